"""Tempo in relational form: autocorrelation peaks, candidates, comb scores, refinement, finalists, beat phase."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as k
from ..functions.expr import fold, normalized_confidence, prior, tempo_confidence
from .frames import autocorrelation, interpolated, over, smooth


def lags(fps: float) -> tuple[int, int]:
    return max(2, math.floor(60 * fps / k.SEARCH_HIGH)), math.ceil(60 * fps / k.SEARCH_LOW)


def peaks(series: DataFrame, fps: float) -> DataFrame:
    """(clip, lag, bpm, weight, rank): the ten heaviest local maxima of the autocorrelation under the prior."""
    least, most = lags(fps)
    acf = autocorrelation(series, most)
    order = over("clip").orderBy("lag")
    end = F.least(F.lit(most), F.max("lag").over(over("clip")) - 1)
    w = acf.withColumn("end", end).where(F.col("lag") >= least).withColumn("bpm", 60 * fps / F.col("lag")).withColumn("weight", F.col("acf") * prior(F.col("bpm")))
    near = w.withColumn("before", F.lag("weight").over(order)).withColumn("after", F.lead("weight").over(order))
    top = near.where((F.col("lag") > least) & (F.col("lag") < F.col("end")) & (F.col("weight") > F.col("before")) & (F.col("weight") >= F.col("after")) & (F.col("weight") > 0))
    rank = F.row_number().over(Window.partitionBy("clip").orderBy(F.desc("weight"), "lag"))
    return top.withColumn("rank", rank).where(F.col("rank") <= k.ACF_PEAKS).select("clip", "lag", "bpm", "weight", "rank")


def apart(sorted_values: Column, least: float = 0.5) -> Column:
    """Of an array, each value that is ``least`` away from all kept before it."""
    return F.aggregate(sorted_values, F.array().cast("array<double>"), lambda kept, v: F.when(F.exists(kept, lambda o: F.abs(o - v) < least), kept).otherwise(F.concat(kept, F.array(v))))


def candidates(series: DataFrame, fps: float) -> DataFrame:
    """(clip, place, bpm): folded peaks and their metric relatives, heaviest first, half a BPM apart."""
    ratios = F.array(*map(F.lit, k.RATIOS))
    told = peaks(series, fps).select("clip", "rank", F.posexplode(ratios).alias("i", "ratio"), "bpm")
    folded = told.select("clip", F.struct("rank", "i", fold(F.col("bpm") * F.col("ratio")).alias("v")).alias("s")).where("s.v > 0")
    kept = folded.groupBy("clip").agg(apart(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["v"])).alias("kept"))
    return kept.select("clip", F.posexplode("kept").alias("place", "bpm"))


def on_grid(xs: Column, period: Column, phase: Column) -> Column:
    """Mean, deviation and number of beats of ``xs`` on one grid."""
    beats = (F.floor((F.size(xs) - 1 - phase) / period) + 1).cast("int")
    values = F.transform(F.sequence(F.lit(0), F.greatest(beats, F.lit(1)) - 1), lambda i: interpolated(xs, phase + i * period))
    sums = F.aggregate(values, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("q")), lambda acc, v: F.struct((acc["a"] + v).alias("a"), (acc["q"] + v * v).alias("q")))
    mean = sums["a"] / beats
    return F.struct(mean.alias("mean"), F.sqrt(F.greatest(sums["q"] / beats - mean * mean, F.lit(0.0))).alias("sd"), beats.alias("beats"))


def lengths(series: DataFrame) -> DataFrame:
    return series.groupBy("clip").agg(F.count("*").alias("_n"))


def grids(series: DataFrame, tempos: DataFrame, fps: float) -> DataFrame:
    """(columns of ``tempos``, period, s, mean, sd): each tempo's grids at every half phase s / 2 that fit four beats.

    A row a beat, joined with the frame it falls behind and the frame after.
    """
    keys, n, period = tempos.columns, F.col("_n"), F.col("period")
    begun = tempos.join(lengths(series), "clip").withColumn("period", 60 * fps / F.col("bpm")).where((period >= 2) & (F.floor(period) < n))
    begun = begun.select(*keys, "period", "_n", F.explode(F.sequence(F.lit(0), F.ceil(period * 2).cast("int") - 1)).alias("s"))
    beats = (F.floor((n - 1 - F.col("s") * 0.5) / period) + 1).cast("int")
    points = begun.where(beats >= 4).select(*keys, "period", "s", F.explode(F.sequence(F.lit(0), beats - 1)).alias("_k")).withColumn("_at", F.col("s") * 0.5 + F.col("_k") * period).withColumn("t", F.floor("_at"))
    known = series.select("clip", F.col("t").cast("long").alias("t"), "x", F.coalesce(F.lead("x").over(over("clip").orderBy("t")), "x").alias("_next"))
    v = F.col("x") + (F.col("_next") - F.col("x")) * (F.col("_at") - F.col("t"))
    sums = points.join(known, ["clip", "t"]).withColumn("_v", v).groupBy(*keys, "period", "s").agg(F.avg("_v").alias("mean"), F.avg(F.col("_v") * F.col("_v")).alias("_q"))
    return sums.select(*keys, "period", "s", "mean", F.sqrt(F.greatest(F.col("_q") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("sd"))


def comb(series: DataFrame, tempos: DataFrame, fps: float) -> DataFrame:
    """(clip, bpm, score, mean, sd, phase, and what else ``tempos`` has) of each tempo whose grid fits four beats, at its best phase, the first of equals."""
    keys = tempos.columns
    best = grids(series, tempos, fps).groupBy(*keys).agg(F.max(F.struct("mean", (-F.col("s")).alias("neg"), "sd", "period")).alias("b"))
    best = best.select(*keys, "b.mean", "b.sd", "b.period", (-F.col("b.neg") * 0.5).alias("phase"))
    line = lambda d: (F.col("t") - F.col("phase")) / F.col("period") * d
    off = lambda d: F.abs(line(d) - F.round(line(d))) * (F.col("period") / d)
    up = series.select("clip", "t", F.greatest("x", F.lit(0.0)).alias("_up"))
    near = [F.sum(F.when(off(d) <= k.HALF_WIDTH_SECS * fps, F.col("_up")).otherwise(0.0)).alias(f"_near{d}") for d in k.LATTICE]
    found = best.join(up, "clip").groupBy(*keys, "mean", "sd", "phase").agg(F.sum("_up").alias("_all"), *near)
    lost = lambda d: F.when(F.col("_all") > 0, 1 - F.least(F.col(f"_near{d}") / F.when(F.col("_all") > 0, F.col("_all")), F.lit(1.0))).otherwise(1.0)
    miss = sum((lost(d) for d in k.LATTICE[1:]), lost(k.LATTICE[0]))
    score = F.col("mean") - k.CONSISTENCY * F.col("sd") - k.MISS * miss
    return found.select("clip", "bpm", score.alias("score"), "mean", "sd", "phase", *[c for c in keys if c not in ("clip", "bpm")])


def around(bpm: Column, step: Column, span: float) -> Column:
    """Tempos within a share ``span`` of ``bpm``, ``step`` of it apart."""
    half = F.ceil(span / step).cast("int")
    return F.transform(F.sequence(-half, half), lambda i: bpm * (1 + i * step))


def refined(soft: DataFrame, coarse: DataFrame, fps: float) -> DataFrame:
    """(clip, place, bpm, score, mean, sd, phase): the best tempo near each of ``coarse`` (clip, place, bpm) on the smoothed series, itself first.

    A grid so fine that a beat drifts by a sixteenth over the clip at most; nothing near
    below four beats.
    """
    rows = coarse.join(lengths(soft), "clip").withColumn("_beats", F.col("_n") / fps * F.col("bpm") / 60)
    near = F.filter(around(F.col("bpm"), k.REFINE_DRIFT / F.col("_beats"), k.REFINE_SPAN), lambda v: (v >= k.LOW_BPM) & (v < k.HIGH_BPM))
    tried = F.concat(F.array("bpm"), F.when(F.col("_beats") >= 4, near).otherwise(F.array().cast("array<double>")))
    got = comb(soft, rows.select("clip", "place", F.posexplode(tried).alias("turn", "bpm")), fps)
    best = got.groupBy("clip", "place").agg(F.max(F.struct("score", (-F.col("turn")).alias("neg"), "bpm", "mean", "sd", "phase")).alias("b"))
    return best.select("clip", "place", "b.bpm", "b.score", "b.mean", "b.sd", "b.phase")


def precise(series: DataFrame, tempos: DataFrame, fps: float) -> DataFrame:
    """``tempos`` (clip, place, bpm) moved to the highest grid mean close by, the lowest of equals; as they are where none fits four beats."""
    rows = tempos.select("clip", "place", F.col("bpm").alias("from")).join(lengths(series).where("_n >= 8"), "clip")
    near = rows.select("clip", "place", F.posexplode(around(F.col("from"), k.PRECISION_DRIFT / F.col("_n"), k.PRECISION_SPAN)).alias("turn", "bpm"))
    best = grids(series, near, fps).groupBy("clip", "place").agg(F.max(F.struct("mean", (-F.col("turn")).alias("neg"), "bpm")).alias("b"))
    return tempos.select("clip", "place", "bpm").join(best, ["clip", "place"], "left").select("clip", "place", F.coalesce("b.bpm", "bpm").alias("bpm"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("clip").orderBy(*order)))


def finalists(series: DataFrame, fps: float) -> DataFrame:
    """(clip, rank, bpm, score, mean, sd, phase): the best refined candidates, made precise on the series as it is and scored on it again."""
    soft = smooth(series, math.floor(k.SMOOTH_SECS * fps + 0.5))
    tried = refined(soft, candidates(series, fps), fps).where(~F.isnan("score") & (F.abs("score") < float("inf")))
    few = ranked(tried, F.desc("score"), F.col("place")).where(F.col("rank") <= k.FINALISTS).select("clip", F.col("rank").alias("place"), "bpm")
    fine = comb(series, precise(series, few, fps).withColumn("bpm", fold(F.col("bpm"))), fps)
    return ranked(fine, F.desc("score"), F.col("place")).select("clip", "rank", "bpm", "score", "mean", "sd", "phase")


def estimates(series: DataFrame, fps: float) -> DataFrame:
    """(clip, bpm, score, rival, half, double, confidence): the first finalist, the score of the next one that is not the same tempo, and of half and double."""
    found = finalists(series, fps)
    first = found.where("rank = 1").drop("rank")
    others = found.where("rank > 1").select("clip", F.col("bpm").alias("_bpm"), F.col("score").alias("_score"), F.col("rank").alias("_rank"))
    rival = first.join(others, "clip").where(F.abs(F.col("_bpm") - F.col("bpm")) >= 0.5).groupBy("clip").agg(F.min(F.struct("_rank", "_score")).alias("r")).select("clip", F.col("r._score").alias("rival"))
    metric = first.select("clip", F.explode(F.array(F.struct(F.lit(0).alias("d"), (F.col("bpm") / 2).alias("bpm")), F.struct(F.lit(1).alias("d"), (F.col("bpm") * 2).alias("bpm")))).alias("m")).select("clip", "m.*")
    metric = comb(series, metric, fps).groupBy("clip").agg(F.max(F.when(F.col("d") == 0, F.col("score"))).alias("half"), F.max(F.when(F.col("d") == 1, F.col("score"))).alias("double"))
    acf = autocorrelation(series, lags(fps)[1]).groupBy("clip").agg(F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda p: p["acf"]).alias("acf"))
    rows = first.join(rival, "clip", "left").join(metric, "clip", "left").join(acf, "clip").join(lengths(series), "clip")
    sure = tempo_confidence(F.col("mean"), F.col("sd"), F.col("score") - F.col("rival"), interpolated(F.col("acf"), 60 * fps / F.col("bpm")), F.col("_n") / fps * F.col("bpm") / 60)
    return rows.select("clip", "bpm", "score", "rival", "half", "double", normalized_confidence(sure).alias("confidence"))


def beat_phases(envelopes: DataFrame, tempos: DataFrame, fps: float) -> DataFrame:
    """(clip, bpm, phase) of (clip, t, x, kick) and (clip, bpm, otherwise): where beats fall, in frames.

    Of the phases shortly before or on a strong rise of the kick, the one of the strongest
    onsets, the last of equals; ``otherwise`` where the kick hardly rises.  Phases are a
    circle of half frames.
    """
    held = F.sort_array(F.collect_list(F.struct("t", "x", "kick")))
    rows = envelopes.groupBy("clip").agg(held.alias("_h")).select("clip", F.transform("_h", lambda p: p["x"]).alias("xs"), F.transform("_h", lambda p: p["kick"]).alias("ks"))
    rows = rows.join(tempos, "clip").withColumn("period", 60 * fps / F.col("bpm")).withColumn("steps", F.ceil(F.col("period") * 2).cast("int"))
    period, steps = F.col("period"), F.col("steps")
    circle = F.sequence(F.lit(0), steps - 1)
    at = lambda array, i: F.element_at(array, (F.pmod(i, steps) + 1).cast("int"))
    phase = lambda s: F.pmod(s * 0.5, period)
    rows = rows.withColumn("kick", F.transform(circle, lambda s: on_grid(F.col("ks"), period, phase(s))["mean"]))
    width = max(1, math.floor(k.KICK_RISE_SECS * fps * 2 + 0.5))
    kick = F.col("kick")
    turned = lambda s: sum((at(kick, s + i) - at(kick, s - i) for i in range(2, width + 1)), at(kick, s + 1) - at(kick, s - 1)) / width
    rows = rows.withColumn("rise", F.transform(circle, turned)).withColumn("top", F.array_max("rise"))
    lead, lag = ((F.floor(share * period * 2 + 0.5)).cast("int") for share in (k.KICK_LEAD, k.KICK_LAG))
    near = lambda s: F.exists(F.sequence(-lag, lead), lambda i: at(F.col("rise"), s + i) >= k.KICK_SHARE * F.col("top"))
    onset = F.transform(F.filter(circle, near), lambda s: F.struct(on_grid(F.col("xs"), period, phase(s))["mean"].alias("mean"), s.alias("s")))
    found = phase(F.array_max(onset)["s"])
    return rows.select("clip", "bpm", F.when(F.col("top") >= k.KICK_LEAST, found).otherwise(F.col("otherwise")).alias("phase"))
