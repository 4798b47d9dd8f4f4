"""Key estimation in relational form."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as k
from ..functions.expr import camelot, camelot_number, key_name, normalized_confidence, ramp, ratio, relation, uncertain
from .frames import over


def chromagram(spectrum: DataFrame, bin_hz: float) -> DataFrame:
    """(clip, pc, e) from (clip, t, b, mag): class means of bins in 110-3520 Hz, frames scaled to 1, summed; nothing where a class has no bin."""
    hz = F.col("b") * bin_hz
    inside = spectrum.where((hz >= k.CHROMA_LOW) & (hz <= k.CHROMA_HIGH))
    pc = F.pmod(F.round(69 + 12 * F.log2(hz / 440.0)).cast("int"), F.lit(12))
    mean = inside.groupBy("clip", "t", pc.alias("pc")).agg(F.avg("mag").alias("e"))
    share = mean.withColumn("all", F.sum("e").over(over("clip", "t"))).withColumn("classes", F.count("*").over(over("clip", "t"))).where("classes = 12")
    return share.groupBy("clip", "pc").agg(F.sum(ratio(F.col("e"), F.col("all"))).alias("e"))


def gates(chroma: DataFrame) -> DataFrame:
    """(clip, salience, tonal_pitch_classes, structure, coverage) of (clip, pc, e)."""
    shifted = chroma.withColumn("p", F.col("e") - F.min("e").over(over("clip")))
    found = shifted.groupBy("clip").agg(F.stddev_pop("e").alias("sd"), F.avg("e").alias("mean"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("s2"))
    sal, tpc = ratio(F.col("sd"), F.col("mean")), F.when(F.col("s") > 1e-9, F.col("s") * F.col("s") / F.when(F.col("s") > 1e-9, F.col("s2"))).otherwise(0.0)
    out = found.select("clip", sal.alias("salience"), tpc.alias("tonal_pitch_classes"))
    return out.withColumn("structure", ramp(F.col("salience"), k.SALIENCE_FLOOR, k.SALIENCE_FULL)).withColumn("coverage", ramp(F.col("tonal_pitch_classes"), k.COVER_FLOOR, k.COVER_FULL))


def profiles(spark: SparkSession, name: str) -> DataFrame:
    """(degree, minor, w): 24 rows, always."""
    rows = [(i, bool(m), float(w)) for m, shape in enumerate(k.PROFILES[name]) for i, w in enumerate(shape)]
    return spark.createDataFrame(rows, "degree int, minor boolean, w double").coalesce(1)


def band_weights(spark: SparkSession) -> DataFrame:
    """(band, degree, minor, w): 120 rows, always."""
    rows = [(b, i, bool(m), float(w)) for m, mode in enumerate(k.BAND_WEIGHTS) for b, band in enumerate(mode) for i, w in enumerate(band)]
    return spark.createDataFrame(rows, "band int, degree int, minor boolean, w double").coalesce(1)


def turned(chroma: DataFrame) -> DataFrame:
    """Every class as a degree above each of the 12 tonics."""
    return chroma.withColumn("tonic", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("degree", F.pmod(F.col("pc") - F.col("tonic"), F.lit(12)).cast("int"))


def correlations(chroma: DataFrame, profile: str) -> DataFrame:
    """(clip, tonic, minor, score): Pearson's r of each rotated chroma with both profiles, 0 without variance."""
    both = turned(chroma).join(F.broadcast(profiles(chroma.sparkSession, profile)), "degree")
    x, y, n = F.col("e"), F.col("w"), F.lit(12.0)
    s = both.groupBy("clip", "tonic", "minor").agg(F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    den = F.sqrt(F.greatest(F.col("xx") - F.col("x") * F.col("x") / n, F.lit(0.0)) * F.greatest(F.col("yy") - F.col("y") * F.col("y") / n, F.lit(0.0)))
    return s.select("clip", "tonic", "minor", ratio(F.col("xy") - F.col("x") * F.col("y") / n, den).alias("score"))


def probabilities(bands: DataFrame) -> DataFrame:
    """(clip, tonic, minor, score): softmax of the learned band scores of (clip, band, pc, e)."""
    both = turned(bands).join(F.broadcast(band_weights(bands.sparkSession)), ["band", "degree"])
    bias = F.when(F.col("minor"), k.MODE_BIAS[1]).otherwise(k.MODE_BIAS[0])
    z = both.groupBy("clip", "tonic", "minor").agg(F.sum(F.col("w") * F.col("e")).alias("z")).withColumn("z", F.col("z") + bias)
    e = z.withColumn("e", F.exp(F.col("z") - F.max("z").over(over("clip"))))
    return e.select("clip", "tonic", "minor", (F.col("e") / F.sum("e").over(over("clip"))).alias("score"))


def slopes(bands: DataFrame, keys: DataFrame, l2: float = 1e-2) -> DataFrame:
    """(minor, band, degree, slope, loss) of (clip, band, pc, e) and (clip, tonic, minor): how the fitted loss changes with each learned weight.

    The loss is the mean cross entropy of ``probabilities`` with half of ``l2`` times the
    squared weights.  Each band energy counts for the weight of its degree above each of
    the 24 keys, by what the key's share exceeds the truth.
    """
    n = keys.count()
    shares = probabilities(bands).join(keys.select("clip", F.col("tonic").alias("_tonic"), F.col("minor").alias("_minor")), "clip")
    over_ = shares.withColumn("right", (F.col("tonic") == F.col("_tonic")) & (F.col("minor") == F.col("_minor")))
    over_ = over_.select("clip", "tonic", "minor", (F.col("score") - F.col("right").cast("double")).alias("over"), F.when(F.col("right"), -F.ln("score")).alias("lost"))
    weights = F.broadcast(band_weights(bands.sparkSession))  # 120 rows
    each = turned(bands).join(over_.drop("lost"), ["clip", "tonic"]).groupBy("minor", "band", "degree").agg((F.sum(F.col("over") * F.col("e")) / n).alias("slope"))
    loss = (over_.agg(F.sum("lost")).first()[0] or 0.0) / max(n, 1) + l2 / 2 * float(sum(w * w for mode in k.BAND_WEIGHTS for band in mode for w in band))  # one number
    return each.join(weights, ["minor", "band", "degree"]).select("minor", "band", "degree", (F.col("slope") + l2 * F.col("w")).alias("slope"), F.lit(loss).alias("loss"))


def ranked(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("clip").orderBy(F.desc("score"), "tonic", "minor")
    return scores.withColumn("rank", F.row_number().over(order))


def winners(scores: DataFrame) -> DataFrame:
    """One row a clip: its best key, the runner-up's score, and ranks 2 to 4 as alternates."""
    top = ranked(scores).where(F.col("rank") <= 4)
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    rest = F.sort_array(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "tonic", "minor", "score"))))
    got = top.groupBy("clip").agg(at("tonic", 1).alias("tonic"), at("minor", 1).alias("minor"), at("score", 1).alias("r1"), at("score", 2).alias("r2"), rest.alias("rest"))
    label = lambda a: F.concat(key_name(a["tonic"], a["minor"]), F.lit(" ("), camelot(a["tonic"], a["minor"]), F.lit(")"))
    alternate = lambda a: F.struct(camelot_number(a["tonic"], a["minor"]).cast("double").alias("value"), label(a).alias("label"), relation(F.col("tonic"), F.col("minor"), a["tonic"], a["minor"]).alias("relation"), F.round(a["score"], 3).alias("score"))
    return got.withColumn("alternates", F.transform("rest", alternate)).drop("rest")


def estimate(scores: DataFrame, gate: DataFrame, learned: bool) -> DataFrame:
    """(clip, key, camelot, confidence, uncertain, ...): the winner and its confidence factors."""
    rows = winners(scores).join(gate, "clip").where(F.col("r1") > 0)
    if learned:
        strength, margin, cover = F.col("r1"), F.lit(1.0), ramp(F.col("tonal_pitch_classes"), k.BAND_COVER_FLOOR, k.BAND_COVER_FULL)
    else:
        strength, margin, cover = ramp(F.col("r1"), k.KEY_FLOOR, k.KEY_FULL), 1 - F.exp(-((F.col("r1") - F.col("r2")) / F.col("r1")) / k.KEY_MARGIN), F.col("coverage")
    rows = rows.withColumn("strength", strength).withColumn("margin", margin).withColumn("coverage", cover)
    rows = rows.withColumn("confidence", normalized_confidence(F.col("strength") * F.col("margin") * F.col("structure") * F.col("coverage")))
    tonic, minor = F.col("tonic"), F.col("minor")
    return rows.select("clip", key_name(tonic, minor).alias("key"), camelot(tonic, minor).alias("camelot"), "confidence", uncertain(F.col("confidence")).alias("uncertain"), F.col("r1").alias("correlation"), F.col("r2").alias("runner_up"), "salience", "tonal_pitch_classes", "strength", "margin", "structure", "coverage", "alternates")


def band_grid(grid: DataFrame) -> DataFrame:
    """(clip, band, pc, e) of a log-frequency grid (clip, t, j, g): compressed, whitened across frequency, read on semitones, all summing to 12."""
    peak = F.max("g").over(over("clip"))
    log = grid.withColumn("x", F.log1p(ratio(k.GRID_GAIN * F.col("g"), peak)))
    half = k.GRID_WHITEN // 2
    level = F.avg("x").over(over("clip", "t").orderBy("j").rowsBetween(-half, half - 1))
    midi = (k.GRID_LOW + F.col("j") / k.GRID_STEP).cast("int")
    band = F.lit(None).cast("int")
    for i, (low, high) in enumerate(k.BANDS):
        band = F.when((midi >= low) & (midi < high), i).otherwise(band)
    found = log.withColumn("level", level).where(F.col("j") % k.GRID_STEP == 0).select("clip", band.alias("band"), (midi % 12).alias("pc"), F.greatest(F.col("x") - F.col("level"), F.lit(0.0)).alias("e")).where("band IS NOT NULL")
    total = found.groupBy("clip", "band", "pc").agg(F.sum("e").alias("e"))
    return total.withColumn("e", ratio(12.0 * F.col("e"), F.sum("e").over(over("clip"))))


def taps(rate: float, n: int) -> list[tuple[int, int, float | None]]:
    """(j, bin, weight) of the log-frequency grid over spectra of windows of ``n``: of a grid place as wide as a bin all its bins, unweighted; of a narrower one its two neighbours."""
    bins, df, out = n // 2 + 1, rate / n, []
    hz = lambda note: 440 * 2 ** ((note - 69) / 12)
    for j in range(k.GRID_BINS):
        note = k.GRID_LOW + j / k.GRID_STEP
        low, high = math.ceil(hz(note - 0.5 / k.GRID_STEP) / df), math.floor(hz(note + 0.5 / k.GRID_STEP) / df)
        place = hz(note) / df
        at = math.floor(place)
        if high >= low:
            out += [(j, b, None) for b in range(min(low, bins - 1), min(high, bins - 1) + 1)]
        elif at + 1 < bins:
            out += [(j, at, 1 - (place - at)), (j, at + 1, place - at)]
        else:
            out.append((j, 0, 0.0))
    return out


def grid_taps(spectrum: DataFrame, rate: float, n: int) -> DataFrame:
    """(clip, t, j, g) of (clip, t, b, mag): the peak of each grid place's bins, or the value between its neighbours.

    Places are intervals of bins; each is listed bin by bin, a table as long as a spectrum,
    so that the interval join is one on equal bins.
    """
    table = spectrum.sparkSession.createDataFrame(taps(rate, n), "j int, b int, w double")
    met = spectrum.join(F.broadcast(table), "b")
    return met.groupBy("clip", "t", "j").agg(F.coalesce(F.max(F.when(F.col("w").isNull(), F.col("mag"))), F.sum(F.col("mag") * F.col("w"))).alias("g"))
