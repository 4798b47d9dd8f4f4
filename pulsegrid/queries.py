"""One registered query an operator, over the driver's tables as proxies.

Each takes (spark, sf_dir).  Vectors of ``embeddings`` stand for mel frames (a label is a
clip, 20 frames a second), spectra or chroma; hourly sums of ``events`` for series.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .constants import PITCHES
from .functions import expr, sql, synth
from .functions.sql import analyze_audio
from .operators import cache, frames, kernels, key, match, tempo, validate
from .plans import batch
from .schema import analysis
from .sources import catalog, lines
from .streaming import batch as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FPS, HOURS = 20.0, 720


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), t.alias("t"), "embedding")
    return rows.select("clip", "t", F.posexplode("embedding").alias("m", "x")).select("clip", "t", "m", F.abs(F.col("x").cast("double")).alias("v"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip"), x.alias("x"))


def twelve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("clip", F.posexplode(F.slice("x", 1, 12)).alias("pc", "e"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, t, x): value summed by event type and hour, all hours there."""
    events = table(spark, sf_dir, "events")
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - 1704067200) / 3600).cast("long")
    sums = events.groupBy(F.col("event_type").alias("clip"), hour.alias("t")).agg(F.sum("value").alias("x"))
    grid = events.select(F.col("event_type").alias("clip")).distinct().select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOURS - 1).cast("long"))).alias("t"))
    return grid.join(sums, ["clip", "t"], "left").select("clip", "t", F.coalesce("x", F.lit(0.0)).alias("x"))


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = lambda n: F.col("o_orderkey") % n == 0
    fields = F.struct(F.when(o(5), F.col("o_custkey")).alias("track_id"), F.when(~o(7), F.col("o_orderstatus")).alias("artist"), F.when(o(11), " ").otherwise(F.col("o_orderpriority")).alias("title"))
    line = F.when(o(19), " ").when(o(17), "this is not json").when(o(13), "[1]").otherwise(F.to_json(fields))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), line.alias("line"))


@query
def batch_parse(spark, sf_dir):
    return lines.parsed(request_lines(spark, sf_dir)).select("line_no", "query.artist", "query.title", "query.track_id", F.col("error.kind").alias("error"))


@query
def batch_ordered_results(spark, sf_dir):
    parsed = lines.parsed(request_lines(spark, sf_dir))
    none = lambda kind: F.lit(None).cast(kind)
    from .schema import AUDIO, FEATURES, TRACK

    done = parsed.select("line_no", analysis(F.col("query"), none(TRACK), none(FEATURES), none(AUDIO), F.lit(False), F.col("error")).alias("analysis"))
    status = F.get_json_object("value", "$.status")
    # a global place without a global sort: places inside ranges, after counts of the ranges before
    ranged = lines.rendered(done).select("line_no", status.alias("status")).repartitionByRange("line_no").withColumn("part", F.spark_partition_id())
    ranged = scratch.written(ranged, "ranged")
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("line_no"))
    return ranged.withColumn("place", place).join(F.broadcast(before.drop("n")), "part").select((F.col("place") + F.col("skip")).cast("long").alias("place"), "line_no", "status")


@query
def pcm_stats(spark, sf_dir):
    pcm = table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), F.explode(F.transform("embedding", lambda v: v.cast("double"))).alias("x"))
    return rounded(frames.pcm_stats(pcm), peak=6, rms=6, silent_fraction=6)


@query
def sanitize(spark, sf_dir):
    nan = lambda c: F.when(F.col("l_linenumber") == 2, float("nan")).when(F.col("l_linenumber") == 3, float("inf")).otherwise(c)
    sure = expr.normalized_confidence(nan(F.col("l_discount") * 20 - 0.2))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", expr.finite(nan(F.col("l_extendedprice"))).alias("x"), sure.alias("confidence"))
    return rows.withColumn("uncertain", expr.uncertain(F.col("confidence")))


@query
def mono_downmix(spark, sf_dir):
    pcm = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), (F.col("l_suppkey") % 2).alias("t"), F.col("l_linenumber").alias("channel"), F.col("l_quantity").alias("x"))
    return rounded(frames.downmix(pcm), x=6)


@query
def kick_energy(spark, sf_dir):
    return rounded(frames.kick_energy(mel(spark, sf_dir), 2), kick=6)


@query
def whiten(spark, sf_dir):
    return rounded(frames.whiten(mel(spark, sf_dir), FPS), v=6)


@query
def log_flux(spark, sf_dir):
    return rounded(frames.log_flux(mel(spark, sf_dir)), x=6)


@query
def onset_envelope(spark, sf_dir):
    return rounded(frames.onset_envelope(mel(spark, sf_dir), FPS, 2), x=6, kick=6)


@query
def detrend(spark, sf_dir):
    return rounded(frames.detrend(hourly(spark, sf_dir), 30), x=5)


@query
def zscore_pulse(spark, sf_dir):
    series = hourly(spark, sf_dir)
    return rounded(frames.zscore(series).join(frames.pulse_strength(series), "clip"), x=6, pulse_strength=6)


@query
def autocorrelation(spark, sf_dir):
    return rounded(frames.autocorrelation(hourly(spark, sf_dir), tempo.lags(FPS)[1]), acf=6)


@query
def acf_peaks_topk(spark, sf_dir):
    return rounded(tempo.peaks(hourly(spark, sf_dir), FPS), bpm=6, weight=6)


@query
def tempo_candidates(spark, sf_dir):
    return rounded(tempo.candidates(hourly(spark, sf_dir), FPS), bpm=6)


@query
def hann_smooth(spark, sf_dir):
    return rounded(frames.smooth(hourly(spark, sf_dir), 6), x=6)


@query
def interp_grid_mean(spark, sf_dir):
    rows = frames.series_of(hourly(spark, sf_dir)).withColumn("period", F.explode(F.array(*map(F.lit, (7.5, 12.25, 24.0))))).withColumn("phase", F.explode(F.array(F.lit(0.0), F.lit(1.5))))
    return rows.select("clip", "period", "phase", F.round(frames.grid_mean(F.col("xs"), F.col("period"), F.col("phase")), 4).alias("mean"))


@query
def tempo_fold(spark, sf_dir):
    bpm = F.col("l_extendedprice") / F.col("l_quantity") - F.when(F.col("l_linenumber") == 7, 1e6).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(expr.fold(bpm), 9).alias("folded"))


@query
def comb_score(spark, sf_dir):
    env = frames.zscore(hourly(spark, sf_dir))
    tempos = env.select("clip").distinct().withColumn("bpm", F.explode(F.array(*map(F.lit, (50.0, 97.0, 131.0)))))
    return rounded(tempo.comb(env, tempos, FPS), score=5, mean=5, sd=5)


@query
def tempo_refine(spark, sf_dir):
    series = frames.zscore(hourly(spark, sf_dir))
    return rounded(tempo.refined(frames.smooth(series, 5), tempo.candidates(series, FPS), FPS), bpm=6, score=5, mean=5, sd=5)


@query
def tempo_finalists(spark, sf_dir):
    return rounded(tempo.finalists(frames.zscore(hourly(spark, sf_dir)), FPS), bpm=6, score=5, mean=5, sd=5)


@query
def tempo_estimates(spark, sf_dir):
    return rounded(tempo.estimates(frames.zscore(hourly(spark, sf_dir)), FPS), bpm=6, score=5, rival=5, half=5, double=5)


@query
def beat_phase(spark, sf_dir):
    env = frames.onset_envelope(mel(spark, sf_dir), FPS, 2)
    tempos = env.select("clip").distinct().select("clip", (F.col("clip") * 8.25 + 91.5).alias("bpm"), F.lit(-1.0).alias("otherwise"))
    return rounded(tempo.beat_phases(env, tempos, FPS), phase=6)


@query
def tempo_confidence(spark, sf_dir):
    mean = F.col("l_extendedprice") / 40000 - 0.1
    gap = F.when(F.col("l_linenumber") != 1, F.col("l_discount") * 12)
    sure = expr.tempo_confidence(mean, F.col("l_tax") * 10, gap, F.col("l_tax") * 8, F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", expr.normalized_confidence(sure).alias("confidence"))


@query
def chromagram(spark, sf_dir):
    spectrum = mel(spark, sf_dir).withColumnsRenamed({"m": "b", "v": "mag"})
    return rounded(key.chromagram(spectrum, 55.0), e=6)


@query
def chroma_gates(spark, sf_dir):
    return rounded(key.gates(twelve(spark, sf_dir)), salience=6, tonal_pitch_classes=6, structure=6, coverage=6)


@query
def key_correlation(spark, sf_dir):
    chroma = twelve(spark, sf_dir)
    best = key.estimate(key.correlations(chroma, "edm"), key.gates(chroma), learned=False)
    return rounded(best.select("clip", "key", "camelot", "correlation", "runner_up", "confidence"), correlation=6, runner_up=6)


@query
def key_softmax(spark, sf_dir):
    bands = vectors(spark, sf_dir).select("clip", F.posexplode(F.slice("x", 1, 60)).alias("i", "e"))
    bands = bands.select("clip", F.floor(F.col("i") / 12).cast("int").alias("band"), (F.col("i") % 12).alias("pc"), "e")
    return rounded(key.probabilities(bands), score=6)


@query
def band_grid(spark, sf_dir):
    wide = F.transform(F.sequence(F.lit(0), F.lit(251)), lambda j: F.element_at("x", (j % 64 + 1).cast("int")))
    grid = vectors(spark, sf_dir).select("clip", F.lit(0).alias("t"), F.posexplode(wide).alias("j", "g"))
    return rounded(key.band_grid(grid), e=6)


#: Sampling rates at which spectra of 64 bins are read as windows of 126 samples.
TAP_RATES, TAP_WINDOW = (8000.0, 22050.0, 44100.0), 126


@query
def grid_taps(spark, sf_dir):
    spectrum = mel(spark, sf_dir).withColumnsRenamed({"m": "b", "v": "mag"})
    one = lambda rate: key.grid_taps(spectrum, rate, TAP_WINDOW).withColumn("rate", F.lit(rate))
    taps = one(TAP_RATES[0])
    for rate in TAP_RATES[1:]:
        taps = taps.unionByName(one(rate))
    return rounded(taps, g=6)


def two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the 24 keys, by a join on the pairs' numbers: 24 rows on either side, always."""
    n = table(spark, sf_dir, "nation").where("n_nationkey < 24").select(F.col("n_nationkey").cast("long").alias("n"))
    pairs = n.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long")))).join(n.select(F.col("n").alias("o")), "o")
    return pairs.select((F.col("n") % 12).alias("tonic"), (F.col("n") >= 12).alias("minor"), (F.col("o") % 12).alias("other"), (F.col("o") >= 12).alias("other_minor"))


@query
def key_labels(spark, sf_dir):
    t, m, o, om = map(F.col, ("tonic", "minor", "other", "other_minor"))
    return two_keys(spark, sf_dir).select(t, m, o, om, expr.key_name(t, m).alias("key"), expr.camelot(o, om).alias("camelot"), expr.relation(t, m, o, om).alias("relation"))


@query
def stft_dft(spark, sf_dir):
    framed = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("t"), "embedding")
    framed = framed.select("clip", "t", F.transform(F.slice("embedding", (F.col("t") * 8 + 1).cast("int"), F.lit(16)), lambda x: x.cast("double")).alias("xs"))
    return rounded(frames.dft(framed, 16), mag=6)


@query
def stft_fft(spark, sf_dir):
    """A label's vectors one after another are a clip."""
    pieces = table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), F.col("vec_id").alias("place"), F.col("embedding").alias("xs"))
    windows = frames.framed_pieces(pieces, 1024, 1024).select("clip", "t", F.transform("xs", lambda x: x.cast("double")).alias("xs"))
    return rounded(frames.fft(windows, 1024), mag=5)


@query
def normalize_text(spark, sf_dir):
    text = F.concat(F.lit("  "), "p_name", F.lit(" & "), "p_brand", F.lit("--("), "p_type", F.lit(")! "))
    return table(spark, sf_dir, "part").select("p_partkey", match.normalize(text).alias("plain"))


@query
def similarity_pairs(spark, sf_dir):
    """Pairs of parts of one brand and size; two names that many parts have are compared once."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    held = match.bundled(part.where("p_partkey IS NOT NULL"), "p_partkey").withColumn("at", F.struct("p_name", "part"))
    held = match.spread(held, "p_brand", "p_size")
    a, b = held.alias("a"), held.alias("b")
    met = a.join(b, ["p_brand", "p_size"]).where("a.at <= b.at")
    alike = F.round(match.similarity(F.col("a.p_name"), F.col("b.p_name")), 6)
    rows = met.select(F.col("a.held").alias("x"), F.col("b.held").alias("y"), (F.col("a.at") == F.col("b.at")).alias("same"), alike.alias("similarity"))
    rows = rows.select(F.explode("x").alias("x"), "y", "same", "similarity").select("x", F.explode("y").alias("y"), "same", "similarity")
    x, y = F.col("x.p_partkey"), F.col("y.p_partkey")
    rows = rows.where((x < y) | ((x > y) & ~F.col("same")))  # bundles meet once, whichever has the smaller key
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "similarity")


def match_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests and entries, which meet by brand and name."""
    n, name, kind, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.col("p_brand")
    titles = [name, F.concat(name, F.lit(" (Radio Edit)")), F.concat(name, F.lit(" (Deep Dish Remix)")), F.concat(name, F.lit(" [feat. "), kind, F.lit("]")), F.concat(name, F.lit(" (Remastered 2011)")), F.concat(name, F.lit(" feat. "), kind)]
    artists = [F.concat(brand, F.lit(" & "), kind), F.concat(brand, F.lit(" feat. Guest")), brand, brand]
    pick = lambda of: F.element_at(F.array(*of), (n % len(of) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(n.alias("id"), brand.alias("brand"), name.alias("name"), pick(titles).alias("title"), pick(artists).alias("artist"), F.when(n % 7 != 0, "there").alias("preview"))
    asked = rows.select(F.col("id").alias("query_id"), "brand", "name", F.col("title").alias("q_title"), F.col("artist").alias("q_artist"))
    known = rows.select(F.col("id").alias("c_track_id"), "brand", "name", F.col("title").alias("c_title"), F.col("artist").alias("c_artist"), F.col("preview").alias("c_preview"))
    return asked, known


@query
def match_scores(spark, sf_dir):
    """All pairs of one brand and name; what equal parts have in common is read and scored once."""
    asked, known = match_pairs(spark, sf_dir)
    asked = match.bundled(asked, "query_id").withColumnRenamed("held", "asking").drop("part")
    known = match.bundled(known.drop("c_preview"), "c_track_id").drop("part")
    pairs = match.read_requests(match.spread(asked, "brand", "name")).join(match.read_entries(match.spread(known, "brand", "name")), ["brand", "name"])
    rows = match.scored(pairs).select("asking", "held", F.round("score", 6).alias("score"), F.col("qualifier_bytes").cast("long").alias("qualifier_bytes"))
    rows = rows.select(F.explode("asking").alias("a"), "held", "score", "qualifier_bytes").select("a", F.explode("held").alias("h"), "score", "qualifier_bytes")
    return rows.select("a.query_id", F.col("h.c_track_id").alias("track_id"), "score", "qualifier_bytes")


@query
def pick_best(spark, sf_dir):
    """Of entries that are equal but for their ids only the smallest can win; requests that are equal but for theirs have one answer."""
    asked, known = match_pairs(spark, sf_dir)
    asked = asked.select("query_id", F.struct(*[c for c in asked.columns if c != "query_id"]).alias("asked"))
    known = known.where("c_track_id IS NOT NULL AND c_preview IS NOT NULL")
    known = known.groupBy(*[c for c in known.columns if c != "c_track_id"]).agg(F.min("c_track_id").alias("c_track_id"))
    each = match.spread(asked.select("asked").distinct().select("asked", "asked.*"), "brand", "name")
    pairs = match.read_requests(each).join(match.read_entries(match.spread(known, "brand", "name")), ["brand", "name"])
    answer = F.struct((-F.col("score")).alias("score"), "qualifier_bytes", F.col("c_track_id").alias("track_id"), "match_score", "uncertain").alias("answer")
    best = asked.join(match.pick_best(pairs, "asked").select("asked", answer), "asked")
    best = best.groupBy("query_id").agg(F.min("answer").alias("answer"))  # requests of one id are one
    return best.select("query_id", "answer.track_id", "answer.match_score", "answer.uncertain")


@query
def block_and_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    asked = part.select(F.col("p_partkey").alias("query_id"), F.col("p_brand").alias("q_artist"), F.col("p_name").alias("q_title"))
    known = part.select(F.col("p_partkey").alias("c_track_id"), F.col("p_brand").alias("c_artist"), F.col("p_name").alias("c_title"), F.lit("there").alias("c_preview"))
    return match.pick_best(match.block(asked, known)).select("query_id", F.col("c_track_id").alias("track_id"), "match_score")


@query
def resolution_key(spark, sf_dir):
    n = F.col("c_custkey")
    code = F.element_at(F.array(F.lit(None).cast("string"), F.lit("de"), F.lit("us"), F.lit(None).cast("string")), (n % 4 + 1).cast("int"))
    title = F.when(n % 7 == 0, "  ").otherwise(F.col("c_mktsegment"))
    key_ = expr.resolution_key(F.col("c_name"), title, F.when(n % 3 == 0, n), code)
    return table(spark, sf_dir, "customer").select("c_custkey", key_.alias("key"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track_id"), F.col("o_orderstatus").alias("options"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("payload"))


@query
def cache_latest(spark, sf_dir):
    return cache.latest(stored(spark, sf_dir), "track_id", "options").select("track_id", "options", "payload")


@query
def cache_hit_miss(spark, sf_dir):
    text = F.when(F.col("payload") % 9 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("payload").alias("n"))))
    # equal times are told apart by the row, so the number comes first
    results = stored(spark, sf_dir).select("track_id", F.lit(13).alias("algorithm_version"), "options", F.col("payload").alias("order"), text.alias("payload"), "created_at")
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track_id"))
    return cache.hits(asked, results, "O", "n BIGINT").select("track_id", F.col("hit.n").alias("hit"), F.col("hit").isNotNull().alias("cached"))


@query
def dedupe_analyze(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("track_id"))
    done = cache.once(asked).join(asked.groupBy("track_id").agg(F.count("*").alias("shared")), "track_id")
    return asked.join(done, "track_id").select("l_orderkey", "l_linenumber", "track_id", "shared")


@query
def rate_limit(spark, sf_dir):
    secs = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - 1704067200
    arrivals = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("bucket"), secs.alias("secs"), F.col("event_id").alias("tie"))
    return cache.waits(arrivals, rate=0.3).select("event_id", F.round("wait", 4).alias("wait"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = F.when(F.col("l_linenumber") != 6, 60 + F.col("l_discount") * 2000)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("genre"), (90 + F.col("l_quantity")).alias("want"), got.alias("got"), "l_extendedprice", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    return rows.withColumn("verdict", expr.verdict(F.col("want"), F.col("got")))


@query
def verdict(spark, sf_dir):
    return judged(spark, sf_dir).select("l_orderkey", "l_linenumber", "verdict")


@query
def key_matches(spark, sf_dir):
    def name(n: Column) -> Column:
        spelled = F.element_at(F.array(*map(F.lit, ("C", "c#", " D", "Eb", "Fb", "F", "Gb", "G", "g#", "A", "Bb", "Cb"))), (n % 12 + 1).cast("int"))
        return F.concat(spelled, F.when(n >= 24, "").when(n >= 12, " Minor").otherwise(" major"))

    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"))
    pairs = n.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(24)))).join(n.select(F.col("a").alias("b")), "b")
    return pairs.select("a", F.col("b").cast(n.schema["a"].dataType).alias("b"), expr.key_matches(name(F.col("a")), name(F.col("b"))).alias("matches"))


def checked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation rows of every line item: tempos as ``judged`` has them, keys by turns right, wrong, missing and not expected."""
    n, spelled = F.col("l_suppkey") % 12, F.array(*map(F.lit, PITCHES))
    name = lambda i: F.concat(F.element_at(spelled, (i + 1).cast("int")), F.when(F.col("l_linenumber") % 2 == 0, " minor").otherwise(" major"))
    rows = judged(spark, sf_dir).select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("label"), "genre", F.col("want").alias("expected_bpm"), "got", "l_linenumber", "l_suppkey", "l_discount", "l_tax")
    expected = rows.select("label", "genre", "expected_bpm", F.when(F.col("l_linenumber") == 3, "").otherwise(name(n)).alias("expected_key"))
    key = F.when(F.col("l_linenumber") != 5, name(F.when(F.col("l_linenumber") == 4, (n + 7) % 12).otherwise(n)))
    sure = F.round(F.col("l_discount") * 10, 2)
    estimated = rows.select("label", F.col("got").alias("bpm"), F.when(F.col("got").isNotNull(), sure).alias("confidence"), F.when(F.col("got").isNotNull(), sure <= 0.5).alias("uncertain"), key.alias("key"), F.when(key.isNotNull(), F.round(F.col("l_tax") * 12, 2)).alias("key_confidence"), F.when(key.isNotNull(), F.round(F.col("l_tax") * 12, 2) <= 0.5).alias("key_uncertain"), F.when(F.col("l_linenumber") == 7, "decode: broken").alias("error"))
    return validate.rows(expected, estimated)


@query
def validation_rows(spark, sf_dir):
    return checked_rows(spark, sf_dir).select("label", "verdict", "key_ok", validate.passed().alias("passed"))


@query
def validation_summary(spark, sf_dir):
    return validate.summary(checked_rows(spark, sf_dir), "genre")


@query
def validation_diagnostics(spark, sf_dir):
    return validate.diagnostics(checked_rows(spark, sf_dir))


@query
def report_compare(spark, sf_dir):
    orders, price, who = table(spark, sf_dir, "orders"), F.col("o_totalprice"), F.col("o_custkey")
    run = lambda rows, ok, unsure, key_ok: rows.select(F.col("o_orderkey").alias("label"), F.when(ok, "ok").otherwise("wrong").alias("verdict"), unsure.alias("uncertain"), key_ok.alias("key_ok"), F.lit(None).cast("string").alias("error"))
    before = run(orders.where("o_orderkey % 5 <> 0"), price > 100000, who % 2 != 0, F.col("o_orderstatus") != "O")
    after = run(orders.where("o_orderkey % 7 <> 0"), price > 150000, who % 4 == 0, who % 3 != 0)
    return validate.compare(before, after).select("label", "change")


@query
def calibration(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = rows.select(F.col("lang").alias("dataset"), ((F.col("doc_id") % 101) / 100.0).alias("confidence"), (F.col("quality") == 1).alias("right"))
    return rounded(validate.calibration(rows), share=6)


@query
def mirex(spark, sf_dir):
    rows = two_keys(spark, sf_dir).withColumnsRenamed({"other": "got", "other_minor": "got_minor"})
    return rows.withColumn("score", expr.mirex(F.col("tonic"), F.col("minor"), F.col("got"), F.col("got_minor")))


@query
def fetch_policy(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("", " Audio/MPEG; q=1", "video/mp4", "text/html"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", expr.allowed(F.col("url")).alias("allowed"), expr.plausible_audio(kind).alias("plausible"))


@query
def search_url(spark, sf_dir):
    code = F.when(F.col("p_partkey") % 2 == 0, "de")
    return table(spark, sf_dir, "part").select("p_partkey", expr.search_url("https://catalog.example", F.col("p_name"), F.concat("p_brand", F.lit(" ~*(x)")), code).alias("url"))


@query
def wav_decode_analyze(spark, sf_dir):
    """A label's vectors one after another as a clip of 8,000 samples a second: written as WAV bytes, decoded and measured.

    Beside the clip of its number, every self-test signal at full length: written, decoded and
    analysed, with the tempo and key found and those that it was made with.
    """
    rows = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("clip")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("held"))
    clips = rows.select("clip", F.flatten(F.transform("held", lambda h: h["embedding"])).alias("xs")).repartition("clip")

    @F.pandas_udf("binary")
    def encoded(xs: pd.Series) -> pd.Series:
        return pd.Series([synth.wav(np.asarray(x, float), 8000) for x in xs])

    files = clips.select("clip", encoded("xs").alias("content"))
    got = files.select("clip", sql.decode_audio()("content").alias("d"), analyze_audio()("content", F.lit("bands"), F.lit(False)).alias("a"))
    pcm = got.select("clip", F.explode(F.transform("d.samples", lambda x: x.cast("double"))).alias("x"))
    facts = got.select("clip", F.round("a.audio.duration_secs", 6).alias("duration_secs"), F.round("a.audio.silent_fraction", 6).alias("told_silent"), F.col("d.sample_rate").alias("sample_rate"))
    measured = rounded(frames.pcm_stats(pcm).join(facts, "clip"), peak=6, rms=6, silent_fraction=6)

    @F.pandas_udf("binary")
    def signal(case: pd.Series) -> pd.Series:
        return pd.Series([synth.wav(synth.selftest_case(int(i)) * 0.5) for i in case])

    cases = [(i, float(bpm), name) for i, (bpm, _, _, name, *_) in enumerate(synth.SELFTEST)]
    made = spark.createDataFrame(cases, "clip int, expected_bpm double, expected_key string").repartition(len(cases), "clip").withColumn("content", signal("clip"))
    heard = made.select("clip", "expected_bpm", "expected_key", analyze_audio()("content", F.lit("bands"), F.lit(False)).alias("got"))
    right = (F.col("expected_key") == "") | (F.col("got.features.key.key") == F.col("expected_key"))
    heard = heard.select("clip", "expected_bpm", F.round(F.col("got.features.tempo.bpm").cast("double"), 0).alias("bpm"), "expected_key", right.alias("key_right"), F.round("got.audio.duration_secs", 3).alias("signal_secs"))
    return measured.join(heard, "clip", "full")


@query
def validation_report(spark, sf_dir):
    """Markdown rows of estimates against expectations."""
    return validate.table(checked_rows(spark, sf_dir))


@query
def key_alternates(spark, sf_dir):
    chroma = twelve(spark, sf_dir)
    best = key.estimate(key.correlations(chroma, "edm"), key.gates(chroma), learned=False)
    rows = best.select("clip", F.posexplode("alternates").alias("place", "a"))
    return rounded(rows.select("clip", F.col("place").cast("int").alias("place"), "a.value", "a.label", "a.relation", F.col("a.score").alias("score")), score=3)


def sixty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, band, pc, e): the first 60 numbers of each vector as band chroma."""
    bands = vectors(spark, sf_dir).select("clip", F.posexplode(F.slice("x", 1, 60)).alias("i", "e"))
    return bands.select("clip", F.floor(F.col("i") / 12).cast("int").alias("band"), (F.col("i") % 12).alias("pc"), "e")


@query
def key_bands(spark, sf_dir):
    """Keys by the learned scorer, with the gates of the bands' sum."""
    bands = sixty(spark, sf_dir)
    total = bands.groupBy("clip", "pc").agg(F.sum("e").alias("e"))
    best = key.estimate(key.probabilities(bands), key.gates(total), learned=True)
    return rounded(best.select("clip", "key", "camelot", "confidence", "uncertain", "correlation", "runner_up", "structure", "coverage"), correlation=6, runner_up=6, structure=6, coverage=6)


@query
def chroma_key(spark, sf_dir):
    return vectors(spark, sf_dir).select("clip", sql.chroma_key(F.slice("x", 1, 12)).alias("key"))


@query
def key_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    n = F.col("doc_id")
    rows = rows.select(F.col("lang").alias("dataset"), (n % 12).alias("tonic"), (n % 2 == 0).alias("minor"), ((n + F.when(n % 3 == 0, 0).when(n % 3 == 1, 7).otherwise(9)) % 12).alias("got_tonic"), ((n % 2 == 0) != (F.col("toxic") == 1)).alias("got_minor"), ((n % 101) / 100.0).alias("confidence"))
    return rounded(validate.key_metrics(rows), exact=6, mirex=6, coverage=6, precision=6)


@query
def track_lookup(spark, sf_dir):
    """Requests by id against a catalog in which ids repeat, miss a preview or are not there."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), F.col("o_custkey").alias("track_id"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("c_track_id"), F.col("c_name").alias("c_artist"), F.col("c_mktsegment").alias("c_title"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("c_preview"))
    repeated = known.unionByName(known.withColumn("c_artist", F.lit("A")))
    return match.lookup(asked, repeated).select("line_no", "track_id", F.when(F.col("error").isNull(), F.col("c_artist")).alias("artist"), "match_score", "error")


@query
def resolution_cache(spark, sf_dir):
    """Requests answered from stored resolutions: the latest of each key counts, what doesn't parse is a miss."""
    rows = table(spark, sf_dir, "orders")
    options = batch.Options(country="de")
    said = lambda c: F.struct(F.col(c).alias("artist"), F.lit("t").alias("title"), F.lit(None).cast("long").alias("track_id"))
    text = F.when(F.col("o_custkey") % 9 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("track_id"))))
    stored_ = rows.select(batch.resolution_key(said("o_custkey"), options).alias("query_key"), text.alias("matched"), (F.unix_timestamp("o_orderdate") * 10_000_000 + F.col("o_orderkey")).alias("created_at"))
    known = cache.resolutions(stored_, "track_id BIGINT").withColumnRenamed("query_key", "_key")
    asked = table(spark, sf_dir, "customer").select("c_custkey", batch.resolution_key(said("c_custkey"), options).alias("query_key"))
    return asked.join(known, F.col("query_key") == F.col("_key"), "left").select("c_custkey", F.col("track.track_id").alias("track_id"))


@query
def resolvable_rows(spark, sf_dir):
    """What a batch would store: one resolution a key, by the rules of its market."""
    rows = table(spark, sf_dir, "customer")
    none = lambda kind: F.lit(None).cast(kind)
    from .schema import AUDIO, FEATURES, TRACK

    track = F.struct(F.col("c_nationkey").cast("long").alias("track_id"))
    whole = F.struct(*[(track["track_id"] if f == "track_id" else F.lit(None).cast(kind)).alias(f) for f, kind in (x.strip().split(": ") for x in TRACK[7:-1].split(","))])
    query_ = F.struct(F.col("c_mktsegment").alias("artist"), F.lit("T").alias("title"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("long")).alias("track_id"), none("string").alias("client_ref"))
    done = rows.select(analysis(query_, F.when(F.col("c_custkey") % 3 != 0, whole), none(FEATURES), none(AUDIO), F.lit(False), F.lit(None).cast("STRUCT<kind: STRING, message: STRING>")).alias("analysis"))
    return batch.resolvable(done, options=batch.Options(country="us")).select("query_key")


@query
def stream_batch(spark, sf_dir):
    """The whole batch on a stream over a folder of request lines, with a catalog that lacks previews."""
    text = request_lines(spark, sf_dir).select(F.col("line").alias("value"))
    folder = f"{scratch.folder(spark)}/stream-{uuid.uuid4().hex}"
    text.write.text(f"{folder}/in")
    none = F.lit(None).cast("string")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c_track_id"), none.alias("c_artist"), none.alias("c_title"), none.alias("c_preview"))
    files = spark.createDataFrame([], "path string, content binary")
    stream.start(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", known, files, once=True).awaitTermination()
    got = F.from_json("value", "status STRING, query STRUCT<artist: STRING, title: STRING, track_id: BIGINT>, error STRUCT<kind: STRING>")
    return spark.read.text(f"{folder}/out").select(got.alias("a")).select("a.status", "a.query.artist", "a.query.title", "a.query.track_id", F.col("a.error.kind").alias("error"))


@query
def search_responses(spark, sf_dir):
    """Entries of search responses, one body a brand; a body that doesn't parse is an error."""
    part = table(spark, sf_dir, "part")
    one = F.struct(F.col("p_partkey").alias("trackId"), F.col("p_name").alias("trackName"), F.col("p_brand").alias("artistName"), F.lit(1).alias("more"))
    body = F.to_json(F.struct(F.count("*").alias("resultCount"), F.sort_array(F.collect_list(one)).alias("results")))
    bodies = part.groupBy("p_brand", "p_size").agg(body.alias("body")).select(F.concat_ws("/", "p_brand", "p_size").alias("key"), F.when(F.col("p_size") % 10 == 0, "<html>").when(F.col("p_size") % 10 == 1, "{}").otherwise(F.col("body")).alias("body"))
    return catalog.responses(bodies).select("key", F.col("c_track_id").alias("track_id"), F.col("c_title").alias("title"), F.col("c_artist").alias("artist"), "error")


@query
def manifest_rows(spark, sf_dir):
    """A tab-separated manifest, written and read; lines that don't fit are dropped."""
    n = F.col("c_custkey")
    line = F.concat_ws("\t", F.lit("set"), n.cast("string"), F.col("c_name"), F.when(n % 11 == 0, "x").otherwise((n % 14).cast("string")), F.when(n % 3 == 0, "major").when(n % 3 == 1, "minor").otherwise("dorian"))
    path = f"{scratch.folder(spark)}/manifest-{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").select(line).write.text(path)
    return catalog.manifest(spark, path)


@query
def confident_labels(spark, sf_dir):
    spelled = F.element_at(F.array(*map(F.lit, ("Eb minor", "f# major", "H", "A", "Cb  Minor"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    raw = table(spark, sf_dir, "customer").select(F.lit("set").alias("dataset"), F.col("c_custkey").alias("id"), spelled.alias("label"), (F.col("c_nationkey") % 3).alias("confidence"))
    return catalog.labelled(raw)


@query
def parsed_options(spark, sf_dir):
    """Country codes, profile names and option keys as they are given."""
    n = F.col("c_custkey")
    code = F.element_at(F.array(*map(F.lit, (" DE", "usa", "g1", "", "Jp", None))), (n % 6 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("Bands", "KS", "shaath", "EDM", "other"))), (n % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", expr.country(code).alias("country"), expr.profile(name).alias("profile"), expr.options_key(name, n % 2 == 0).alias("options"), expr.lookup_url("https://catalog.example", n, expr.country(code)).alias("lookup_url"))


@query
def frame_sizes(spark, sf_dir):
    """Windows and hops that each sampling rate gets for onsets, chroma and key bands."""
    rates = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 3777 + 4000).cast("int").alias("rate"))

    @F.pandas_udf("onset_window int, onset_hop int, chroma_window int, chroma_hop int, band_window int, band_hop int")
    def sized(rate: pd.Series) -> pd.DataFrame:
        rows = [[x for use in ("onsets", "chroma", "bands") for x in kernels.sizes(int(r), use)] for r in rate]
        return pd.DataFrame(rows, columns=["onset_window", "onset_hop", "chroma_window", "chroma_hop", "band_window", "band_hop"])

    return rates.select("rate", sized("rate").alias("s")).select("rate", "s.*")


@query
def mel_filterbank(spark, sf_dir):
    """Every vector as a spectrum of 64 bins of 171.875 Hz, through 64 triangles on the mel scale."""
    weights = kernels.mel_weights(22000, 126)
    rows = [(int(m), int(b), float(weights[b, m])) for b, m in zip(*weights.nonzero())]
    filters = spark.createDataFrame(rows, "m int, b int, w double").coalesce(1)
    spectrum = vectors(spark, sf_dir).select("clip", F.lit(0).alias("t"), F.posexplode("x").alias("b", "mag"))
    return rounded(frames.mel_spectrum(spectrum, filters).select("clip", "m", "v"), v=6)


@query
def middle_slice(spark, sf_dir):
    """The middle of each vector, as if it were samples at 4 to 10 a second and the cut 8 seconds."""
    rate = (F.col("vec_id") % 7 + 4).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", frames.middle(F.col("embedding"), rate, 8.0).alias("x")).select("vec_id", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query
def key_slopes(spark, sf_dir):
    """Loss and its slopes at the learned weights, over vectors as bands of keys that their numbers name."""
    n = F.col("vec_id")
    bands = vectors(spark, sf_dir).select("clip", F.posexplode(F.slice("x", 1, 60)).alias("i", "e"))
    bands = bands.select("clip", F.floor(F.col("i") / 12).cast("int").alias("band"), (F.col("i") % 12).alias("pc"), "e")
    keys = table(spark, sf_dir, "embeddings").select(n.alias("clip"), (n % 12).cast("int").alias("tonic"), (n % 2 == 0).alias("minor"))
    return rounded(key.slopes(bands, keys), slope=6, loss=6)


@query
def key_fit(spark, sf_dir):
    """The learned scorer fitted on vectors as bands: loss over all of them, and how many it gets right."""
    x = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    n = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (n % 12).cast("int").alias("tonic"), (n % 2 == 0).alias("minor"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.slice(x, i * 12 + 1, F.lit(12))).alias("bands"))
    weights, bias = validate.fit(rows)
    got = validate.predicted(rows, weights, bias)
    right = (F.col("got_tonic") == F.col("tonic")) & (F.col("got_minor") == F.col("minor"))
    return got.agg(F.count("*").alias("n"), F.count_if(right).alias("exact"), F.round(F.avg("share"), 4).alias("share"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempo candidates of every clip, from band energies: six window and aggregate operators in one plan."""
    env = frames.onset_envelope(mel(spark, sf_dir), FPS, 2)
    return rounded(tempo.candidates(env.select("clip", "t", "x"), FPS), bpm=6)


QUERIES["flagship"] = flagship
