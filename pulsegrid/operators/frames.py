"""Time-series operators in long form: (clip, t, x), or (clip, t, m, v) for bands over time.

Every window is partitioned by clip (and band), so clips spread over all tasks and no
frame crosses one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as k
from .. import scratch
from ..functions.expr import finite, ratio


def over(*keys: str):
    return Window.partitionBy(*keys)


def pcm_stats(pcm: DataFrame) -> DataFrame:
    """Peak, root mean square and silent share of (clip, x)."""
    x = finite(F.col("x"))
    rms, silent = F.sqrt(F.avg(x * x)), F.avg((F.abs(x) < k.SILENT).cast("double"))
    return pcm.groupBy("clip").agg(F.count("*").alias("n"), F.max(F.abs(x)).alias("peak"), rms.alias("rms"), silent.alias("silent_fraction"))


def downmix(pcm: DataFrame) -> DataFrame:
    """(clip, t, x) from (clip, t, channel, x): the channels' mean, non-finite samples as 0."""
    return pcm.groupBy("clip", "t").agg(F.avg(finite(F.col("x"))).alias("x"))


def kick_energy(mel: DataFrame, bands: int) -> DataFrame:
    """Energy of the lowest ``bands``, as a share of the clip's loudest frame over all."""
    v2 = F.col("v") * F.col("v")
    energy = mel.groupBy("clip", "t").agg(F.sum(F.when(F.col("m") < bands, v2).otherwise(0.0)).alias("low"), F.sum(v2).alias("all"))
    return energy.select("clip", "t", ratio(F.col("low"), F.max("all").over(over("clip")), 0.0).alias("kick"))


def whiten(mel: DataFrame, fps: float) -> DataFrame:
    """Each band over a decaying follower of its own peak: a running maximum on a tilted log scale."""
    slope = -1.0 / (k.WHITEN_SECS * fps)
    tilt = F.col("t") * slope
    running = over("clip", "m").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    floor = F.max("v").over(over("clip")) * k.WHITEN_FLOOR
    log = F.when(F.col("v") > 0, F.ln(F.when(F.col("v") > 0, F.col("v"))))
    peak = F.greatest(F.exp(F.max(log - tilt).over(running) + tilt), F.col("floor"))
    return mel.withColumn("floor", floor).withColumn("peak", peak).select("clip", "t", "m", F.when(F.col("floor") > 0, F.col("v") / F.when(F.col("floor") > 0, F.col("peak"))).otherwise(F.col("v")).alias("v"))


def log_flux(mel: DataFrame) -> DataFrame:
    """(clip, t, x): rises of ln(1 + 10 v), summed over bands; the first frame repeats the second."""
    log = F.log1p(k.LOG_GAIN * F.col("v"))
    rise = mel.select("clip", "t", (log - F.lag(log).over(over("clip", "m").orderBy("t"))).alias("d"))
    flux = rise.groupBy("clip", "t").agg(F.sum(F.greatest(F.col("d"), F.lit(0.0))).alias("x"), F.max(F.col("d").isNull()).alias("first"))
    return flux.select("clip", "t", F.when(F.col("first"), F.lead("x").over(over("clip").orderBy("t"))).otherwise(F.col("x")).alias("x"))


def pulse_strength(flux: DataFrame) -> DataFrame:
    return flux.groupBy("clip").agg(ratio(F.stddev_pop("x"), F.avg("x")).alias("pulse_strength"))


def detrend(series: DataFrame, window: int) -> DataFrame:
    """Less the mean of the frames around, as many as there are."""
    half = max(3, window) // 2
    return series.withColumn("x", F.col("x") - F.avg("x").over(over("clip").orderBy("t").rowsBetween(-half, half)))


def zscore(series: DataFrame) -> DataFrame:
    sd = F.stddev_pop("x").over(over("clip"))
    return series.withColumn("x", ratio(F.col("x") - F.avg("x").over(over("clip")), sd))


def onset_envelope(mel: DataFrame, fps: float, kick_bands: int) -> DataFrame:
    """(clip, t, x, kick): kick energy beside whitened, compressed, rectified, detrended, scaled flux."""
    env = zscore(detrend(log_flux(whiten(mel, fps)), int(k.DETREND_SECS * fps)))
    return env.join(kick_energy(mel, kick_bands), ["clip", "t"])


def mel_spectrum(spectrum: DataFrame, weights: DataFrame) -> DataFrame:
    """(clip, t, m, v) from (clip, t, b, mag) and sparse filters (m, b, w): at most bins x bands of these, a fixed table."""
    return spectrum.join(F.broadcast(weights), "b").groupBy("clip", "t", "m").agg(F.sum(F.col("mag") * F.col("w")).alias("v"))


def series_of(df: DataFrame) -> DataFrame:
    """One row a clip: ``xs``, its values in the order of t."""
    return df.groupBy("clip").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda p: p["x"]).alias("xs"))


def autocorrelation(series: DataFrame, most: int) -> DataFrame:
    """(clip, lag, acf) for lags 0 to ``most``, over the energy; zeros without energy."""
    xs, n = F.col("xs"), F.size("xs")
    energy = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x * x)
    lagged = F.transform(F.sequence(F.lit(0), F.least(F.lit(most), n - 1)), lambda j: F.aggregate(F.zip_with(F.slice(xs, F.lit(1), n - j), F.slice(xs, j + 1, n - j), lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p))
    return series_of(series).select("clip", energy.alias("energy"), F.posexplode(lagged).alias("lag", "dot")).select("clip", "lag", ratio(F.col("dot"), F.col("energy"), 1e-12).alias("acf"))


def smooth(series: DataFrame, length: int) -> DataFrame:
    """Under a normalised Hann kernel of odd length; nothing beyond the ends."""
    length |= 1
    if length <= 1:
        return series
    half, frame = length // 2, over("clip").orderBy("t")
    weight = lambda i: 0.5 - 0.5 * F.cos(F.lit(2.0 * 3.141592653589793 * (i + 1) / (length + 1)))
    near = lambda i: F.coalesce(F.lag("x", half - i).over(frame), F.lit(0.0))
    total = sum((weight(i) for i in range(1, length)), weight(0))
    return series.withColumn("x", sum((near(i) * weight(i) for i in range(1, length)), near(0) * weight(0)) / total)


def interpolated(xs: Column, where: Column) -> Column:
    """The array ``xs`` at a fractional place; 0 outside, the last value at the end."""
    i = F.floor(where).cast("int")
    a = F.try_element_at(xs, F.when((where >= 0) & (i < F.size(xs)), i + 1).otherwise(F.size(xs) + 1))
    b = F.coalesce(F.try_element_at(xs, F.when(where >= 0, i + 2).otherwise(F.size(xs) + 1)), a)
    return F.coalesce(a + (b - a) * (where - F.floor(where)), F.lit(0.0))


def grid_mean(xs: Column, period: Column, phase: Column) -> Column:
    """Mean of ``xs`` on a grid."""
    beats = (F.floor((F.size(xs) - 1 - phase) / period) + 1).cast("int")
    return F.aggregate(F.sequence(F.lit(0), beats - 1), F.lit(0.0), lambda s, i: s + interpolated(xs, phase + i * period)) / beats


def middle(samples: Column, rate: Column, secs: float = 30.0) -> Column:
    """The middle ``secs`` of a clip's samples."""
    skip = (F.greatest(F.size(samples) / rate - secs, F.lit(0.0)) / 2 * rate).cast("int")
    return F.slice(samples, skip + 1, F.greatest((rate * secs).cast("int"), F.lit(1)))


def dft(frames: DataFrame, n: int) -> DataFrame:
    """(clip, t, b, mag) of frames ``xs`` of ``n`` samples, under a periodic Hann window: the definition, for small n."""
    turn = 2.0 * 3.141592653589793 / n
    hann = F.transform("xs", lambda x, i: x * (0.5 - 0.5 * F.cos(turn * i)))
    part = lambda f, b: F.aggregate(F.transform(F.col("w"), lambda x, i: x * f(turn * i * b)), F.lit(0.0), lambda s, v: s + v)
    rows = frames.withColumn("w", hann).select("clip", "t", "w", F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("b"))
    re, im = part(F.cos, F.col("b")), part(F.sin, F.col("b"))
    return rows.select("clip", "t", "b", F.sqrt(re * re + im * im).alias("mag"))


def framed(clips: DataFrame, n: int, hop: int) -> DataFrame:
    """(clip, t, xs): windows of ``n`` samples, ``hop`` apart, of (clip, xs); none of less."""
    count = F.floor((F.size("xs") - n) / hop).cast("int")
    rows = clips.where(F.size("xs") >= n).select("clip", "xs", F.explode(F.sequence(F.lit(0), count)).alias("t"))
    return rows.select("clip", F.col("t").cast("long").alias("t"), F.slice("xs", F.col("t") * hop + 1, F.lit(n)).alias("xs"))


def framed_pieces(pieces: DataFrame, n: int, hop: int) -> DataFrame:
    """``framed`` of clips of any length, held in pieces (clip, place, xs) that follow by place; no row ever holds a clip.

    Where a piece starts is found by ranges of (clip, place): inside each, after the samples
    that the ranges before hold of the clip.  A piece is cut by the windows that it is in,
    and a window is put together from its cuts.
    """
    parts = pieces.where(F.size("xs") > 0).repartitionByRange("clip", "place").withColumn("part", F.spark_partition_id())
    parts = scratch.written(parts, "pieces")
    earlier = Window.unboundedPreceding, -1
    before = parts.groupBy("part", "clip").agg(F.sum(F.size("xs")).alias("n"))
    before = before.select(F.col("part").alias("_part"), F.col("clip").alias("_clip"), F.coalesce(F.sum("n").over(over("clip").orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("skip"))
    inside = F.coalesce(F.sum(F.size("xs")).over(over("part", "clip").orderBy("place", "xs").rowsBetween(*earlier)), F.lit(0))
    placed = parts.withColumn("inside", inside).join(before, (F.col("part") == F.col("_part")) & F.col("clip").eqNullSafe(F.col("_clip")))
    placed = placed.select("clip", "xs", (F.col("skip") + F.col("inside")).alias("start"))
    first, last = F.greatest(F.floor((F.col("start") - n) / hop) + 1, F.lit(0)), F.floor((F.col("start") + F.size("xs") - 1) / hop)
    met = placed.withColumn("t", F.explode(F.when(first <= last, F.sequence(first, last))))
    at = F.greatest(F.col("t") * hop - F.col("start"), F.lit(0))
    until = F.least(F.col("t") * hop + n - F.col("start"), F.size("xs"))
    cuts = met.select("clip", "t", "start", F.slice("xs", (at + 1).cast("int"), (until - at).cast("int")).alias("cut"))
    whole = cuts.groupBy("clip", "t").agg(F.sort_array(F.collect_list(F.struct("start", "cut"))).alias("cuts"))
    return whole.select("clip", "t", F.flatten(F.transform("cuts", lambda c: c["cut"])).alias("xs")).where(F.size("xs") == n)


def fft(frames: DataFrame, n: int) -> DataFrame:
    """(clip, t, b, mag) of frames ``xs`` of ``n`` samples, a power of two, under a periodic Hann window.

    Radix two in self-sorting order: each pass is a column of its own, made from the one
    before by as many butterflies as there are samples, so a frame costs n log n.
    """
    if n < 2 or n & (n - 1):
        raise ValueError("windows are powers of two")
    turn = 2.0 * 3.141592653589793
    every = F.sequence(F.lit(0), F.lit(n - 1))
    rows = frames.select("clip", "t", F.transform("xs", lambda x, i: x * (0.5 - 0.5 * F.cos(turn / n * i))).alias("re1"), F.array_repeat(F.lit(0.0), n).alias("im1"))
    size, stride = n, 1  # columns are named by stride: one name for all passes would mean the new column where the old one is meant
    while size > 1:
        half = size // 2

        def butterfly(i: Column, real: bool, size: int = size, stride: int = stride, half: int = half) -> Column:
            q, r = i % stride, F.floor(i / stride).cast("int")
            p = F.floor(r / 2).cast("int")
            first, second = q + stride * p, q + stride * (p + half)
            are, aim, bre, bim = (F.get(f"{part}{stride}", at) for at in (first, second) for part in ("re", "im"))
            cos, sin = F.cos(-turn / size * p), F.sin(-turn / size * p)
            even, odd = (are + bre, (are - bre) * cos - (aim - bim) * sin) if real else (aim + bim, (are - bre) * sin + (aim - bim) * cos)
            return F.when(r % 2 == 0, even).otherwise(odd)

        size, stride = half, stride * 2
        rows = rows.select("clip", "t", F.transform(every, lambda i: butterfly(i, True)).alias(f"re{stride}"), F.transform(every, lambda i: butterfly(i, False)).alias(f"im{stride}"))
    re, im = (lambda b: F.get(f"re{n}", b)), (lambda b: F.get(f"im{n}", b))
    magnitude = F.transform(F.sequence(F.lit(0), F.lit(n // 2)), lambda b: F.sqrt(re(b) * re(b) + im(b) * im(b)))
    return rows.select("clip", "t", F.posexplode(magnitude).alias("b", "mag"))
