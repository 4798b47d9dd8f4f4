"""Functions to call from SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import constants as k
from ..operators import kernels
from ..schema import AUDIO, FEATURES
from ..sources import audio


def _pcm(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
    got = [kernels.analyze(np.asarray(x if x is not None else []), int(r or 0)) for x, r in zip(samples, rate)]
    return pd.DataFrame({"tempo": [g["tempo"] for g in got], "key": [g["key"] for g in got]})


def examined(raw: bytes, profile: str | None, explain: bool) -> dict:
    """Bytes of a file to facts and features; what fails is named, never raised."""
    row = {"audio": None, "features": None, "error": None}
    try:
        pcm = audio.decode(bytes(raw))
        if not len(pcm["samples"]):
            row["error"] = "unusable_audio"
    except Exception:  # noqa: BLE001
        row["error"] = "decode"
    if row["error"] is None:
        try:
            row["audio"], row["features"] = audio.facts(pcm), kernels.analyze(pcm["samples"], pcm["sample_rate"], profile or "bands", bool(explain))
        except Exception:  # noqa: BLE001
            row = {"audio": None, "features": None, "error": "internal"}
    return row


def _audio(content: pd.Series, profile: pd.Series, explain: pd.Series) -> pd.DataFrame:
    rows = [examined(*row) for row in zip(content, profile, explain)]
    return pd.DataFrame(rows, columns=["audio", "features", "error"])


class Spectrogram:
    """spectrogram(samples, rate): the onset frames, the magnitudes of each as one array."""

    def eval(self, samples, rate):
        n, hop = kernels.sizes(rate, "onsets")
        frame = 0
        for block in kernels.magnitudes(np.asarray(samples, float), n, hop):
            for row in block:
                yield frame, row.tolist()
                frame += 1


def _decode(content: pd.Series) -> pd.DataFrame:
    """Bytes of a file to mono samples."""
    rows = []
    for raw in content:
        try:
            pcm = audio.decode(bytes(raw))
            rows.append({"samples": pcm["samples"], "sample_rate": pcm["sample_rate"], "source_channels": pcm["source_channels"], "truncated": pcm["truncated"], "error": None if len(pcm["samples"]) else "unusable_audio"})
        except Exception:  # noqa: BLE001  a bad file is a row
            rows.append({"samples": None, "sample_rate": None, "source_channels": None, "truncated": None, "error": "decode"})
    return pd.DataFrame(rows, columns=["samples", "sample_rate", "source_channels", "truncated", "error"])


def chroma_key(bins: Column, profile: str = "edm") -> Column:
    """The key name of 12 pitch-class energies by a correlation profile; null without a positive correlation."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / 12.0
    flat = F.transform(bins, lambda v: v.cast("double") - mean(F.transform(bins, lambda w: w.cast("double"))))
    scored = []
    for minor, shape in enumerate(k.PROFILES[profile]):
        middle = sum(shape) / 12
        for tonic in range(12):
            weight = F.array(*[F.lit(shape[(i - tonic) % 12] - middle) for i in range(12)])
            dot = F.aggregate(F.zip_with(flat, weight, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
            scored.append(F.struct(dot.alias("score"), F.lit(-(2 * tonic + minor)).alias("order"), F.lit(f"{k.PITCHES[tonic]} {('major', 'minor')[minor]}").alias("key"), F.lit((sum((x - middle) ** 2 for x in shape)) ** 0.5).alias("norm")))
    # one chroma has one norm, so the correlation is in the order of dot product by profile norm
    best = F.array_max(F.transform(F.array(*scored), lambda s: F.struct((s["score"] / s["norm"]).alias("score"), s["order"], s["key"])))
    return F.when((F.size(bins) == 12) & (best["score"] > 1e-9), best["key"])


class TempoCandidates:
    """tempo_candidates(samples, rate): the coarse tempos of a clip."""

    def eval(self, samples, rate):
        env = kernels.onsets(np.asarray(samples, float), rate)
        for i, bpm in enumerate(kernels.tempo_candidates(env["values"], env["fps"])[0]):
            yield i, float(bpm)


def analyze_pcm():
    """The pandas UDF (samples, rate) -> features; made per session, since its type is parsed there."""
    return F.pandas_udf(_pcm, FEATURES)


def analyze_audio():
    """The pandas UDF (content, profile, explain) -> audio, features, error."""
    return F.pandas_udf(_audio, f"STRUCT<audio: {AUDIO}, features: {FEATURES}, error: STRING>")


def analyze_files(get: Callable[[str], tuple[bytes | None, str | None]]):
    """The pandas UDF (path, length, profile, explain) -> audio, features, error, why: ``get`` reads a file, or says why not, once for a run of equal paths; null paths give nulls."""

    def _files(path: pd.Series, length: pd.Series, profile: pd.Series, explain: pd.Series) -> pd.DataFrame:
        rows, last = [], (None, None)
        for where, size, *how in zip(path, length, profile, explain):
            row = {"audio": None, "features": None, "error": None, "why": None}
            if where is not None and last[0] == where:
                row = last[1]
            elif where is not None:
                body, row["why"] = get(where) if not size > k.MAX_AUDIO_BYTES else (None, f"too large: {int(size)} bytes (limit {k.MAX_AUDIO_BYTES})")
                if body is not None:
                    row |= examined(body, *how)
                last = (where, row)
            rows.append(row)
        return pd.DataFrame(rows, columns=["audio", "features", "error", "why"])

    return F.pandas_udf(_files, f"STRUCT<audio: {AUDIO}, features: {FEATURES}, error: STRING, why: STRING>")


def decode_audio():
    """The pandas UDF content -> samples, sample_rate, source_channels, truncated, error."""
    return F.pandas_udf(_decode, "STRUCT<samples: ARRAY<FLOAT>, sample_rate: INT, source_channels: INT, truncated: BOOLEAN, error: STRING>")


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``; no setting is changed (Spark bounds batches of clips by bytes)."""
    spark.udf.register("analyze_pcm", analyze_pcm())
    spark.udf.register("analyze_audio", analyze_audio())
    spark.udf.register("decode_audio", decode_audio())
    spark.udtf.register("spectrogram", F.udtf(Spectrogram, returnType="frame int, magnitudes array<double>"))
    spark.udtf.register("tempo_candidates", F.udtf(TempoCandidates, returnType="place int, bpm double"))
