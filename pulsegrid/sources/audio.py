"""Audio files: bytes to mono samples, failures as rows."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as k
from . import clips

#: Decoders by file signature, for formats that need a library: bytes -> (samples frames x channels, rate).
DECODERS: dict[bytes, Callable[[bytes], tuple[np.ndarray, int]]] = {}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length, message); files over the size limit are there without content, which is not read."""
    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > k.MAX_AUDIO_BYTES).select("path", F.lit(None).cast("binary").alias("content"), "length", F.format_string(f"too large: %d bytes (limit {k.MAX_AUDIO_BYTES})", "length").alias("message"))
    return files.where(F.col("length") <= k.MAX_AUDIO_BYTES).select("path", "content", "length", F.lit(None).cast("string").alias("message")).unionByName(large)


def wav(raw: bytes) -> tuple[np.ndarray, int]:
    """Samples (frames x channels) and rate of WAV bytes: PCM of 8 to 32 bits, or 32-bit float."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", raw, at + 8)
            if form[0] == 0xFFFE and size >= 26:
                form = (struct.unpack_from("<H", raw, at + 32)[0], *form[1:])
        elif name == b"data" and form:
            data = raw[at + 8 : at + 8 + size]
            break
        at += 8 + size + size % 2
    else:
        raise ValueError("no audio in the WAV file")
    kind, channels, rate, _, _, bits = form
    width = bits // 8
    data = data[: len(data) // (width * channels) * width * channels]
    if kind == 3 and bits == 32:
        x = np.frombuffer(data, "<f4").astype(np.float64)
    elif kind == 1 and bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif kind == 1 and bits in (16, 32):
        x = np.frombuffer(data, f"<i{width}") / float(1 << (bits - 1))
    elif kind == 1 and bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        raise ValueError("an encoding that is not supported")
    return x.reshape(-1, channels), rate


def decode(raw: bytes) -> dict:
    """Mono samples of a file: channels averaged, non-finite values 0, at most 120 seconds."""
    for mark, decoder in DECODERS.items():
        if raw.startswith(mark):
            x, rate = decoder(raw)
            break
    else:
        x, rate = wav(raw)
    truncated = len(x) > k.MAX_SECS * rate
    x = x[: k.MAX_SECS * rate]
    return {"samples": np.where(np.isfinite(x), x, 0).mean(1) if len(x) else np.zeros(0), "sample_rate": rate, "source_channels": x.shape[1], "truncated": truncated}


def facts(pcm: dict) -> dict:
    x = pcm["samples"]
    return {"duration_secs": len(x) / pcm["sample_rate"] if pcm["sample_rate"] else 0.0, "sample_rate": pcm["sample_rate"], "source_channels": pcm["source_channels"], "silent_fraction": float((np.abs(x) < k.SILENT).mean()) if len(x) else 1.0, "truncated": True if pcm["truncated"] else None}


def levels(pcm: dict) -> dict:
    x = np.asarray(pcm["samples"], float)
    return {"samples": len(x), "peak": float(np.abs(x).max()) if len(x) else 0.0, "rms": float(np.sqrt((x * x).mean())) if len(x) else 0.0}


def middle(samples: np.ndarray, rate: int, secs: float = 30.0) -> np.ndarray:
    """The ``secs`` seconds in the middle of a clip, as a store's preview would be."""
    skip = int(max(len(samples) / rate - secs, 0.0) / 2 * rate)
    return samples[skip : skip + int(secs * rate)]


def benched(manifest: DataFrame, files: DataFrame | clips.Folder) -> DataFrame:
    """(dataset, id, value) of a manifest (dataset, id, url, tonic_pc, mode) and files, a folder or (path, content): a JSON line each.

    A line has the labels, the band chroma of the clip's middle, and the key that each
    scorer gives; what fails is a line with an error.  Lines come in no order.
    """
    from ..operators import kernels

    get = None if isinstance(files, DataFrame) else files.get

    def one(row) -> dict:
        try:
            content, message = (row.content, "no such file") if get is None else get(row.url) if row.there else (None, "no such file")
            if content is None:
                raise ValueError(message)
            pcm = decode(bytes(content))
            clip = middle(pcm["samples"], pcm["sample_rate"])
            bands, _ = kernels.band_chroma(clip, pcm["sample_rate"])
            found = {name: kernels.key(clip, pcm["sample_rate"], name) for name in ("edm", "krumhansl", "bands")}
            told = {name: got and {"key": got["key"], "confidence": got["confidence"], "scoring": got["scoring"]} for name, got in found.items()}
            return {"dataset": row.dataset, "id": row.id, "tonic": int(row.tonic_pc), "mode": row.mode, "bands": bands.tolist(), "estimates": told}
        except Exception as error:  # noqa: BLE001  a bad file is a row
            return {"dataset": row.dataset, "id": row.id, "error": str(error)}

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"dataset": pdf["dataset"], "id": pdf["id"], "value": [json.dumps(one(row)) for row in pdf.itertuples(index=False)]})

    labels = ["dataset", "id", "tonic_pc", "mode"]
    if get is None:
        rows = manifest.repartition("url").join(files.select(F.col("path").alias("url"), "content"), "url", "left").select(*labels, "content")
    else:
        names = files.names(manifest.sparkSession).select(F.col("path").alias("url"), F.lit(True).alias("there"))
        rows = manifest.join(names, "url", "left").select(*labels, "url", F.coalesce("there", F.lit(False)).alias("there")).repartition("id")
    return rows.mapInPandas(made, "dataset string, id string, value string")


def decoded(files: DataFrame) -> DataFrame:
    """(path, samples, sample_rate, source_channels, truncated, error) of (path, content); a batch holds a few clips."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                try:
                    got = decode(bytes(raw)) | {"error": None}
                    if not len(got["samples"]):
                        got["error"] = "unusable_audio"
                except Exception:  # noqa: BLE001  a bad file is a row
                    got = {"samples": None, "sample_rate": None, "source_channels": None, "truncated": None, "error": "decode"}
                yield pd.DataFrame([got | {"path": path}])[["path", "samples", "sample_rate", "source_channels", "truncated", "error"]]

    return files.select("path", "content").mapInPandas(made, "path string, samples array<float>, sample_rate int, source_channels int, truncated boolean, error string")
