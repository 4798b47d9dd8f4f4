"""Schemas of requests, results and stored rows, and the result constructors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as k

QUERY = "STRUCT<artist: STRING, title: STRING, track_id: BIGINT, client_ref: STRING>"
ALTERNATES = "ARRAY<STRUCT<value: DOUBLE, label: STRING, relation: STRING, score: FLOAT>>"
TEMPO = f"STRUCT<bpm: FLOAT, confidence: FLOAT, uncertain: BOOLEAN, maturity: STRING, source: STRING, beat_offset_secs: FLOAT, canonical_window_bpm: ARRAY<FLOAT>, alternates: {ALTERNATES}>"
SCORING = "STRUCT<correlation: FLOAT, runner_up: FLOAT, salience: FLOAT, tonal_pitch_classes: FLOAT, strength: FLOAT, margin: FLOAT, structure: FLOAT, coverage: FLOAT>"
KEY = f"STRUCT<key: STRING, tonic: STRING, mode: STRING, camelot: STRING, confidence: FLOAT, uncertain: BOOLEAN, maturity: STRING, source: STRING, alternates: {ALTERNATES}, scoring: {SCORING}>"
FEATURES = f"STRUCT<tempo: {TEMPO}, key: {KEY}>"
AUDIO = "STRUCT<duration_secs: DOUBLE, sample_rate: INT, source_channels: INT, silent_fraction: DOUBLE, truncated: BOOLEAN>"
TRACK = "STRUCT<track_id: BIGINT, artist: STRING, title: STRING, album: STRING, release_date: STRING, genre: STRING, preview_url: STRING, duration_ms: BIGINT, match_score: FLOAT, uncertain: BOOLEAN>"
ERROR = "STRUCT<kind: STRING, message: STRING>"
CATALOG = "STRUCT<resultCount: INT, results: ARRAY<STRUCT<trackId: BIGINT, trackName: STRING, artistName: STRING, collectionName: STRING, releaseDate: STRING, primaryGenreName: STRING, previewUrl: STRING, trackTimeMillis: BIGINT>>>"


def analysis(query: Column, track: Column, features: Column, audio: Column, cached: Column, error: Column) -> Column:
    """A result row, of success or failure alike: a failed one has no audio and empty features."""
    failed = error.isNotNull()
    return F.struct(
        F.lit(k.SCHEMA_VERSION).alias("schema_version"),
        F.lit(k.ALGORITHM_VERSION).alias("algorithm_version"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        query.alias("query"),
        track.cast(TRACK).alias("track"),
        F.when(failed, F.struct(F.lit(None).cast(TEMPO).alias("tempo"), F.lit(None).cast(KEY).alias("key"))).otherwise(features).alias("features"),
        F.when(~failed, audio).alias("audio"),
        (F.coalesce(cached, F.lit(False)) & ~failed).alias("cached"),
        error.cast(ERROR).alias("error"),
    )
