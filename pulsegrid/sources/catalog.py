"""The catalog, as search responses or as a table; labelled manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as k
from ..schema import CATALOG


def responses(bodies: DataFrame) -> DataFrame:
    """(key, track..., error) of search responses (key, body): one row an entry; a malformed or oversized body is an ``http`` error."""
    got = bodies.withColumn("r", F.from_json("body", CATALOG)).withColumn("ok", F.try_parse_json("body").isNotNull() & (F.octet_length("body") <= k.MAX_SEARCH_BYTES))
    rows = got.select("key", F.when(~F.coalesce("ok", F.lit(False)), "http").alias("error"), F.explode_outer(F.when(F.col("ok"), F.col("r.results"))).alias("t"))
    return rows.select("key", F.col("t.trackId").alias("c_track_id"), F.col("t.artistName").alias("c_artist"), F.col("t.trackName").alias("c_title"), F.col("t.previewUrl").alias("c_preview"), F.col("t.collectionName").alias("album"), F.col("t.releaseDate").alias("release_date"), F.col("t.primaryGenreName").alias("genre"), F.col("t.trackTimeMillis").alias("duration_ms"), "error")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, id, url, tonic_pc, mode) of a tab-separated manifest; lines that do not parse are dropped."""
    rows = spark.read.schema("dataset string, id string, url string, tonic_pc int, mode string").option("sep", "\t").csv(path)
    return rows.where("tonic_pc BETWEEN 0 AND 11 AND mode IN ('major', 'minor')")


def labelled(raw: DataFrame) -> DataFrame:
    """(dataset, id, tonic_pc, mode) of labels such as "Eb minor" that were given the top confidence, 2."""
    from ..functions.expr import parsed_key

    pc, minor = parsed_key(F.col("label"))
    return raw.where("confidence = 2").select("dataset", "id", pc.alias("tonic_pc"), F.when(minor, "minor").otherwise("major").alias("mode")).where("tonic_pc IS NOT NULL")
