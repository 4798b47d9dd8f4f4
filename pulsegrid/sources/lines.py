"""Request lines in, result lines out, in the order they came."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions.expr import input_error
from ..schema import ERROR, QUERY


#: Where a line of a text source comes from; a file's splits begin at ``start``.
ORIGIN = ["value AS line", "_metadata.file_modification_time AS at", "_metadata.file_path AS file", "_metadata.file_block_start AS start"]
#: Lines of a split.
WIDE = 1 << 33
#: Up to so many splits their numbers go to every task; beyond, lines are shuffled by split.
BROADCAST_SPLITS = 100_000


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """(line_no, line) of ``rows`` with ORIGIN: numbers rise with ``by`` (file, if none), and with the place in a file.

    Spark packs splits into partitions by size, so a row's number in its partition orders
    only the rows of one split.  Splits are numbered by file and start, a row each; lines
    stay where they are read, as tasks that get them by split have few and large keys.
    """
    order = [*(by or ("file",)), "file", "start"]
    place = F.row_number().over(Window.orderBy(*dict.fromkeys(order)))
    splits = rows.select("at", "file", "start").distinct().withColumn("split", place - 1).select("file", "start", "split")
    splits = scratch.written(splits, "splits")
    if scratch.at_most(splits, BROADCAST_SPLITS):
        splits = F.broadcast(splits)
    here = F.monotonically_increasing_id() % WIDE
    return rows.withColumn("here", here).join(splits, ["file", "start"]).select((F.col("split") * WIDE + F.col("here")).alias("line_no"), "line")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of text files; numbers rise with file and place."""
    return numbered(spark.read.text(path).selectExpr(*ORIGIN))


def parsed(lines: DataFrame) -> DataFrame:
    """(line_no, query, error) of every line that is not blank; a malformed one has an empty query."""
    shown = lines.where(F.trim("line") != "")
    body = QUERY[7:-1].replace(":", "") + ", _bad STRING"
    got = shown.withColumn("q", F.from_json("line", body, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("q").isNull() | F.col("q._bad").isNotNull() | ~F.startswith(F.ltrim("line"), F.lit("{"))
    query = F.struct(*[F.when(~broken, F.col(f"q.{c}")).alias(c) for c in ("artist", "title", "track_id", "client_ref")])
    kind = F.when(broken, "invalid_input").otherwise(input_error(F.col("q.artist"), F.col("q.title"), F.col("q.track_id")))
    why = F.when(broken, "not a request object").otherwise("a request names a track_id, or an artist and a title")
    return got.select("line_no", query.alias("query"), F.when(kind.isNotNull(), F.struct(kind.alias("kind"), why.alias("message"))).cast(ERROR).alias("error"))


def rendered(results: DataFrame) -> DataFrame:
    """(line_no, value): one JSON line a result; fields that are null are left out."""
    return results.select("line_no", F.to_json("analysis").alias("value"))


def write(results: DataFrame, path: str) -> None:
    rendered(results).orderBy("line_no").select("value").write.text(path)
