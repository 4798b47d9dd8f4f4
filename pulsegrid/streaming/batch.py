"""The batch while its input is still open: micro-batches of lines, emitted as they finish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import batch
from ..sources import lines, web


def start(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, catalog: DataFrame | web.Service, files: batch.Files, options: batch.Options = batch.Options(), once: bool = False, cache: batch.Cache = batch.Cache(None)) -> StreamingQuery:
    """Answer the lines of every file that comes to ``inbox``; ``outbox`` gets one folder a micro-batch, in order."""

    def emit(rows: DataFrame, number: int) -> None:
        done = lines.rendered(cache.answer(lines.numbered(rows, "at"), catalog, files, options)).orderBy("line_no")
        done.select("value").write.mode("overwrite").text(f"{outbox}/batch={number:09d}")  # a repeated batch replaces itself

    stream = spark.readStream.text(inbox).selectExpr(*lines.ORIGIN).writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def parsed_stream(spark: SparkSession, inbox: str) -> DataFrame:
    """Requests as a stream: (line_no, query, error), without state.

    A line's number is a structure that rises with the time its file was written, the file's name, and the place in it.
    """
    files = spark.readStream.text(inbox, wholetext=True).select("value", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"))
    placed = files.select("at", "file", F.posexplode(F.split("value", "\\r?\\n")).alias("place", "line"))
    return lines.parsed(placed.select(F.struct("at", "file", "place").alias("line_no"), "line"))
