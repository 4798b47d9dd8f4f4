"""Tables written to the folder that driver and executors share.

Long lineages are cut by writing a Parquet table below ``spark.checkpoint.dir``
and reading it again: an executor that is lost later costs nothing, since the
files outlive it.  The setting is read from the session.  Where none is set, a
session on one machine gets a folder of its own; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows that go to a Python worker at once: rows are whole texts, and a worker and its JVM hold some such batches each.
BATCH_BYTES = 1 << 21
#: Rows that a reader of Parquet decodes at once, into arrays of the JVM that hold all their texts.
READ_ROWS = 512


def lean(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES and what is read at once by READ_ROWS, unless they are smaller."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > READ_ROWS:
        spark.conf.set(name, str(READ_ROWS))


def folder(spark: SparkSession) -> str:
    """The shared folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df``, written to the shared folder and read from there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def bucketed(df: DataFrame, what: str, key: str, buckets: int) -> DataFrame:
    """``df``, written bucketed by ``key`` and read from there: grouping or joining by it needs no shuffle of this side."""
    spark = df.sparkSession
    name = f"{what}_{uuid.uuid4().hex}"
    path = f"{folder(spark)}/{name}"
    df.write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(buckets, key).saveAsTable(name)
    table = spark.table(name)
    table._scratch, table._named = path, name
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes written tables.  Only for such as nothing but written tables was made from: a lost task may read its inputs again."""
    for table in tables:
        spark = table.sparkSession
        if getattr(table, "_named", None):
            spark.sql(f"DROP TABLE IF EXISTS {table._named}")  # its entry in the catalog; the files are not the catalog's
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished queries now; it does so when the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` (a written table) has no more than ``rows`` rows."""
    return df.count() <= rows
