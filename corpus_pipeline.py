"""A corpus from raw documents to packed sequences, in four stages.

Each stage takes all rows its predecessor kept and writes Parquet that the next one
reads.  Filters decide on rows by id and text together (the text by a hash of it) and
take out what they reject by an anti-join, which leaves the texts where they are unless
the rejected are too many to broadcast.

Defined results, in every stage: a null text counts as empty; empty texts are equal to
one another, so exact dedup leaves one, and are near copies of nothing; a null id is a
row of its own for toxicity, exact dedup and packing, and never a near copy; rows that
share an id are judged by their own texts, and of fully repeated rows one stays; of
equal texts the longest as written stays, then the smallest id; of near copies the
smallest id, then the smallest hash of its text; an empty table goes through all stages
empty; columns beside doc_id, text and source pass through the filters as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import dedup, jaccard, packing, queries, scratch, toxicity


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` but for the rows in ``rejected`` (id, mark), a written table."""
    mark = F.xxhash64("text")
    lost = jaccard.small(rejected).alias("_rejected")
    return docs.alias("_docs").join(lost, F.col("_docs.doc_id").eqNullSafe(F.col("_rejected.id")) & (mark == F.col("_rejected.mark")), "left_anti")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learning from the labels of rows not held out, scores below 0.5."""
    model = toxicity.train_on(docs, queries.table(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity")
    return toxicity.score(docs, model, into=score).where(F.col(score) < 0.5).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; a row that repeats another's id and text goes as well."""
    rows = scratch.written(dedup.groups(docs).groupBy("id", "mark").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("NOT kept OR rows > 1"), "copies")
    once = without(docs, scratch.written(rows.where("NOT kept").select("id", "mark"), "rejected"))
    again = scratch.written(rows.where("kept").select("id", "mark"), "again")
    if again.isEmpty():
        return once
    twice = jaccard.small(again).alias("_again")
    repeated = once.alias("_docs").join(twice, F.col("_docs.doc_id").eqNullSafe(F.col("_again.id")) & (F.xxhash64("text") == F.col("_again.mark")), "left_semi")
    return without(once, again).unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, similarity 0.8) the document with the smallest id."""
    linked = jaccard.join(docs, n=5, num=80, den=100)
    return without(docs, scratch.written(linked.where("NOT first").select("id", "mark").distinct(), "rejected"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, mixed by source: ids as little-endian unsigned 32-bit numbers, and their CRC-32."""
    packed = packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"))
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "ids")


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("jaccard_join", near), ("packing", pack)]
#: The trained classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
