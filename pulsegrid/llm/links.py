"""Connected components of links, without a driver-side table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def roots(parents: DataFrame) -> DataFrame:
    """(id, root) from (id, parent) with parent < id, at most one row an id: pointers are doubled until none moves."""
    while True:
        up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        grown = scratch.written(parents.join(up, "parent", "left").select("id", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "roots")
        parents = grown.select("id", "parent")
        if grown.where("moved").isEmpty():
            return parents.withColumnRenamed("parent", "root")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b): the smallest id that its links reach.

    Alternating stars: each node hands its neighbours above it to the smallest
    neighbour, then its neighbours below it likewise, until all edges are stars.
    A node of any degree is a minimum (partially aggregated) and a join.
    """
    pairs = scratch.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.written(large.where("u <> v"), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = scratch.written(small.select("e.u", "e.v").where("u <> v").distinct(), "small")
        change = pairs.exceptAll(small).isEmpty() and small.exceptAll(pairs).isEmpty()
        pairs = small
        if change:
            return pairs.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id").union(pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
