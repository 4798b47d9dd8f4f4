"""Chat formatting: reply trees to conversations.

Every node of a tree answers its parent.  Self-joins of the parent links, each
doubling the step, give every node's ancestor 1, 2, 4, ... steps up; joining the
leaves with these tables, the longest step first, enumerates all root-to-leaf paths in
as many joins as the depth has binary digits, with one row a path and node.  A path's
score is the sum of its nodes'; the best of each tree are formatted, each as one
conversation, with a mask over the characters that a model should learn.

Turns are marked ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline.  A text may
hold such strings: each ``<``, backslashes, ``|`` gets one backslash more, which reading
back takes off again; in roles, backslashes and newlines are escaped.

Defined results: null roles and texts count as empty; a parent that does not exist makes
a root; nodes on a cycle, and what hangs on it, are on no path; equal scores are ranked
by leaf; of nodes repeated with one id all are kept, as turns in the order of role and
text; a null tree is a tree; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: The marks of the template.
START, STOP = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    kept = F.replace(unescape(role), F.lit("\\\\"), F.lit("\\\u0000"))
    return F.replace(F.replace(kept, F.lit("\\n"), F.lit("\n")), F.lit("\\\u0000"), F.lit("\\"))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, height) of all root-to-leaf paths of ``nodes`` (tree, node, parent); height 0 is the leaf."""
    ids = nodes.select("tree", "node").distinct()
    links = nodes.where("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("above")).distinct()
    same = lambda a, b: F.col(f"l.{a}").eqNullSafe(F.col(f"r.{b}"))
    known = links.alias("l").join(ids.alias("r"), same("tree", "tree") & (F.col("l.above") == F.col("r.node")), "left_semi")
    steps = [scratch.written(known, "step")]
    most = ids.count()
    while 1 << len(steps) <= most:
        last = steps[-1]
        far = last.alias("l").join(last.alias("r"), same("tree", "tree") & (F.col("l.above") == F.col("r.node"))).select("l.tree", "l.node", "r.above")
        far = scratch.written(far, "step")
        if far.isEmpty():
            break
        steps.append(far)
    leaves = ids.alias("l").join(steps[0].alias("r"), same("tree", "tree") & (F.col("l.node") == F.col("r.above")), "left_anti")
    found = scratch.written(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height")), "paths")
    for k in range(len(steps) - 1, -1, -1):
        up = found.alias("l").join(steps[k].alias("r"), same("tree", "tree") & (F.col("l.node") == F.col("r.node")))
        found = scratch.written(found.unionByName(up.select("l.tree", "leaf", F.col("r.above").alias("node"), (F.col("height") + (1 << k)).alias("height"))), "paths")
    rooted = found.alias("l").join(steps[0].alias("r"), same("tree", "tree") & (F.col("l.node") == F.col("r.node")), "left_anti")
    ends = rooted.select("tree", "leaf").distinct()
    return found.alias("l").join(ends.alias("r"), same("tree", "tree") & (F.col("l.leaf") == F.col("r.leaf")), "left_semi")


def chosen(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, score, turns) of the ``best`` paths of each tree of ``nodes`` (tree, node, parent, role, text, score)."""
    nodes = scratch.written(nodes.select("tree", "node", "parent", "role", "text", "score"), "nodes")
    on_path = paths(nodes.select("tree", "node", "parent"))
    told = nodes.select("tree", "node", "role", "text", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    same = F.col("l.tree").eqNullSafe(F.col("r.tree")) & (F.col("l.node") == F.col("r.node"))
    turn = F.struct((-F.col("height")).alias("place"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = on_path.alias("l").join(told.alias("r"), same).groupBy("l.tree", "leaf").agg(F.sum("score").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    return whole.withColumn("rank", rank).where(F.col("rank") <= best).drop("rank")


def formatted(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conversations`` with ``formatted``, and ``mask``: spans [start, end) of the code points of ``learn``'s texts."""
    one = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    parts = F.transform("turns", lambda t: F.struct((t["role"] == learn).alias("own"), one(t).alias("head"), escape(t["text"]).alias("body")))
    tail = STOP + "\n"
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + len(tail)).cast("long").alias("at"), F.when(p["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return conversations.withColumn("parts", parts).withColumn("formatted", text).withColumn("mask", F.aggregate("parts", start, step, lambda acc: acc["spans"])).drop("parts")


def read_back(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(text, r"<\|im_start\|>"), lambda x: x != "")
    body = lambda x: F.substring(x, F.instr(x, "\n") + 1, F.length(x) - F.instr(x, "\n") - F.lit(len(STOP) + 1))
    return F.transform(pieces, lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(body(x)).alias("text")))


def learned(text: Column, mask: Column) -> Column:
    """What stands under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def linear(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Conversations given as rows by turn, as trees of one branch."""
    order = Window.partitionBy("tree").orderBy(turn_col, "role", "text")
    cut = rows.select(F.col(id_col).alias("tree"), turn_col, "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return cut.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
