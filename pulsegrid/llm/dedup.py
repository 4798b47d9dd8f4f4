"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every input partition digests its normalised texts (whitespace deleted), keeps a
   short fingerprint of each, and at its end sorts the distinct ones, cuts them by owner
   (a range of the fingerprint space) and codes each owner's list by Golomb and Rice.
   Digests and lists are written by partition: as a table bucketed by it.
2. An owner decodes its lists, counts in how many a fingerprint stands, and
   answers each sender with one bitmap: which of its entries others have too.
3. The bitmaps come back to the digests where these lie, which are not shuffled.
   Rows whose bit is set, or whose fingerprint repeats inside their partition,
   are suspects.  Only their texts are shuffled, and only to be compared byte for
   byte: grouping by the text itself, after a partial aggregation, so that a group
   of copies of any size costs a row a task.

A fingerprint sent once a partition, however many rows share it, makes a hot group
as cheap as a cold one.  False suspects cost time, never a wrong result.

Defined results: a null text counts as empty, and all empty texts are equal; of
equal texts the row with most code points stays, then the smallest id (null last),
then the first as read; fully repeated rows are a group like any other; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textkernel as tk

BLANKS = b" \t\n\x0b\x0c\r"
#: Bits of a fingerprint: of a million million texts each has a false copy in one case of 280.
PRINT_BITS = 48
#: Suspects' ids are broadcast up to this many (24 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def encode(values: np.ndarray, bits: int) -> tuple[int, bytes]:
    """Golomb-Rice code of a sorted list of distinct ``bits``-bit numbers: (remainder width, bytes).

    Gaps are split into a quotient, in unary, and a remainder of fixed width; the
    quotients come first, the remainders after, so that both decode as arrays.
    """
    n = len(values)
    if not n:
        return 0, b""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    width = max(0, int(np.log2(max(1.0, float(gaps.mean())) * 0.69)) if n else 0)
    high, low = gaps >> width, gaps & ((1 << width) - 1)
    unary = np.zeros(int(high.sum()) + n, np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    rest = ((low[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8)
    return width, np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def decode(n: int, width: int, code: bytes) -> np.ndarray:
    """The list that ``encode`` was given."""
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(code, np.uint8)
    tail = (n * width + 7) // 8
    stops = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]))[:n]
    high = np.diff(stops, prepend=-1) - 1
    rest = np.unpackbits(raw[len(raw) - tail :], count=n * width).reshape(n, width).astype(np.int64)
    low = rest @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64)) if width else 0
    return np.cumsum((high << width) + low + 1) - 1


def prints(sha: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(x[:8] for x in sha), ">u8") if len(sha) else np.zeros(0, np.uint64)
    return (raw.astype(np.uint64) >> np.uint64(64 - PRINT_BITS)).astype(np.int64)


def digests(docs: DataFrame, owners: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (pid, seat, id, mark, n_cp, sha): a text's partition, its place there, a hash of it as it is, code points, SHA-256 when normalised; and lists (pid, owner, n, width, code)."""
    edges = np.array([(o << PRINT_BITS) // owners for o in range(1, owners)], np.int64)
    names = ["pid", "seat", "id", "mark", "n_cp", "sha", "owner", "n", "width", "code"]
    wide = [pa.int64(), pa.int64(), None, pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def table(rows: int, like: pa.DataType, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(rows, k or like) for c, k in zip(names, wide)], names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.forget()
        pid, seat, own, like = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64), None
        for batch in batches:
            like = batch.column("id").type
            sha, points = [], []
            for _, _, data, at in tk.blocks(batch.column("text"), 1 << 22):
                whole, cut = data.tobytes(), at.tolist()
                sha += [hashlib.sha256(whole[a:b].translate(None, BLANKS)).digest() for a, b in zip(cut, cut[1:])]
                points.append(tk.code_points(data, at))
            n = batch.num_rows
            points = np.concatenate(points) if points else np.zeros(0, np.int64)
            own = np.union1d(own, prints(sha))
            yield table(n, like, pid=pa.array(np.full(n, pid)), seat=pa.array(np.arange(seat, seat + n)), id=batch.column("id"), mark=batch.column("mark"), n_cp=pa.array(points.astype(np.int64)), sha=pa.array(sha, pa.binary()))
            seat += n
        parts = [(o, x) for o, x in enumerate(np.split(own, np.searchsorted(own, edges))) if len(x)]
        if parts:
            width, code = zip(*(encode(x, PRINT_BITS) for _, x in parts))
            yield table(len(parts), like, pid=pa.array([pid] * len(parts)), owner=pa.array([o for o, _ in parts], pa.int32()), n=pa.array([len(x) for _, x in parts], pa.int32()), width=pa.array(width, pa.int32()), code=pa.array(code, pa.binary()))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    return rows.mapInArrow(digest, f"pid long, seat long, id {kind}, mark long, n_cp long, sha binary, owner int, n int, width int, code binary")


def suspects(seen: DataFrame, lists: DataFrame) -> DataFrame:
    """(pid, seat, id, mark, n_cp, sha) of the rows of ``seen`` whose fingerprint stands there again; both are read by partition."""
    rows = seen.schema.simpleString()[7:-1]

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        decoded = [decode(n, w, c) for n, w, c in zip(pdf["n"], pdf["width"], pdf["code"])]
        value, count = np.unique(np.concatenate(decoded), return_counts=True)
        again = value[count > 1]
        marks = [np.packbits(np.isin(x, again, assume_unique=True)).tobytes() for x in decoded]
        return pd.DataFrame({"pid": pdf["pid"], "owner": pdf["owner"], "n": pdf["n"], "marks": marks})

    def suspect(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        value, inverse, count = np.unique(prints(left["sha"].tolist()), return_inverse=True, return_counts=True)
        right = right.sort_values("owner")
        told = [np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(right["marks"], right["n"])]
        marked = np.concatenate(told).astype(bool) if told else np.zeros(0, bool)
        return left[((count > 1) | marked)[inverse]]

    answers = lists.groupBy("owner").applyInPandas(own, "pid long, owner int, n int, marks binary")
    return seen.groupBy("pid").cogroup(answers.groupBy("pid")).applyInPandas(suspect, rows)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256, mark (a hash of the text as it is)."""
    spark = docs.sparkSession
    scratch.lean(spark)
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = scratch.bucketed(digests(docs, owners, id_col, text_col), "digests", "pid", owners)
    seen = made.where("owner IS NULL").select("pid", "seat", "id", "mark", "n_cp", "sha")
    lists = made.where("owner IS NOT NULL").select("pid", "owner", "n", "width", "code")
    doubted = scratch.written(suspects(seen, lists), "suspects")
    ids = doubted.select(F.col("id").alias("_id")).distinct()
    if scratch.at_most(doubted, BROADCAST_ROWS):
        ids = F.broadcast(ids)
    bare = F.translate(F.coalesce(F.col("_text"), F.lit("")), BLANKS.decode(), "")
    texts = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text")).join(ids, F.col("_own").eqNullSafe(F.col("_id")), "left_semi").select(bare.alias("bare"))
    same = texts.groupBy(F.unhex(F.sha2(F.col("bare"), 256)).alias("sha"), "bare").agg(F.count("*").alias("n"))
    proven = same.groupBy("sha").agg(F.count("*").alias("variants"))
    best = F.min(F.struct((-F.col("n_cp")).alias("shorter"), F.col("id").isNull().alias("nameless"), "id", "pid", "seat"))
    copies = doubted.groupBy("sha").agg(F.count("*").alias("size"), best.alias("best")).where("size > 1")
    copies = copies.join(proven, "sha").where(F.assert_true(F.col("variants") == 1, F.lit("two texts with one SHA-256")).isNull())
    copies = scratch.written(copies.select("sha", "size", "best"), "copies")  # read again, so that a hot sha's rows can be split
    found = seen.join(F.broadcast(copies) if scratch.at_most(copies, BROADCAST_ROWS // 4) else copies, "sha", "left")
    alone = F.col("size").isNull()
    return found.select(
        F.col("id"),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("pid") == F.col("best.pid")) & (F.col("seat") == F.col("best.seat")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "mark",
    )
