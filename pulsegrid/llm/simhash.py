"""Document fingerprints: SimHash over weighted terms.

A text's terms are its distinct pairs of neighbouring words (A-Z lower-cased; a single
word is a term of its own); one that stands there n times weighs 1 + ln n.  Each term's
hash votes on BITS signed bits with its weight; the fingerprint has the signs.  Two
texts' likeness is the share of bits on which they agree, 1 - angle / pi of their term
vectors in expectation.

``search`` finds all fingerprints within a Hamming radius below 32 exactly: of 16 parts
of 16 bits, one differs in at most one bit.  There is a table for each part, permuted so
that the part leads and names the block: a fingerprint stands in one block of each table,
and a query asks the block of its part, and of the part with each bit flipped.  Blocks
are dealt over the tasks by hash, so a fingerprint is sent 16 times and a query 272 times
however many there are; blocks of many entries are dealt over several tasks.  A pair
counts in the first table in which it meets.  Equal fingerprints count as one entry with
a number; ``neighbours`` gives the rows themselves.  What is compared is a 65,536th of all
entries in each block asked, so comparisons still grow with entries times queries; no
wider part would keep all fingerprints within an eighth of the bits.

``chained`` puts each text beside the next by id without a global sort: ids are cut into
ranges, a text goes to its range, and the first of each range to the one before as well.

Defined results: a null text counts as empty; a text without words has the fingerprint 0;
a null id comes before all others, as does the smallest long, which comes back as null; rows with equal ids are ordered by a hash of their
texts; after the last comes the first, so a single row follows itself; columns other
than id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textkernel as tk

BITS = 256
WORDS = BITS // 64
#: Texts of a likeness of 0.88; copies of 400 words with a Jaccard likeness of 0.8 in five-word shingles differ in 24 bits by calculation.
RADIUS = 31
#: Of 16 bits each; up to a radius of 31, one of them differs in at most one bit.
PARTS = BITS // 16
#: Entries of a block that go to one task, about: 32 MB.  Fingerprints placed at once.
BLOCK_ENTRIES, PLACED = 1 << 20, 256
#: Pairs compared at once; a task's memory for them is some 20 MB.
COMPARED = 1 << 17
_SEEDS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.full(WORDS, 0x9E3779B97F4A7C15, np.uint64)


def sketch(own: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The fingerprint of weighted term hashes, as WORDS 64-bit numbers."""
    votes = np.zeros(BITS, np.float64)
    for lo in range(0, len(own), 1 << 14):
        term, w = own[lo : lo + (1 << 14)], weight[lo : lo + (1 << 14)]
        wide = np.stack([tk.mix(term + seed) for seed in _SEEDS], 1)
        bits = np.unpackbits(wide.view(np.uint8), axis=1)
        votes += 2.0 * (w @ bits.astype(np.float32)) - w.sum()
    return np.packbits(votes > 0).view(np.uint64)


def fingerprints(texts: list[str]) -> np.ndarray:
    """(n, WORDS) fingerprints of whole texts."""
    out = np.zeros((len(texts), WORDS), np.uint64)
    for first, _, data, at in tk.blocks(pa.array(texts, pa.large_string())):
        hashes, cut, _ = tk.words(data, at)
        for i, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
            own, count = np.unique(tk.shingles(hashes[a:b], 2), return_counts=True)
            if len(own):
                out[first + i] = sketch(own, (1 + np.log(count)).astype(np.float32))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) / BITS


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Ranges:
    """Buckets of rows by (key, tie): ranges of keys between ``cuts``; a key that several cuts fall on is cut by its ties as well."""

    def __init__(self, cuts: list[int]):
        self.values, many = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.pieces = np.array([1 << int(m - 1).bit_length() if m > 1 else 1 for m in many.tolist()], np.int64)
        self.base = 1 + np.cumsum(np.append(0, np.where(self.pieces > 1, self.pieces + 1, 1)))[: len(many)].astype(np.int64)
        self.hot = self.values[self.pieces > 1]

    def bucket(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(len(key), np.int64)
        j = np.searchsorted(self.values, key, side="right") - 1
        at = np.maximum(j, 0)
        piece = np.where(self.values[at] == key, tie.astype(np.int64) * self.pieces[at] >> 32, self.pieces[at])
        return np.where(j < 0, 0, self.base[at] + np.where(self.pieces[at] > 1, piece, 0))


def chained(docs: DataFrame, ranges: int) -> DataFrame:
    """(bucket, extra, key, tie, text) of ``docs`` (id, text): sorted by these within a bucket, each row's next follows it.

    ``extra`` rows are the copies that close a bucket.
    """
    key = F.coalesce(F.col("id"), F.lit(-(1 << 63))).alias("key")
    cuts = docs.select(key).select(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else None
    dealt_by = Ranges(cuts or [])
    hot = set(dealt_by.hot.tolist())
    tie = F.when(key.isin(*hot), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).otherwise(0) if hot else F.lit(0)

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[int, int]] = {}
        for batch in batches:
            k, t = batch.column("key").to_numpy(), batch.column("tie").to_numpy()
            bucket = dealt_by.bucket(k, t)
            order = np.lexsort((t, k, bucket))
            first = order[np.append(True, np.diff(bucket[order]) > 0)] if len(order) else order
            for b, x in zip(bucket[first].tolist(), zip(k[first].tolist(), t[first].tolist())):
                least[b] = min(x, least.get(b, x))
        yield pa.RecordBatch.from_arrays([pa.array([*least], pa.int64()), pa.array([x[0] for x in least.values()], pa.int64()), pa.array([x[1] for x in least.values()], pa.int64())], ["bucket", "key", "tie"])

    ends = docs.select(key, tie.cast("long").alias("tie")).mapInArrow(low, "bucket long, key long, tie long")
    firsts = ends.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("first")).orderBy("bucket").collect()  # a row a range
    before = {(r["first"]["key"], r["first"]["tie"]): firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, texts = batch.column("key").to_numpy(), batch.column("text")
            for lo in range(0, len(k), 512):
                part = k[lo : lo + 512]
                raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in texts[lo : lo + 512]]
                own_tie = np.array([zlib.crc32(x) for x in raw], np.int64)
                packed = [zlib.compress(x, 1) for x in raw]
                name = [(x, t if x in hot else 0) for x, t in zip(part.tolist(), own_tie.tolist())]
                also = [i for i, x in enumerate(name) if x in before]
                rows = [*range(len(part)), *also]
                bucket = np.append(dealt_by.bucket(part, own_tie), [before[name[i]] for i in also]).astype(np.int64)
                extra = [0] * len(part) + [1] * len(also)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(extra, pa.int32()), pa.array(part[rows]), pa.array(own_tie[rows]), pa.array([packed[i] for i in rows], pa.binary())], ["bucket", "extra", "key", "tie", "packed"])

    dealt = docs.select(key, "text").mapInArrow(deal, "bucket long, extra int, key long, tie long, packed binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "extra", "key", "tie")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    scratch.lean(docs.sparkSession)
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, str]] = []

        def done(rows):
            own = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            texts = [r[3] for r in rows]
            new = [edited(texts[i], texts[i + 1]) for i in own]
            prints = fingerprints(texts)
            changed = fingerprints(new)
            here, following = prints[own], prints[[i + 1 for i in own]]
            name = lambda x: [v.tobytes().hex() for v in x]
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[i][2] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()), pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in new], pa.string()),
                 pa.array(name(here), pa.string()), pa.array(name(changed), pa.string()), pa.array(likeness(here, changed), pa.float64()), pa.array(likeness(here, following), pa.float64())],
                ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        size = 0
        for batch in batches:
            for bucket, extra, key, packed in zip(*(batch.column(c) for c in ("bucket", "extra", "key", "packed"))):
                text = zlib.decompress(packed.as_buffer()).decode("utf-8", "surrogatepass")
                rows.append((bucket.as_py(), extra.as_py(), key.as_py(), text))
                size += len(text)
                if size > 1 << 20 and len(rows) > 1:
                    yield done(rows)
                    rows, size = rows[-1:], len(text)
        if len(rows) > 1:
            yield done(rows)

    got = chained(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ranges).mapInArrow(
        made, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return got.select(F.when(F.col("key") != -(1 << 63), F.col("key")).alias("id"), *got.columns[1:])


def tables(raw: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """The blocks (rows x PARTS x flips) that fingerprints stand in: of the table of each part, permuted so that the part leads, those that the part with each of ``flips`` names."""
    parts = raw.view(np.uint16).reshape(-1, PARTS)
    return (np.arange(PARTS, dtype=np.int64)[:, None] << 16) | (parts[:, :, None] ^ flips)


def met(prints: DataFrame, queries: DataFrame, radius: int, each: bool) -> DataFrame:
    """(query, n): rows of ``prints`` (fingerprint) within ``radius`` of each distinct fingerprint of ``queries``, in parts that add up; if ``each``, (query, found) instead."""
    if not 0 <= radius < 2 * PARTS:
        raise ValueError("radius is to be below %d" % (2 * PARTS))
    spark = prints.sparkSession
    entries = scratch.written(prints.groupBy(F.unhex("fingerprint").alias("raw")).agg(F.count("*").alias("n")), "classes")
    flips = np.array([0, *(1 << i for i in range(16 if radius >= PARTS else 0))], np.uint16)
    most = 2 if len(flips) > 1 else 1

    def placed(flips: np.ndarray):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, PLACED):
                    part = batch.slice(lo, PLACED)
                    raw = np.frombuffer(b"".join(part.column("raw").to_pylist()), np.uint64).reshape(-1, WORDS)
                    blocks = tables(raw, flips)
                    owner = pa.array(np.repeat(np.arange(len(raw)), blocks[0].size))
                    yield pa.RecordBatch.from_arrays([pa.array(blocks.ravel()), part.column("n").take(owner), part.column("raw").take(owner)], ["block", "n", "raw"])

        return place

    # a block of many entries is dealt over several tasks, and what asks it to each of them
    own = entries.select("n", "raw").mapInArrow(placed(flips[:1]), "block long, n long, raw binary")
    hot = own.groupBy("block").count().where(F.col("count") > BLOCK_ENTRIES).select("block", F.ceil(F.col("count") / BLOCK_ENTRIES).cast("int").alias("over"))
    hot = F.broadcast(scratch.written(hot, "hot"))  # at most PARTS << 16 rows, whatever the input
    over = F.coalesce("over", F.lit(1))
    own = own.join(hot, "block", "left").select("block", F.pmod(F.xxhash64("raw"), over).cast("int").alias("slice"), "n", "raw")
    asked = queries.select(F.unhex("fingerprint").alias("raw")).distinct().select(F.lit(0).cast("long").alias("n"), "raw").mapInArrow(placed(flips), "block long, n long, raw binary")
    asked = asked.join(hot, "block", "left").select("block", F.explode(F.sequence(F.lit(0), over - 1)).alias("slice"), "n", "raw")

    def compared(block: np.ndarray, n: np.ndarray, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query row, entry row) of pairs within the radius, each in the first table in which it meets; rows are sorted by block."""
        has, asks = np.flatnonzero(n > 0), np.flatnonzero(n == 0)
        low, high = np.searchsorted(block[has], block[asks]), np.searchsorted(block[has], block[asks], side="right")
        ends = np.cumsum(high - low)
        halves = raw.view(np.uint16).reshape(-1, PARTS)
        done, total = 0, int(ends[-1]) if len(ends) else 0
        while done < total:
            pair = np.arange(done, min(total, done + COMPARED))
            done += len(pair)
            q = np.searchsorted(ends, pair, side="right")
            e, q = has[pair - (ends[q] - high[q])], asks[q]
            close = np.bitwise_count(raw[q] ^ raw[e]).sum(1, dtype=np.int64) <= radius
            q, e = q[close], e[close]
            first = (np.bitwise_count(halves[q] ^ halves[e]) < most).argmax(1) == block[q] >> 36
            yield q[first], e[first]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WORDS), np.uint64))
        for batch in batches:
            block = (batch.column("block").to_numpy() << 20) | batch.column("slice").to_numpy()
            raw = np.frombuffer(b"".join(batch.column("raw").to_pylist()), np.uint64).reshape(-1, WORDS)
            block, n, raw = (np.concatenate(x) for x in zip(held, (block, batch.column("n").to_numpy(), raw)))
            for q, e in compared(block, n, raw):
                if each and len(q):
                    yield pa.RecordBatch.from_arrays([pa.array([raw[i].tobytes() for i in q], pa.binary()), pa.array([raw[i].tobytes() for i in e], pa.binary())], ["query", "found"])
                elif len(q):
                    who, at = np.unique(q, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([raw[i].tobytes() for i in who], pa.binary()), pa.array(np.bincount(at, n[e]).astype(np.int64))], ["query", "n"])
            if len(block):
                keep = (block == block[-1]) & (n > 0)
                held = (block[keep], n[keep], raw[keep])

    rows = own.unionByName(asked).repartition("block", "slice").sortWithinPartitions("block", "slice", F.col("n").desc())
    name = lambda c: F.lower(F.hex(c)).alias(c)
    if each:
        return rows.mapInArrow(meet, "query binary, found binary").select(name("query"), name("found"))
    return rows.mapInArrow(meet, "query binary, n long").select(name("query"), "n")


def search(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, n_near): rows of ``prints`` (fingerprint) within ``radius`` bits of each distinct fingerprint of ``queries``."""
    return met(prints, queries, radius, False).groupBy("query").agg(F.sum("n").alias("n_near"))


def neighbours(prints: DataFrame, queries: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(query, found, id): the rows that ``search`` counts."""
    return met(prints, queries, radius, True).join(prints.select(F.col("fingerprint").alias("found"), F.col(id_col)), "found").select("query", "found", id_col)
