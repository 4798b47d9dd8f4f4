"""Incremental line dedup that can be undone: an index of lines to which documents are added and from which they are taken.

A line's key is the line with blanks stripped at both ends and A-Z lower-cased; keys of
LEAST code points or more count.  A key that stands in several documents stays only in the
one with the smallest id.  Keys are named by 128-bit BLAKE2b hashes.

* **Blocks.**  A task deals its documents into blocks of texts.  Texts are written by
  block and never shuffled; for each block and key one *cell* is, with the number of
  documents that hold it and their smallest and largest id.  A line that all documents
  hold is a cell a block.
* **Shards.**  Cells go to the shard of their key.  A shard has a cuckoo filter with one
  fingerprint of each key that lives, and an exact table of reference counts of those
  that several documents hold.  New cells pass the filter in waves: a key it doesn't know
  enters it and costs no more; one that it seems to know is a suspect.  Only suspects are
  counted exactly, over the cells of the shard, which also shows false suspects: these get
  a fingerprint of their own.  What finds no room in the filter is kept beside it.
* **Deletions.**  The blocks of deleted documents are written anew without them.  Keys that
  have no cell any more leave the filter, which, unlike a Bloom filter's, can give up a
  fingerprint since each living key has exactly one; the other keys of these blocks are
  counted anew.  The index is then as if the documents had never been added.
* **Texts.**  Shards tell each block which of its keys have several holders and who keeps
  them; block and answer meet without a shuffle of texts.

Defined results: a null or empty text is one empty line; rows that share an id are one
document, that keeps its lines in each of them; a null id comes after all others, and all
rows without id are one document; ids are whole numbers; an empty table gives an empty
result; columns other than id and text are not read; texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import textkernel as tk

BLANKS = b" \t\n\x0b\x0c\r"
#: Code points of the shortest key that counts.
LEAST = 10
#: Bytes of text of a block, and documents' bytes sent on at once.
BLOCK_BYTES, SENT_BYTES = 1 << 24, 1 << 20
#: Cells a shard at the start; the shards are dealt anew when they hold FULL times as many.
SHARD_CELLS, FULL = 1 << 20, 4
#: Cells that pass a filter at once.
WAVE = 1 << 16
NO_ID = (1 << 63) - 1


class Cuckoo:
    """A cuckoo filter of 64-bit hashes: buckets of four 16-bit fingerprints, and what found no room.

    A hash has two buckets, each found from the other and the fingerprint alone.  Copies
    of a fingerprint in the same two buckets are alike, so that deleting any is right.
    """

    SLOTS, KICKS, LOAD = 4, 200, 0.8

    def __init__(self, table: np.ndarray, rest: np.ndarray):
        self.table, self.rest = table, rest

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (cls.SLOTS * cls.LOAD)))))
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16), np.zeros(0, np.int64))

    @classmethod
    def load(cls, raw: bytes) -> Cuckoo:
        buckets, rest = np.frombuffer(raw[:16], np.int64).tolist()
        data = np.frombuffer(pa.decompress(raw[16:], buckets * cls.SLOTS * 2 + rest * 8, codec="zstd", asbytes=True), np.uint8)
        split = buckets * cls.SLOTS * 2
        return cls(data[:split].view(np.uint16).reshape(buckets, cls.SLOTS).copy(), data[split:].view(np.int64).copy())

    def dump(self) -> bytes:
        return np.array([len(self.table), len(self.rest)], np.int64).tobytes() + pa.compress(self.table.tobytes() + self.rest.tobytes(), codec="zstd", asbytes=True)

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table)) + len(self.rest)

    def room(self) -> int:
        return int(self.table.size * self.LOAD) - len(self)

    def other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (tk.mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, bucket, other bucket) of each hash."""
        mark = np.maximum(hashes >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        first = (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, self.other(first, mark)

    def codes(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """One number for a fingerprint and its two buckets."""
        return (mark.astype(np.int64) << 44) | np.minimum(bucket, self.other(bucket, mark))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(hashes)
        found = (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)
        return found | np.isin(self.codes(mark, one), self.rest) if len(self.rest) else found

    def put(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of ``bucket``; which of them found none."""
        if not len(mark):
            return np.zeros(0, np.int64)
        order = np.argsort(bucket, kind="stable")
        at = bucket[order]
        fresh = np.append(True, at[1:] != at[:-1])
        nth = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        free = self.table[at] == 0
        upto = np.cumsum(free, axis=1)
        fits = upto[:, -1] > nth
        slot = ((upto == nth[:, None] + 1) & free).argmax(1)
        self.table[at[fits], slot[fits]] = mark[order[fits]]
        return order[~fits]

    def insert(self, hashes: np.ndarray) -> None:
        """Enters one fingerprint for each of ``hashes``."""
        mark, one, two = self.places(hashes)
        left = self.put(mark, one)
        mark, bucket = mark[left], two[left]
        left = self.put(mark, bucket)
        mark, bucket = mark[left], bucket[left]
        for turn in range(self.KICKS):
            if not len(mark):
                return
            at, who = np.unique(bucket, return_index=True)  # one a bucket moves a fingerprint on
            slot = (at + turn) % self.SLOTS
            out = self.table[at, slot]
            self.table[at, slot] = mark[who]
            wait = np.setdiff1d(np.arange(len(mark)), who)
            mark, bucket = np.concatenate([out, mark[wait]]), np.concatenate([self.other(at, out), bucket[wait]])
            left = self.put(mark, bucket)
            mark, bucket = mark[left], bucket[left]
        self.rest = np.sort(np.concatenate([self.rest, self.codes(mark, bucket)]))

    def delete(self, hashes: np.ndarray) -> None:
        """Takes one fingerprint out for each of ``hashes``, all of which are in."""
        mark, one, two = self.places(hashes)
        left = np.arange(len(mark))
        for bucket in (one, two):
            while len(left):
                same = self.table[bucket[left]] == mark[left, None]
                cell = np.where(same.any(1), bucket[left] * self.SLOTS + same.argmax(1), -1)
                cell, who = np.unique(cell, return_index=True)
                who = who[cell >= 0]
                if not len(who):
                    break
                self.table.ravel()[cell[cell >= 0]] = 0
                left = np.delete(left, who)
        if len(left):
            gone, many = np.unique(self.codes(mark[left], one[left]), return_counts=True)
            have, count = np.unique(self.rest, return_counts=True)
            at = np.searchsorted(have, gone)
            if (at >= len(have)).any() or (have[at] != gone).any() or (count[at] < many).any():
                raise ValueError("deleting what the filter doesn't hold")
            count[at] -= many
            self.rest = np.repeat(have, count)


def key_of(line: bytes) -> bytes | None:
    """The 128-bit name of a line's key; None if the line doesn't count."""
    key = line.strip(BLANKS)
    if len(key) < LEAST or (len(key) < 4 * LEAST and len(key.decode("utf-8", "replace")) < LEAST):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def numbers(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


HELD = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("text", pa.large_string()), ("k1", pa.int64()), ("k2", pa.int64()), ("docs", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def dealt(docs: DataFrame, generation: int) -> DataFrame:
    """``docs`` (id, text) by block: rows with id and text, and cells (k1, k2, docs, low, high) of the keys of each block."""

    def batch_of(rows: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(rows, f.type) for f in HELD], schema=HELD)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.forget()
        base, number, size = (generation << 44) | (TaskContext.get().partitionId() << 20), 0, 0
        cells: dict[bytes, list[int]] = {}
        last: dict[bytes, int] = {}

        def closed() -> pa.RecordBatch:
            k1, k2 = numbers([*cells])
            docs, low, high = (np.array(x, np.int64) for x in zip(*cells.values()))
            return batch_of(len(cells), block=np.full(len(cells), base + number), k1=k1, k2=k2, docs=docs, low=low, high=high)

        for batch in batches:
            held: list[tuple[int, int | None, str]] = []
            sent = 0
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                name = NO_ID if id_ is None else id_
                raw = text.encode("utf-8", "surrogatepass")
                for key in {k for line in raw.split(b"\n") if (k := key_of(line)) is not None}:
                    own = cells.get(key)
                    if own is None:
                        cells[key] = [1, name, name]
                    else:
                        own[0], own[1], own[2] = own[0] + 1, min(own[1], name), max(own[2], name)
                held.append((base + number, id_, text))
                size, sent = size + len(raw), sent + len(raw)
                if sent > SENT_BYTES:
                    yield batch_of(len(held), **dict(zip(("block", "id", "text"), zip(*held))))
                    held, sent = [], 0
                if size > BLOCK_BYTES:
                    if cells:
                        yield closed()
                    cells.clear()
                    number, size = number + 1, 0
            if held:
                yield batch_of(len(held), **dict(zip(("block", "id", "text"), zip(*held))))
        if cells:
            yield closed()

    return docs.mapInArrow(deal, "block long, id long, text string, k1 long, k2 long, docs long, low long, high long")


LIVE, NEW, GONE = 0, 1, 2
STATE = "shard long, filter binary, block long, k1 long, k2 long, docs long, low long, high long"
_STATE = pa.schema([("shard", pa.int64()), ("filter", pa.binary()), *((c, pa.int64()) for c in ("block", "k1", "k2", "docs", "low", "high"))])


def settle(shard: int, cells: dict[str, np.ndarray], filter_: Cuckoo | None, known: tuple[np.ndarray, np.ndarray]) -> tuple[Cuckoo, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """One shard, brought up to date: its filter, its reference counts, and the answers to blocks.

    ``cells``: kind (LIVE, NEW, GONE), block, k1, k2, docs, low, high; ``known``: keys that
    had several holders.
    """
    kind, n = cells["kind"], len(cells["kind"])
    k1, k2 = np.concatenate([cells["k1"], known[0]]), np.concatenate([cells["k2"], known[1]])
    order = np.lexsort((k2, k1))
    fresh = np.append(True, (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)) if len(order) else np.zeros(0, bool)
    key = np.empty(len(k1), np.int64)
    key[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    k1, k2, keys = k1[first], k2[first], len(first)
    hashes = tk.mix(k1.view(np.uint64).copy())

    def having(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(keys, bool)
        out[rows] = True
        return out

    shared, own = having(key[n:]), key[:n]
    living, gone = having(own[kind == LIVE]), having(own[kind == GONE])
    entering = np.flatnonzero(kind == NEW)
    entering = entering[np.argsort(cells["block"][entering], kind="stable")]
    if filter_ is None:
        filter_ = Cuckoo.sized(int(having(own[entering]).sum()))
    leaving = gone & ~living
    filter_.delete(hashes[leaving])
    shared &= ~leaving
    if filter_.room() < len(entering) and filter_.room() < (new := int((having(own[entering]) & ~living).sum())):
        filter_ = Cuckoo.sized(2 * (int(living.sum()) + new))
        filter_.insert(hashes[living])
    held = living.copy()
    wide = entering[cells["low"][entering] < cells["high"][entering]]
    shared[own[wide]] = True
    for lo in range(0, len(entering), WAVE):
        ids, many = np.unique(own[entering[lo : lo + WAVE]], return_counts=True)
        hit = filter_.contains(hashes[ids])
        shared[ids[hit | (many > 1)]] = True
        filter_.insert(hashes[ids[~hit]])
        held[ids[~hit]] = True
    missing = having(own[entering]) & ~held  # false suspects: each gets a fingerprint of its own
    filter_.insert(hashes[missing])

    counted = np.flatnonzero((kind != GONE) & shared[own])
    at = own[counted]
    docs, low, high = np.zeros(keys, np.int64), np.full(keys, NO_ID), np.full(keys, -(1 << 63))
    np.add.at(docs, at, cells["docs"][counted])
    np.minimum.at(low, at, cells["low"][counted])
    np.maximum.at(high, at, cells["high"][counted])
    several = shared & (low < high)
    refs = {"k1": k1[several], "k2": k2[several], "docs": docs[several], "low": low[several], "high": high[several]}
    told = counted[several[at]]
    answers = {"block": cells["block"][told], "k1": cells["k1"][told], "k2": cells["k2"][told], "low": low[own[told]]}
    return filter_, refs, answers


def settled(changes: DataFrame, state: DataFrame, shards: int) -> DataFrame:
    """The state after ``changes`` (kind, block, k1, k2, docs, low, high): filters, reference counts and answers, written."""
    names = ["kind", "block", "k1", "k2", "docs", "low", "high"]

    def table(shard: int, rows: int, **given) -> pa.Table:
        given["shard"] = np.full(rows, shard)
        return pa.Table.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(rows, f.type) for f in _STATE], schema=_STATE)

    def shard(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        number = key[0].as_py()
        cells = {c: left.column(c).to_numpy() for c in names}
        blobs = right.column("filter").drop_null()
        known = right.filter(right.column("k1").is_valid())
        filter_ = Cuckoo.load(blobs[0].as_py()) if len(blobs) else None
        filter_, refs, answers = settle(number, cells, filter_, (known.column("k1").to_numpy(), known.column("k2").to_numpy()))
        return pa.concat_tables([table(number, 1, filter=[filter_.dump()]), table(number, len(refs["k1"]), **refs), table(number, len(answers["k1"]), **answers)])

    to = F.pmod("k2", F.lit(shards)).cast("long")
    left = changes.select(to.alias("shard"), *(F.col(c).cast("long").alias(c) for c in names)).groupBy("shard")
    return scratch.written(left.cogroup(state.where("block IS NULL").select("shard", "filter", "k1", "k2").groupBy("shard")).applyInArrow(shard, STATE), "lines_state")


@dataclass(frozen=True)
class Index:
    """Documents and their lines.  Tables are never changed: each step gives a new index, and the one before stays right."""

    spark: SparkSession
    generation: int = 0
    shards: int = 0
    #: (block, id, text)
    texts: DataFrame | None = None
    #: (block, k1, k2, docs, low, high)
    cells: DataFrame | None = None
    #: STATE
    state: DataFrame | None = None

    def added(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Texts and cells of ``docs`` (id, text), written by block."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        made = scratch.bucketed(dealt(docs, self.generation), "lines", "block", buckets)
        return made.where("k1 IS NULL").select("block", "id", "text"), made.where("k1 IS NOT NULL").select("block", "k1", "k2", "docs", "low", "high")

    def moved(self, texts: DataFrame, live: DataFrame | None, new: DataFrame, gone: DataFrame | None) -> Index:
        """The index with these texts and cells."""
        cells = new if live is None else live.unionByName(new)
        many, shards = cells.count(), self.shards
        parallel = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        changes = [(NEW, new), *([(LIVE, live)] if live is not None else []), *([(GONE, gone)] if gone is not None else [])]
        state = self.state if self.state is not None else self.spark.createDataFrame([], STATE)
        if not shards or many > FULL * SHARD_CELLS * shards:
            shards = max(-(-many // SHARD_CELLS), min(parallel, -(-many // WAVE)), 1)
            changes, state = [(NEW, cells)], self.spark.createDataFrame([], STATE)
        marked = [df.withColumn("kind", F.lit(kind)) for kind, df in changes]
        for df in marked[1:]:
            marked[0] = marked[0].unionByName(df)
        return replace(self, generation=self.generation + 1, shards=shards, texts=texts, cells=cells, state=settled(marked[0], state, shards))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
        scratch.lean(self.spark)
        texts, cells = self.added(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
        return self.moved(texts if self.texts is None else self.texts.unionByName(texts), self.cells, cells, None)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> Index:
        """Without the documents whose ids are in ``ids``."""
        if self.texts is None:
            return self
        gone = ids.select(F.col(id_col).cast("long").alias("_gone")).distinct()
        named = F.col("id").eqNullSafe(F.col("_gone"))
        hit = scratch.written(self.texts.select("block", "id").join(gone, named, "left_semi").select("block").distinct(), "lines_hit")
        left = self.texts.join(hit, "block", "left_semi").join(gone, named, "left_anti").select("id", "text")
        texts, cells = self.added(left)
        untouched = self.texts.join(hit, "block", "left_anti")
        return self.moved(untouched.unionByName(texts), self.cells.join(hit, "block", "left_anti"), cells, self.cells.join(hit, "block", "left_semi"))

    def references(self) -> DataFrame:
        """(k1, k2, docs, low, high) of the keys with several holders: rows that hold it, the smallest and the largest id."""
        return self.state.where("k1 IS NOT NULL AND block IS NULL").select("k1", "k2", "docs", "low", "high")

    def result(self) -> DataFrame:
        """(id, n_lines, n_dropped, text) of every document: the text without lines that a document with a smaller id has."""
        answers = self.state.where("block IS NOT NULL").select("block", "k1", "k2", "low")
        out = pa.schema([("id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])

        def clean(told: pa.Table, held: pa.Table) -> pa.Table:
            pairs = np.stack([told.column(c).to_numpy() for c in ("k1", "k2")], 1).astype(np.int64) if told.num_rows else np.zeros((0, 2), np.int64)
            raw = pairs.tobytes()
            keeper = {raw[16 * i : 16 * i + 16]: low for i, low in enumerate(told.column("low").to_pylist())}
            rows = []
            for id_, text in zip(held.column("id"), held.column("text")):
                id_, lines = id_.as_py(), (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                name = NO_ID if id_ is None else id_
                kept = [line for line in lines if keeper.get(key_of(line), name) == name] if keeper else lines
                rows.append((id_, len(lines), len(lines) - len(kept), b"\n".join(kept).decode("utf-8", "surrogatepass")))
            return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), out)], schema=out) if rows else out.empty_table()

        return answers.groupBy("block").cogroup(self.texts.groupBy("block")).applyInArrow(clean, "id long, n_lines long, n_dropped long, text string")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``Index.result`` of an index of ``docs``."""
    return Index(docs.sparkSession).insert(docs, id_col, text_col).result()
