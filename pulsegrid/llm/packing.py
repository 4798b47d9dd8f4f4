"""Mixture-controlled packing: deficit round-robin over one queue a source.

All texts of a source form one queue, in the order of their partitions.  In each round
every queue is visited in turn; its deficit grows by its target share of a window, and
while it holds a quantum, a quantum is served and taken off.  What is left of a deficit
is carried into the next round, so over windows and partitions each queue is never more
than a quantum from its target.  Deficits begin staggered, so that small queues don't
come due together.  An empty queue is passed over, which leaves its share to the others.

Served one by one, that would be a loop over the corpus.  But the number of quanta that
a queue was served by the end of round k is known at once, floor((8 k w + d) / W) for a
weight w of W in all, 8 quanta a window and a first deficit d; so the round of any
quantum is, and with it all that comes before.  Once each text has its place in its
queue (prefix sums over a small table of partition and queue), every partition computes
where its own tokens go, and nothing but that table is gathered.

More sources than FAN form a tree: each FAN of them share a node by deficit
round-robin, and nodes share their parent's stream likewise by the sums of their shares.

Windows are cut from the stream without gaps.  What is left at its end is cut
into powers of two, which need no padding.

Defined results: a null text counts as empty and consists of the end token alone;
a null source shares the queue of the empty name; repeated rows are packed each;
an empty table gives no pieces; columns other than id, text and source are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, tokens
from . import textkernel as tk

WINDOW = 2048
QUANTUM = 256
#: Queues that share a stream directly; more do so by a tree of such streams.
FAN = 256
#: Weights are whole numbers up to this; with FAN of them and up to 2**34 quanta in a queue, products stay below 2**63.
RESOLUTION = 1 << 20
#: Rows (partition, queue) that are broadcast, 24 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Sources at most: their names and sizes are gathered, some 100 bytes each.
SOURCES = 2_000_000
#: Places computed at once, times FAN.
PLACED = 4096


def encoded(docs: DataFrame, path: str, end: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(pid, queue, id, queue_start, n, ids) of every text; ``queue_start`` counts inside its partition's part of the queue."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.trim()
        encoder = tokens.held(tokens.Encoder, path)
        last, width = np.array([end], encoder.dtype).tobytes(), encoder.dtype.itemsize
        pid, served = TaskContext.get().partitionId(), {}
        for batch in batches:
            for first, after, texts in tokens.runs(batch.column("text")):
                ids = [x + last for x in encoder.encode(texts)]
                n = [len(x) // width for x in ids]
                queue, start = batch.column("queue")[first:after], []
                for q, k in zip(queue.to_pylist(), n):
                    start.append(served.get(q, 0))
                    served[q] = start[-1] + k
                yield pa.RecordBatch.from_arrays([pa.array([pid] * len(n), pa.int64()), queue, batch.column("id")[first:after], pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["pid", "queue", "id", "queue_start", "n", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    name = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = docs.select(name.alias("queue"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, f"pid long, queue string, id {kind}, queue_start long, n long, ids binary")


@dataclass
class Stream:
    """Queues that share one stream: their weights, first deficits and sizes."""

    weights: np.ndarray
    first: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, shares: np.ndarray, sizes: np.ndarray) -> Stream:
        weights = np.maximum(1, np.round(shares / max(shares.max(initial=0), 1e-300) * RESOLUTION)).astype(np.int64)
        first = (np.arange(1, len(weights) + 1) * 0.6180339887498949 % 1 * weights.sum()).astype(np.int64)
        return cls(weights, first, sizes)

    def place(self, quantum: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Tokens in the stream before each given quantum of queue ``own``."""
        out = np.empty(len(quantum), np.int64)
        whole, gain = int(self.weights.sum()), WINDOW // QUANTUM * self.weights
        last = (-(-self.sizes // QUANTUM) * whole) // gain + 1  # the round in which a queue has run dry
        queue = np.arange(len(gain))
        for lo in range(0, len(quantum), PLACED):
            i, q = quantum[lo : lo + PLACED], own[lo : lo + PLACED]
            turn = -(-((i + 1) * whole - self.first[q]) // gain[q])
            rounds = np.minimum(turn[:, None] - (queue[None, :] > q[:, None]), last[None, :])
            served = np.minimum((rounds * gain + self.first) // whole * QUANTUM, self.sizes)
            served[np.arange(len(q)), q] = i * QUANTUM
            out[lo : lo + PLACED] = served.sum(1)
        return out


def streams(shares: np.ndarray, sizes: np.ndarray) -> list[list[Stream]]:
    """The streams of all queues, a list a level: each FAN of a level share a stream, which is a queue of the next."""
    out = []
    while True:
        parts = [slice(lo, lo + FAN) for lo in range(0, len(sizes), FAN)]
        out.append([Stream.of(shares[p], sizes[p]) for p in parts])
        if len(parts) <= 1:
            return out
        shares, sizes = (np.array([x[p].sum() for p in parts]) for x in (shares, sizes))


def edges(total: int) -> np.ndarray:
    """Where the sequences after the last full window begin, and the end: powers of two, the largest first."""
    full, rest = total // WINDOW * WINDOW, total % WINDOW
    return full + np.cumsum([0, *(1 << b for b in range(WINDOW.bit_length() - 1, -1, -1) if rest >> b & 1)])


def sequence(at: np.ndarray, tail: np.ndarray) -> np.ndarray:
    return np.where(at < tail[0], at // WINDOW, tail[0] // WINDOW + np.searchsorted(tail, at, side="right") - 1)


def begin(number: np.ndarray, tail: np.ndarray) -> np.ndarray:
    full = tail[0] // WINDOW
    return np.where(number < full, number * WINDOW, tail[np.clip(number - full, 0, len(tail) - 1)])


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for each number from low to high of each row."""
    sizes = high - low + 1
    row = np.repeat(np.arange(len(low)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[row]


def cut(start: np.ndarray, n: np.ndarray, own: np.ndarray, levels: list[list[Stream]], total: int) -> tuple[np.ndarray, ...]:
    """Pieces of texts, at ``start`` in their queue ``own`` with ``n`` tokens: (text, first token, length, sequence, offset)."""
    tail = edges(total)
    text, first, at, size = np.arange(len(start)), np.zeros(len(start), np.int64), start, n
    for level in levels:
        row, quantum = expand(at // QUANTUM, (at + size - 1) // QUANTUM)
        low = np.maximum(at[row], quantum * QUANTUM)
        size = np.minimum((at + size)[row], (quantum + 1) * QUANTUM) - low
        text, first = text[row], first[row] + low - at[row]
        place = np.empty(len(row), np.int64)
        node = own[text] // FAN
        for one in np.unique(node):
            here = np.flatnonzero(node == one)
            place[here] = level[one].place(quantum[here], own[text[here]] % FAN)
        at = place + low - quantum * QUANTUM
        own = own // FAN
    row, number = expand(sequence(at, tail), sequence(at + size - 1, tail))
    begins = np.maximum(at[row], begin(number, tail))
    ends = np.minimum((at + size)[row], begin(number + 1, tail))
    text, first = text[row], first[row] + begins - at[row]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1]) | (begins[1:] != ends[:-1])
    keep = np.flatnonzero(fresh)
    length = np.add.reduceat(ends - begins, keep) if len(keep) else np.zeros(0, np.int64)
    return text[keep], first[keep], length, number[keep], (begins - begin(number, tail))[keep]


def pack(docs: DataFrame, path: str, end: int = 1, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset, source) of all texts.

    ``targets``: the share of tokens that each source should have in every window;
    by default its share of the whole corpus, so that all queues end together.  A
    source without a target is served when all others have run dry, or a millionth
    as often as the largest.
    ``ids`` are little-endian unsigned 32-bit numbers.
    """
    spark = docs.sparkSession
    scratch.lean(spark)
    rows = scratch.written(encoded(docs, path, end, id_col, text_col, source_col), "ids")
    served = rows.groupBy("queue", "pid").agg(F.sum("n").alias("part"))
    before = F.coalesce(F.sum("part").over(Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = scratch.written(served.select("queue", "pid", "part", before.alias("base")), "bases")
    sources = bases.groupBy("queue").agg(F.sum("part").alias("size")).limit(SOURCES + 1).collect()
    if len(sources) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources; pack by a coarser column")
    totals = {r["queue"]: r["size"] for r in sources}
    names = sorted(totals)
    if targets and names and not any(targets.get(q) for q in names):
        raise ValueError("targets name no source of the table")
    sizes = np.array([totals[q] for q in names], np.int64)
    levels = streams(np.array([(targets or totals).get(q, 0) for q in names], float), sizes)
    total = int(sizes.sum())
    plan = spark.sparkContext.broadcast((names, levels))  # SOURCES at most
    width = tokens.held(tokens.Encoder, path).dtype.itemsize

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.forget()
        names, levels = plan.value
        number = {q: i for i, q in enumerate(names)}
        for batch in batches:
            own = np.array([number[q] for q in batch.column("queue").to_pylist()], np.int64)
            start = batch.column("queue_start").to_numpy() + batch.column("base").to_numpy()
            n, ids = batch.column("n").to_numpy(), batch.column("ids")
            text, first, length, seq, offset = cut(start, n, own, levels, total)
            for lo in range(0, len(text), 4096):
                part = slice(lo, lo + 4096)
                row = text[part]
                out, last, whole = [], -1, None
                for r, a, k in zip(row.tolist(), first[part].tolist(), length[part].tolist()):
                    if r != last:
                        last, whole = r, np.frombuffer(ids[r].as_buffer(), f"<u{width}").astype("<u4").tobytes()
                    out.append(whole[4 * a : 4 * (a + k)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(row)), pa.array(first[part]), pa.array(length[part]), pa.array(out, pa.binary()), pa.array(n[row]), pa.array(seq[part]), pa.array(offset[part]), batch.column("queue").take(pa.array(row))],
                    ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source"],
                )

    if scratch.at_most(bases, BROADCAST_ROWS):
        bases = F.broadcast(bases)
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.join(bases.drop("part"), ["queue", "pid"]).select("queue", "id", "queue_start", "base", "n", "ids")
    return found.mapInArrow(pieces, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string")


def checked(packed: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of these."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def unpack(piece: bytes) -> list[int]:
    return np.frombuffer(piece, "<u4").tolist()


def crc32(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
