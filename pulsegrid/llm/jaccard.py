"""Exact n-gram Jaccard join: who is linked to whom, as one component id a text.

A text's *seat* stands for its shingle set: the partition and a number there.  Equal sets
(by a 128-bit sum) are one class from the start, of which the lowest seat goes on.

* **Size bands.**  Sets are banded by size, each band 1.3 times as wide as the one
  below.  Two sets with similarity t or more differ in at most K = (1-t)/(1+t)(|A|+|B|)
  shingles.
* **Keys.**  A band cuts the hash space into m > K parts.  Two linked sets agree in all
  but K parts; so the largest part on which they agree is among the K + 1 largest of
  both, and each set sends the hashes of its K + 1 largest parts only.  Agreeing on a
  part means agreeing on a handful of shingles at once, so neither a common word nor a
  passage that many texts share brings its texts together.  A task sends a key once,
  however many of its texts have it; the exchange moves sorted, packed blocks.
* **Stars.**  Each set is first compared with one other: the lowest seat of one of its
  keys, namely the one it shares most keys with.  Only keys whose sets these links left
  in several components go on, and of keys with the same sets one.
* **Tiles.**  In such a key the sets outside its largest component are compared with all
  others of another component, tile by tile (large keys are split into blocks, each pair
  of blocks a task's worth), by hashed bitmap signatures: bit i is the parity of the
  shingles hashing to i, so two signatures differ in at most as many bits as the sets
  differ in shingles.  Counting these bits bounds the overlap from above.
* **Rounds.**  While many are left, each set names in the first round the one of its keys
  that most sets have, in the next 16 of those that are still split; then all count.  A tile first gives a
  spanning forest of its components, the closest pairs that the bound lets through, so
  at most a pair a set.  What these link is one component from then on.  A key with pairs
  left over goes on, and each two of its components then give their 8, 64, ... closest
  pairs.  A key without is done, and its sets need not be compared again in another.
* **Verification.**  Pairs are proven by intersecting their sorted arrays of shingle
  hashes; these are sent to one side of the pair, whose partners are dealt over tasks.

No pair is capped or sampled: a key is done when each pair that the bound lets through
was verified or lies within one component.

Defined results: null and empty texts have no shingles, n_shingles 0, and are linked
with nothing; a text with fewer words than n is one shingle; a null id is returned with
its size and a null component; rows repeated with one id are judged by their own texts;
columns other than id and text are not read; ids must be whole numbers.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import links, scratch
from . import textkernel as tk

WIDTH = 1.3
SPARE = 1.25
#: Bits of a signature for each shingle that two linked sets may differ in: a pair that the bound lets through differs in at most 1.07 times as many.
BITS_A_DIFFERENCE = 16
TILE = 512
#: Rows of two or three numbers broadcast at most, some 16 MB; beyond, joins shuffle.
BROADCAST_ROWS = 500_000
#: Keys that a task sorts and sends together.
FLUSH = 1_000_000
#: Partners of one set that are verified in one group.
PARTNERS = 256
#: Rows (key, seat) up to which all keys are compared in one round: a matter of time alone.
FEW = 100_000
#: Of the keys that are done, those told of a set, so that pairs compared there are not compared again: a matter of time alone.
PAST = 24
#: Bytes of a key, and of a seat's number in its partition.
KEY_BYTES, SEAT_BYTES = 6, 4


@lru_cache
def bands(num: int, den: int, largest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Lower ends of the bands up to ``largest``, and each band's (upper end, part edges)."""
    low, found = [], []
    at = 1
    while at <= largest:
        up = max(at, int(at * WIDTH))
        m = int(np.ceil(SPARE * (difference(2 * up, num, den) + 1)))
        low.append(at)
        found.append((up, np.array([(p << 64) // m for p in range(m)], np.uint64)))
        at = up + 1
    return np.array(low), found


def difference(both: int, num: int, den: int) -> int:
    """Shingles that two linked sets of ``both`` shingles together may differ in."""
    return (den - num) * both // (den + num)


def keys(own: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys of one sorted set of shingle hashes; their lowest bit is free."""
    n = len(own)
    reach = n * den // num
    low, all_bands = bands(num, den, 1 << max(10, int(reach).bit_length() + 1))
    first, last = int(np.searchsorted(low, n, side="right")) - 1, int(np.searchsorted(low, reach, side="right")) - 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(own))])
    out = []
    for band in range(first, last + 1):
        up, cuts = all_bands[band]
        k = difference(n + min(up, reach), num, den)
        if not k:
            continue
        at = np.append(np.searchsorted(own, cuts), n)
        part = np.argsort(-np.diff(at), kind="stable")[: k + 1]
        name = tk.mix((part + (band << 40)).astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
        out.append(tk.mix((total[at[part + 1]] - total[at[part]]) ^ name))
    return np.concatenate(out) >> np.uint64(64 - 8 * KEY_BYTES) & ~np.uint64(1) if out else np.zeros(0, np.uint64)


def signature(own: np.ndarray, num: int, den: int) -> bytes:
    """Bit i: the parity of how many hashes fall on i; twice as many bits from one size on, so that sizes differ by a fold."""
    bits = 1 << max(6, (BITS_A_DIFFERENCE * max(1, difference(2 * len(own), num, den)) - 1).bit_length())
    odd = np.bincount((own >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of 64-bit numbers, all of the least width among them."""
    sizes = np.array([len(x) for x in signatures])
    least = int(sizes.min())
    out = np.zeros((len(signatures), least), np.uint8)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        wide = np.frombuffer(b"".join(signatures[i] for i in at), np.uint8).reshape(len(at), -1, least)
        out[at] = np.bitwise_xor.reduce(wide, 1)
    return out.view(np.uint64)


def shingled(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct shingle hashes of each text from there on) of blocks of texts."""
    for first, _, data, at in tk.blocks(column):
        hashes, cut, _ = tk.words(data, at)
        yield first, [np.unique(tk.shingles(hashes[a:b], n)) for a, b in zip(cut.tolist(), cut[1:].tolist())]


def sets(docs: DataFrame, n: int, num: int, den: int, buckets: int) -> DataFrame:
    """Of (id, text, mark): a row a text (id, mark, n, sig, seat), and blocks (bucket, pid, n, raw) of its partition's keys.

    ``bucket`` is that of the keys for which the block is meant; -1 marks a block that
    needs no owner: further sets of a key that the partition sent.
    """
    shift = np.uint64(8 * KEY_BYTES - (buckets.bit_length() - 1))
    names = ["id", "mark", "n", "sig", "seat", "bucket", "pid", "raw"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def table(rows: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(rows, k) for c, k in zip(names, kinds)], names)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.forget()
        pid, number, held = TaskContext.get().partitionId(), 0, 0
        seats: dict[bytes, int] = {}
        key: list[np.ndarray] = []
        own_seat: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            k, s = np.concatenate(key), np.concatenate(own_seat)
            order = np.lexsort((s, k))
            k, s = k[order], s[order]
            first = np.append(True, k[1:] != k[:-1])
            begin = np.flatnonzero(first)
            many = np.diff(begin, append=len(k)) > 1
            sent, pivot = k[begin] | many.astype(np.uint64), s[begin]
            bucket, start = np.unique(sent >> shift, return_index=True)
            spans = list(zip(start.tolist(), [*start[1:].tolist(), len(sent)]))
            raw = [tk.packed((sent[a:b], KEY_BYTES), (pivot[a:b], SEAT_BYTES)) for a, b in spans]
            yield table(len(spans), n=pa.array([b - a for a, b in spans]), bucket=pa.array(bucket.astype(np.int32)), pid=pa.array([pid] * len(spans)), raw=pa.array(raw, pa.binary()))
            more = np.flatnonzero(~first)
            if len(more):
                raw = tk.packed((k[more], KEY_BYTES), (s[more], SEAT_BYTES), (s[begin][np.cumsum(first)[more] - 1], SEAT_BYTES))
                yield table(1, n=pa.array([len(more)]), bucket=pa.array([-1], pa.int32()), pid=pa.array([pid]), raw=pa.array([raw], pa.binary()))

        for batch in batches:
            for first, all_own in shingled(batch.column("text"), n):
                size, sig, seat = [], [], []
                for own in all_own:
                    size.append(len(own))
                    sig.append(b"%016x%016x" % (int(own.sum(dtype=np.uint64)), int(tk.mix(own + np.uint64(1)).sum(dtype=np.uint64))) if len(own) else None)
                    if not len(own):
                        seat.append(None)
                        continue
                    here = seats.get(sig[-1])
                    if here is None:
                        here = seats[sig[-1]] = number
                        number += 1
                        k = keys(own, num, den)
                        key.append(k)
                        own_seat.append(np.full(len(k), here, np.uint64))
                        held += len(k)
                    seat.append(pid << 40 | here)
                part = slice(first, first + len(size))
                yield table(len(size), id=batch.column("id")[part], mark=batch.column("mark")[part], n=pa.array(size, pa.int64()), sig=pa.array(sig, pa.binary()), seat=pa.array(seat, pa.int64()))
                if held > FLUSH:
                    yield from flush()
                    key, own_seat, held = [], [], 0
                    seats.clear()  # a copy further on gets a seat of its own
        if held:
            yield from flush()
        key, own_seat = [], []
        tk.trim()

    return docs.mapInArrow(made, "id long, mark long, n long, sig binary, seat long, bucket int, pid long, raw binary")


def met(made: DataFrame) -> DataFrame:
    """(key, seat, pivot) of all keys that more than one seat has; ``pivot`` is a lower seat of the key, or the seat itself."""

    def rows(key: np.ndarray, seat: np.ndarray, pivot: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (key, seat, pivot)], ["key", "seat", "pivot"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, []

        def done() -> pa.RecordBatch:
            key, seat = (np.concatenate(x) for x in zip(*parts))
            many = key & np.uint64(1) > 0
            key = key & ~np.uint64(1)
            order = np.lexsort((seat, key))
            key, seat, many = key[order], seat[order], many[order]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(begin, append=len(key))
            keep = np.repeat(size > 1, size) | many
            return rows(key[keep], seat[keep], np.repeat(seat[begin], size)[keep])

        for batch in batches:
            for bucket, pid, n, raw in zip(*(batch.column(c) for c in ("bucket", "pid", "n", "raw"))):
                if parts and bucket.as_py() != here:
                    yield done()
                    parts = []
                here = bucket.as_py()
                key, seat = tk.unpacked(raw.as_buffer(), n.as_py(), KEY_BYTES, SEAT_BYTES)
                parts.append((key, seat | np.uint64(pid.as_py() << 40)))
        if parts:
            yield done()

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, n, raw in zip(*(batch.column(c) for c in ("pid", "n", "raw"))):
                key, seat, pivot = tk.unpacked(raw.as_buffer(), n.as_py(), KEY_BYTES, SEAT_BYTES, SEAT_BYTES)
                base = np.uint64(pid.as_py() << 40)
                yield rows(key, seat | base, pivot | base)

    blocks = made.where("bucket >= 0").select("bucket", "pid", "n", "raw").repartition("bucket").sortWithinPartitions("bucket")
    local = made.where("bucket = -1").select("pid", "n", "raw")
    kind = "key long, seat long, pivot long"
    return blocks.mapInArrow(own, kind).union(local.mapInArrow(more, kind))


def small(df: DataFrame) -> DataFrame:
    """A written table with the hint that fits its size."""
    return F.broadcast(df) if scratch.at_most(df, BROADCAST_ROWS) else df


def texts(docs: DataFrame, facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text and the columns of ``wanted``) of one document for each row of ``wanted`` (seat, ...)."""
    one = facts.join(wanted, "seat").groupBy("seat").agg(F.min(F.struct("id", "mark")).alias("one"), *(F.first(c).alias(c) for c in wanted.columns if c != "seat"))
    found = scratch.written(one.select(F.col("one.id").alias("_id"), F.col("one.mark").alias("_mark"), *wanted.columns), "found")
    return docs.join(small(found), docs["id"].eqNullSafe(F.col("_id")) & (docs["mark"] == F.col("_mark"))).select("text", *wanted.columns)


def verified(pairs: DataFrame, facts: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of seats whose shingle sets reach the threshold, by exact intersection."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # of repeated rows one will do
        for batch in batches:
            seat, hubs = batch.column("seat").to_pylist(), batch.column("hubs")
            for first, all_own in shingled(batch.column("text"), n):
                out = []
                for i, own in enumerate(all_own, first):
                    if seat[i] not in done:
                        done.add(seat[i])
                        raw = own.tobytes()
                        out += [(h["hub"], h["salt"], seat[i], raw) for h in hubs[i].as_py()]
                for lo in range(0, len(out), 1024):
                    hub, salt, own_seat, raw = zip(*out[lo : lo + 1024])
                    yield pa.RecordBatch.from_arrays([pa.array(hub, pa.int64()), pa.array(salt, pa.int32()), pa.array(own_seat, pa.int64()), pa.array(raw, pa.binary())], ["hub", "salt", "seat", "own"])

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, x = None, None
        for batch in batches:
            a, b = [], []
            for hub, salt, seat, raw in zip(batch.column("hub").to_pylist(), batch.column("salt").to_pylist(), batch.column("seat").to_pylist(), batch.column("own")):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if seat == hub:
                    group, x = (hub, salt), own.copy()
                elif group == (hub, salt):
                    both = len(np.intersect1d(x, own, assume_unique=True))
                    if den * both >= num * (len(x) + len(own) - both):
                        a.append(hub)
                        b.append(seat)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    dealt = scratch.written(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")), "dealt")
    sent = dealt.select(F.col("b").alias("seat"), F.col("a").alias("hub"), "salt").union(dealt.select("a", "a", "salt").distinct())
    wanted = sent.groupBy("seat").agg(F.collect_list(F.struct("hub", "salt")).alias("hubs"))
    arrays = texts(docs, facts, wanted).mapInArrow(send, "hub long, salt int, seat long, own binary")
    order = F.col("seat") != F.col("hub")
    return arrays.repartition("hub", "salt").sortWithinPartitions("hub", "salt", order, "seat").mapInArrow(intersect, "a long, b long").distinct()


def signed(docs: DataFrame, facts: DataFrame, seats: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(seat, n, bits) of ``seats``: sizes and signatures."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            seat = batch.column("seat").to_pylist()
            for first, all_own in shingled(batch.column("text"), n):
                new = [(seat[i], own) for i, own in enumerate(all_own, first) if seat[i] not in done]
                done.update(s for s, _ in new)
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in new], pa.int64()), pa.array([len(x) for _, x in new], pa.int64()), pa.array([signature(x, num, den) for _, x in new], pa.binary())], ["seat", "n", "bits"])

    return texts(docs, facts, seats).mapInArrow(made, "seat long, n long, bits binary").dropDuplicates(["seat"])


def forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Places of the edges (a, b), given from the closest on, of a spanning forest of the closest."""
    up = np.arange(nodes)
    kept, live = [], np.arange(len(a))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    while True:
        la, lb = up[a[live]], up[b[live]]
        apart = la != lb
        live, la, lb = live[apart], la[apart], lb[apart]
        if not len(live):
            return np.array(sorted(kept), np.int64)
        _, first = np.unique(np.stack([la, lb], 1).ravel(), return_index=True)  # the closest edge of each component
        for e in live[np.unique(first // 2)].tolist():
            x, y = top(int(a[e])), top(int(b[e]))
            if x != y:
                up[max(x, y)] = min(x, y)
                kept.append(e)
        up = np.array([top(x) for x in range(nodes)])


def nearest(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], num: int, den: int, most: int) -> tuple[np.ndarray, bool]:
    """Pairs (seat, seat) of a tile that the bit counts can't rule out, and whether some are left over.

    ``left`` and ``right`` are (seat, root, n, bits, done); pairs that are together in a key
    that is ``done`` (a column each) are left out.  ``most`` 0: a spanning forest of the
    roots; else up to ``most`` pairs of each two roots.
    """
    found = []
    for lo in range(0, len(left[0]), 64):
        seat, root, size, bits, done = (x[lo : lo + 64] for x in left)
        differ = np.bitwise_count(bits[:, None, :] ^ right[3][None, :, :]).sum(-1, dtype=np.int64)
        ok = (differ * (den + num) <= (size[:, None] + right[2][None, :]) * (den - num)) & (root[:, None] != right[1][None, :])
        ok &= den * np.minimum(size[:, None], right[2][None, :]) >= num * np.maximum(size[:, None], right[2][None, :])
        if done.shape[1]:
            ok &= ~(done @ right[4].T > 0)
        i, j = np.nonzero(ok)
        found.append(np.stack([seat[i], right[0][j], root[i], right[1][j], differ[i, j]], 1))
    all_ = np.concatenate(found)
    turn = all_[:, 0] > all_[:, 1]
    all_[turn] = all_[turn][:, [1, 0, 3, 2, 4]]
    all_ = all_[np.lexsort((all_[:, 1], all_[:, 0], all_[:, 4]))]
    all_ = all_[np.sort(np.unique(all_[:, :2], axis=0, return_index=True)[1])]
    if not len(all_):
        return all_[:, :2], False
    roots, at = np.unique(all_[:, 2:4], return_inverse=True)
    a, b = at.reshape(-1, 2).T
    if not most:
        kept = forest(a, b, len(roots))
    else:
        both = np.minimum(a, b) * len(roots) + np.maximum(a, b)
        order = np.argsort(both, kind="stable")
        begin = np.flatnonzero(np.append(True, np.diff(both[order]) > 0))
        rank = np.arange(len(order)) - np.repeat(begin, np.diff(begin, append=len(order)))
        kept = order[rank < most]
    return all_[kept, :2], len(kept) < len(all_)


def together(done: list[list[int]]) -> np.ndarray:
    """A column for each key that two or more rows of a tile have among those ``done``."""
    key, at, many = np.unique(np.array([k for x in done for k in x], np.int64), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(done)), [len(x) for x in done])
    keep = many[at] > 1
    out = np.zeros((len(done), len(key)), np.float32)
    out[row[keep], at[keep]] = 1
    return out[:, many > 1]


def tiled(rows: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """(a, b, open) of ``rows`` (key, seat, root, n, bits, done): pairs that ``nearest`` gives; ``open`` names a key with pairs left over."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[tuple]) -> pa.RecordBatch:
            tile, side, seat, root, size = (np.concatenate(x) for x in list(zip(*parts))[:5])
            bits, past = ([x for p in parts for x in p[i]] for i in (5, 6))
            edge = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]).any(1)))
            pairs, still = [np.zeros((0, 2), np.int64)], []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(tile)]):
                cut = a + int(np.count_nonzero(side[a:b] == 0))
                if a < cut < b:
                    wide, both = folded(bits[a:b]), together(past[a:b])
                    got, more = nearest((seat[a:cut], root[a:cut], size[a:cut], wide[: cut - a], both[: cut - a]), (seat[cut:b], root[cut:b], size[cut:b], wide[cut - a :], both[cut - a :]), num, den, most)
                    pairs.append(got)
                    still += [int(tile[a, 0])] * more
            got = np.unique(np.concatenate(pairs), axis=0)
            none = pa.nulls(len(still), pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(got[:, 0]), none]), pa.concat_arrays([pa.array(got[:, 1]), none]), pa.concat_arrays([pa.nulls(len(got), pa.int64()), pa.array(still, pa.int64())])], ["a", "b", "open"])

        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            part = (tile, *(batch.column(c).to_numpy() for c in ("side", "seat", "root", "n")), batch.column("bits").to_pylist(), batch.column("done").to_pylist())
            whole = np.flatnonzero((tile != tile[-1]).any(1))  # what comes before the last tile, which may go on
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if held and ((tile[0] != held[-1][0][-1]).any() or cut):
                held.append(tuple(x[:cut] for x in part))
                yield done([x for x in held if len(x[0])])
                held = [tuple(x[cut:] for x in part)]
            elif cut:
                yield done([tuple(x[:cut] for x in part)])
                held = [tuple(x[cut:] for x in part)]
            else:
                held.append(part)
        if held:
            yield done(held)

    blocks = lambda c: F.ceil(F.col(c) / TILE).cast("long")
    by_root = rows.groupBy("key", "root").agg(F.count("*").alias("size"))
    sizes = by_root.groupBy("key").agg(F.max(F.struct("size", "root")).alias("big"), F.sum("size").alias("all"))
    sizes = sizes.select("key", F.col("big.root").alias("big"), (F.col("all") - F.col("big.size")).alias("others"), "all")
    sized = rows.join(sizes, "key").withColumn("lefts", blocks("others")).withColumn("rights", blocks("all"))
    into = lambda c: F.pmod(F.xxhash64("seat"), F.col(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = sized.where("root <> big").withColumn("i", into("lefts")).withColumn("j", each("rights")).withColumn("side", F.lit(0))
    right = sized.withColumn("j", into("rights")).withColumn("i", each("lefts")).withColumn("side", F.lit(1))
    dealt = left.unionByName(right).select("key", "i", "j", "side", "seat", "root", "n", "bits", "done")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(tiles, "a long, b long, open long")


def rooted(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """``rows`` (key, seat) with their roots and their key's ``size``, of keys that have several; of keys with the same seats one."""
    known = scratch.written(rows.select("key", "seat").join(small(tree), "seat", "left").select("key", "seat", F.coalesce("root", "seat").alias("root")), "rooted")
    mixed = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.xxhash64("seat") % (1 << 40)).alias("name"), F.sum(F.xxhash64("seat", F.lit(1)) % (1 << 40)).alias("more"), F.count("*").alias("size")).where("low <> high")
    one = mixed.groupBy("name", "more", "size").agg(F.min("key").alias("key")).select("key", "size")
    rest = scratch.written(known.join(one, "key"), "rest")
    scratch.drop(known)
    return rest


def named(rest: DataFrame, most: int) -> DataFrame:
    """The keys that some seat has among its ``most`` largest."""
    order = Window.partitionBy("seat").orderBy(F.desc("size"), "key")
    return rest.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).select("key").distinct()


def grown(tree: DataFrame, proven: DataFrame) -> DataFrame:
    """``tree`` (seat, root) after the links (a, b) of ``proven``."""
    of = small(tree)
    ends = proven.join(of.select(F.col("seat").alias("a"), F.col("root").alias("ra")), "a", "left").join(of.select(F.col("seat").alias("b"), F.col("root").alias("rb")), "b", "left")
    merged = links.components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    merged = scratch.written(merged.select(F.col("id").alias("root"), F.col("root").alias("top")), "merged")
    below = tree.join(small(merged), "root", "left").select("seat", F.coalesce("top", "root").alias("root"))
    return scratch.written(below.unionByName(merged.select(F.col("root").alias("seat"), F.col("top").alias("root"))).distinct(), "tree")


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, mark, first) of every row: texts with ``den * |A and B| >= num * |A or B|`` are linked.

    ``first`` is true for one text of each component, that with the smallest id (of
    several, the smallest ``mark``, a hash of the text).
    """
    spark = docs.sparkSession
    scratch.lean(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    buckets = 1 << max(4, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    made = scratch.written(sets(docs, n, num, den, buckets), "sets")
    facts = scratch.written(made.where("bucket IS NULL").select("id", "mark", "n", "sig", "seat"), "facts")
    seats = facts.where("seat IS NOT NULL").groupBy("sig").agg(F.min("seat").alias("rep"), F.max("seat").alias("last")).where("rep <> last").select("sig", "rep")
    classes = facts.select("sig", "seat").join(seats, "sig").where("seat <> rep").select("seat", "rep").distinct()
    classes = scratch.written(classes, "copies")
    of = small(classes)
    shared = met(made).join(of, "seat", "left_anti").join(of.withColumnsRenamed({"seat": "pivot", "rep": "other"}), "pivot", "left")
    shared = scratch.written(shared.select("key", "seat", F.coalesce("other", "pivot").alias("pivot")), "met")
    scratch.drop(made)
    scratch.release(spark)

    often = shared.where("seat <> pivot").groupBy("seat", "pivot").agg(F.count("*").alias("often"))
    stars = often.groupBy("seat").agg(F.max(F.struct("often", (-F.col("pivot")).alias("neg"))).alias("best")).select((-F.col("best.neg")).alias("a"), F.col("seat").alias("b"))
    proven = verified(scratch.written(stars, "stars"), facts, docs, n, num, den)
    tree = links.roots(scratch.written(proven.select(F.col("b").alias("id"), F.col("a").alias("parent")), "proven"))
    tree = scratch.written(tree.select(F.col("id").alias("seat"), "root"), "tree")

    rest = rooted(shared, tree)
    scratch.drop(shared)
    bits = past = None
    for step in itertools.count():
        left = rest.count()
        if not left:
            break
        if bits is None:
            bits = scratch.written(signed(docs, facts, rest.select("seat").distinct(), n, num, den), "bits")
            past = bits.select("seat", F.array().cast("array<bigint>").alias("done"))
        rows = rest.select("key", "seat", "root")
        if left > FEW and step < 2:
            rows = scratch.written(rows.join(named(rest, 16**step), "key", "left_semi"), "asked")
        told = scratch.written(tiled(rows.join(bits, "seat").join(past, "seat").select("key", "seat", "root", "n", "bits", "done"), num, den, 8**step if step else 0), "told")
        pairs = told.where("a IS NOT NULL").select("a", "b").distinct()
        if not pairs.isEmpty():
            proven = scratch.written(verified(pairs, facts, docs, n, num, den), "proven")
            if not proven.isEmpty():
                tree = grown(tree, proven)
        still = told.where("open IS NOT NULL").select(F.col("open").alias("key")).distinct()
        ended = scratch.written(rows.select("key", "seat").join(still, "key", "left_anti"), "ended")
        of_seat = past.select("seat", F.explode("done").alias("key")).union(ended.select("seat", "key")).groupBy("seat").agg(F.slice(F.sort_array(F.collect_set("key")), 1, PAST).alias("done"))
        past = scratch.written(bits.select("seat").join(of_seat, "seat", "left").select("seat", F.coalesce("done", F.array().cast("array<bigint>")).alias("done")), "past")
        rest = rooted(rest.join(ended.select("key").distinct(), "key", "left_anti"), tree)

    above = small(tree)
    top = classes.join(above.withColumnsRenamed({"seat": "rep", "root": "top"}), "rep", "left").select("seat", F.coalesce("top", "rep").alias("root"))
    tops = small(scratch.written(top.union(tree.select("seat", "root")), "tops"))
    lowest = facts.where("id IS NOT NULL AND seat IS NOT NULL").join(tops, "seat", "left").groupBy(F.coalesce("root", "seat").alias("root"))
    lowest = scratch.written(lowest.agg(F.min(F.struct("id", "mark")).alias("low"), F.count("*").alias("rows")).where("rows > 1").select("root", "low"), "lowest")
    out = facts.join(tops, "seat", "left").withColumn("root", F.coalesce("root", "seat")).join(small(lowest), "root", "left")
    alone: Column = F.col("low").isNull()
    return out.select(
        "id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("low.id", "id")).alias("component_id"),
        "mark",
        (alone | F.col("id").isNull() | ((F.col("id") == F.col("low.id")) & (F.col("mark") == F.col("low.mark")))).alias("first"),
    )
