"""Language-model scores from a log-frequency Bloom filter.

Training counts every word and every pair of neighbouring words of all training texts.
Tasks combine their counts, cut them by hash range and send each range, a shard, one
packed block of sorted keys and counts, so the exchange moves blocks, not rows.

The model is a Bloom filter over (n-gram, level): an n-gram seen c times, once included,
is entered at the levels 1 to ``level(c)``, and its count is read back by probing level
after level until one is missing.  Levels tell counts apart up to 7 and to within a
quarter octave above, so an estimate is right or off by at most an eighth.
Every shard has BITS_PER_ENTRY bits an entry at any size: in 0.5 % of cases an n-gram is
read a level too high (one never seen as seen once), never too low.  Beside it a shard
keeps the exact counts of its words, which the base score needs.

The filter grows with the corpus, so it is not broadcast: each block of texts sends its
distinct words and pairs to the tasks of their shards and gets levels and counts back.
The probability of a word w after v is

    lambda * f(v w) / c(v)  +  (1 - lambda) * (f(w) + 1) / (F + V + 1)

f being estimates read from the filter, F their sum over all words, c(v) the count of v
(to within 0.1 %); an unseen word's 1 / (F + V + 1) completes the sum over all words to 1
but for the errors stated.  f(v w) is at most f(w), and 0 after an unseen v.  Lambda is set by expectation
maximisation on all training texts, each count less one there (its own occurrence); a
table of how often each three levels occur stands for all tokens.

Defined results: a null text counts as empty and consists of its end alone; a null id
is trained on; repeated rows count as often as they stand there; without training
texts N, V and all counts are 0; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textkernel as tk

END = np.uint64(0x0E4D0E4D0E4D0E4D)
BITS_PER_ENTRY = 12
HASHES = 5
#: Bits of a pair's key inside its shard, which tell the pairs of a shard apart but for one in ten thousand; words have all 64.
PAIR_BITS = 32
COUNT_BYTES = 5
#: Levels are below this: enough for counts up to 2 ** 40.
LEVELS = 1 << 8
#: Steps an octave of a context's count.
FINE = 512
#: Tokens that a task counts before it sends them.
FLUSH = 2_500_000
#: Bytes of text that ask the filter together; a batch of rows has half as many.
ASK_BYTES = 1 << 24
#: Shards whose filters a task holds together: as many as have so many bytes; but up to LEAST_ROUTES tasks they have one each.
ROUTE_BYTES, LEAST_ROUTES = 1 << 25, 256


def chain(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a block, an end after each text, and where each text's begin (n + 1)."""
    hashes, cut, _ = tk.words(data, at)
    texts = len(at) - 1
    ends = cut[1:] + np.arange(texts)
    out = np.empty(len(hashes) + texts, np.uint64)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = hashes, END
    return out, np.append(0, ends + 1)


def pairs(tokens: np.ndarray, cut: np.ndarray, bits: int) -> np.ndarray:
    """A key of ``bits`` bits for each token with the one before it; the first of a text follows an end."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[cut[:-1]] = END
    return tk.mix(before * np.uint64(0xD6E8FEB86659FD93) + tk.mix(tokens + np.uint64(0x1234567))) >> np.uint64(64 - bits)


def gaps(key: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, which pack smaller; ``np.cumsum`` gives them back."""
    return np.diff(key, prepend=np.uint64(0))


def level(count: np.ndarray) -> np.ndarray:
    """The level of each count: itself up to 7, then four an octave."""
    count = np.asarray(count, np.int64)
    octave = np.frexp(np.maximum(count, 8).astype(float))[1] - 1
    return np.where(count < 8, count, 8 + 4 * (octave - 3) + ((count >> np.maximum(octave - 2, 0)) & 3))


def count_at(level_: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for none."""
    level_ = np.asarray(level_, np.int64)
    octave, step = 3 + (np.maximum(level_, 8) - 8) // 4, (np.maximum(level_, 8) - 8) % 4
    width = np.exp2(octave - 2.0)
    return np.where(level_ < 8, level_, (4 + step) * width + (width - 1) / 2)


def spots(mixed: np.ndarray, level_: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where the bits of (key, level) begin, and their step, as 32-bit numbers; ``mixed`` are the keys' ``tk.mix``."""
    h = (mixed ^ np.asarray(level_, np.uint64) * np.uint64(0xA0761D6478BD642F)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(32)).astype(np.uint32), (h ^ h >> np.uint64(29)).astype(np.uint32) | np.uint32(1)


def spot(first: np.ndarray, step: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th bit, in a filter of ``bits`` bits."""
    return ((first + np.uint32(i) * step).astype(np.uint64) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


class Filter:
    """A log-frequency Bloom filter: ``levels`` reads back how high each key was entered."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw

    @classmethod
    def of(cls, key: np.ndarray, top: np.ndarray) -> Filter:
        """With each key entered at the levels from 1 to its ``top``."""
        entries = int(top.sum())
        flags = np.zeros(-(-max(64, BITS_PER_ENTRY * entries) // 64) * 64, bool)
        for lo in range(0, len(key), 1 << 18):
            k, t = key[lo : lo + (1 << 18)], top[lo : lo + (1 << 18)]
            row = np.repeat(np.arange(len(k)), t)
            lev = np.arange(len(row)) - np.repeat(np.cumsum(t) - t, t) + 1
            first, step = spots(tk.mix(k)[row], lev)
            for i in range(HASHES):
                flags[spot(first, step, i, len(flags))] = True
        return cls(np.packbits(flags, bitorder="little"))

    def levels(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.uint8)
        live, mixed, at = np.arange(len(key)), tk.mix(key), 1
        while len(live) and at < LEVELS:
            first, step = spots(mixed, at)
            for i in range(HASHES):  # most are gone after two
                place = spot(first, step, i, 8 * len(self.raw))
                there = (self.raw[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
                if not there.all():
                    live, mixed, first, step = live[there], mixed[there], first[there], step[there]
            out[live] = at
            at += 1
        return out


@dataclass
class Model:
    """``shards``: a written table (shard, words, n_words, filter, tokens, mass), 2 ** ``shard_bits`` rows at most; N, V and F."""

    shards: DataFrame
    shard_bits: int
    n: int
    v: int
    mass: float
    bytes: int

    @property
    def pair_bits(self) -> int:
        return self.shard_bits + PAIR_BITS


def train(docs: DataFrame) -> Model:
    """The model of the texts of ``docs`` (text)."""
    spark = docs.sparkSession
    shard_bits = max(4, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    pair_bits = shard_bits + PAIR_BITS
    bits, width = (64, pair_bits), (8, -(-pair_bits // 8))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                key, c = np.unique(np.concatenate(held[kind]), return_counts=True)
                held[kind].clear()
                shard, first = np.unique(key >> np.uint64(bits[kind] - shard_bits), return_index=True)
                spans = list(zip(first.tolist(), [*first[1:].tolist(), len(key)]))
                raw = [tk.packed((gaps(key[a:b]), width[kind]), (c[a:b], COUNT_BYTES)) for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array([kind] * len(spans), pa.int32()), pa.array([b - a for a, b in spans], pa.int32()), pa.array(raw, pa.binary())], ["shard", "kind", "n", "raw"])

        n = 0
        for batch in batches:
            for _, _, data, at in tk.blocks(batch.column("text")):
                tokens, cut = chain(data, at)
                held[0].append(tokens)
                held[1].append(pairs(tokens, cut, pair_bits))
                n += len(tokens)
                if n > FLUSH:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, ([], [])

        def total(kind: int) -> tuple[np.ndarray, np.ndarray]:
            if not parts[kind]:
                return np.zeros(0, np.uint64), np.zeros(0, np.int64)
            key, c = (np.concatenate(x) for x in zip(*parts[kind]))
            order = np.argsort(key, kind="stable")
            key, c = key[order], c[order].astype(np.int64)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            return key[first], np.add.reduceat(c, first)

        def done() -> pa.RecordBatch:
            (word, c), (pair, often) = total(0), total(1)
            made = Filter.of(np.append(word, pair), level(np.append(c, often)))
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([here], pa.int32()), "words": [tk.packed((word, 8), (c, COUNT_BYTES))], "n_words": [len(word)], "filter": [made.raw.tobytes()], "tokens": [int(c.sum())], "mass": [float(count_at(level(c)).sum())]}
            )

        for batch in batches:
            for shard, kind, n, raw in zip(*(batch.column(x) for x in ("shard", "kind", "n", "raw"))):
                if shard.as_py() != here:
                    if here is not None:
                        yield done()
                    here, parts = shard.as_py(), ([], [])
                key, c = tk.unpacked(raw.as_buffer(), n.as_py(), width[kind.as_py()], COUNT_BYTES)
                parts[kind.as_py()].append((np.cumsum(key), c))
        if here is not None:
            yield done()

    sent = docs.select("text").mapInArrow(combine, "shard int, kind int, n int, raw binary").repartition("shard").sortWithinPartitions("shard", "kind")
    made = scratch.written(sent.mapInArrow(shards, "shard int, words binary, n_words long, filter binary, tokens long, mass double"), "filter")
    told = made.agg(F.sum("tokens").alias("n"), F.sum("n_words").alias("v"), F.sum("mass").alias("mass"), F.sum(F.octet_length("filter").cast("long")).alias("bytes")).first()
    return Model(made, shard_bits, told["n"] or 0, told["v"] or 0, told["mass"] or 0.0, told["bytes"] or 0)


def blocked(rows: DataFrame) -> DataFrame:
    """``rows`` (id, held_out, text), a block of texts a row: (block, id, held_out, n_words, words, cut, index), ``index`` the place of each token in ``words``.

    ``words`` are in the order of their frequency, which makes the index small.
    """
    from pyspark import TaskContext

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, after, data, at in tk.blocks(batch.column("text"), ASK_BYTES):
                tokens, cut = chain(data, at)
                words, index, often = np.unique(tokens, return_inverse=True, return_counts=True)
                order = np.argsort(-often, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                whole = pa.array([0, after - first], pa.int32())
                listed = [pa.ListArray.from_arrays(whole, batch.column(c)[first:after]) for c in ("id", "held_out")]
                raw = [tk.packed((words[order], 8)), tk.packed((cut, 8)), tk.packed((place[index], 4))]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *listed, pa.array([len(words)]), *(pa.array([x], pa.binary()) for x in raw)], ["block", "id", "held_out", "n_words", "words", "cut", "index"])
                block += 1

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(pack, f"block long, id array<{kind}>, held_out array<boolean>, n_words long, words binary, cut binary, index binary")


def opened(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, cut, index) of a row of ``blocked``."""
    (words,) = tk.unpacked(block["words"].as_buffer(), block["n_words"].as_py(), 8)
    (cut,) = tk.unpacked(block["cut"].as_buffer(), len(block["id"]) + 1, 8)
    cut = cut.astype(np.int64)
    (index,) = tk.unpacked(block["index"].as_buffer(), int(cut[-1]), 4)
    return words, cut, index.astype(np.int64)


def answered(blocks: DataFrame, model: Model) -> DataFrame:
    """(block, route, n_words, words, n_pairs, pairs): level and count of a block's distinct words, and the level of its pairs, in the order of their keys, cut by route."""
    routes = 1 << min(model.shard_bits, max(LEAST_ROUTES.bit_length() - 1, (model.bytes // ROUTE_BYTES).bit_length()))
    route_bits, shard_bits, pair_bits = routes.bit_length() - 1, model.shard_bits, model.pair_bits
    pair_bytes = -(-pair_bits // 8)
    high = lambda key, bits, most: (key >> np.uint64(bits - most)).astype(np.int64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = {c: batch.column(c)[i] for c in batch.schema.names}
                words, cut, index = opened(block)
                pair = np.unique(pairs(words[index], cut, pair_bits))
                words = np.sort(words)
                ends = [np.searchsorted(high(key, bits, route_bits), np.arange(routes + 1)).tolist() for key, bits in ((words, 64), (pair, pair_bits))]
                use = [r for r in range(routes) if ends[0][r] < ends[0][r + 1] or ends[1][r] < ends[1][r + 1]]
                sizes = [pa.array([e[r + 1] - e[r] for r in use], pa.int64()) for e in ends]
                raw = [pa.array([tk.packed((gaps(key[e[r] : e[r + 1]]), width)) for r in use], pa.binary()) for key, width, e in ((words, 8, ends[0]), (pair, pair_bytes, ends[1]))]
                yield pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), pa.array([block["block"].as_py()] * len(use), pa.int64()), sizes[0], raw[0], sizes[1], raw[1]], ["route", "block", "n_words", "words", "n_pairs", "pairs"])

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known = -1, {}

        def read(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
            shard, got, count = high(key, bits, shard_bits), np.zeros(len(key), np.uint8), np.zeros(len(key), np.int64)
            for s in np.unique(shard).tolist():
                if s in known:
                    word, c, filter_ = known[s]
                    at = np.flatnonzero(shard == s)
                    got[at] = filter_.levels(key[at])
                    if bits == 64 and len(word):
                        place = np.minimum(np.searchsorted(word, key[at]), len(word) - 1)
                        count[at] = np.where(word[place] == key[at], c[place], 0)
            return got, count

        for batch in batches:
            route, block, n_words, n_pairs = (batch.column(c).to_pylist() for c in ("route", "block", "n_words", "n_pairs"))
            words, pair = batch.column("words"), batch.column("pairs")
            i = 0
            while i < len(route):
                if route[i] != here:
                    here, known = route[i], {}
                if block[i] < 0:  # a shard of the route: its words, and its filter in the place of pairs
                    word, c = tk.unpacked(words[i].as_buffer(), n_words[i], 8, COUNT_BYTES)
                    known[-1 - block[i]] = word, c.astype(np.int64), Filter(np.frombuffer(pair[i].as_buffer(), np.uint8).copy())
                    i += 1
                    continue
                first, size = i, 0
                while i < len(route) and route[i] == here and size < 1 << 18:
                    size += n_words[i] + n_pairs[i]
                    i += 1
                rows = range(first, i)
                own = np.concatenate([np.cumsum(tk.unpacked(words[r].as_buffer(), n_words[r], 8)[0]) for r in rows])
                both = np.concatenate([np.cumsum(tk.unpacked(pair[r].as_buffer(), n_pairs[r], pair_bytes)[0]) for r in rows])
                word_level, count = read(own, 64)
                pair_level, _ = read(both, pair_bits)
                w, p = np.cumsum([0, *(n_words[r] for r in rows)]).tolist(), np.cumsum([0, *(n_pairs[r] for r in rows)]).tolist()
                raw = [tk.packed((word_level[a:b], 1), (count[a:b], COUNT_BYTES)) for a, b in zip(w, w[1:])]
                raw_pairs = [tk.packed((pair_level[a:b], 1)) for a, b in zip(p, p[1:])]
                part = slice(first, i)
                yield pa.RecordBatch.from_arrays([pa.array(block[part], pa.int64()), pa.array(route[part], pa.int32()), pa.array(n_words[part], pa.int64()), pa.array(raw, pa.binary()), pa.array(n_pairs[part], pa.int64()), pa.array(raw_pairs, pa.binary())], ["block", "route", "n_words", "words", "n_pairs", "pairs"])

    asked = blocks.select("block", "id", "n_words", "words", "cut", "index").mapInArrow(ask, "route int, block long, n_words long, words binary, n_pairs long, pairs binary")
    route = F.floor(F.col("shard") / (1 << (shard_bits - route_bits))).cast("int").alias("route")
    parts = model.shards.select(route, (-1 - F.col("shard")).cast("long").alias("block"), "n_words", "words", F.lit(0).cast("long").alias("n_pairs"), F.col("filter").alias("pairs"))
    return parts.union(asked).repartition("route").sortWithinPartitions("route", "block").mapInArrow(reply, "block long, route int, n_words long, words binary, n_pairs long, pairs binary")


def coded(both: np.ndarray, own: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One number for a token: the levels of its pair and of itself, and the count before it where the pair is known."""
    both = np.where(before > 0, both, 0)
    fine = np.where(both > 0, np.round(FINE * np.log2(np.maximum(before, 1))) + 1, 0).astype(np.int64)
    return ((fine * LEVELS + both) * LEVELS + own).astype(np.int32)


def likelihood(code: np.ndarray, mass: float, v: int, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(pair estimate, word estimate) of tokens by their code; ``less`` is taken off every count."""
    code = np.asarray(code, np.int64)
    own, both, fine = count_at(code % LEVELS), count_at(code // LEVELS % LEVELS), code // LEVELS**2
    before = np.where(fine > 0, np.exp2((fine - 1) / FINE), 0.0)
    two = np.maximum(np.minimum(both, own) - less, 0) / np.maximum(before - less, 1)
    one = (np.maximum(own - less, 0) + 1) / (mass + v + 1)
    return np.minimum(two, 1), one


def mixture(learned: DataFrame, mass: float, v: int) -> float:
    """Lambda by expectation maximisation over ``learned`` (codes, often), each count less the token's own."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            c = batch.column("codes").flatten().to_numpy().astype(np.int64)
            fine = c // LEVELS**2
            c = np.where(fine > 0, ((fine - 1) // (FINE // 4) * (FINE // 4) + FINE // 8 + 1) * LEVELS**2 + c % LEVELS**2, c)  # contexts to a quarter octave
            code, at = np.unique(np.append(code, c), return_inverse=True)
            n = np.bincount(at, np.append(n, batch.column("often").flatten().to_numpy()), len(code)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    found = learned.select("codes", "often").mapInArrow(tally, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()  # three numbers below 160: some 100,000 rows at any size
    if not len(found):
        return 0.0
    two, one = likelihood(found.column("code").to_numpy(), mass, v, less=1)
    often = found.column("n").to_numpy()
    share = 0.3
    for _ in range(30):
        share = float(np.average(share * two / (share * two + (1 - share) * one), weights=often))
    return share


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; texts not held out are learned from."""
    spark = docs.sparkSession
    scratch.lean(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = train(rows.where("NOT held_out"))
    n, v, mass, pair_bits = model.n, model.v, model.mass, model.pair_bits
    scratch.release(spark)

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block and the answers to it: what its texts' tokens are."""
        block = {c: left.column(c)[0] for c in left.column_names}
        words, cut, index = opened(block)
        parts = sorted(zip(*(right.column(c).to_pylist() for c in ("route", "n_words", "words", "n_pairs", "pairs"))))
        answers = [tk.unpacked(raw, size, 1, COUNT_BYTES) for _, size, raw, _, _ in parts]
        word_level, count = (np.concatenate(x).astype(np.int64) for x in zip(*answers))
        pair_level = np.concatenate([tk.unpacked(raw, size, 1)[0] for *_, size, raw in parts]).astype(np.int64)
        order = np.argsort(words)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        index_sorted = place[index]
        pair, at = np.unique(pairs(words[index], cut, pair_bits), return_inverse=True)
        if len(word_level) != len(words) or len(pair_level) != len(pair):
            raise RuntimeError("answers to a block are missing")
        own, exact = word_level[index_sorted], count[index_sorted]
        before = np.empty_like(exact)
        before[1:] = exact[:-1]
        before[cut[:-1]] = exact[cut[1:] - 1]  # an end
        code = coded(pair_level[at], own, before)
        texts, size = len(cut) - 1, np.diff(cut)
        text = np.repeat(np.arange(texts), size)
        by = np.lexsort((code, text))
        new = np.flatnonzero(np.append(True, (np.diff(text[by]) > 0) | (np.diff(code[by]) != 0)))
        ends = np.searchsorted(text[by][new], np.arange(texts + 1)).astype(np.int32)
        often = np.diff(new, append=len(by)).astype(np.int32)
        known = np.add.reduceat((exact > 0).astype(np.int64), cut[:-1])
        base = np.add.reduceat(np.log10(exact + 1.0), cut[:-1])
        return pa.Table.from_arrays(
            [block["id"].values, block["held_out"].values, pa.array(size), pa.array(known), pa.array(base), pa.ListArray.from_arrays(ends, pa.array(code[by][new])), pa.ListArray.from_arrays(ends, pa.array(often))], ["id", "held_out", "n_tokens", "n_known", "base", "codes", "often"]
        )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, often = batch.column("codes").flatten().to_numpy(), batch.column("often").flatten().to_numpy()
            two, one = likelihood(code, mass, v)
            ends = np.cumsum([0, *pc.list_value_length(batch.column("codes")).to_pylist()])
            each = np.log10(share * two + (1 - share) * one) * often
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.add.reduceat(each, ends[:-1]) if len(code) else np.zeros(0))], [*batch.schema.names[:5], "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    blocks = scratch.bucketed(blocked(rows), "blocks", "block", int(spark.conf.get("spark.sql.shuffle.partitions")))  # which stay where they are
    same = f"id {kind}, held_out boolean, n_tokens long, n_known long, base double"
    met = blocks.groupBy("block").cogroup(answered(blocks, model).groupBy("block")).applyInArrow(read, f"{same}, codes array<int>, often array<int>")
    done = scratch.written(met, "scored")
    scratch.drop(blocks, model.shards)
    scratch.release(spark)
    share = mixture(done.where("NOT held_out"), mass, v)
    out = done.mapInArrow(score, f"{same}, score double")
    base = F.col("base") - F.col("n_tokens") * float(np.log10(n + v + 1))
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
