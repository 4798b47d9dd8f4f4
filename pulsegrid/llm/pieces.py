"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

A document up to GIANT characters is encoded by the library.  A longer one is cut into
chunks at fixed places, wherever these fall, and every chunk is a task's row:

1. The state at a boundary is the piece that covers the character before it; the
   possible states are few, and the text on both sides shows them all.
2. A chunk yields a transfer matrix over (max, +): the best score of a path from each
   state at its left to each state at its right.
3. The matrices of a document are combined associatively into the one state at each
   boundary that the best whole path goes through.
4. Every chunk, now between two known states, is backtraced on its own.

Unigram models score a path by the sum of its pieces' scores.  For BPE models the scan
runs over {0, -inf}: a sequence of pieces is what merging gives if and only if merging
each two neighbours alone gives these two (a piece may follow another or not), so 0
marks the one valid path, and a matrix entry is one bit.

Defined results: a null text counts as empty and has no pieces; repeated rows are
encoded each; texts come back from ``decode`` as they were normalised; columns other
than id and text are not read.  Models with normalisation tables or user-defined pieces
are left to the library at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, tokens

#: Texts longer than this are scanned in parallel.  The library takes some 30 ms for as much, the scan of a chunk ten times as long a character: below, a text's own time never holds a job up.
GIANT = 65_536
CHUNK = 16_384
#: A chunk takes a task 0.2 s.
CHUNKS_A_TASK = 4
REMEMBERED = 1_000_000
#: Fixed value: what an unknown character costs below the lowest score in a unigram model.
UNKNOWN = 10.0
State = tuple[int, int]


class Model:
    """A model file: the library's processor, and the tables that the scan needs."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        normal = proto.normalizer_spec
        self.bpe = proto.trainer_spec.model_type == 2
        self.plain = proto.trainer_spec.model_type in (1, 2) and not normal.precompiled_charsmap and not normal.remove_extra_whitespaces and normal.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix and all(p.type not in (4, 5) for p in proto.pieces)
        self.prefix = "▁" if normal.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.lowest = min(self.score.values()) - UNKNOWN
        self.longest = max(map(len, self.score))
        self.known: dict[tuple[str, str], bool] = {}

    def normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", "▁") if text else ""

    def merged(self, text: str) -> list[str]:
        """What BPE merging makes of a short string."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, left: str, right: str) -> bool:
        if not self.bpe:
            return True
        got = self.known.get((left, right))
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[left, right] = left + right not in self.score and self.merged(left + right) == [left, right]
        return got

    def from_(self, text: str, at: int) -> list[int]:
        """Ends of the pieces of ``text`` that start at ``at``; a character alone always counts."""
        last = min(self.longest, len(text) - at)
        return [at + 1, *(at + n for n in range(2, last + 1) if text[at : at + n] in self.score)]

    def weight(self, piece: str) -> float:
        return 0.0 if self.bpe else self.score.get(piece, self.lowest)

    def named(self, pieces: list[str]) -> list[int]:
        out = []
        for piece in pieces:
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return out


def states(model: Model, text: str, at: int) -> list[State]:
    """The pieces (start, end) of ``text`` that cover the character before ``at``."""
    found = []
    for start in range(max(0, at - model.longest), at):
        found += [(start, end) for end in model.from_(text, start) if end >= at]
    return found


def forward(model: Model, text: str, entering: list[State], to: int) -> dict[State, np.ndarray]:
    """Best scores of paths from each state of ``entering`` to each piece that ends before ``to`` or covers the character before it.

    A state's own piece scores 0; (n, n) stands for the start of a text.
    """
    lanes = len(entering)
    ending: dict[int, list[tuple[State, np.ndarray]]] = {}
    for lane, state in enumerate(entering):
        row = np.full(lanes, -np.inf)
        row[lane] = 0.0
        ending.setdefault(state[1], []).append((state, row))
    out: dict[State, np.ndarray] = {s: r for here in ending.values() for s, r in here}
    for at in range(min(ending, default=to), to):
        here = ending.pop(at, None)
        if not here:
            continue
        lefts = [(text[s:e], row) for (s, e), row in here]
        if not model.bpe:
            lefts = [("", np.max([row for _, row in lefts], 0))]
        for end in model.from_(text, at):
            piece = text[at:end]
            rows = [row for left, row in lefts if left == "" or model.follows(left, piece)]
            if rows:
                total = (rows[0] if len(rows) == 1 else np.max(rows, 0)) + model.weight(piece)
                out[at, end] = total
                ending.setdefault(end, []).append(((at, end), total))
    return out


def transfer(model: Model, text: str, entering: list[State], to: int) -> tuple[list[State], np.ndarray]:
    """(states at ``to``, matrix): the chunk's best scores from each entering state to each of these."""
    got = forward(model, text, entering, to)
    leaving = states(model, text, to)
    none = np.full(len(entering), -np.inf)
    return leaving, np.stack([got.get(s, none) for s in leaving], 1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product over (max, +)."""
    return np.max(a[:, :, None] + b[None, :, :], 1)


def chosen(matrices: list[np.ndarray]) -> list[int]:
    """The state at each boundary, from the first to the last, on the best path through ``matrices``.

    Products of halves are associative: a tree of them gives the best end, and going
    back down it the state between every two halves.
    """

    def tree(lo: int, hi: int):
        if hi - lo == 1:
            return matrices[lo], None
        mid = (lo + hi) // 2
        left, right = tree(lo, mid), tree(mid, hi)
        return product(left[0], right[0]), (mid, left, right)

    out = [0] * (len(matrices) + 1)

    def down(node, lo: int, hi: int) -> None:
        if node[1] is None:
            return
        mid, left, right = node[1]
        out[mid] = int(np.argmax(left[0][out[lo]] + right[0][:, out[hi]]))
        down(left, lo, mid)
        down(right, mid, hi)

    whole = tree(0, len(matrices))
    out[-1] = int(np.argmax(whole[0][0]))
    down(whole, 0, len(matrices))
    return out


def backtrace(model: Model, text: str, entering: State, leaving: State, to: int) -> list[str]:
    """The pieces after ``entering`` up to ``leaving``, on the best path between them."""
    got = forward(model, text, [entering], to)
    ends: dict[int, list[State]] = {}
    for s in got:
        if s[0] < s[1]:
            ends.setdefault(s[1], []).append(s)
    out, at = [], leaving
    while at != entering:
        out.append(text[at[0] : at[1]])
        need = got[at][0] - model.weight(out[-1])
        if at[0] == entering[1] and (entering[0] == entering[1] or model.follows(text[entering[0] : entering[1]], out[-1])):
            at = entering
            continue
        before = [s for s in ends.get(at[0], []) if model.follows(text[s[0] : s[1]], out[-1])]
        at = min(before, key=lambda s: abs(got[s][0] - need))
    return out[::-1]


def slices(model: Model, text: str, chunk: int) -> list[tuple[int, int, int, str]]:
    """(number, left end in the slice, right end in the slice, slice) of a normalised text; slices overlap by the longest piece."""
    cuts = [*range(0, max(1, len(text) - model.longest), chunk), len(text)]
    halo = model.longest
    out = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        lo, hi = max(0, a - halo), min(len(text), b + halo)
        out.append((i, a - lo, b - lo, text[lo:hi]))
    return out


def entering(model: Model, text: str, left: int) -> list[State]:
    return states(model, text, left) if left else [(0, 0)]


def scan(model: Model, text: str, chunk: int = CHUNK) -> list[int]:
    """Ids of one text by the scan, all steps in place (the operator runs them as tasks)."""
    parts = slices(model, model.normal(text), chunk)
    if not text:
        return []
    sides = [(entering(model, s, a), *transfer(model, s, entering(model, s, a), b)) for _, a, b, s in parts]
    last = sides[-1]
    stop = np.where(np.array([e == parts[-1][2] for _, e in last[1]]), 0.0, -np.inf)
    sides[-1] = (last[0], last[1], last[2] + stop)
    at = chosen([m for *_, m in sides])
    out: list[int] = []
    for (_, _, b, s), (enter, leave, _), i, j in zip(parts, sides, at, at[1:]):
        out += model.named(backtrace(model, s, enter[i], leave[j], b))
    return out


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", giant: int | None = None, chunk: int | None = None) -> DataFrame:
    """(row, id, n_chunks, ids) of every row: the ids of its whole text, as little-endian unsigned 32-bit numbers.

    ``giant`` and ``chunk``: characters from which on a text is scanned, and of a chunk (GIANT, CHUNK).
    """
    scratch.lean(docs.sparkSession)
    giant, chunk = GIANT if giant is None else giant, CHUNK if chunk is None else chunk
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ordinary texts with their ids; of giant ones, their slices."""
        model, row = tokens.held(Model, path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, texts in tokens.runs(batch.column("text"), 1 << 20):
                out = []
                big = [len(t) > giant and model.plain for t in texts]
                small = iter(model.library.encode([t for t, b in zip(texts, big) if not b], num_threads=1))
                for n, (id_, text, b) in enumerate(zip(batch.column("id")[lo:hi].to_pylist(), texts, big)):
                    if b:
                        parts = slices(model, model.normal(text), chunk)
                        out += [(row + n, id_, len(parts), i, a, z, s, None) for i, a, z, s in parts]
                    else:
                        out.append((row + n, id_, 1, 0, 0, 0, None, np.array(next(small), "<u4").tobytes()))
                row += len(texts)
                yield pa.RecordBatch.from_pylist([dict(zip(cut.names, x)) for x in out], cut)

    cut = pa.schema([("row", pa.int64()), ("id", _arrow(docs, id_col)), ("n_chunks", pa.int32()), ("number", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("slice", pa.string()), ("ids", pa.binary())])
    made = scratch.written(rows.mapInArrow(first, f"row long, id {kind}, n_chunks int, number int, left int, right int, slice string, ids binary"), "pieces")
    cut_up = made.where("slice IS NOT NULL").select("row", "number", "left", "right", "slice")
    tasks = max(1, -(-cut_up.count() // CHUNKS_A_TASK))  # given as a number, else chunks are merged into few tasks, being small
    chunks = cut_up.repartition(tasks, "row", "number")

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens.held(Model, path)
        for batch in batches:
            for r in batch.to_pylist():
                _, m = transfer(model, r["slice"], entering(model, r["slice"], r["left"]), r["right"])
                stop = np.array([e == r["right"] for _, e in states(model, r["slice"], r["right"])])
                yield pa.RecordBatch.from_pydict({"row": [r["row"]], "number": pa.array([r["number"]], pa.int32()), "m": [m.tobytes()], "lanes": pa.array([len(m)], pa.int32()), "stop": [stop.tobytes()]})

    def combine(pdf):
        import pandas as pd

        pdf = pdf.sort_values("number")
        parts = [np.frombuffer(m).reshape(n, -1) for m, n in zip(pdf["m"], pdf["lanes"])]
        parts[-1] = parts[-1] + np.where(np.frombuffer(pdf["stop"].iloc[-1], bool), 0.0, -np.inf)
        at = chosen(parts)
        return pd.DataFrame({"row": pdf["row"], "number": pdf["number"], "enter": at[:-1], "leave": at[1:]})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens.held(Model, path)
        for batch in batches:
            for r in batch.to_pylist():
                s, to = r["slice"], r["right"]
                got = backtrace(model, s, entering(model, s, r["left"])[r["enter"]], states(model, s, to)[r["leave"]], to)
                yield pa.RecordBatch.from_pydict({"row": [r["row"]], "number": pa.array([r["number"]], pa.int32()), "ids": [np.array(model.named(got), "<u4").tobytes()]})

    matrices = scratch.written(chunks.mapInArrow(matrix, "row long, number int, m binary, lanes int, stop binary"), "matrices")
    ways = matrices.groupBy("row").applyInPandas(combine, "row long, number int, enter int, leave int")
    known = cut_up.join(scratch.written(ways, "ways"), ["row", "number"]).select("row", "number", "left", "right", "slice", "enter", "leave")
    traced = known.repartition(tasks, "row", "number").mapInArrow(trace, "row long, number int, ids binary")
    whole = traced.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("number", "ids"))).alias("x"))
    whole = whole.select("row", F.unhex(F.array_join(F.transform("x", lambda x: F.hex(x["ids"])), "")).alias("ids"))  # joined at once: a fold would copy all before for each chunk
    giants = made.where("slice IS NOT NULL AND number = 0").select("row", "id", "n_chunks").join(whole, "row")
    return made.where("slice IS NULL").select("row", "id", "n_chunks", "ids").unionByName(giants)


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """``encoded`` with the texts that its ids stand for."""
    from pyspark.sql import types as T

    schema = T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens.held(Model, path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [np.frombuffer(x.as_buffer(), "<u4").tolist() if x.is_valid else [] for x in part.column(ids_col)]
                texts = model.library.decode(ids, num_threads=1) if ids else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return encoded.mapInArrow(decoded, schema)
