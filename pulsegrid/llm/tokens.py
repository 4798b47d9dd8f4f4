"""Token counts and ids of whole texts, without encoding whole texts.

Both tokenizers cut a text into pre-tokens that encode independently of each
other.  So a text is cut here, by the same pattern, and each distinct pre-token
is looked up:

* the whole-token shortcut: offline, every vocabulary string that encodes alone
  as one token is proven to do so, by encoding it; a pre-token among them counts
  as one without any merging;
* all other pre-tokens are merged by the library, many at a time, and remembered
  in a table of bounded size that is emptied when full.

The pattern is followed only where it is proven to agree with the library, code
point by code point (``tests/llm``): texts of code points below U+0180 (but U+0130) and common
punctuation.  Texts with other code points, or with a special token's string, are
encoded whole by the library.

Defined results: null counts as empty and has no tokens; ties and repeated rows
count alike; other columns of the table are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textkernel as tk

REMEMBERED = 400_000
JOINED = 256
_L = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_N = "0-9²³¹¼-¾"
_S = "\\t-\\r \u0085 "
#: Anything but code points on which the patterns below were proven.
UNPROVEN = re.compile("[^\\x00-įı-ſ‐-‧‰-›€™]")
#: The patterns of the two tokenizers, their classes spelled out for the proven code points.
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
BYTE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_LETTERS = frozenset(filter(re.compile(f"[{_L}]").fullmatch, map(chr, range(0x180))))

def _library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if ("library", path) not in tk.KEPT:
        from tokenizers import Tokenizer

        tk.KEPT["library", path] = Tokenizer.from_file(path)
    return tk.KEPT["library", path]


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def whole_tokens(path: str) -> list[str]:
    """The vocabulary strings that, encoded alone, are proven to give their one token."""
    library, back = _library(path), _byte_chars()
    texts = {}
    for piece, token in library.get_vocab(with_added_tokens=False).items():
        try:
            texts[token] = bytes(back[c] for c in piece.removesuffix("</w>")).decode()
        except (KeyError, UnicodeDecodeError):
            continue
    found = library.encode_batch([*texts.values()], add_special_tokens=False)
    return sorted({text for text, one in zip(texts.values(), found) if len(one.ids) == 1 and WORD.fullmatch(text.lower()) and text == text.lower()})


class Remembering:
    """A table ``known`` of pre-tokens, of bounded size: when it is full, those met in one batch of texts only go."""

    known: dict
    lasting: dict = {}

    def __init__(self):
        self.again: set[str] = set()

    def unknown(self, met: set[str]) -> list[str]:
        """Those of the pre-tokens ``met`` in a batch of texts that are not known; there is room for them then."""
        unknown = met.difference(self.known)
        self.again.update(met.difference(unknown))
        if len(self.known) + len(unknown) > REMEMBERED + len(self.lasting):
            kept = self.again | met if len(self.again) < REMEMBERED // 2 else met
            self.known = self.lasting | {p: self.known[p] for p in kept if p in self.known}
            self.again = set()
        return [*unknown]


class Counter(Remembering):
    """Token counts by ``word_bpe``-like files: lower case, white space dropped, word ends marked."""

    def __init__(self, path: str, single: list[str]):
        super().__init__()
        self.library, self.lasting = _library(path), dict.fromkeys(single, 1)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.known: dict[str, int] = dict(self.lasting)

    def learn(self, unknown: list[str]) -> None:
        parts = [unknown[lo : lo + JOINED] for lo in range(0, len(unknown), JOINED)]
        for part, got in zip(parts, self.library.encode_batch_fast([" ".join(x) for x in parts], add_special_tokens=False)):
            stops = np.flatnonzero(self.ends[got.ids])
            if len(stops) != len(part):  # the library cut one of them otherwise: each on its own
                self.known.update((x, len(one.ids)) for x, one in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)))
                continue
            self.known.update(zip(part, np.diff(stops, prepend=-1).tolist()))

    def count(self, texts: list[str | None]) -> np.ndarray:
        out, later, whole = np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if (not text.isascii() and (UNPROVEN.search(text) or not unicodedata.is_normalized("NFC", text))) or any(s in text for s in self.special):
                whole.append(i)
                continue
            later.append((i, WORD.findall(text.lower())))
        self.learn(self.unknown(set().union(*(parts for _, parts in later))))
        for i, parts in later:
            out[i] = sum(map(self.known.__getitem__, parts))
        for i in whole:
            out[i] = len(self.library.encode(texts[i], add_special_tokens=False).ids)
        return out


class Encoder(Remembering):
    """Ids by ``byte_bpe``-like files, as bytes of little-endian ``dtype`` numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.library = _library(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.starts[[i for piece, i in vocab.items() if piece.startswith("Ġ")]] = True
        self.known: dict[str, bytes] = {}

    def learn(self, unknown: list[str]) -> None:
        spaced = [x for x in unknown if x[0] == " " and _LETTERS.issuperset(x[1:]) and len(x) > 1]
        other = [*set(unknown).difference(spaced)]
        parts = [spaced[lo : lo + JOINED] for lo in range(0, len(spaced), JOINED)]
        for part, got in zip(parts, self.library.encode_batch_fast(["".join(x) for x in parts], add_special_tokens=False)):
            ids = np.array(got.ids)
            first = np.flatnonzero(self.starts[ids])
            if len(first) != len(part):  # the library cut one of them otherwise: each on its own
                other += part
                continue
            raw, cut = ids.astype(self.dtype).tobytes(), [*(first * self.dtype.itemsize).tolist(), None]
            self.known.update(zip(part, map(raw.__getitem__, map(slice, cut, cut[1:]))))
        for x, got in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False)):
            self.known[x] = np.array(got.ids, self.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, later, whole = [b""] * len(texts), [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if (not text.isascii() and UNPROVEN.search(text)) or any(s in text for s in self.special):
                whole.append(i)
                continue
            later.append((i, BYTE.findall(text)))
        self.learn(self.unknown(set().union(*(parts for _, parts in later))))
        for i, parts in later:
            out[i] = b"".join(map(self.known.__getitem__, parts))
        for i in whole:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, self.dtype).tobytes()
        return out


def held(kind: Callable, *args):
    """This worker's one object of ``kind``, so that what it learned outlives a task."""
    key = (kind, args[0])
    if key not in tk.KEPT:
        tk.KEPT[key] = kind(*args)
    return tk.KEPT[key]


def runs(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first row, row after the last, texts) of about ``size`` bytes each."""
    _, at = tk.buffers(column)
    first = 0
    while first < len(column):
        after = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        yield first, after, column[first:after].to_pylist()
        first = after


def counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row: UTF-8 bytes and tokens of the whole text."""
    scratch.lean(docs.sparkSession)
    single = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary: under 1 MB

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(Counter, path, single.value)
        for batch in batches:
            n = [counter.count(texts) for _, _, texts in runs(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
