"""NumPy kernels over the UTF-8 bytes of whole Arrow string columns.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``, with
A-Z lower-cased.  Words are named by 64-bit hashes, computed for all words of a
block of documents at once; nothing here loops over words in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(256, _BASE, np.uint64))


#: What a Python worker keeps from task to task: tables of tokens, some 200 MB.
KEPT: dict[tuple, object] = {}


def trim() -> None:
    """Gives memory that is free back to the machine, which the C library would keep."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def forget() -> None:
    """Gives back what the worker keeps: for operators that need none of it, since workers outlive the stage that filled them."""
    KEPT.clear()
    trim()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    data, at = buffers(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        after = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        yield first, after, data[at[first] : at[after]], at[first : after + 1] - at[first]
        first = after


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(1 << int(n - 1).bit_length(), _BASE, np.uint64))
    return _powers


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a block, in order; where each text's words begin (n + 1); each word's first byte."""
    texts = len(at) - 1
    solid = ~SPACE[data]
    inside = np.flatnonzero(solid)
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64), np.zeros(0, np.int64)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    begins[edges] = solid[edges]
    first = np.flatnonzero(begins)
    slot = np.flatnonzero(begins[inside])
    sizes = np.diff(slot, append=len(inside))
    place = np.arange(len(inside), dtype=np.int64) - np.repeat(slot, sizes)
    terms = _BYTE[LOWER[data[inside]]] * powers(int(sizes.max()))[place]
    hashes = mix(np.add.reduceat(terms, slot) + sizes.astype(np.uint64))
    return hashes, np.searchsorted(first, at), first


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text; with fewer words its whole sequence as one; none without words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    total = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        total += hashes[i : len(hashes) - n + 1 + i] * powers(2 * n + 2)[n + 1 + i]
    return mix(total)


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of each text of a block."""
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return starts[at[1:]] - starts[at[:-1]]


def packed(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of numbers, the lowest ``width`` bytes of each, byte by byte and compressed: sorted columns shrink most."""
    planes = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() for x, width in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(raw: pa.Buffer | bytes, n: int, *widths: int) -> list[np.ndarray]:
    """The ``n`` numbers of each column that ``packed`` was given."""
    data = np.frombuffer(pa.decompress(raw, decompressed_size=n * sum(widths), codec="zstd"), np.uint8)
    out, at = [], 0
    for width in widths:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = data[at : at + n * width].reshape(width, n).T
        out.append(wide.view("<u8").ravel())
        at += n * width
    return out
