"""Whitening of embeddings by a one-sided Jacobi singular value decomposition.

1. **Sums.**  Entries become whole numbers, x = floor(SCALE c) + SHIFT; their sums S over
   the n rows are exact.
2. **R.**  Rows are centred as (n x - S) / n, of which the numerator is exact, before
   anything is multiplied.  Each task takes them in blocks and keeps the R of a QR
   decomposition of the R so far on top of the block; the R of tasks are stacked and
   decomposed FAN at a time until one is left.  It has the centred rows' singular values
   and right singular vectors, and no covariance is ever formed, which would square the
   condition.
3. **Jacobi.**  Plane rotations make R's columns orthogonal, a round of disjoint pairs at a
   time.  The columns' lengths are then the singular values, small ones as accurate as
   large ones, and the rotations, multiplied up, are the components.
4. **Whitened rows.**  Centred rows times components over standard deviations; their own
   covariance, summed up by tasks, is held against the identity.

What goes through the driver are some vectors and a matrix of the embeddings' dimension,
whatever the number of rows.

Defined results: rows whose vector is null, or holds null or non-finite entries, are left
out; so are rows of another dimension than most (the larger of equally frequent ones, for
empty vectors cannot be whitened), and entries past 2^53 / SCALE, which doubles no longer
count; ids are carried as they are, null and repeated ones too, and repeated rows count
each; a component along which rows do not vary, to double precision, has no whitened value
(null) and does not enter the error of the identity; ``deviation`` is a decimal of 38
digits, which the query makes a long (null where it doesn't fit); an empty table gives an
empty result; columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

SCALE, SHIFT = 1024, 100_000
#: R matrices that a task stacks; rows of a block at least, beside four times the dimension.
FAN, BLOCK = 32, 1024
#: Sweeps over all pairs of columns at most; some ten are enough.
SWEEPS = 60
EPS = np.finfo(np.float64).eps


def fit_rows(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, x) of the rows that count, x as whole numbers, and the dimension."""
    vector = F.col(vector_col)
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float(2**53) / SCALE))
    sound = rows.where(vector.isNotNull() & (F.size(vector) > 0) & finite)
    most = sound.groupBy(F.size(vector).alias("d")).count().agg(F.max_by("d", F.struct("count", "d"))).first()[0]
    kept = sound.where(F.size(vector) == (most or 0))
    return kept.select(F.col(id_col).alias("id"), F.transform(whole, lambda x: x + SHIFT).alias("x")), most or 0


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The x of a batch, rows x d whole numbers."""
    return np.asarray(batch.column("x").flatten()).astype(np.int64).reshape(-1, d)


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many rows, and the exact sums of their dimensions."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, [0] * d, [0] * d
        for batch in batches:
            x = matrix(batch, d)
            n += len(x)
            for lo in range(0, len(x), 1 << 20):  # halves, so that no sum passes 64 bits
                high = [a + b for a, b in zip(high, (x[lo : lo + (1 << 20)] >> 32).sum(0).tolist())]
                low = [a + b for a, b in zip(low, (x[lo : lo + (1 << 20)] & 0xFFFFFFFF).sum(0).tolist())]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["at", "n", "high", "low"])

    parts = rows.select("x").mapInArrow(add, "at int, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(19,0)"))
    got = sorted(parts.groupBy("at").agg(F.sum("n").alias("n"), wide("high").alias("high"), wide("low").alias("low")).collect())  # a row a dimension
    return (got[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in got]) if got else (0, [])


def numerators(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exactly: as long integers where these suffice, else as Python's."""
    if len(x) and max(n * int(np.abs(x).max()), max(map(abs, total))) < 1 << 62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    return numerators(x, n, total).astype(np.float64) / n


def triangle(stacked: np.ndarray) -> np.ndarray:
    """The R of a QR decomposition, d x d whatever the rows."""
    d = stacked.shape[1]
    r = np.linalg.qr(stacked, mode="r")
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def reduced(rows: DataFrame, d: int, n: int, total: list[int]) -> np.ndarray:
    """The R of all centred rows: of blocks in each task, then of the tasks' R, FAN at a time."""
    block = max(BLOCK, 4 * d)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            x = matrix(batch, d)
            for lo in range(0, len(x), block):
                y = centred(x[lo : lo + block], n, total)
                r = triangle(y if r is None else np.vstack([r, y]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def stack(table: pa.Table) -> pa.Table:
        r = None
        for raw in table.column("r"):
            own = np.frombuffer(raw.as_buffer(), np.float64).reshape(d, d)
            r = own if r is None else triangle(np.vstack([r, own]))
        return pa.table({"r": pa.array([r.tobytes()], pa.binary())})

    left = scratch.written(rows.select("x").mapInArrow(blocks, "r binary").withColumn("at", F.monotonically_increasing_id()), "triangles")
    while (many := left.count()) > 1:
        group = F.pmod(F.xxhash64("at"), F.lit(-(-many // FAN)))
        left = scratch.written(left.groupBy(group.alias("g")).applyInArrow(stack, "r binary").withColumn("at", F.monotonically_increasing_id()), "triangles")
    return np.frombuffer(left.first()["r"], np.float64).reshape(d, d)  # one d x d matrix


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right singular vectors as columns) of a square matrix.

    Pairs of columns are rotated until all are orthogonal.  A round holds disjoint pairs,
    which a round robin deals out, so that each pair meets once a sweep.
    """
    d = r.shape[1]
    size = float(np.abs(r).max()) or 1.0
    a, v = r / size, np.eye(d)
    seats = np.arange(d + d % 2)  # the seat past the last column is a bye
    half = len(seats) // 2
    for _ in range(SWEEPS):
        turned = False
        for _ in range(max(1, len(seats) - 1)):
            p, q = seats[:half], seats[half:][::-1]
            real = (p < d) & (q < d)
            p, q = np.minimum(p, q)[real], np.maximum(p, q)[real]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            if not len(p):
                continue
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            far = np.abs(gamma) > EPS * np.sqrt(alpha) * np.sqrt(beta)
            swap = ~far & (beta > alpha)
            if not (far.any() or swap.any()):
                continue
            turned = True
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (beta - alpha) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(far, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            # larger column first, so that columns end up sorted
            flip = np.where(far, beta > alpha, swap)
            for m in (a, v):
                x, y = m[:, p], m[:, q]
                one, two = c * x - s * y, s * x + c * y
                m[:, p], m[:, q] = np.where(flip, two, one), np.where(flip, -one, two)
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order] * size, v[:, order]


class Whitening:
    """Components (d x k, unit columns), standard deviations, and what share of the trace each has."""

    def __init__(self, n: int, total: list[int], components: np.ndarray, deviations: np.ndarray, explained: np.ndarray):
        self.n, self.total, self.components, self.deviations, self.explained = n, total, components, deviations, explained

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; nan along components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.deviations > 0, centred(x, self.n, self.total) @ self.components / self.deviations, np.nan)


def fit(rows: DataFrame, d: int, components: int) -> Whitening | None:
    """The whitening of ``rows`` (id, x), a written table; None without rows."""
    n, total = sums(rows, d)
    if not n:
        return None
    r = reduced(rows, d, n, total)
    sigma, v = jacobi(r)
    sigma = np.where(sigma > sigma[0] * EPS * max(d, 8), sigma, 0.0)
    trace = float((sigma**2).sum())
    keep = min(components, d)
    explained = sigma[:keep] ** 2 / trace if trace else np.zeros(keep)
    return Whitening(n, total, v[:, :keep], sigma[:keep] / np.sqrt(n), explained)


def identity_error(rows: DataFrame, d: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    good = np.flatnonzero(model.deviations > 0)
    if not len(good):
        return 0.0
    k = len(good)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x = matrix(batch, d)
            for lo in range(0, len(x), BLOCK):
                w = model.apply(x[lo : lo + BLOCK])[:, good]
                one += w.sum(0)
                two += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k), pa.int32()), pa.array(np.append(one, two.ravel()))], ["at", "s"])

    got = rows.select("x").mapInArrow(products, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()  # k + k^2 numbers
    s = np.array([r["s"] for r in got]) / model.n
    mean, second = s[:k], s[k:].reshape(k, k)  # the mean is nought but for rounding
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whitened(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each row that counts and each of its first ``components``."""
    if components < 1:
        raise ValueError("one component at least")
    spark = rows.sparkSession
    kept, d = fit_rows(rows, id_col, vector_col)
    kind = kept.schema["id"].dataType
    schema = f"id {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = None
    if d:
        kept = scratch.written(kept, "vectors")
        model = fit(kept, d, components)
    if model is None:
        return spark.createDataFrame([], schema)
    error, k = identity_error(kept, d, model), model.components.shape[1]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x, m = matrix(part, d), part.num_rows
                top = numerators(x, model.n, model.total)
                squares = [str(sum(y * y for y in row)) for row in top.tolist()]
                w = model.apply(x)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)), pa.array(squares, pa.string()).take(pa.array(each)),
                     pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    wide = kept.mapInArrow(made, schema.replace("decimal(38,0)", "string"))
    return wide.withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))"))


def as_long(decimal: Column) -> Column:
    """A decimal as a long, null where it doesn't fit."""
    return decimal.try_cast("long")
