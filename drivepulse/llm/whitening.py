"""Whitening of embeddings from a polarisation covariance, exact up to the eigenvectors.

A component c becomes the whole number x = floor(64 c) + 1000000. One pass gives the sums S of every
dimension; the mean S / n is cut into the nearest whole number and a rest. The second pass squares
what is left of every dimension, y, and of every sum of two dimensions, and adds the squares up as
whole numbers of any size. n sum(y^2) - (sum y)^2 is then n times the squared distance from the
mean, exactly, and half of what the variance of a sum exceeds the two variances by is the
covariance. Only the finished matrix becomes doubles and goes to ``eigh``; so its size, the square
of the number of dimensions, is what the driver holds.

Rows take part when their vector is neither null nor empty and holds no null, NaN or infinite entry
and as many entries as most vectors have (on a tie, more entries win). Components beyond 2^56 in size
count as 2^56; a ``deviation`` of 39 digits or more is null. Null ids stay null, repeated rows are rows of their own, other columns are not read.
A component whose variance is nothing but rounding (all vectors alike, fewer vectors than dimensions)
has a null ``whitened`` and is left out of ``identity_error``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Components that are returned, at most.
COMPONENTS = 32
# Rows that one vectorised step works on.
STEP_ROWS = 4096
SCALE, OFFSET = 64, 1_000_000
# Largest size of a component.
REACH = 2.0**56
# Whole numbers of any size travel in limbs of so many bits.
LIMB, LIMBS = 40, 4
LIMB_NAMES = [f"l{i}" for i in range(LIMBS)]
PARTIAL = "size bigint, a int, b int, n bigint, " + ", ".join(f"{x} bigint" for x in LIMB_NAMES)
OUTPUT = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double"


def vectors_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of entries: row numbers of the sound vectors and their entries x as whole numbers."""
    column = batch.column(1)
    if not len(column):
        return
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        for first in range(0, len(rows), STEP_ROWS):
            some = rows[first : first + STEP_ROWS]
            block = values[starts[some][:, None] + np.arange(size)]
            sound = np.isfinite(block).all(axis=1)
            yield int(size), some[sound], np.floor(SCALE * np.clip(block[sound], -REACH, REACH)).astype(np.int64) + OFFSET


def squares(values: np.ndarray, axis: int) -> np.ndarray:
    """Sum of the squares along an axis: 64-bit where nothing can overflow, else Python's integers."""
    if values.dtype != object:
        top = int(max(-int(values.min()), int(values.max()))) if values.size else 0
        if top * top * values.shape[axis] < 2**63:
            return np.einsum("ij,ij->j" if axis == 0 else "ij,ij->i", values, values)
        values = values.astype(object)
    return (values * values).sum(axis=axis)


def _limbs(size: int, a, b, n: int, totals) -> pa.RecordBatch:
    """One row for every total."""
    cells = [[int(t) >> (LIMB * i) & ((1 << LIMB) - 1) for t in totals] for i in range(LIMBS - 1)]
    cells.append([int(t) >> (LIMB * (LIMBS - 1)) for t in totals])
    rows = len(totals)
    columns = [pa.array([size] * rows, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array([n] * rows, pa.int64())]
    return pa.RecordBatch.from_arrays(columns + [pa.array(c, pa.int64()) for c in cells], [f.split()[0] for f in PARTIAL.split(", ")])


def _total(row) -> int:
    return sum(int(row[name]) << (LIMB * i) for i, name in enumerate(LIMB_NAMES))


def _added(partial: DataFrame, *keys: str) -> DataFrame:
    """The partial sums of all tasks, added up before and after one small shuffle."""
    return partial.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in LIMB_NAMES])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for size, rows, x in vectors_of(batch):
            entry = found.setdefault(size, [0, np.zeros(size, object)])
            entry[0] += len(rows)
            low = x & ((1 << 32) - 1)
            entry[1] = entry[1] + low.sum(axis=0).astype(object) + ((x >> 32).sum(axis=0).astype(object) << 32)
    for size, (n, totals) in found.items():
        yield _limbs(size, range(size), range(size), n, totals)


class Fit:
    """What a task needs of the fit: the mean in whole numbers and the components."""

    def __init__(self, n: int, totals: list[int]):
        self.n, self.size = n, len(totals)
        centre = [(2 * s + n) // (2 * n) for s in totals]
        self.centre = np.array(centre, np.int64)
        # The mean is centre + rest / n; the rest is at most n / 2.
        self.rest = np.array([s - n * c for s, c in zip(totals, centre, strict=True)], object)
        self.vectors = self.values = self.explained = None

    def left(self, x: np.ndarray) -> np.ndarray:
        return x - self.centre

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n x - S of every entry."""
        bound = self.n * (int(np.abs(y).max()) + 1) if y.size else 0
        if bound < 2**62:
            return y * self.n - self.rest.astype(np.int64)
        return y.astype(object) * self.n - self.rest

    def solve(self, variances: dict[tuple[int, int], int], keep: int) -> None:
        """``variances[a, b]``: n times the squared distances of the dimension a (a = b), or of the sum of two."""
        size, scale = self.size, self.n * self.n
        matrix = np.zeros((size, size))
        for (a, b), v in variances.items():
            twice = 2 * v if a == b else v - variances[a, a] - variances[b, b]
            matrix[a, b] = matrix[b, a] = twice / (2 * scale)
        values, vectors = np.linalg.eigh(matrix)
        values, vectors = values[::-1][:keep], vectors[:, ::-1][:, :keep]
        trace = sum(variances[a, a] for a in range(size)) / scale
        real = values > size * np.finfo(float).eps * max(values[0], 0.0)
        self.values, self.vectors = np.where(real, values, 0.0), np.ascontiguousarray(vectors)
        self.explained = self.values / trace if trace else np.zeros(len(values))

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """NaN in components without variance."""
        real = self.values > 0
        out = (y - (self.rest / self.n).astype(np.float64)) @ self.vectors
        out[:, ~real] = np.nan
        out[:, real] /= np.sqrt(self.values[real])
        return out


def _read(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def fit(vectors: DataFrame, keep: int = COMPONENTS) -> Fit | None:
    """Mean and components of all sound vectors; None when there are none."""
    rows = _read(vectors)
    found: dict[int, list] = {}
    # The most frequent size alone comes to the driver.
    partial = rows.mapInArrow(_sums, PARTIAL)
    sizes = _added(partial, "size", "a")
    top = sizes.filter("a = 0 AND n > 0").orderBy(F.desc("n"), F.desc("size")).limit(1).select("size")
    for r in sizes.join(F.broadcast(top), "size").collect():
        found[r["a"]] = [r["n"], _total(r)]
    if not found:
        return None
    model = Fit(found[0][0], [found[a][1] for a in range(len(found))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = model.size
        squared = [np.zeros(size - k, object) for k in range(size)]
        plain, n = np.zeros(size, object), 0
        for batch in batches:
            for found_size, rows_, x in vectors_of(batch):
                if found_size != size or not len(rows_):
                    continue
                y, n = model.left(x), n + len(rows_)
                plain = plain + y.astype(object).sum(axis=0) if np.abs(y).max() >= 2**40 else plain + y.sum(axis=0).astype(object)
                squared[0] = squared[0] + squares(y, 0)
                # Sums of the dimensions a and a + k, one k after another.
                for k in range(1, size):
                    squared[k] = squared[k] + squares(y[:, :-k] + y[:, k:], 0)
        if n:
            yield _limbs(-1, range(size), range(size), n, plain)
            for k in range(size):
                yield _limbs(size, range(size - k), range(k, size), n, squared[k])

    plain, squared = {}, {}
    for r in _added(rows.mapInArrow(run, PARTIAL), "size", "a", "b").collect():
        (plain if r["size"] < 0 else squared)[r["a"], r["b"]] = _total(r)
    n = model.n
    variances = {}
    for (a, b), total in squared.items():
        middle = plain[a, a] if a == b else plain[a, a] + plain[b, b]
        variances[a, b] = n * total - middle * middle
    model.solve(variances, keep)
    return model


def transform(vectors: DataFrame, model: Fit) -> DataFrame:
    """Rows of ``OUTPUT``: every sound vector and component."""
    rows = _read(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = len(model.values)
        for batch in batches:
            ids = batch.column(0)
            for size, at, x in vectors_of(batch):
                if size != model.size or not len(at):
                    continue
                y = model.left(x)
                deviation = squares(model.deviations(y), 1)
                white = model.whitened(y)
                each = np.repeat(np.arange(len(at)), kept)
                decimals = pa.array([int(v) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(at)).take(pa.array(each)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(each), model.n)), decimals.take(pa.array(each)),
                    pa.array(white.ravel(), mask=np.isnan(white.ravel())), pa.array(np.tile(model.explained, len(at)))],
                    [f.split()[0] for f in OUTPUT.split(", ")])

    return rows.mapInArrow(run, OUTPUT)


def identity_error(vectors: DataFrame, model: Fit) -> float | None:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, from the rows themselves.

    Two passes: the means of the whitened rows, then the products of what they leave.
    """
    rows = _read(vectors)
    real = np.flatnonzero(model.values > 0)
    if not len(real):
        return None

    def blocks(batches):
        for batch in batches:
            for size, at, x in vectors_of(batch):
                if size == model.size and len(at):
                    yield model.whitened(model.left(x))[:, real]

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(real))
        for block in blocks(batches):
            total += block.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(real), dtype=np.int32)), pa.array(total)], ["a", "v"])

    found = rows.mapInArrow(means, "a int, v double").groupBy("a").agg(F.sum("v").alias("v")).collect()
    mean = np.array([r["v"] for r in sorted(found)]) / model.n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(real), len(real)))
        for block in blocks(batches):
            left = block - mean
            total += left.T @ left
        a, b = np.triu_indices(len(real))
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], ["a", "b", "v"])

    summed = rows.mapInArrow(products, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v"))
    off = F.abs(F.col("v") / model.n - (F.col("a") == F.col("b")).cast("double"))
    return summed.agg(F.max(off).alias("v")).collect()[0]["v"]


def report(vectors: DataFrame, keep: int = COMPONENTS) -> DataFrame:
    """The whitened rows with the error of the whole beside them."""
    model = fit(vectors, keep)
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUTPUT + ", identity_error double")
    return transform(vectors, model).withColumn("identity_error", F.lit(identity_error(vectors, model)).cast("double"))
