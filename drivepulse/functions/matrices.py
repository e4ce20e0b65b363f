"""Expressions over ``array<array<double>>`` columns: one matrix per row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivepulse.functions.scalars import let


def _zero() -> Column:
    return F.lit(0.0)


def total(values: Column) -> Column:
    return F.aggregate(values, _zero(), lambda acc, v: acc + v)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def column_of(matrix: Column, index: Column) -> Column:
    return F.transform(matrix, lambda row: F.get(row, index))


def transpose(matrix: Column) -> Column:
    """Rows become columns; the width is taken from the first row."""
    def flip(m: Column) -> Column:
        width = F.size(F.get(m, F.lit(0)))
        return F.transform(F.sequence(F.lit(0), width - 1), lambda i: column_of(m, i))

    return let(matrix, flip)


def spread(df: DataFrame, keep, array, pos: str, value: str) -> DataFrame:
    """One row per array element.

    The outer form of the generator carries no inferred size filter, which would
    otherwise be pushed down together with a copy of the array's definition.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())


def moments(values: Column) -> Column:
    """Struct of count, mean and population standard deviation in one stable fold.

    Uses the running-mean update, so no second pass over the array is needed.
    """
    start = F.struct(_zero().alias("n"), _zero().alias("mean"), _zero().alias("m2"))

    def step(acc, v):
        n = acc["n"] + 1.0
        shift = v - acc["mean"]
        centre = acc["mean"] + shift / n
        return F.struct(n.alias("n"), centre.alias("mean"), (acc["m2"] + shift * (v - centre)).alias("m2"))

    def finish(acc):
        return F.struct(
            acc["n"].alias("n"),
            acc["mean"].alias("mean"),
            F.when(acc["n"] > 0, F.sqrt(acc["m2"] / acc["n"])).alias("std"),
        )

    return F.aggregate(values, start, step, finish)


def quantile(values: Column, q: float) -> Column:
    """Linear-interpolation quantile of an array (nulls must be absent)."""
    return let(F.array_sort(values), lambda s: _interpolated(s, (F.size(s) - 1) * F.lit(float(q))))


def _interpolated(ordered: Column, place: Column) -> Column:
    low = F.floor(place).cast("int")
    share = place - low
    left = F.get(ordered, low)
    right = F.coalesce(F.get(ordered, low + 1), left)
    return left + (right - left) * share


def fit_matrix(matrix: Column, rows: int, columns: int) -> Column:
    """Pad with zeros or cut to ``rows`` x ``columns``, rows first."""
    blank = F.array_repeat(_zero(), columns)
    missing = F.greatest(F.lit(rows) - F.size(matrix), F.lit(0))
    widened = F.transform(
        matrix,
        lambda r: F.slice(
            F.concat(r, F.array_repeat(_zero(), F.greatest(F.lit(columns) - F.size(r), F.lit(0)))), 1, columns
        ),
    )
    return F.slice(F.concat(widened, F.array_repeat(blank, missing)), 1, rows)


def rescale(matrix: Column, low: float, span: float) -> Column:
    """``(v - low) / span`` clipped to [0, 1]."""
    return F.transform(
        matrix,
        lambda r: F.transform(
            r, lambda v: F.least(F.greatest((v - F.lit(low)) / F.lit(span), F.lit(0.0)), F.lit(1.0))
        ),
    )


def reshape(values: Column, rows: int, columns: int) -> Column:
    """Flat array to a row-major matrix."""
    starts = F.sequence(F.lit(0), F.lit(rows - 1))
    return let(values, lambda xs: F.transform(starts, lambda i: F.slice(xs, i * columns + 1, columns)))
