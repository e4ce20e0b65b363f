"""Dense positions and order statistics that never put a hot key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def dense_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    *,
    slice_by: Column,
    name: str = "pos",
    size: str | None = None,
) -> DataFrame:
    """0-based position of each row inside its key, as a long; ``size`` adds the key's row count.

    ``order`` must be total inside a key and ``slice_by`` must not decrease along it. Rows are ranked
    inside (key, slice) and shifted by the rows of the key's earlier slices, so the largest task holds
    one slice, however many rows the key has. The plan is the same at every size and runs no job of
    its own. Null keys form a key of their own; a null slice comes first.
    """
    keys = list(keys)
    # One struct as the key of rows and offsets: nulls in it are equal, so the join keeps them and
    # needs no other partitioning than the window before it.
    place = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("slice"))
    sliced = df.withColumn("_slice", slice_by)
    # Slices only, counted map-side over the key columns alone.
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        place.alias("_place"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("_total"),
    )
    rank = F.row_number().over(Window.partitionBy("_place").orderBy(*_cols(order)))
    ranked = sliced.withColumn("_place", place).withColumn("_rank", rank.cast("long") - 1)
    extra = [] if size is None else [F.col("_total").alias(size)]
    position = F.col("_rank") + F.col("_before")
    return ranked.join(offsets, "_place").select(*df.columns, position.alias(name), *extra)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    *,
    width: float,
) -> DataFrame:
    """Exact linear-interpolation quantiles per key in long form (keys, prob, value).

    Pass one counts values per slice of ``width``; pass two looks only into the
    slices that hold a wanted rank, on (value, count) pairs. Neither pass gathers
    the values of a key in one task.
    """
    keys = list(keys)
    base = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v"), F.floor(F.col(value) / F.lit(float(width))).alias("_slice")
    )
    counts = base.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    per_key = Window.partitionBy(*keys)
    run = per_key.orderBy("_slice")
    spans = counts.select(
        *keys,
        "_slice",
        F.sum("_rows").over(run).alias("_upto"),
        (F.sum("_rows").over(run) - F.col("_rows")).alias("_from"),
        F.sum("_rows").over(per_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"),
    )
    place = (F.col("_n") - 1) * F.col("_prob")
    wanted = (
        spans.withColumn("_prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_low", F.floor(place))
        .withColumn("_share", place - F.col("_low"))
        .withColumn("_rank", F.explode(F.array(F.col("_low"), F.least(F.col("_low") + 1, F.col("_n") - 1))))
        .filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_upto")))
        .withColumn("_weight", F.when(F.col("_rank") == F.col("_low"), 1 - F.col("_share")).otherwise(F.col("_share")))
        .select(*keys, "_slice", "_prob", "_weight", (F.col("_rank") - F.col("_from")).alias("_k"))
    )
    needed = wanted.select(*keys, "_slice").distinct()
    pairs = base.join(needed, keys + ["_slice"], "left_semi").groupBy(*keys, "_slice", "_v").agg(
        F.count(F.lit(1)).alias("_c")
    )
    inner = Window.partitionBy(*keys, "_slice").orderBy("_v")
    placed = pairs.select(
        *keys, "_slice", "_v", F.sum("_c").over(inner).alias("_to"), (F.sum("_c").over(inner) - F.col("_c")).alias("_at")
    )
    hits = placed.join(wanted, keys + ["_slice"]).filter((F.col("_k") >= F.col("_at")) & (F.col("_k") < F.col("_to")))
    # When both ranks coincide (share 0 at the top) the two weights still add up to one.
    return hits.groupBy(*keys, F.col("_prob").alias("prob")).agg(
        (F.sum(F.col("_v") * F.col("_weight")) / F.sum("_weight")).alias("value")
    )
