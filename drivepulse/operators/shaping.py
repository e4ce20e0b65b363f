"""Cutting recordings into chunks, repairing gaps and assembling panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivepulse.functions.domains import CHUNK_ROWS, SENSORS, SIGNAL_COLUMNS
from drivepulse.functions.matrices import spread
from drivepulse.functions.scalars import fit_length, length_action
from drivepulse.operators.ranking import dense_position


def chunk_rows(
    signal: DataFrame,
    *,
    recording: Sequence[str] = ("group_key", "sensor"),
    order: Sequence[str] = ("time_idx",),
    slice_by: Column | None = None,
    chunk_size: int = CHUNK_ROWS,
    strict: bool = True,
) -> DataFrame:
    """Non-overlapping chunks in row form: adds ``chunk_id`` and ``pos``.

    ``strict`` rejects a recording whose length is no multiple of the chunk size;
    otherwise only the incomplete tail is dropped.
    """
    if chunk_size <= 0:
        raise ValueError(f"chunk_size must be positive, got {chunk_size}")
    recording = list(recording)
    slice_by = F.floor(F.col(order[0]) / F.lit(1_000_000)) if slice_by is None else slice_by
    placed = dense_position(signal, recording, list(order), slice_by=slice_by, name="_at", size="_len")
    # Complete chunks of a recording are known from its length alone.
    length, at = F.col("_len"), F.col("_at")
    whole = length % chunk_size == 0 if strict else at < length - length % chunk_size
    return (
        placed.filter(whole)
        .withColumn("chunk_id", F.floor(at / chunk_size).cast("int"))
        .withColumn("pos", (at % chunk_size).cast("int"))
        .drop("_at", "_len")
    )


def repair_gaps(
    rows: DataFrame,
    value: str = "rms",
    *,
    chunk: Sequence[str] = ("group_key", "sensor", "chunk_id"),
    pos: str = "pos",
    out: str = "clean",
) -> DataFrame:
    """Linear interpolation by position inside each chunk; edges hold, all-missing is zero.

    Two running ``last valid`` scans (one per direction) keep the cost linear in
    the chunk length; both share the chunk partitioning.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    point = F.when(v.isNotNull(), F.struct(v.alias("v"), F.col(pos).alias("p")))
    upto = Window.partitionBy(*chunk).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*chunk).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_point", point)
    near = near.withColumn("_prev", F.last("_point", ignorenulls=True).over(upto))
    near = near.withColumn("_next", F.last("_point", ignorenulls=True).over(back))
    left, right = F.col("_prev"), F.col("_next")
    slope = (right["v"] - left["v"]) / (right["p"] - left["p"])
    between = left["v"] + slope * (F.col(pos) - left["p"])
    clean = (
        F.when(F.col("_point").isNotNull(), F.col("_point")["v"])
        .when(left.isNotNull() & right.isNotNull(), between)
        .otherwise(F.coalesce(left["v"], right["v"], F.lit(0.0)))
    )
    return near.withColumn(out, clean).withColumn("was_gap", F.col("_point").isNull()).drop("_point", "_prev", "_next")


def missing_ratio(rows: DataFrame, value: str = "rms", *, chunk: Sequence[str]) -> DataFrame:
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return rows.groupBy(*chunk).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.when(v.isNull(), 1.0).otherwise(0.0)).alias("missing_ratio")
    )


def assemble_chunks(
    rows: DataFrame,
    value: str = "clean",
    *,
    chunk: Sequence[str] = ("group_key", "sensor", "chunk_id"),
    carry: Sequence[str] = (),
    out: str = "x",
) -> DataFrame:
    """One row per chunk with its samples as ``array<float>`` in position order.

    A chunk has a fixed length, so the collected list is bounded by it.
    """
    return rows.groupBy(*chunk).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col(value).cast("float").alias("v")))),
            lambda s: s["v"],
        ).alias(out),
        *[F.first(c, ignorenulls=True).alias(c) for c in carry],
    )


def explode_chunk(chunks: DataFrame, keys: Sequence[str], array: str = "x", value: str = "v") -> DataFrame:
    """Back to row form: the inverse of :func:`assemble_chunks`."""
    return spread(chunks, keys, array, "pos", value)


def signal_column(df: DataFrame, name: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Select one measured column after checking it against the closed set."""
    if name not in SIGNAL_COLUMNS:
        raise KeyError(f"unknown signal column {name!r}, expected one of {SIGNAL_COLUMNS}")
    if name not in df.columns:
        raise KeyError(f"column {name!r} is absent; present: {df.columns}")
    return df.select(*keys, F.col(name).cast("float").alias(name))


def enforce_length(df: DataFrame, target: int = CHUNK_ROWS, *, array: str = "x", out: str = "x") -> DataFrame:
    """Every array gets length ``target``; the action taken is kept for reporting."""
    size = F.size(array)
    return df.withColumns(
        {"input_len": size, "length_action": length_action(size, target), out: fit_length(F.col(array), target)}
    )


def length_report(df: DataFrame, target: int = CHUNK_ROWS, *, array: str = "x") -> DataFrame:
    """How many arrays were padded, cut or left alone, per input length."""
    size = F.size(array)
    return df.groupBy(length_action(size, target).alias("length_action"), size.alias("input_len")).agg(
        F.count(F.lit(1)).alias("n")
    )


def to_panel(df: DataFrame, target: int = CHUNK_ROWS, *, array: str = "x", out: str = "panel") -> DataFrame:
    """Channel-major panel column with one channel."""
    if not df.take(1):
        raise ValueError("no signals to assemble")
    fitted = fit_length(F.col(array).cast("array<double>"), target).cast("array<float>")
    return df.withColumn(out, F.array(fitted))


def stitch_fragments(
    fragments: DataFrame, *, recording: Sequence[str], number: str = "fragment", size: str | None = None,
) -> DataFrame:
    """Runs of consecutive fragment numbers: (recording, run, first, last, fragments[, rows]).

    Inside a run the fragment number minus its position is constant.
    """
    recording = list(recording)
    placed = dense_position(fragments, recording, [number], slice_by=F.floor(F.col(number) / 10_000), name="_at")
    extra = [F.sum(size).alias("n_rows")] if size else []
    runs = placed.groupBy(*recording, (F.col(number) - F.col("_at")).alias("_island")).agg(
        F.min(number).alias("first_fragment"),
        F.max(number).alias("last_fragment"),
        F.count(F.lit(1)).alias("n_fragments"),
        *extra,
    )
    numbered = dense_position(
        runs, recording, ["first_fragment", "_island"], slice_by=F.floor(F.col("first_fragment") / 10_000), name="_run"
    )
    return numbered.withColumn("run", F.col("_run") + 1).drop("_run", "_island")


def fuse_sensors(
    channels: DataFrame,
    *,
    session: Sequence[str],
    sensor: str = "sensor",
    panel: str = "channels",
    sensors: Sequence[str] = SENSORS,
) -> DataFrame:
    """Early fusion: all channels of a session side by side, cut to the shortest sensor.

    ``panel`` is channel-major (``array<array<…>>``). Sessions lacking a sensor drop out.
    """
    wide = channels.groupBy(*session).agg(
        *[F.max(F.when(F.col(sensor) == s, F.col(panel))).alias(f"_c{i}") for i, s in enumerate(sensors)]
    )
    parts = [F.col(f"_c{i}") for i in range(len(sensors))]
    shortest = F.least(*[F.size(F.get(p, F.lit(0))) for p in parts])
    complete = wide.dropna(subset=[f"_c{i}" for i in range(len(sensors))]).withColumn("length", shortest)
    return complete.select(
        *session,
        "length",
        F.transform(F.concat(*parts), lambda c: F.slice(c, F.lit(1), F.col("length"))).alias("fused"),
    )


def panel_chunks(fused: DataFrame, keys: Sequence[str], chunk_size: int = CHUNK_ROWS, panel: str = "fused") -> DataFrame:
    """Cut a fused panel into complete chunks (the tail is dropped), one row each."""
    length = F.size(F.get(F.col(panel), F.lit(0)))
    n = F.floor(length / chunk_size).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cut = fused.select(*keys, panel, F.explode_outer(ids).alias("chunk_id")).filter(F.col("chunk_id").isNotNull())
    return cut.select(
        *keys,
        "chunk_id",
        F.transform(panel, lambda c: F.slice(c, F.col("chunk_id") * chunk_size + 1, F.lit(chunk_size))).alias(panel),
    )


def session_completeness(
    rows: DataFrame, *, session: Sequence[str], sensor: str = "sensor", length: str = "length", expected: int = 3
) -> DataFrame:
    """Per session: sensors present, shortest and longest length, and whether it can be fused."""
    return rows.groupBy(*session).agg(
        F.countDistinct(sensor).alias("n_sensors"),
        F.min(length).alias("min_len"),
        F.max(length).alias("max_len"),
    ).withColumn("complete", (F.col("n_sensors") == expected) & (F.col("min_len") == F.col("max_len")))


def interleave(
    chunks: DataFrame,
    *,
    sensor: str = "sensor",
    order: Sequence[str] = ("group_key", "chunk_id"),
    slice_by: Column | None = None,
    sensors: Sequence[str] = SENSORS,
) -> DataFrame:
    """Round-robin ``step`` over the sensors; exhausted sensors are skipped.

    The step follows in closed form from the rank inside the sensor and the queue
    lengths, so no global sort is involved.
    """
    known = chunks.filter(F.col(sensor).isin(*sensors))
    slice_by = F.col(order[0]) if slice_by is None else slice_by
    ranked = dense_position(known, [sensor], list(order), slice_by=slice_by, name="_rank")
    counts = [F.count_if(F.col(sensor) == s).alias(f"n{i}") for i, s in enumerate(sensors)]
    sizes = known.agg(*counts).select(F.struct("*")).scalar()  # one row, read when the result is
    step = F.lit(0)
    for i, s in enumerate(sensors):
        size = sizes[f"n{i}"]
        step = step + F.least(F.col("_rank"), size)
        ahead = F.array(*[F.lit(x) for x in sensors[i + 1 :]]) if i + 1 < len(sensors) else None
        if ahead is not None:
            step = step + F.when(F.array_contains(ahead, F.col(sensor)) & (size > F.col("_rank")), 1).otherwise(0)
    return ranked.withColumn("step", step.cast("long")).drop("_rank")
