"""Chunking, gap repair and panel queries over the signal view."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivepulse.functions.matrices import spread
from drivepulse.functions.scalars import half_up, ladder
from drivepulse.operators import shaping
from drivepulse.plans.registry import half_up_sql as r
from drivepulse.plans.registry import query
from drivepulse.plans.views import CHUNK, LENIENT, REPAIRED, SIG, STRICT, sig, sig_slice

CHUNK_KEYS = ["unit", "chunk_id"]


def chunked(spark, sf, strict=False):
    return shaping.chunk_rows(
        sig(spark, sf), recording=["unit"], order=["ts", "seq"], slice_by=sig_slice(),
        chunk_size=CHUNK, strict=strict,
    )


def repaired(spark, sf, strict=False):
    return shaping.repair_gaps(chunked(spark, sf, strict), chunk=CHUNK_KEYS)


def chunk_grades(rows):
    stats = rows.groupBy(*CHUNK_KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.when(F.col("was_gap"), 1.0).otherwise(0.0)).alias("missing"),
        F.sqrt(F.avg(F.col("clean") * F.col("clean"))).alias("level"),
        F.max("clean").alias("top"),
    )
    share = F.least(F.col("level") / 100.0, F.lit(1.0))
    return stats.select(
        *CHUNK_KEYS, "n_rows",
        half_up(F.col("missing"), 4).alias("missing_ratio"),
        half_up(F.col("level"), 5).alias("level"),
        half_up(F.col("top"), 5).alias("top"),
        ladder(share, [("<", 0.3, "normal"), ("<=", 0.7, "caution")], "danger").alias("band"),
    )


GRADES = "WITH " + LENIENT + REPAIRED + f""",
stats AS (
  SELECT unit, chunk_id, count(*) AS n_rows, avg(CASE WHEN was_gap THEN 1e0 ELSE 0e0 END) AS missing,
         sqrt(avg(clean * clean)) AS level, max(clean) AS top FROM repaired GROUP BY 1, 2)
SELECT unit, chunk_id, n_rows, {r('missing', 4)} AS missing_ratio, {r('level', 5)} AS level, {r('top', 5)} AS top,
       CASE WHEN least(level / 100e0, 1e0) < 0.3e0 THEN 'normal'
            WHEN least(level / 100e0, 1e0) <= 0.7e0 THEN 'caution' ELSE 'danger' END AS band
FROM stats"""


@query("chunk_grades", GRADES)
def q_chunk_grades(spark, sf):
    return chunk_grades(repaired(spark, sf))


_CHUNKS = "SELECT unit, chunk_id, count(*) AS n_rows, count(rms) AS n_valid, {} AS total FROM chunked GROUP BY 1, 2"


def _chunk_summary(rows):
    return rows.groupBy(*CHUNK_KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("rms").alias("n_valid"), half_up(F.sum("rms"), 4).alias("total")
    )


@query("chunk_strict", "WITH " + STRICT + _CHUNKS.format(r("sum(rms)", 4)))
def q_strict(spark, sf):
    return _chunk_summary(chunked(spark, sf, strict=True))


@query("chunk_lenient", "WITH " + LENIENT + _CHUNKS.format(r("sum(rms)", 4)))
def q_lenient(spark, sf):
    return _chunk_summary(chunked(spark, sf))


@query("chunk_rows", "WITH " + LENIENT + " SELECT unit, chunk_id, pos, seq, rms FROM chunked")
def q_chunk_rows(spark, sf):
    return chunked(spark, sf).select("unit", "chunk_id", "pos", "seq", "rms")


@query(
    "gap_repair",
    "WITH " + LENIENT + REPAIRED + f" SELECT unit, chunk_id, pos, was_gap, {r('clean', 6)} AS clean FROM repaired",
)
def q_repair(spark, sf):
    return repaired(spark, sf).select("unit", "chunk_id", "pos", "was_gap", half_up(F.col("clean"), 6).alias("clean"))


@query(
    "missing_ratio",
    "WITH " + LENIENT + f""" SELECT unit, chunk_id, count(*) AS n_rows,
    {r('avg(CASE WHEN rms IS NULL THEN 1e0 ELSE 0e0 END)', 6)} AS missing_ratio FROM chunked GROUP BY 1, 2""",
)
def q_missing(spark, sf):
    out = shaping.missing_ratio(chunked(spark, sf), chunk=CHUNK_KEYS)
    return out.withColumn("missing_ratio", half_up(F.col("missing_ratio"), 6))


LENGTH_TARGET = 20


def _assembled(spark, sf):
    rows = repaired(spark, sf)
    return shaping.assemble_chunks(rows, chunk=CHUNK_KEYS)


@query(
    "length_guard",
    "WITH " + SIG + f""",
tails AS (SELECT unit, CAST(place // 24 AS INTEGER) AS piece, CAST(place % 24 AS INTEGER) AS pos, coalesce(rms, 0) AS v,
                 count(*) OVER (PARTITION BY unit, place // 24) AS n FROM placed),
slots AS (SELECT DISTINCT unit, piece, n, unnest(range(0, {LENGTH_TARGET})) AS pos FROM tails)
SELECT s.unit, s.piece, CAST(s.n AS INTEGER) AS input_len,
       CASE WHEN s.n < {LENGTH_TARGET} THEN 'pad' WHEN s.n > {LENGTH_TARGET} THEN 'truncate' ELSE 'no_op' END AS length_action,
       CAST(s.pos AS INTEGER) AS pos, {r('coalesce(t.v, 0)', 4)} AS v
FROM slots s LEFT JOIN tails t ON s.unit = t.unit AND s.piece = t.piece AND s.pos = t.pos""",
)
def q_length_guard(spark, sf):
    pieces = _pieces(spark, sf)
    guarded = shaping.enforce_length(pieces, LENGTH_TARGET)
    rows = spread(guarded, ["unit", "piece", "input_len", "length_action"], "x", "pos", "v")
    return rows.withColumn("v", half_up(F.col("v"), 4))


def _pieces(spark, sf):
    """Pieces of up to 24 samples, the last of a unit shorter, as arrays."""
    placed = shaping.dense_position(sig(spark, sf), ["unit"], ["ts", "seq"], slice_by=sig_slice(), name="at")
    cut = placed.select(
        "unit", F.floor(F.col("at") / 24).cast("int").alias("piece"), (F.col("at") % 24).cast("int").alias("pos"),
        F.coalesce("rms", F.lit(0.0)).alias("v"),
    )
    return cut.groupBy("unit", "piece").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("x")
    )


@query(
    "length_report",
    "WITH " + SIG + f""",
sizes AS (SELECT unit, place // 24 AS piece, count(*) AS n FROM placed GROUP BY 1, 2)
SELECT CASE WHEN n < {LENGTH_TARGET} THEN 'pad' WHEN n > {LENGTH_TARGET} THEN 'truncate' ELSE 'no_op' END AS length_action,
       CAST(n AS INTEGER) AS input_len, count(*) AS n FROM sizes GROUP BY 1, 2""",
)
def q_length_report(spark, sf):
    return shaping.length_report(_pieces(spark, sf), LENGTH_TARGET)


@query(
    "panel_assembly",
    "WITH " + LENIENT + REPAIRED + f"""
SELECT unit, chunk_id, CAST(1 AS INTEGER) AS channels, CAST(count(*) AS INTEGER) AS length,
       {r('sum(CAST(CAST(clean AS FLOAT) AS DOUBLE))', 3)} AS total FROM repaired GROUP BY 1, 2""",
)
def q_panel(spark, sf):
    p = shaping.to_panel(_assembled(spark, sf), CHUNK)
    first = F.get(F.col("panel"), F.lit(0))
    total = F.aggregate(first, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return p.select(
        *CHUNK_KEYS, F.size("panel").alias("channels"), F.size(first).alias("length"), half_up(total, 3).alias("total")
    )


STREAM_SENSORS = ("click", "error", "purchase", "signup", "view")


@query(
    "round_robin",
    "WITH " + SIG + """,
firsts AS (SELECT sensor, unit, min(seq) AS seq, count(*) AS n_rows FROM sig GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY unit) AS rn FROM firsts)
SELECT sensor, unit, n_rows, row_number() OVER (ORDER BY rn, sensor) - 1 AS step FROM ranked""",
)
def q_round_robin(spark, sf):
    queue = sig(spark, sf).groupBy("sensor", "unit").agg(F.count(F.lit(1)).alias("n_rows"))
    return shaping.interleave(
        queue, order=["unit"], slice_by=F.floor(F.col("unit") / 10_000), sensors=STREAM_SENSORS
    ).select("sensor", "unit", "n_rows", "step")


@query(
    "row_count_check",
    "WITH " + SIG + f""" SELECT unit, count(*) AS n_rows, count(*) // {CHUNK} AS n_chunks,
    count(*) IN (48, 64, 80, 96) AS allowed FROM sig GROUP BY 1""",
)
def q_row_counts(spark, sf):
    from drivepulse.sources.signals import row_count_check

    return row_count_check(sig(spark, sf), recording=["unit"], allowed=(48, 64, 80, 96), chunk_size=CHUNK)


