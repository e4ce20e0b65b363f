"""Streaming queries: each runs to completion on the available files."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivepulse.functions.scalars import half_up
from drivepulse.operators import health, models
from drivepulse.operators.ranking import dense_position
from drivepulse.plans.health_queries import ALERTS, INTEGRATED, responses_of, with_probabilities
from drivepulse.plans.model_queries import _N, CENTROIDS
from drivepulse.plans.registry import half_up_sql as r
from drivepulse.plans.registry import query
from drivepulse.plans.views import CHUNK, LENIENT, panel, panel_of, sig, sig_slice, table_path
from drivepulse.session import shared_dir
from drivepulse.streaming import streams


@query(
    "stream_scoring",
    "WITH " + CENTROIDS + f""" SELECT vec_id, {_N}[arg_max(cls, p) + 1] AS predicted_label, {r('max(p)', 6)} AS top_prob,
  {r("1e0 - max(CASE WHEN cls = 0 THEN p END)", 6)} AS anomaly_score FROM pr GROUP BY vec_id""",
)
def q_stream_scoring(spark, sf):
    coefficients = models.centroid_coefficients(panel(spark, sf).withColumnRenamed("x", "features"), width=64)
    arriving = panel_of(streams.table_stream(spark, table_path(sf, "embeddings"))).withColumnRenamed("x", "features")
    scored = streams.score_stream(arriving, coefficients).select(
        "vec_id", "predicted_label", half_up(F.col("top_prob"), 6).alias("top_prob"),
        half_up(F.col("anomaly_score"), 6).alias("anomaly_score"),
    )
    return streams.append_to(scored, "stream-scoring")


@query(
    "stream_chunks",
    "WITH " + LENIENT + f" SELECT unit, chunk_id, CAST(count(*) AS INTEGER) AS n_rows, CAST(count(rms) AS INTEGER) AS n_valid, {r('sum(rms)', 4)} AS total FROM chunked GROUP BY 1, 2",
)
def q_stream_chunks(spark, sf):
    """Samples with positions are written as shuffled files and assembled again as they arrive."""
    placed = dense_position(sig(spark, sf), ["unit"], ["ts", "seq"], slice_by=sig_slice(), name="place")
    path = shared_dir(spark, "samples")
    placed.select("unit", "place", "rms").repartition("place").write.parquet(path)
    arriving = streams.table_stream(spark, path, files_per_trigger=2)
    live = streams.assemble_live(arriving, recording=[("unit", "long")], place="place", value="rms", chunk_size=CHUNK)
    out = streams.append_to(live, "stream-chunks")
    valid = F.filter("x", lambda v: v.isNotNull())
    return out.select(
        "unit", "chunk_id", F.size("x").alias("n_rows"), F.size(valid).alias("n_valid"),
        half_up(F.aggregate(valid, F.lit(0.0), lambda a, v: a + v), 4).alias("total"),
    )


@query(
    "stream_latest",
    """SELECT user_id AS unit, event_type AS sensor, arg_max(value, (ts, event_id)) AS score FROM events GROUP BY 1, 2""",
)
def q_stream_latest(spark, sf):
    e = streams.table_stream(spark, table_path(sf, "events"))
    scored = e.select(F.col("user_id").alias("unit"), F.col("event_type").alias("sensor"), "ts", "event_id", "value")
    state = streams.latest_state(scored, keys=["unit", "sensor"], score="value", order=["ts", "event_id"])
    return streams.upsert(state, "stream-latest", ["unit", "sensor"])


@query("stream_integrated", INTEGRATED)
def q_stream_integrated(spark, sf):
    """The integrated score kept up to date by a stream."""
    arriving = with_probabilities(panel_of(streams.table_stream(spark, table_path(sf, "embeddings"))))
    scored = arriving.select(
        (F.col("vec_id") % 40).alias("unit"), "sensor", "vec_id", health.anomaly_score(F.get("probs", F.lit(0))).alias("score"))
    state = streams.integrated_state(scored, keys=["unit"], sensor="sensor", score="score", order=["vec_id"])
    return streams.upsert(state, "stream-integrated", ["unit"])


@query(
    "stream_ring",
    """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= 30""",
)
def q_stream_ring(spark, sf):
    e = streams.table_stream(spark, table_path(sf, "events")).select("user_id", "ts", "event_id", "value")
    kept = streams.ring(e, "stream-ring", keys=["user_id"], order=["ts", "event_id"], keep=30)
    return kept.select("user_id", "event_id", "value")


@query("stream_alerts", "WITH " + ALERTS + " SELECT id, epoch_us(ts) AS ts_us, vehicle_id, level, component, message FROM alert")
def q_stream_alerts(spark, sf):
    e = streams.table_stream(spark, table_path(sf, "events"))
    # The files of a table come in no time order, so nothing counts as late.
    out = streams.append_to(streams.alert_stream(responses_of(spark, sf, e)), "stream-alerts")
    return out.select("id", F.unix_micros("ts").alias("ts_us"), "vehicle_id", "level", "component", "message")


@query(
    "stream_rate",
    "SELECT epoch_us(date_trunc('second', ts)) AS start_us, count(*) AS n FROM events GROUP BY 1",
)
def q_stream_rate(spark, sf):
    e = streams.table_stream(spark, table_path(sf, "events")).select("ts")
    out = streams.upsert(streams.message_rate(e), "stream-rate", ["start"])
    return out.select(F.unix_micros("start").alias("start_us"), "n")


@query("message_rate", "SELECT epoch_us(date_trunc('second', ts)) AS start_us, count(*) AS n FROM events GROUP BY 1")
def q_rate(spark, sf):
    from drivepulse.plans.views import table

    return streams.message_rate(table(spark, sf, "events")).select(F.unix_micros("start").alias("start_us"), "n")
