"""Alert generation, merging and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivepulse.functions.domains import ALERT_LEVEL
from drivepulse.functions.scalars import lookup

ALERT_COLUMNS = ["id", "ts", "vehicle_id", "car_model", "level", "component", "message", "fault_type"]
MOTOR_QUIET, SOH_QUIET = 5.0, 90.0


def level_of(status: Column) -> Column:
    return lookup(ALERT_LEVEL, F.lower(status), "info")


def _alert_id(component: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(component), F.col("response_id").cast("string")), 256)


def response_alerts(responses: DataFrame) -> DataFrame:
    """Motor and battery alerts of each response, from one pass over the responses."""
    fault, score = F.col("fault_type"), F.col("motor_score")
    cls, soh = F.col("classification"), F.col("soh_proxy")
    motor_text = F.when(
        fault != "NORMAL", F.format_string("Motor anomaly detected: %s (score=%.1f)", fault, score)
    ).otherwise(F.format_string("Motor operating normally (score=%.1f)", score))
    percent = F.bround(soh, 0)  # half-even, as the text format rounds
    pack_text = F.when(
        cls != "NORMAL", F.format_string("Battery %s: SOH=%.0f%%, %d fault cell(s)", cls, percent, F.col("n_faulty"))
    ).otherwise(F.format_string("Battery healthy: SOH=%.0f%%", percent))

    def entry(component: str, status: str, text: Column, kind: Column) -> Column:
        return F.struct(
            _alert_id(component).alias("id"),
            level_of(F.col(status)).alias("level"),
            F.lit(component).alias("component"),
            text.alias("message"),
            kind.alias("fault_type"),
        )

    motor = F.when((fault != "NORMAL") | (score > MOTOR_QUIET), entry("motor", "motor_status", motor_text, fault))
    pack = F.when((cls != "NORMAL") | (soh < SOH_QUIET), entry("battery", "battery_status", pack_text, cls))
    found = F.filter(F.array(motor, pack), lambda a: a.isNotNull())
    spread = responses.select("ts", "vehicle_id", "car_model", F.explode_outer(found).alias("a"))
    return spread.filter(F.col("a").isNotNull()).select(
        "a.id", "ts", "vehicle_id", "car_model", "a.level", "a.component", "a.message", "a.fault_type"
    )


def pack_alerts(packs: DataFrame) -> DataFrame:
    """The battery alerts alone, of responses without a motor."""
    quiet = packs.withColumns({"fault_type": F.lit("NORMAL"), "motor_score": F.lit(0.0), "motor_status": F.lit("normal")})
    return response_alerts(quiet)


def live_alerts(responses: DataFrame, *, manual: bool = False) -> DataFrame:
    """Client-side alerts: a live feed reacts to warnings, a manual fetch to any deviation."""
    motor, pack = F.col("motor_status"), F.col("battery_status")
    warning = (motor == "warning") | (pack == "warning")
    if manual:
        hit, motor_first = (motor != "normal") | (pack != "normal"), motor != "normal"
        level, digits = F.when(warning, "warning").otherwise("caution"), "%.0f"
        soh = F.bround("soh_proxy", 0)
    else:
        hit, motor_first = warning, motor == "warning"
        level, digits, soh = F.lit("warning"), "%.1f", F.col("soh_proxy")
    text = F.when(motor_first, F.format_string("Motor: MSE %.1f", F.col("motor_score"))).otherwise(
        F.format_string(f"Battery SOH {digits}", soh)
    )
    prefix = "fetch-" if manual else "auto-"
    return responses.filter(hit).select(
        F.concat(F.lit(prefix), F.col("response_id").cast("string")).alias("id"),
        "ts", "vehicle_id", level.alias("level"), text.alias("message"),
    )


def recent(alerts: DataFrame, *, level: str | None = None, component: str | None = None, limit: int = 50) -> DataFrame:
    """Newest alerts first after filtering (limit 1 to 200)."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    out = alerts
    if level:
        out = out.filter(F.col("level") == level.lower())
    if component:
        out = out.filter(F.col("component") == component.lower())
    return out.orderBy(F.col("ts").desc(), F.col("id")).limit(limit)


def keep_newest(alerts: DataFrame, n: int = 200) -> DataFrame:
    """Retention: the newest ``n`` alerts; 0 clears the store."""
    return alerts.orderBy(F.col("ts").desc(), F.col("id")).limit(n)


def keep_newest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Newest ``n`` rows per key; Spark limits each key before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")


def trend(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, keep: int = 30, reset_by: str | None = None) -> DataFrame:
    """Last ``keep`` points per key; ``reset_by`` restarts the trend when that column changes."""
    if reset_by is not None:
        stamp = F.struct(*order)
        # The newest stamp per (key, value) tells the current value and the last other one.
        ends = df.groupBy(*keys, reset_by).agg(F.max(stamp).alias("_end"))
        now = ends.groupBy(*keys).agg(F.max_by(F.col(reset_by), F.col("_end")).alias("_now"))
        other = (
            ends.join(now, list(keys)).groupBy(*keys, "_now")
            .agg(F.max(F.when(~F.col(reset_by).eqNullSafe(F.col("_now")), F.col("_end"))).alias("_since"))
        )
        df = (
            df.join(other, list(keys))
            .filter(F.col("_since").isNull() | (stamp > F.col("_since")))
            .drop("_now", "_since")
        )
    return keep_newest_per(df, keys, [F.col(c).desc() for c in order], keep)


def merge_alerts(existing: DataFrame, incoming: DataFrame, n: int = 100) -> DataFrame:
    """Add alerts whose id is new, newest first, keep ``n``."""
    fresh = incoming.dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti")
    return keep_newest(existing.unionByName(fresh.select(existing.columns)), n)


def level_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def exceedance(trend_points: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, threshold: float) -> DataFrame:
    """Latest score per key and whether it is strictly above the threshold."""
    stamp = F.struct(*order)
    return trend_points.groupBy(*keys).agg(F.max_by(score, stamp).alias("latest_score")).withColumn(
        "exceeded", F.col("latest_score") > threshold
    )
