"""Motor health: anomaly scores, bands, head output, responses and the fleet view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivepulse.functions.domains import (
    CLASSES_ALPHABETICAL,
    SENSORS,
    SEVERITY,
    SPECTROGRAM_HEIGHT,
    SPECTROGRAM_WIDTH,
)
from drivepulse.functions.scalars import argmax_name, half_up, ladder, lookup, pick, softmax

# Score limits.
MOTOR_THRESHOLD, MOTOR_WARNING = 10.0, 30.0
AS_CAUTION, AS_WARNING = 0.3, 0.7
MEAN_WEIGHT, WORST_WEIGHT = 0.6, 0.4


def anomaly_score(p_normal: Column) -> Column:
    return F.lit(1.0) - p_normal


def gauge_band(score: Column) -> Column:
    """Gauge colours: exactly 0.7 is still caution."""
    return ladder(score, [("<", AS_CAUTION, "normal"), ("<=", AS_WARNING, "caution")], "warning")


def log_band(score: Column) -> Column:
    """Log severity: exactly 0.7 is already a warning."""
    return ladder(score, [(">=", AS_WARNING, "warning"), (">=", AS_CAUTION, "caution")], "normal")


def integrated_score(mean: Column, worst: Column) -> Column:
    return half_up(F.lit(MEAN_WEIGHT) * mean + F.lit(WORST_WEIGHT) * worst, 3)


def integrate(latest: DataFrame, *, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Combine the latest score of each sensor; a key without scores gets nulls."""
    out = latest.groupBy(*keys).agg(F.avg(score).alias("_mean"), F.max(score).alias("_worst"))
    value = integrated_score(F.col("_mean"), F.col("_worst"))
    return out.select(
        *keys,
        value.alias("integrated"),
        half_up(F.col("_mean"), 3).alias("mean"),
        half_up(F.col("_worst"), 3).alias("worst"),
        F.bround(value * 100.0, 0).cast("int").alias("points"),
    )


def motor_status(score: Column) -> Column:
    return ladder(score, [("<", MOTOR_THRESHOLD, "normal"), ("<", MOTOR_WARNING, "caution")], "warning")


def motor_score(head_score: Column, p_normal: Column, available: Column) -> Column:
    """Head output when there is one, else from P(NORMAL); 0 for a missing channel."""
    value = F.coalesce(half_up(head_score, 1), half_up((F.lit(1.0) - F.coalesce(p_normal, F.lit(1.0))) * 100.0, 1))
    return F.when(available, value).otherwise(0.0)


def channel_scores(scored: DataFrame, *, keys: Sequence[str], sensors: Sequence[str] = SENSORS) -> DataFrame:
    """One score column per channel; a channel without a result counts 0."""
    wide = scored.groupBy(*keys).pivot("sensor", list(sensors)).agg(F.max("score"))
    return wide.fillna(0.0, subset=list(sensors))


def sensor_band(score: Column) -> Column:
    return ladder(score, [("<", 30.0, "normal"), ("<=", 70.0, "caution")], "warning")


def display_percent(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))


def overall_status(*statuses: Column) -> Column:
    """The worst of several statuses."""
    codes = [lookup(SEVERITY, s, 0) for s in statuses]
    return pick(list(SEVERITY), F.greatest(*codes) if len(codes) > 1 else codes[0])


def head_result(df: DataFrame, logits: Column, bbox: Column, score: Column) -> DataFrame:
    """Localiser head output: class, rounded probabilities, box (blank if normal) and score."""
    staged = df.withColumn("_p", softmax(logits))
    cls = argmax_name(CLASSES_ALPHABETICAL, F.col("_p"), "UNKNOWN")
    named = F.map_from_arrays(
        F.array(*[F.lit(c) for c in CLASSES_ALPHABETICAL]), F.transform("_p", lambda p: half_up(p, 4))
    )
    blank = F.array(*[F.lit(0.0)] * 4)
    return (
        staged.withColumn("predicted_class", cls)
        .withColumn("probabilities", named)
        .withColumn("has_bbox", F.col("predicted_class") != "NORMAL")
        .withColumn("bbox", F.when(F.col("has_bbox"), F.transform(bbox, lambda v: half_up(v, 4))).otherwise(blank))
        .withColumn("anomaly_score", half_up(score * 100.0, 1))
        .drop("_p")
    )


def polygon_box(polygons: Column, width: Column, height: Column) -> Column:
    """Normalised bounds of the first polygon; null when there is none."""
    first = F.get(polygons, F.lit(0))

    def axis(i: int) -> Column:
        return F.transform(first, lambda p: F.get(p, F.lit(i)))

    box = F.struct(
        (F.array_min(axis(0)) / width).alias("x1"),
        (F.array_min(axis(1)) / height).alias("y1"),
        (F.array_max(axis(0)) / width).alias("x2"),
        (F.array_max(axis(1)) / height).alias("y2"),
    )
    return F.when(F.size(F.coalesce(first, F.array().cast("array<array<double>>"))) > 0, box)


def box_pixels(box: Column, cls: Column, probability: Column) -> Column:
    """Box in image pixels with a percent label, for drawing over the spectrogram."""
    w, h = F.lit(float(SPECTROGRAM_WIDTH)), F.lit(float(SPECTROGRAM_HEIGHT))
    x1, y1, x2, y2 = (F.get(box, F.lit(i)) for i in range(4))
    percent = half_up(F.coalesce(probability, F.lit(0.0)) * 100.0, 0).cast("int")
    return F.struct(
        (x1 * w).alias("x"),
        (y1 * h).alias("y"),
        ((x2 - x1) * w).alias("w"),
        ((y2 - y1) * h).alias("h"),
        F.concat(cls, F.lit(" "), percent.cast("string"), F.lit("%")).alias("label"),
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key, combined map-side so a busy key costs one row per task."""
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a stated order."""
    others = [c for c in df.columns if c not in keys]
    oldest = F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(oldest).select(*keys, "_row.*")


def battery_part(fault: str = "pack_fault") -> Column:
    """The battery half of a response from the columns of ``battery.response_columns``."""
    return F.struct(
        F.col("soh_proxy"),
        F.col("battery_status").alias("status"),
        F.col("classification"),
        F.col("probabilities"),
        F.col(fault).alias("fault_type"),
        F.col("fault_probabilities"),
        F.col("faulty_cells").alias("faulty_cell_indices"),
        F.col("cell_scores"),
        F.struct("min_cell_voltage", "voltage_deviation", "temperature", "cell_count", "cell_mean_voltages").alias(
            "metrics"
        ),
    )


def assemble_response(pairs: DataFrame) -> DataFrame:
    """Nested response rows from flat motor and battery columns of one vehicle.

    ``sensor_scores`` holds a score per channel; the localisation, with the class probabilities behind
    it, is null where the head drew no box.
    """
    has_box = F.coalesce(F.col("has_bbox"), F.lit(False))
    localisation = F.when(
        has_box,
        F.struct(
            F.col("bbox"), F.col("fault_type").alias("predicted_class"), F.col("motor_probabilities").alias("probabilities"),
            has_box.alias("has_bbox"), F.lit(True).alias("model_available"),
        ),
    )
    motor = F.struct(
        F.col("motor_score").alias("anomaly_score"),
        F.lit(MOTOR_THRESHOLD).alias("threshold"),
        motor_status(F.col("motor_score")).alias("status"),
        F.col("fault_type"),
        F.col("sensor_scores"),
        F.col("spectrogram_url"),
        localisation.alias("localization"),
    )
    return pairs.select(
        F.col("ts").alias("timestamp"), "vehicle_id", "car_model", motor.alias("motor"), battery_part().alias("battery")
    )


def fleet(responses: DataFrame, now: Column, *, model: str | None = None, status: str | None = None) -> DataFrame:
    """Vehicles with last_seen, current overall status and staleness; filters ignore case."""
    current = latest(
        responses.select("vehicle_id", "car_model", "ts", "response_id", "motor_status", "battery_status"),
        ["vehicle_id"], ["ts", "response_id"],
    )
    out = current.select(
        "vehicle_id", "car_model",
        overall_status(F.col("motor_status"), F.col("battery_status")).alias("status"),
        F.col("ts").alias("last_seen"),
        (now.cast("timestamp").cast("long") - F.col("ts").cast("timestamp").cast("long")).alias("stale_seconds"),
    )
    if model:
        out = out.filter(F.upper("car_model") == model.upper())
    if status:
        out = out.filter(F.lower("status") == status.lower())
    return out
