"""Battery packs: metrics, faulty cells, health proxy. One matrix per row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivepulse.functions import matrices as mx
from drivepulse.functions.domains import (
    PACK_CELLS,
    PACK_CLASSES,
    PACK_FAULTS,
    PACK_STATUS,
    PACK_STEPS,
    PACK_V_MIN,
    PACK_V_SPAN,
)
from drivepulse.functions.scalars import argmax_name, half_up, ladder, let, lookup, softmax

# Limits of the rules below.
LOW_CELL_VOLTS = 3.5
Z_LIMIT = 2.0
DEFECT_MIN_VOLTS, DEFECT_SPREAD = 3.3, 0.05
CAUTION_MIN_VOLTS, CAUTION_SPREAD = 3.7, 0.02
SOH_SPREAD_LIMIT, SOH_FULL_VOLTS, SOH_VOLTS_RANGE = 0.10, 4.2, 1.2
SOH_WEIGHTS = (15.0, 15.0, 10.0)
CLASS_PENALTY = {"NORMAL": 0.0, "CAUTION": 0.5, "DEFECT": 1.0}
# Ranges of the shares that stand in where no classifier answered; their middles are used.
STATUS_SHARES = {
    "NORMAL": {"normal": (0.80, 0.98), "caution": (0.01, 0.15), "defect": (0.00, 0.05)},
    "CAUTION": {"normal": (0.05, 0.25), "caution": (0.50, 0.75), "defect": (0.05, 0.30)},
    "DEFECT": {"normal": (0.00, 0.08), "caution": (0.05, 0.20), "defect": (0.72, 0.95)},
}
NO_FAULT_SHARE, OTHER_FAULT_SHARE = (0.01, 0.05), (0.01, 0.10)


def network_input(matrix: Column, steps: int = PACK_STEPS, cells: int = PACK_CELLS) -> Column:
    """Fixed-size matrix scaled to [0, 1]; padding ends up as 0."""
    return mx.rescale(mx.fit_matrix(matrix, steps, cells), PACK_V_MIN, PACK_V_SPAN)


def with_moments(packs: DataFrame, matrix: str = "m") -> DataFrame:
    """Adds ``v_min``, ``v_spread``, ``cell_mean`` and ``cell_std`` (unrounded)."""
    m = F.col(matrix)
    steps = F.transform(m, lambda row: mx.moments(row)["std"])
    return (
        packs.withColumn("_cells", F.transform(mx.transpose(m), mx.moments))
        .withColumn("v_min", F.array_min(F.transform(m, F.array_min)))
        .withColumn("v_spread", mx.moments(steps)["mean"])
        .withColumn("cell_mean", F.transform("_cells", lambda c: c["mean"]))
        .withColumn("cell_std", F.transform("_cells", lambda c: c["std"]))
        .drop("_cells")
    )


def pack_metrics(packs: DataFrame, *, temperature: Column | None = None) -> DataFrame:
    """Rounded display metrics from the moments."""
    temp = F.lit(None).cast("double") if temperature is None else half_up(temperature, 1)
    return packs.withColumns(
        {
            "min_cell_voltage": half_up(F.col("v_min"), 3),
            "voltage_deviation": half_up(F.col("v_spread"), 4),
            "temperature": temp,
            "cell_count": F.size("cell_mean"),
            "cell_mean_voltages": F.transform("cell_mean", lambda v: half_up(v, 4)),
        }
    )


def rule_class(v_min: Column, v_spread: Column) -> Column:
    """Class from unrounded voltage statistics when no classifier is at hand."""
    return (
        F.when((v_min < DEFECT_MIN_VOLTS) | (v_spread > DEFECT_SPREAD), "DEFECT")
        .when((v_min < CAUTION_MIN_VOLTS) | (v_spread > CAUTION_SPREAD), "CAUTION")
        .otherwise("NORMAL")
    )


def pack_identity(cell_count: Column) -> tuple[Column, Column]:
    """(vehicle, pack type) implied by the number of cells."""
    small = cell_count == 96
    return F.when(small, "IONIQ").otherwise("KONA"), F.when(small, "Vlt_96").otherwise("Vlt_98")


def folder_fault(pack_type: Column, status: Column) -> Column:
    return (
        F.when(F.upper(status) == "NORMAL", "none")
        .when(F.startswith(pack_type, F.lit("Dev")), "cell_deviation")
        .otherwise("cell_voltage")
    )


def _z_values(stat: Column) -> Column:
    """Distance of each cell from the pack in population deviations."""
    return let(
        mx.moments(stat),
        lambda pack: F.transform(stat, lambda v: (v - pack["mean"]) / (pack["std"] + F.lit(1e-9))),
    )


def localise(packs: DataFrame, stat: Column, kind: str, prefix: str) -> DataFrame:
    """Scores, flags and indices of suspicious cells from one statistic per cell.

    ``low`` looks for cells below the pack (or below the absolute limit), ``wide``
    for cells that vary more than the pack. Without any hit the single most
    extreme cell is flagged, the first one on ties.
    """
    sign = -1.0 if kind == "low" else 1.0
    if kind == "low":
        extreme = F.array_min(stat)
        hit = F.zip_with(stat, "_z", lambda v, z: (v < LOW_CELL_VOLTS) | (z < -Z_LIMIT))
    else:
        extreme = F.array_max(stat)
        hit = F.transform("_z", lambda z: z > Z_LIMIT)

    def scores(excess: Column) -> Column:
        top = F.array_max(excess) + F.lit(1e-9)
        return let(top, lambda t: F.transform(excess, lambda r: half_up(r / t, 4)))

    def cells(hits: Column) -> Column:
        places = F.filter(F.transform(hits, lambda h, i: F.when(h, i)), lambda i: i.isNotNull())
        return F.when(F.size(places) > 0, places).otherwise(F.array(F.array_position(stat, extreme).cast("int") - 1))

    excess = F.transform("_z", lambda z: F.greatest(z * F.lit(sign), F.lit(0.0)))
    return (
        packs.withColumn("_z", _z_values(stat))
        .withColumns({f"{prefix}_scores": let(excess, scores), f"{prefix}_cells": let(hit, cells)})
        .drop("_z")
    )


def locate_faults(packs: DataFrame, *, classification: Column, pack_type: Column, predicted: Column | None = None) -> DataFrame:
    """Adds ``fault_type``, ``faulty_cells`` and ``cell_scores``.

    A normal pack has no fault; otherwise a predicted fault type other than none
    wins over the type implied by the pack.
    """
    both = localise(localise(packs, F.col("cell_mean"), "low", "_low"), F.col("cell_std"), "wide", "_wide")
    guess = F.lit(None).cast("string") if predicted is None else F.when(predicted != "none", predicted)
    fault = F.when(classification == "NORMAL", "none").otherwise(
        F.coalesce(guess, folder_fault(pack_type, F.lit("DEFECT")))
    )
    wide = F.col("fault_type") == "cell_deviation"
    calm = F.col("fault_type") == "none"
    return (
        both.withColumn("fault_type", fault)
        .withColumn(
            "faulty_cells",
            F.when(calm, F.array().cast("array<int>")).when(wide, F.col("_wide_cells")).otherwise(F.col("_low_cells")),
        )
        .withColumn(
            "cell_scores",
            F.when(calm, F.transform("cell_mean", lambda v: F.lit(0.0)))
            .when(wide, F.col("_wide_scores"))
            .otherwise(F.col("_low_scores")),
        )
        .drop("_low_scores", "_low_cells", "_wide_scores", "_wide_cells")
    )


def soh_proxy(deviation: Column, min_voltage: Column, classification: Column) -> Column:
    """100 minus three capped penalties, from the rounded metrics."""
    w_spread, w_low, w_class = SOH_WEIGHTS
    spread = F.least(deviation / F.lit(SOH_SPREAD_LIMIT), F.lit(1.0))
    deficit = F.greatest(F.lit(SOH_FULL_VOLTS) - min_voltage, F.lit(0.0))
    low = F.least(deficit / F.lit(SOH_VOLTS_RANGE), F.lit(1.0))
    penalty = lookup(CLASS_PENALTY, F.upper(classification), 0.5)
    raw = F.lit(100.0) - F.lit(w_spread) * spread - F.lit(w_low) * low - F.lit(w_class) * penalty
    return F.greatest(F.least(half_up(raw, 1), F.lit(100.0)), F.lit(0.0))


def soh_band(soh: Column, status: Column | None = None) -> Column:
    """Gauge band; an explicit status wins."""
    derived = ladder(soh, [(">=", 80.0, "normal"), (">=", 60.0, "caution")], "warning")
    return derived if status is None else F.coalesce(status, derived)


def status_of_class(classification: Column, *, upload: bool = False) -> Column:
    """Fleet path maps DEFECT to warning; the upload path only lower-cases the class."""
    return F.lower(classification) if upload else lookup(PACK_STATUS, F.upper(classification), "normal")


def cell_severity(score: Column, faulty: Column) -> Column:
    s = F.coalesce(score, F.lit(0.0))
    return (
        F.when(faulty | (s > 0.7), "severe").when(s > 0.4, "high").when(s > 0.2, "raised").otherwise("calm")
    )


def cell_grid(packs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell with mean voltage, score, flag and severity bin."""
    cells = mx.spread(packs, [*keys, "cell_scores", "faulty_cells"], "cell_mean_voltages", "cell", "voltage")
    faulty = F.array_contains("faulty_cells", F.col("cell"))
    score = F.coalesce(F.get("cell_scores", F.col("cell")), F.lit(0.0))
    return cells.select(
        *keys, "cell", "voltage", score.alias("score"),
        faulty.alias("faulty"), cell_severity(score, faulty).alias("severity"),
    )


def _shares(values: dict[str, float]) -> Column:
    """A map of shares that add up to one, rounded to four digits."""
    total = sum(values.values())
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, round(v / total, 4))])


def stand_in_probabilities(classification: Column) -> Column:
    """Status shares of a class where no classifier answered; unknown classes count as normal."""
    middles = {c: {k: (low + high) / 2 for k, (low, high) in ranges.items()} for c, ranges in STATUS_SHARES.items()}
    out = _shares(middles["NORMAL"])
    for c in ("CAUTION", "DEFECT"):
        out = F.when(F.upper(classification) == c, _shares(middles[c])).otherwise(out)
    return out


def stand_in_fault_probabilities(pack_type: Column, classification: Column) -> Column:
    """Fault shares of a pack where no classifier answered: the fault that the pack's type implies leads."""
    none, other = (sum(r) / 2 for r in (NO_FAULT_SHARE, OTHER_FAULT_SHARE))
    voltage, deviation = (
        {"none": none, "cell_voltage": v, "cell_deviation": d} for v, d in ((1 - none - other, other), (other, 1 - none - other)))
    return F.when(classification == "NORMAL", _shares({"none": 1.0, "cell_voltage": 0.0, "cell_deviation": 0.0})).when(
        pack_type.startswith("Dev"), _shares(deviation)).otherwise(_shares(voltage))


def response_columns(packs: DataFrame, *, classification: Column, pack_type: Column, temperature: Column | None = None) -> DataFrame:
    """Everything that a battery response shows, from ``m``: metrics, faults, proxy of health, status and shares."""
    measured = pack_metrics(with_moments(packs), temperature=temperature).withColumn("classification", F.upper(classification))
    cls = F.col("classification")
    found = locate_faults(measured, classification=cls, pack_type=pack_type)
    return found.withColumns({
        "soh_proxy": soh_proxy(F.col("voltage_deviation"), F.col("min_cell_voltage"), cls),
        "battery_status": status_of_class(cls),
        "probabilities": stand_in_probabilities(cls),
        "fault_probabilities": stand_in_fault_probabilities(pack_type, cls),
    })


def metric_alarms(deviation: Column, temperature: Column) -> tuple[Column, Column]:
    return deviation > 0.01, F.coalesce(temperature > 50.0, F.lit(False))


def head_result(df: DataFrame, status_logits: Column, fault_logits: Column) -> DataFrame:
    """Classifier head output: class, fault type and rounded probability maps."""
    staged = df.withColumn("_s", softmax(status_logits)).withColumn("_f", softmax(fault_logits))
    status = argmax_name(PACK_CLASSES, F.col("_s"), "NORMAL")
    fault = argmax_name(PACK_FAULTS, F.col("_f"), "none")

    def named(names, probs):
        return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.transform(probs, lambda p: half_up(p, 4)))

    return (
        staged.withColumn("status", status)
        .withColumn("fault_type", F.when(F.col("status") == "NORMAL", "none").otherwise(fault))
        .withColumn("status_probabilities", named([c.lower() for c in PACK_CLASSES], F.col("_s")))
        .withColumn("fault_probabilities", named(PACK_FAULTS, F.col("_f")))
        .drop("_s", "_f")
    )


def unpivot(packs: DataFrame, keys: list[str], matrix: str = "m") -> DataFrame:
    """Matrix rows to (t, cell, v)."""
    return mx.spread(mx.spread(packs, keys, matrix, "t", "_row"), [*keys, "t"], "_row", "cell", "v")


def pivot(cells: DataFrame, keys: list[str], matrix: str = "m") -> DataFrame:
    """(t, cell, v) back to one matrix per key; a pack has a fixed number of cells."""
    rows = cells.groupBy(*keys, "t").agg(F.array_sort(F.collect_list(F.struct("cell", "v"))).alias("_row"))
    rows = rows.withColumn("_row", F.transform("_row", lambda s: s["v"]))
    return rows.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "_row"))), lambda s: s["_row"]).alias(matrix)
    )


def module_features(packs: DataFrame, keys: list[str], *, matrix: str = "m", per_module: int = 8, limit: float = 3.7) -> DataFrame:
    """Per module: extremes, readings above a limit and the max-min spread of its cells."""
    cells = unpivot(packs, keys, matrix)
    return cells.groupBy(*keys, F.floor(F.col("cell") / per_module).cast("int").alias("module")).agg(
        F.min("v").alias("v_min"),
        F.max("v").alias("v_max"),
        F.sum(F.when(F.col("v") > limit, 1).otherwise(0)).alias("n_above"),
        (F.max("v") - F.min("v")).alias("spread"),
    )
