"""Pack metrics, fault location, motor scores, responses and fleet queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivepulse.functions.domains import PACK_CLASSES, PACK_FAULTS, VEHICLES
from drivepulse.functions.matrices import spread
from drivepulse.functions.scalars import (
    argmax0,
    decode_label,
    encode_label,
    half_up,
    lookup,
    pick,
    renormalise,
    softmax,
)
from drivepulse.operators import alerts, battery, health
from drivepulse.plans.registry import half_up_sql as r
from drivepulse.plans.registry import query
from drivepulse.plans.views import EVENT_FAULT, PACK, PACK_METRICS, PANEL, PRED, pack, panel, pred, table


def packs(spark, sf):
    """Packs with moments, rounded metrics, rule class and health proxy."""
    p = battery.pack_metrics(battery.with_moments(pack(spark, sf)))
    p = p.withColumn("classification", battery.rule_class(F.col("v_min"), F.col("v_spread")))
    return p.withColumn(
        "soh_proxy", battery.soh_proxy(F.col("voltage_deviation"), F.col("min_cell_voltage"), F.col("classification"))
    )


def located(spark, sf):
    return battery.locate_faults(packs(spark, sf), classification=F.col("classification"), pack_type=F.col("pack_type"))


@query(
    "pack_metrics",
    "WITH " + PACK_METRICS + """
SELECT vec_id, min_cell_voltage, voltage_deviation, CAST(8 AS INTEGER) AS cell_count FROM metrics""",
)
def q_metrics(spark, sf):
    return packs(spark, sf).select("vec_id", "min_cell_voltage", "voltage_deviation", "cell_count")


@query(
    "pack_cell_means",
    "WITH " + PACK + f" SELECT vec_id, CAST(cell AS INTEGER) AS cell, {r('avg(v)', 4)} AS voltage FROM cells GROUP BY 1, 2",
)
def q_cell_means(spark, sf):
    return spread(packs(spark, sf), ["vec_id"], "cell_mean_voltages", "cell", "voltage")


@query("pack_rule_class", "WITH " + PACK_METRICS + " SELECT vec_id, classification FROM metrics")
def q_rule(spark, sf):
    return packs(spark, sf).select("vec_id", "classification")


_CLIP = "least(greatest((v - 3e0) / 1.2e0, 0e0), 1e0)"


@query(
    "pack_network_input",
    "WITH " + PACK + f""", slots AS (
  SELECT vec_id, t, cell FROM (SELECT vec_id FROM embeddings), (SELECT unnest(range(0, 10)) AS t), (SELECT unnest(range(0, 6)) AS cell))
SELECT s.vec_id, CAST(s.t AS INTEGER) AS t, CAST(s.cell AS INTEGER) AS cell,
       {r('coalesce(' + _CLIP + ', 0e0)', 5)} AS v
FROM slots s LEFT JOIN cells c ON s.vec_id = c.vec_id AND s.t = c.t AND s.cell = c.cell""",
)
def q_network_input(spark, sf):
    """Ten steps by six cells: the time axis is padded, the cell axis is cut."""
    shaped = pack(spark, sf).select("vec_id", battery.network_input(F.col("m"), 10, 6).alias("m"))
    return battery.unpivot(shaped, ["vec_id"]).withColumn("v", half_up(F.col("v"), 5))


@query("matrix_unpivot", "WITH " + PACK + f" SELECT vec_id, CAST(t AS INTEGER) AS t, CAST(cell AS INTEGER) AS cell, {r('v', 6)} AS v FROM cells")
def q_unpivot(spark, sf):
    long = battery.unpivot(pack(spark, sf), ["vec_id"])
    back = battery.pivot(long, ["vec_id"])
    return battery.unpivot(back, ["vec_id"]).withColumn("v", half_up(F.col("v"), 6))


LOCATED = PACK_METRICS + """,
stat AS (SELECT vec_id, cell, avg(v) AS mean, stddev_pop(v) AS sd FROM cells GROUP BY 1, 2),
base AS (SELECT vec_id, avg(mean) AS pm, stddev_pop(mean) + 1e-9 AS ps, avg(sd) AS sm, stddev_pop(sd) + 1e-9 AS ss
         FROM stat GROUP BY 1),
z AS (SELECT s.vec_id, s.cell, s.mean, s.sd, (s.mean - b.pm) / b.ps AS zl, (s.sd - b.sm) / b.ss AS zw
      FROM stat s JOIN base b USING (vec_id)),
ranked AS (
  SELECT *, greatest(-zl, 0e0) / (max(greatest(-zl, 0e0)) OVER p + 1e-9) AS low_score,
         greatest(zw, 0e0) / (max(greatest(zw, 0e0)) OVER p + 1e-9) AS wide_score,
         mean < 3.5e0 OR zl < -2e0 AS low_hit, zw > 2e0 AS wide_hit,
         row_number() OVER (PARTITION BY vec_id ORDER BY mean, cell) = 1 AS lowest,
         row_number() OVER (PARTITION BY vec_id ORDER BY sd DESC, cell) = 1 AS widest
  FROM z WINDOW p AS (PARTITION BY vec_id)),
marked AS (
  SELECT *, low_hit OR (lowest AND NOT bool_or(low_hit) OVER p) AS low_flag,
         wide_hit OR (widest AND NOT bool_or(wide_hit) OVER p) AS wide_flag
  FROM ranked WINDOW p AS (PARTITION BY vec_id)),
kind AS (
  SELECT vec_id, classification, CASE WHEN classification = 'NORMAL' THEN 'none'
         WHEN starts_with(pack_type, 'Dev') THEN 'cell_deviation' ELSE 'cell_voltage' END AS fault_type FROM metrics),
graded AS (
  SELECT m.vec_id, m.cell, k.fault_type, m.mean,
         CASE k.fault_type WHEN 'none' THEN 0e0 WHEN 'cell_deviation' THEN floor(wide_score * 1e4 + 0.5e0) / 1e4
              ELSE floor(low_score * 1e4 + 0.5e0) / 1e4 END AS score,
         CASE k.fault_type WHEN 'none' THEN FALSE WHEN 'cell_deviation' THEN wide_flag ELSE low_flag END AS faulty
  FROM marked m JOIN kind k USING (vec_id)),
faults AS (SELECT vec_id, any_value(fault_type) AS fault_type, CAST(count(*) FILTER (WHERE faulty) AS INTEGER) AS n_faulty FROM graded GROUP BY 1)"""


def _flags(df, prefix):
    cells = spread(df, ["vec_id", f"{prefix}_cells"], f"{prefix}_scores", "cell", "score")
    return cells.select("vec_id", "cell", "score", F.array_contains(f"{prefix}_cells", F.col("cell")).alias("faulty"))


@query(
    "low_cells",
    "WITH " + LOCATED + f" SELECT vec_id, CAST(cell AS INTEGER) AS cell, {r('low_score', 4)} AS score, low_flag AS faulty FROM marked",
)
def q_low(spark, sf):
    return _flags(battery.localise(packs(spark, sf), F.col("cell_mean"), "low", "x"), "x")


@query(
    "wide_cells",
    "WITH " + LOCATED + f" SELECT vec_id, CAST(cell AS INTEGER) AS cell, {r('wide_score', 4)} AS score, wide_flag AS faulty FROM marked",
)
def q_wide(spark, sf):
    return _flags(battery.localise(packs(spark, sf), F.col("cell_std"), "wide", "x"), "x")


@query("pack_faults", "WITH " + LOCATED + " SELECT vec_id, fault_type, n_faulty FROM faults")
def q_faults(spark, sf):
    return located(spark, sf).select("vec_id", "fault_type", F.size("faulty_cells").alias("n_faulty"))


@query(
    "cell_grid",
    "WITH " + LOCATED + """
SELECT vec_id, CAST(cell AS INTEGER) AS cell, floor(mean * 1e4 + 0.5e0) / 1e4 AS voltage, score, faulty,
       CASE WHEN faulty OR score > 0.7e0 THEN 'severe' WHEN score > 0.4e0 THEN 'high' WHEN score > 0.2e0 THEN 'raised' ELSE 'calm' END AS severity
FROM graded""",
)
def q_grid(spark, sf):
    return battery.cell_grid(located(spark, sf), ["vec_id"])


@query(
    "soh_proxy",
    "WITH " + PACK_METRICS + """ SELECT vec_id, soh_proxy,
  CASE WHEN soh_proxy >= 80e0 THEN 'normal' WHEN soh_proxy >= 60e0 THEN 'caution' ELSE 'warning' END AS band,
  CASE WHEN classification = 'DEFECT' THEN 'warning' WHEN soh_proxy >= 80e0 THEN 'normal'
       WHEN soh_proxy >= 60e0 THEN 'caution' ELSE 'warning' END AS shown
FROM soh""",
)
def q_soh(spark, sf):
    given = F.when(F.col("classification") == "DEFECT", "warning")
    return packs(spark, sf).select(
        "vec_id", "soh_proxy", battery.soh_band(F.col("soh_proxy")).alias("band"),
        battery.soh_band(F.col("soh_proxy"), given).alias("shown"),
    )


@query(
    "pack_status",
    "WITH " + PACK_METRICS + """ SELECT vec_id,
  CASE classification WHEN 'NORMAL' THEN 'normal' WHEN 'CAUTION' THEN 'caution' WHEN 'DEFECT' THEN 'warning' ELSE 'normal' END AS fleet_status,
  lower(classification) AS upload_status,
  CASE WHEN classification = 'NORMAL' THEN 'none' WHEN starts_with(pack_type, 'Dev') THEN 'cell_deviation' ELSE 'cell_voltage' END AS folder_fault,
  CASE WHEN vec_id % 2 = 0 THEN 'IONIQ' ELSE 'KONA' END AS vehicle, CASE WHEN vec_id % 2 = 0 THEN 'Vlt_96' ELSE 'Vlt_98' END AS pack_type
FROM metrics""",
)
def q_pack_status(spark, sf):
    cells = F.when(F.col("vec_id") % 2 == 0, 96).otherwise(98)
    vehicle, kind = battery.pack_identity(cells)
    return packs(spark, sf).select(
        "vec_id",
        battery.status_of_class(F.col("classification")).alias("fleet_status"),
        battery.status_of_class(F.col("classification"), upload=True).alias("upload_status"),
        battery.folder_fault(F.col("pack_type"), F.col("classification")).alias("folder_fault"),
        vehicle.alias("vehicle"), kind.alias("pack_type"),
    )


@query(
    "pack_modules",
    "WITH " + PACK + f""" SELECT vec_id, CAST(cell // 4 AS INTEGER) AS module, {r('min(v)', 5)} AS v_min, {r('max(v)', 5)} AS v_max,
    count(*) FILTER (WHERE v > 3.7e0) AS n_above, {r('max(v) - min(v)', 5)} AS spread FROM cells GROUP BY 1, 2""",
)
def q_modules(spark, sf):
    out = battery.module_features(pack(spark, sf), ["vec_id"], per_module=4)
    return out.withColumns({c: half_up(F.col(c), 5) for c in ("v_min", "v_max", "spread")})


@query(
    "label_codes",
    "WITH " + PRED + """ SELECT sample_id, CASE upper(lower(true_label)) WHEN 'NORMAL' THEN 0 WHEN 'ECC10' THEN 1 WHEN 'ECC20' THEN 2
  WHEN 'DEMAG' THEN 3 WHEN 'REDUC' THEN 4 END AS label_id, true_label AS decoded FROM pred""",
)
def q_labels(spark, sf):
    p = pred(spark, sf).withColumn("label_id", encode_label(F.lower("true_label")))
    return p.select("sample_id", "label_id", decode_label(F.col("label_id")).alias("decoded"))


def probabilities(spark, sf):
    """Class probabilities per panel row from its first five samples."""
    return with_probabilities(panel(spark, sf))


def with_probabilities(p):
    return p.withColumn("probs", softmax(F.transform(F.slice("x", 1, 5), lambda v: v * 8.0)))


PROBS = PANEL + """,
logits AS (SELECT *, list_transform(list_slice(x, 1, 5), lambda v: v * 8e0) AS lg FROM panel),
exps AS (SELECT *, list_transform(lg, lambda v: exp(v - list_max(lg))) AS ex FROM logits),
probs AS (SELECT *, list_transform(ex, lambda v: v / list_sum(ex)) AS p FROM exps)"""
_NAMES = "['NORMAL','ECC10','ECC20','DEMAG','REDUC']"


@query(
    "softmax_argmax",
    "WITH " + PROBS + f""" SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS predicted_id,
  {_NAMES}[list_position(p, list_max(p))] AS predicted_label, {r('list_max(p)', 5)} AS top_prob FROM probs""",
)
def q_softmax(spark, sf):
    p = probabilities(spark, sf)
    return p.select(
        "vec_id", argmax0(F.col("probs")).alias("predicted_id"),
        decode_label(argmax0(F.col("probs"))).alias("predicted_label"),
        half_up(F.array_max("probs"), 5).alias("top_prob"),
    )


@query(
    "probability_ranking",
    "WITH " + PROBS + f""", flat AS (SELECT vec_id, unnest({_NAMES}) AS name, unnest(p) AS p FROM probs)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, name) - 1 AS INTEGER) AS place, name, {r('p', 5)} AS p FROM flat""",
)
def q_ranking(spark, sf):
    from drivepulse.functions.domains import CLASSES

    names = F.array(*[F.lit(c) for c in CLASSES])
    pairs = F.arrays_zip(names.alias("name"), F.col("probs").alias("p"))
    ordered = F.array_sort(
        pairs,
        lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1)
        .when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0),
    )
    out = spread(probabilities(spark, sf), ["vec_id"], ordered, "place", "e")
    return out.select("vec_id", "place", F.col("e.name").alias("name"), half_up(F.col("e.p"), 5).alias("p"))


_AS = "1e0 - p[1]"


@query(
    "anomaly_score",
    "WITH " + PROBS + f""", scored AS (SELECT vec_id, {_AS} AS s FROM probs)
SELECT vec_id, {r('s', 5)} AS score,
  CASE WHEN s < 0.3e0 THEN 'normal' WHEN s <= 0.7e0 THEN 'caution' ELSE 'warning' END AS gauge,
  CASE WHEN s >= 0.7e0 THEN 'warning' WHEN s >= 0.3e0 THEN 'caution' ELSE 'normal' END AS severity FROM scored""",
)
def q_as(spark, sf):
    s = probabilities(spark, sf).select("vec_id", health.anomaly_score(F.get("probs", F.lit(0))).alias("s"))
    return s.select(
        "vec_id", half_up(F.col("s"), 5).alias("score"), health.gauge_band(F.col("s")).alias("gauge"),
        health.log_band(F.col("s")).alias("severity"),
    )


@query(
    "as_threshold_edges",
    """WITH s AS (SELECT event_id, round(event_id % 1001) / 1000e0 AS s FROM events)
SELECT event_id, CASE WHEN s < 0.3e0 THEN 'normal' WHEN s <= 0.7e0 THEN 'caution' ELSE 'warning' END AS gauge,
  CASE WHEN s >= 0.7e0 THEN 'warning' WHEN s >= 0.3e0 THEN 'caution' ELSE 'normal' END AS severity,
  CASE WHEN s * 100 < 30 THEN 'normal' WHEN s * 100 <= 70 THEN 'caution' ELSE 'warning' END AS sensor_band FROM s""",
)
def q_edges(spark, sf):
    """Scores on a grid of thousandths so that every limit is hit exactly."""
    s = (F.col("event_id") % 1001) / 1000.0
    return table(spark, sf, "events").select(
        "event_id", health.gauge_band(s).alias("gauge"), health.log_band(s).alias("severity"),
        health.sensor_band(s * 100).alias("sensor_band"),
    )


INTEGRATED = "WITH " + PROBS + f""", scored AS (SELECT vec_id % 40 AS unit, sensor, vec_id, {_AS} AS s FROM probs),
latest AS (SELECT unit, sensor, arg_max(s, vec_id) AS s FROM scored GROUP BY 1, 2),
agg AS (SELECT unit, avg(s) AS m, max(s) AS w FROM latest GROUP BY 1)
SELECT unit, {r('0.6e0 * m + 0.4e0 * w', 3)} AS integrated, {r('m', 3)} AS mean, {r('w', 3)} AS worst,
  CAST(round_even({r('0.6e0 * m + 0.4e0 * w', 3)} * 100e0, 0) AS INTEGER) AS points FROM agg"""


@query("integrated_score", INTEGRATED)
def q_integrated(spark, sf):
    scored = probabilities(spark, sf).select(
        (F.col("vec_id") % 40).alias("unit"), "sensor", "vec_id",
        health.anomaly_score(F.get("probs", F.lit(0))).alias("score"),
    )
    return health.integrate(health.latest(scored, ["unit", "sensor"], ["vec_id"]), keys=["unit"])


@query(
    "score_history",
    "WITH " + PROBS + f""" SELECT sensor, row_number() OVER (PARTITION BY sensor ORDER BY vec_id) - 1 AS step, vec_id,
  {r(_AS, 3)} AS score FROM probs""",
)
def q_history(spark, sf):
    from drivepulse.operators.ranking import dense_position

    scored = probabilities(spark, sf).select(
        "sensor", "vec_id", half_up(health.anomaly_score(F.get("probs", F.lit(0))), 3).alias("score")
    )
    return dense_position(scored, ["sensor"], ["vec_id"], slice_by=F.floor(F.col("vec_id") / 1_000_000), name="step")


@query(
    "severity_counts",
    "WITH " + PROBS + f""", s AS (SELECT sensor, {_AS} AS s, fault_class, {_NAMES}[list_position(p, list_max(p))] AS pl FROM probs)
SELECT sensor, count(*) FILTER (WHERE s >= 0.7e0) AS n_warning, count(*) FILTER (WHERE s >= 0.3e0 AND s < 0.7e0) AS n_caution,
  count(*) FILTER (WHERE s < 0.3e0) AS n_normal, count(*) FILTER (WHERE fault_class <> pl) AS n_wrong FROM s GROUP BY 1""",
)
def q_severity(spark, sf):
    from drivepulse.operators.evaluation import severity_counts

    s = probabilities(spark, sf).select(
        "sensor", health.anomaly_score(F.get("probs", F.lit(0))).alias("score"),
        F.col("fault_class").alias("true_label"), decode_label(argmax0(F.col("probs"))).alias("predicted_label"),
    )
    return severity_counts(s, ["sensor"])


_PACK_N = "['CAUTION','DEFECT','NORMAL']"
_FAULT_N = "['cell_deviation','cell_voltage','none']"


def _sm(src, name):
    return f"""list_transform(list_transform({src}, lambda v: exp(v - list_max({src}))), lambda e: e / list_sum(list_transform({src}, lambda v: exp(v - list_max({src}))))) AS {name}"""


@query(
    "battery_head",
    "WITH " + PANEL + f""",
lg AS (SELECT vec_id, list_transform(list_slice(x, 11, 13), lambda v: v * 10e0) AS a, list_transform(list_slice(x, 14, 16), lambda v: v * 10e0) AS b FROM panel),
sm AS (SELECT vec_id, {_sm('a', 'sp')}, {_sm('b', 'fp')} FROM lg)
SELECT vec_id, {_PACK_N}[list_position(sp, list_max(sp))] AS status,
  CASE WHEN {_PACK_N}[list_position(sp, list_max(sp))] = 'NORMAL' THEN 'none' ELSE {_FAULT_N}[list_position(fp, list_max(fp))] END AS fault_type,
  {r('sp[1]', 4)} AS caution, {r('sp[2]', 4)} AS defect, {r('sp[3]', 4)} AS normal, {r('fp[1]', 4)} AS cell_deviation,
  {r('fp[2]', 4)} AS cell_voltage, {r('fp[3]', 4)} AS none FROM sm""",
)
def q_battery_head(spark, sf):
    p = panel(spark, sf)

    def logits(start):
        return F.transform(F.slice("x", start, 3), lambda v: v * 10.0)

    out = battery.head_result(p, logits(11), logits(14))
    maps = [F.try_element_at("status_probabilities", F.lit(n.lower())).alias(n.lower()) for n in PACK_CLASSES]
    maps += [F.try_element_at("fault_probabilities", F.lit(n)).alias(n) for n in PACK_FAULTS]
    return out.select("vec_id", "status", "fault_type", *maps)


_ALPHA = "['DEMAG','ECC10','ECC20','NORMAL','REDUC']"
MOTOR_HEAD = PANEL + f""",
lg AS (SELECT vec_id, x, cls, list_transform(list_slice(x, 1, 5), lambda v: v * 10e0) AS a FROM panel),
sm AS (SELECT vec_id, x, cls, {_sm('a', 'p')} FROM lg),
head AS (SELECT vec_id, x, cls, p, {_ALPHA}[list_position(p, list_max(p))] AS pc FROM sm)"""


def motor_head(spark, sf):
    p = panel(spark, sf)
    bbox = F.transform(F.slice("x", 6, 4), F.abs)
    score = F.when(F.col("cls") != 4, F.abs(F.get("x", F.lit(9))))
    return health.head_result(p, F.transform(F.slice("x", 1, 5), lambda v: v * 10.0), bbox, score)


def _boxed(i):
    return f"CASE WHEN pc = 'NORMAL' THEN 0e0 ELSE {r(f'abs(x[{i}])', 4)} END"


@query(
    "motor_head",
    "WITH " + MOTOR_HEAD + f""" SELECT vec_id, pc AS predicted_class, pc <> 'NORMAL' AS has_bbox,
  {_boxed(6)} AS x1, {_boxed(7)} AS y1, {_boxed(8)} AS x2, {_boxed(9)} AS y2,
  CASE WHEN cls <> 4 THEN {r('abs(x[10]) * 100e0', 1)} END AS anomaly_score, {r('p[4]', 4)} AS p_normal FROM head""",
)
def q_motor_head(spark, sf):
    return motor_head(spark, sf).select(
        "vec_id", "predicted_class", "has_bbox",
        *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
        "anomaly_score", F.try_element_at("probabilities", F.lit("NORMAL")).alias("p_normal"),
    )


@query(
    "box_pixels",
    "WITH " + MOTOR_HEAD + f""", b AS (SELECT vec_id, pc, {_boxed(6)} AS x1, {_boxed(7)} AS y1, {_boxed(8)} AS x2, {_boxed(9)} AS y2,
   {r('list_max(p)', 4)} AS top FROM head)
SELECT vec_id, {r('x1 * 2000e0', 3)} AS x, {r('y1 * 1280e0', 3)} AS y, {r('(x2 - x1) * 2000e0', 3)} AS w, {r('(y2 - y1) * 1280e0', 3)} AS h,
  pc || ' ' || CAST(CAST({r('top * 100e0', 0)} AS INTEGER) AS VARCHAR) || '%' AS label FROM b WHERE pc <> 'NORMAL'""",
)
def q_box_pixels(spark, sf):
    h = motor_head(spark, sf).filter(F.col("has_bbox"))
    p = F.try_element_at("probabilities", F.col("predicted_class"))
    box = health.box_pixels(F.col("bbox"), F.col("predicted_class"), p)
    out = h.select("vec_id", box.alias("b")).select("vec_id", "b.*")
    return out.withColumns({c: half_up(F.col(c), 3) for c in "xywh"})


@query(
    "polygon_box",
    f"""WITH pts AS (SELECT vec_id, label, CAST(embedding[2 * k + 1] AS DOUBLE) * 1000 AS px, CAST(embedding[2 * k + 2] AS DOUBLE) * 1000 AS py
  FROM embeddings, (SELECT unnest(range(0, 6)) AS k)),
b AS (SELECT vec_id, label, min(px) AS a, min(py) AS b, max(px) AS c, max(py) AS d FROM pts GROUP BY 1, 2)
SELECT vec_id, CASE WHEN label > 0 THEN {r('a / 2000', 6)} END AS x1, CASE WHEN label > 0 THEN {r('b / 1280', 6)} END AS y1,
       CASE WHEN label > 0 THEN {r('c / 2000', 6)} END AS x2, CASE WHEN label > 0 THEN {r('d / 1280', 6)} END AS y2 FROM b""",
)
def q_polygon(spark, sf):
    x = F.transform("embedding", lambda v: v.cast("double") * 1000)
    points = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.slice(F.col("_x"), k * 2 + 1, F.lit(2)))
    polys = F.when(F.col("label") > 0, F.array(points)).otherwise(F.array().cast("array<array<array<double>>>"))
    e = table(spark, sf, "embeddings").select("vec_id", "label", x.alias("_x")).withColumn("polygons", polys)
    box = health.polygon_box(F.col("polygons"), F.lit(2000), F.lit(1280))
    out = e.select("vec_id", box.alias("b")).select("vec_id", "b.*")
    return out.withColumns({c: half_up(F.col(c), 6) for c in ("x1", "y1", "x2", "y2")})


@query(
    "renormalised_shares",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_discount AS a, l_tax AS b, CASE WHEN l_returnflag = 'A' THEN 0.05e0 ELSE 0e0 END AS c FROM lineitem),
t AS (SELECT *, CASE WHEN a + b + c = 0 THEN 1e0 ELSE a + b + c END AS n FROM s)
SELECT l_orderkey, l_linenumber, """
    + f"{r('a / n', 6)} AS a, {r('b / n', 6)} AS b, {r('c / n', 6)} AS c FROM t",
)
def q_shares(spark, sf):
    li = table(spark, sf, "lineitem")
    c = F.when(F.col("l_returnflag") == "A", 0.05).otherwise(0.0)
    shares = renormalise([F.col("l_discount"), F.col("l_tax"), c])
    return li.select("l_orderkey", "l_linenumber", *[half_up(s, 6).alias(n) for s, n in zip(shares, "abc")])


# Responses: one per event, with the pack whose id the user maps to; users are spread over all packs.
def responses(spark, sf):
    return responses_of(spark, sf, table(spark, sf, "events"))


def responses_of(spark, sf, e):
    """Responses for a batch or stream of events; a response without its pack stays."""
    packs = max(1, table(spark, sf, "embeddings").count())  # from the file footers
    p = located(spark, sf).select(
        F.col("vec_id").alias("_pack"), "classification", "soh_proxy", F.col("fault_type").alias("pack_fault"),
        F.size("faulty_cells").alias("n_faulty"),
    )
    score = half_up(F.least("value", F.lit(100.0)), 1)
    flat = e.select(
        F.col("event_id").alias("response_id"), "ts", "user_id", "props",
        F.concat(F.lit("V"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("vehicle_id"),
        pick(VEHICLES, (F.col("user_id") % 3).cast("int")).alias("car_model"),
        score.alias("motor_score"),
        lookup(EVENT_FAULT, F.col("event_type")).alias("fault_type"),
        (F.col("user_id") % packs).alias("_pack"),
    )
    # The planner broadcasts the packs when their size allows, else adaptive execution splits hot keys.
    return (
        flat.join(p, "_pack", "left")
        .drop("_pack")
        .withColumn("motor_status", health.motor_status(F.col("motor_score")))
        .withColumn("battery_status", battery.status_of_class(F.col("classification")))
    )


RESP = LOCATED + f""",
resp AS (
  SELECT e.event_id AS response_id, e.ts, e.user_id, 'V' || lpad(CAST(e.user_id AS VARCHAR), 6, '0') AS vehicle_id,
    ['IONIQ','KONA','NIRO'][CAST(e.user_id % 3 AS INTEGER) + 1] AS car_model, {r('least(e.value, 100e0)', 1)} AS motor_score,
    CASE e.event_type WHEN 'view' THEN 'NORMAL' WHEN 'click' THEN 'ECC10' WHEN 'purchase' THEN 'ECC20' WHEN 'signup' THEN 'DEMAG' WHEN 'error' THEN 'REDUC' END AS fault_type,
    s.classification, s.soh_proxy, f.fault_type AS pack_fault, f.n_faulty, e.props
  FROM events e LEFT JOIN soh s ON s.vec_id = e.user_id % (SELECT count(*) FROM embeddings) LEFT JOIN faults f ON f.vec_id = s.vec_id),
response AS (
  SELECT *, CASE WHEN motor_score < 10e0 THEN 'normal' WHEN motor_score < 30e0 THEN 'caution' ELSE 'warning' END AS motor_status,
    CASE classification WHEN 'CAUTION' THEN 'caution' WHEN 'DEFECT' THEN 'warning' ELSE 'normal' END AS battery_status FROM resp)"""
_WORST = """CASE WHEN motor_status = 'warning' OR battery_status = 'warning' THEN 'warning'
  WHEN motor_status = 'caution' OR battery_status = 'caution' THEN 'caution' ELSE 'normal' END"""


@query(
    "responses",
    "WITH " + RESP + f""" SELECT response_id, vehicle_id, car_model, motor_score, motor_status, fault_type, classification, soh_proxy,
  battery_status, n_faulty, {_WORST} AS overall FROM response""",
)
def q_responses(spark, sf):
    return responses(spark, sf).select(
        "response_id", "vehicle_id", "car_model", "motor_score", "motor_status", "fault_type", "classification",
        "soh_proxy", "battery_status", "n_faulty",
        health.overall_status(F.col("motor_status"), F.col("battery_status")).alias("overall"),
    )


@query(
    "json_temperature",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS temperature,
  coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50, FALSE) AS hot, value / 1000 > 0.01 AS uneven FROM events""",
)
def q_json(spark, sf):
    e = table(spark, sf, "events")
    temp = F.from_json("props", "k double")["k"]
    uneven, hot = battery.metric_alarms(F.col("value") / 1000, temp)
    return e.select("event_id", temp.alias("temperature"), hot.alias("hot"), uneven.alias("uneven"))


@query(
    "channel_scores",
    "WITH " + PROBS + f""", s AS (SELECT vec_id, session, sensor, CASE WHEN cls = 4 THEN 0e0 WHEN cls = 3 THEN {r('abs(x[10]) * 100', 1)}
   ELSE {r('(1e0 - p[1]) * 100e0', 1)} END AS s FROM probs)
SELECT session, coalesce(max(CASE WHEN sensor = 'Current_U' THEN s END), 0) AS "Current_U",
  coalesce(max(CASE WHEN sensor = 'Vib_Motor' THEN s END), 0) AS "Vib_Motor",
  coalesce(max(CASE WHEN sensor = 'Vib_TM' THEN s END), 0) AS "Vib_TM" FROM s GROUP BY 1""",
)
def q_channels(spark, sf):
    p = probabilities(spark, sf)
    head = F.when(F.col("cls") == 3, F.abs(F.get("x", F.lit(9))) * 100)
    score = health.motor_score(head, F.get("probs", F.lit(0)), F.col("cls") != 4)
    return health.channel_scores(p.select("session", "sensor", score.alias("score")), keys=["session"])


# Channels of a motor response and their shares of its score in this view.
CHANNEL_SHARES = {"current_u": 1.0, "vib_motor": 0.5, "vib_tm": 0.25}


@query(
    "latest_response",
    "WITH " + RESP + f""",
motor AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, response_id DESC) AS rn FROM response),
fleet AS (SELECT max(user_id) + 1 AS vehicles FROM events),
bat AS (SELECT 'V' || lpad(CAST(vec_id % vehicles AS VARCHAR), 6, '0') AS vehicle_id, vec_id, min_cell_voltage, voltage_deviation, soh_proxy, classification, pack_type,
        row_number() OVER (PARTITION BY vec_id % vehicles ORDER BY vec_id DESC) AS rn FROM soh, fleet)
SELECT m.vehicle_id, m.car_model, m.response_id, m.motor_score AS motor_score, 10e0 AS threshold, m.motor_status, m.fault_type AS motor_fault, b.soh_proxy AS soh_proxy,
  b.classification AS classification, b.min_cell_voltage AS min_cell_voltage, CAST(NULL AS DOUBLE) AS temperature, f.n_faulty AS n_faulty,
  m.fault_type <> 'NORMAL' AS localised, {r('m.motor_score * 0.25e0', 1)} AS vib_tm,
  CASE WHEN m.fault_type <> 'NORMAL' THEN {r('1e0 - m.motor_score / 100e0', 4)} END AS p_motor_normal,
  CASE b.classification WHEN 'NORMAL' THEN 0.0251e0 WHEN 'CAUTION' THEN 0.1842e0 WHEN 'DEFECT' THEN 0.835e0 END AS p_defect,
  CASE WHEN b.classification = 'NORMAL' THEN 0e0 WHEN b.pack_type LIKE 'Dev%' THEN 0.915e0 WHEN b.pack_type IS NOT NULL THEN 0.055e0 END AS p_cell_deviation
FROM motor m LEFT JOIN (SELECT * FROM bat WHERE rn = 1) b USING (vehicle_id) LEFT JOIN faults f ON f.vec_id = b.vec_id WHERE m.rn = 1""",
)
def q_latest_response(spark, sf):
    """Newest motor result joined with the newest pack of each vehicle, nested and flattened again."""
    motor = health.latest(
        responses(spark, sf).select("vehicle_id", "car_model", "ts", "response_id", "motor_score", "fault_type"),
        ["vehicle_id"], ["ts", "response_id"],
    )
    box = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: i / 10.0)
    # The head's probabilities follow the score here; each channel's score is a share of it.
    p = F.col("motor_score") / 100.0
    motor = motor.withColumns({
        "bbox": box, "has_bbox": F.col("fault_type") != "NORMAL", "spectrogram_url": F.lit(None).cast("string"),
        "motor_probabilities": F.create_map(F.lit("NORMAL"), half_up(1.0 - p, 4), F.lit("FAULT"), half_up(p, 4)),
        "sensor_scores": F.struct(*[half_up(F.col("motor_score") * w, 1).alias(n) for n, w in CHANNEL_SHARES.items()])})
    vehicles = table(spark, sf, "events").agg(F.max("user_id") + 1).scalar()
    bat = located(spark, sf).select(
        F.concat(F.lit("V"), F.lpad((F.col("vec_id") % vehicles).cast("string"), 6, "0")).alias("vehicle_id"), "vec_id",
        "soh_proxy", "classification", F.col("fault_type").alias("pack_fault"), "faulty_cells", "cell_scores",
        "min_cell_voltage", "voltage_deviation", "temperature", "cell_count", "cell_mean_voltages",
        battery.stand_in_probabilities(F.col("classification")).alias("probabilities"),
        battery.stand_in_fault_probabilities(F.col("pack_type"), F.col("classification")).alias("fault_probabilities"),
    ).withColumn("battery_status", battery.status_of_class(F.col("classification")))
    bat = health.latest(bat, ["vehicle_id"], ["vec_id"])
    nested = health.assemble_response(motor.join(bat, "vehicle_id", "left").withColumn("ts", F.struct("ts", "response_id")))
    return nested.select(
        "vehicle_id", "car_model", F.col("timestamp.response_id").alias("response_id"),
        F.col("motor.anomaly_score").alias("motor_score"), F.col("motor.threshold").alias("threshold"),
        F.col("motor.status").alias("motor_status"), F.col("motor.fault_type").alias("motor_fault"),
        F.col("battery.soh_proxy").alias("soh_proxy"), F.col("battery.classification").alias("classification"),
        F.col("battery.metrics.min_cell_voltage").alias("min_cell_voltage"),
        F.col("battery.metrics.temperature").alias("temperature"),
        F.size("battery.faulty_cell_indices").alias("n_faulty"),
        F.col("motor.localization").isNotNull().alias("localised"),
        F.col("motor.sensor_scores.vib_tm").alias("vib_tm"),
        F.col("motor.localization.probabilities")["NORMAL"].alias("p_motor_normal"),
        F.col("battery.probabilities")["defect"].alias("p_defect"),
        F.col("battery.fault_probabilities")["cell_deviation"].alias("p_cell_deviation"),
    )


@query(
    "fleet",
    "WITH " + RESP + f""", latest AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, response_id DESC) AS rn FROM response)
SELECT vehicle_id, car_model, {_WORST} AS status, CAST(floor(epoch(TIMESTAMP '2024-02-01 00:00:00')) - floor(epoch(ts)) AS BIGINT) AS stale_seconds
FROM latest WHERE rn = 1""",
)
def q_fleet(spark, sf):
    return health.fleet(responses(spark, sf), F.lit("2024-02-01 00:00:00")).drop("last_seen")


@query(
    "fleet_filtered",
    "WITH " + RESP + f""", latest AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, response_id DESC) AS rn FROM response)
SELECT vehicle_id, car_model, {_WORST} AS status FROM latest WHERE rn = 1 AND car_model = 'KONA' AND {_WORST} = 'warning'""",
)
def q_fleet_filtered(spark, sf):
    return health.fleet(responses(spark, sf), F.lit("2024-02-01"), model="kona", status="WARNING").select(
        "vehicle_id", "car_model", "status"
    )


# Alerts
ALERTS = RESP + """,
motor_alert AS (
  SELECT sha256('motor|' || CAST(response_id AS VARCHAR)) AS id, ts, vehicle_id, car_model,
    CASE motor_status WHEN 'normal' THEN 'info' ELSE 'warning' END AS level, 'motor' AS component,
    CASE WHEN fault_type <> 'NORMAL' THEN printf('Motor anomaly detected: %s (score=%.1f)', fault_type, motor_score)
         ELSE printf('Motor operating normally (score=%.1f)', motor_score) END AS message, fault_type
  FROM response WHERE fault_type <> 'NORMAL' OR motor_score > 5e0),
pack_alert AS (
  SELECT sha256('battery|' || CAST(response_id AS VARCHAR)) AS id, ts, vehicle_id, car_model,
    CASE battery_status WHEN 'normal' THEN 'info' ELSE 'warning' END AS level, 'battery' AS component,
    CASE WHEN classification <> 'NORMAL' THEN printf('Battery %s: SOH=%.0f%%, %d fault cell(s)', classification, soh_proxy, n_faulty)
         ELSE printf('Battery healthy: SOH=%.0f%%', soh_proxy) END AS message, classification AS fault_type
  FROM response WHERE classification <> 'NORMAL' OR soh_proxy < 90e0),
alert AS (SELECT * FROM motor_alert UNION ALL SELECT * FROM pack_alert)"""
_ACOLS = "id, epoch_us(ts) AS ts_us, vehicle_id, car_model, level, component, message, fault_type"


def _stamped(df):
    return df.withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")


@query("alerts", "WITH " + ALERTS + f" SELECT {_ACOLS} FROM alert")
def q_alerts(spark, sf):
    return _stamped(alerts.response_alerts(responses(spark, sf)))


@query(
    "alerts_recent",
    "WITH " + ALERTS + f" SELECT {_ACOLS} FROM alert WHERE level = 'warning' AND component = 'motor' ORDER BY ts DESC, id LIMIT 50",
)
def q_recent(spark, sf):
    return _stamped(alerts.recent(alerts.response_alerts(responses(spark, sf)), level="WARNING", component="Motor"))


@query("alerts_retained", "WITH " + ALERTS + f" SELECT {_ACOLS} FROM alert ORDER BY ts DESC, id LIMIT 200")
def q_retained(spark, sf):
    return _stamped(alerts.keep_newest(alerts.response_alerts(responses(spark, sf)), 200))


@query(
    "alerts_merged",
    "WITH " + ALERTS + f""", old AS (SELECT * FROM alert WHERE ts < TIMESTAMP '2024-01-30 18:00:00'),
fresh AS (SELECT * FROM alert WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' AND id NOT IN (SELECT id FROM old))
SELECT {_ACOLS} FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh) ORDER BY ts DESC, id LIMIT 100""",
)
def q_merged(spark, sf):
    a = alerts.response_alerts(responses(spark, sf))
    ts = F.col("ts").cast("timestamp")
    old = a.filter(ts < F.lit("2024-01-30 18:00:00").cast("timestamp"))
    new = a.filter(ts >= F.lit("2024-01-30 12:00:00").cast("timestamp"))
    return _stamped(alerts.merge_alerts(old, new, 100))


@query("alert_levels", "WITH " + ALERTS + " SELECT level, count(*) AS n FROM alert GROUP BY 1")
def q_levels(spark, sf):
    return alerts.level_counts(alerts.response_alerts(responses(spark, sf)))


@query(
    "alert_level_map",
    """SELECT event_id, CASE lower(s) WHEN 'normal' THEN 'info' WHEN 'caution' THEN 'warning' WHEN 'warning' THEN 'warning'
  WHEN 'defect' THEN 'critical' WHEN 'critical' THEN 'critical' ELSE 'info' END AS level
FROM (SELECT event_id, ['Normal','CAUTION','warning','defect','Critical','odd'][CAST(event_id % 6 AS INTEGER) + 1] AS s FROM events)""",
)
def q_level_map(spark, sf):
    words = ["Normal", "CAUTION", "warning", "defect", "Critical", "odd"]
    return table(spark, sf, "events").select(
        "event_id", alerts.level_of(pick(words, (F.col("event_id") % 6).cast("int"))).alias("level")
    )


_LIVE = """CASE WHEN {first} THEN printf('Motor: MSE %.1f', motor_score) ELSE printf('Battery SOH %.{d}f', soh_proxy) END AS message"""


@query(
    "alerts_live",
    "WITH " + RESP + """ SELECT 'auto-' || CAST(response_id AS VARCHAR) AS id, epoch_us(ts) AS ts_us, vehicle_id, 'warning' AS level, """
    + _LIVE.format(first="motor_status = 'warning'", d=1)
    + " FROM response WHERE motor_status = 'warning' OR battery_status = 'warning'",
)
def q_live(spark, sf):
    return _stamped(alerts.live_alerts(responses(spark, sf)))


@query(
    "alerts_manual",
    "WITH " + RESP + """ SELECT 'fetch-' || CAST(response_id AS VARCHAR) AS id, epoch_us(ts) AS ts_us, vehicle_id,
  CASE WHEN motor_status = 'warning' OR battery_status = 'warning' THEN 'warning' ELSE 'caution' END AS level, """
    + _LIVE.format(first="motor_status <> 'normal'", d=0)
    + " FROM response WHERE motor_status <> 'normal' OR battery_status <> 'normal'",
)
def q_manual(spark, sf):
    return _stamped(alerts.live_alerts(responses(spark, sf), manual=True))


@query(
    "trend_last30",
    """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= 30""",
)
def q_trend(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return alerts.trend(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query(
    "trend_reset",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
   first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS now FROM events),
o AS (SELECT user_id, min(CASE WHEN event_type <> now THEN rn END) AS stop FROM n GROUP BY 1)
SELECT n.user_id, n.event_id, n.value FROM n JOIN o USING (user_id) WHERE n.rn < coalesce(o.stop, 1000000000) AND n.rn <= 30""",
)
def q_trend_reset(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    out = alerts.trend(e, ["user_id"], ["ts", "event_id"], reset_by="event_type")
    return out.select("user_id", "event_id", "value")


@query(
    "threshold_exceeded",
    """SELECT user_id, arg_max(value, (ts, event_id)) AS latest_score, arg_max(value, (ts, event_id)) > 10 AS exceeded FROM events GROUP BY 1""",
)
def q_exceeded(spark, sf):
    e = table(spark, sf, "events")
    return alerts.exceedance(e, ["user_id"], ["ts", "event_id"], "value", 10.0)


@query(
    "latest_per_sensor",
    """SELECT user_id AS unit, event_type AS sensor, arg_max(event_id, (ts, event_id)) AS seq, arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY 1, 2""",
)
def q_latest(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("unit"), F.col("event_type").alias("sensor"), "ts", F.col("event_id").alias("seq"), "value"
    )
    return health.latest(e, ["unit", "sensor"], ["ts", "seq"]).drop("ts")


