import numpy as np
import pytest
from pyspark.sql import functions as F

from drivepulse.functions.scalars import half_up
from drivepulse.operators import alerts, battery, health


def packs(spark, *matrices):
    df = spark.createDataFrame([(i, np.asarray(m, dtype=float).tolist()) for i, m in enumerate(matrices)], "id int, m array<array<double>>")
    return battery.pack_metrics(battery.with_moments(df), temperature=F.lit(41.26))


def rows(df):
    return df.orderBy("id").collect()


def uniform(cells=96, steps=20):
    return np.full((steps, cells), 3.9)


def one_low():
    m = uniform()
    m[:, 7] = 3.2
    return m


def one_shaky():
    m = uniform(98)
    m[::2, 5] += 0.1
    m[1::2, 5] -= 0.1
    return m


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(5)
    ms = [rng.normal(3.8, 0.05, (20, 96)), rng.normal(3.6, 0.1, (18, 98)), uniform()]
    for m, r in zip(ms, rows(packs(spark, *ms))):
        assert r["min_cell_voltage"] == pytest.approx(m.min(), abs=5.1e-4)
        assert r["v_spread"] == pytest.approx(m.std(axis=1).mean())
        assert np.allclose(r["cell_mean"], m.mean(axis=0)) and np.allclose(r["cell_std"], m.std(axis=0))
        assert (r["cell_count"], r["temperature"]) == (m.shape[1], 41.3)


def locate(spark, *ms, kind="Vlt_96", cls="DEFECT", predicted=None):
    df = battery.locate_faults(
        packs(spark, *ms), classification=F.lit(cls), pack_type=F.lit(kind),
        predicted=None if predicted is None else F.lit(predicted),
    )
    return [(r["fault_type"], r["faulty_cells"], r["cell_scores"]) for r in rows(df)]


def test_low_cell(spark):
    (flat, low) = locate(spark, uniform(), one_low())
    assert flat[:2] == ("cell_voltage", [0])
    assert low[1] == [7] and low[2][7] == 1.0 and max(low[2][:7]) == 0.0


def test_shaky_cell(spark):
    ((fault, cells, scores),) = locate(spark, one_shaky(), kind="Dev_98")
    assert (fault, cells, scores[5]) == ("cell_deviation", [5], 1.0)


def test_dispatch(spark):
    assert locate(spark, one_low(), cls="NORMAL") == [("none", [], [0.0] * 96)]
    assert locate(spark, one_low(), kind="Dev_96", predicted="cell_voltage")[0][:2] == ("cell_voltage", [7])
    assert locate(spark, one_shaky(), kind="Dev_98", predicted="none")[0][0] == "cell_deviation"


def test_random_packs_match_numpy(spark):
    rng = np.random.default_rng(11)
    ms = [rng.normal(3.55, 0.05, (20, 96)) for _ in range(6)]
    for m, (_, cells, scores) in zip(ms, locate(spark, *ms)):
        mean = m.mean(axis=0)
        z = (mean - mean.mean()) / (mean.std() + 1e-9)
        raw = np.clip(-z, 0, None)
        flags = (mean < 3.5) | (z < -2)
        want = np.where(flags)[0].tolist() if flags.any() else [int(mean.argmin())]
        assert cells == want and np.allclose(scores, raw / (raw.max() + 1e-9), atol=1e-4)


@pytest.mark.parametrize(
    "dev,v,cls,soh",
    [(0.0, 4.2, "NORMAL", 100.0), (0.10, 3.0, "DEFECT", 60.0), (0.05, 3.6, "CAUTION", 80.0), (0.5, 2.0, "DEFECT", 60.0), (0.0, 4.3, "odd", 95.0)],
)
def test_soh(spark, dev, v, cls, soh):
    got = spark.range(1).select(battery.soh_proxy(F.lit(dev), F.lit(v), F.lit(cls))).first()[0]
    assert got == soh


def test_network_input_shapes(spark):
    for steps, cells in ((18, 96), (25, 98), (20, 100)):
        m = packs(spark, uniform(cells, steps)).select(battery.network_input(F.col("m")).alias("n")).first()["n"]
        a = np.array(m)
        assert a.shape == (20, 98)
        assert np.allclose(a[: min(steps, 20), : min(cells, 98)], 0.75) and a[min(steps, 20) :].sum() == 0


def test_rule_class(spark):
    cases = [(3.29, 0.0, "DEFECT"), (3.3, 0.051, "DEFECT"), (3.69, 0.0, "CAUTION"), (3.7, 0.021, "CAUTION"), (3.7, 0.02, "NORMAL")]
    df = spark.createDataFrame(cases, "v double, s double, want string")
    assert all(r[0] == r[1] for r in df.select(battery.rule_class(F.col("v"), F.col("s")), "want").collect())


def column(spark, values, fn):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_threshold_edges(spark):
    assert column(spark, [0.299, 0.3, 0.7, 0.701], health.gauge_band) == ["normal", "caution", "caution", "warning"]
    assert column(spark, [0.299, 0.3, 0.7, 0.701], health.log_band) == ["normal", "caution", "warning", "warning"]
    assert column(spark, [9.99, 10, 29.99, 30], health.motor_status) == ["normal", "caution", "caution", "warning"]
    assert column(spark, [29.9, 30, 70, 70.1], health.sensor_band) == ["normal", "caution", "caution", "warning"]
    assert column(spark, [80, 79.9, 60, 59.9], battery.soh_band) == ["normal", "caution", "caution", "warning"]
    assert column(spark, [0.71, 0.41, 0.21, 0.2], lambda s: battery.cell_severity(s, F.lit(False))) == ["severe", "high", "raised", "calm"]
    assert column(spark, [-3, 50, 130], health.display_percent) == [0.0, 50.0, 100.0]
    assert column(spark, [0.5, 1.5, 2.4], lambda v: half_up(v, 0)) == [1.0, 2.0, 2.0]


def test_integrated_score(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4), (1, 0.9), (2, None)], "u int, score double")
    out = {r["u"]: r for r in health.integrate(df, keys=["u"]).collect()}
    assert (out[1]["integrated"], out[1]["points"]) == (0.66, 66)
    assert out[2]["integrated"] is None and out[2]["points"] is None


def test_heads(spark):
    df = spark.createDataFrame([(0, [9.0, 1.0, 1.0], [1.0, 5.0, 1.0]), (1, [1.0, 1.0, 9.0], [1.0, 5.0, 1.0])], "id int, s array<double>, f array<double>")
    a, b = rows(battery.head_result(df, F.col("s"), F.col("f")))
    assert (a["status"], a["fault_type"]) == ("CAUTION", "cell_voltage")
    assert (b["status"], b["fault_type"]) == ("NORMAL", "none")
    assert set(a["status_probabilities"]) == {"caution", "defect", "normal"}
    m = spark.createDataFrame([(0, [1.0, 1.0, 1.0, 9.0, 1.0]), (1, [9.0, 1.0, 1.0, 1.0, 1.0])], "id int, l array<double>")
    box = F.array(*[F.lit(v) for v in (0.1, 0.2, 0.3, 0.4)])
    n, d = rows(health.head_result(m, F.col("l"), box, F.lit(0.4567)))
    assert (n["predicted_class"], n["has_bbox"], n["bbox"]) == ("NORMAL", False, [0.0] * 4)
    assert (d["predicted_class"], d["bbox"], d["anomaly_score"]) == ("DEMAG", [0.1, 0.2, 0.3, 0.4], 45.7)


def response(spark, *cases):
    cols = "response_id long, ts timestamp, vehicle_id string, car_model string, fault_type string, motor_score double, motor_status string, classification string, soh_proxy double, battery_status string, n_faulty int"
    data = [(i, None, "V1", "KONA", *c) for i, c in enumerate(cases)]
    return spark.createDataFrame(data, cols)


def test_alert_cases(spark):
    r = response(
        spark,
        ("NORMAL", 5.0, "normal", "NORMAL", 90.0, "normal", 0),
        ("NORMAL", 5.1, "normal", "NORMAL", 89.9, "normal", 0),
        ("ECC20", 20.0, "caution", "DEFECT", 72.5, "warning", 2),
        ("NORMAL", 1.0, "normal", "DEFECT", 61.0, "defect", 1),
    )
    out = [(a["level"], a["component"], a["message"], a["fault_type"]) for a in alerts.response_alerts(r).collect()]
    assert sorted(out) == sorted([
        ("info", "motor", "Motor operating normally (score=5.1)", "NORMAL"),
        ("info", "battery", "Battery healthy: SOH=90%", "NORMAL"),
        ("warning", "motor", "Motor anomaly detected: ECC20 (score=20.0)", "ECC20"),
        ("warning", "battery", "Battery DEFECT: SOH=72%, 2 fault cell(s)", "DEFECT"),
        ("critical", "battery", "Battery DEFECT: SOH=61%, 1 fault cell(s)", "DEFECT"),
    ])


def test_merge_and_retention(spark):
    a = spark.createDataFrame([(f"a{i}", i) for i in range(150)], "id string, ts int")
    b = spark.createDataFrame([(f"a{i}", i) for i in range(140, 160)], "id string, ts int")
    merged = alerts.merge_alerts(a, b, 100).collect()
    assert [r["ts"] for r in merged] == list(range(159, 59, -1))
    assert alerts.keep_newest(a, 0).count() == 0
    with pytest.raises(ValueError):
        alerts.recent(a, limit=201)


def test_trend_restarts_after_a_change(spark):
    data = [("v", i, "KONA" if i < 40 else "NIRO") for i in range(45)] + [("w", i, "KONA") for i in range(45)]
    df = spark.createDataFrame(data, "v string, t int, model string")
    plain = alerts.trend(df, ["v"], ["t"])
    assert {r["v"]: r["count"] for r in plain.groupBy("v").count().collect()} == {"v": 30, "w": 30}
    fresh = alerts.trend(df, ["v"], ["t"], reset_by="model")
    assert {r["v"]: r["count"] for r in fresh.groupBy("v").count().collect()} == {"v": 5, "w": 30}


def test_limits_per_key_are_applied_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = alerts.keep_newest_per(df, ["k"], [F.col("id").desc()], 30)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
