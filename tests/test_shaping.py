import numpy as np
import pytest
from pyspark.sql import functions as F

from drivepulse.operators import shaping
from drivepulse.operators.ranking import dense_position, exact_quantiles

KEYS = ["group_key", "chunk_id"]


def signal(spark, n, key="G", gaps=()):
    rng = np.random.default_rng(42)
    rows = [(key, "Vib_TM", i + 500, None if i in gaps else float(v)) for i, v in enumerate(rng.standard_normal(n))]
    return spark.createDataFrame(rows, "group_key string, sensor string, time_idx long, rms float")


def values(spark, items):
    rows = [("G", 0, i, None if v is None else float(v)) for i, v in enumerate(items)]
    return spark.createDataFrame(rows, "group_key string, chunk_id int, pos int, rms double")


def repaired(df):
    rows = shaping.repair_gaps(df, chunk=KEYS).orderBy("pos").collect()
    return [r["clean"] for r in rows]


@pytest.mark.parametrize("n,chunks", [(2000, 1), (4000, 2), (6000, 3), (10000, 5)])
def test_whole_recordings_are_cut(spark, n, chunks):
    rows = shaping.chunk_rows(signal(spark, n))
    found = rows.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    assert sorted(map(tuple, found.collect())) == [(i, 2000, 0, 1999) for i in range(chunks)]


def test_strict_rejects_and_lenient_drops_the_tail(spark):
    assert shaping.chunk_rows(signal(spark, 3000)).count() == 0
    assert shaping.chunk_rows(signal(spark, 3000), strict=False).count() == 2000


@pytest.mark.parametrize("size", [0, -1])
def test_chunk_size_must_be_positive(spark, size):
    with pytest.raises(ValueError, match="positive"):
        shaping.chunk_rows(signal(spark, 20), chunk_size=size)


def test_chunks_joined_again_are_the_signal(spark):
    s = signal(spark, 60)
    rows = shaping.repair_gaps(shaping.chunk_rows(s, chunk_size=20))
    chunks = shaping.assemble_chunks(rows)
    back = shaping.explode_chunk(chunks, ["group_key", "sensor", "chunk_id"])
    got = [r["v"] for r in back.orderBy("chunk_id", "pos").collect()]
    assert got == [r["rms"] for r in s.orderBy("time_idx").collect()]
    assert chunks.schema["x"].dataType.elementType.simpleString() == "float"


def test_interior_gaps_are_interpolated(spark):
    rng = np.random.default_rng(0)
    x = np.arange(2000, dtype=float)
    gaps = rng.choice(np.arange(10, 1990), 100, replace=False)
    holes = x.tolist()
    for g in gaps:
        holes[g] = None
    df = values(spark, holes)
    assert np.allclose(repaired(df), x)
    assert shaping.missing_ratio(df, chunk=KEYS).first()["missing_ratio"] == pytest.approx(0.05)


def test_valid_samples_stay(spark):
    assert repaired(values(spark, [3.0, 1.0, 2.0])) == [3.0, 1.0, 2.0]


def test_all_missing_becomes_zero(spark):
    df = values(spark, [None] * 5)
    assert repaired(df) == [0.0] * 5
    assert shaping.missing_ratio(df, chunk=KEYS).first()["missing_ratio"] == 1.0


def test_edges_take_the_nearest_value(spark):
    x = np.linspace(0, 1, 100).tolist()
    got = repaired(values(spark, [None] * 5 + x[5:95] + [None] * 5))
    assert got[:5] == [x[5]] * 5 and got[95:] == [x[94]] * 5


def test_nan_counts_as_missing(spark):
    df = values(spark, [1.0, float("nan"), 3.0])
    assert repaired(df) == [1.0, 2.0, 3.0]


def test_values_do_not_cross_a_chunk_border(spark):
    s = signal(spark, 40, gaps=range(18, 20))
    rows = shaping.repair_gaps(shaping.chunk_rows(s, chunk_size=20)).orderBy("chunk_id", "pos").collect()
    assert rows[18]["clean"] == rows[17]["clean"] == rows[19]["clean"]


@pytest.mark.parametrize("n,action", [(1500, "pad"), (2000, "no_op"), (2500, "truncate")])
def test_length_guard(spark, n, action):
    df = spark.createDataFrame([([float(i) for i in range(n)],)], "x array<double>")
    row = shaping.enforce_length(df).first()
    assert (len(row["x"]), row["length_action"], row["input_len"]) == (2000, action, n)
    assert row["x"][: min(n, 2000)] == [float(i) for i in range(min(n, 2000))]
    assert all(v == 0 for v in row["x"][n:])
    assert shaping.length_report(df).first()["n"] == 1


def test_length_target_must_be_positive(spark):
    with pytest.raises(ValueError):
        shaping.enforce_length(spark.createDataFrame([([1.0],)], "x array<double>"), 0)


def test_column_choice(spark):
    s = signal(spark, 5)
    assert shaping.signal_column(s, "rms").schema["rms"].dataType.simpleString() == "float"
    with pytest.raises(KeyError):
        shaping.signal_column(s, "voltage")
    with pytest.raises(KeyError):
        shaping.signal_column(s, "band_end")


def test_panel(spark):
    df = spark.createDataFrame([([1.0] * 2000,), ([1.0] * 1500,)], "x array<double>")
    shapes = [(len(r["panel"]), len(r["panel"][0])) for r in shaping.to_panel(df).collect()]
    assert shapes == [(1, 2000), (1, 2000)]
    with pytest.raises(ValueError):
        shaping.to_panel(df.limit(0))


def skewed(spark):
    """One key holds a third of the rows."""
    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("k"), ((F.col("id") * 7) % 900).alias("t")
    )


@pytest.mark.parametrize("width", [1, 40, 10_000])
def test_positions_do_not_depend_on_the_slices(spark, width):
    df = dense_position(skewed(spark), ["k"], ["t"], slice_by=F.floor(F.col("t") / width), size="n")
    got = {(r["k"], r["t"]): (r["pos"], r["n"]) for r in df.collect()}
    by_key = {}
    for k, t in got:
        by_key.setdefault(k, []).append(t)
    assert got == {(k, t): (i, len(ts)) for k, ts in by_key.items() for i, t in enumerate(sorted(ts))}
    assert len(got) == 900


def test_null_keys_are_ranked_like_others(spark):
    rows = [(None, t) for t in (5, 1, 90, None)] + [("a", t) for t in (70, 2)]
    df = spark.createDataFrame(rows, "k string, t int")
    out = dense_position(df, ["k"], ["t"], slice_by=F.floor(F.col("t") / 10), size="n")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(None, None, 0, 4), (None, 1, 1, 4), (None, 5, 2, 4), (None, 90, 3, 4), ("a", 2, 0, 2), ("a", 70, 1, 2)], key=str
    )


def test_no_job_runs_while_plans_are_built(spark):
    s = signal(spark, 400)
    spark.sparkContext.setJobGroup("plan", "plan")
    chunks = shaping.chunk_rows(s, chunk_size=20).select("group_key", "sensor", "chunk_id").distinct()
    steps = shaping.interleave(chunks)
    runs = shaping.stitch_fragments(chunks.withColumnRenamed("chunk_id", "fragment"), recording=["sensor"])
    found = spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    spark.sparkContext.setJobGroup("other", "other")
    assert steps.columns and runs.columns and not list(found)


def test_hot_recordings_chunk_like_others(spark):
    s = signal(spark, 400).unionByName(signal(spark, 40, "H"))
    plain = shaping.chunk_rows(s, chunk_size=20)
    sliced = shaping.chunk_rows(s, chunk_size=20, slice_by=F.floor(F.col("time_idx") / 64))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sliced.select(plain.columns).collect()))


@pytest.mark.parametrize("width", [0.01, 1.0, 50.0, 1e6])
def test_exact_quantiles(spark, width):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k, n in ((1, 101), (2, 2), (3, 1)) for v in np.round(rng.normal(0, 20, n), 1)]
    df = spark.createDataFrame(rows, "k int, v double")
    probs = (0.0, 0.025, 0.5, 0.95, 1.0)
    got = {(r["k"], r["prob"]): r["value"] for r in exact_quantiles(df, ["k"], "v", probs, width=width).collect()}
    for k in (1, 2, 3):
        xs = [v for kk, v in rows if kk == k]
        for p in probs:
            assert got[k, p] == pytest.approx(np.quantile(xs, p))


def test_round_robin_order(spark):
    sizes = {"Current_U": 2, "Vib_Motor": 4, "Vib_TM": 1}
    rows = [(s, f"g{i}", 0) for s, n in sizes.items() for i in range(n)] + [("other", "g0", 0)]
    df = spark.createDataFrame(rows, "sensor string, group_key string, chunk_id int")
    out = shaping.interleave(df).orderBy("step").collect()
    assert [r["step"] for r in out] == list(range(7))
    assert [r["sensor"] for r in out] == [
        "Current_U", "Vib_Motor", "Vib_TM", "Current_U", "Vib_Motor", "Vib_Motor", "Vib_Motor"
    ]


def test_stitching_runs(spark):
    rows = [("a", n, 10) for n in (1, 2, 3, 7, 8, 20)]
    df = spark.createDataFrame(rows, "rec string, fragment int, size int")
    out = shaping.stitch_fragments(df, recording=["rec"], size="size").orderBy("run").collect()
    assert [(r["run"], r["first_fragment"], r["last_fragment"], r["n_rows"]) for r in out] == [
        (1, 1, 3, 30), (2, 7, 8, 20), (3, 20, 20, 10)
    ]


def test_fusion_cuts_to_the_shortest_and_drops_incomplete(spark):
    rows = [("s", "Current_U", [[1.0] * 7] * 4), ("s", "Vib_Motor", [[2.0] * 5] * 4), ("s", "Vib_TM", [[3.0] * 6] * 4),
            ("t", "Vib_TM", [[3.0] * 6] * 4)]
    df = spark.createDataFrame(rows, "session string, sensor string, channels array<array<double>>")
    fused = shaping.fuse_sensors(df, session=["session"])
    (row,) = fused.collect()
    assert (row["session"], row["length"], len(row["fused"])) == ("s", 5, 12)
    assert [c[0] for c in row["fused"]] == [1.0] * 4 + [2.0] * 4 + [3.0] * 4
    assert [len(r["fused"][0]) for r in shaping.panel_chunks(fused, ["session"], 2).collect()] == [2, 2]
    assert shaping.panel_chunks(fused, ["session"], 6).count() == 0
