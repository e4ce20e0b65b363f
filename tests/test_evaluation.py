"""Published confusion matrices as inputs and their published summaries as results."""

import numpy as np
import pytest

from drivepulse.operators import evaluation as ev

# Summed confusion matrices, rows true, columns predicted.
ORDER = ("DEMAG", "ECC10", "ECC20", "NORMAL", "REDUC")
MATRICES = {
    "IONIQ": [[3168, 0, 0, 42, 0], [4, 2559, 45, 4, 0], [1, 43, 2763, 0, 0], [63, 4, 0, 3246, 0], [0, 0, 0, 0, 2956]],
    "KONA": [[3045, 0, 4, 199, 2], [0, 2732, 14, 3, 1], [3, 15, 2736, 1, 0], [245, 4, 2, 2848, 1], [1, 3, 0, 8, 3099]],
    "NIRO": [[3216, 2, 0, 192, 6], [1, 3934, 26, 0, 0], [2, 48, 3015, 0, 0], [319, 1, 0, 2927, 2], [2, 0, 0, 1, 3102]],
}


@pytest.fixture(scope="module")
def cells(spark):
    rows = [
        (v, ORDER[i], ORDER[j], n) for v, m in MATRICES.items() for i, row in enumerate(m) for j, n in enumerate(row) if n
    ]
    return spark.createDataFrame(rows, "vehicle string, true_label string, predicted_label string, n long")


def test_recalls_and_directed_errors(cells):
    out = {r["vehicle"]: r for r in ev.directed_confusion(cells, ["vehicle"]).collect()}
    assert [round(out[v]["recall"], 4) for v in MATRICES] == [0.9869, 0.9369, 0.9415]
    assert sum(r["a_to_b"] for r in out.values()) == 433
    assert sum(r["b_to_a"] for r in out.values()) == 627


def test_report_matches_the_matrix(spark, cells):
    from pyspark.sql import functions as F

    samples = cells.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n", "i")
    report = {(r["vehicle"], r["label"]): r for r in ev.classification_report(samples, ["vehicle"]).collect()}
    for v, m in MATRICES.items():
        m = np.array(m, dtype=float)
        f1 = 2 * np.diag(m) / (m.sum(0) + m.sum(1))
        assert report[v, "macro avg"]["f1"] == pytest.approx(f1.mean())
        assert report[v, "accuracy"]["f1"] == pytest.approx(np.trace(m) / m.sum())
        for i, c in enumerate(ORDER):
            assert report[v, c]["recall"] == pytest.approx(m[i, i] / m[i].sum())
            assert report[v, c]["support"] == m[i].sum()
    matrix = ev.confusion_matrix(samples, ["vehicle"]).filter("vehicle = 'KONA' and true_label = 'REDUC'").first()
    assert [matrix[c] for c in ORDER] == MATRICES["KONA"][4]


def test_error_reduction(spark):
    rows = [("51", 704, 758, 1462), ("87", 433, 627, 1060)]
    df = spark.createDataFrame(rows, "model string, a_to_b long, b_to_a long, both_ways long")
    out = ev.error_reduction(df, "model", "51", "87").first()
    assert round(out["a_to_b_reduction"], 1) == 38.5 and round(out["both_ways_reduction"], 1) == 27.5


def test_paired_comparison(spark):
    df = spark.createDataFrame([(16046, 477, 386)], "n long, n10 long, n01 long")
    out = ev.mcnemar_p(ev.effect_size(df)).first()
    assert round(out["delta"] * 100, 4) == 0.5671
    assert round(out["mcnemar"], 3) == 9.386
    assert round(out["p_value"], 4) == 0.0022


@pytest.fixture(scope="module")
def sessions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 40, int(a), int(b)) for i, (a, b) in enumerate(zip(rng.poisson(1.2, 300), rng.poisson(1.0, 300)))]
    return spark.createDataFrame(rows, "session long, n long, n10 long, n01 long"), rows


def test_hashed_and_multinomial_bootstrap_agree(sessions):
    df, rows = sessions
    hashed = ev.bootstrap_interval(ev.bootstrap_draws(df, 2000)).first()
    drawn = ev.bootstrap_interval(ev.bootstrap_multinomial(df, 4000)).first()
    d = np.array([a - b for _, _, a, b in rows]) / 40
    spread = d.std() / np.sqrt(len(d))
    for q, z in (("ci_low", -1.96), ("ci_high", 1.96)):
        assert hashed[q] == pytest.approx(d.mean() + z * spread, abs=0.25 * spread)
        assert drawn[q] == pytest.approx(d.mean() + z * spread, abs=0.25 * spread)


def test_permutation_forms_agree(sessions):
    df, _ = sessions
    a = ev.permutation_p(ev.permutation_deltas(df, 2000)).first()
    b = ev.permutation_p(ev.permutation_binomial(df, 4000)).first()
    assert a["observed"] == pytest.approx(b["observed"])
    assert a["p_value"] == pytest.approx(b["p_value"], abs=0.04)


def test_bootstrap_draws_brute_force(spark, monkeypatch):
    def mix(x):
        for _ in range(2):
            x = ((x >> 16 ^ x) * 0x45D9F3B) & 0xFFFFFFFF
        return x >> 16 ^ x

    rows = [(0, 2, 1, 0), (1, 3, 0, 2), (2, 1, 0, 0), (3, 2, 2, 0)] + [(i, 2, i % 3, 0) for i in range(4, 90)]
    df = spark.createDataFrame(rows, "session long, n long, n10 long, n01 long")
    pool = sorted((a - b, n) for _, n, a, b in rows)
    total = len(pool)

    def words(rep, count):
        return [mix(mix(rep ^ 7) ^ i) for i in range(count)]

    for tables, step in ((1 << 21, 1 << 14), (0, 1 << 14), (0, 2)):
        monkeypatch.setattr(ev, "TABLE_PLACES", tables)
        monkeypatch.setattr(ev, "DRAW_STEP", step)
        got = {r["replicate"]: r["delta"] for r in ev.bootstrap_draws(df, 20, 7).collect()}
        flipped = {r["replicate"]: r["delta"] for r in ev.permutation_deltas(df, 20, 7).collect()}
        size = sum(n for _, n in pool)
        assert flipped.pop(-1) == pytest.approx(sum(d for d, _ in pool) / size) and len(got) == len(flipped) == 20
        for rep in range(20):
            picks = [pool[w * total >> 32] for w in words(rep, total)]
            assert got[rep] == pytest.approx(sum(d for d, _ in picks) / sum(n for _, n in picks))
            bits = words(rep, -(-total // 32))
            assert flipped[rep] == pytest.approx(sum(d * (1 if bits[i // 32] >> (i % 32) & 1 else -1) for i, (d, _) in enumerate(pool)) / size)


def test_pools_too_large_for_a_task(spark, monkeypatch):
    monkeypatch.setattr(ev, "POOL_PROFILES", 5)
    rows = [(i, 10 + i, i % 7, i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "session long, n long, n10 long, n01 long")
    assert ev.bootstrap_draws(df, 30, 3).count() == 30 and ev.permutation_deltas(df, 30, 3).count() == 31
    assert ev.bootstrap_draws(df.limit(0), 30).collect() == ev.permutation_deltas(df.limit(0), 30).collect() == []


def test_bootstrap_takes_any_number_of_profiles(spark):
    """2,500 sessions of different (difference, size): no limit, and the same draws as by hand."""
    rows = [(i, 10 + i, i % 7, i % 3) for i in range(2500)]
    df = spark.createDataFrame(rows, "session long, n long, n10 long, n01 long")
    deltas = [r["delta"] for r in ev.bootstrap_draws(df, 40, 3).collect()]
    whole = sum(a - b for _, _, a, b in rows) / sum(n for _, n, _, _ in rows)
    assert len(deltas) == 40 and np.mean(deltas) == pytest.approx(whole, rel=0.2)


@pytest.mark.parametrize("block", [16, 4096])
def test_profile_forms_take_any_number_of_profiles(spark, monkeypatch, block):
    """More profiles than a block (and than the former limit, set low here): the distribution of the hand-made draws."""
    monkeypatch.setattr(ev, "LISTED_PROFILES", 10, raising=False)
    monkeypatch.setattr(ev, "PROFILE_BLOCK", block, raising=False)
    rows = [(i, 20 + i % 50, i % 7, i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "session long, n long, n10 long, n01 long")
    d, n = np.array([a - b for _, _, a, b in rows]), np.array([r[1] for r in rows])
    rng = np.random.default_rng(5)
    picks = rng.integers(0, 400, (3000, 400))
    want = d[picks].sum(1) / n[picks].sum(1)
    got = {r["replicate"]: r["delta"] for r in ev.bootstrap_multinomial(df, 3000).collect()}
    assert sorted(got) == list(range(3000))
    assert np.mean(list(got.values())) == pytest.approx(want.mean(), abs=0.1 * want.std())
    assert np.std(list(got.values())) == pytest.approx(want.std(), rel=0.08)
    flipped = {r["replicate"]: r["delta"] for r in ev.permutation_binomial(df, 3000).collect()}
    assert sorted(flipped) == list(range(-1, 3000))
    assert flipped.pop(-1) == pytest.approx(d.sum() / n.sum())
    assert np.std(list(flipped.values())) == pytest.approx(np.sqrt((d * d).sum()) / n.sum(), rel=0.08)


def test_registered_sizes_are_the_published_ones(spark):
    from drivepulse.plans import evaluation_queries, model_queries

    assert evaluation_queries.REPLICATES == 100_000
    assert model_queries.SWEEP == (1_176, 2_436, 4_956, 9_996) and model_queries.MAX_ITER == 1_000
    scored = model_queries._split_scored(spark, "/root/testdata/sf0.001", (84,), 2)
    assert scored.count() == scored.select("key").distinct().count() == 500


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "cls int")
    out = {r["cls"]: r["weight"] for r in ev.balanced_weights(df).collect()}
    assert out == {0: 8 / 12, 1: 8 / 4}


def test_design_effect_without_correlation(spark):
    rng = np.random.default_rng(0)
    x = (rng.random((400, 41)) < 0.7).astype(float)
    rows = [(41.0, float(r.sum()), float((r * r).sum())) for r in x]
    out = ev.design_effect(spark.createDataFrame(rows, "n double, s double, ss double")).first()
    assert abs(out["icc"]) < 0.01 and out["mean_size"] == 41


def test_the_table_of_draws_does_not_grow_with_the_sessions():
    pool = ev._Pool([{"d": d, "n": n, "sessions": 70_001 + 13 * d + n} for d in range(-3, 4) for n in range(1, 7)], 5)
    reps = np.arange(2)
    over, under = pool.drawn(reps)
    assert pool.total > 1 << 21 and len(pool._table) <= 1 << 16
    for i in reps:
        words = np.concatenate([pool.words(reps[i : i + 1], low, min(low + (1 << 18), pool.total))[0] for low in range(0, pool.total, 1 << 18)])
        met = np.searchsorted(pool.upto, words.astype("uint64") * np.uint64(pool.total) >> np.uint64(32), "right")
        assert over[i] == pool.d[met].sum() and under[i] == pool.n[met].sum()
