"""Splits, random-convolution features, models, spectra and streams."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivepulse.functions.domains import CLASSES, SENSORS
from drivepulse.operators import models, rocket, spectral, splits
from drivepulse.streaming import streams


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(s, f"g{i}", CLASSES[i % 5]) for s in SENSORS for i in range(27)]
    return spark.createDataFrame(rows, "sensor string, grp string, fault string")


def test_holdout_shape_and_disjointness(groups):
    s = splits.group_holdout(groups, by="sensor", group="grp", label="fault")
    sides = {(r["sensor"], r["side"]): r["count"] for r in s.groupBy("sensor", "side").count().collect()}
    assert all(sides[n, "train"] == 21 and sides[n, "val"] == 6 for n in SENSORS)
    splits.assert_no_leak(s, by="sensor", group="grp")
    tried = splits.holdout_trials(groups, by="sensor", group="grp", label="fault")
    assert tried.groupBy("sensor", "seed", "grp").count().filter("count > 1").count() == 0
    counts = {(r["sensor"], r["seed"], r["side"]): r["count"] for r in tried.groupBy("sensor", "seed", "side").count().collect()}
    assert all(n == (21 if side == "train" else 6) for (_, _, side), n in counts.items())


def test_holdout_errors(spark, groups):
    with pytest.raises(Exception, match="fewer than five"):
        splits.group_holdout(groups.filter("grp in ('g0', 'g1')"), by="sensor", group="grp", label="fault").collect()
    lone = groups.withColumn("fault", F.lit("NORMAL"))
    with pytest.raises(Exception, match="no accepted split"):
        splits.group_holdout(lone, by="sensor", group="grp", label="fault").collect()


def test_leak_is_reported(spark):
    bad = spark.createDataFrame([("a", "g", "train"), ("a", "g", "val")], "s string, g string, side string")
    with pytest.raises(AssertionError, match="g"):
        splits.assert_no_leak(bad, by="s", group="g")


def test_folds_are_balanced(spark):
    df = spark.range(6000).select((F.col("id") % 300).alias("g"), (F.col("id") % 5).alias("y"))
    f = splits.stratified_folds(df, group="g", label="y")
    per = [r["count"] for r in f.groupBy("y", "fold").count().collect()]
    assert f.count() == 300 and max(per) - min(per) <= 1


def test_folds_of_groups_with_several_classes(spark):
    """Each class is spread over the folds, although groups mix two of them in unlike sizes."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(400):
        first, second = rng.choice(5, 2, replace=False)
        rows += [(g, CLASSES[first])] * int(rng.integers(1, 90)) + [(g, CLASSES[second])] * int(rng.integers(0, 40))
    rows += [(None, CLASSES[0]), (None, None), (7, "other")]
    df = spark.createDataFrame(rows, "g int, y string")
    for block in (10_000, 50):
        f = splits.class_balanced_folds(df, group="g", label="y", block=block)
        fold = {r["g"]: r["fold"] for r in f.collect()}
        assert len(fold) == 401 and f.agg(F.sum("size")).first()[0] == len(rows)
        for c in CLASSES:
            per = np.bincount([fold[g] for g, y in rows if y == c], minlength=3)
            assert per.max() - per.min() <= 0.05 * per.sum()
    # Groups that do not differ are dealt in whole rounds.
    same = spark.range(3000).select((F.col("id") % 300).alias("g"), F.lit(CLASSES[1]).alias("y"))
    assert [r["count"] for r in splits.class_balanced_folds(same, group="g", label="y").groupBy("fold").count().collect()] == [100] * 3
    assert splits.class_balanced_folds(df.limit(0), group="g", label="y").count() == 0


def test_balanced_sample_is_even_over_drives(spark):
    df = spark.range(1000).select(F.lit("c").alias("c"), F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 10).alias("d"), "id")
    out = splits.balanced_sample(df, cell=["c"], drive="d", key="id", cap=60)
    counts = [r["count"] for r in out.groupBy("d").count().collect()]
    assert sum(counts) == 60 and max(counts) - min(counts) <= 1


def test_standardiser_uses_other_folds_only(spark):
    rng = np.random.default_rng(2)
    data = [(i % 3, "s", rng.normal(i % 3, 1, 10).tolist()) for i in range(30)]
    df = spark.createDataFrame(data, "fold int, ch string, x array<double>")
    for r in splits.standardiser(df, fold="fold", channel="ch").collect():
        rest = np.concatenate([x for f, _, x in data if f != r["fold"]])
        assert r["mean"] == pytest.approx(rest.mean()) and r["std"] == pytest.approx(rest.std())


# Random convolutions
def brute_force(x, plan):
    """x: (channels, time); plain loops over kernels, positions and taps."""
    feats = []
    for p, d, k in plan.pairs():
        w = np.full(9, -1.0)
        w[list(rocket.KERNELS[k])] = 2.0
        dil, t_max = plan.dilations[d], plan.length
        out = np.zeros(t_max)
        for t in range(t_max):
            for j in range(9):
                s = t + (j - 4) * dil
                if 0 <= s < t_max:
                    out[t] += w[j] * sum(x[c][s] for c in plan.subsets[p])
        if (d + k) % 2 == 1 and t_max > 8 * dil:
            out = out[4 * dil : t_max - 4 * dil]
        feats += [float((out > b).mean()) for b in plan.biases[p]]
    return feats


@pytest.mark.parametrize("channels", [1, 3])
def test_transform_equals_brute_force(spark, channels):
    rng = np.random.default_rng(4)
    xs = rng.normal(size=(6, channels, 40))
    data = [(i, xs[i].tolist() if channels > 1 else xs[i, 0].tolist()) for i in range(6)]
    kind = "array<array<double>>" if channels > 1 else "array<double>"
    df = spark.createDataFrame(data, f"id long, x {kind}")
    plan = rocket.fit_biases(df, rocket.make_plan(40, n_features=252, channels=channels), key="id")
    assert plan.n_features == 252 and len(plan.biases) == len(plan.pairs())
    out = {r["id"]: r["features"] for r in rocket.transform(df, plan, keys=["id"]).collect()}
    for i in (0, 5):
        assert np.allclose(out[i], brute_force(xs[i], plan), atol=0.026)
        assert np.mean(np.abs(np.array(out[i]) - brute_force(xs[i], plan))) < 1e-4


@pytest.mark.parametrize("asked,made", [(10_000, 9_996), (5_000, 4_956), (2_500, 2_436), (1_200, 1_176)])
def test_feature_counts(asked, made):
    plan = rocket.make_plan(2000, n_features=asked)
    assert plan.n_features == made
    assert plan.dilations[0] == 1 and max(plan.dilations) <= (2000 - 1) // 8


def test_feature_cache(spark, tmp_path):
    df = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=32).tolist()) for i in range(4)], "id long, x array<double>")
    plan = rocket.fit_biases(df, rocket.make_plan(32, n_features=84), key="id")
    a = rocket.cached_features(df, plan, str(tmp_path), keys=["id"])
    b = rocket.cached_features(df, plan, str(tmp_path), keys=["id"])
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert len(list(tmp_path.iterdir())) == 1
    rocket.cached_features(df.filter("id > 0"), plan, str(tmp_path), keys=["id"])
    assert len(list(tmp_path.iterdir())) == 2


# Models
@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(8)
    data = [(i, SENSORS[i % 2], i % 5, (rng.normal(0, 0.3, 4) + np.eye(5)[i % 5][:4] * 3).tolist()) for i in range(200)]
    df = spark.createDataFrame(data, "id int, sensor string, cls int, features array<double>")
    return df, models.train_slots(df, SENSORS[:2], max_iter=50)


def test_models_separate_the_classes(spark, trained):
    df, fitted = trained
    out = models.verdicts(models.linear_probabilities(df, models.coefficient_table(spark, fitted)))
    wrong = out.filter(F.col("predicted_id") != F.col("cls")).count()
    assert wrong < 10
    row = out.first()
    assert sum(row["class_probs"].values()) == pytest.approx(1.0) and row["model_key"].startswith("pilot_")
    assert row["anomaly_score"] == pytest.approx(1 - row["class_probs"]["NORMAL"])


def test_coefficient_scoring_equals_model_scoring(spark, trained):
    df, fitted = trained
    a = {r["id"]: r["probs"] for r in models.score_models(df, fitted).collect()}
    b = {r["id"]: r["probs"] for r in models.linear_probabilities(df, models.coefficient_table(spark, fitted)).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i]) for i in a)


def test_model_store(spark, trained, tmp_path):
    _, fitted = trained
    with pytest.raises(FileNotFoundError):
        models.ModelStore(spark, str(tmp_path / "none")).load("Vib_TM")
    models.ModelStore(spark, str(tmp_path)).save(fitted)
    store = models.ModelStore(spark, str(tmp_path))
    again = store.load_all(SENSORS[:2])
    assert np.allclose(again["Current_U"].coefficientMatrix.toArray(), fitted["Current_U"].coefficientMatrix.toArray())
    with pytest.raises(KeyError, match="Vib_TM"):
        store.load("Vib_TM")


def test_model_store_keeps_slots_of_earlier_saves(spark, trained, tmp_path):
    _, fitted = trained
    first, second = SENSORS[:2]
    models.ModelStore(spark, str(tmp_path)).save({first: fitted[first]})
    models.ModelStore(spark, str(tmp_path)).save({second: fitted[second]})
    store = models.ModelStore(spark, str(tmp_path))
    assert {r["slot"] for r in store.table().collect()} == {first, second}
    assert store.load(first).numFeatures == store.load(second).numFeatures


def test_half_written_features_are_made_anew(spark, tmp_path):
    rng = np.random.default_rng(3)
    chunks = spark.createDataFrame([(i, rng.normal(size=40).tolist()) for i in range(4)], "id int, x array<double>")
    plan = rocket.fit_biases(chunks, rocket.make_plan(40, n_features=84), key="id")
    whole = rocket.cached_features(chunks, plan, str(tmp_path), keys=["id"]).collect()
    (folder,) = tmp_path.iterdir()
    (folder / "complete").rename(folder / "lost")  # as if the job had stopped before its mark
    (folder / "features").rename(folder / "gone")
    again = rocket.cached_features(chunks, plan, str(tmp_path), keys=["id"]).collect()
    assert sorted(r["id"] for r in again) == sorted(r["id"] for r in whole) == [0, 1, 2, 3]


def test_shared_folder_is_refused_on_a_cluster_without_the_setting(spark, monkeypatch):
    from types import SimpleNamespace

    from drivepulse.session import shared_dir

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(bare, "x")
    bare.sparkContext.master = "local[2]"
    assert "/x-" in shared_dir(bare, "x")


def test_late_fusion(spark):
    df = spark.createDataFrame([("s", [0.6, 0.4, 0.0, 0.0, 0.0]), ("s", [0.1, 0.2, 0.0, 0.7, 0.0]), ("s", [0.0, 0.3, 0.0, 0.7, 0.0])], "s string, probs array<double>")
    row = models.late_fusion(df, session=["s"]).first()
    assert (row["predicted_label"], row["n_sensors"]) == ("DEMAG", 3)
    assert row["probs"] == pytest.approx([0.7 / 3, 0.3, 0.0, 1.4 / 3, 0.0])


# Spectra against plain numpy
@pytest.mark.parametrize("form", [spectral.sensor_features, spectral.sensor_features_batched])
def test_sensor_features_match_numpy(spark, form):
    rng = np.random.default_rng(9)
    h, t, rpm, ref = 20, 17, 4000.0, 5700.0
    e = rng.random((h, t))
    df = spark.createDataFrame([(1, rpm, e.tolist())], "id int, rpm double, e array<array<double>>")
    out = {r["t"]: r for r in form(df, keys=["id"], reference_rpm=ref).collect()}
    med = np.median(e, axis=1, keepdims=True)
    z = (e - med) / (1.4826 * (np.median(np.abs(e - med), axis=1, keepdims=True) + 1e-6))
    limit = np.quantile(z, 0.9)
    u = np.arange(h) * rpm / ref
    resampled = np.stack([np.interp(u, np.arange(h), e[:, j]) for j in range(t)], axis=1)
    for j in range(t):
        r = out[j]
        above = np.where(z[:, j] > limit)[0]
        assert r["peak_freq_bin"] == z[:, j].argmax()
        assert (r["band_start"], r["band_end"]) == ((above.min(), above.max()) if len(above) else (None, None))
        assert r["rms"] == pytest.approx(np.sqrt((e[:, j] ** 2).mean()))
        for prefix, m in (("abs_", e), ("ord_", resampled)):
            c = m[:, j]
            p = c / (c.sum() + 1e-12)
            bands = [p[np.floor(np.arange(h) * 8 / h) == b].sum() for b in range(8)]
            assert [r[f"{prefix}band_{b}"] for b in range(8)] == pytest.approx(bands)
            assert r[f"{prefix}centroid"] == pytest.approx((np.arange(h) * p).sum())
            assert r[f"{prefix}entropy"] == pytest.approx(-(p * np.log(p + 1e-12)).sum())
            assert r[f"{prefix}rolloff"] == np.argmax(np.cumsum(p) >= 0.85)
            assert r[f"{prefix}log_flatness"] == pytest.approx(np.log(c + 1e-12).mean() - np.log(c.mean() + 1e-12))


@pytest.mark.parametrize("name", ["12", "15", "18", "48", "51", "51_order", "81", "87"])
def test_feature_sets_have_their_width(name):
    assert len(spectral.feature_set(name)) * 3 == int(name.split("_")[0])


def test_stft_of_a_tone(spark):
    n = np.arange(2000) / 1000
    df = spark.createDataFrame([(1, np.sin(2 * np.pi * 125 * n).tolist()), (2, [0.0] * 50)], "id int, x array<double>")
    out = {r["id"]: r["e"] for r in spectral.stft(df, keys=["id"]).collect()}
    e = np.array(out[1])
    assert e.shape == (48, 79) and e.max() == pytest.approx(1.0) and set(e.argmax(axis=0)) == {16}
    assert out[2] == []


# Streams
def test_live_chunks_handle_disorder_and_repeats(spark, tmp_path):
    data = [(u, p, float(p)) for u in (1, 2) for p in range(50)]
    rng = np.random.default_rng(0)
    for i, part in enumerate(np.array_split(rng.permutation(len(data) * 2), 5)):
        picked = [data[j % len(data)] for j in part]
        spark.createDataFrame(picked, "u long, place long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = streams.table_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    live = streams.assemble_live(arriving, recording=[("u", "long")], place="place", value="v", chunk_size=20)
    got = sorted((r["u"], r["chunk_id"], r["x"]) for r in streams.append_to(live, "t-chunks").collect())
    assert got == [(u, c, [float(v) for v in range(c * 20, c * 20 + 20)]) for u in (1, 2) for c in (0, 1)]


def test_live_chunks_leave_no_state_behind(spark, tmp_path):
    """A finished, a repeated and an unfinished chunk: the last comes out with what it had when the watermark passes it."""
    at = lambda second: f"2024-01-01 00:{second // 60:02d}:{second % 60:02d}"
    files = [
        [(1, p, float(p), at(p)) for p in range(6)] + [(2, p, float(p), at(p)) for p in range(3)],
        [(1, p, float(p), at(p)) for p in range(4, 10)] + [(2, 1, 99.0, at(1))],
        [(3, p, None, at(300 + p)) for p in range(10)],
        [(3, 10, 1.0, at(320))],
        [(2, 3, 3.0, at(3))],  # behind the watermark
        [(3, 20 + p, 1.0, at(900 + p)) for p in range(2)]]
    stamped = set()
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, "u long, place long, v double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set((tmp_path / "in").glob("*.parquet")) - stamped:  # files are taken by their time
            os.utime(f, (1_500_000_000 + i, 1_500_000_000 + i))
            stamped.add(f)
    arriving = streams.table_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    live = streams.assemble_live(arriving, recording=[("u", "long")], place="place", value="v", chunk_size=10, ts="ts", delay="30 seconds")
    got = {(r["u"], r["chunk_id"]): (r["x"], r["n_rows"], r["finished"]) for r in streams.append_to(live, "t-live").collect()}
    assert got[1, 0] == ([float(v) for v in range(10)], 10, True) and got[3, 0] == ([None] * 10, 10, True)
    assert got[2, 0] == (None, 3, False) and got[3, 1] == (None, 1, False)
    assert set(got) == {(1, 0), (2, 0), (3, 0), (3, 1)}  # the newest chunk is still open


def test_a_ring_rewrites_only_the_buckets_of_a_batch(spark, tmp_path):
    source, place = str(tmp_path / "in"), str(tmp_path / "job")

    def step(lo, hi, keys):
        rows = spark.range(lo, hi).select((F.col("id") % keys).alias("k"), F.col("id").alias("t"))
        rows.coalesce(1).write.mode("append").parquet(source)
        out = streams.ring(streams.file_stream(spark, source, "k long, t long"), "t", keys=["k"], order=["t"], keep=2, location=place)
        return {(r["k"], r["t"]) for r in out.collect()}

    assert len(step(0, 200, 100)) == 200
    folders = lambda n: {f.name for f in (tmp_path / "job" / "data" / str(n)).glob("__bucket=*")}
    assert len(folders(0)) > 30
    assert {t for k, t in step(1000, 1001, 1) if k == 0} == {100, 1000} and len(folders(1)) == 1
    assert {t for k, t in step(2000, 2001, 1) if k == 0} == {1000, 2000} and len(folders(2)) == 1
    got = step(3000, 3001, 1)
    assert len(got) == 200 and {t for k, t in got if k == 0} == {2000, 3000}
    # Superseded versions of the bucket are gone, untouched buckets stand where they were.
    assert not folders(1) and folders(2) == folders(3) and len(folders(0)) > 30 and not folders(0) & folders(3)


def test_ring_and_latest_over_several_batches(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), (F.col("id") * 1.0).alias("s"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))

    def arriving():
        return streams.table_stream(spark, str(tmp_path / "in"), files_per_trigger=1)

    kept = streams.ring(arriving(), "t-ring", keys=["k"], order=["t"], keep=10).collect()
    assert sorted(r["t"] for r in kept) == list(range(170, 200))
    whole = streams.ring(arriving(), "t-ring-all", keys=[], order=["t"], keep=5).collect()
    assert sorted(r["t"] for r in whole) == list(range(195, 200))
    last = streams.upsert(streams.latest_state(arriving(), keys=["k"], score="s", order=["t"]), "t-latest", ["k"])
    assert {r["k"]: r["score"] for r in last.collect()} == {0: 198.0, 1: 199.0, 2: 197.0}


def test_a_ring_without_its_previous_table_fails(spark, tmp_path):
    import shutil

    source, place = str(tmp_path / "in"), str(tmp_path / "job")
    spark.range(5).select(F.lit(1).alias("k"), F.col("id").alias("t")).write.parquet(source)
    stream = streams.file_stream(spark, source, "k int, t long")
    assert streams.ring(stream, "t", keys=["k"], order=["t"], keep=3, location=place).count() == 3
    spark.range(5, 9).select(F.lit(1).alias("k"), F.col("id").alias("t")).write.mode("append").parquet(source)
    resumed = streams.ring(streams.file_stream(spark, source, "k int, t long"), "t", keys=["k"], order=["t"], keep=3, location=place)
    assert sorted(r["t"] for r in resumed.collect()) == [6, 7, 8]
    shutil.move(f"{place}/data/1", str(tmp_path / "away"))
    spark.range(9, 11).select(F.lit(1).alias("k"), F.col("id").alias("t")).write.mode("append").parquet(source)
    with pytest.raises(Exception):
        streams.ring(streams.file_stream(spark, source, "k int, t long"), "t", keys=["k"], order=["t"], keep=3, location=place)


def test_alerts_are_emitted_once(spark, tmp_path):
    from tests.test_health import response

    r = response(spark, ("ECC10", 20.0, "caution", "DEFECT", 70.0, "warning", 1)).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    r.unionByName(r).repartition(2).write.parquet(str(tmp_path / "in"))
    r.write.mode("append").parquet(str(tmp_path / "in"))
    arriving = streams.table_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    assert streams.append_to(streams.alert_stream(arriving), "t-alerts").count() == 2


def test_chunks_of_a_shard_are_assembled_together(spark, tmp_path, monkeypatch):
    """Three states hold all chunks; long numbers stand beside a null, and a sample repeated after its chunk ended changes nothing."""
    monkeypatch.setattr(streams, "CHUNK_SHARDS", 3)
    units = [2**53 + 1, 2**53, None, 4]
    rows = [(u, p, None if p == 3 else float(p)) for u in units for p in range(22)]
    halves = [rows[::2], rows[1::2], [(2**53 + 1, 0, 99.0), (4, 21, 99.0)]]
    for i, part in enumerate(halves):
        spark.createDataFrame(part, "u long, place long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = streams.table_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    live = streams.assemble_live(arriving, recording=[("u", "long")], place="place", value="v", chunk_size=10)
    out = [(r["u"], r["chunk_id"], r["x"]) for r in streams.append_to(live, "t-shards").collect()]
    assert len(out) == 8 and {(u, c) for u, c, _ in out} == {(u, c) for u in units for c in (0, 1)}
    assert all(len(x) == 10 and x[1:] == [None if p == 3 else float(p) for p in range(c * 10 + 1, c * 10 + 10)] for _, c, x in out)
