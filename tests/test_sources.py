import json
import os
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivepulse.functions.domains import CLASSES, META_COLUMNS, SENSORS, VEHICLES
from drivepulse.operators import health, shaping, spectral
from drivepulse.sources import binary, paths, signals, sinks

DATE = "0609"


def write_csv(root, vehicle, fault, sensor, rec, rows, *, start=500, drop=()):
    key = f"22_06_09_12_26_53_01_zsplit{rec:03d}"
    folder = os.path.join(root, vehicle, fault, DATE, sensor)
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{key}_{sensor}_timeseries.csv")
    meta = dict(zip(META_COLUMNS, (key, vehicle, fault, DATE, sensor, "22_06_09", f"z{rec}")))
    head = [c for c in (*META_COLUMNS, "time_idx", "peak_freq_bin", "band_start", "band_end", "rms") if c not in drop]
    with open(path, "w") as fh:
        fh.write(",".join(head) + "\n")
        for i in range(rows):
            rec_row = {**meta, "time_idx": start + i, "peak_freq_bin": i % 9, "band_start": 1, "band_end": 8,
                       "rms": "NaN" if i % 20 == 3 else i / 10}
            fh.write(",".join(str(rec_row[c]) for c in head) + "\n")
    return path


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Every (vehicle, sensor, class) cell has recordings of 20 to 100 rows."""
    root = str(tmp_path_factory.mktemp("tree"))
    n = 0
    for v in VEHICLES:
        for c in CLASSES:
            for s in SENSORS:
                n += 1
                write_csv(root, v, c, s, 1, 20 * (1 + n % 5))
    open(os.path.join(root, "KONA", "ECC10", DATE, "Vib_TM", "notes_Vib_TM.csv"), "w").close()
    return root


def test_index_covers_all_cells(spark, tree):
    index = paths.recording_index(paths.list_files(spark, tree))
    assert index.count() == 45
    o = paths.index_overview(index).first()
    assert (o["n_rows"], o["n_groups"], o["n_combinations"]) == (45, 1, 45)
    assert {r["group_key"] for r in index.collect()} == {"22_06_09_12_26_53_01_zsplit001"}
    assert paths.index_stats(index, "fault_class").first()["keys"].startswith("IONIQ/DEMAG,IONIQ/ECC10")


def test_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path"):
        paths.list_files(spark, str(tmp_path / "absent")).count()


def test_ghost_class_is_reported_per_vehicle(spark, tree):
    gaps = paths.coverage_gaps(paths.list_files(spark, tree), classes=(*CLASSES, "__GHOST__")).collect()
    assert sorted((g["vehicle"], g["fault_class"], g["problem"]) for g in gaps) == [
        (v, "__GHOST__", "class folder missing") for v in VEHICLES
    ]


def test_scan_split_and_chunk(spark, tree):
    rows = signals.scan_signals(spark, f"{tree}/IONIQ/NORMAL")
    meta = signals.recording_meta(rows)
    assert meta.count() == 3 and {r["label_id"] for r in meta.collect()} == {0}
    sizes = signals.row_count_check(rows, allowed=(20, 40, 60, 80, 100), chunk_size=20)
    assert all(r["allowed"] and r["n_rows"] == 20 * r["n_chunks"] for r in sizes.collect())
    chunks = shaping.repair_gaps(shaping.chunk_rows(rows, recording=["path"], chunk_size=20), chunk=["path", "chunk_id"])
    assert chunks.filter("clean is null or isnan(clean)").count() == 0
    assert chunks.filter("was_gap").count() == chunks.count() // 20
    first = chunks.filter("chunk_id = 0 and pos = 3").first()
    assert first["clean"] == pytest.approx(0.3, abs=1e-6)


def test_missing_metadata_column_is_an_error(spark, tmp_path):
    write_csv(str(tmp_path), "KONA", "DEMAG", "Vib_TM", 1, 4, drop=("zsplit",))
    with pytest.raises(ValueError, match="zsplit"):
        signals.scan_signals(spark, str(tmp_path))


def test_unknown_class_fails(spark, tmp_path):
    write_csv(str(tmp_path), "KONA", "ODD", "Vib_TM", 1, 4)
    with pytest.raises(Exception, match="unknown fault class"):
        signals.recording_meta(signals.scan_signals(spark, str(tmp_path))).collect()


def test_sinks_round_trip(spark, tree, tmp_path):
    index = paths.recording_index(paths.list_files(spark, tree))
    back = sinks.write_index(index, str(tmp_path / "index"))
    assert back.count() == 45
    pruned = back.filter("sensor = 'Vib_TM'")
    assert pruned.count() == 15
    rows = signals.scan_signals(spark, f"{tree}/NIRO/DEMAG")
    done = shaping.repair_gaps(shaping.chunk_rows(rows, chunk_size=20))
    sinks.write_chunks(shaping.assemble_chunks(done), str(tmp_path / "chunks"))
    assert {len(r["x"]) for r in spark.read.parquet(str(tmp_path / "chunks")).collect()} == {20}
    with pytest.raises(ValueError):
        sinks.write_chunks(shaping.assemble_chunks(done).limit(0), str(tmp_path / "none"))


def test_fingerprint_ignores_row_order(spark):
    df = spark.range(500).withColumn("k", F.lit(1))

    def mark(d):
        text = F.col("id").cast("string")
        return sinks.fingerprint(d, ["k"], text).first()["sha256"]

    assert mark(df) == mark(df.repartition(7).orderBy(F.col("id").desc()))
    assert mark(df) != mark(df.filter("id > 0"))


def test_matrices_and_labels(spark, tmp_path):
    np.save(tmp_path / "good.npy", np.full((20, 96), 3.9, dtype="float32"))
    np.save(tmp_path / "flat.npy", np.zeros(5))
    (tmp_path / "bad.npy").write_bytes(b"not a matrix")
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {"temperature": 41.26}}))
    (tmp_path / "b.json").write_text("{broken")
    got = {os.path.basename(r["path"]): r["m"] for r in binary.scan_matrices(spark, str(tmp_path)).collect()}
    assert (len(got["good.npy"]), len(got["good.npy"][0])) == (20, 96)
    assert got["flat.npy"] is None and got["bad.npy"] is None
    labels = {os.path.basename(r["path"]): r["metadata"] for r in binary.scan_labels(spark, str(tmp_path)).collect()}
    assert labels["a.json"]["temperature"] == 41.26
    assert labels["b.json"] is None


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[i].astype("uint8").tobytes() for i in range(h))

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    with open(path, "wb") as fh:
        fh.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)))
        fh.write(chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_spectrogram_pixels_come_back_as_values(spark, tmp_path):
    v = np.linspace(0, 1, 48).reshape(6, 8)
    rgb = np.floor(np.clip(1.5 - np.abs(4 * v[..., None] - np.array([3, 2, 1])), 0, 1) * 255)
    png(tmp_path / "s.png", rgb)
    px = binary.pixels(binary.scan_spectrograms(spark, str(tmp_path)))
    got = {(r["row"], r["col"]): (r["r"], r["g"], r["b"]) for r in px.collect()}
    assert got == {(i, j): tuple(int(x) for x in rgb[i, j]) for i in range(6) for j in range(8)}
    values = spectral.recover_scalar(px)
    assert max(abs(r["e"] - v[r["row"], r["col"]]) for r in values.collect()) < 0.02
    (m,) = spectral.assemble_map(values, ["path"]).collect()
    assert np.allclose(np.array(m["e"])[::-1], v, atol=0.02)
    (whole,) = spectral.maps_from_images(binary.scan_spectrograms(spark, str(tmp_path))).collect()
    assert whole["e"] == m["e"]


def test_pack_index_pairing(spark):
    base = "/r/Dev_96/{}/KONA/DEFECT/0701/x/{}"
    files = [base.format("NPY", "a.npy"), base.format("NPY", "b.npy"), base.format("JSON", "a.json"),
             base.format("JSON", "c.json"), "/r/Vlt_98/NPY/NIRO/NORMAL/0701/y/z.npy"]
    out = paths.pack_index(spark.createDataFrame([(f,) for f in files], "path string"))
    got = {r["matrix_path"][-5:]: r["label_path"][-6:] for r in out.collect()}
    assert got == {"a.npy": "a.json", "b.npy": "a.json"}


def test_spectrogram_index_rules(spark):
    day = "/{}/IONIQ/DEMAG/0728/{}/{}"
    files = [day.format("raw", "Current_U", "r1_Current_U.png"), day.format("raw", "Current_U", "r2_Current_U.png"),
             day.format("raw", "Vib_TM", "r1_Vib_TM.png"), day.format("raw", "Vib_TM", "r0_Vib_TM.png"),
             day.format("lbl", "Current_U", "r2_Current_U.json"),
             "/raw/KONA/NORMAL/0101/Vib_Motor/q_Vib_Motor.png"]
    out = paths.spectrogram_index(spark.createDataFrame([(f,) for f in files], "path string"))
    got = {r["path"].split("/")[-1]: r for r in out.collect()}
    assert set(got) == {"r1_Current_U.png", "r2_Current_U.png"}  # no label, no row
    assert got["r1_Current_U.png"]["channels"]["Vib_TM"].endswith("r1_Vib_TM.png")
    assert got["r2_Current_U.png"]["channels"]["Vib_TM"].endswith("r0_Vib_TM.png")
    assert "Vib_Motor" not in got["r2_Current_U.png"]["channels"]
    assert {g["label_path"].split("/")[-1] for g in got.values()} == {"r2_Current_U.json"}
    url = out.select(paths.relative_resource(F.col("channels"), "/raw", "/static/")).first()[0]
    assert url.startswith("/static/IONIQ/DEMAG/0728/Current_U/")


def test_polygon_box(spark):
    df = spark.createDataFrame(
        [([[[200.0, 128.0], [1000.0, 640.0], [400.0, 1280.0]]],), ([],), ([[]],)],
        "p array<array<array<double>>>",
    )
    out = [r[0] for r in df.select(health.polygon_box(F.col("p"), F.lit(2000), F.lit(1280))).collect()]
    assert tuple(out[0]) == (0.1, 0.1, 0.5, 1.0) and out[1] is None and out[2] is None


def test_tree_to_models(spark, tmp_path):
    from drivepulse.plans import training

    root = str(tmp_path / "tree")
    for c in CLASSES:
        for rec in range(5):
            write_csv(root, "KONA", c, "Vib_TM", rec * 10 + CLASSES.index(c), 40 if rec else 30)
    index = training.build_index(spark, root, str(tmp_path / "index"))
    assert index.count() == 25
    split = training.split_groups(index)
    sides = {r["side"]: r["count"] for r in split.groupBy("side").count().collect()}
    assert sides == {"train": 20, "val": 5}
    sinks.write_splits(split, str(tmp_path / "splits"))
    assert spark.read.json(str(tmp_path / "splits")).count() == 25
    chunks = training.load_chunks(index, chunk_size=20)
    # Recordings of 30 rows are rejected as a whole.
    assert chunks.count() == 5 * 4 * 2 and {len(r["x"]) for r in chunks.collect()} == {20}
    assert {r["cls"] for r in chunks.select("cls").distinct().collect()} == set(range(5))
    exported = training.export_validation_chunks(index, split, str(tmp_path / "val"), chunk_size=20)
    held = {r["group_key"] for r in split.filter("side = 'val'").collect()}
    assert {r["group_key"] for r in exported.collect()} <= held
    report = training.train_sensors(chunks, split, str(tmp_path / "out"), n_features=84, sensors=["Vib_TM"], max_iter=5)
    assert report.filter("label = 'macro avg'").count() == 1
    assert os.path.isdir(tmp_path / "out" / "models" / "slot=Vib_TM")
    assert spark.read.json(str(tmp_path / "out" / "summary")).count() == 9


def test_only_indexed_recordings_become_chunks(spark, tmp_path):
    from drivepulse.plans import training

    root = str(tmp_path / "ordner mit ümlaut+x")
    for rec in range(4):
        write_csv(root, "KONA", "ECC20", "Vib_TM", rec, 20)
    index = training.build_index(spark, root)
    every = {r["group_key"]: r["x"] for r in training.load_chunks(index, chunk_size=20).collect()}
    some = index.filter("group_key like '%zsplit002' or group_key like '%zsplit003'").select("sensor", "group_key")
    rows = {r["group_key"]: r["x"] for r in training.load_chunks(index, some, chunk_size=20).collect()}
    assert len(every) == 4 and len(rows) == 2 and all(every[k] == x for k, x in rows.items())
    with pytest.raises(ValueError):
        training.load_chunks(index, some.limit(0), chunk_size=20)


def test_sweep_report_of_the_pilot_profile(spark, tmp_path):
    # Recordings per length of the published pilot tree (81 files, 225 chunks).
    profile = {2000: 21, 4000: 24, 6000: 9, 8000: 6, 10000: 21}
    cells = [(v, s, c) for v in VEHICLES for s in SENSORS for c in CLASSES]
    lengths = [n for n, k in profile.items() for _ in range(k)] + [3000]
    rows = [(f"f{i}", *cells[i % 45], n, n // 2000) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "csv_path string, vehicle string, sensor string, fault_class string, n_rows long, n_chunks long")
    out = {r["n_rows"]: (r["n_recordings"], r["n_chunks"], r["expected"]) for r in signals.length_distribution(df).collect()}
    assert {n: out[n][0] for n in profile} == profile
    assert sum(out[n][1] for n in profile) == 225
    assert out[3000] == (1, 1, False)
    pivot = signals.chunk_pivot(df)
    assert sum(r["TOTAL"] for r in pivot.collect()) == 226 and pivot.count() == 9
    sinks.write_report(df, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 82


def test_columns_are_found_by_name_and_refused_files_are_listed(spark, tmp_path):
    root = str(tmp_path / "t")
    plain = write_csv(root, "KONA", "DEMAG", "Vib_TM", 1, 20)
    turned = write_csv(root, "KONA", "DEMAG", "Vib_TM", 2, 20)
    lines = [line.split(",") for line in open(turned).read().splitlines()]
    open(turned, "w").write("\n".join(",".join(reversed(cells)) for cells in lines) + "\n")
    cut = write_csv(root, "KONA", "DEMAG", "Vib_TM", 3, 20)
    text = open(cut).read()
    open(cut, "w").write(text[: text.rstrip().rindex(",")])  # the last row lost its last field
    lacking = write_csv(root, "KONA", "DEMAG", "Vib_TM", 4, 20, drop=("zsplit",))
    unordered = write_csv(root, "KONA", "DEMAG", "Vib_TM", 5, 20, drop=("time_idx",))
    fewer = write_csv(root, "KONA", "DEMAG", "Vib_TM", 6, 20, drop=("band_start",))
    empty, notes = (os.path.join(os.path.dirname(plain), n) for n in ("empty.csv", "a[b]{c} d.csv"))
    open(empty, "w").close()
    open(notes, "w").write("no header\n")
    odd = os.path.join(os.path.dirname(plain), "x[b]{c} d.csv")
    open(odd, "w").write(open(plain).read())
    rows, rejects = signals.scan_with_rejects(spark, root)
    got = {}
    for r in rows.orderBy("path", "time_idx").collect():
        got.setdefault(r["path"], []).append((r["time_idx"], r["peak_freq_bin"], r["rms"], r["fault_class"], r["band_start"]))
    assert set(got) == {plain, turned, fewer, odd} and got[plain] == got[turned] == got[odd] and len(got[plain]) == 20
    assert got[fewer] == [(*row[:4], None) for row in got[plain]]
    reasons = {r["path"]: r["reason"] for r in rejects.collect()}
    assert set(reasons) == {cut, lacking, unordered, notes}
    assert reasons[cut] == "malformed rows: 1" and "zsplit" in reasons[lacking] and reasons[notes] == reasons[unordered] == signals.NO_HEADER
    with pytest.raises(ValueError, match="malformed rows"):
        signals.scan_signals(spark, root)
    assert signals.scan_signals(spark, root, skip_unreadable=True).count() == 80
    only = signals.scan_with_rejects(spark, [empty])
    assert only[0].count() == 0 and only[0].columns == rows.columns and only[1].first()["reason"] == signals.EMPTY


def test_ingested_table_opens_only_the_buckets_of_the_groups(spark, tmp_path):
    from drivepulse.plans import training

    root = str(tmp_path / "tree")
    for rec in range(6):
        for sensor in ("Vib_TM", "Current_U"):
            write_csv(root, "KONA", "ECC20", sensor, rec, 40 if rec else 30)
    index = training.build_index(spark, root)
    table = training.ingest(index, str(tmp_path / "table"))
    assert table.count() == 2 * (5 * 40 + 30) and spark.read.schema("path string").parquet(str(tmp_path / "table_rejects")).count() == 0
    some = index.filter("sensor = 'Vib_TM' and group_key like '%zsplit002'").select("sensor", "group_key")
    rows = training.pruned(table, some)
    assert rows.count() == 40
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*sensor#\d+ = Vib_TM", plan)
    # A file of another partition may be gone: it is not opened.
    others = {f for f in table.inputFiles() if "sensor=Current_U" in f}
    for f in others:
        open(f.replace("file://", ""), "w").write("broken")
    assert training.pruned(spark.read.schema(table.schema).parquet(str(tmp_path / "table")), some).count() == 40
    want = {r["group_key"]: r["x"] for r in training.load_chunks(index, some, chunk_size=20).collect()}
    got = {r["group_key"]: r["x"] for r in training.chunks_of(rows, chunk_size=20).collect()}
    assert got.keys() == want.keys() and len(got) == 1
    # Only this recording's file is read, and what gives no chunks is listed.
    os.chmod(index.filter("sensor = 'Current_U'").first()["csv_path"].replace("file:", ""), 0)
    chunks, skipped = training.load_with_skipped(index, index.filter("sensor = 'Vib_TM'").select("sensor", "group_key").distinct(), chunk_size=20)
    assert chunks.count() == 10
    found = skipped.collect()
    assert len(found) == 1 and "zsplit000" in found[0]["path"] and found[0]["reason"] == "30 rows are no multiple of 20"


def test_a_listing_is_taken_apart_once(spark):
    files = [f"/img/IONIQ/NORMAL/0101/{c}/r1_{c}.png" for c in ("Current_U", "Vib_TM")] + ["/lbl/IONIQ/NORMAL/0101/Current_U/r1_Current_U.json"]
    out = paths.spectrogram_index(spark.createDataFrame([(f,) for f in files], "path string"))
    assert "regexp_extract" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 1
