import json
import os
import shutil

import numpy as np
import pytest

from drivepulse.plans import pack_job


def write_pack(root, kind, vehicle, status, name, matrix, temperature=21.26):
    for part in ("NPY", "JSON"):
        os.makedirs(f"{root}/{kind}/{part}/{vehicle}/{status}", exist_ok=True)
    path = f"{root}/{kind}/NPY/{vehicle}/{status}/{name}.npy"
    if isinstance(matrix, bytes):
        open(path, "wb").write(matrix)
    else:
        np.save(path, matrix)
    with open(f"{root}/{kind}/JSON/{vehicle}/{status}/{name}.json", "w") as fh:
        json.dump({"metadata": {"temperature": temperature}}, fh)
    return path


def volts(low=None, wide=None):
    m = 4.0 + 0.001 * np.arange(6)[:, None] + np.zeros((6, 8))
    if low is not None:
        m[:, low] = 3.2
    if wide is not None:
        m[:, wide] = np.linspace(3.6, 4.2, 6)
    return m


def test_files_to_responses_and_alerts(spark, tmp_path):
    root, out = str(tmp_path / "packs"), str(tmp_path / "out")
    write_pack(root, "Vlt_96", "KONA", "Normal", "a", volts())
    write_pack(root, "Vlt_96", "KONA", "Defect", "b", volts(low=5))
    write_pack(root, "Dev_96", "NIRO", "Caution", "c", volts(wide=2), None)
    write_pack(root, "Dev_96", "NIRO", "Caution", "bad", b"no matrix")
    write_pack(root, "Dev_96", "NIRO", "Caution", "flat", np.arange(5.0))
    assert pack_job.run(spark, root, out, now="2024-02-01 00:00:00") == 5
    got = {os.path.basename(r["matrix_path"])[:-4]: r for r in pack_job.results(spark, out, "responses").collect()}
    assert set(got) == {"a", "b", "c"}
    a, b, c = (got[k]["battery"] for k in "abc")
    assert a["classification"] == "NORMAL" and a["fault_type"] == "none" and a["faulty_cell_indices"] == [] and a["status"] == "normal"
    assert a["metrics"]["temperature"] == 21.3 and a["metrics"]["cell_count"] == 8 and len(a["metrics"]["cell_mean_voltages"]) == 8
    assert b["fault_type"] == "cell_voltage" and b["faulty_cell_indices"] == [5] and b["metrics"]["min_cell_voltage"] == 3.2 and b["status"] == "warning"
    assert c["fault_type"] == "cell_deviation" and c["faulty_cell_indices"] == [2] and c["metrics"]["temperature"] is None
    for r in (a, b, c):
        assert sum(r["probabilities"].values()) == pytest.approx(1, abs=2e-4) and sum(r["fault_probabilities"].values()) == pytest.approx(1, abs=2e-4)
    assert max(b["fault_probabilities"], key=b["fault_probabilities"].get) == "cell_voltage"
    assert {os.path.basename(r["matrix_path"]) for r in pack_job.results(spark, out, "rejects").collect()} == {"bad.npy", "flat.npy"}
    raised = pack_job.results(spark, out, "alerts").collect()
    assert {r["fault_type"] for r in raised} >= {"DEFECT", "CAUTION"} and all(r["component"] == "battery" for r in raised)
    assert len({r["id"] for r in raised}) == len(raised)

    # Nothing is new: nothing is done twice.
    assert pack_job.run(spark, root, out, now="2024-02-02 00:00:00") == 0
    # A newer version of one file and one more file are a batch of their own.
    path = write_pack(root, "Vlt_96", "KONA", "Normal", "a", volts(low=0))
    os.utime(path, (2_000_000_000, 2_000_000_000))
    write_pack(root, "Vlt_96", "IONIQ", "Normal", "d [1]", volts())
    assert pack_job.run(spark, root, out, now="2024-02-03 00:00:00") == 2
    assert pack_job.results(spark, out, "responses").count() == 5
    newest = {os.path.basename(r["matrix_path"])[:-4]: r for r in pack_job.current(spark, out).collect()}
    assert set(newest) == {"a", "b", "c", "d [1]"} and newest["a"]["battery"]["metrics"]["min_cell_voltage"] == 3.2


def test_a_lost_job_is_run_again(spark, tmp_path):
    root, out = str(tmp_path / "packs"), str(tmp_path / "out")
    write_pack(root, "Vlt_96", "KONA", "Defect", "b", volts(low=5))
    assert pack_job.run(spark, root, out, now="2024-02-01 00:00:00") == 1
    shutil.rmtree(f"{out}/ledger")  # the results were written, the ledger was not
    write_pack(root, "Vlt_96", "KONA", "Normal", "later", volts())
    assert pack_job.run(spark, root, out, now="2024-02-01 00:00:00") == 2
    assert pack_job.results(spark, out, "responses").count() == 2
    assert pack_job.results(spark, out, "alerts").filter("fault_type = 'DEFECT'").count() == 1
