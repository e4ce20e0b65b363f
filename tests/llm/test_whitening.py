import random

import numpy as np
import pytest

from drivepulse.llm import whitening

VECTORS = "vec_id bigint, embedding array<double>, n bigint, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "odd") for i, v in rows], VECTORS)


def exact(vectors):
    """Whole numbers of Python: n, n x - S of every entry, and the covariance."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    left = [[n * a - s for a, s in zip(row, sums, strict=True)] for row in x]
    size = len(sums)
    cov = np.array([[sum(row[a] * row[b] for row in left) / (n**3) for b in range(size)] for a in range(size)])
    return n, left, cov


@pytest.mark.parametrize("scale", [1.0, 1e9, 3e15])
def test_against_whole_numbers(spark, scale):
    rnd = random.Random(3)
    base = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(80)]
    rows = [(i, [scale * (a + 0.5 * v[0]) for a in v]) for i, v in enumerate(base)]
    rows += [(7, rows[7][1]), (None, rows[3][1])]
    odd = [(90, None), (91, []), (92, [1.0] * 5), (93, [1.0, None] + [2.0] * 4), (94, [float("nan")] + [1.0] * 5), (95, [float("inf")] + [1.0] * 5)]
    out = whitening.report(frame(spark, rows + odd).repartition(5), keep=4).collect()
    n, left, cov = exact([v for _, v in rows])
    values, vectors = np.linalg.eigh(cov)
    assert len(out) == 4 * n and {r.n for r in out} == {n} and {r.vec_id for r in out} == {i for i, _ in rows}
    deviations = {i: sum(a * a for a in row) for (i, _), row in zip(rows, left, strict=True)}
    assert all(r.deviation == (deviations[r.vec_id] if deviations[r.vec_id] < 10**38 else None) for r in out)
    for c in range(4):
        want = np.array(left, float) / n @ vectors[:, -1 - c] / np.sqrt(values[-1 - c])
        want = {i: w for (i, _), w in zip(rows, want, strict=True)}
        got = {r.vec_id: r.whitened for r in out if r.component == c + 1}
        sign = np.sign(got[0] * want[0])
        assert all(abs(got[i] - sign * want[i]) < 1e-9 for i in want)
        assert all(abs(r.explained - values[-1 - c] / np.trace(cov)) < 1e-12 for r in out if r.component == c + 1)
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9


def test_components_without_variance(spark):
    out = whitening.report(frame(spark, [(i, [float(i), 1.0, 2.0 * i]) for i in range(5)])).collect()
    assert len(out) == 15 and all((r.whitened is None) == (r.component > 1) for r in out)
    assert out[0].identity_error < 1e-9 and sorted({r.explained for r in out}) == [0.0, pytest.approx(1.0)]
    alike = whitening.report(frame(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(alike) == 6 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error is None for r in alike)


def test_nothing_to_fit(spark):
    assert whitening.report(frame(spark, [])).collect() == []
    assert whitening.report(frame(spark, [(1, None), (2, [float("nan")])])).collect() == []
