import numpy as np
import pytest

from prismfold.operators import models
from prismfold.spectra import Spectra


def made(spark, n, classes, seed=1):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, classes, n)
    x = rng.normal(0, 1, (n, 6)) + np.eye(6)[g] * 2.5
    x[:, 5] = 3.0  # a column without variance
    s = Spectra.of(spark.createDataFrame([(i, f"G{k}", v.tolist()) for i, (k, v) in enumerate(zip(g, x))], "spectrum_id long, group string, raw_data array<double>"), range(6))
    return s, g, x


def objective(w, x, sign):
    return (w[1:] ** 2).sum() / 2 + np.maximum(0, 1 - sign * (x @ w[1:] + w[0])).sum()


def test_plane_of_two_classes(spark):
    s, g, x = made(spark, 120, 2)
    m = models.svm(s)
    z, sign = (x - m.centre) / m.scale, np.where(g == 0, 1.0, -1.0)
    # The exact hinge, by many steps against its subgradient.
    w, best = np.zeros(7), np.inf
    for t in range(1, 20001):
        out = sign * (z @ w[1:] + w[0]) < 1
        grad = np.concatenate([[-sign[out].sum()], w[1:] - sign[out] @ z[out]])
        w = w - grad / (10 + t)
        best = min(best, objective(w, z, sign))
    assert objective(m.planes[0], z, sign) <= best + 120 * 0.05 / 4
    assert abs(objective(m.planes[0], z, sign) - best) < 0.02 * best


def test_votes_of_pairs(spark):
    s, g, x = made(spark, 300, 4)
    m = models.svm(s)
    got = models.predict(m, s).orderBy("spectrum_id").collect()
    z = (x - m.centre) / m.scale
    for r, row in zip(got, z):
        votes = [0] * 4
        for plane, (a, b) in zip(m.planes, m.pairs()):
            votes[a if plane[1:] @ row + plane[0] > 0 else b] += 1
        assert r["votes"] == votes and r["prediction"] == f"G{int(np.argmax(votes))}" and r["probability"] is None
    assert np.mean([r["prediction"] == f"G{k}" for r, k in zip(got, g)]) > 0.8


def test_single_class_and_nulls(spark):
    rows = [(0, "G0", [1.0, 2.0]), (1, "G0", [2.0, 1.0]), (2, None, [0.0, 0.0]), (3, "G1", None)]
    s = Spectra.of(spark.createDataFrame(rows, "spectrum_id long, group string, raw_data array<double>"), range(2))
    got = {r["spectrum_id"]: r["prediction"] for r in models.predict(models.svm(s), s).collect()}
    assert got == {0: "G0", 1: "G0", 2: "G0", 3: None}
    lda = models.LinearDiscriminant(["G0", "G1"], np.zeros(2), np.eye(2), np.eye(2), np.zeros(2))
    assert [r["prediction"] for r in models.predict(lda, s).orderBy("spectrum_id").collect()] == ["G1", "G0", "G0", None]
    with pytest.raises(ValueError):
        models.svm(s[s.df["spectrum_id"] == 2])
