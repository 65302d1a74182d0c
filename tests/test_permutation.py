"""Permutation importance against the local form with the same permutations, and the kernel machine against the dense one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlab.operators import learn, permutation, solvers


@pytest.fixture(scope="module")
def rings(spark):
    """2,000 rows of 5 features: the label is whether the first two lie in a ring; the last is constant."""
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 5))
    x[:, 4] = 3.0
    y = (np.abs(np.linalg.norm(x[:, :2], axis=1) - 1.2) < 0.5).astype(int)
    return spark.createDataFrame([(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, label int, features array<double>").persist(), x, y


@pytest.mark.parametrize("size", [1, 100_000])
def test_rows_are_numbered_without_gaps(rings, monkeypatch, size):
    wide = rings[0]
    monkeypatch.setattr(permutation, "NUMBERED", size if size > 1 else 50)  # 64 ranges, and one
    rows = permutation.numbered(wide.withColumn("id", F.col("id") % 700)).collect()  # repeated ids too
    assert sorted(r["n"] for r in rows) == list(range(2000))
    assert sorted(tuple(r["features"]) for r in rows) == sorted(map(tuple, rings[1].tolist()))


def test_permutations_are_bijections():
    for rows in (1, 2, 3, 10, 97, 2000):
        a, b = permutation.bijection(rows, 3, 1)
        assert sorted((a * n + b) % rows for n in range(rows)) == list(range(rows))


def test_importance_equals_the_local_form(rings):
    wide, x, y = rings
    predict = lambda z: (np.abs(np.hypot(z[:, 0], z[:, 1]) - 1.2) < 0.5 + 0.1 * np.sign(z[:, 2])).astype(int)
    got = {r["j"]: r["score"] for r in permutation.importance(wide, predict, 3, 5).collect()}
    rows = {r["n"]: (r["features"], r["label"]) for r in permutation.numbered(wide, 5).collect()}
    z, t = np.array([rows[n][0] for n in range(2000)]), np.array([rows[n][1] for n in range(2000)])
    base, n = (predict(z) == t).mean(), np.arange(2000)
    for j in range(5):
        fall = []
        for repeat in range(3):
            a, b = permutation.bijection(2000, j, repeat, 5)
            moved = z.copy()
            moved[(a * n + b) % 2000, j] = z[:, j]
            fall.append(base - (predict(moved) == t).mean())
        assert got[j] == pytest.approx(np.mean(fall), abs=1e-12)
    assert got[0] > 0.1 and got[1] > 0.1 and got[3] == got[4] == 0


def test_kernel_machine_is_as_good_as_the_dense_one(rings):
    wide, x, y = rings
    dense = (learn.KernelSVM().fit(x, y, 2).decision(x).argmax(1) == y).mean()
    with solvers.training(wide) as rows:
        model = solvers.kernel_machine(rows)
    assert (model.predict(x) == y).mean() > dense - 0.01 and model.landmarks.shape == (256, 5)


def test_kernel_select_finds_the_ring(rings):
    assert {r["j"] for r in solvers.kernel_select(rings[0], 2, repeats=2).collect()} == {0, 1}


def test_no_rows_and_one(spark):
    schema = "id long, label int, features array<double>"
    predict = lambda z: np.zeros(len(z), int)
    assert permutation.importance(spark.createDataFrame([], schema), predict).count() == 0
    one = spark.createDataFrame([(1, 0, [1.0, 2.0])], schema)
    assert [tuple(r) for r in permutation.importance(one, predict).orderBy("j").collect()] == [(0, 0.0), (1, 0.0)]
