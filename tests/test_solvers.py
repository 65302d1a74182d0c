"""Solvers from sums over tasks against dense forms on the whole matrix."""

import numpy as np
import pytest

from featlab.operators import learn, selectors, solvers


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(8)
    y = r.integers(0, 3, 150)
    x = np.abs(r.normal(size=(150, 8)))
    x[:, 1] += y
    x[:, 3] += 1.5 * (y == 2)
    x[:, 5] = x[:, 1] + 0.1 * x[:, 5]  # correlated beyond 0.8
    x[:, 7] = 2.0  # constant
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, int(c) * 2 + 5, [float(v) for v in row], 1) for i, (row, c) in enumerate(zip(x, y, strict=True))], "id long, label int, features array<double>, y int").repartition(3)


def fold(data, k=4):
    x, y = data
    return selectors.Fold(x, y, len(np.unique(y)), k)


def listed(df):
    rows = df.orderBy("rank").collect()
    return [r["j"] for r in rows], [r["score"] for r in rows]


def same(got, want, rel=1e-6):
    assert got[0] == want[0] and got[1] == pytest.approx(want[1], rel=rel, abs=1e-8)


@pytest.mark.parametrize("two", [False, True])
def test_logistic_equals_dense(spark, data, two):
    x, y = data[0], (data[1] == 2).astype(int) if two else data[1]
    with solvers.training(frame(spark, x, y)) as rows:
        m = solvers.logistic(rows)
    dense = learn.Logistic(steps=2000).fit(x, y, int(y.max()) + 1)
    shift = lambda w: w - w.mean(1, keepdims=True)  # noqa: E731  the loss doesn't change when all classes move
    a = np.concatenate((x, np.ones((len(x), 1))), 1)
    g = a.T @ (learn.softmax(a @ np.vstack((m.w, m.b))) - np.eye(int(y.max()) + 1)[y])
    g[:-1] += m.w
    assert np.abs(g).max() < 1e-4
    assert np.allclose(shift(np.vstack((m.w, m.b))), shift(dense.w), atol=1e-3)
    rows = sorted(m.scored(frame(spark, x, y)).collect(), key=lambda r: r["id"])
    assert np.allclose([r["p"] for r in rows], learn.softmax(x @ m.w + m.b)) and [r["predicted"] for r in rows] == [m.labels[k] for k in learn.softmax(x @ m.w + m.b).argmax(1)]


@pytest.mark.parametrize("two", [False, True])
def test_support_vectors_equal_dense(spark, data, two):
    x, y = data[0], (data[1] == 2).astype(int) if two else data[1]
    columns = [list(range(8)), [1, 3], [6]]
    with solvers.training(frame(spark, x, y)) as rows:
        found = solvers.support_vectors(rows, columns)
        accuracy = solvers.hinge_accuracy(rows, columns, found)
    for cols, w, share in zip(columns, found, accuracy, strict=True):
        dense = learn.LinearSVM().fit(x[:, cols], y, int(y.max()) + 1)
        assert np.allclose(w, dense.w, atol=1e-6)
        assert share == pytest.approx((dense.decision(x[:, cols]).argmax(1) == y).mean())
    same(listed(solvers.svc_select(frame(spark, x, y), 4)), selectors.linear_svc(fold((x, y))))


def test_wrappers_equal_dense(spark, data):
    same(listed(solvers.svm_wrapper(frame(spark, *data), 3)), selectors.svm_forward(fold(data, 3)))
    assert sorted(listed(solvers.svm_wrapper(frame(spark, *data), 8))[0]) == list(range(8))  # all K
    f = fold(data, 6)
    want = selectors._greedy(f, selectors._svm_score(f, 1.0, "l2", 1e-3, 100), False)
    same(listed(solvers.svm_wrapper(frame(spark, *data), 6, forward=False)), want)


def test_discriminant_equals_dense(spark, data):
    x, y = data
    with solvers.training(frame(spark, x, y)) as rows:
        m = solvers.discriminant(rows)
    dense = learn.LDA().fit(x, y, 3)
    assert np.allclose(learn.softmax(x @ m.w + m.b), dense.predict_proba(x), atol=1e-8)
    assert ((x @ m.w + m.b).argmax(1) == y).mean() > 0.6


def test_spectral_selectors_equal_dense(spark, data):
    x = data[0]
    s = x.T @ x / len(x)
    off = ~np.eye(8, dtype=bool)
    s[off & (s < 1 / np.sqrt(len(x)))] = 0
    values = np.linalg.eigvalsh(s)
    assert np.diff(values).min() > 1e-6  # vectors are settled but for signs
    same(listed(solvers.thresholded_eigen(frame(spark, *data), 4)), selectors.thresholded_eigen(fold(data)))
    same(listed(solvers.leading_eigenvector(frame(spark, *data), 4)), selectors.leading_eigenvector(fold(data)))


def test_robust_regression_equals_the_rows_by_rows_form(spark, data):
    x, y = data
    got = listed(solvers.robust_regression(frame(spark, x, y), 8, 0.5, 200, 1e-5))
    f, t = fold(data, 8), np.eye(3)[y]
    a, d, before = np.concatenate((x, 0.5 * np.eye(len(x))), 1), np.ones(8 + len(x)), np.inf
    for _ in range(200):
        da = a.T / d[:, None]
        u = da @ np.linalg.solve(a @ da, t)
        d = 0.5 / np.maximum(np.linalg.norm(u, axis=1), 1e-12)
        now = np.linalg.norm(x @ u[:8] - t, axis=1).sum() + 0.5 * np.linalg.norm(u[:8], axis=1).sum()
        if abs(before - now) < 1e-5:
            break
        before = now
    same(got, selectors.ranked(np.linalg.norm(u[:8], axis=1), f.k), 1e-3)


def test_fused_lasso_equals_dense(spark, data):
    same(listed(solvers.graph_fused(frame(spark, *data), 8)), selectors.graph_fused(fold(data, 8)))


def test_odd_tables(spark, data):
    x, y = data
    with pytest.raises(ValueError), solvers.training(frame(spark, x[:0], y[:0])):
        pass
    with solvers.training(frame(spark, x[:5], np.zeros(5, int))) as rows:  # one class
        assert rows.labels == [5] and solvers.logistic(rows).w.shape == (8, 1) and np.isfinite(solvers.discriminant(rows).w).all()
    with_null = frame(spark, x, y).unionByName(frame(spark, x[:1], y[:1]).selectExpr("id", "CAST(NULL AS INT) AS label", "features", "y"))
    with solvers.training(with_null) as rows:
        assert rows.n == len(x)
