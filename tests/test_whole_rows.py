"""Results come from all rows, not from the first or a few of them."""

import numpy as np

from featlab.operators import learn, selectors
from featlab.plans import hard


def test_split_importances_use_all_training_rows(spark):
    r = np.random.default_rng(5)
    n = 700  # the first 300 rows hold only the first feature, the others only the second
    x = np.zeros((n, 2))
    x[:300, 0], x[300:, 1] = r.random(300), r.random(n - 300)
    y = np.where(np.arange(n) < 300, x[:, 0] > 0.5, x[:, 1] > 0.5).astype(int)
    rows = [(i, int(y[i]), x[i].tolist(), i % 7 != 6) for i in range(n)]
    got = hard.single_split(spark.createDataFrame(rows, "id long, label int, features array<double>, train boolean"), None, [2]).first()
    a = np.array([t for *_, t in rows])
    trees = learn.Forest(50, 3).fit(x[a], y[a], 2, hard.SEED).trees
    want = np.abs(sum(learn.tree_shap(t, x[a]) for t in trees) / len(trees)).mean((0, 2))
    assert np.allclose(np.array(got["importance"]), np.sort(want)[::-1], atol=1e-9)
    assert got["selected"] == np.argsort(-want).tolist()


def _fold(n, k=3):
    r = np.random.default_rng(8)
    x = r.random((n, 4))
    return selectors.Fold(x, ((x[:, 0] + x[:, 1] * r.random(n)) * 1.5).astype(int).clip(0, 2), 3, k)


def test_shapley_explains_all_rows():
    f = _fold(900, 4)
    trees = learn.Forest(10, 3, False).fit(f.x, f.y, 3, f.seed).trees
    want = np.abs(sum(learn.tree_shap(t, f.x) for t in trees) / 10).mean((0, 2))
    order, value = selectors.shapley(f, n_estimators=10)
    assert order == np.argsort(-want).tolist() and np.allclose(value, want[order], atol=1e-9)


def test_graph_gradient_is_of_all_rows(monkeypatch):
    f, r, seen = _fold(700), np.random.default_rng(2), []
    y, w0 = learn.one_hot(f.y, 3), r.standard_normal((2, 6))
    noisy = [(r.standard_normal((6, 5)), r.standard_normal((6, 5)), r.standard_normal((5, 3))) for _ in range(3)]
    got = selectors.graph_gradient(f.x, y, [0, 2], w0, noisy, 0.9, cells=700 * 64)
    z = f.x[:, [0, 2]] / np.linalg.norm(f.x[:, [0, 2]], axis=1, keepdims=True)
    c = np.abs(z @ z.T)
    a = (c >= np.quantile(c, 0.9, axis=1, keepdims=True)).astype(float)
    a /= a.sum(1, keepdims=True)

    def loss(w):
        h = np.maximum(f.x @ w, 0)
        return sum(-np.log((learn.softmax(np.maximum(a @ h @ wl + h @ wr, 0) @ wo) * y).sum(1)).mean() for wl, wr, wo in noisy)

    whole = np.zeros((4, 6))
    whole[[0, 2]] = w0
    for at in ((0, 1), (1, 3), (3, 4)):  # features that are not chosen yet have weight zero
        d = np.zeros((4, 6))
        d[at] = 1e-6
        assert abs((loss(whole + d) - loss(whole - d)) / 2e-6 - got[at]) < 1e-5
    real = selectors.graph_gradient
    monkeypatch.setattr(selectors, "graph_gradient", lambda full, *rest: seen.append(len(full)) or real(full, *rest))
    selectors.graph_network(f, epochs=1)
    assert seen == [700] * 3
