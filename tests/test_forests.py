"""Histogram trees against plain trees on the same bins, grown row by row with masks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlab.operators import forests as fo
from featlab.operators import learn


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(5)
    y = r.integers(0, 3, 160)
    x = np.abs(r.normal(size=(160, 7)))
    x[:, 2] += y
    x[:, 4] += 0.7 * (y == 1)
    x[:, 5] = 1.0  # constant
    x[:, 6] = np.round(x[:, 6])  # ties
    return x, y


def frame(spark, x, y):
    rows = [(i, int(c) * 3 + 1, [float(v) for v in row], 5, "b") for i, (row, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, label int, features array<double>, y int, b string").repartition(3)


def gini(w):
    return w.sum() - (w**2).sum() / w.sum() if w.sum() else 0.0


def squares(t, n):
    return -(t.sum() ** 2) / n if n else 0.0


def plain_tree(b, stat, depth, kind, seed, tree, m, extra, p):
    """stat: (rows, statistics). Gains by feature, and a function from rows to their leaf's sums."""
    gains, leaf = {}, {}

    def impurity(rows):
        return gini(stat[rows].sum(0)) if kind == "gini" else squares(stat[rows, 0], stat[rows, 2].sum())

    def size(rows):
        return stat[rows].sum() if kind == "gini" else stat[rows, 2].sum()

    def split(rows, number, level):
        found = None
        if level < depth and not (kind == "gini" and number and np.count_nonzero(stat[rows].sum(0) > 1e-9) <= 1):
            candidates, u = fo.draws(seed, tree, number, p, m) if m < p or extra else (np.arange(p), None)
            own = rows[stat[rows].sum(1) > 1e-9] if kind == "gini" else rows
            for q, j in enumerate(candidates):
                held = b[own, j]
                cuts = range(63)
                if extra:
                    cuts = [int(held.min() + np.floor(u[q] * (int(held.max()) - int(held.min()))))]
                for c in cuts:
                    low, high = rows[b[rows, j] <= c], rows[b[rows, j] > c]
                    if size(low) > 1e-9 and size(high) > 1e-9:
                        g = impurity(rows) - impurity(low) - impurity(high)
                        if g > 1e-12 * max(1.0, size(rows)) and (found is None or g > found[0] + 1e-12):
                            found = (g, int(j), low, high)
        if found is None:
            for i in rows:
                leaf[i] = stat[rows].sum(0)
            return
        gains[found[1]] = gains.get(found[1], 0.0) + found[0]
        split(found[2], 2 * number + 1, level + 1)
        split(found[3], 2 * number + 2, level + 1)

    split(np.arange(len(b)), 0, 0)
    out = np.zeros(p)
    for j, g in gains.items():
        out[j] = g
    return (out / out.sum() if out.sum() else out), leaf


def bins_of(x, bins=64):
    edges = []
    for j in range(x.shape[1]):
        s = np.sort(x[:, j])
        edges.append(np.unique([s[int(np.ceil(k * len(s) / bins)) - 1] for k in range(1, bins + 1)])[:-1])
    return edges, np.stack([(x[:, [j]] > e[None]).sum(1) for j, e in enumerate(edges)], axis=1)


def scores(df):
    return np.array([r["score"] for r in df.orderBy("j").collect()])


@pytest.fixture(params=[1 << 22, 500])
def histogram(request, monkeypatch):
    """Whole levels in one job, and a few trees a job with the histograms added up by a shuffle."""
    monkeypatch.setattr(fo, "HISTOGRAM", request.param)


def test_edges_are_quantiles(spark, data):
    x, y = data
    edges, b = bins_of(x)
    got = fo.bin_edges(frame(spark, x, y))
    assert all(np.array_equal(a, e) for a, e in zip(got, edges, strict=True)) and (fo.in_bins(x, got) == b).all()


@pytest.mark.parametrize("extra", [True, False])
def test_forests_equal_plain_trees(spark, data, histogram, extra):
    x, y = data
    _, b = bins_of(x)
    want = np.zeros(x.shape[1])
    for t in range(12):
        stat = np.eye(3)[y]
        if not extra:
            stat = stat * np.searchsorted(fo._TIMES, fo._hashed(np.arange(len(y)), t, 4), "right")[:, None]
        want += plain_tree(b, stat, 3, "gini", 4, t, 2, extra, x.shape[1])[0] / 12
    assert scores(fo.importances(frame(spark, x, y), 12, 3, extra, 4)) == pytest.approx(want, abs=1e-6)


def test_ada_boost_equals_plain_rounds(spark, data, histogram):
    x, y = data
    _, b = bins_of(x)
    w, total, want = np.ones(len(y)) / len(y), 0.0, np.zeros(x.shape[1])
    n = 0
    for k in range(6):
        gain, leaf = plain_tree(b, np.eye(3)[y] * w[:, None], 2, "gini", 0, k, x.shape[1], False, x.shape[1])
        wrong = np.array([leaf[i].argmax() != y[i] for i in range(len(y))])
        e = w[wrong].sum() / w.sum()
        if e >= 1 - 1 / 3:
            break
        a = 0.5 * (np.log((1 - e) / e) + np.log(2))
        want, total, n = want + a * gain, total + a, n + 1
        w = w * np.exp(a * wrong)
        w /= w.sum()
    assert n > 3
    assert scores(fo.boosted_importances(frame(spark, x, y), 6, 0.5, 2)) == pytest.approx(want / total, abs=1e-6)


def test_boosting_equals_plain_rounds(spark, data, histogram):
    x, y = data
    y = (y == 1).astype(int)
    _, b = bins_of(x)
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    with fo.binned(frame(spark, x, y)) as own:
        trees = fo.boosting(own, 4, 0.3, 2)
    for k in range(4):
        q = 1 / (1 + np.exp(-f))
        gain, leaf = plain_tree(b, np.stack((y - q, q * (1 - q), np.ones(len(y))), 1), 2, "squares", 0, k, x.shape[1], False, x.shape[1])
        assert trees[k].gain == pytest.approx(gain, abs=1e-6)
        step = np.array([0.3 * leaf[i][0] / leaf[i][1] for i in range(len(y))])
        assert trees[k].predict(x)[:, 0] == pytest.approx(step, abs=1e-9)
        f = f + step


def brute_shap(tree, x):
    """All subsets of all features."""
    from itertools import combinations
    from math import factorial

    p, n = x.shape[1], x.shape[0]

    def expect(known, node):
        f = tree.feature[node]
        if f < 0:
            return np.tile(tree.value[node], (n, 1))
        a, b = (expect(known, c) for c in (tree.left[node], tree.right[node]))
        wa, wb = (tree.weight[c] for c in (tree.left[node], tree.right[node]))
        return np.where((x[:, f] <= tree.limit[node])[:, None], a, b) if f in known else (wa * a + wb * b) / (wa + wb)

    out = np.zeros((n, p, len(tree.value[0])))
    for k in range(p):
        for s in combinations(range(p), k):
            for f in set(range(p)) - set(s):
                out[:, f] += factorial(k) * factorial(p - k - 1) / factorial(p) * (expect({*s, f}, 0) - expect(set(s), 0))
    return out


def test_shapley_values_equal_all_subsets(spark, data):
    x, y = data
    with fo.binned(frame(spark, x, y)) as own:
        trees = fo.forest(own, 3, 4, False, 2)
        labels = own.labels
    want = [brute_shap(t, x) for t in trees]
    assert all(np.allclose(learn.tree_shap(t, x), s) for t, s in zip(trees, want, strict=True)) and labels == [1, 4, 7]
    rows = fo.shap_rows(frame(spark, x, y), trees, labels, 13).collect()
    got = np.zeros((len(x), x.shape[1], 3))
    for r in rows:
        got[r["id"], r["j"], labels.index(r["class"])] = r["contribution"]
    assert np.allclose(got, sum(want) / 3)
    assert scores(fo.shap_importance(frame(spark, x, y), trees, 1 / 3, 11)) == pytest.approx(np.abs(sum(want) / 3).mean(2).mean(0), abs=1e-9)
    mean = {r["id"]: np.array(r["p"]) for r in fo.probabilities(frame(spark, x, y), trees).collect()}
    assert all(np.allclose(mean[i], np.mean([t.predict(x[[i]])[0] for t in trees], 0)) for i in range(0, len(x), 17))


def test_odd_tables(spark, data):
    x, y = data
    assert scores(fo.importances(frame(spark, x[:0], y[:0]), 3)).tolist() == []
    one = scores(fo.importances(frame(spark, x[:40], np.zeros(40, int)), 3))  # one class: nothing to split
    assert one.tolist() == [0.0] * 7
    same = scores(fo.importances(frame(spark, np.ones((9, 2)), np.arange(9) % 2), 3))
    assert same.tolist() == [0.0, 0.0]
    with_null = frame(spark, x, y).withColumn("label", F.when(F.col("id") >= 100, None).otherwise(F.col("label")))
    assert scores(fo.importances(with_null, 5)) == pytest.approx(scores(fo.importances(frame(spark, x[:100], y[:100]), 5)))
