"""Nearest rows through the metric index against all distances, on clustered, repeated and odd rows."""

import numpy as np
import pytest

from featlab.operators import graphs, metric_index


def _rows(spark, x, y):
    return spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y, strict=True))], "id long, label int, features array<double>")


@pytest.fixture(scope="module")
def clustered():
    """600 rows in 12 far clusters, 150 of them one and the same row, two zero rows."""
    r = np.random.default_rng(3)
    x = r.normal(0, 20, (12, 6))[r.integers(0, 12, 600)] + r.normal(0, 0.3, (600, 6))
    x[50:200] = x[50]
    x[[7, 9]] = 0
    return np.round(x, 3), r.integers(0, 3, 600)


def _plain(x, y, k, metric, within, ax=None, ay=None):
    own = ax is None
    ax, ay = (x, y) if own else (ax, ay)
    if metric == "cosine":
        u, v = (z / np.maximum(1e-12, np.linalg.norm(z, axis=1, keepdims=True)) for z in (x, ax))
        d = -(u @ v.T)
    else:
        d = ((x[:, None] - ax[None]) ** 2).sum(2)
    d, out = np.round(d, 9), []
    for i in range(len(x)):
        for c in {"any": [None], "same": [y[i]], "each": np.unique(ay)}[within]:
            at = [j for j in range(len(ax)) if (c is None or ay[j] == c) and not (within == "each" and own and i == j)]
            out += [(i, -1 if c is None or within == "same" else int(c), float(v)) for v in np.sort(d[i, at])[:k]]
    return np.array(sorted(out))


def _found(rows, metric, within):
    sign = -1 if metric == "cosine" else 1
    return np.array(sorted((r["src"], r["dst_label"] if within == "each" else -1, sign * r["d"]) for r in rows))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("within", ["any", "same", "each"])
def test_index_equals_all_distances(spark, clustered, monkeypatch, metric, within):
    monkeypatch.setattr(graphs, "BLOCK_ROWS", 120)
    x, y = clustered
    got = graphs.neighbours(_rows(spark, x, y), 4, metric, within).collect()
    want = _plain(x, y, 4, metric, within)
    assert len(got) == len(want) and np.abs(_found(got, metric, within) - want).max() < 1e-8
    assert len({(r["src"], r["dst"]) for r in got}) == len(got)


def test_ties_go_to_the_least_id(spark, clustered, monkeypatch):
    monkeypatch.setattr(graphs, "BLOCK_ROWS", 120)
    got = graphs.neighbours(_rows(spark, *clustered), 5).where("src BETWEEN 50 AND 199").collect()
    assert {(r["dst"], r["d"]) for r in got} == {(j, 0.0) for j in range(50, 55)}


def test_other_rows_are_searched(spark, clustered, monkeypatch):
    monkeypatch.setattr(graphs, "BLOCK_ROWS", 120)
    x, y = clustered
    got = graphs.neighbours(_rows(spark, x[:100], y[:100]), 3, against=_rows(spark, x[100:], y[100:])).collect()
    assert np.abs(_found(got, "euclidean", "any") - _plain(x[:100], y[:100], 3, "euclidean", "any", x[100:], y[100:])).max() < 1e-8


def test_far_blocks_are_not_compared(spark, clustered):
    x, y = clustered
    seen = metric_index.visited(_rows(spark, x, y), 4, block_rows=40).first()
    assert seen["all_cells"] == 600 * 600 and seen["pairs"] < 0.5 * seen["all_pairs"] and seen["cells_read"] < 0.3 * seen["all_cells"]


def test_few_rows_and_none(spark, clustered, monkeypatch):
    monkeypatch.setattr(graphs, "BLOCK_ROWS", 2)
    x, y = clustered
    assert graphs.neighbours(_rows(spark, x[:1], y[:1]), 3).count() == 1  # fewer than k: all there are
    assert graphs.neighbours(_rows(spark, x[:5], y[:5]), 9).count() == 25
    empty = _rows(spark, x[:0], y[:0])
    assert graphs.neighbours(empty, 3).count() == 0
    assert graphs.neighbours(_rows(spark, x[:5], y[:5]), 3, against=empty).count() == 0
    assert graphs.neighbours(empty, 3, against=_rows(spark, x[:5], y[:5])).count() == 0
