"""Multi-cluster selection over shares of the rows against the dense form."""

import numpy as np

from featlab.operators import selectors, spectral


def test_shares_give_the_dense_selection(spark, monkeypatch):
    r = np.random.default_rng(3)
    y = np.arange(300) % 3
    x = r.normal(0, 1, (300, 8)) + 0.5 * np.eye(3)[y] @ r.normal(0, 1, (3, 8))
    wide = spark.createDataFrame([(7 * i - 100, int(y[i]), x[i].tolist()) for i in range(300)], "id long, label int, features array<double>")
    want, scores = selectors.multi_cluster(selectors.Fold(x, y, 3, 5))
    monkeypatch.setattr(spectral, "DENSE", 90)
    monkeypatch.setattr(selectors, "heat_graph", None)  # no matrix of rows by rows
    got = spectral.multi_cluster(wide, 5).orderBy("rank").collect()
    assert [q["j"] for q in got] == want and np.allclose([q["score"] for q in got], scores, rtol=1e-3, atol=1e-9)
