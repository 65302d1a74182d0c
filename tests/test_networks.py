"""The concrete autoencoder over shares of the rows against the one in a task."""

import numpy as np

from featlab.operators import networks, selectors


def test_shares_of_rows_train_one_network(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (240, 2))[:, [0, 1, 0, 1, 0, 0]] + r.normal(0, 0.05, (240, 6))
    wide = spark.createDataFrame([(i, i % 2, x[i].tolist()) for i in range(240)], "id long, label int, features array<double>")
    want, scores = selectors.concrete_autoencoder(selectors.Fold(x, np.arange(240) % 2, 2, 3), num_epochs=20)
    got = networks.concrete_autoencoder(wide, 3, num_epochs=20).orderBy("rank").collect()  # one share: the same
    assert [q["j"] for q in got] == want and np.allclose([q["score"] for q in got], scores, atol=1e-3)
    monkeypatch.setattr(networks, "LEAST", 60)
    seen, train = [], selectors.Concrete.train
    monkeypatch.setattr(selectors.Concrete, "train", lambda *a: (seen.append(1), train(*a)))
    shared = networks.concrete_autoencoder(wide, 3, num_epochs=20).orderBy("rank").collect()
    assert len({q["j"] for q in shared}) == 3 and not seen  # no part of it is trained by the driver
    assert [tuple(q) for q in shared] == [tuple(q) for q in networks.concrete_autoencoder(wide, 3, num_epochs=20).orderBy("rank").collect()]
