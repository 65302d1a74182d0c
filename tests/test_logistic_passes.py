"""The logistic model's passes over the rows: few, though columns are alike and large."""

import numpy as np

from featlab.operators import learn, solvers


def test_logistic_needs_few_passes_where_columns_are_alike(spark, monkeypatch):
    r = np.random.default_rng(0)
    y = r.integers(0, 4, 400)
    x = np.abs(r.normal(0, 1, (400, 1)) * 5 + r.normal(0, 0.2, (400, 12)) + y[:, None] * np.eye(4, 12)[y] * 0.1)
    wide = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(400)], "id long, label int, features array<double>")
    passes, added = [], solvers.added
    monkeypatch.setattr(solvers, "added", lambda *a: passes.append(1) or added(*a))
    with solvers.training(wide) as rows:
        model = solvers.logistic(rows)
    assert len(passes) <= 30
    q = learn.softmax(x @ model.w + model.b)
    q[np.arange(400), y] -= 1
    slope = np.concatenate((x.T @ q + model.w, q.sum(0)[None]))  # the penalised loss's, which has one minimum
    assert np.abs(slope).max() < 1e-2
