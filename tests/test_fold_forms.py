"""Folds are judged in one way, whatever the size of the matrix."""

import numpy as np

from featlab.plans import pipeline


def test_folds_of_any_size_are_judged_in_the_same_way(spark, monkeypatch):
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 80)
    x = np.round(r.normal(0, 1, (80, 3)) + y[:, None], 3)
    wide = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(80)], "id long, label int, features array<double>")
    timed = ("seconds", "fs_seconds")
    rows = lambda: [{k: v for k, v in q.asDict().items() if k not in timed} for q in pipeline.fold_runs(wide, "low_variance", [2], ["ETREE"], 2).orderBy("fold").collect()]
    monkeypatch.setattr(pipeline, "FOLD", 0)
    large = rows()
    monkeypatch.setattr(pipeline, "FOLD", 1 << 40)
    assert rows() == large
