"""Folds judged over all rows against folds in one task each."""

import numpy as np
import pytest

from featlab.operators import learn
from featlab.plans import pipeline


@pytest.mark.parametrize("classes", [2, 3])
def test_folds_over_all_rows_equal_folds_in_a_task(spark, monkeypatch, classes):
    r = np.random.default_rng(classes)
    y = r.integers(0, classes, 150)
    x = np.round(r.normal(0, 1, (150, 5)) + y[:, None] * np.array([0, 1.5, 0, 2.5, 0]), 3)
    wide = spark.createDataFrame([(i, int(y[i]) * 2 + 1, x[i].tolist()) for i in range(150)], "id long, label int, features array<double>")
    names = ["LR", "KNN", "LDA", "ETREE", "SVM", "RF"] if classes == 3 else ["LR", "KNN", "SVM"]
    rows = lambda: {(q["fold"], q["evaluator"]): q for q in pipeline.fold_runs(wide, "low_variance", [3], names, 2).collect()}
    dense = rows()
    monkeypatch.setattr(pipeline, "FOLD", 0)
    monkeypatch.setattr(pipeline, "Fold", None)  # no fold meets in a task
    got = rows()
    assert set(got) == set(dense)
    for at, q in got.items():
        exact = at[1] in ("LR", "KNN", "LDA", "RF")
        assert set(q["selected"]) == set(dense[at]["selected"])
        assert all(abs(q[c] - dense[at][c]) < (2e-3 if exact else 0.1) for c in ("accuracy", "auc", "precision", "recall", "f1")), (at, q, dense[at])
        if at[1] in ("LR", "RF"):
            assert np.allclose(q["importance"], dense[at]["importance"], atol=2e-3)


def test_kernel_machines_of_large_folds_raise_no_error(spark, monkeypatch):
    monkeypatch.setattr(learn, "SQUARE", 10_000)
    wide = spark.createDataFrame([(i, i % 2, [float(i % 2) + (i * 7 % 11) / 20, float(i * 13 % 17)]) for i in range(150)], "id long, label int, features array<double>")
    assert [q["accuracy"] > 0.9 for q in pipeline.fold_runs(wide, "DT", [2], ["SVM"], 2).collect()] == [True, True]
