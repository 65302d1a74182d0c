"""Greedy selectors fetch rows of products for what they choose, on tables with far more features than rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlab.operators import filters, moments, redundancy, selectors
from featlab.sources import matrices as M

P = 20_000


@pytest.fixture(scope="module")
def broad(spark):
    """120 rows of 20,000 features; 5, 70 and 900 follow the label, 71 repeats 70."""
    label = (F.col("id") % 3).cast("int")
    noise = lambda j: F.pmod(F.xxhash64("id", j), F.lit(1000)) / 1000.0
    x = F.transform(F.sequence(F.lit(0), F.lit(P - 1)), lambda j: noise(F.when(j == 71, 70).otherwise(j)) + F.when(j.isin(5, 70, 71, 900), label * (0.5 + F.sqrt(F.when(j == 71, 70).otherwise(j)) / 50)).otherwise(0.0))
    return spark.range(120).select("id", label.alias("label"), x.alias("features")).persist()


@pytest.fixture(scope="module")
def arrays(broad):
    rows = broad.orderBy("id").collect()
    return np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows], float)


def test_a_row_of_products_equals_the_dense_one(broad, arrays):
    x, _ = arrays
    got = moments.Products(broad)
    assert got.n == 120 and got.p == P
    assert np.allclose(got.correlation(70), np.corrcoef(x[:, 70], x, rowvar=False)[0, 1:], atol=1e-9)
    assert sorted(got.rows) == [70, 71, 72] and got.passes == 1  # as many as one pass may ship, not P x P
    assert np.allclose(got.row(72), x[:, 72] @ x) and got.passes == 1


def test_mrmr_with_many_features(broad, arrays):
    x, y = arrays
    groups = [x[y == c] for c in range(3)]
    mean = x.mean(0)
    between = sum(len(g) * (g.mean(0) - mean) ** 2 for g in groups) / 2
    rel = between / (sum(((g - g.mean(0)) ** 2).sum(0) for g in groups) / 117)
    chosen, red = [], []
    for _ in range(4):
        value = rel / np.mean(red, 0) if red else rel.copy()
        value[chosen] = -1
        chosen.append(int(np.round(value, 9).argmax()))
        red.append(np.maximum(redundancy.FLOOR, np.abs(np.corrcoef(x[:, chosen[-1]], x, rowvar=False)[0, 1:])))
    assert [r["j"] for r in redundancy.mrmr(broad, 4).orderBy("rank").collect()] == chosen


def test_alpha_investing_with_many_features(broad, arrays):
    x, y = arrays
    xc, yc = x - x.mean(0), y - y.mean()
    run, want = redundancy.AlphaInvesting(len(y)), []
    for j in range(P):
        if len(want) == 4:
            break
        cols = [*run.chosen, j]
        beta = np.linalg.lstsq(xc[:, cols], yc, rcond=None)[0]
        if run.offer(j, float(((yc - xc[:, cols] @ beta) ** 2).sum() / (yc @ yc))):
            want.append(j)
    assert [r["j"] for r in redundancy.alpha_investing(broad, 4).orderBy("rank").collect()] == want


def test_merit_fetches_what_it_chose(broad, arrays, monkeypatch):
    """The dense form's features, whether a pass compares one feature or all."""
    some = [*range(0, 30), 70, 71, 900]
    long = M.to_long(M.slice_features(broad, some))
    want = selectors.entropy_merit(selectors.Fold(arrays[0][:, some], arrays[1].astype(int), 3, 6))[0]
    assert filters.cfs_select(long, 6) == want
    monkeypatch.setattr(filters, "CFS_PAIRS", 1)
    assert filters.cfs_select(long, 6) == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id long, label int, features array<double>")
    assert redundancy.mrmr(empty, 3).count() == 0 and redundancy.alpha_investing(empty, 3).count() == 0
