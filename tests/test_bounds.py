"""No thinning unless it is asked for, sums over smaller values, saves that can be cut short, ids by content."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlab.operators import filters, learn, metrics, prefix, redundancy, selectors, splits
from featlab.plans import pipeline, registry, results
from featlab.sources import matrices as M


@pytest.fixture(scope="module")
def long_table(spark):
    """120,000 rows, 8 features, of which 3 and 5 follow the label."""
    x = [(F.rand(10 + j) + (F.col("label") * 0.3 if j in (3, 5) else F.lit(0.0))).alias(f"x{j}") for j in range(8)]
    rows = spark.range(120_000).withColumn("label", (F.col("id") % 3).cast("int")).select("id", "label", *x)
    return rows.select("id", "label", F.array(*[f"x{j}" for j in range(8)]).alias("features")).cache()


@pytest.mark.parametrize("name", ["low_variance", "DT", "Skewness", "Univariate", "SVC", "CT", "LeadingEV"])
def test_selectors_take_all_rows(spark, long_table, name):
    fn, params = registry.REGISTRY[name].fn, registry.SETTINGS.get(name, {})
    got = selectors.select(long_table, fn, 3, params)
    assert got.columns == ["rank", "j", "score"]
    part = long_table.toPandas().sort_values("id")
    _, y = np.unique(part["label"], return_inverse=True)
    want = fn(selectors.Fold(np.array(part["features"].tolist()), y, 3, 3), **params)[0]
    assert [r["j"] for r in got.orderBy("rank").collect()] == [int(j) for j in want]


def test_thinning_is_asked_for_and_told(spark, long_table):
    got = selectors.select(long_table, selectors.variance, 2, max_rows=5000).first()
    assert got["n_rows"] == 120_000 and 4500 < got["rows_used"] < 5500
    assert selectors.forest_importance(long_table, 3, trees=2, tasks=1, max_rows=2000).first()["n_rows"] == 120_000


@pytest.mark.parametrize("name", ["LS", "ReliefF", "MCFS", "SVM_RBF", "CEI_GA"])
def test_square_matrices_are_refused_with_a_reason(name, monkeypatch):
    monkeypatch.setattr(learn, "SQUARE", 10_000)
    r = np.random.default_rng(0)
    f = selectors.Fold(r.random((200, 6)), r.integers(0, 2, 200), 2, 3)
    with pytest.raises(ValueError, match="don't fit in a task"):
        registry.REGISTRY[name].fn(f, **registry.SETTINGS.get(name, {}))


def test_all_test_rows_are_judged(spark, long_table):
    some = long_table.where("id < 30000")
    runs = pipeline.fold_runs(some, "low_variance", [2], ["LDA"], 2).collect()
    assert len(runs) == 2 and all(0.3 < r["accuracy"] < 0.8 for r in runs)


def test_below_equals_plain_sums(spark):
    r = np.random.default_rng(4)
    rows = [(g, float(v), int(n)) for g, size in ((0, 3000), (1, 40), (2, 1)) for v, n in zip(r.permutation(size) / 7 if g else r.exponential(1, size) ** 6, r.integers(0, 5, size), strict=True)]
    got = prefix.below(spark.createDataFrame(rows, "g int, x double, n long"), ["g"], "x", ["n"]).toPandas()
    assert len(got) == len(rows)
    for g, part in got.groupby("g"):
        part = part.sort_values("x")
        assert part["below_n"].tolist() == (part["n"].cumsum() - part["n"]).tolist()


def test_ties_and_orders_of_spans_and_curves(spark):
    r = np.random.default_rng(5)
    rows = [(i, int(r.integers(3)), j, float(r.integers(6))) for i in range(400) for j in range(2)]
    long = spark.createDataFrame(rows, "id long, label int, j int, x double")
    got, ks = {x["j"]: x["score"] for x in filters.cei(long).collect()}, {x["j"]: x["score"] for x in filters.ks(long).collect()}
    for j in range(2):
        own = sorted((x, i, y) for i, y, k, x in rows if k == j)
        shares, gaps = [], []
        for c in range(3):
            at = [k for k, (_, _, y) in enumerate(own) if y == c]
            shares.append(1 - len(at) / (at[-1] - at[0] + 1))
            of = lambda v, same: np.mean([x <= v for x, _, y in own if (y == c) == same])  # noqa: B023, E731
            gaps.append(max(abs(of(v, True) - of(v, False)) for v in range(6)))
        assert got[j] == pytest.approx(1 - min(shares)) and ks[j] == pytest.approx(np.mean(gaps))
    scores = spark.createDataFrame([(k, int(r.integers(2)), float(r.integers(5))) for k in range(300)], "id long, label int, score double")
    y, s = (np.array(v) for v in zip(*[(x["label"], x["score"]) for x in scores.collect()], strict=True))
    assert metrics.auc_binary(scores).first()["auc"] == pytest.approx(learn.auc(y, s))
    for x in metrics.pr_curve(scores).collect():
        taken = s >= x["score"]
        assert x["precision"] == pytest.approx(y[taken].mean()) and x["recall"] == pytest.approx(y[taken].sum() / y.sum())


def test_a_save_that_is_cut_short_loses_nothing(spark, tmp_path):
    path, jvm = str(tmp_path / "t"), spark.sparkContext._jvm
    schema = spark.range(1).schema
    results.save(spark.range(3), path)
    results.save(spark.range(5), path)
    assert results.open_or_create(spark, path, schema).count() == 5
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.rename(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".before"))  # as between two renames
    assert results.open_or_create(spark, path, schema).count() == 5
    results.save(results.open_or_create(spark, path, schema).unionByName(spark.range(1)), path)
    assert results.open_or_create(spark, path, schema).count() == 6 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_ids_come_from_the_content(spark):
    df = spark.createDataFrame([(k % 3, [float(k % 50), 1.0]) for k in range(300)], "y int, x array<double>")
    one, two = (M.matrix(d, None, "y", "x") for d in (df, df.repartition(7).orderBy("x")))
    assert one.count() == 300 and one.select("id").distinct().count() == 300
    assert sorted(r["id"] for r in one.collect()) == sorted(r["id"] for r in two.collect())
    folds = [{(r["id"], r["fold"]) for r in splits.stratified_folds(m, 5).collect()} for m in (one, two)]
    assert folds[0] == folds[1]


def test_redundancy_counts_within_a_domain_only(spark):
    r = np.random.default_rng(6)
    base = r.random((200, 3))
    x = np.column_stack([base[:, 0], base[:, 0] + 0.01 * r.random(200), base[:, 1], base[:, 2]])
    y = (1.5 * base[:, 0] + base[:, 1] > 1.25).astype(int)
    wide = spark.createDataFrame([(k, int(y[k]), x[k].tolist()) for k in range(200)], "id long, label int, features array<double>")
    everywhere = [v["j"] for v in redundancy.mrmr(wide, 2).orderBy("rank").collect()]
    apart = [v["j"] for v in redundancy.mrmr(wide, 2, same_domain=str).orderBy("rank").collect()]
    assert set(apart) == {0, 1} and set(everywhere) != {0, 1}
