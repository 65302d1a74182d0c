"""Result tables, benchmark runs and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import featlab.__main__ as command
from featlab.operators import splits
from featlab.plans import hard, peeling, pipeline, registry, results
from featlab.streaming import streams


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(i, i % 3, [float((i * 7 + j * 13) % 11) + (3.0 * (i % 3) if j == 2 else 0.0) for j in range(6)]) for i in range(90)]
    return spark.createDataFrame(rows, "id long, label int, features array<double>").cache()


def test_the_results_table_has_its_columns(wide):
    rows = pipeline.cross_validate(wide, "d", "low_variance", "r", [2, 4, 60], ["KNN", "LDA"])
    assert rows.schema.names == results.RESULTS.names and len(rows.schema.names) == 46
    got = rows.collect()
    assert {(r["k"], r["evaluator"]) for r in got} == {(k, e) for k in (2, 4) for e in ("KNN", "LDA")}
    for r in got:
        assert len(r["accuracy_list"]) == r["good_folds"] == 5 and r["max_accuracy"] == max(r["accuracy_list"])
        assert len(r["best_by_frequency"]) == r["k"] and set(r["best_by_rank"]) <= set(range(6))
        assert r["run_key"].startswith("d_low_variance_90_6_")


def test_benchmark_runs_what_is_missing(spark, wide, tmp_path):
    path = str(tmp_path / "results")
    first = pipeline.benchmark(wide, "d", path, "Fast", ["DT"]).select("algorithm", "fs").distinct().collect()
    assert {tuple(r) for r in first} == {("No FS", "HD"), ("DT", "FS")}
    before = spark.read.parquet(path).count()
    again = pipeline.benchmark(wide, "d", path, "Fast", ["DT", "low_variance"])
    assert again.count() > before and again.where("algorithm = 'DT'").count() == again.where("algorithm = 'low_variance'").count()
    with pytest.raises(ValueError):
        pipeline.benchmark(wide, "d", path, "Fast", ["nothing"])


def test_registry(spark):
    assert [len(registry.algorithms(g)) for g in ("All", "Fast", "GPU", "Slow")] == [27, 19, 5, 4]
    with pytest.raises(ValueError):
        registry.algorithms("Other")
    registry.register_selector("mine", lambda f, **_: ([0], [1.0]))
    try:
        assert registry.settings_table(spark).where("algorithm = 'mine'").count() == 1
    finally:
        registry.REGISTRY.pop("mine"), registry.SETTINGS.pop("mine")


def test_upserts_keep_first_or_last(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], "key string, v int, s int")
    new = spark.createDataFrame([("a", 2, 1), ("c", 2, 2), ("c", 3, 3)], "key string, v int, s int")
    rows = lambda keep: {r["key"]: r["v"] for r in results.upsert(old, new, ["key"], keep, "s").collect()}
    assert rows("first") == {"a": 1, "b": 1, "c": 2} and rows("last") == {"a": 2, "b": 1, "c": 3}


def test_open_or_create(spark, tmp_path):
    assert results.open_or_create(spark, str(tmp_path / "none")).count() == 0
    spark.range(1).select(F.lit("d").alias("dataset"), F.lit(1).alias("extra")).write.parquet(str(tmp_path / "t"))
    df = results.open_or_create(spark, str(tmp_path / "t"))
    assert df.columns[:46] == results.RESULTS.names and df.columns[46:] == ["extra"] and df.first()["dataset"] == "d"


def test_peel_until(wide):
    scores = iter([0.95, 0.8, 0.65, 0.1])
    now, steps = peeling.peel_until(wide, lambda df: next(scores), 0.7)
    assert [d for d, _ in steps] == [0, 1, 2] and now.count() == 72


def test_features_as_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("r", 50.0, j, e) for j, e in enumerate([0.9, 0.85, 0.85, 0.4])]
    df = spark.createDataFrame(rows, "run string, n double, j int, error double")
    df.write.parquet(src)
    q = streams.alpha_investing_stream(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("accepted").outputMode("append").start()
    try:
        q.processAllAvailable()
        got = {r["j"]: r["accepted"] for r in spark.table("accepted").collect()}
    finally:
        q.stop()
    assert len(got) == 4 and got[0] and got[1]


def test_results_as_a_stream(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    new = results.ensure_columns(spark.createDataFrame([("k1", "d", 1), ("k1", "d", 1), ("k2", "d", 5)], "run_key string, dataset string, k int"), results.RESULTS)
    new.write.parquet(src)
    q = streams.upsert_stream(spark.readStream.schema(new.schema).parquet(src), out, str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["run_key"] for r in spark.read.parquet(out).collect()) == ["k1", "k2"]


def test_single_splits_and_the_outcome_row(spark, wide):
    rows = splits.train_test(wide, 0.5).cache()
    fs, hd = hard.single_split(rows, "DT", [2, 3]), hard.single_split(rows, None, [6])
    assert [r["k"] for r in fs.orderBy("k").collect()] == [2, 3] and hard.leading(hd, "auc")["k"] == 6
    known = hard.rescored(rows, [2, 0])
    assert set(hard.leading(known, "auc")["selected"]) == {0, 2}
    out = hard.document(spark, "d", {"n": 90, "p": 6, "classes": 3, "hard_t": 0.7}, hd, fs, hd, fs, {"auc": known, "accuracy": known}).first()
    assert out["label"] in ("Hard Interesting", "Hard Not Interesting") and out["auc_overlap"] is not None and out["leading_fs"] == "DT"
    assert hard.sweep(rows, 0.0, 2.0, 3, [2], "Fast").count() == 1  # the first one is good enough


def test_contributions_sum_to_probabilities(wide):
    rows = hard.shap_contributions(wide, trees=5).groupBy("id").agg(F.sum("contribution").alias("s"))
    assert rows.where("abs(s) > 1e-6").count() == 0  # over classes they cancel out


def test_selected_importance():
    r = np.random.default_rng(0)
    x, y = r.random((80, 5)), r.integers(0, 2, 80)
    x[:, 3] += y
    order, share, total = hard.selected_importance(x, y, 2, [0, 3, 4])
    assert order[0] == 3 and share == sorted(share, reverse=True) and 0 < total <= 1


def test_command_line(spark, wide, tmp_path, capsys):
    path = str(tmp_path / "repo" / "toy")
    wide.select(F.col("features").alias("X"), (F.col("label") + 1).alias("Y")).write.parquet(path)
    command.main([path, "--algorithms", "DT", "--results", str(tmp_path / "out")])
    assert "DT" in capsys.readouterr().out
