"""The results table: a row for each run and evaluator, its keys, upserts, work lists and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featlab.functions import expressions as X

METRICS = ("accuracy", "auc", "precision", "recall", "f1")

#: 46 columns.
RESULTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("run_key", "repository", "dataset", "fs", "algorithm")]
    + [T.StructField("n", T.IntegerType()), T.StructField("p", T.IntegerType()), T.StructField("pn", T.DoubleType()), T.StructField("pn_class", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("k_percent", T.DoubleType()), T.StructField("ln_k", T.DoubleType())]
    + [T.StructField("hyper", T.StringType()), T.StructField("perform_cv", T.StringType()), T.StructField("folds", T.IntegerType()), T.StructField("good_folds", T.IntegerType()), T.StructField("threshold", T.DoubleType())]
    + [T.StructField(n, T.DoubleType()) for n in ("pipeline_seconds", "fs_seconds", "fs_hours")]
    + [T.StructField("evaluator", T.StringType()), T.StructField("avg_fit_seconds", T.DoubleType()), T.StructField("std_fit_seconds", T.DoubleType())]
    + [T.StructField(f"{a}_{m}", T.DoubleType()) for m in METRICS for a in ("avg", "std")]
    + [T.StructField(f"max_{m}", T.DoubleType()) for m in METRICS]
    + [T.StructField(f"{m}_list", T.ArrayType(T.DoubleType())) for m in METRICS]
    + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("best_by_frequency", "best_by_rank", "best_by_importance")]
)


def open_or_create(spark: SparkSession, path: str, schema: T.StructType = RESULTS) -> DataFrame:
    """The table at path, or an empty one; columns that it lacks are null. Where a save was cut short, the table before it."""
    fs, at = _paths(spark, path, "", ".before")
    found = next((p for p in at if fs.exists(p)), None)
    if found is None:
        return spark.createDataFrame([], schema)
    return ensure_columns(spark.read.parquet(found.toString()), schema)


def _paths(spark: SparkSession, path: str, *ends: str):
    """The file system, and path with each of the ends."""
    jvm = spark.sparkContext._jvm
    at = [jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + e) for e in ends]
    return at[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns first, null where df lacks them, then df's others."""
    return df.sparkSession.createDataFrame([], schema).unionByName(df, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: str = "first", seq: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """Both tables with one row a key: the first (old rows win) or the last one. seq: a column that orders rows of one table."""
    at = lambda df, k: df.withColumn("_side", F.lit(k)).withColumn("_seq", F.col(seq) if seq else F.monotonically_increasing_id())
    rows = at(old, 0).unionByName(at(new, 1), allowMissingColumns=True)
    by = [F.col("_side"), F.col("_seq")] if keep == "first" else [F.col("_side").desc(), F.col("_seq").desc()]
    one = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_rn = 1").drop("_rn", "_side", "_seq")
    return one.orderBy(*order) if order else one


#: Keys, which row stays, and the order written, of each table.
UPSERTS = {
    "results": (["run_key", "perform_cv", "folds", "fs"], "first", [F.asc, ("dataset", "algorithm", "k")]),
    "original_fs": (["repository", "dataset", "hard_t", "training_percent", "algorithm", "k"], "last", [F.asc, ("repository", "dataset", "hard_t", "training_percent", "algorithm", "k")]),
    "change_log": (["repository", "dataset", "removed_percent", "fs", "hard_t", "training_percent"], "last", None),
    "full_results": (["repository", "dataset", "hard_t", "training_percent", "removed_percent", "fs", "algorithm", "k", "hyper", "evaluator"], "last", None),
    "dataset_labels": (["repository", "dataset", "hard_t", "training_percent", "n", "p", "fs", "algorithm"], "first", None),
}


def upsert_table(name: str, old: DataFrame, new: DataFrame, seq: str | None = None) -> DataFrame:
    keys, keep, order = UPSERTS[name]
    columns = [order[0](c) for c in order[1]] if order else None
    if name == "full_results":
        columns = [F.desc(c) if c in ("hard_t", "training_percent") else F.asc(c) for c in keys]
    if name == "change_log":
        columns = [F.asc("repository"), F.asc("dataset"), F.desc("training_length"), F.asc("fs")]
    return upsert(old, new, keys, keep, seq, columns)


def save(df: DataFrame, path: str) -> None:
    """Overwrite beside the table, then swap: df may come from path itself, and at each moment the old or the new table is there in whole."""
    fs, (now, new, old) = _paths(df.sparkSession, path, "", ".next", ".before")
    df.write.mode("overwrite").parquet(new.toString())
    if fs.exists(now):
        fs.delete(old, True)  # what a save that was cut short has left; path is there, so it isn't needed
        fs.rename(now, old)
    fs.rename(new, now)
    fs.delete(old, True)


def where_all(df: DataFrame, conditions: dict[str, object]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in conditions.items()], F.lit(True)))


def filter_runs(df: DataFrame, dataset: str, algorithm: str, n: int, p: int, hyper: str, perform_cv: str, folds: int, train_percent: float | None = None) -> DataFrame:
    """The finished runs of one setting; by folds under cross-validation, else by training size."""
    own = {"dataset": dataset, "algorithm": algorithm, "n": n, "p": p, "hyper": hyper, "perform_cv": perform_cv}
    return where_all(df, own | ({"folds": folds} if perform_cv == "Y" else {"train_percent": train_percent}))


def k_limit(grid: DataFrame) -> DataFrame:
    """Without the K that exceed the number of features."""
    return grid.where(F.col("k") <= F.col("p"))


def worklist(settings: DataFrame, ks: list[int], evaluators: list[str], done: DataFrame) -> DataFrame:
    """(settings' columns, k, missing): for each setting and K up to p the evaluators that no finished FS run has, if any.

    settings has dataset, algorithm, p; done has dataset, algorithm, k, evaluator.
    """
    grid = k_limit(settings.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))).withColumn("evaluator", F.explode(F.array(*[F.lit(e) for e in evaluators])))
    left = grid.join(done.select("dataset", "algorithm", "k", "evaluator").distinct(), ["dataset", "algorithm", "k", "evaluator"], "left_anti")
    return left.groupBy(*settings.columns, "k").agg(F.array_sort(F.collect_set("evaluator")).alias("missing"))


def baseline_presence(settings: DataFrame, evaluators: list[str], done: DataFrame) -> DataFrame:
    """(settings' columns, present, complete): whether runs without selection exist, and with all evaluators."""
    seen = done.where("fs IN ('HD', 'No FS')").groupBy("dataset", "algorithm").agg(F.count_distinct("evaluator").alias("seen"))
    return settings.join(seen, ["dataset", "algorithm"], "left").select(*settings.columns, F.when(F.col("seen") > 0, "Y").otherwise("N").alias("present"), (F.coalesce("seen", F.lit(0)) >= len(evaluators)).alias("complete"))


def best_by_algorithm(df: DataFrame, metric: str, std: str) -> DataFrame:
    """df with the maxima of algorithm and dataset, flags of the rows that reach them, the distinct K, settings and algorithms there, and of the dataset's best the least deviation."""
    a, d = ["repository", "dataset", "algorithm", "n", "p"], ["repository", "dataset", "n", "p"]
    wa, wd = Window.partitionBy(*a), Window.partitionBy(*d)
    at = lambda top: F.col(metric) == F.col(top)
    names = lambda c, top, w: F.array_sort(F.collect_set(F.when(at(top), F.col(c))).over(w))
    rows = df.withColumn("algorithm_max", F.max(metric).over(wa)).withColumn("dataset_max", F.max(metric).over(wd))
    rows = rows.withColumn("algorithm_best", F.when(at("algorithm_max"), "Y").otherwise("N")).withColumn("dataset_best", F.when(at("dataset_max"), "Y").otherwise("N"))
    rows = rows.withColumn("algorithm_best_ks", names("k", "algorithm_max", wa)).withColumn("algorithm_best_hyper", names("hyper", "algorithm_max", wa))
    rows = rows.withColumn("dataset_best_ks", names("k", "dataset_max", wd)).withColumn("dataset_best_algorithms", names("algorithm", "dataset_max", wd))
    rows = rows.withColumn("dataset_min_std", F.min(F.when(at("dataset_max"), F.col(std))).over(wd))
    best = at("dataset_max") & (F.col(std) == F.col("dataset_min_std"))
    return rows.withColumn("best", F.when(best, "Y").otherwise("")).withColumn("best_text", F.when(best, F.concat(F.col(metric).cast("string"), F.lit(" ± "), F.col(std).cast("string"))).otherwise(""))


def best_by_dataset(df: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """(dataset, fs, metric, best, std, label, keys): of each dataset, with and without selection, and each metric the highest mean, of these the least deviation, and the keys that have both, joined by " ; ".

    metrics: mean column to deviation column.
    """
    long = df.select("dataset", "fs", "run_key", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("mean"), F.col(s).cast("double").alias("std")) for m, s in metrics.items()])).alias("x")).select("dataset", "fs", "run_key", "x.*")
    by = ["dataset", "fs", "metric"]
    top = long.groupBy(*by).agg(F.max("mean").alias("mean"))
    low = long.join(top, [*by, "mean"]).groupBy(*by, "mean").agg(F.min("std").alias("std"))
    keys = long.join(low, [*by, "mean", "std"]).groupBy(*by, "mean", "std").agg(F.array_join(F.array_sort(F.collect_list("run_key")), " ; ").alias("keys"))
    return keys.select("dataset", F.when(F.col("fs") == "HD", "No FS").otherwise(F.col("fs")).alias("fs"), "metric", X.custom_round(F.col("mean")).alias("best"), X.custom_round(F.col("std")).alias("std"), X.performance_label(F.col("mean")).alias("label"), "keys")


def summary(best: DataFrame) -> DataFrame:
    """A row for each dataset and metric that has runs with and without selection: both results, their settings, and the dataset's category."""
    side = lambda fs, p: best.where(F.col("fs") == fs).select("dataset", "metric", *[F.col(c).alias(f"{p}_{c}") for c in ("best", "std", "label", "keys")])
    both = side("No FS", "no_fs").join(side("FS", "fs"), ["dataset", "metric"])
    text = lambda p: X.mean_std_label(F.col(f"{p}_best"), F.col(f"{p}_std"), F.col(f"{p}_label"))
    out = [F.col("dataset"), F.col("metric"), text("no_fs").alias("no_fs"), text("fs").alias("fs"), X.dataset_category(F.col("no_fs_label"), F.col("fs_label")).alias("category")]
    for p in ("no_fs", "fs"):
        out += [X.key_algorithm(F.col(f"{p}_keys")).alias(f"{p}_algorithm"), X.key_hyperparameters(F.col(f"{p}_keys")).alias(f"{p}_hyper")]
    for p in ("no_fs", "fs"):
        out += [X.percent(F.col(f"{p}_best"), 1).alias(f"{p}_average"), X.percent(F.col(f"{p}_std"), 2).alias(f"{p}_std")]
    return both.select(*out)


def leaders(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    """(by, best, algorithms): the distinct algorithms that reach the best score, joined by commas."""
    top = df.groupBy(*by).agg(F.max(metric).alias(metric))
    return df.join(top, [*by, metric]).groupBy(*by).agg(F.max(metric).alias("best"), F.array_join(F.array_sort(F.collect_set("algorithm")), ",").alias("algorithms"))


def light(df: DataFrame, seq: str, metrics: list[str]) -> DataFrame:
    """The FS rows that lead their dataset by one of the metrics (of equals the first by seq), each once."""
    rows = df.where("fs = 'FS'")
    top = [rows.withColumn("_rn", F.row_number().over(Window.partitionBy("dataset", "fs").orderBy(F.desc(m), F.asc(seq)))).where("_rn = 1").drop("_rn") for m in metrics]
    return reduce(lambda a, b: a.unionByName(b), top).distinct()


def flatten(df: DataFrame, by: list[str], evaluators: list[str], metrics: list[str]) -> DataFrame:
    """One row for each `by` with columns evaluator_metric."""
    return df.groupBy(*by).agg(*[F.max(F.when(F.col("evaluator") == e, F.round(m, 3))).alias(f"{e.lower()}_{m}") for e in evaluators for m in metrics])


def fold_summary(folds: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(by, avg_, std_ (population), max_ and list of each metric over folds in order)."""
    aggs = []
    for m in metrics:
        aggs += [F.round(F.avg(m), 3).alias(f"avg_{m}"), F.round(F.stddev_pop(m), 3).alias(f"std_{m}"), F.round(F.max(m), 3).alias(f"max_{m}"), F.transform(F.sort_array(F.collect_list(F.struct("fold", F.round(m, 3).alias("v")))), lambda s: s["v"]).alias(f"{m}_list")]
    return folds.groupBy(*by).agg(*aggs)


def with_columns_of_run(df: DataFrame) -> DataFrame:
    """pn, pn_class, k_percent, ln_k and run_key from dataset, algorithm, n, p, k, hyper, threshold and evaluator."""
    pn = F.round(F.col("p") / F.col("n"), 3)
    return df.withColumns({"pn": pn, "pn_class": X.pn_class(F.col("p") / F.col("n")), "k_percent": X.k_percent(F.col("k"), F.col("p")), "ln_k": X.ln_k(F.col("k"), F.col("p")), "run_key": X.run_key(*[F.col(c) for c in ("dataset", "algorithm", "n", "p", "k", "hyper", "threshold", "evaluator")])})


def change_log(df: DataFrame, by: list[str], algorithms: list[str], value: str = "score") -> DataFrame:
    """A row for each `by` with a column for each algorithm and the best one's value marked."""
    wide = df.groupBy(*by).pivot("algorithm", algorithms).agg(F.max(value))
    best = F.greatest(*[F.coalesce(F.col(a), F.lit(float("-inf"))) for a in algorithms])
    return wide.select(*by, *[F.when(F.col(a) == best, F.concat(F.lit("**"), F.col(a).cast("string"), F.lit("**"))).otherwise(F.col(a).cast("string")).alias(a) for a in algorithms])


def as_json(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, json): the rows of a group as one JSON text, in order of the columns."""
    return df.groupBy(*by).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*columns)))).alias("json"))
