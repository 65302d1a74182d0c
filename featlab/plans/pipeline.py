"""Cross-validated benchmark runs: select, slice, judge, agree; one Spark job for all folds and K of an algorithm."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.operators import splits
from featlab.operators.selectors import Fold  # noqa: F401
from featlab.plans import results
from featlab.plans.registry import EVALUATORS, FOLDS, K_LIST, SEED, THRESHOLD, comment

_FOLD = "fold int, k int, evaluator string, accuracy double, auc double, precision double, recall double, f1 double, seconds double, fs_seconds double, selected array<int>, importance array<double>"


#: Kept for those that set it: nothing depends on it.
FOLD = 0


def fold_runs(wide: DataFrame, algorithm: str | None, ks: list[int], evaluators: list[str], folds: int = FOLDS, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each fold, K and evaluator. algorithm None: all features, K the number of them.

    Each class that is missing from one side of a fold gets all its rows from the other. Matrices of all sizes are
    judged by `folds.runs`, over all rows, so what comes out doesn't depend on a form that a size picks.
    """
    from featlab.plans import folds as spread_folds

    return wide.sparkSession.createDataFrame(spread_folds.runs(wide, algorithm, ks, evaluators, folds, seed, threshold), _FOLD)


def _consensus(runs: DataFrame) -> DataFrame:
    """(k, evaluator, three lists): by frequency, mean rank and mean importance over folds, K features each."""
    cell = runs.select("k", "evaluator", "fold", F.posexplode(F.arrays_zip("selected", "importance")).alias("pos", "x"))
    per = cell.select("k", "evaluator", F.col("x.selected").alias("j"), F.struct("fold", "pos").alias("met"), "pos", F.col("x.importance").alias("imp"))
    stat = per.groupBy("k", "evaluator", "j").agg(F.count("*").alias("n"), F.min("met").alias("met"), F.avg("pos").alias("rank"), F.avg("imp").alias("imp"))
    lists = lambda *o: F.slice(F.transform(F.sort_array(F.collect_list(F.struct(*o, "j"))), lambda s: s["j"]), F.lit(1), F.first("k"))
    return stat.groupBy("k", "evaluator").agg(lists((-F.col("n")).alias("a"), F.col("met").alias("b")).alias("best_by_frequency"), lists(F.col("rank").alias("a")).alias("best_by_rank"), lists((-F.col("imp")).alias("a")).alias("best_by_importance"))


def cross_validate(wide: DataFrame, dataset: str, algorithm: str | None, repository: str = "", ks: list[int] | None = None, evaluators: list[str] | None = None, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Rows of the results table: one for each K up to the number of features and evaluator. algorithm None is the run without selection, kept as HD."""
    n, p = wide.agg(F.count("*"), F.max(F.size("features"))).first()
    folds = splits.feasible_folds(wide, folds)
    ks = [k for k in (ks or K_LIST) if k <= p] if algorithm else [p]
    began = time.perf_counter()
    # a row for each fold, K and evaluator; read several times below
    runs = wide.sparkSession.createDataFrame(fold_runs(wide, algorithm, ks, list(evaluators or EVALUATORS), folds, seed).collect(), _FOLD)
    rows = results.fold_summary(runs, ["k", "evaluator"])
    times = runs.groupBy("k", "evaluator").agg(F.count("*").cast("int").alias("good_folds"), F.round(F.avg("seconds"), 3).alias("avg_fit_seconds"), F.round(F.stddev_pop("seconds"), 3).alias("std_fit_seconds"), F.round(F.sum("fs_seconds"), 3).alias("fs_seconds"))
    out = rows.join(times, ["k", "evaluator"]).join(_consensus(runs), ["k", "evaluator"])
    const = {"repository": repository, "dataset": dataset, "fs": "FS" if algorithm else "HD", "algorithm": algorithm or "No FS", "hyper": comment(algorithm) if algorithm else "", "perform_cv": "Y"}
    out = out.withColumns({k: F.lit(v) for k, v in const.items()} | {"n": F.lit(int(n)), "p": F.lit(int(p)), "folds": F.lit(folds), "threshold": F.lit(THRESHOLD), "fs_hours": F.round(F.col("fs_seconds") / 3600, 6), "pipeline_seconds": F.lit(round(time.perf_counter() - began, 3))})
    return results.with_columns_of_run(out).select(*[F.col(f.name).cast(f.dataType) for f in results.RESULTS])


def benchmark(wide: DataFrame, dataset: str, path: str, group: str = "Fast", only: list[str] | None = None, repository: str = "") -> DataFrame:
    """Run what the table at path lacks for a dataset, baselines first, and upsert it; the table as it is then. ValueError if no algorithm is left by `only`."""
    from featlab.plans.registry import algorithms

    names = [a for a in algorithms(group) if only is None or a in only]
    if not names:
        raise ValueError(f"none of {only} is in group {group}")
    spark = wide.sparkSession
    for name in [None, *names]:
        done = results.open_or_create(spark, path)
        own = done.where((F.col("dataset") == dataset) & (F.col("algorithm") == (name or "No FS")))
        if not own.isEmpty():
            continue
        new = cross_validate(wide, dataset, name, repository)
        results.save(results.upsert_table("results", done, new), path)
    return results.open_or_create(spark, path)
