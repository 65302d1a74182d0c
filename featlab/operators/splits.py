"""Splits by a hash of the row id: any executor gives a row the same fold.

A row's place in its class is its rank by that hash. Ranks are taken in buckets of the hash, 4,096 a
class, and the sizes of the buckets before are added, so no class has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _placed(wide: DataFrame, seed: int) -> DataFrame:
    """wide with _at, a row's place in its class from 1, and _size, the class's rows."""
    rows = wide.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = rows.groupBy("label", "_b").agg(F.count("*").alias("_k"))
    own = Window.partitionBy("label")
    before = sizes.select("label", "_b", F.coalesce(F.sum("_k").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_k").over(own).alias("_size"))
    at = F.row_number().over(Window.partitionBy("label", "_b").orderBy("_h", "id"))
    placed = rows.withColumn("_rn", at).join(before, ["label", "_b"])
    return placed.select(*wide.columns, (F.col("_before") + F.col("_rn")).alias("_at"), "_size")


def stratified_folds(wide: DataFrame, folds: int = 5, seed: int = 0) -> DataFrame:
    """wide with fold: rows of a class are dealt in turn in hash order, each class starting where the one before ended."""
    sizes = wide.groupBy("label").agg(F.count("*").alias("n"))
    before = sizes.withColumn("off", F.coalesce(F.sum("n").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("label", "off")
    return _placed(wide, seed).join(before, "label").select(*wide.columns, F.pmod(F.col("_at") - 1 + F.col("off"), F.lit(folds)).cast("int").alias("fold"))


def feasible_folds(wide: DataFrame, folds: int = 5, fallback: int = 2) -> int:
    """folds if each class has as many rows, else the fallback."""
    least = wide.groupBy("label").count().agg(F.min("count")).first()[0] or 0
    return folds if least >= folds else fallback


def train_test(wide: DataFrame, train_share: float, seed: int = 0) -> DataFrame:
    """wide with train: in each class the first rows in hash order, the rounded share of them."""
    return _placed(wide, seed).select(*wide.columns, (F.col("_at") <= F.round(F.col("_size") * train_share)).alias("train"))


def repair_classes(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each side gets all rows of the classes that it lacks and the other has."""
    more_train = test.join(train.select("label").distinct(), "label", "left_anti").select(*train.columns)
    more_test = train.join(test.select("label").distinct(), "label", "left_anti").select(*test.columns)
    return train.unionByName(more_train), test.unionByName(more_test)


def duplicate_singletons(wide: DataFrame) -> DataFrame:
    """Rows that are alone in their class twice."""
    sizes = wide.groupBy("label").agg(F.count("*").alias("n"))
    return wide.join(sizes, "label").withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("n") == 1, 2).otherwise(1)))).drop("n").select(*wide.columns, "copy")


def peel(wide: DataFrame, tenths: int, seed: int = 0) -> DataFrame:
    """Without floor(n d / 10) rows of each class, the first in hash order; if that is none at all, without one of the least class."""
    rows = _placed(wide, seed).withColumn("_quota", F.floor(F.col("_size") * tenths / 10))
    least = wide.groupBy("label").agg(F.floor(F.count("*") * tenths / 10).alias("q")).agg(F.sum("q").alias("all"), F.min("label").alias("first"))
    rows = rows.crossJoin(F.broadcast(least))
    quota = F.when((F.col("all") == 0) & (F.col("label") == F.col("first")), 1).otherwise(F.col("_quota"))
    return rows.where(F.col("_at") > quota).select(*wide.columns)


def training_share(counts: dict[int, int], start: float, least_share: float = 0.3, least_rows: int = 50, step: float = 0.01, tries: int = 100) -> float:
    """The first share from start down that leaves both sides the least share and rows; 0.3 if none does."""
    n, share = sum(counts.values()), start
    for _ in range(tries):
        a = sum(round(c * share) for c in counts.values())
        if min(a, n - a) >= least_rows and min(share, 1 - share) >= least_share:
            return round(share, 2)
        share -= step
        if share <= 0:
            break
    return least_share
