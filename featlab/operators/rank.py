"""Top-k rules. Ties go to the lower feature number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 9


def top_k(scores: DataFrame, k: int, by: list[str] | None = None, ascending: bool = False) -> DataFrame:
    """(by, rank, j, score): the k best of scores (by, j, score); rank 1 is the best. Scores count with DIGITS decimals.

    Without groups the k best come from a distributed top-k before ranks are given.
    """
    by = by or []
    s = F.round("score", DIGITS)
    rows = scores.select(*by, "j", s.alias("score"))
    order = [F.col("score").asc() if ascending else F.col("score").desc(), F.col("j").asc()]
    if not by:
        rows = rows.orderBy(*order).limit(k)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select(*by, "rank", "j", "score")


def column_order(selected: DataFrame) -> DataFrame:
    """Ranks by feature number, as a mask gives them."""
    return selected.withColumn("rank", F.row_number().over(Window.orderBy("j")))


def reversed_rank(selected: DataFrame, k: int) -> DataFrame:
    """The same features, best last."""
    return selected.withColumn("rank", F.lit(k + 1) - F.col("rank"))


def at_least_kth(scores: DataFrame, k: int) -> DataFrame:
    """All features whose score reaches the k-th largest; ties may give more than k."""
    kth = scores.orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("_kth"))
    return scores.join(F.broadcast(kth), F.col("score") >= F.col("_kth")).drop("_kth")


def tier(scores: DataFrame, k: int, h: int) -> DataFrame:
    """The h-th tier of k features: ranks (h-1)k+1 to hk."""
    return top_k(scores, k * h).where(F.col("rank") > k * (h - 1))
