"""One selection from those of the folds: (fold, rank, j[, importance])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.operators.rank import top_k


def by_frequency(selections: DataFrame, k: int) -> DataFrame:
    """(rank, j): the most often chosen; of equals the one met first, by fold, then rank."""
    c = selections.groupBy("j").agg(F.count("*").alias("n"), F.min(F.struct("fold", "rank")).alias("met"))
    best = c.orderBy(F.desc("n"), "met").limit(k).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "met", "j"))).alias("x"))
    return best.select(F.posexplode("x").alias("p", "y")).select((F.col("p") + 1).alias("rank"), F.col("y.j").alias("j"))


def by_average_rank(selections: DataFrame, k: int) -> DataFrame:
    """(rank, j, score): the lowest mean rank over the folds that chose it."""
    return top_k(selections.groupBy("j").agg(F.avg("rank").alias("score")), k, ascending=True)


def by_mean_importance(importances: DataFrame, k: int) -> DataFrame:
    """(rank, j, score): the highest mean importance."""
    return top_k(importances.groupBy("j").agg(F.avg("importance").alias("score")), k)


def overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row of two feature sets (j): common, only in either, share of the first that is common (null if it is empty), and mutual information in nats of membership."""
    both = first.select("j").distinct().withColumn("a", F.lit(1)).join(second.select("j").distinct().withColumn("b", F.lit(1)), "j", "full_outer").select("j", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a, b = F.col("a") == 1, F.col("b") == 1
    t = both.agg(n(a & b).alias("n11"), n(a & ~b).alias("n10"), n(~a & b).alias("n01"), F.count("*").alias("n"))
    t = t.withColumn("a1", F.col("n11") + F.col("n10")).withColumn("b1", F.col("n11") + F.col("n01"))
    cell = lambda c, r, s: F.when(c > 0, c / F.col("n") * F.ln(c * F.col("n") / (r * s))).otherwise(0.0)
    mi = cell(F.col("n11"), F.col("a1"), F.col("b1")) + cell(F.col("n10"), F.col("a1"), F.col("n") - F.col("b1")) + cell(F.col("n01"), F.col("n") - F.col("a1"), F.col("b1"))
    return t.select(F.col("n11").alias("common"), F.col("n10").alias("only_first"), F.col("n01").alias("only_second"), (F.col("n11") / F.nullif(F.col("a1"), F.lit(0))).alias("overlap"), mi.alias("mutual_information"))
