"""Metrics over predictions (id, label, predicted) and scores (id, label, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.operators.prefix import below


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def weighted_prf(pred: DataFrame) -> DataFrame:
    """One row: accuracy and weighted precision, recall and F1; undefined ones count as 0."""
    c = confusion(pred)
    right = c.where("label = predicted").select("label", F.col("n").alias("tp"))
    support = c.groupBy("label").agg(F.sum("n").alias("s"))
    given = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("g"))
    r = support.join(right, "label", "left").join(given, "label", "left").select("s", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("g", F.lit(0)).alias("g"))
    p = F.coalesce(F.col("tp") / F.nullif(F.col("g"), F.lit(0)), F.lit(0.0))
    q = F.col("tp") / F.col("s")
    f = F.coalesce(2 * p * q / F.nullif(p + q, F.lit(0.0)), F.lit(0.0))
    w = lambda x: F.sum(F.col("s") * x) / F.sum("s")
    return r.agg((F.sum("tp") / F.sum("s")).alias("accuracy"), w(p).alias("precision"), w(q).alias("recall"), w(f).alias("f1"))


def _auc(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc) of (by, y 0/1, score): the rank sum with mean ranks for ties, from counts by distinct score.

    Counts below a score go by buckets of distinct scores, so no task holds a group.
    """
    v = scores.groupBy(*by, "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"), F.count("*").alias("n"))
    w = below(v, by, "score", ["neg"]).withColumn("win", F.col("pos") * (F.col("below_neg") + F.col("neg") / 2))
    return w.groupBy(*by).agg((F.sum("win") / F.nullif(F.sum("pos") * F.sum(F.col("n") - F.col("pos")), F.lit(0))).alias("auc"))


def auc_binary(scores: DataFrame, positive: int = 1) -> DataFrame:
    return _auc(scores.select(F.lit(0).alias("g"), (F.col("label") == positive).cast("int").alias("y"), "score"), ["g"]).select("auc")


def auc_ovr(scores: DataFrame) -> DataFrame:
    """scores: (id, label, class, score). The mean over classes of each against the rest."""
    return _auc(scores.select("class", (F.col("label") == F.col("class")).cast("int").alias("y"), "score"), ["class"]).agg(F.avg("auc").alias("auc"))


def auc_ovo(scores: DataFrame) -> DataFrame:
    """The mean over ordered pairs of classes, each by the score of its first."""
    classes = scores.select(F.col("class").alias("other")).distinct()
    pairs = scores.join(classes, (F.col("other") != F.col("class")) & F.col("label").isin(F.col("class"), F.col("other")))
    rows = pairs.select("class", "other", (F.col("label") == F.col("class")).cast("int").alias("y"), "score")
    return _auc(rows, ["class", "other"]).agg(F.avg("auc").alias("auc"))


def pr_curve(scores: DataFrame, positive: int = 1) -> DataFrame:
    """(score, precision, recall) at each distinct score, from the highest down."""
    v = scores.groupBy("score").agg(F.sum((F.col("label") == positive).cast("int")).alias("pos"), F.count("*").alias("n"))
    all_ = v.agg(F.sum("pos").alias("p"), F.sum("n").alias("all"))
    at = below(v.withColumn("g", F.lit(0)), ["g"], "score", ["pos", "n"]).crossJoin(F.broadcast(all_))  # one row
    tp, k = F.col("p") - F.col("below_pos"), F.col("all") - F.col("below_n")
    return at.select("score", (tp / k).alias("precision"), (tp / F.nullif(F.col("p"), F.lit(0))).alias("recall"))
