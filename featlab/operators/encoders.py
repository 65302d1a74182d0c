"""Categories as numbers from a target: one aggregation a category, joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stats(df: DataFrame, category: str, target: str) -> DataFrame:
    y = F.col(target).cast("double")
    own = df.groupBy(category).agg(F.count(y).alias("_n"), F.sum(y).alias("_s"), F.var_samp(y).alias("_v"))
    everyone = df.agg(F.avg(y).alias("_g"), F.var_samp(y).alias("_gv"))
    return df.join(own, category).crossJoin(F.broadcast(everyone))  # the broadcast side is one row


def target_mean(df: DataFrame, category: str, target: str) -> DataFrame:
    """df with encoded: the target's mean in the category."""
    return _stats(df, category, target).select(*df.columns, (F.col("_s") / F.nullif(F.col("_n"), F.lit(0))).alias("encoded"))


def leave_one_out(df: DataFrame, category: str, target: str) -> DataFrame:
    """The mean over the category's other rows; the mean of all rows where there are none."""
    other = (F.col("_s") - F.col(target).cast("double")) / F.nullif(F.col("_n") - 1, F.lit(0))
    return _stats(df, category, target).select(*df.columns, F.coalesce(other, F.col("_g")).alias("encoded"))


def james_stein(df: DataFrame, category: str, target: str) -> DataFrame:
    """The category's mean drawn to that of all rows by the share of its variance in the sum of both."""
    v = F.coalesce(F.col("_v"), F.lit(0.0))
    b = F.coalesce(v / F.nullif(v + F.col("_gv"), F.lit(0.0)), F.lit(0.0))
    return _stats(df, category, target).select(*df.columns, ((1 - b) * F.col("_s") / F.col("_n") + b * F.col("_g")).alias("encoded"))
