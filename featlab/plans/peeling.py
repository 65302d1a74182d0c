"""Harder variants of datasets and how well selection holds up on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlab.functions import expressions as X
from featlab.operators import splits


def fs_contribution(auc_fs: Column, auc_hd: Column) -> tuple[Column, Column]:
    """The gain by selection, and Yes or No."""
    gain = F.round(auc_fs - auc_hd, 3)
    return gain, F.when(gain > 0, "Yes").otherwise("No")


def ground_truth_contribution(gt: Column, hard: Column) -> tuple[Column, Column, Column]:
    """Absolute and percentage gain of the original selection on the hard dataset, and whether it is of interest (10 % or more)."""
    percent = F.round((gt / F.nullif(hard, F.lit(0.0)) - 1) * 100, 3)
    return F.round(gt - hard, 3), percent, F.when(percent >= 10, "Hard Interesting").otherwise("")


def hardness_columns(df: DataFrame, high: float = 0.9, low: float = 0.7) -> DataFrame:
    return df.withColumns({"accuracy_score": X.hardness_label(F.col("avg_accuracy"), high, low), "auc_score": X.hardness_label(F.col("avg_auc"), high, low)})


def top_features(indices: Column, top: int = 60, fallback: int = 10) -> Column:
    """The first `top` features of a list, the first `fallback` of a shorter one."""
    return F.slice(indices, F.lit(1), F.when(F.size(indices) >= top, top).otherwise(fallback))


def peel_until(wide: DataFrame, score: Callable[[DataFrame], float], low: float = 0.7, seed: int = 0) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Peel a tenth more of each class at a time until the baseline scores under `low`, at most nine tenths; the variant and the scores on the way."""
    steps, now = [], wide
    for d in range(10):
        now = splits.peel(wide, d, seed) if d else wide
        steps.append((d, score(now)))
        if steps[-1][1] < low:
            break
    return now, steps
