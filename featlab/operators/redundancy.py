"""Selectors that weigh a feature against those chosen before it; the driver holds a row of P sums for each feature that was chosen, or fetched along with it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlab.operators import filters, forests, moments
from featlab.sources.matrices import to_long

FLOOR = 0.001


def _frame(spark: SparkSession, rows: list[tuple[int, float]]) -> DataFrame:
    return spark.createDataFrame([(k + 1, int(j), float(s)) for k, (j, s) in enumerate(rows)], "rank int, j int, score double")


def mrmr(wide: DataFrame, k: int, relevance: str | Callable[[DataFrame], DataFrame] = "f", denominator: str = "mean", same_domain: Callable[[int], str] | None = None) -> DataFrame:
    """(rank, j, score): relevance over redundancy, greedy.

    relevance: f, ks, f_regression, forest (importances of a random forest), or a function of the long frame. Redundancy of a candidate with each
    chosen feature is |correlation|, 0.001 at least and where undefined; their mean or maximum divides,
    1.0 exactly counts as no use. Features without relevance are out. same_domain: redundancy counts
    between features of one domain only.
    """
    long = to_long(wide)
    named = {"f": filters.f_classif, "ks": filters.ks, "f_regression": filters.f_regression, "forest": lambda _: forests.importances(wide, extra=False)}
    score = named[relevance](long) if isinstance(relevance, str) else relevance(long)
    rel = {r["j"]: r["score"] for r in score.collect() if r["score"] is not None and r["score"] > 0}  # a number for each feature
    chosen: list[tuple[int, float]] = []
    with kept(wide) as rows:
        products = moments.Products(rows, sorted(rel, key=lambda f: (-rel[f], f)))
        left = np.array(sorted(rel), int)
        gain = np.array([rel[f] for f in left.tolist()])
        most, total, count = np.zeros(len(left)), np.zeros(len(left)), np.zeros(len(left), int)
        domain = None if same_domain is None else np.array([same_domain(f) for f in left.tolist()], object)
        free = np.ones(len(left), bool)
        while free.any() and len(chosen) < k:
            d = most if denominator == "max" else total / np.maximum(count, 1)
            value = np.where(count == 0, gain, np.where(d == 1.0, 0.0, gain / np.where((d == 1.0) | (count == 0), 1.0, d)))
            at = np.flatnonzero(free)
            best = int(at[np.round(value[at], 9).argmax()])  # of equals the first feature
            chosen.append((int(left[best]), float(value[best])))
            free[best] = False
            if free.any() and len(chosen) < k:
                r = np.abs(products.correlation(int(left[best]))[left])
                r = np.where(np.isnan(r), FLOOR, np.maximum(FLOOR, r))
                use = np.ones(len(left), bool) if domain is None else domain == domain[best]
                most, total, count = np.where(use, np.maximum(most, r), most), total + np.where(use, r, 0.0), count + use
    return _frame(wide.sparkSession, chosen)


@contextmanager
def kept(wide: DataFrame) -> Iterator[DataFrame]:
    """The features, cached while a selector passes over them."""
    rows = wide.select("features").persist()
    try:
        yield rows
    finally:
        rows.unpersist()


class AlphaInvesting:
    """Streamwise selection from sums of products: features are offered in turn, wealth pays for tests and grows with each accepted one."""

    def __init__(self, n: float, w0: float = 10.0, dw: float = 0.01):
        self.n, self.w, self.dw, self.seen, self.chosen, self.error = n, w0, dw, 0, [], 1.0

    def offer(self, j: int, error: float) -> bool:
        """error: 1 - R² with feature j beside the chosen ones."""
        alpha = self.w / 2 / (self.seen + 1)
        self.seen += 1
        p = math.exp((error - self.error) / (2 * self.error / self.n)) if self.error > 0 else 1.0
        if p < alpha:
            self.chosen.append(j)
            self.error, self.w = error, self.w + self.dw - alpha
            return True
        self.w -= alpha
        return False


def residual_share(gram: np.ndarray, cross: np.ndarray, total: float) -> float:
    """1 - R² of least squares on centred features with these sums of products, among them and with the label."""
    beta = np.linalg.lstsq(gram, cross, rcond=None)[0]
    return float(max(0.0, 1 - cross @ beta / total)) if total > 0 else 1.0


def alpha_investing(wide: DataFrame, k: int, w0: float = 10.0, dw: float = 0.01) -> DataFrame:
    """(rank, j, score): the first k accepted features, score the error after each. A pass for the label and one for each accepted feature give the sums."""
    with kept(wide.withColumn("features", F.concat("features", F.array(F.col("label").cast("double"))))) as rows:
        products = moments.Products(rows)
        p = max(0, products.p - 1)  # the label is the last column
        out: list[tuple[int, float]] = []
        if p:
            cross = products.centred(p)
            total, squares = float(cross[p]), products.squares - products.sums**2 / products.n
            run, near = AlphaInvesting(products.n, w0, dw), np.zeros((0, p + 1))  # a row for each chosen feature
            for j in range(p):
                if len(out) == k:
                    break
                cols = [*run.chosen, j]
                gram = np.concatenate((near[:, cols], [[*near[:, j], squares[j]]]))
                if run.offer(j, residual_share(gram, cross[cols], total)):
                    out.append((j, run.error))
                    if len(out) < k:
                        near = np.concatenate((near, [products.centred(j)]))
    return _frame(wide.sparkSession, out)
