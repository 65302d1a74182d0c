"""P x P matrices from one aggregation over the rows.

Each task sums the outer products of its rows, so what is shuffled is a P x P partial sum a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sums(wide: DataFrame) -> DataFrame:
    """(i, j, s) with s the sum of x_i x_j over rows, j from i up; row i = -1: sums of x_j; (-1, -1): the row count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in batches:
            if len(part):
                x = np.array(part["features"].tolist(), float)
                x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i - 1, "j": j - 1, "s": total[i, j]})

    return wide.select("features").mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def second_moments(wide: DataFrame) -> DataFrame:
    """(i, j, v): mean of x_i x_j, not centred, for i <= j."""
    s = sums(wide)
    n = s.where("i = -1 AND j = -1").select(F.col("s").alias("n"))
    return s.where("i >= 0").crossJoin(F.broadcast(n)).select("i", "j", (F.col("s") / F.col("n")).alias("v"))


def thresholded(wide: DataFrame, t: float = 1.0) -> DataFrame:
    """Second moments; entries off the diagonal under t / sqrt(n), negative ones too, become 0."""
    s = sums(wide)
    n = s.where("i = -1 AND j = -1").select(F.col("s").alias("n"))
    v = F.col("s") / F.col("n")
    return s.where("i >= 0").crossJoin(F.broadcast(n)).select("i", "j", F.when((F.col("i") != F.col("j")) & (v < t / F.sqrt("n")), 0.0).otherwise(v).alias("v"))


def covariance(wide: DataFrame) -> DataFrame:
    """(i, j, v): sample covariance for i <= j."""
    s = sums(wide)
    n = s.where("i = -1 AND j = -1").select(F.col("s").alias("n"))
    one = s.where("i = -1 AND j >= 0").select("j", "s")
    rows = s.where("i >= 0").withColumnRenamed("s", "xy").join(one.select(F.col("j").alias("i"), F.col("s").alias("a")), "i").join(one.select("j", F.col("s").alias("b")), "j").crossJoin(F.broadcast(n))
    return rows.select("i", "j", ((F.col("xy") - F.col("a") * F.col("b") / F.col("n")) / (F.col("n") - 1)).alias("v"))


def correlation(wide: DataFrame) -> DataFrame:
    """(i, j, r) for i < j; null where a feature is constant."""
    c = covariance(wide)
    d = c.where("i = j").select("j", F.when(F.col("v") > 1e-12, F.sqrt("v")).alias("s"))
    rows = c.where("i < j").join(d.select(F.col("j").alias("i"), F.col("s").alias("a")), "i").join(d.select("j", F.col("s").alias("b")), "j")
    return rows.select("i", "j", (F.col("v") / (F.col("a") * F.col("b"))).alias("r"))


def correlation_edges(wide: DataFrame, limit: float = 0.8) -> DataFrame:
    """(i, j) of features whose correlation exceeds the limit in size."""
    return correlation(wide).where(F.abs(F.col("r")) > limit).select("i", "j")


def extreme_entries(entries: DataFrame, k: int, largest: bool = True, value: str = "v") -> DataFrame:
    """The k largest or smallest entries of a matrix, ties by place."""
    v = F.round(value, 9)
    return entries.orderBy(v.desc() if largest else v.asc(), "i", "j").limit(k)


def l21_norm(long: DataFrame) -> DataFrame:
    """One row: the sum over rows of their Euclidean lengths."""
    return long.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n")).agg(F.sum("n").alias("norm"))


def masked(wide: DataFrame, masks: DataFrame) -> DataFrame:
    """(id, label, mask_id, features): each row under each mask (mask_id, mask)."""
    return wide.crossJoin(masks).select("id", "label", "mask_id", F.zip_with("features", "mask", lambda x, m: x * m).alias("features"))


def dense(entries: DataFrame, p: int, value: str = "v") -> np.ndarray:
    """The symmetric matrix of (i, j, value) with p(p+1)/2 entries at most, on the driver."""
    out = np.zeros((p, p))
    rows = entries.toPandas()
    out[rows["i"], rows["j"]] = rows[value]
    out[rows["j"], rows["i"]] = rows[value]
    return out


#: Sums that a task ships in a pass over the rows, about; of features with more products than this one at a time.
SHIPPED = 1 << 16


class Products:
    """Sums of products of features, a row of P numbers for each feature that is asked for, so that a greedy selector holds rows of what
    it chose and never P x P. A pass also fetches features that follow in `order`, as many as SHIPPED allows."""

    def __init__(self, wide: DataFrame, order: list[int] | None = None):
        self.wide, self.order, self.rows, self.passes = wide, order, {}, 0
        self.n, self.sums, self.squares = self._profile()
        self.p = len(self.sums)

    def _profile(self) -> tuple[int, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = None, 0
            for part in batches:
                if len(part):
                    x = np.array(part["features"].tolist(), float)
                    own = np.stack((x.sum(0), (x * x).sum(0)))
                    total, n = own if total is None else total + own, n + len(x)
            if total is not None:
                yield pd.DataFrame({"i": np.arange(total.shape[1]), "a": total[0], "b": total[1], "n": n})

        told = self.wide.select("features").mapInPandas(run, "i int, a double, b double, n long").groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n")).toPandas().sort_values("i")
        return (int(told["n"].iloc[0]) if len(told) else 0), told["a"].to_numpy(), told["b"].to_numpy()

    def _fetch(self, columns: list[int]) -> None:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for part in batches:
                if len(part):
                    x = np.array(part["features"].tolist(), float)
                    own = x[:, columns].T @ x
                    total = own if total is None else total + own
            if total is not None:
                for c, s in zip(columns, total, strict=True):
                    yield pd.DataFrame({"c": c, "i": np.arange(len(s)), "s": s})

        told = self.wide.select("features").mapInPandas(run, "c int, i int, s double").groupBy("c", "i").agg(F.sum("s").alias("s")).toPandas()
        self.passes += 1
        for c, own in told.groupby("c"):
            self.rows[c] = own.sort_values("i")["s"].to_numpy()

    def row(self, j: int) -> np.ndarray:
        """Σ x_j x_i by i."""
        if j not in self.rows:
            ahead = [i for i in (range(j + 1, self.p) if self.order is None else self.order) if i != j and i not in self.rows]
            self._fetch([j, *ahead[: max(1, SHIPPED // max(1, self.p)) - 1]])
        return self.rows[j]

    def centred(self, j: int) -> np.ndarray:
        """Σ (x_j - mean) (x_i - mean) by i."""
        return self.row(j) - self.sums[j] * self.sums / self.n

    def correlation(self, j: int) -> np.ndarray:
        """Pearson's r of j with each feature; nan where one is constant."""
        free = max(1, self.n - 1)
        v = np.maximum(self.squares - self.sums**2 / self.n, 0) / free
        sd = np.where(v > 1e-12, np.sqrt(v), np.nan)
        return self.centred(j) / free / (sd[j] * sd)
