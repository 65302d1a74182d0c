"""Permutation importance as a join: the model travels, the permuted values are dealt to the rows they land in.

Rows are numbered by the order of a hash of their id. For each feature and repeat a seeded bijection of these
numbers, n -> (a n + b) mod rows with a coprime to it, says which row gets whose value; that order is random
already, so a stride through it is a shuffle. The permuted cells meet their rows in one join, a map scores each
row with each of its P x repeats values in place, and only counts of right answers come back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are numbered in one task, about.
NUMBERED = 4096


def numbered(wide: DataFrame, seed: int = 0) -> DataFrame:
    """(n, label, features), n from 0 without gaps in the order of a hash of the id. Ranges of the hash are counted, then numbered each by itself."""
    rows = wide.select("id", "label", "features", F.xxhash64("id", F.lit(seed)).alias("h"))
    bits = min(16, max(0, math.ceil(math.log2(max(1, wide.count() / NUMBERED)))))
    rows = rows.withColumn("range", F.shiftright(F.col("h"), 64 - bits) if bits else F.lit(0).cast("long"))
    counts = sorted((r["range"], r["count"]) for r in rows.groupBy("range").count().collect())  # 65,536 numbers at most
    starts = np.cumsum([0, *[c for _, c in counts]])[:-1].tolist()
    first = wide.sparkSession.createDataFrame([(r, int(s)) for (r, _), s in zip(counts, starts, strict=True)], "range long, start long")
    nth = F.row_number().over(Window.partitionBy("range").orderBy("h", "id", "label", "features"))
    return rows.withColumn("nth", nth).join(first, "range").select((F.col("start") + F.col("nth") - 1).alias("n"), "label", "features")


def bijection(rows: int, j: int, repeat: int, seed: int = 0) -> tuple[int, int]:
    """(a, b) of the permutation of a feature in a repeat; a stays below 2^31, so products fit a long for up to 4e9 rows."""
    rng = np.random.default_rng([seed, j, repeat])
    a = 1
    for _ in range(1000 if rows > 2 else 0):
        a = int(rng.integers(1, min(rows, 1 << 31)))
        if math.gcd(a, rows) == 1 and a != 1:
            break
        a = 1
    return a, int(rng.integers(0, max(1, rows)))


def importance(wide: DataFrame, predict: Callable[[np.ndarray], np.ndarray], repeats: int = 5, seed: int = 0) -> DataFrame:
    """(j, score): how much the share of rows that predict(features) labels right falls, on average over repeats, when feature j is permuted.

    predict: from (rows, P) numbers to labels; it is sent to the tasks. A row meets P x repeats numbers. No rows: no features.
    """
    about = wide.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("p")).first()
    rows_, p = about["n"], about["p"] or 0
    spark = wide.sparkSession
    if not rows_:
        return spark.createDataFrame([], "j int, score double")
    rows = numbered(wide, seed)
    moves = spark.createDataFrame([(j, r, *bijection(rows_, j, r, seed)) for j in range(p) for r in range(repeats)], "j int, repeat int, a long, b long")
    moves = moves.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("repeat", "a", "b"))).alias("moves"))  # P rows of `repeats` structs
    cells = rows.select("n", F.posexplode("features").alias("j", "x")).join(moves, "j").select("n", "j", "x", F.explode("moves").alias("m"))
    dealt = cells.select(F.pmod(F.col("m.a") * F.col("n") + F.col("m.b"), F.lit(rows_)).alias("n"), ((F.col("j") * repeats) + F.col("m.repeat")).alias("at"), "x")
    given = dealt.groupBy("n").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("given"))
    met = rows.join(given, "n").select("label", "features", "given")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right, base = np.zeros((p, repeats)), 0
        for part in batches:
            for at in range(0, len(part), 512):
                some = part.iloc[at : at + 512]
                x, y = np.array(some["features"].tolist(), float), some["label"].to_numpy()
                other = np.array(some["given"].tolist(), float).reshape(len(x), p, repeats)
                base += int((predict(x) == y).sum())
                for j in range(p):
                    z = np.repeat(x, repeats, axis=0)
                    z[:, j] = other[:, j].ravel()
                    right[j] += (predict(z).reshape(len(x), repeats) == y[:, None]).sum(0)
        yield pd.DataFrame({"j": np.arange(p, dtype=np.int32), "gap": (base - right).sum(1)})

    return met.mapInPandas(run, "j int, gap double").groupBy("j").agg((F.sum("gap") / (repeats * rows_)).alias("score"))
