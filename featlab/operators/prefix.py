"""Sums over all smaller values of a group, without one task for the group.

Edges near the quantiles of a group cut its values into buckets; running sums go over a bucket, and what the
buckets before it hold is added from a small table. Values that tie have to be merged first, so that a bucket
can be no more than one value. Spark may work the edges out more than once in a query, and rows arrive in
another order each time, so they come from values picked by a hash: a sketch of quantiles depends on the
order, and two sketches that differ would put a value in one bucket here and in another there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a group at most, and values that its edges are taken from, about.
BUCKETS, PICKED = 64, 1024


def _edges(points: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, _edges): BUCKETS - 1 ascending values of each group, the same for the same set of points."""
    rate = points.groupBy(*by).agg(F.ceil(F.count(x) / PICKED).alias("_rate"))
    some = points.join(rate, by).where(F.pmod(F.xxhash64(x), F.greatest("_rate", F.lit(1))) == 0)
    picked = some.groupBy(*by).agg(F.sort_array(F.collect_list(x)).alias("_all"))
    at = F.sequence(F.lit(1), F.lit(BUCKETS - 1))
    return picked.select(*by, F.transform(at, lambda k: F.get("_all", F.floor(k * F.size("_all") / BUCKETS).cast("int"))).alias("_edges"))


def below(points: DataFrame, by: list[str], x: str, sums: list[str]) -> DataFrame:
    """points: one row for each distinct (by, x). With below_c for each c of sums: the sum of c over the group's rows with a smaller x; null x comes first."""
    edges = _edges(points, by, x)
    step = int(BUCKETS**0.5)
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(step), F.lit(BUCKETS - 1), F.lit(step)), lambda k: F.get("_edges", k - 1)), lambda e: e < F.col(x))) * step
    fine = F.size(F.filter(F.slice("_edges", coarse + 1, F.lit(step)), lambda e: e < F.col(x)))
    rows = points.join(edges, by, "left").withColumn("_b", F.when(F.col(x).isNull(), -1).otherwise(coarse + fine)).drop("_edges")
    own = rows.groupBy(*by, "_b").agg(*[F.sum(c).alias(c) for c in sums])
    up = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS + 1 rows a group at most
    before = own.select(*by, "_b", *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"_before_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.select(*points.columns, "_b", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in sums])
    out = within.join(before, [*by, "_b"])
    return out.select(*points.columns, *[(F.col(f"_before_{c}") + F.col(f"_in_{c}")).alias(f"below_{c}") for c in sums])
