"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.llm.common import written


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Links (u, v), u > v. large: each larger neighbour links to the least one; small: each smaller neighbour and the node itself do."""
    if large:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        out = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """(node, component_id) for every node that has a link; component_id is the least node reachable.

    edges: any undirected links; repeats, either direction and loops are fine, null ends are ignored.
    Both steps only join and aggregate, so no group is gathered in one task; each round is written
    to the shared folder. Ends when a round changes nothing; a star forest is then left.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    links = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    links, before = written(links, "links"), None
    for _ in range(most):
        links = written(_star(_star(links, True), False), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
