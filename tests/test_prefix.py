from pyspark.sql import functions as F

from featlab.operators import prefix
from featlab.operators.prefix import below


def test_edges_do_not_depend_on_the_order_of_rows(spark):
    n = 200_000
    points = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") * 1.5).alias("x"), F.lit(1).cast("long").alias("c"))
    edges = {tuple(prefix._edges(points.repartition(k).sortWithinPartitions(F.xxhash64("x", F.lit(k))), ["g"], "x").first()["_edges"]) for k in (2, 3, 5)}
    assert len(edges) == 1
    (edge,) = edges
    assert len(edge) == prefix.BUCKETS - 1 and list(edge) == sorted(edge)
    assert max(b - a for a, b in zip((0, *edge), (*edge, n * 1.5), strict=True)) < 3 * n * 1.5 / prefix.BUCKETS
    got = below(points, ["g"], "x", ["c"])
    assert got.count() == n and got.where(F.col("below_c") * 1.5 != F.col("x")).isEmpty()


def test_nulls_repeated_groups_and_few_values(spark):
    rows = [("a", None, 5), ("a", 1.0, 2), ("a", 3.0, 4), ("b", 2.0, 7), ("c", None, 1)]
    got = below(spark.createDataFrame(rows, "g string, x double, c long"), ["g"], "x", ["c"]).collect()
    assert {(r["g"], r["x"]): r["below_c"] for r in got} == {("a", None): 0, ("a", 1.0): 5, ("a", 3.0): 7, ("b", 2.0): 0, ("c", None): 0}
