from pyspark.sql import functions as F

from featlab.operators import filters, graphs
from featlab.queries import QUERIES


def test_cells_are_never_the_side_that_is_broadcast(spark, tmp_path):
    """Spark took the cells of a table of small columns for the smaller side, so the driver held a row for each of them."""
    n = 20_000
    spark.range(n).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), *[(F.col("id") % m).cast("double").alias(c) for m, c in ((7, "l_quantity"), (5, "l_extendedprice"), (3, "l_discount"), (2, "l_tax"))], F.when(F.col("id") % 2 == 0, "O").otherwise("F").alias("l_linestatus"), F.lit("A").alias("l_returnflag")).write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("minmax_scale_stats", "zscore_stats"):
        out = QUERIES[name](spark, str(tmp_path))
        out.collect()
        assert "BuildLeft" not in out._jdf.queryExecution().executedPlan().toString()
    out = filters.min_max_scaled(spark.createDataFrame([(1, 0, 0, 2.0), (2, 0, 0, 6.0), (1, 0, 1, 5.0)], "id long, label int, j int, x double"))
    assert sorted((r["j"], r["x"]) for r in out.collect()) == [(0, 0.0), (0, 1.0), (1, 0.0)]


def test_a_class_of_the_fisher_graph_is_many_tasks(spark):
    wide = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("label"), F.array(F.lit(1.0)).alias("features"))
    out = graphs.affinity(wide, 5, "supervised", "fisher")
    assert {(r["src"], r["dst"], r["w"]) for r in out.collect()} == {(a, b, 1 / 150) for a in range(300) for b in range(300) if a % 2 == b % 2}
    assert out.join(wide.select(F.col("id").alias("src"), "label"), "src").withColumn("piece", F.pmod(F.xxhash64("src"), F.lit(graphs.PIECES))).select("label", "piece").distinct().count() > 50
    assert "piece" in out._jdf.queryExecution().optimizedPlan().toString()
