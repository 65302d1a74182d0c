import numpy as np

from featlab.operators import graphs, metric_index


def _wide(spark, n=600, p=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, p))
    return x, spark.createDataFrame([(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)], "id long, label int, features array<double>")


def test_what_is_found_is_k_a_row_however_many_blocks_there_are(spark):
    """Nothing but the k best of a row leaves a task, so what is shuffled doesn't grow with the pairs of blocks."""
    x, wide = _wide(spark)
    for within, per in (("any", 4), ("same", 4), ("each", 12)):
        near = metric_index.nearest(wide, None, 4, "euclidean", within, 50).toPandas()
        assert len(near) == 600 * per
    d = np.round(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(2)), 9)
    best = [set(np.lexsort((np.arange(600), r))[:4].tolist()) for r in d]
    near = metric_index.nearest(wide, None, 4, "euclidean", "any", 50).toPandas().groupby("src")["dst"].agg(set)
    assert [near[i] for i in range(600)] == best


def test_edge_sums_join_no_row_of_features_to_an_edge(spark):
    x, wide = _wide(spark)
    edges = spark.createDataFrame([(i, (7 * i + k) % 600, 0.5 + k) for i in range(600) for k in range(3)], "src long, dst long, w double")
    for of in (np.multiply, lambda a, b: np.abs(a - b)):
        got = graphs.edge_sums(wide, edges, of).orderBy("j").toPandas()["s"]
        assert np.allclose(got, sum((0.5 + k) * of(x[i], x[(7 * i + k) % 600]) for i in range(600) for k in range(3)))


def test_rows_are_shipped_narrow_and_found_once(spark):
    """Features that single precision holds take four bytes, others eight; both directions of an edge come from one search."""
    rng = np.random.default_rng(1)
    for x, size in ((rng.random((40, 3)).astype(np.float32).astype(float), 12), (rng.random((40, 3)), 24)):
        assert {len(v) for v in metric_index.narrow(x)} == {size}
        assert (metric_index.wide_again(metric_index.narrow(x), 3) == x).all()
    mixed = [*metric_index.narrow(np.ones((2, 3))), *metric_index.narrow(np.full((1, 3), 0.1))]
    assert (metric_index.wide_again(mixed, 3) == [[1] * 3, [1] * 3, [0.1] * 3]).all()
    _, wide = _wide(spark)
    plan = graphs.affinity(wide, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("run(") == 1


def test_no_copy_of_the_rows_is_shuffled_for_a_share(spark):
    """A task a share, and nothing between what is kept in order and the search."""
    _, wide = _wide(spark, 1100)
    for against in (None, wide.where("id % 2 = 0")):
        near = metric_index.nearest(wide, against, 3, "euclidean", "any", 50)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan
        assert near.rdd.getNumPartitions() == 3
        assert near.count() == 3300
