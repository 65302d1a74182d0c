"""Rows of trees are packed once, evenly over the cores."""

import numpy as np

from featlab.operators import forests


def test_trees_read_rows_packed_once_on_all_cores(spark):
    r = np.random.default_rng(3)
    x, y = np.round(r.normal(size=(400, 4)), 3), r.integers(0, 3, 400)
    wide = spark.createDataFrame([(i, int(y[i]) + 4, x[i].tolist()) for i in range(400)], "id long, label int, features array<double>").coalesce(1)
    with forests.binned(wide) as data:
        assert data.blocks.getNumPartitions() >= spark.sparkContext.defaultParallelism
        blocks = data.blocks.collect()
    assert sum(len(ids) > 0 for ids, _, _ in blocks) >= spark.sparkContext.defaultParallelism  # no task has all rows
    assert len(blocks) < 40
    ids, got, b = (np.concatenate(v) for v in zip(*blocks, strict=True))
    order = ids.argsort()
    assert ids[order].tolist() == list(range(400)) and got[order].tolist() == y.tolist()
    assert (b[order] == forests.in_bins(x, data.edges)).all()
