import numpy as np

from featlab.operators import learn, selectors, solvers
from featlab.queries import QUERIES


def test_backward_equals_its_dense_form(spark):
    r = np.random.default_rng(3)
    x, y = r.random((150, 5)), r.integers(0, 3, 150)
    x[:, 1] += y
    wide = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(150)], "id long, label int, features array<double>")
    with solvers.training(wide) as rows:
        for cols, w in zip([[0, 1, 2, 3, 4], [1, 3]], solvers.sparse_support_vectors(rows, [[0, 1, 2, 3, 4], [1, 3]]), strict=True):
            assert np.allclose(w, learn.LinearSVM(0.1, "l1", 30, 0.05).fit(x[:, cols], y, 3).w, atol=1e-9)
    out = solvers.svm_wrapper(wide, 3, False, 0.1, solvers.sparse_support_vectors).orderBy("rank").collect()
    want, score = selectors.svm_backward(selectors.Fold(x, y, 3, 3))
    assert [q["j"] for q in out] == want and np.allclose([q["score"] for q in out], score)


def test_the_query_gathers_no_group(spark, tmp_path):
    r = np.random.default_rng(0)
    spark.createDataFrame([(i, i % 2, r.random(61).tolist()) for i in range(40)], "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = QUERIES["fs_svm_backward"](spark, str(tmp_path))
    assert out.count() == 60 and "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
