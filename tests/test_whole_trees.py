"""Trees of full depth grown level by level against those grown node by node."""

import time

import numpy as np
import pytest

from featlab.operators import learn


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_trees_grown_by_levels_equal_those_grown_by_nodes(seed):
    r = np.random.default_rng(seed)
    x, y, w = np.round(r.normal(size=(300, 1)), 1 + seed), r.integers(0, 3, 300), r.integers(1, 4, 300).astype(float)
    a = learn.grow(x, learn.one_hot(y, 3), w, np.random.default_rng(1))
    b = learn.grow_whole(x, y, w, 3, np.random.default_rng(1))
    z = r.normal(size=(2000, 1))
    assert len(a.feature) == len(b.feature)
    assert np.allclose(a.predict(z), b.predict(z))


def test_a_tree_of_full_depth_tells_its_rows_apart_and_is_grown_in_little_time():
    r = np.random.default_rng(5)
    x, y = r.normal(size=(4000, 5)), r.integers(0, 10, 4000)
    began = time.process_time()
    model = learn.Forest(3, None, False).fit(x, y, 10)
    whole = time.process_time() - began
    began = time.process_time()
    learn.grow(x, learn.one_hot(y, 10), np.ones(4000), np.random.default_rng(0), None, 2)
    assert whole < 3 * (time.process_time() - began)
    assert (model.predict_proba(x).argmax(1) == y).mean() > 0.7
    tree = learn.grow_whole(x, y, np.ones(4000), 10, np.random.default_rng(0), 2)
    assert (tree.predict(x).argmax(1) == y).all()


def test_a_chain_of_more_than_64_levels_is_walked_to_its_end():
    n = 100
    tree = learn.Tree([0] * n + [-1] * (n + 1), [float(i) for i in range(n)] + [0.0] * (n + 1), list(range(n, 2 * n)), [*range(1, n), 2 * n], [np.array([0.0])] * n + [np.array([float(i)]) for i in range(n + 1)])
    assert tree.predict(np.array([[1000.0]]))[0, 0] == n
