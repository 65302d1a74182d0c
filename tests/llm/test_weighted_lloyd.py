"""Weighted Lloyd against the rounds over all rows in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from featlab.llm import weighted_lloyd as wl

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, digest string, q int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "d", 2, 3) for i, v in rows], SCHEMA)


def plain(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    c = [q for _, q in first]

    def assign():
        out = []
        for _, q in kept:
            d = [sum((a - b) ** 2 for a, b in zip(q, m, strict=True)) for m in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            own = [q for (_, q), (a, _) in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign() if c else []
    per = {j: sum(d for a, d in at if a == j) for j in range(len(c))}
    most = 2**63 - 1
    return sorted(((i, a, min(d, most), min(per[a], most), min(sum(per.values()), most), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), (a, d) in zip(kept, at, strict=True)), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_whole_number_rounds(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(i, (r.normal(size=4) * 0.01).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(200)]  # copies of three vectors
    rows += [(5, rows[5][1])] * 3 + [(5, [0.5, 0.5, 0.5, 0.5]), (None, [0.1, 0.2, 0.3, 0.4]), (None, None), (7, None), (8, []), (9, [1.0, 2.0, 3.0]), (10, [1.0, None, 0.0, 0.0]), (11, [float("nan"), 0.0, 0.0, 0.0]), (12, [float("inf"), 0.0, 0.0, 0.0]), (13, [0.0, -0.0, 0.0, 0.0])]
    got = wl.clusters(frame(spark, rows), k=12, rounds=5, dim=4).collect()
    assert sorted((tuple(x) for x in got), key=str) == plain(rows, 12, 5, 4)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [0.0, 0.0]) for i in range(6)] + [(9, [1.0, 1.0])]
    seen = []
    got = wl.clusters(frame(spark, rows), k=7, rounds=2, dim=2, seen=seen.append).collect()
    assert sorted((tuple(x) for x in got), key=str) == plain(rows, 7, 2, 2)
    assert len({x["cluster"] for x in got}) == 2 and len(seen) == 2 and sum(c == [0, 0] for c in seen[-1]) == 6


def test_very_large_components_stay_exact(spark):
    rows = [(i, [float(i), 1e300, -1e300, 1e17]) for i in range(3)] + [(4, [-5.0, 3.0, 2.0, 1.0]), (5, [1e306, 0.0, 0.0, 0.0]), (6, [2.0**22, 1.0, 0.0, 0.0]), (7, [1e5, -1e5, 1e5, 3e5])]
    got = wl.clusters(frame(spark, rows), k=4, rounds=3, dim=4).collect()
    assert sorted((tuple(x) for x in got), key=str) == plain(rows, 4, 3, 4)


def test_digits_add_up():
    for v in (0, 1, -1, 2**31, -(2**31), 2**32, -(2**63), 10**40, -(10**40)):
        assert sum(d << 32 * k for k, d in enumerate(wl.digits(v))) == v


def test_nothing_kept(spark):
    assert wl.clusters(frame(spark, []), dim=4).collect() == []
    assert wl.clusters(frame(spark, [(1, None), (None, [1.0] * 4)]), dim=4).collect() == []


def test_the_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from featlab.llm import queries

    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=64) * 0.1).tolist()) for i in range(150)] + [(200 + i, [0.01] * 64) for i in range(30)]
    import pandas as pd

    embeddings = pd.DataFrame({"vec_id": [i for i, _ in rows], "embedding": [v for _, v in rows]})  # noqa: F841
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    want = con.sql(queries.lloyd_sql()).fetchall()
    assert sorted(tuple(x) for x in wl.clusters(frame(spark, rows)).collect()) == sorted(want)
