import numpy as np

from featlab.llm import rotation_codes
from tests.llm.helpers import collapse

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, unit int"


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rotation_codes.near_vectors(df, **options).collect()}
    ok = [(i, np.array(v, np.float32).astype(float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    pairs = [(a, b) for n, (a, u, x) in enumerate(ok) for b, v, y in ok[n + 1 :] if x == y and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93]
    ids = [r[0] for r in rows]
    least = collapse(pairs, ids)
    n = {i: sum(i in p for p in pairs) for i in ids}
    assert got == {i: (n[i], least[i], least[i] == i) for i in ids}


def test_equals_brute_force_with_odd_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(32).tolist(), i % 3) for i in range(120)]
    for c in range(4):  # balls of near copies, one of them over a tile
        base = r.standard_normal(32)
        rows += [(1000 + 100 * c + k, (base + 0.18 * r.standard_normal(32)).tolist(), c % 2) for k in range(30)]
    rows += [(2000 + k, rows[0][1], 0) for k in range(9)]
    rows += [(3000, None, 1), (3001, [0.0] * 32, 1), (3002, [float("nan")] * 32, 1), (3003, [None] * 32, 1), (3004, [float("inf")] + [0.0] * 31, 1), (3005, rows[0][1], None), (3006, [], 1), (3007, [1.0, 2.0], 1), (3008, [2.0, 4.0], 1), (3009, (np.array(rows[0][1]) * 1e-30).tolist(), 0)]
    check(spark, rows, tile=8, tables=64, bits=10)


def test_empty_and_estimate(spark):
    assert rotation_codes.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    r = np.random.default_rng(1)
    rot = rotation_codes.rotation(64, 0)
    assert np.allclose(rot @ rot.T, np.eye(64))
    o, q = (v / np.linalg.norm(v) for v in r.standard_normal((2, 64)))
    est = []
    for k in range(400):
        p = rotation_codes.rotation(64, k, 99)
        x = np.sign(p @ o) / 8
        est.append(x @ (p @ q) / (x @ (p @ o)))
    assert abs(np.mean(est) - o @ q) < 0.02


def test_rows_without_an_id_and_repeated_rows(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal(32)
    near = lambda: (base + 0.1 * r.standard_normal(32)).tolist()
    same = near()
    rows = [(1, same, 0), (1, same, 0), (2, near(), 0), (None, near(), 0), (None, r.standard_normal(32).tolist(), 0), (3, r.standard_normal(32).tolist(), 0)]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA)
    got = sorted(((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in rotation_codes.near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (None, 0, None, False), (3, 0, 3, True)], key=str)
    text = spark.createDataFrame([("a", same, 0), ("7", same, 0)], "vec_id string, embedding array<float>, label int")
    assert sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in rotation_codes.near_vectors(text).collect()), key=str) == [(7, 1, 7), (None, 1, 7)]


def test_bits_grow_with_the_vectors_and_tables_keep_the_recall():
    assert rotation_codes.tables_for(1000) == (rotation_codes.TABLES, 16) == (48, 16)
    before = (0, 0)
    for n in (10**7, 10**8, 10**9, 10**12):
        tables, bits = rotation_codes.tables_for(n)
        assert (tables, bits) > before and (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables <= rotation_codes.MISS
        before = tables, bits
    assert rotation_codes.tables_for(10**12)[1] <= 32
    # as far as single precision loses nothing, vectors travel in it
    v = np.array([0.1, 2.0])
    assert len(rotation_codes._packed(v)) == 16 and len(rotation_codes._packed(v.astype(np.float32).astype(float))) == 8
