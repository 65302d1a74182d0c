"""The filter audit against applying the filters in order, one document at a time."""

from itertools import permutations

import pytest

from featlab.llm import filter_audit as fa
from tests.llm.helpers import docs

LABELS = "doc_id long, quality int, toxic int, n int, mask int, part string"


def labels(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p") for r in rows], LABELS)


def fails(rows):
    out = []
    for i, text, lang in rows:
        t = text or ""
        w = [x for x in t.encode().split() if x]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        out.append((i, lang or "", {k for k, v in f.items() if v}))
    return out


def plain(rows, known):
    found, out = fails(rows), {}
    good, toxic = {i for i, q, _ in known if q == 1 and i is not None}, {i for i, _, t in known if t == 1 and i is not None}
    shapley = {}
    for part in {p for _, p, _ in found}:
        own = [(i, f) for i, p, f in found if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                lost, kept = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                gone = sum(x in f for _, f in own) - len(lost)
                out[part, order, k + 1] = [len(kept), len(lost), gone, sum(f == {x} for _, f in own), sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)]
                shapley[part, x] = shapley.get((part, x), 0) + len(lost)
                left = kept
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(spark, rows, known):
    frame = fa.audit(docs(spark, rows).repartition(3), labels(spark, known))
    cells = frame.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in cells}
    assert len(out) == len(cells)
    return out


LONG = " ".join(f"w{k}" for k in range(250))
ROWS = (
    [(k, LONG, "en") for k in range(20)]
    + [(3, LONG, "en"), (0, LONG, "de"), (None, LONG, "en"), (None, None, None), (50, None, None), (51, "", "en"), (52, "  ", "de"), (53, "a " * 300, "fr"), (54, "A# b", "en"), (55, LONG.upper(), "en"), (56, LONG + " |", "en")]
    + [(57, "x\x1cy\x85z " * 260, "en"), (2**60 + 1, "É" * 40 + "A", "fr"), (2**60 + 2, "É" * 40 + "A", "fr"), (60, "AAA" + "b" * 97, "en"), (61, "AAAA" + "b" * 96, "en"), (62, "w " * 100 + LONG[:0] + " ".join(f"u{k}" for k in range(99)), "en")]
)
KNOWN = [(k, k % 2, (k + 1) % 2) for k in range(30)] + [(51, 1, 1), (51, 0, None), (53, 1, 1), (None, 1, 1), (55, 1, None), (2**60 + 2, 1, 1)]


def test_equals_the_filters_in_order(spark):
    assert got(spark, ROWS, KNOWN) == plain(ROWS, KNOWN)


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_a_text_over_many_ranges(spark, parts):
    """A hot text, a hot repeated row and rows without ids are cut by the ranges; the first id alone passes."""
    rows = [(k, "the hot text", "en") for k in range(100, 400)] + [(7, "the hot row", "de")] * 200 + [(None, "the hot row", "de")] * 50 + [(9, "the hot row", "fr")] * 50 + [(k, f"text {k % 90}", "es") for k in range(180)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = fa.decided(fa.masks(docs(spark, rows).repartition(5))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = sorted((i, p, "E" in f) for i, p, f in fails(rows) if i is not None)
    assert sorted((r["id"], r["part"], r["mask"] >= 16) for r in frame if r["id"] is not None) == want
    assert sum(r["id"] is None for r in frame) == 50 and not any(r["mask"] >= 16 for r in frame if r["id"] is None)


def test_no_documents_and_no_labels(spark):
    assert got(spark, [], []) == {}
    assert got(spark, ROWS[:3], []) == plain(ROWS[:3], [])


def test_the_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    from featlab.llm import queries

    con = duckdb.connect()
    own = [r for r in ROWS if r[0] is not None]
    con.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in own], "Int64"), "text": [r[1] for r in own], "lang": [r[2] for r in own]}))
    con.register("labels", pd.DataFrame({c: pd.array([r[k] for r in KNOWN], "Int64") for k, c in enumerate(("doc_id", "quality", "toxic"))}))
    want = {tuple(r[:3]): tuple(r[3:]) for r in con.sql(queries.OP13_SQL).fetchall()}
    assert want == plain([r for r in ROWS if r[0] is not None], KNOWN)
