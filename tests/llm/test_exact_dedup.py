import hashlib
import re

import pytest

from featlab.llm import exact_dedup
from tests.llm.helpers import docs


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=str)


@pytest.mark.parametrize("digest_bytes", [32, 0, 1])
def test_groups_equal_brute_force(spark, digest_bytes):
    d = docs(spark)
    got = exact_dedup.exact_groups(d, digest_bytes=digest_bytes).collect()
    want = brute([(r["doc_id"], r["text"]) for r in d.collect()])
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=str) == sorted((w[:4] for w in want), key=str)
    if digest_bytes == 32:
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in got), key=str) == want


def test_drop_keeps_one_row_a_text_and_all_columns(spark):
    d = docs(spark)
    out = exact_dedup.drop_copies(d)
    assert out.columns == d.columns
    texts = [norm(r["text"]) for r in out.collect()]
    assert sorted(texts) == sorted({norm(r["text"]) for r in d.collect()})
    assert {r["doc_id"] for r in out.collect() if norm(r["text"]) == "The same text here"} == {3}


def test_empty(spark):
    d = docs(spark, [])
    assert exact_dedup.exact_groups(d).count() == 0 and exact_dedup.drop_copies(d).count() == 0


def test_index_merges_runs(spark):
    index = exact_dedup.DigestIndex(spark)
    for lo in (0, 5):
        index.flush(spark.range(lo, lo + 8).selectExpr("id", "unhex(sha2(string(id % 6), 256)) AS digest"))
    assert sorted((r["least_id"], r["n"]) for r in index.compacted().collect()) == sorted((min(x for x in [*range(8), *range(5, 13)] if x % 6 == k), sum(x % 6 == k for x in [*range(8), *range(5, 13)])) for k in range(6))


def _scanned(df):
    """Rows that the scan of a plan gave out; whole row groups that statistics or filters rule out are not read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    leaf = leaves.head()
    if leaf.nodeName().startswith(("AdaptiveSparkPlan", "ResultQueryStage")):
        leaf = leaf.executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_runs_are_merged_by_level_and_lookups_skip_files(spark):
    index = exact_dedup.DigestIndex(spark, fan_in=2)
    for k in range(5):
        index.flush(spark.range(k * 3000, k * 3000 + 4000).selectExpr("id", "unhex(sha2(string(id), 256)) AS digest"))
    assert [len(x) for x in index.levels] == [5]
    rows = index.compacted()
    assert sum(map(len, index.levels)) == 1 and len(index.levels) == 4  # 5, 3, 2, 1 runs
    assert rows.count() == 16_000 and rows.agg({"n": "sum"}).first()[0] == 20_000
    some = [hashlib.sha256(str(i).encode()).digest() for i in (3, 3500, 15_999)]
    found = index.lookup(some)
    assert sorted((r["least_id"], r["n"]) for r in found.collect()) == [(3, 1), (3500, 2), (15_999, 1)]
    files = len(rows.inputFiles())
    assert files > 3 and 0 < _scanned(index.lookup(some[:1])) < 1.5 * 16_000 / files  # one file has rows
    assert _scanned(index.lookup([hashlib.sha256(b"no row").digest()])) == 0  # the Bloom filter rules out the one that may


def test_filter_grows_with_the_hits(spark):
    assert [exact_dedup.filter_words(n) for n in (0, 10**5, 10**6, 4 * 10**6, 10**9)] == [17, 17, 18, 20, 21]
    hits = spark.range(2000).selectExpr("unhex(sha2(string(id), 256)) AS digest")
    assert exact_dedup.hit_filter(hits, 4).count() == 16
