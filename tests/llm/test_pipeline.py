import corpus_pipeline

from featlab.llm import exact_dedup, queries
from tests.llm.helpers import collapse, docs, words


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    d = docs(spark)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "pii", "packing"]
    now = d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.schema == d.schema
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    norm = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        norm.setdefault(" ".join((t or "").split(" ")) if not (t or "").strip() else " ".join((t or "").split()), i)
    left = [i for i in norm.values() if i is not None]
    text = {i: t for i, t in rows if i is not None}
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(text[i])) else set() for i in left}
    pairs = [(a, b) for a in left for b in left if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    kept = set(collapse(pairs, left).values())
    assert kept <= {r["doc_id"] for r in out} | {None}
    assert {r["doc_id"] for r in out} - {None} <= kept | {2}


def test_every_operator_has_its_query():
    numbers = sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert exact_dedup.FILTER_WORDS == 17
