import random

import corpus_pipeline

from featlab.llm import near_copies, simhash
from tests.llm.helpers import collapse, docs, words


def plain(text, n=5):
    w = words(text)
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(a, b):
    a, b = plain(a), plain(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def test_shingles_equal_definition():
    for t in (None, "", "one", "One two", "A b C d e F", "a b c " * 50, "É b\x0bc d e f g"):
        assert len(near_copies.shingles(t)) == len(plain(t))
    assert near_copies.shingles("A b C d e").tolist() == near_copies.shingles("a b c\td E").tolist()


def test_stage_drops_what_is_four_fifths_alike(spark, tmp_path):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(12):  # words changed here and there: 0 to 9 of 200, so near the limit on both sides
        text = [r.choice(vocabulary) for _ in range(200)]
        rows.append(" ".join(text))
        for changed in range(1, 10):
            t = list(text)
            for at in r.sample(range(len(t)), changed):
                t[at] = f"new{base}.{changed}.{at}"
            rows.append(" ".join(t))
    common = [r.choice(vocabulary) for _ in range(100)]
    for k in range(60):  # one large group: a changed word each, so most pairs of them are under the limit
        t = list(common)
        t[5 + k] = f"one{k}"
        t[95 - k] = f"two{k}"
        rows.append(" ".join(t))
    d = docs(spark, [(k, t, "en") for k, t in enumerate(rows)])
    pairs = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if similar(rows[a], rows[b])]
    far = [(a, b) for a, b in pairs if bin(simhash.fingerprint(rows[a]) ^ simhash.fingerprint(rows[b])).count("1") > 2]
    assert len(far) > len(pairs) / 2  # what the fingerprints of op3 leave
    want = collapse(pairs, range(len(rows)))
    got = {x["doc_id"]: x["component_id"] for x in near_copies.near_components(d).collect()}
    assert got == want
    kept = corpus_pipeline.near(spark, d, str(tmp_path))
    assert kept.columns == d.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(want.values()))


def test_odd_rows(spark):
    d = docs(spark)
    of = {r["doc_id"]: r["component_id"] for r in near_copies.near_components(d).collect() if r["doc_id"] is not None}
    assert of[3] == of[5] == of[9] == 3 and of[4] == of[2] == 2 and of[7] == of[8] == 7 and of[10] == of[11] == 10 and of[12] == 12
    assert near_copies.near_components(docs(spark, [])).count() == 0
    assert near_copies.drop_near_copies(docs(spark, [(1, "a", "x"), (1, "a", "x")])).count() == 1


def test_fingerprints_alone_find_what_they_reach(spark):
    """SimHash gives candidates of its own: with no min-hash bucket at all, sets whose fingerprints are near are still linked, after the exact check."""
    assert corpus_pipeline.STAGES[2][0] == "simhash near-dedup"
    base = [f"w{i}" for i in range(4000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(f"v{i}" for i in range(400))), (4, "")]
    a, b = (near_copies.fingerprint(near_copies.shingles(t)) for _, t in rows[:2])
    assert bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = near_copies._signatures(frame, "doc_id", "text", 5).where("n > 0")
    pairs = near_copies._by_fingerprint(nodes)
    checked = near_copies._checked(pairs, near_copies._sets(frame, "text", 5, nodes.select("t")), near_copies.SIMILARITY)
    ids = {r["s"]: r["id"] for r in nodes.collect()}
    assert [{ids[r["a"]], ids[r["b"]]} for r in checked.collect()] == [{1, 2}]
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_components(frame).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
