import random

import pytest
import xxhash

from featlab.llm import simhash
from tests.llm.helpers import collapse, docs, words


def plain(text):
    w = words(text)
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("text", [None, "", "one", "One two", "A b C d", "a b c " * 50, "É b\x0bc d e", "x y z q"])
def test_fingerprint_equals_definition(text):
    assert simhash.fingerprint(text) == plain(text)


def test_masks_cover_every_pair_of_positions():
    masks = simhash.masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_components_equal_brute_force(spark):
    r = random.Random(4)
    fps = {r.getrandbits(64) for _ in range(40)}
    for _ in range(6):  # chains of steps of two bits, and one dense ball that fills a bucket
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            x ^= (1 << r.randrange(64)) ^ (1 << r.randrange(64))
    x = r.getrandbits(64)
    fps |= {x ^ (1 << i) ^ (1 << j) for i in range(0, 64, 7) for j in range(0, 64, 7)}  # positions with one vector: all in one bucket
    fps |= {x ^ (1 << i) for i in range(0, 64, 7)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = {tuple(q) for q in simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    brute = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    assert collapse(links, signed) == collapse(brute, signed)
    assert len(links) < len(brute)


def test_rows_and_stage(spark):
    d = docs(spark)
    rows = simhash.near_components(d).collect()
    assert len(rows) == d.count()
    of = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert of[3] == of[5] == of[9] == 3 and of[4] == of[2] == 2 and of[7] == of[8] == 7
    assert all(len(r["fingerprint"]) == 16 for r in rows)
    out = simhash.drop_near_copies(d)
    assert out.columns == d.columns
    assert [r["doc_id"] for r in out.collect()].count(9) == 0
    assert out.where("doc_id = 3").count() == 1
    assert simhash.drop_near_copies(docs(spark, [(1, "a", "x"), (1, "a", "x")])).count() == 1
    assert simhash.near_components(docs(spark, [])).count() == 0
