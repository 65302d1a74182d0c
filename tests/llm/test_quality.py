"""The quality classifier against a plain form."""

import random

import numpy as np
import pytest

from featlab.llm import quality
from tests.llm.helpers import docs


def plain_grams(text, order=quality.ORDER):
    words = (text or "").encode().split()
    data = b" ".join([b"\xff" + w if k and w == words[k - 1] else w for k, w in enumerate(words)] + [b"\n"])
    data = b"\n" * (order - 1) + data
    return [data[i : i + order] for i in range(len(data) - order + 1)]


def plain_model(texts, order=quality.ORDER):
    """log2 of the probability of a gram's last byte, by dictionaries."""
    top = [g for t in texts for g in plain_grams(t)]
    orders = {order: {g: top.count(g) for g in top}}
    for n in range(order - 1, 0, -1):
        below = [g[1:] for g in orders[n + 1]]
        orders[n] = {g: below.count(g) for g in below}

    def d(n):
        n1, n2, n3, n4 = (sum(v == k for v in orders[n].values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        out = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
        return [min(max(v, 0.05), k + 0.95) for k, v in enumerate(out)]

    off = {n: d(n) for n in orders}

    def prob(g):
        if not g:
            return 1 / 256
        n, lower = len(g), prob(g[1:])
        own = {k: v for k, v in orders[n].items() if k[:-1] == g[:-1]}
        if not own:
            return lower
        total, held = sum(own.values()), sum(off[n][min(v, 3) - 1] for v in own.values())
        part = (own[g] - off[n][min(own[g], 3) - 1]) / total if g in own else 0
        return part + held / total * lower

    return lambda g: np.log2(prob(g))


TEXTS = ["the cat sat. the the cat", "A cat sat on 12 mats", "the end", "einé größe und und die katze", ""]


@pytest.mark.parametrize("block_bytes", [20, 10**6])
def test_perplexity_equals_plain_counts(spark, block_bytes):
    model = quality.train(spark.createDataFrame([(t,) for t in TEXTS], "text string"), block_bytes=block_bytes)
    log2 = plain_model(TEXTS)
    rows = [(k, t, "en") for k, t in enumerate([*TEXTS, "the mat sat on a dog", "Привет 字 \U0001f600", None, "same same same\tsame"])]
    got = {r["id"]: r for r in quality.scored(docs(spark, rows), model, block_bytes=block_bytes).collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        grams = plain_grams(t)
        assert got[k]["n"] == len(grams) and got[k]["bits"] == pytest.approx(-sum(map(log2, grams)), rel=1e-5)


def test_probabilities_sum_to_one(spark):
    model = quality.train(spark.createDataFrame([(t,) for t in TEXTS], "text string"), shards=1)
    own = quality.Orders(*quality.unpacked(model.counts.first()["data"], "i"))
    for context in (b"the ", b" cat", b"zzzz", b"\n\n\n\n"):
        asked = np.array([sum(x << (8 * k) for k, x in enumerate(reversed(context + bytes([b])))) for b in range(256)])
        assert (2 ** own.log2(np.sort(asked), model.discounts, model.low)).sum() == pytest.approx(1)


@pytest.mark.parametrize("lost", [0.001, 0.05, 0.2])
def test_thresholds_and_decisions_equal_plain_quantiles(spark, lost):
    r = random.Random(7)
    word = lambda: "".join(r.choice(["an", "the", "re", "ing"]) for _ in range(r.randint(1, 3)))
    rows = [(k, " ".join(word() for _ in range(r.randint(3, 40))), ["en", "de", "fr", None][min(3, k % 5)]) for k in range(240)]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(k, int(k < 160), 0) for k in range(0, 240)], "doc_id long, quality int, toxic int")
    trainers, others = (sorted(x["id"] for x in t.collect()) for t in quality.trusted_ids(labels, 60))
    assert len(trainers) == 60 and sorted(trainers + others) == list(range(160))
    text = {k: t for k, t, _ in rows}
    log2 = plain_model([text[k] for k in trainers])
    score = {k: (-sum(map(log2, g := plain_grams(t))), len(g), lang) for k, t, lang in rows}

    def at(values, q):  # the least value with that share of values up to it
        return sorted(values)[max(0, int(np.ceil(q * len(values))) - 1)]

    def value(bits, n, lang):
        return (bits + quality.PRIOR * median[lang]) / (n + quality.PRIOR)

    of = lambda lang: [score[k] for k in others if score[k][2] == lang]
    median = {None: at([score[k][0] / score[k][1] for k in others], 0.5)}
    median |= {lang: at([b / n for b, n, _ in of(lang)], 0.5) if len(of(lang)) >= quality.MEDIAN_ROWS else median[None] for lang in ("en", "de", "fr")}
    beyond = at([value(*score[k]) - median[score[k][2]] for k in others], 1 - lost)
    high = {lang: at([value(*x) for x in of(lang)], 1 - lost) if lang and len(of(lang)) >= 1 / lost else median[lang] + beyond for lang in median}
    got = {x["doc_id"]: x for x in quality.quality(d, labels, 60, lost).collect()}
    for k, (bits, n, lang) in score.items():
        assert got[k]["log2_perplexity"] == pytest.approx(value(bits, n, lang), rel=1e-5)
        assert got[k]["threshold"] == pytest.approx(high[lang], rel=1e-5) and got[k]["pooled"] == (lang is None or len(of(lang)) < 1 / lost)
        if abs(value(bits, n, lang) - high[lang]) > 1e-5:
            assert got[k]["kept"] == (value(bits, n, lang) <= high[lang])


def test_repeated_words_are_marked():
    assert quality.stream("Ab ab ab cd") == b"Ab ab \xffab cd \n"
    assert quality.stream("x x\tx\nx") == b"x \xffx \xffx \xffx \n" and quality.stream(None) == quality.stream(" ") == b"\n"


def test_quality_keeps_clean_and_rejects_junk(spark):
    r = random.Random(2)
    syl = ["an", "the", "re", "ing", "to", "er", "on"]
    clean = lambda: " ".join("".join(r.choice(syl) for _ in range(r.randint(1, 3))) for _ in range(60)) + "."
    rows = [(i, clean(), "en") for i in range(300)] + [(1000 + i, clean().upper().replace(" ", "!! "), "en") for i in range(20)] + [(2000, None, None), (2001, "", "xx"), (None, clean(), "en"), (2002, "ok", "en")]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(1000, 0, 0), (None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.quality(d, labels).collect()}
    assert not any(got[1000 + i] for i in range(20)) and sum(got[i] for i in range(300)) >= 297 and got[2000] and got[2001]
    out = quality.drop_low_quality(d, labels)
    assert out.schema == d.schema and out.count() == sum(quality_row["kept"] for quality_row in quality.quality(d, labels).collect())
    assert quality.drop_low_quality(d, labels.where("false")).count() == len(rows)
    assert quality.quality(docs(spark, []), labels).count() == 0
