import itertools
import random
import re

import numpy as np

from featlab.llm import pii

WORDS = "stone river paper light garden window music winter summer letter".split()


def enumerated(field, unary, chain, skip):
    """Marginals by the sum over all labellings."""
    n, k = unary.shape
    out = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        w = np.exp(sum(unary[i, a] for i, a in enumerate(y)) + sum(field.chain[y[a], y[b]] for a, b in chain) + sum(field.skip[y[a], y[b]] for a, b in skip))
        for i, a in enumerate(y):
            out[i, a] += w
    return out / out.sum(1, keepdims=True)


def test_beliefs_equal_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 5):
        field = pii.Field(np.zeros((pii.FEATURES, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
        unary = rng.normal(size=(n, 5))
        tree = [(int(rng.integers(i)), i) for i in range(1, n)]
        chain, skip = tree[::2], tree[1::2]
        p = field.beliefs(unary, np.array(chain, int).reshape(-1, 2), np.array(skip, int).reshape(-1, 2))
        assert np.abs(p - enumerated(field, unary, chain, skip)).max() < 1e-3
    # with a loop the beliefs are an approximation: close where potentials are weak
    field = pii.Field(np.zeros((pii.FEATURES, 5)), 0.2 * rng.normal(size=(5, 5)), 0.2 * rng.normal(size=(5, 5)))
    unary = rng.normal(size=(4, 5))
    chain, skip = [(0, 1), (1, 2), (2, 3)], [(0, 3)]
    assert np.abs(field.beliefs(unary, np.array(chain), np.array(skip)) - enumerated(field, unary, chain, skip)).max() < 0.01


def checked(body):
    return next(body + c for c in "0123456789" if pii.luhn(re.sub("[^0-9]", "", body + c)))


def documents(n, seed):
    draw = random.Random(seed)

    def number(k):
        return "".join(draw.choices("0123456789", k=k))

    def value():
        return [f"{draw.choice(WORDS)}.{number(2)}@{draw.choice(WORDS)}.org", ".".join(str(draw.randrange(256)) for _ in range(4)), checked(number(15)), f"+1 ({number(3)}) {number(3)}-{number(4)}"][draw.randrange(4)]

    def prose():
        no_card = next(x for x in iter(lambda: number(16), None) if not pii.luhn(x))
        middle = draw.choices([*WORDS, number(3), no_card, f"{number(1)}.{number(2)}.{number(1)}"], k=12)
        return " ".join([draw.choice(WORDS), *middle, draw.choice(WORDS)])

    return [f"{prose()} {value()} {prose()} {value()} {prose()}" for _ in range(n)]


def test_hidden_mentions_are_found_and_decoys_left_alone():
    field = pii.fit_field([pii.rehearsed(t) for t in documents(300, 1)])
    draw, texts, want = random.Random(5), [], []
    for t in documents(300, 2):
        spans, more, own = pii.base_spans(t), t, []
        for a, b, k in spans:
            hidden = pii._disguised(k, t[a:b], draw)
            if pii.base_spans(hidden):
                continue
            own.append((len(more) + 7, len(more) + 7 + len(hidden), k))
            decoy = "someone@else" if k == 0 else re.sub("[0-9]", lambda _: str(draw.randrange(10)), hidden)
            more += f" again {hidden} then" + (f" or {decoy} here" if not pii.base_spans(decoy) else "")
        if pii.base_spans(more) == spans:
            texts.append(more)
            want.append(own)
    found = wrong = 0
    for (_, more), own in zip(pii.all_spans(texts, field), want, strict=True):
        hits = [any(x == k and a < e and b > s for a, b, x in more) for s, e, k in own]
        found += sum(hits)
        wrong += sum(not any(a < e and b > s for s, e, _ in own) for a, b, _ in more)
    total = sum(map(len, want))
    assert total > 400 and found >= 0.98 * total and wrong <= 0.01 * total, (found, wrong, total)


def test_an_example_of_second_mentions():
    field = pii.fit_field([pii.rehearsed(t) for t in documents(300, 1)])
    text = "call +1 (389) 555-1234 now. later 389 555-1234 and 13895551234 again, xxx-xxx-1234 but not 389 555-1235 or 555-9999"
    base, more = pii.all_spans([text], field)[0]
    assert [text[a:b] for a, b, _ in base] == ["+1 (389) 555-1234"]
    assert [text[a:b] for a, b, _ in more] == ["389 555-1234", "13895551234", "xxx-xxx-1234"] and {k for *_, k in more} == {3}


def test_long_tokens_and_many_spans_are_read_whole():
    field = pii.fit_field([pii.rehearsed(t) for t in documents(300, 1)])
    text = "a@b.org " * 9 + "y" * 300 + "@b.org-x " + "x" * 100_000 + "1234 " + "(" * 50_000 + " 1 2 3" * 30_000
    base, more = pii.all_spans([text], field)[0]
    assert len(base) == 10 and all(b <= len(text) for _, b, _ in more)


def test_the_sample_is_bounded_and_repeats_count_once(spark):
    rows = [(1, "a@b.org or a@b today")] * 500 + [(i, t) for i, t in enumerate(documents(40, 3))] + [(None, None), (7, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = pii.fit(d, most=20), pii.fit(d.repartition(5), most=20)
    assert np.allclose(one.node, two.node) and np.allclose(one.skip, two.skip)
    assert np.allclose(pii.fit(d.limit(0)).skip, 3 * np.eye(5))
