import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from featlab.llm import context_tree as C
from tests.llm.helpers import docs, words


def contexts(data, depth):
    """The context of each byte, last byte first; end bytes are before the start."""
    for i, b in enumerate(data):
        yield tuple((list(reversed(data[:i])) + [10] * depth)[:depth]), b


def plain(rows, depth):
    """Recursive context-tree weighting over dictionaries."""
    counts = defaultdict(lambda: [0, 0])
    texts = {i: [w.encode() for w in words(t)] + [C.END] for i, t in rows}

    def steps(i):
        yield from contexts(b" ".join(texts[i]), depth)

    def bits(b):
        for k in range(8):
            yield (1 << k) | (b >> (8 - k)), b >> (7 - k) & 1

    for i in texts:
        if not C.held_out(i):
            for ctx, b in steps(i):
                for node, bit in bits(b):
                    for d in range(depth + 1):
                        counts[ctx[:d], node][bit] += 1
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)
    children = defaultdict(set)
    for ctx, node in counts:
        if ctx:
            children[ctx[:-1], node].add(ctx)
    memo = {}

    def weighted(ctx, node):
        if (ctx, node) not in memo:
            own = kt(*counts.get((ctx, node), (0, 0)))
            memo[ctx, node] = own if len(ctx) == depth else math.log(0.5) + np.logaddexp(own, sum(weighted(c, node) for c in children.get((ctx, node), ())))
        return memo[ctx, node]

    def prob(ctx, node, bit, d):
        n = counts.get((ctx[:d], node), (0, 0))
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return own
        stop = math.exp(math.log(0.5) + kt(*n) - weighted(ctx[:d], node))
        return stop * own + (1 - stop) * prob(ctx, node, bit, d + 1)

    return {i: sum(math.log10(prob(ctx, node, bit, 0)) for ctx, b in steps(i) for node, bit in bits(b)) for i in texts}


def test_scores_equal_plain_recursion(spark):
    rows = [(i, t, "en") for i, t in enumerate(["the cat sat on the mat", "a cat, a hat", "the THE The bat", "", None, "mat", "é ü the cat", "cats sat on mats a b c", "on the mat the cat sat", "zzz yyy", "the cat"])]
    want = plain([r[:2] for r in rows], C.DEPTH)
    got = {r["doc_id"]: r for r in C.score(docs(spark, rows), block_chars=60).collect()}
    assert len(got) == len(rows)
    for i, s in want.items():
        assert got[i]["score"] == pytest.approx(s, rel=1e-6)  # probabilities travel in single precision
        assert got[i]["bits_per_byte"] == pytest.approx(-s / math.log10(2) / got[i]["n_bytes"], rel=1e-6)
    train = Counter(w for i, t, _ in rows if not C.held_out(i) for w in [*words(t), "\n"])
    n, v = sum(train.values()), len(train)
    for i, t, _ in rows:
        tokens = [*words(t), "\n"]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 5 == 1, len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), abs=1e-9)


def test_probabilities_of_a_byte_sum_to_one():
    r = np.random.default_rng(0)
    context = r.integers(97, 100, (300, C.DEPTH))
    gram = sum(context[:, k] << (8 * (k + 1)) for k in range(C.DEPTH)) | r.integers(97, 123, 300)
    gram, c = np.unique(gram, return_counts=True)
    one = (gram[0] >> 8 << 8) | np.arange(256)
    every, at = np.unique(np.concatenate((gram, one)), return_inverse=True)
    counts = np.bincount(at[: len(gram)], c, len(every))
    node, z, o, w = (np.concatenate(x) for x in zip(*[[t.levels[-1][j] for j in (0, 1, 2, 4)] for t in (C.Subtree(every, counts, k, C.DEPTH, 2) for k in range(8))], strict=True))
    crown = C.Crown({1: [(((node >> 8) & 255) << 8) | (node & 255), z, o, w]}, C.DEPTH)
    p = 10 ** crown.mixed(every, counts, C.DEPTH, C.Shards(3))
    assert p[np.searchsorted(every, one)].sum() == pytest.approx(1)


def test_merging_takes_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "MERGE", 2)
    rows = [(i, f"word{i % 7} other words {i}", "en") for i in range(40)]
    many = {r["doc_id"]: r["score"] for r in C.score(docs(spark, rows), block_chars=30).collect()}
    monkeypatch.setattr(C, "TASK_BYTES", 100)  # a shard's questions are answered in several tasks
    few = {r["doc_id"]: r["score"] for r in C.score(docs(spark, rows), block_chars=30, shard_chars=10).collect()}
    one = {r["doc_id"]: r["score"] for r in C.score(docs(spark, rows)).collect()}
    assert many == pytest.approx(one, rel=1e-6) and few == pytest.approx(one, rel=1e-6)


def all_grams(block):
    """The gram of each predicted byte, in order."""
    at, g = (np.concatenate(x) for x in zip(*[block.grams(r, 0, block.size) for r in range(len(block.ranges))], strict=True))
    return g[np.argsort(at)]


def test_contexts_reach_across_words():
    text = "one two"
    data = b"\n" * 6 + b"one two \n"
    want = [sum(data[at - k] << (8 * k) for k in range(7)) for at in range(6, len(data))]
    for size in (1, 3, None):
        own = C.Block([C.stream(text), C.stream("x")], 6, C.Shards(5), size)
        got = all_grams(own)
        assert got.tolist()[: len(want)] == want and len(got) == own.sizes.sum()


@pytest.mark.parametrize(("size", "slice_"), [(None, None), (40, 17), (1, 5)])
def test_counts_and_sums_go_range_by_range(monkeypatch, size, slice_):
    r = np.random.default_rng(3)
    streams = [C.stream(" ".join(r.choice(["a", "bc", "def"], n))) for n in [30] * 10 + [0, 1, 200] + [5] * 10]
    train = r.random(len(streams)) < 0.5
    if slice_:
        monkeypatch.setattr(C, "SLICE", slice_)
        monkeypatch.setattr(C, "RANGE", 11)
    deal = C.Shards(7, [[0x6320, 0x2061]])
    own = C.Block(streams, 3, deal, size)
    assert own.ranges[0][0] == 0 and own.ranges[-1][1] == 7 and all(a[1] == b[0] for a, b in zip(own.ranges, own.ranges[1:], strict=False)) and (size is None or len(own.ranges) > 1)
    of, edge = all_grams(own), np.cumsum([0, *own.sizes])
    want, sums = Counter(), np.zeros(len(streams))
    for a, b, marked in zip(edge, edge[1:], train, strict=False):
        want.update(of[a:b].tolist() if marked else [])
    got = {}
    for k, shards in enumerate(own.ranges):
        gram, c = own.counted(k, own.marked(train))
        assert (np.diff(gram) > 0).all() and ((deal.of(gram) >= shards[0]) & (deal.of(gram) < shards[1])).all()
        assert (own.counted(k)[0] == gram).all()
        got |= dict(zip(gram.tolist(), c.tolist(), strict=True))
        if len(gram):
            own.add_sums(sums, k, gram, gram / 7.0)
    assert got == {g: want[g] for g in set(of.tolist())}
    assert sums == pytest.approx([of[a:b].sum() / 7.0 for a, b in zip(edge, edge[1:], strict=False)])


def test_hot_contexts_are_cut_into_shards_that_stay_small():
    """A corpus of one two-byte context: its grams go to shards by the bytes before."""
    r = np.random.default_rng(5)
    streams = [b"".join(bytes([x]) + b"ab" for x in r.integers(97, 123, 400).tolist()) + b" \n" for _ in range(30)]
    whole = C.Block(streams, 6)
    heavy = whole.heavy(1 / 100)
    assert [d for d, *_ in heavy] == [2, 3, 4, 5] and {0x6162} <= set(heavy[0][1].tolist())
    g = np.concatenate([whole._gram(i, i + 1) for i in range(whole.size)])
    for d, c, n in heavy:
        at, want = np.unique((g >> 8) & ((1 << 8 * d) - 1), return_counts=True)
        assert dict(zip(c.tolist(), n.tolist(), strict=True)) == {a: k for a, k in zip(at.tolist(), want.tolist(), strict=True) if k > whole.size / 100}
    deal, plain_ = C.Shards(64, [c for _, c, _ in heavy]), C.Shards(64)
    most = lambda s: np.bincount(s.of(g)).max()
    assert most(deal) < 0.1 * len(g) < 0.3 * len(g) < most(plain_)
    for top, some in deal.by_top(g):  # a shard's grams share `top` bytes with all of their subtree
        owner = {}
        for c, k in zip((g[some] >> 8 & (1 << 8 * top) - 1).tolist(), deal.of(g[some]).tolist(), strict=True):
            assert owner.setdefault(c, k) == k
    assert sum(len(some) for _, some in deal.by_top(g)) == len(g)


@pytest.mark.parametrize("hot", [2, 6, 512])
def test_scores_do_not_depend_on_what_is_hot(spark, monkeypatch, hot):
    monkeypatch.setattr(C, "HOT", hot)
    rows = [(i, "ababababab abab xab yab " * 3 + t, "en") for i, t in enumerate(["the cat", "", "abab", "zab ab", "hat", "babab", "b", "xyab"])]
    got = {r["doc_id"]: r["score"] for r in C.score(docs(spark, rows), block_chars=150).collect()}
    assert got == pytest.approx(plain([r[:2] for r in rows], C.DEPTH), rel=1e-6)
    total, held = C.hot_contexts(C.texts(docs(spark, rows), "doc_id", "text", C.DEPTH, 150).where("kind > 0"))
    data = [C.END * C.DEPTH + C.stream(t) for _, t, _ in rows]
    assert total == sum(map(len, data))
    for d in range(2, C.DEPTH):
        n = Counter(x[i - d : i] for x in data for i in range(d, len(x)))
        must = {int.from_bytes(c, "big") for c, k in n.items() if k > total / hot}
        assert must <= set(held[d - 2] if d - 2 < len(held) else []) and all(len(h) <= 2 * hot for h in held)


def test_places_find_every_number():
    r = np.random.default_rng(2)
    for n in (1, 2, 50, 100_000):
        numbers = np.unique(r.integers(0, 1 << 56, n))
        asked = r.permutation(np.repeat(np.arange(len(numbers)), 3))
        assert (C.Places(numbers).of(numbers[asked]) == asked).all()


def test_odd_rows(spark):
    rows = C.score(docs(spark)).collect()
    assert len(rows) == docs(spark).count() and all(r["score"] < 0 for r in rows)
    assert C.score(docs(spark, [])).count() == 0


def test_a_block_is_opened_without_more_copies_of_its_text():
    import pickle
    import tracemalloc

    import zstandard

    one = b"some words of a text " * 5000 + C.END
    n = 40
    data, more = zstandard.ZstdCompressor(level=3).compress(one * n), pickle.dumps((list(range(n)), np.full(n, len(one)), [len(one)] * n))
    tracemalloc.start()
    block, _, _ = C.opened(data, more, C.DEPTH, C.Shards(16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert block.streams == [one] * n
    # its streams, their bytes in a row and a shard of two bytes each; slices are bounded, and so are the tables of 65,536 contexts and shards
    assert peak < 4 * n * len(one) + 180 * C.SLICE
