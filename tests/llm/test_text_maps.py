"""Token ids, packing, pieces and personal data: each against a plain version."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from featlab.llm import binary_output, packing, pieces, pii, tokens
from tests.llm.helpers import docs

public = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "It's  the\tday's 3 ½ x", "İstanbul ΑΣ ſ ŉ", "<|endoftext|> a<|startoftext|>b", "é é", "字 \U0001f600 \x1c x\x85y", "w" * 300, "Ab'LL  1234 ,,, --"]


def test_word_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    own = tokens.WordEncoder(public.path("word_bpe_49k.json"))
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(["a", "the", " ", "'s", "É", "ß", "9", "\n", "字", "<|", "._"]) for _ in range(30)) for _ in range(300)]
    for _ in range(2):
        assert own.encode_batch(texts) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_packing_is_whole_and_close(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    d = docs(spark)
    rows = packing.pack_first_fit(d, length=64, with_ids=True).collect()
    want = {}
    for r in d.collect():
        ids = np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(r["doc_id"], []).append(ids)
    of = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        of.setdefault(r["doc_id"], []).append((r["start"], r["ids"], r["doc_tokens"]))
    assert set(of) == set(want)
    for i, pieces_ in of.items():
        assert sum(len(p) // 4 for _, p, _ in pieces_) == sum(map(len, want[i]))
        if len(want[i]) == 1:
            assert b"".join(p for _, p, _ in sorted(pieces_)) == want[i][0].tobytes()
            assert {n for *_, n in pieces_} == {len(want[i][0])}
    bins = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 64 and sum(64 - n for n in bins.values()) < 64  # one group
    assert packing.pack_first_fit(docs(spark, [])).count() == 0


def test_repeated_rows_are_dealt_to_several_groups(spark):
    """A repeated row and a long document don't make a group larger."""
    rows = [(1, "the same row again", "en")] * 5000 + [(2, "word " * 40_000, "en"), (None, "no id", "de"), (None, "no id", "de")]
    d = docs(spark, rows).coalesce(3)
    dealt = packing.tokenised(d, "word", packing.TOKENIZER, 2, "doc_id", "text", 64, 512, False).toPandas()
    sizes = dealt["grp"].value_counts()
    assert len(sizes) == 10 and sizes.max() < 1.4 * len(dealt) / 10
    assert dealt[dealt["crc"].notna()]["ids"].isna().all() and dealt["n"].sum() == dealt.drop_duplicates(["id", "total"])["total"].mul([5000, 1, 2]).sum()
    out = packing.pack_first_fit(d, length=64, group_docs=512)
    assert out.count() >= len(dealt) and out.where("doc_id = 1 AND start = 0").count() == 5000


def test_word_memory_is_bounded_and_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    own, free = (tokens.WordEncoder(public.path("word_bpe_49k.json")) for _ in range(2))
    for k in range(60):
        texts = [f"the word{j} zażółć{j} again" for j in range(k, k + 30)]
        got = own.encode_batch(texts)
        monkeypatch.setattr(tokens, "CACHE_BYTES", 1 << 40)
        assert got == free.encode_batch(texts)
        monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
        for known in (own.words, own.parts):
            assert len(known.new) + len(known.old) < 400


@pytest.mark.parametrize("fit", [packing.first_fit, binary_output.best_fit])
def test_bins_hold_everything_once(fit):
    r = random.Random(7)
    for _ in range(60):
        sizes = [r.choice([1, 3, 7, 16, 17, 40]) for _ in range(r.randrange(30))]
        seen = {}
        for b in fit(sizes, 16):
            assert 0 < sum(n for *_, n in b) <= 16
            for d, a, n in b:
                seen.setdefault(d, []).append((a, n))
        for d, size in enumerate(sizes):
            at = 0
            for a, n in sorted(seen[d]):
                assert a == at
                at += n
            assert at == size


def test_tournament_and_capacities_equal_scans():
    r = random.Random(2)
    sizes = sorted((r.randint(1, 20) for _ in range(80)), reverse=True)
    tree, free = packing.Tournament(80, 20), [20] * 80
    for s in sizes:
        want = next(i for i, f in enumerate(free) if f >= s)
        assert tree.first(s) == want
        tree.take(want, s)
        free[want] -= s
    caps, held = binary_output.Capacities(20), []
    for k in range(200):
        if held and r.random() < 0.5:
            s = r.randint(0, 20)
            got, want = caps.pop(s), min((c for c, _ in held if c >= s), default=None)
            assert (got[1] if got else None) == want
            if got:
                held.remove((got[1], got[0]))
        else:
            c = r.randint(0, 20)
            caps.put(k, c)
            held.append((c, k))


def test_matrices_round_trip(spark, tmp_path):
    d = docs(spark)
    binary_output.write_packed(binary_output.packed_rows(d, length=32), str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m"))
    lib = tokens.RankEncoder(public.path("byte_bpe_50k.tiktoken"))
    for r in rows.collect():
        pos, ends = np.frombuffer(r["positions"], "<u2"), r["cu_seqlens"]
        assert len(r["ids"]) == 64 and len(pos) == 32 and ends[0] == 0
        assert pos.tolist() == [k for a, b in zip(ends, [*ends[1:], 32], strict=True) for k in range(b - a)]
    back = {}
    for r in binary_output.unpacked(rows).orderBy("start").collect():
        back[r["doc_id"]] = back.get(r["doc_id"], b"") + bytes(r["ids"])
    for r in d.dropDuplicates(["doc_id"]).where("doc_id <> 9 AND length(text) > 0").collect():
        assert back[r["doc_id"]] == np.frombuffer(lib.encode_batch([r["text"]])[0], "<u4").astype("<u2").tobytes()
    assert binary_output.packed_rows(docs(spark, [])).count() == 0


def test_pieces_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    own = pieces.Pieces(public.path("piece_bpe_32k.model"))
    r = random.Random(3)
    texts = [*ODD, "  a   b  ", " " * 40 + "x", "\n\n a\tb", "<s>x</s>", "በ ▁ z"] + ["".join(r.choice(["a", "the", " ", "ing", "\n", "é", "字", "    ", "1"]) for _ in range(25)) for _ in range(300)]
    got = own.encode_batch(texts)
    assert got == [np.array(x, "<u4").tobytes() for x in lib.encode(texts)]
    assert [own.decode(b) for b in got] == [t.replace("▁", " ") for t in texts]
    rows = pieces.encode(docs(spark)).collect()
    assert len(rows) == docs(spark).count() and all(r["exact"] == (r["doc_id"] != 2**60 + 1) for r in rows)  # that text holds the mark
    assert pieces.decode(pieces.encode(docs(spark))).count() == len(rows) and pieces.encode(docs(spark, [])).count() == 0


def test_shared_prefix_scores_equal_plain_viterbi():
    own = pieces.Pieces(public.path("piece_bpe_32k.model"), merges=False)
    words = ["▁the", "▁there", "▁then", "▁thenx", "abc", "abd", "字x", "zzzzz"]
    low = min(own.score.values()) - 10
    for word, ids in own.lattice(words):
        best = [0.0] + [None] * len(word)
        for i in range(1, len(word) + 1):
            best[i] = max([best[j] + own.score[word[j:i]] for j in range(i) if word[j:i] in own.score] or [best[i - 1] + low])
        assert sum(own.score[own.text[i]] if i >= 0 else low for i in ids) == pytest.approx(best[-1])
        assert "".join(own.text[i] if i >= 0 else chr(-1 - i) for i in ids) == word


def plain_spans(t):
    out = [(m.start(), m.end(), 0) for m in pii.EMAIL.finditer(t)]
    out += [(m.start(), m.end(), 1) for m in pii.IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in pii.CARD.finditer(t) if 14 <= sum(c.isdigit() for c in m[0]) <= 19 and pii.luhn("".join(c for c in m[0] if c.isdigit()))]
    out += [(m.start(), m.end(), 3) for m in pii.PHONE.finditer(t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns(spark):
    r = random.Random(5)
    for _ in range(20_000):
        t = "".join(r.choice("a1@.+- (9.5%@é)4") for _ in range(r.randint(1, 60)))
        assert pii.base_spans(t) == plain_spans(t), t
    long = "1" * 300_000 + " a@b.co " + "1." * 100_000 + " " + "x" * 300_000 + "@ +1" + "(" * 100_000
    field = pii.Field(np.zeros((pii.FEATURES, 5)), np.zeros((5, 5)), np.zeros((5, 5)))
    began = time.perf_counter()
    assert any(k == 0 for *_, k in pii.base_spans(long)) and len(pii.all_spans([long], field)) == 1
    assert time.perf_counter() - began < 10
    d = docs(spark)
    rows = pii.find(d).collect()
    want = {r["doc_id"]: plain_spans(r["text"] or "") for r in d.collect()}
    assert len(rows) == d.count()
    for r in rows:
        own = pii.joined(want[r["doc_id"]])
        if r["doc_id"] is not None:
            assert r["base_sha256"] == hashlib.sha256(own.encode()).hexdigest()
            assert set(own.split(",")) <= set(r["spans"].split(",")) and r["n_email"] == sum(k == 0 for *_, k in want[r["doc_id"]])
    assert pii.find(docs(spark, [])).count() == 0


def test_skip_edges_carry_labels():
    import numpy as np

    lines = []
    r = random.Random(1)
    for _ in range(300):
        lines.append(f"call +1 (389) 555-{r.randrange(1000, 9999)} or 10.0.{r.randrange(255)}.7 id {r.randrange(10**6)} v{r.randrange(9)} mail u{r.randrange(99)}@h.org again")
    field = pii.fit_field([pii.graph(t, pii.base_spans(t)) for t in lines])
    assert all(field.skip[k, k] >= field.skip[k].max() - 1e-9 for k in range(len(pii.LABELS)))
    u = np.zeros((3, 5))
    u[0, 4] = 50.0
    field.skip = 3 * np.eye(5)
    p = field.beliefs(u, np.zeros((0, 2), int), np.array([[0, 1], [1, 2]]))
    assert p[1].argmax() == 4 and p[2].argmax() == 4 and p[1, 4] > p[2, 4] > 0.5
    alone = field.beliefs(u[1:], np.zeros((0, 2), int), np.zeros((0, 2), int))
    assert np.allclose(alone, 0.2)
    clean = "nothing personal here, version 1.2.3 of 2024"
    assert pii.all_spans([clean], field)[0] == ([], [])
    assert pii.masked("a b@c.de f", [(2, 8, 0)]) == "a [EMAIL] f"


def test_mask_stage(spark):
    d = docs(spark)
    out = {r["doc_id"]: r for r in pii.mask(d).collect()}
    assert pii.mask(d).schema == d.schema and len(out[10]["text"]) == out[10]["n_chars"]
    assert "[EMAIL]" in out[10]["text"] and "[IP]" in out[10]["text"] and "555-5010" not in out[10]["text"]
    assert out[4]["text"] is None and out[5]["text"] == "The same text here"
    assert pii.mask(docs(spark, [])).count() == 0


def test_texts_that_hold_the_mark_are_not_exact(spark):
    d = docs(spark, [(1, "plain words", "en"), (2, "a \u2581 mark", "en"), (3, "\u2581", "en"), (4, None, "en"), (5, " two  spaces ", "en")])
    rows = pieces.encode(d)
    text = {r["doc_id"]: r["text"] for r in pieces.decode(rows).collect()}
    own = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    assert {r["doc_id"]: r["exact"] for r in rows.collect()} == {i: text[i] == t for i, t in own.items()} and text[2] != own[2] and text[1] == own[1]
