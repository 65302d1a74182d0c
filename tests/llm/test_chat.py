import hashlib

import pytest

from featlab.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, tree string, node long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(rows):
    out = {}
    key = lambda v: (v is not None, v or 0)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (key(r[1]), r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        lost = "".join(t or "" for _, _, r, t in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())
    return out


def test_digests_equal_brute_force(spark):
    s = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", s), (-7, 1, "assistant", s), (1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "tie \\0 \\\\1 <b> é\U0001f600"), (1, 2, None, "x"), (2, 5, "assistant", "only"), (2, 5, "assistant", "only"), (None, None, "sys[tem", "<s>"), (None, 3, "assistant", "y")]
    rows += [(3, k, ("user", "assistant")[k % 2], f"turn {k}\n" * 3) for k in range(70)] + [(4, 0, "user", "long " * 40_000)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.conversation_digests(frame(spark, rows)).collect()}
    assert got == brute(rows)
    assert chat.conversation_digests(frame(spark, [])).count() == 0


def test_branches_rank_and_format(spark):
    nodes = [("t", 1, None, 1.0, "user", "q"), ("t", 2, 1, 5.0, "assistant", "good"), ("t", 3, 1, 1.0, "assistant", "bad"), ("t", 4, 2, 3.0, "user", "more"), ("t", 5, 3, None, "user", None), ("u", 1, 77, 0.0, "user", "root, its parent is missing")]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double, role string, text string")
    rows = {(r["tree"], r["leaf"]): r for r in chat.format_trees(df).collect()}
    assert set(rows) == {("t", 4), ("t", 5), ("u", 1)}
    best = rows["t", 4]
    assert best["branch_rank"] == 1 and best["n_turns"] == 3 and abs(best["branch_score"] - 3.0) < 1e-9
    assert best["formatted"] == "<s>[INST]user[/INST]q</s><s>[INST]assistant[/INST]good</s><s>[INST]user[/INST]more</s>"
    assert [best["formatted"][s["start"] : s["end"]] for s in best["loss_spans"]] == ["good"]
    assert {(r["tree"], r["leaf"]) for r in chat.format_trees(df, best=1).collect()} == {("t", 4), ("u", 1)}


def test_loop_is_an_error(spark):
    df = spark.createDataFrame([("t", 1, 2, 0.0, "user", "a"), ("t", 2, 1, 0.0, "user", "b")], "tree string, node long, parent long, score double, role string, text string")
    with pytest.raises(ValueError):
        chat.format_trees(df)
