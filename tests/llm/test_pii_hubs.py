import numpy as np

from featlab.llm import pii


def field():
    f = pii.Field(np.zeros((pii.FEATURES, 5)), np.zeros((5, 5)), 4 * np.eye(5))
    f.node[0, 0] = 0.5
    return f


def test_labels_reach_every_mention():
    text = "+1 (389) 555-0199 once, then " + "a word and 389-555-0199 again " * 60
    base, more = pii.all_spans([text], field())[0]
    assert len(base) == 1 and len(more) == 60
    assert {text[a:b] for a, b, _ in more} == {"389-555-0199"} and {k for *_, k in more} == {3}
    beside = "+1 (389) 555-0177 and 10.0.0.1 " + "389-555-0177 10.0.0.1 " * 7
    alone = pii.all_spans([text], field()) + pii.all_spans([beside], field())
    assert pii.all_spans([text, beside], field()) == alone  # documents of a batch do not touch each other


def test_hubs_are_linear_and_messages_end_where_they_settle():
    g = pii.graph("389-555-0199 +1 389-555-0199 7 (389-555-0199) 8 8 x9", [])
    n, joins = pii.hubs(g)
    assert n == 2 and len(joins) == 5
    f = field()
    f.chain = np.eye(5)
    u = np.zeros((200, 5))
    u[0, 2] = 50.0
    chain = np.array([(i, i + 1) for i in range(199)])
    p = f.beliefs(u, chain, np.zeros((0, 2), int))
    exact, m = [np.eye(5)[2]], np.exp(f.chain) / np.exp(f.chain).sum(0)
    for _ in range(199):
        exact.append(exact[-1] @ m)
    assert np.abs(p - np.array(exact)).max() < 1e-3


def test_documents_without_a_base_span_get_inference():
    f = field()
    f.node[13, 4] = 6.0  # a hyphen in the token
    line = "reach me at 389-555-0199 today"
    assert pii.base_spans(line) == []
    want = [(12, 24, 3)]
    assert pii.all_spans([line], f)[0] == ([], want)
    assert pii.all_spans([line + " or a@b.org"], f)[0][1] == want
