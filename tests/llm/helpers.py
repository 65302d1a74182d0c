"""Documents with every odd case, and plain versions of what the operators do."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, _id long, fp int, digest string, key int, calibrates boolean"
LONG = "lorem ipsum dolor sit amet " * 6000


def docs(spark, rows=None):
    """Null ids, texts and languages, empty and very long texts, repeated rows, ties, columns with names that the operators use."""
    if rows is None:
        rows = [
            (5, "The same text here", "en"),
            (3, "The  same\ttext\nhere", "en"),
            (9, "The same text here", "en"),
            (9, "The same text here", "en"),
            (4, None, None),
            (2, "", "en"),
            (None, "  ", "de"),
            (None, "no id but a text", "de"),
            (7, LONG, "en"),
            (8, LONG + "x", "en"),
            (10, "mail me: a.b@example.com or +1 (389) 555-5010 or 10.0.0.1 and 4111 1111 1111 1111", "en"),
            (11, "mail me: a.b@example.com or +1 (389) 555-5010 or 10.0.0.1 and 4111 1111 1111 1111!", None),
            (2**60 + 1, "ünïcödé \U0001f600 字 \u0001 ▁ <|endoftext|> </s>[INST]", "fr"),
            (12, "w" * 5000, "en"),
        ]
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "x", 1, 2, "d", 3, True) for i, t, lang in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def collapse(pairs, nodes):
    """Least node reachable of each node."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
