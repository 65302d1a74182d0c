"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The nodes of the field are the base spans and, outside them, the tokens
that hold a digit or an @, runs of numbers that together repeat a base span's, and tokens with their
start blotted out (xxxx 1234) or with (at) for an @. A node has potentials from its shape and from the
words beside it; neighbouring nodes share potentials (linear chain), and so do nodes with the same or
similar text, however far apart (skip edges: each occurrence with the hub of its group, a node without
a text of its own, so a token that occurs k times has k edges at most and any two of its mentions are
two steps apart; a base span on one of them gives the hub its label). Similar: the same digits, the
same last ten digits of a phone, a phone's last seven, the last four after a blot, an IP address with
other separators, an email's name and host. Loopy sum-product messages spread the base spans' labels to
the other mentions in the document until they no longer change. A node whose label is certain enough and
that no base span touches becomes a further span.

The weights come from maximum pseudo-likelihood on a bounded sample of documents. What the patterns miss
has no label of its own to learn from, so base spans are hidden: each is written once more at the end of
its document in a form that no pattern finds, beside decoys of the same form with other digits. The
first has the base span's label, the decoys none, so only the skip potentials tell them apart. Tokens of
the document itself that are similar to a base span, but none, are left out of the sums.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.llm.common import lean

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Documents at most that the weights are learned from: those with the least hash of their id among those with a digit or an @.
SAMPLE_ROWS = 2_000
DAMPING, CERTAIN = 0.3, 0.9
#: Messages are passed until none changes by more than TOLERANCE; every STEADY rounds the steps halve, so that those that swing settle.
TOLERANCE, STEADY = 1e-4, 100

# Scans below take time in proportion to the text, also where a run of digits or letters is very long.
_TOKEN, _REST = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"\x20\([0-9]+\)\x20[0-9][0-9-]*")
_HOLDS, _NUMBERS = re.compile("[0-9@]"), re.compile(r"[0-9.]+")
_MASKED = re.compile(r"(?<![*xX#\u2022])(?:[*xX#\u2022]{2,}+[-.\x20]?+){1,4}+([0-9]{4})(?![0-9])")
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++)\x20?[\[(]at[\])]\x20?([A-Za-z0-9-]++)(?:\.[A-Za-z0-9-]+)*")
_FOUR = re.compile(r"(?<![0-9])([0-9]{1,3})[-_.]([0-9]{1,3})[-_.]([0-9]{1,3})[-_.]([0-9]{1,3})(?![0-9])")
_NUMERIC = re.compile(r"[+(]?[0-9][0-9().-]*")
#: Tokens at most that are read together as one number.
TOGETHER = 5
_EDGE = " \t\n\r\x0b\f.,;:!?*#$%&|\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _number(s: str) -> int:
    s = s.lstrip("0")
    return int(s or "0") if len(s) < 10 else 1 << 40  # a run of any length is no number to convert


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's position in KINDS), sorted."""
    out = []
    if "@" in text:
        out += [(m.start(), m.end(), 0) for m in _emails(text)]
    if _DIGIT.search(text):
        out += [(a, b, 1) for a, b, parts in _dotted(text) if all(_number(x) <= 255 for x in parts)]
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start():
                digits = re.sub(r"[^0-9]", "", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


_DIGIT = re.compile(r"[0-9]")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


class _Span:
    def __init__(self, a: int, b: int):
        self.a, self.b = a, b

    def start(self) -> int:
        return self.a

    def end(self) -> int:
        return self.b


def _emails(text: str) -> Iterator[_Span]:
    """What EMAIL.finditer finds, from each @ outwards, so that long words without one cost nothing."""
    at, free = text.find("@"), 0
    while at >= 0:
        host = _HOST.match(text, at)
        end = at + 1
        if host:
            a = at
            while a > free and text[a - 1] in _LOCAL_SET:
                a -= 1
            if a < at:
                yield _Span(a, host.end())
                free = end = host.end()
        at = text.find("@", end)


def _dotted(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """What IP.finditer finds, with the parts: four digit groups in turn in a run of digits and dots."""
    for run in _NUMBERS.finditer(text):
        groups = run[0].split(".")
        if len(groups) < 4:
            continue
        starts, at = [], run.start()
        for g in groups:
            starts.append(at)
            at += len(g) + 1
        k = 0
        while k + 4 <= len(groups):
            four = groups[k : k + 4]
            if all(four):
                yield starts[k], starts[k + 3] + len(four[3]), four
                k += 4
            else:
                k += 1


@dataclass
class Graph:
    """Nodes of one document: spans, features, group keys; base: the label that a base span gives, 0 if none touches the node.
    y: what the weights are learned from, -1 if unknown; tail: nodes from here on are not of the document's own text."""

    spans: list[tuple[int, int]]
    feats: np.ndarray
    base: list[int]
    keys: list[tuple[str, ...]]
    y: list[int] | None = None
    tail: int | None = None


FEATURES = 28


def _features(token: str, before: str) -> np.ndarray:
    """Shape of the token, what speaks against it, and the word before it."""
    number = re.sub("[^0-9]", "", token)
    digits = len(number)
    letters = sum(c.isalpha() for c in token)
    x = np.zeros(FEATURES, np.float32)
    x[0] = 1
    x[1 + min(4, digits // 4)] = 1
    x[6] = letters > 0
    x[7] = "@" in token
    x[8 + min(3, token.count("."))] = 1
    x[12] = token.startswith("+")
    x[13] = "-" in token
    x[14] = "(" in token
    x[15] = digits == len(token)
    x[16] = letters > digits
    x[17] = bool(re.search(r"[^A-Za-z0-9.@+()\x20-]", token))
    x[18] = digits > 19
    x[19] = 14 <= digits <= 19
    x[20] = 10 <= digits <= 15 and not x[15]
    x[21] = len(token) > 40
    x[22] = before.endswith((":", "="))
    x[23] = digits < 4
    x[24] = _MASKED.match(token) is not None
    x[25] = "(at)" in token or "[at]" in token
    x[26] = 14 <= digits <= 19 and not luhn(number)
    x[27] = bool(x[11]) and any(_number(part) > 255 for part in re.findall("[0-9]+", token))
    return x


def _keys(token: str, label: int) -> tuple[str, ...]:
    """What a node shares with similar ones. label: of the base span, 0 if there is none."""
    digits = re.sub(r"[^0-9]", "", token)
    out = ["t:" + hashlib.md5(token.lower().encode("utf-8", "surrogatepass")).hexdigest()]
    last = digits[-10:] if len(digits) <= 13 else digits
    kind = KINDS[label - 1] if label else None
    if kind == "email" or not kind and "@" in token:
        name, _, host = token.lower().partition("@")
        if name.strip(_EDGE) and host:
            out.append(f"e:{name.strip(_EDGE)}@{host.split('.')[0]}")
    elif not kind and (m := _AT.match(token)):
        out.append(f"e:{m[1].lower().strip(_EDGE)}@{m[2].lower()}")
    elif not kind and (m := _MASKED.match(token)):
        out.append("m:" + m[1])
    elif kind != "card" and kind != "phone" and (m := _FOUR.search(token)):
        out.append("i:" + ".".join(m.groups()))
    elif kind == "phone":
        out += ["d:" + last, "s:" + digits[-7:], "m:" + digits[-4:]]
    elif kind == "card":
        out += ["d:" + last, "m:" + digits[-4:]]
    elif len(digits) == 7:
        out.append("s:" + digits)
    elif len(digits) > 7:
        out.append("d:" + last)
    return tuple(out)


def _candidates(text: str, lo: int, hi: int, labels: set[int], numbers: set[str]) -> list[tuple[int, int]]:
    """Tokens of text[lo:hi], which no base span touches. labels: of the document's base spans; numbers: their digit keys."""
    out = []
    if labels & {3, 4}:
        out += [m.span() for m in _MASKED.finditer(text, lo, hi)]
    if 1 in labels:
        out += [m.span() for m in _AT.finditer(text, lo, hi)]
    out.sort()
    special, k, done = out[:], 0, lo
    tokens = list(_TOKEN.finditer(text, lo, hi))
    for i, m in enumerate(tokens):
        while k < len(special) and special[k][1] <= m.start():
            k += 1
        if m.start() < done or not _HOLDS.search(m[0]) or k < len(special) and special[k][0] < m.end():
            continue
        more = _REST.match(text, m.end(), hi)  # a number that goes on after a space
        done = more.end() if more else m.end()
        if numbers and _NUMERIC.match(m[0].strip(_EDGE.replace("(", ""))):
            digits, end = "", m.start() - 1
            for n in tokens[i : i + TOGETHER]:  # numbers that are a base span's together
                own = n[0].strip(_EDGE)
                if n.start() != end + 1 or not _NUMERIC.fullmatch(own):
                    break
                digits, end = digits + re.sub("[^0-9]", "", own), n.end()
                if "d:" + (digits[-10:] if len(digits) <= 13 else digits) in numbers or "s:" + digits in numbers:
                    done = max(done, end)
                    break
                if n[0][-1] in ".,;:!?":
                    break
        raw = text[m.start() : done]
        a = m.start() + len(raw) - len(raw.lstrip(_EDGE))
        b = done - len(raw) + len(raw.rstrip(_EDGE))
        if a < b:
            out.append((a - (raw[0] == "(" and ")" in text[a:b]), b))
    return sorted(out)


def graph(text: str, spans: list[tuple[int, int, int]]) -> Graph:
    """spans: the base spans, sorted. Of overlapping ones the first gives the label."""
    held: list[list[int]] = []
    for a, b, k in spans:
        if held and a < held[-1][1]:
            held[-1][1] = max(held[-1][1], b)
        else:
            held.append([a, b, k + 1])
    labels, keyed = {k for *_, k in held}, {a: _keys(text[a:b], k) for a, b, k in held}
    numbers = {x for keys in keyed.values() for x in keys if x[0] in "ds"}
    nodes, base, done = [], [], 0
    for a, b, k in [*held, [len(text), len(text), 0]]:
        own = _candidates(text, done, a, labels, numbers)
        nodes += own
        base += [0] * len(own)
        if k:
            nodes.append((a, b))
            base.append(k)
        done = b
    feats = [_features(text[a:b], text[max(0, a - 12) : a].strip()) for a, b in nodes]
    keys = [keyed[a] if k else _keys(text[a:b], 0) for (a, b), k in zip(nodes, base, strict=True)]
    return Graph(nodes, np.array(feats, np.float32).reshape(-1, FEATURES), base, keys)


#: Decoys for each hidden span.
DECOYS = 3


def _disguised(kind: int, value: str, draw: random.Random) -> str | None:
    """The value in a form that the patterns don't find."""
    digits = re.sub("[^0-9]", "", value)
    if kind == 0:
        name, _, host = value.partition("@")
        return draw.choice([f"{name}@{host.split('.')[0]}", f"{name} (at) {host}", f"{name}[at]{host}"])
    if kind == 1:
        return value.replace(".", draw.choice("-_"))
    if kind == 2:
        fours = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return draw.choice([".".join(fours), "/".join(fours), "**** **** **** " + digits[-4:], "xxxx-xxxx-xxxx-" + digits[-4:]])
    last = digits[-10:]
    return draw.choice([f"{last[:3]}-{last[3:6]}-{last[6:]}", f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]} {last[3:6]} {last[6:]}", digits, last, f"{last[3:6]}-{last[6:]}", f"xxx-xxx-{last[6:]}"])


def rehearsed(text: str) -> Graph:
    """The graph of a text with its base spans hidden once more behind it, each among DECOYS decoys."""
    spans = base_spans(text)
    draw = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    lines = []
    for a, b, k in spans:
        value = _disguised(k, text[a:b], draw)
        if value and not base_spans(value):
            lines.append((value, k + 1))
            for _ in range(DECOYS):
                other = re.sub("[0-9]", lambda _: str(draw.randrange(10)), value)
                if k == 2 and sum(c.isdigit() for c in other) > 7:
                    other = next(x for x in (other[:-1] + c for c in "0123456789") if luhn(re.sub("[^0-9]", "", x)))
                if k == 0:
                    other = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=7)) + value[text[a:b].index("@") :]
                if other != value and not base_spans(other):
                    lines.append((other, 0))
    draw.shuffle(lines)
    starts, at = [], len(text) + 1
    for value, _ in lines:
        starts.append(at)
        at += len(value) + 1
    g = graph("\n".join([text, *(v for v, _ in lines)]), spans)
    tail = next((i for i, (a, _) in enumerate(g.spans) if a > len(text)), len(g.spans))
    of_base = {k for keys, label in zip(g.keys, g.base, strict=True) if label for k in keys}
    y = [label or (-1 if of_base.intersection(keys) else 0) for label, keys in zip(g.base[:tail], g.keys[:tail], strict=True)]
    y += [lines[bisect_right(starts, a) - 1][1] for a, _ in g.spans[tail:]]
    return Graph(g.spans, g.feats, g.base, g.keys, y, tail)


def hubs(g: Graph) -> tuple[int, list[tuple[int, int]]]:
    """The number of groups of nodes that share keys, directly or by way of others, and (node, group) of all nodes that are not alone."""
    group: dict[str, str] = {}

    def root(k: str) -> str:
        while group.setdefault(k, k) != k:
            group[k] = k = group[group[k]]
        return k

    for keys in g.keys:
        for k in keys[1:]:
            group[root(k)] = root(keys[0])
    members: dict[str, list[int]] = {}
    for i, keys in enumerate(g.keys):
        members.setdefault(root(keys[0]), []).append(i)
    shared = [m for m in members.values() if len(m) > 1]
    return len(shared), [(i, h) for h, m in enumerate(shared) for i in m]


@dataclass
class Field:
    node: np.ndarray  #: FEATURES x labels
    chain: np.ndarray  #: labels x labels
    skip: np.ndarray  #: labels of the hub x labels of the node

    def beliefs(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
        """Marginals of all nodes by damped loopy sum-product messages; edges: (n, 2) of node positions.

        doc: the number of each node's document; each document's messages end by themselves, so none
        depends on the others.
        """
        ends = np.concatenate((chain, skip)).astype(np.int64)
        if not len(ends):
            return _softmax(unary)
        pot = np.concatenate((np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)))
        src, dst = np.concatenate((ends[:, 0], ends[:, 1])), np.concatenate((ends[:, 1], ends[:, 0]))
        pot = np.exp(np.concatenate((pot, pot.transpose(0, 2, 1))))
        back = np.concatenate((np.arange(len(ends)) + len(ends), np.arange(len(ends))))
        own = np.zeros(len(src), np.int64) if doc is None else doc[src]
        msg = np.zeros((len(src), unary.shape[1]))
        going, weight, rounds = np.arange(len(src)), 1 - DAMPING, 0
        total = unary.copy()
        while len(going):
            total[dst[going]] = unary[dst[going]]
            np.add.at(total, dst[going], msg[going])
            out = total[src[going]] - msg[back[going]]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.einsum("ea,eab->eb", out, pot[going]))
            new -= new.max(1, keepdims=True)
            step = weight * (new - msg[going])
            msg[going] += step
            far = np.abs(step).max(1) > TOLERANCE
            open_ = np.zeros(own.max() + 1, bool)
            open_[own[going[far]]] = True
            going = going[open_[own[going]]]
            rounds += 1
            if rounds % STEADY == 0:
                weight /= 2
        total = unary.copy()
        np.add.at(total, dst, msg)
        return _softmax(total)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_field(graphs: list[Graph], steps: int = 600, rate: float = 0.5, penalty: float = 1e-4) -> Field:
    """Maximum pseudo-likelihood by gradient steps with momentum. A node's neighbours are those of the chain and its group's hub,
    which has the label of the base spans on the other nodes of the group, none if there is none."""
    n = len(LABELS)
    feats, y, chain, skip, at = [], [], [], [], 0
    for g in graphs:
        own = g.base if g.y is None else g.y
        tail = len(own) if g.tail is None else g.tail
        feats.append(g.feats)
        y += own
        chain += [(a + at, a + at + 1) for a in range(tail - 1) if own[a] >= 0 and own[a + 1] >= 0]
        count: dict[int, np.ndarray] = {}
        joins = hubs(g)[1]
        for i, h in joins:
            count.setdefault(h, np.zeros(n, int))[g.base[i]] += 1
        for i, h in joins:
            c = count[h].copy()
            c[g.base[i]] -= 1
            c[0] = 0
            if own[i] >= 0 and (c.any() or not g.base[i]):
                skip.append((i + at, int(c.argmax())))
        at += len(own)
    field = Field(np.zeros((FEATURES, n)), np.zeros((n, n)), np.zeros((n, n)))
    if not at:
        field.skip += 3 * np.eye(n)
        return field
    x, y = np.concatenate(feats).astype(np.float64), np.array(y)
    known = (y >= 0).astype(float)[:, None]
    hot = np.eye(n)[np.maximum(y, 0)]
    chain, skip = np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)
    prev, nxt = (hot[chain[:, 0]], hot[chain[:, 1]])
    hub = np.eye(n)[skip[:, 1]]
    speed = [np.zeros_like(w) for w in (field.node, field.chain, field.skip)]
    for _ in range(steps):
        score = x @ field.node
        np.add.at(score, chain[:, 1], prev @ field.chain)
        np.add.at(score, chain[:, 0], nxt @ field.chain.T)
        np.add.at(score, skip[:, 0], hub @ field.skip)
        off = known * (hot - _softmax(score))
        steps_ = (x.T @ off / at, (prev.T @ off[chain[:, 1]] + off[chain[:, 0]].T @ nxt) / at, hub.T @ off[skip[:, 0]] / max(1, len(skip)))
        for w, v, step in zip((field.node, field.chain, field.skip), speed, steps_, strict=True):
            v *= 0.9
            v += rate * (step - penalty * w)
            w += v
    # the fit leaves each row free by a constant; with an equal diagonal a hub that no base span labels favours no label
    field.skip -= (np.diag(field.skip) - field.skip[0, 0])[:, None]
    return field


#: The log potential that holds a node to the label of the base span that touches it.
HELD = 50.0


def all_spans(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and the further ones; all texts' graphs go through one set of messages."""
    found, graphs, unary, chain, skip, doc, at = [base_spans(t) for t in texts], [], [], [], [], [], 0
    for d, (t, spans) in enumerate(zip(texts, found, strict=True)):
        g = None
        if _HOLDS.search(t):  # else there is no node
            g = graph(t, spans)
            u = g.feats @ field.node
            for i, k in enumerate(g.base):
                if k:
                    u[i, k] += HELD
            n, joins = hubs(g)
            own = np.zeros((n, u.shape[1]))
            for i, h in joins:
                if g.base[i]:  # a base span's label holds for the group, however many other mentions it has
                    own[h, g.base[i]] += HELD * len(g.spans)
                else:
                    skip.append((h + at + len(g.spans), i + at))
            unary += [u, own]
            chain += [(a + at, a + at + 1) for a in range(len(g.spans) - 1)]
            at += len(g.spans) + n
            doc += [d] * (len(g.spans) + n)
        graphs.append(g)
    out = []
    pairs = [np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip)]
    p = field.beliefs(np.concatenate(unary), *pairs, np.array(doc, np.int64)) if at else None
    at = 0
    for spans, g in zip(found, graphs, strict=True):
        more = []
        if g is not None:
            own = p[at : at + len(g.spans)]
            at += len(g.spans) + hubs(g)[0]
            for (a, b), k, q in zip(g.spans, g.base, own, strict=True):
                best = int(q.argmax())
                if not k and best and q[best] >= CERTAIN:
                    more.append((a, b, best - 1))
        out.append((spans, more))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span becomes its kind in brackets; of overlapping ones the first takes all."""
    out, at = [], 0
    for a, b, k in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_ROWS) -> Field:
    """Learn the weights from the whole texts of at most `most` documents; only their nodes come to the driver.

    The documents are chosen by a hash of id and text, `most` numbers a task at most; their texts are read after that.
    """

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"h": rows["h"], "graph": [pickle.dumps(rehearsed(t)) for t in rows["text"]]})

    text = F.col(text_col).cast("string")
    rows = docs.select(F.xxhash64(F.col(id_col), text).alias("h"), text.alias("text")).where(F.col("text").rlike("[0-9@]"))
    least = rows.select("h").distinct().orderBy(F.xxhash64("h"), "h").limit(most)
    sample = rows.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"])  # `most` numbers at most
    got = sample.select("h", "text").mapInPandas(lean(nodes), "h long, graph binary").collect()
    return fit_field([pickle.loads(r["graph"]) for r in sorted(got, key=lambda r: r["h"])])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row for each row of docs.

    n_*: base spans of a kind; base_sha256: of "kind:start:end" of the base spans by start, then kind,
    comma-joined; spans: base and further ones likewise; n_added: further ones. Starts and ends are in
    code points. Null texts count as empty.
    """
    field = field or fit(docs, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = all_spans([t or "" for t in rows["text"]], field)
            yield pd.DataFrame(
                {"id": rows["id"]}
                | {f"n_{kind}": np.array([sum(s[2] == k for s in base) for base, _ in got], np.int64) for k, kind in enumerate(KINDS)}
                | {"base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got], "spans": [joined(base + more) for base, more in got], "n_added": np.array([len(more) for _, more in got], np.int64)}
            )

    schema = "id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(lean(run), schema).withColumn("id", F.col("id").try_cast("long")).withColumnRenamed("id", id_col)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """docs with each span replaced by its kind, and n_chars, if there, counted anew; a map over the rows."""
    field = field or fit(docs, id_col, text_col)
    schema = docs.schema
    names = schema.names

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            old = batch.column(text_col).to_pylist()
            new = [t and masked(t, base + more) for t, (base, more) in zip(old, all_spans([t or "" for t in old], field), strict=True)]
            columns = {n: batch.column(n) for n in names} | {text_col: pa.array(new, batch.schema.field(text_col).type)}
            if "n_chars" in columns and "n_chars" != text_col:
                counts = [c if t == u else len(u) for c, t, u in zip(batch.column("n_chars").to_pylist(), old, new, strict=True)]
                columns["n_chars"] = pa.array(counts, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(lean(run), schema)
