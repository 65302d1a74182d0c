"""Token ids by public tokenizer files; one encoder a Python worker."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Bytes, by estimate, that a worker's memory of words or of parts of words may take; words longer than CACHE_LENGTH aren't kept.
CACHE_BYTES, CACHE_LENGTH = 56_000_000, 48
#: What an entry takes besides its own characters and ids.
_ENTRY = 190
#: Bytes of text that are encoded together.
BATCH_BYTES = 1_000_000
_made: dict[tuple, object] = {}

# Texts of these characters need no normalising but lower case, which is the same for each character alone.
_PLAIN = re.compile("[\x09-\x0d\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u0148\u014a-\u017e]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017e]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\u017e\x09-\x0d\x20]+")


class Remembered:
    """Ids by word in two generations: when the newer one has half of CACHE_BYTES, the older one is forgotten and it takes its place.
    What is asked for again moves to the newer one, so words in use stay."""

    def __init__(self):
        self.new: dict = {}
        self.old: dict = {}
        self.size = 0

    def missing(self, words: set) -> list:
        """The words whose ids aren't known; all others are in self.new from now on."""
        other = words.difference(self.new)
        again = list(other.intersection(self.old))
        self.put(again, [self.old[w] for w in again])
        return list(other.difference(self.old))

    def put(self, words: list, ids: list[bytes]) -> None:
        self.new.update(zip(words, ids, strict=True))
        self.size += sum(map(len, words)) + sum(map(len, ids)) + _ENTRY * len(words)

    def turn(self) -> None:
        if self.size > CACHE_BYTES // 2:
            self.old, self.new, self.size = self.new, {}, 0


class WordEncoder:
    """Ids of a `tokenizers` BPE file whose pre-tokenizer always splits at ASCII white space and drops it.

    A plain text is split into its pre-tokens here: letters, single digits, other characters. New ones go
    through the file's BPE model many at a time, and the end-of-word suffix tells where the ids of each
    end. In all other texts each distinct word goes through the whole tokenizer. What is known is
    remembered, so it is encoded once. Ids are little-endian unsigned 32-bit numbers in bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_str(json.dumps(spec))
        split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": split, "added_tokens": []}))
        suffix = spec["model"]["end_of_word_suffix"]
        self.plain = bool(suffix) and spec["normalizer"]["normalizers"][-1]["type"] == "Lowercase"
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.words, self.parts = Remembered(), Remembered()
        self.kind = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"

    def _parts(self, new: list[str]) -> None:
        for k in range(0, len(new), 256):  # a longer text takes more time for each of its words
            some = new[k : k + 256]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            flat = ids.tobytes()
            if len(cuts) != len(some):
                raise ValueError("a part of a word has no end or several")
            self.parts.put(some, [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)])

    def _words(self, new: list[bytes]) -> None:
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            self.words.put(some, [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast([w.decode("utf-8") for w in some], add_special_tokens=False)])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        plain = [self.plain and "<|" not in t and _PLAIN.fullmatch(t) is not None for t in texts]
        lists = [_PARTS.findall(t.lower()) if p else t.encode("utf-8").split() for t, p in zip(texts, plain, strict=True)]
        long = []
        for known, learn, kind in ((self.parts, self._parts, True), (self.words, self._words, False)):
            known.turn()
            new = known.missing(set().union(*(x for x, p in zip(lists, plain, strict=True) if p == kind)))
            learn(new)
            long += [(known, x) for x in new if len(x) > CACHE_LENGTH]
        parts, words = self.parts.new, self.words.new
        out = [b"".join(map((parts if p else words).__getitem__, x)) for x, p in zip(lists, plain, strict=True)]
        for known, x in long:
            known.size -= len(x) + len(known.new.pop(x)) + _ENTRY
        return out


class RankEncoder:
    """Ids of a `tiktoken` rank file; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kind = "<u2" if self.encoding.n_vocab <= 1 << 16 else "<u4"

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.encoding.encode_ordinary(t), "<u4").tobytes() for t in texts]


def lengths(texts) -> list[int]:
    """Bytes of each text of an Arrow column; null: 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def batches_of(sizes: list[int], most: int = BATCH_BYTES) -> list[slice]:
    """Slices of texts with about that size each, one text at least."""
    out, a, total = [], 0, 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            out.append(slice(a, k + 1))
            a, total = k + 1, 0
    return out + [slice(a, len(sizes))] * (a < len(sizes))


def encoder(kind: str, name: str):
    """kind: "word" or "rank"; name: a path, or the name of one of the public tokenizer files."""
    if (kind, name) not in _made:
        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _made[kind, name] = {"word": WordEncoder, "rank": RankEncoder}[kind](path)
    return _made[kind, name]
