"""SentencePiece encoding and decoding with a shared-prefix lattice.

Distinct marked words (a run of word marks, then characters up to the next mark or line break) are sorted,
which lays them out as a depth-first walk of their trie: each word keeps the forward states of the prefix
that it shares with the word before and goes on from there. A state is the best last piece of a prefix.

Unigram files: the state is the best sum of piece scores (Viterbi). Merge (BPE) files, such as the public
one: a sequence of pieces is what merging gives exactly if each two neighbours stay apart when merged by
themselves, and each prefix has one such sequence; so the forward step looks for the one piece that ends
the prefix and is compatible with the last piece of what is before it. The sum of scores would give other
ids than the library here. Characters that no piece holds become byte pieces.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.llm.tokens import batches_of, lengths

MODEL = "piece_bpe_32k.model"
#: Distinct words that a worker remembers at most, and the longest of them in characters; those not met lately are forgotten.
CACHE, CACHE_LENGTH = 500_000, 48
#: Bytes of text whose new words are sorted together.
SORT_BYTES = 4_000_000
MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}\n\r\t]*|[^{MARK}\n\r\t]+|[\n\r\t]")
_made: dict[str, "Pieces"] = {}


class Pieces:
    """A SentencePiece file's pieces with a memory of words."""

    def __init__(self, path: str, merges: bool | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.text) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.high = np.zeros(n, bool)  # bytes of longer characters; those under 128 are characters of their own
        self.high[[i for i, b in self.byte_of.items() if b >= 128]] = True
        self.hidden = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.shown = ["" if i in self.hidden else chr(self.byte_of.get(i, 0)) if i in self.byte_of else p.replace(MARK, " ") for i, p in enumerate(self.text)]
        self.ids = {p: i for i, p in enumerate(self.text) if i not in self.hidden and i not in self.byte_of and not sp.is_unused(i)}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        # scores of merge files are minus the merge's rank, whole numbers
        self.merges = all(float(s).is_integer() for s in self.score.values()) if merges is None else merges
        self.suffixes: dict = {}  # a trie of the pieces from their ends; the key "" holds the piece that begins there
        for p, i in self.ids.items():
            node = self.suffixes
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i
        self.start = n  # stands before the first piece
        self.apart: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, word: str, border: int = 0) -> list[str] | None:
        """By the definition: the best scored neighbours merge, the leftmost of equals, until none can. None as soon as a merge crosses the border."""
        parts, score = list(word), self.score
        left = border  # parts before the border
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            if at == left - 1:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            left -= at < left

    def _compatible(self, a: int, b: int) -> bool:
        """a, b: pieces, or for a the start or a character that no piece holds."""
        if len(self.apart) > CACHE:
            self.apart.clear()
        second = self.text[b]
        if a < 0 or a == self.start:
            known = self.merged(second) == [second]
        else:
            first = self.text[a]
            known = self.merged(first + second, len(first)) == [first, second]
        self.apart[a << 32 | b] = known
        return known

    def lattice(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word with its pieces' ids, in sorted order; a character that no piece holds: minus its code point, minus 1."""
        before, last, begin, best = "", [self.start], [0], [0.0]
        low = min(self.score.values(), default=0.0) - 10
        suffixes, apart, merges = self.suffixes, self.apart, self.merges
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :], best[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                node, j, piece, at, top = suffixes, i, -1 - ord(word[i - 1]), i - 1, None
                while j:
                    j -= 1
                    node = node.get(word[j])
                    if node is None:
                        break
                    p = node.get("")
                    if p is None:
                        continue
                    if merges:
                        known = apart.get(last[j] << 32 | p)
                        if self._compatible(last[j], p) if known is None else known:
                            piece, at = p, j
                            break
                    else:
                        x = best[j] + self.score[self.text[p]]
                        if top is None or x > top:
                            top, piece, at = x, p, j
                if merges:
                    if piece < 0 and word[at] in suffixes and "" in suffixes[word[at]]:
                        raise ValueError("no piece ends here")
                else:
                    best.append(best[at] + low if top is None else top)
                last.append(piece)
                begin.append(at)
            out, i = [], len(word)
            while i:
                out.append(last[i])
                i = begin[i]
            out.reverse()
            yield word, out
            before = word

    def _run(self, n: int) -> list[str]:
        """A run of n marks alone; the pieces for such runs merge from the left."""
        longest = max((k for k in range(1, 64) if MARK * k in self.ids), default=1)
        if all(MARK * k in self.ids for k in range(2, longest + 1)):
            return [MARK * longest] * (n // longest) + [MARK * (n % longest)] * (n % longest > 0)
        return self.merged(MARK * n)

    def _id_bytes(self, pieces: list[int]) -> bytes:
        if min(pieces) < 0:
            pieces = [i for p in pieces for i in ([p] if p >= 0 else [self.byte.get(b, 0) for b in chr(-1 - p).encode("utf-8", "surrogatepass")])]
        return array("I", pieces).tobytes()

    def _learn(self, new: list[str]) -> None:
        many, mark = {}, self.ids.get(MARK)
        if self.merges and mark is not None:
            for w in new:
                if w.startswith(MARK * 2):
                    many.setdefault(MARK + w.lstrip(MARK), []).append(w)
        for short, pieces in self.lattice(list({w for w in new if not (many and w.startswith(MARK * 2))} | set(many))):
            self.words[short] = self._id_bytes(pieces)
            for w in many.get(short, ()):
                # the last mark joins what follows, if a piece holds both; the others are a run
                alone = pieces[0] == mark
                run = self._run(len(w) - len(short) + alone)
                rest = pieces[alone:]
                self.words[w] = array("I", [self.ids[p] for p in run]).tobytes() + (self._id_bytes(rest) if rest else b"")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; a mark is put before each text that isn't empty."""
        lists = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > CACHE // 2:
            self.words, self.older = {}, self.words
        new = set().union(*lists).difference(self.words)
        again = new & self.older.keys()
        self.words.update({w: self.older[w] for w in again})
        self._learn(list(new - again))
        out = [b"".join(map(self.words.__getitem__, x)) for x in lists]
        for w in new:
            if len(w) > CACHE_LENGTH:
                del self.words[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text; exact but that a mark in a text comes back as a space."""
        numbers = np.frombuffer(ids, "<u4")
        if not self.high[numbers].any():
            return "".join(map(self.shown.__getitem__, numbers.tolist()))[1:]
        out, raw = [], bytearray()
        for i in numbers.tolist():
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.shown[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)[1:]


def pieces(name: str = MODEL) -> Pieces:
    """name: a path, or the name of one of the public tokenizer files."""
    if name not in _made:
        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _made[name] = Pieces(path)
    return _made[name]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id_col, ids binary, n_ids, exact), one row for each row of docs. Null texts are empty and have no ids.
    exact: decoding the ids gives the text. A text that holds the mark itself (U+2581) is decoded with a space there, so it isn't."""

    def run(batches):
        import pyarrow as pa

        own = pieces(model)
        for rows in batches:
            for k in batches_of(lengths(rows.column("text")), SORT_BYTES):
                part = rows.slice(k.start, k.stop - k.start)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = own.encode_batch(texts)
                exact = [own.decode(b) == t for b, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary()), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(exact, pa.bool_())], names=["id", "ids", "n_ids", "exact"])

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id string, ids binary, n_ids long, exact boolean").withColumn("id", F.col("id").try_cast("long")).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(id_col, text) of (id_col, ids_col); null ids give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pieces(model)
        for part in batches:
            yield pd.DataFrame({"id": part["id"], "text": [None if b is None else own.decode(b) for b in part["ids"]]})

    return rows.select(F.col(id_col).cast("string").alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, "id string, text string").withColumn("id", F.col("id").try_cast("long")).withColumnRenamed("id", id_col)
