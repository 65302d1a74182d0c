"""Language-model scores by context-tree weighting over bytes.

A text is its words, A-Z in lower case, with one space after each, and an end byte. The context of a byte
is the DEPTH bytes before it, whatever words they belong to; before a text's start are end bytes. A byte
is decomposed into eight binary choices; each choice is a node with counts of zeros and ones in every
context of 0 to DEPTH bytes, with a Krichevsky-Trofimov estimate. Weighted sequence probabilities go from
the deepest contexts up, half for a context's own estimate and half for its children's product; the
weights that this gives each depth mix the estimates when a text is scored.

One pass over the texts writes blocks of them, packed, and how often each block has its most frequent
contexts; contexts that are hot in all blocks together are cut up, so that no shard has more than its share of
the grams. Each block then asks, by shard, about its distinct grams (context and byte) and words, with their
training counts. Counts are summed over
blocks by merging packed shards, MERGE at a time, as often as it takes; the probabilities of a block's
grams, and the counts of its words, go back to that block, in its own order. A token that every text
holds is one entry a block. Nothing from the corpus is gathered on the driver or sent to all executors,
save the nodes of depth 0 and 1, 65,536 at most, and those of hot contexts, of which there are 2 * HOT of a length at most. Words are told apart by 56 bits of their XXH3.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.llm.common import LOWER, give_back, lean, parts, text_or_empty, written

DEPTH = 6
#: Characters of text in a block; characters for each shard of grams and words; packed rows merged at a time; bytes of
#: packed questions that a task answers at least.
BLOCK_CHARS, SHARD_CHARS, MERGE, TASK_BYTES = 32_000_000, 4_500_000, 64, 1 << 25
MOST_SHARDS = (1 << 16) - 1
#: A context of at least two bytes at more than one in so many of all positions is cut into its extensions by a byte before it, which
#: go to shards of their own.
HOT = 512
END = b"\n"
#: Positions of a range of shards, about; positions looked at at a time (they fit a processor's cache); the shard of those that hold no gram.
RANGE, SLICE, NO_SHARD = 3 << 20, 1 << 16, 0xFFFF


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def stream(text: str) -> bytes:
    """The bytes that are predicted."""
    return b" ".join([*text.encode("utf-8", "surrogatepass").translate(LOWER).split(), END])


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, ascending, and how often each occurs. By a sort: numpy's unique hashes them, which takes far longer here. x is changed."""
    x.sort()
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def _added(a: np.ndarray, c: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending lists with counts as one."""
    both = np.concatenate((a, b))
    order = np.argsort(both, kind="stable")  # two runs, so it is a merge
    both = both[order]
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    return both[first], np.add.reduceat(np.concatenate((c, d))[order], first)


class Block:
    """Some texts' streams, each after as many end bytes as a context has.

    Grams are walked range by range: a range is some consecutive shards that hold about RANGE of the block's
    positions, so that no list of all distinct grams is ever held, only one range's.
    """

    def __init__(self, streams: list[bytes], depth: int, shards: Shards | None = None, size: int | None = None):
        self.depth, self.streams, self.shards = depth, streams, shards
        self.flat = np.frombuffer(b"".join(chain((END * 8,), chain.from_iterable((END * depth, s) for s in streams))), np.uint8)  # no other copy of the text
        self.sizes = np.array([len(s) for s in streams], np.int64)
        self.size = len(self.flat) - 8
        self.firsts = np.cumsum(self.sizes + depth) - self.sizes  # of each stream's bytes
        # number i ends with byte i, the bytes before it are above it
        self.windows = np.ndarray(self.size, ">u8", self.flat, 1, (1,))
        if shards:
            self._deal(size or RANGE)

    def _deal(self, size: int) -> None:
        """shard: each position's, NO_SHARD for bytes that aren't predicted; ranges: (first shard, one after the last)."""
        self.shard = np.empty(self.size, np.uint16)
        for lo, hi in self.slices():
            self.shard[lo:hi] = self.shards.of(self._gram(lo, hi))
        self.shard[(self.firsts - self.depth)[:, None] + np.arange(self.depth)] = NO_SHARD
        upto = np.append(0, np.cumsum(sum(np.bincount(self.shard[lo:hi], minlength=NO_SHARD + 1) for lo, hi in self.slices(8 * SLICE))[: self.shards.n]))
        edges = [0]
        while edges[-1] < self.shards.n:
            edges.append(max(edges[-1] + 1, int(np.searchsorted(upto, upto[edges[-1]] + size, "right")) - 1))
        self.ranges = list(zip(edges[:-1], edges[1:], strict=True))

    def _gram(self, at, to: int | None = None) -> np.ndarray:
        """The byte lowest and the context above it, its last byte lowest."""
        own = (self.windows[at] if to is None else self.windows[at:to]).astype("<u8")
        own &= np.uint64((1 << 8 * (self.depth + 1)) - 1)
        return own.view(np.int64)

    def heavy(self, share: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(d, contexts, how often) of all contexts of 2 to depth - 1 bytes at more than that share of the positions."""
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for d in range(2, self.depth):
            so_far = Shards(1, [c for _, c, _ in out])
            count = np.zeros(len(so_far.contexts), np.int64)
            for lo, hi in self.slices():
                count += so_far.further(self._gram(lo, hi))
            many = count > share * self.size
            if not many.any():
                break
            out.append((d, so_far.contexts[many], count[many])) 
        return out

    def slices(self, size: int | None = None) -> Iterator[tuple[int, int]]:
        size = size or SLICE
        return ((k, min(k + size, self.size)) for k in range(0, self.size, size))

    def grams(self, r: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions from lo to hi in a range, and their grams."""
        first, after = self.ranges[r]
        own = self.shard[lo:hi] - np.uint16(first)  # those before it wrap around
        at = np.flatnonzero(own < after - first) + lo
        return at, self._gram(at)

    def counted(self, r: int, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """A range's distinct grams, and how often each occurs at the positions marked (None: at all)."""
        some, held, n = [], [], 0

        def add() -> None:
            some.append(_distinct(np.concatenate(held)))
            held.clear()
            while len(some) > 1 and len(some[-2][0]) < 2 * len(some[-1][0]):  # few long lists, not one for each slice
                some[-2:] = [_added(*some[-2], *some[-1])]

        for lo, hi in self.slices():
            at, g = self.grams(r, lo, hi)
            if marked is not None:
                g <<= 1
                g |= marked[at]
            held.append(g)
            n += len(g)
            if n >= RANGE:
                add()
                n = 0
        add()
        while len(some) > 1:
            some[-2:] = [_added(*some[-2], *some[-1])]
        key, c = some[0]
        if marked is None:
            return key, c
        gram = key >> 1
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
        return gram[first], np.add.reduceat(c * (key & 1), first) if len(gram) else c

    def marked(self, train: np.ndarray) -> np.ndarray:
        """Of each position, whether its stream is in train."""
        return np.repeat(train, self.sizes + self.depth)

    def add_sums(self, out: np.ndarray, r: int, grams: np.ndarray, values: np.ndarray) -> None:
        """Adds to each stream's number in out the values of its grams in a range; grams: all distinct ones there, ascending."""
        places = Places(grams)
        for lo, hi in self.slices():
            at, g = self.grams(r, lo, hi)
            if len(at):
                total = np.append(0.0, np.cumsum(values[places.of(g)]))
                a, b = np.searchsorted(self.firsts, lo, "right") - 1, np.searchsorted(self.firsts, hi, "left")
                edge = np.searchsorted(at, np.append(self.firsts[max(a, 0) : b], hi))
                out[max(a, 0) : b] += np.diff(total[edge])

    def numbered(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct words, the number of the word of each token, and the first token of each stream."""
        numbers: dict = defaultdict()
        numbers.default_factory = numbers.__len__
        flat = []
        for s in self.streams:
            tokens = s.split(b" ")
            flat.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
        size = np.array([len(t) for t in flat], np.int64)
        return list(numbers), np.concatenate(flat), np.cumsum(size) - size


class Places:
    """Positions of numbers in an ascending array, by a table of hashes that the array itself checks."""

    def __init__(self, sorted_: np.ndarray):
        self.all, self.shift = sorted_, np.uint64(62 - max(1, len(sorted_)).bit_length())
        self.table = np.zeros(1 << int(64 - self.shift), np.int32)
        self.table[self._hash(sorted_)] = np.arange(len(sorted_), dtype=np.int32)

    def _hash(self, x: np.ndarray) -> np.ndarray:
        return (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, x: np.ndarray) -> np.ndarray:
        out = self.table[self._hash(x)].astype(np.int64)
        other = np.flatnonzero(self.all[out] != x)
        out[other] = np.searchsorted(self.all, x[other])
        return out


def word_keys(words: list[bytes]) -> np.ndarray:
    import xxhash

    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(8)).astype(np.int64)


def packed(gram: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending grams with columns of 64-bit values, compressed."""
    import zstandard

    parts = [np.diff(gram, prepend=0), *columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(np.asarray(x).astype("<i8" if x.dtype.kind in "iu" else "<f8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in parts))


def unpacked(data: bytes, kinds: str) -> list[np.ndarray]:
    """The grams and the columns, kinds "i" or "f" for each of the latter."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(1 + len(kinds), 8, -1)
    out = [np.ascontiguousarray(x.T).view("<i8" if k == "i" else "<f8").ravel() for x, k in zip(raw, "i" + kinds, strict=True)]
    return [np.cumsum(out[0]), *out[1:]]


def squeezed(x: np.ndarray) -> bytes:
    """Numbers byte by byte of their places, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes())


def restored(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


class Shards:
    """Numbers from 0 to n - 1 for grams, by their context: all grams with the same last two context bytes are in one shard, or, where those
    bytes are hot, all with the same last three, and so on. hot: contexts of two bytes, of three, ...; each without its first byte is hot, too."""

    def __init__(self, n: int, hot: tuple | list = ()):
        self.n, self.hot, self.tables = n, [np.sort(np.asarray(h, np.int64)) for h in hot if len(h)], []
        contexts = np.arange(1 << 16, dtype=np.int64)
        for d, own in enumerate([*self.hot, np.zeros(0, np.int64)], 2):
            mixed = (contexts * 8 + d).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            at = np.searchsorted(own, contexts)
            is_hot = own[np.minimum(at, len(own) - 1)] == contexts if len(own) else np.zeros(len(contexts), bool)
            self.tables.append(np.where(is_hot, -1 - at, (mixed * np.uint64(n) >> np.uint64(32)).astype(np.int64)).astype(np.int32))  # below zero: the place among the hot
            self.contexts, contexts = contexts, (own[:, None] | (np.arange(256, dtype=np.int64) << 8 * d)).ravel()

    def _walk(self, gram: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes of context, grams, their places in the table of so many bytes, what it says), of all grams first, then of those hot so far."""
        at, place = np.arange(len(gram)), (gram >> 8) & 0xFFFF
        for d, table in enumerate(self.tables, 2):
            found = table[place]
            yield d, at, place, found
            inside = np.flatnonzero(found < 0)
            at = at[inside]
            place = (-1 - found[inside]) * 256 + ((gram[at] >> 8 * (d + 1)) & 255)

    def of(self, gram: np.ndarray) -> np.ndarray:
        out = np.empty(len(gram), np.int32)
        for _, at, _, found in self._walk(gram):
            out[at] = found
        return out

    def by_top(self, gram: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(d, grams): those that share their last d context bytes with all of their shard's that have the same last d - 1."""
        return [(d, at[found >= 0]) for d, at, _, found in self._walk(gram) if (found >= 0).any()]

    def further(self, gram: np.ndarray) -> np.ndarray:
        """How many grams have each context of the last table: two bytes, or the longest hot ones and one byte before."""
        *_, (_, _, place, _) = self._walk(gram)
        return np.bincount(place, minlength=len(self.contexts))


def word_shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (key >> 24) * shards >> 32


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    low = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - low


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - np.log(np.pi) - _log_gamma(zeros + ones + 1.0)


HALF = np.log(0.5)


class Subtree:
    """All nodes of one of a byte's eight choices, at depths `top` to depth of the contexts of some grams; all grams with the same last `top` context bytes are here."""

    def __init__(self, gram: np.ndarray, c: np.ndarray, k: int, depth: int, top: int):
        byte = gram & 255
        self.bit = (byte >> (7 - k)) & 1
        key = (gram >> 8 << 8) | (1 << k) | (byte >> (8 - k))  # ascending, as the grams are
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        node, self.at = key[new], np.cumsum(new) - 1
        zeros, ones = (np.bincount(self.at, c * (self.bit == b), len(node)) for b in (0, 1))
        kt = _log_kt(zeros, ones)
        self.levels = [(node, zeros, ones, kt, kt, None)]
        for d in range(depth - 1, top - 1, -1):
            node, zeros, ones, _, weighted, _ = self.levels[-1]
            parent, up = np.unique((((node >> 8) & ((1 << (8 * d)) - 1)) << 8) | (node & 255), return_inverse=True)
            z, o, children = (np.bincount(up, x, len(parent)) for x in (zeros, ones, weighted))
            kt = _log_kt(z, o)
            self.levels.append((parent, z, o, kt, HALF + np.logaddexp(kt, children), up))

    def mixed(self) -> np.ndarray:
        """The probability of each gram's choice, mixed over the depths here."""
        at, p = self.at, None
        for _, zeros, ones, kt, weighted, up in self.levels:
            at = at if up is None else up[at]
            own = (np.where(self.bit, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
            if p is None:
                p = own
            else:
                stop = np.exp(HALF + kt[at] - weighted[at])
                p = stop * own + (1 - stop) * p
        return p


class Crown:
    """What is above the shards' subtrees: the nodes of depths 1 and 0, dense by last byte and node, and those of hot contexts. For each
    node the probability of a one, and the weight of stopping there."""

    def __init__(self, children: dict[int, list[np.ndarray]], depth: int):
        """children: by depth, (context << 8 | node, zeros, ones, weighted), sums over the children that shards hold of the nodes of that depth."""
        sums = {d: list(c) for d, c in children.items()}
        self.deep: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        none = [np.zeros(0, np.int64), *[np.zeros(0)] * 3]
        for d in range(depth - 1, 0, -1):
            key, zeros, ones, weighted = sums.get(d, none)
            node, up = np.unique(key, return_inverse=True)
            z, o, w = (np.bincount(up, x, len(node)) for x in (zeros, ones, weighted))
            one, stop, own = self._node(z, o, w)
            if d > 1:
                self.deep[d] = node, one, stop
                sums[d - 1] = [np.concatenate(x) for x in zip(sums.get(d - 1, none), (((node >> 8) & ((1 << 8 * (d - 1)) - 1)) << 8 | (node & 255), z, o, own), strict=True)]
        dense = lambda x: np.bincount(node, x, 1 << 16) if len(node) else np.zeros(1 << 16)
        z, o, w = dense(z), dense(o), dense(w)
        self.one1, self.stop1, own = self._node(z, o, w)
        z, o, w = (x.reshape(256, 256).sum(0) for x in (z, o, own))
        self.one0, self.stop0, _ = self._node(z, o, w)

    @staticmethod
    def _node(z: np.ndarray, o: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kt = _log_kt(z, o)
        own = HALF + np.logaddexp(kt, w)
        return (o + 0.5) / (z + o + 1), np.exp(HALF + kt - own), own

    def mixed(self, gram: np.ndarray, c: np.ndarray, depth: int, shards: Shards) -> np.ndarray:
        """log10 of the probability of each gram's byte in its context; one of the byte's choices at a time."""
        out = np.zeros(len(gram))
        for top, some in shards.by_top(gram):
            g, own_c = gram[some], c[some]
            for k in range(8):
                tree = Subtree(g, own_c, k, depth, top)
                p, node = tree.mixed(), (1 << k) | ((g & 255) >> (8 - k))
                above = []
                for d in range(top - 1, 1, -1):
                    key, one, stop = self.deep[d]
                    at = np.searchsorted(key, ((g >> 8) & ((1 << 8 * d) - 1)) << 8 | node)
                    above.append((one, stop, at))
                for one, stop, at in (*above, (self.one1, self.stop1, (((g >> 8) & 255) << 8) | node), (self.one0, self.stop0, node)):
                    p = stop[at] * np.where(tree.bit, one[at], 1 - one[at]) + (1 - stop[at]) * p
                out[some] += np.log10(p)
        return out


def _summed(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = [unpacked(d, "i") for d in data]
    gram, at = np.unique(np.concatenate([g for g, _ in both]), return_inverse=True)
    return gram, np.bincount(at, np.concatenate([c for _, c in both]), len(gram)).astype(np.int64)


def merged(rows: DataFrame) -> DataFrame:
    """rows: (block, kind, shard, data). (kind, shard, data), the counts of all blocks summed; MERGE rows meet in a task at a time."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [part["block"].min()], "kind": [part["kind"].iloc[0]], "shard": [part["shard"].iloc[0]], "data": [packed(*_summed(list(part["data"])))]})

    most = rows.groupBy("kind", "shard").count().agg(F.max("count")).first()[0] or 0
    first = True
    while first or most > 1:
        groups = max(1, -(-most // MERGE) if most > MERGE else 1)
        salt = F.pmod(F.xxhash64("block", F.lit(most)), F.lit(groups))
        rows = written(rows.withColumn("salt", salt).groupBy("kind", "shard", "salt").applyInPandas(add, "block long, kind int, shard int, data binary"), "merged")
        first, most = False, groups if groups > 1 else 1
    return rows.select("kind", "shard", "data")


def gram_scores(counts: DataFrame, shards: Shards, depth: int = DEPTH) -> DataFrame:
    """counts: (shard, data) with packed (gram, c). (shard, data) with packed (gram, logp)."""

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for data in rows["data"]:
                gram, c = unpacked(data, "i")
                for top, some in shards.by_top(gram):
                    for k in range(8):
                        node, zeros, ones, _, weighted, _ = Subtree(gram[some], c[some], k, depth, top).levels[-1]
                        parent = ((node >> 8) & ((1 << 8 * (top - 1)) - 1)) << 8 | (node & 255)
                        yield pd.DataFrame({"d": np.int32(top - 1), "key": parent, "zeros": zeros, "ones": ones, "weighted": weighted})

    counts = counts.repartition(parts(counts.sparkSession), "shard")  # small rows, long work: not to be coalesced
    below = counts.select("data").mapInPandas(lean(up), "d int, key long, zeros double, ones double, weighted double")
    # 65,536 rows for depth 1, and 256 for each hot context, of which there are 2 * HOT of a length at most
    sums = below.groupBy("d", "key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted")).orderBy("d", "key").toPandas()
    crown = Crown({int(d): [own["key"].to_numpy(np.int64), *(own[x].to_numpy(float) for x in ("zeros", "ones", "weighted"))] for d, own in sums.groupby("d")}, depth)

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for shard, data in zip(rows["shard"], rows["data"], strict=True):
                gram, c = unpacked(data, "i")
                yield pd.DataFrame({"shard": [shard], "data": [packed(gram, crown.mixed(gram, c, depth, shards))]})

    return counts.mapInPandas(lean(down), "shard int, data binary")


def values(kind: int, data: bytes):
    """A shard's answers to packed keys, in their order. kind 1: counts, packed; kind 2: single-precision numbers."""
    key, value = unpacked(data, "i" if kind == 1 else "f")

    def answer(asked: bytes) -> bytes:
        found = value[np.searchsorted(key, unpacked(asked, "i")[0])]
        return squeezed(found.astype("<i8" if kind == 1 else "<f4"))

    return answer


def answers(asked: DataFrame, known: DataFrame, prepare=values) -> DataFrame:
    """asked: (block, kind, shard, data), known: (kind, shard, data). (block, kind, shard, data) with prepare(kind, known data)(asked data).

    A shard that many blocks ask is answered in several tasks, as many as the questions have times its own size or TASK_BYTES, so
    its copies are no more than the questions. A shard that is not known is answered as an empty one.
    """
    sizes = asked.groupBy("kind", "shard").agg(F.sum(F.octet_length("data")).alias("asked")).join(known.select("kind", "shard", F.octet_length("data").alias("own")), ["kind", "shard"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    sizes = sizes.select("kind", "shard", F.ceil(F.col("asked") / F.greatest(F.col("own"), F.lit(TASK_BYTES))).cast("long").alias("groups"))
    left = asked.join(sizes, ["kind", "shard"]).select("kind", "shard", F.pmod(F.xxhash64("block"), "groups").alias("salt"), "block", "data")
    right = known.join(sizes, ["kind", "shard"]).select(F.col("kind").alias("to_kind"), F.col("shard").alias("to_shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("to_salt"), "data")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"block": [], "kind": [], "shard": [], "data": []})
        own = prepare(int(a["kind"].iloc[0]), b["data"].iloc[0] if len(b) else packed(*[np.zeros(0, np.int64)] * 2))
        out = [own(d) for d in a["data"]]
        return pd.DataFrame({"block": a["block"], "kind": a["kind"], "shard": a["shard"], "data": out})

    return left.groupBy("kind", "shard", "salt").cogroup(right.groupBy("to_kind", "to_shard", "to_salt")).applyInPandas(run, "block long, kind int, shard int, data binary")


def texts(docs: DataFrame, id_col: str, text_col: str, depth: int, block_chars: int) -> DataFrame:
    """(block, kind, data, more). Kind 0: the streams of a block; more: its ids, stream sizes and text bytes. Kind d from 2 to depth - 1: the
    contexts of d bytes at more than one in 2 * HOT of a block's positions, with counts; kind 1: how many positions it has."""
    names = ["block", "kind", "data", "more"]

    def frame(block: int, rows: list[tuple[int | None, bytes, int]]) -> pd.DataFrame:
        import zstandard

        ids, streams, text_bytes = zip(*rows, strict=True)
        text = zstandard.ZstdCompressor(level=3).compress(b"".join(streams))
        own = Block(list(streams), depth)
        sorted_ = lambda c, n: packed(*(x[np.argsort(c)] for x in (c, n)))
        return pd.DataFrame([(block, 0, text, pickle.dumps((list(ids), own.sizes, list(text_bytes)))), (block, 1, packed(np.zeros(1, np.int64), np.array([own.size])), None), *[(block, d, sorted_(c, n), None) for d, c, n in own.heavy(1 / (2 * HOT))]], columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, held, chars = TaskContext.get().partitionId() << 32, [], 0
        for rows in batches:
            for doc_id, text in zip(rows["id"], rows["text"], strict=True):
                s = stream(text)
                held.append((None if doc_id is None else int(doc_id), s, len(text.encode("utf-8", "surrogatepass"))))
                chars += len(s)
                if chars >= block_chars:
                    yield frame(block, held)
                    block, held, chars = block + 1, [], 0
        if held:
            yield frame(block, held)

    return docs.select(F.col(id_col).try_cast("long").cast("string").alias("id"), text_or_empty(text_col).alias("text")).mapInPandas(lean(run), "block long, kind int, data binary, more binary")


def hot_contexts(rows: DataFrame) -> tuple[int, list[list[int]]]:
    """rows: those of texts() from kind 1 on. All positions, and by length the contexts that may be at more than one in HOT of them.

    A context with that share of all positions has it in some block, and what other blocks don't tell of it is less than half of that. So
    what they tell sums up to one in 2 * HOT at least, which no more than 2 * HOT contexts of a length can reach.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for kind, data in zip(some["kind"], some["data"], strict=True):
                context, n = unpacked(data, "i")
                yield pd.DataFrame({"d": np.int32(kind), "context": context, "n": n})

    counts = rows.select("kind", "data").mapInPandas(run, "d int, context long, n long").groupBy("d", "context").agg(F.sum("n").alias("n"))
    counts = written(counts, "contexts")
    total = counts.where("d = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot: dict[int, list[int]] = defaultdict(list)
    for r in counts.where((F.col("d") > 1) & (F.col("n") * 2 * HOT > total)).collect():
        hot[r["d"]].append(r["context"])
    return total, [hot[d] for d in sorted(hot)]


def opened(data: bytes, more: bytes, depth: int, shards: Shards) -> tuple[Block, list, list]:
    """A row of texts() as a block, with ids and text bytes."""
    import zstandard

    ids, sizes, text_bytes = pickle.loads(more)
    text, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum(sizes).tolist()
    streams = [text[b - int(n) : b] for b, n in zip(ends, sizes, strict=True)]
    del text
    return Block(streams, depth, shards), ids, text_bytes


def questions(rows: DataFrame, depth: int, shards: Shards) -> DataFrame:
    """rows: those of texts() of kind 0. (block, kind, shard, data). Kind 1: a block's words of a shard with their training counts; 2: its grams of a shard with theirs."""

    def frame(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pd.DataFrame:
        order = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[order], np.arange(shards.n + 1))
        some = [(k, order[a:b]) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if a < b]
        return pd.DataFrame([(block, kind, k, packed(keys[m], counts[m])) for k, m in some], columns=["block", "kind", "shard", "data"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for block, data, more in part.itertuples(index=False, name=None):
                own, ids, _ = opened(data, more, depth, shards)
                train = np.array([not held_out(i) for i in ids])
                words, flat, first = own.numbered()
                own.streams = []  # grams need the bytes only once
                marked = np.repeat(train, np.diff(np.append(first, len(flat))))
                key, at = np.unique(word_keys(words), return_inverse=True)
                yield frame(block, 1, key, np.bincount(at[flat[marked]], minlength=len(key)), word_shard(key, shards.n))
                del words, flat, first, key, at
                give_back()
                marked = own.marked(train)
                for r in range(len(own.ranges)):
                    gram, c = own.counted(r, marked)
                    if len(gram):
                        yield frame(block, 2, gram, c, shards.of(gram))

    return rows.select("block", "data", "more").mapInPandas(lean(run), "block long, kind int, shard int, data binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_chars: int = BLOCK_CHARS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row for each row of docs: (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, text_bytes, bits_per_byte).

    Documents whose crc32(id as text) mod 5 is 1 are held out, a null id counts as empty text; the others
    train. Words have A-Z in lower case; the end counts as a token. base_score: log10 probability under
    the smoothed token frequencies; score: under the context trees; n_bytes: those that score predicts,
    with one space after a word and the end byte; text_bytes: of the text as it is; bits_per_byte: code
    length for each byte predicted. Null texts are empty, ids that are no whole number null. Without
    training rows every choice is even.
    """
    index = written(texts(docs, id_col, text_col, depth, block_chars), "blocks")
    total, hot = hot_contexts(index.where("kind > 0"))
    shards = Shards(int(min(MOST_SHARDS, max(16, -(-total // shard_chars)))), hot)
    asked = written(questions(index.where("kind = 0"), depth, shards), "questions")
    counts = merged(asked)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            c = [unpacked(d, "i")[1] for d in rows["data"]]
            yield pd.DataFrame({"n": [int(x.sum()) for x in c], "v": [int((x > 0).sum()) for x in c]}, dtype=np.int64)

    size = counts.where("kind = 1").select("data").mapInPandas(sums, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    total, distinct = int(size["n"]), int(size["v"])
    scored = gram_scores(counts.where("kind = 2").select("shard", "data"), shards, depth).select(F.lit(2).alias("kind"), "shard", "data")
    known = written(scored.unionByName(counts.where("kind = 1")), "known")
    given = answers(asked, known).withColumnRenamed("block", "to_block")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        give_back()
        own, ids, text_bytes = opened(left["data"].iloc[0], left["more"].iloc[0], depth, shards)
        sizes = own.sizes
        given_by = {kind: dict(zip(part["shard"], part["data"], strict=True)) for kind, part in right.groupby("kind")}

        def value(kind: int, keys: np.ndarray, shard: np.ndarray, of: tuple[int, int], read) -> np.ndarray:
            order, out = np.argsort(shard, kind="stable"), np.zeros(len(keys))
            edge = np.searchsorted(shard[order], np.arange(of[0], of[1] + 1))
            for k in range(*of):
                if edge[k - of[0]] < edge[k - of[0] + 1]:
                    out[order[edge[k - of[0]] : edge[k - of[0] + 1]]] = read(given_by[kind][k])
            return out

        words, flat, first = own.numbered()
        key, at = np.unique(word_keys(words), return_inverse=True)
        c = value(1, key, word_shard(key, shards.n), (0, shards.n), lambda d: restored(d, "<i8"))[at]
        base = np.add.reduceat(np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))[flat], first)
        known, n_tokens = np.add.reduceat((c > 0)[flat].astype(np.int64), first), np.diff(np.append(first, len(flat)))
        del words, flat, key, at, c
        own.streams = []
        give_back()
        sums = np.zeros(len(sizes))
        for r, of in enumerate(own.ranges):
            gram, _ = own.counted(r)
            own.add_sums(sums, r, gram, value(2, gram, shards.of(gram), of, lambda d: restored(d, "<f4")))
        frame = pd.DataFrame({id_col: pd.array(ids, "Int64"), "held_out": [held_out(i) for i in ids], "n_tokens": n_tokens, "n_known": known, "train_tokens": total, "base_score": base, "score": sums, "n_bytes": sizes, "text_bytes": text_bytes})
        frame["bits_per_byte"] = -frame["score"] / np.log10(2) / frame["n_bytes"]
        return frame

    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, text_bytes long, bits_per_byte double"
    left = index.where("kind = 0").select("block", "data", "more")
    return left.groupBy("block").cogroup(given.groupBy("to_block")).applyInPandas(run, schema)
