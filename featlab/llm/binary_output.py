"""Token ids as packed matrices: best-fit decreasing by a segment tree over capacities.

Overlong documents are split into whole rows and a rest where they are encoded, so nothing is lost. The
rests go by decreasing length to the bin that they fill best. The tree has a leaf for each free capacity
and counts the bins with that much room; a search goes down to the least capacity that suffices. Pieces
are dealt to groups of bounded size by a hash, as in packing; a matrix row is a sequence, with the cumulative lengths of its segments
and positions that start anew with each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.llm.packing import by_id, ids_kind, tokenised

LENGTH, PAD, GROUP_DOCS = 2048, 50256, 2048
TOKENIZER = "byte_bpe_50k.tiktoken"


class Capacities:
    """How many bins have each free capacity 0..length, in a segment tree."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: dict[int, list[int]] = {}

    def _add(self, capacity: int, k: int) -> None:
        i = capacity + self.width
        while i:
            self.count[i] += k
            i //= 2

    def put(self, bin_: int, capacity: int) -> None:
        self.bins.setdefault(capacity, []).append(bin_)
        self._add(capacity, 1)

    def pop(self, size: int) -> tuple[int, int] | None:
        """A bin with the least capacity of at least size, and that capacity."""
        count, i = self.count, size + self.width
        if not count[i]:
            while i > 1 and (i % 2 or not count[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.width
        self._add(capacity, -1)
        return self.bins[capacity].pop(), capacity


def best_fit(lengths: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, size)."""
    out, rest = [], []
    for d, n in enumerate(lengths):
        whole = n - n % length
        out += [[(d, a, length)] for a in range(0, whole, length)]
        if n > whole:
            rest.append((d, whole, n - whole))
    rest.sort(key=lambda x: (-x[2], x[0]))
    tree, bins = Capacities(length), []
    for item in rest:
        found = tree.pop(item[2])
        if found is None:
            found = len(bins), length
            bins.append([])
        b, room = found
        bins[b].append(item)
        if room > item[2]:
            tree.put(b, room - item[2])
    return out + bins


def packed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, pad: int = PAD, tokenizer: str = TOKENIZER, group_docs: int = GROUP_DOCS) -> DataFrame:
    """A row for each sequence: (sequence_id, ids, positions, cu_seqlens, doc_ids, starts).

    ids: `length` little-endian unsigned 16-bit ids (32-bit if the pad id needs it), padded at the end.
    positions: as many 16-bit numbers (32-bit from 65,537 columns), from 0 in each segment and in the
    padding. cu_seqlens: 0, then the end of each segment. doc_ids, starts: of each segment its document
    and the first id's place in it. A document without ids has no segment. Repeated rows are documents
    of their own.
    """
    kind, place = ("<u2" if pad < 1 << 16 else "<u4"), ("<u2" if length <= 1 << 16 else "<u4")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = by_id(rows)
        names, starts, sizes = (rows[c].tolist() for c in ("id", "start", "n"))
        names = [None if i is pd.NA else i for i in names]
        grp, out = int(rows["grp"].iloc[0]), []
        for s, pieces in enumerate(best_fit(sizes, length)):
            row, pos, ends = np.full(length, pad, kind), np.zeros(length, place), [0]
            for d, a, n in pieces:
                row[ends[-1] : ends[-1] + n] = np.frombuffer(rows["ids"][d], ids_kind(rows["ids"][d], sizes[d]))[a : a + n]
                pos[ends[-1] : ends[-1] + n] = np.arange(n)
                ends.append(ends[-1] + n)
            pos[ends[-1] :] = np.arange(length - ends[-1])
            out.append(((grp << 32) + s, row.tobytes(), pos.tobytes(), ends, [names[d] for d, _, _ in pieces], [starts[d] + a for d, a, _ in pieces]))
        return pd.DataFrame(out, columns=["sequence_id", "ids", "positions", "cu_seqlens", "doc_ids", "starts"])

    return tokenised(docs, "rank", tokenizer, None, id_col, text_col, length, group_docs, True).groupBy("grp").applyInPandas(run, "sequence_id long, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>")


def write_packed(rows: DataFrame, path: str) -> None:
    """The matrices as Parquet with a fixed-size row of ids each; Spark commits whole files only."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def unpacked(rows: DataFrame, pad: int = PAD) -> DataFrame:
    """(doc_id, start, ids) of each segment, read back from the matrices."""
    width = 2 if pad < 1 << 16 else 4
    seg = rows.select("ids", F.posexplode(F.arrays_zip("doc_ids", "starts")).alias("k", "x"), "cu_seqlens")
    a, b = F.element_at("cu_seqlens", F.col("k") + 1), F.element_at("cu_seqlens", F.col("k") + 2)
    return seg.select(F.col("x.doc_ids").alias("doc_id"), F.col("x.starts").alias("start"), F.substring(F.col("ids"), a * width + 1, (b - a) * width).alias("ids"))
