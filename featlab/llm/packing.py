"""Packing documents into sequences of one length.

The task that encodes a document cuts whole sequences off it, which need no place; only its rest, less
than a sequence, goes to a randomised group. Groups are dealt by a hash of the id, the text and, for
repeated rows, how many went before in the task, and there is one for each GROUP_DOCS rows and each
GROUP_BYTES of text. So no group grows with a document, a repeated row or the corpus. In a group the
rests are placed by decreasing length in the first bin with room, found in a tournament tree of the
bins' free space. Then the emptiest bins are cut up to fill the gaps in the others, so all gaps of a
group come to less than one sequence.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.llm.tokens import batches_of, encoder, lengths

LENGTH, END, GROUP_DOCS, GROUP_BYTES = 4096, 2, 2048, 16_000_000
TOKENIZER = "word_bpe_49k.json"


class Tournament:
    """Free space of n bins; each inner node holds the most of its two children."""

    def __init__(self, n: int, space: int):
        self.width = 1 << max(0, n - 1).bit_length()
        self.most = [space] * (2 * self.width)

    def first(self, size: int) -> int:
        """The first bin with room for size."""
        most, i = self.most, 1
        while i < self.width:
            i *= 2
            if most[i] < size:
                i += 1
        return i - self.width

    def take(self, bin_: int, size: int) -> None:
        most, i = self.most, bin_ + self.width
        most[i] -= size
        i //= 2
        while i:
            most[i] = max(most[2 * i], most[2 * i + 1])
            i //= 2

    def free(self, bin_: int) -> int:
        return self.most[bin_ + self.width]


def first_fit(lengths: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, size), gapless; all gaps at their ends are less than the emptiest holds."""
    out, rest = [], []
    for d, n in enumerate(lengths):
        whole = n - n % length
        out += [[(d, a, length)] for a in range(0, whole, length)]
        if n > whole:
            rest.append((d, whole, n - whole))
    rest.sort(key=lambda x: (-x[2], x[0]))
    tree, bins = Tournament(len(rest) or 1, length), []
    for item in rest:
        b = tree.first(item[2])
        tree.take(b, item[2])
        if b == len(bins):
            bins.append([])
        bins[b].append(item)
    # the emptiest bins fill the others' gaps
    order = sorted(range(len(bins)), key=lambda b: (-tree.free(b), b))
    free = {b: tree.free(b) for b in order}
    total, gone = sum(free.values()), 0
    while gone < len(order) and length - free[order[gone]] <= total - free[order[gone]]:
        donor = order[gone]
        gone += 1
        total -= length
        free.pop(donor)
        pieces, bins[donor] = bins[donor], []
        gaps = iter(sorted((b for b in order[gone:] if free[b]), key=lambda b: (free[b], b), reverse=True))
        b = next(gaps, None)
        for d, a, n in pieces:
            while n:
                while not free[b]:
                    b = next(gaps)
                k = min(n, free[b])
                bins[b].append((d, a, k))
                free[b] -= k
                a, n = a + k, n - k
    return out + [b for b in bins if b]


_ROW = "id string, grp long, start long, n long, total long, crc long, ids binary"


def tokenised(docs: DataFrame, kind: str, name: str, end: int | None, id_col: str, text_col: str, length: int, group_docs: int, whole_ids: bool) -> DataFrame:
    """(id as a string, grp, start, n, total, crc, ids): each document's whole sequences and, if there is one, its rest.

    start, n: the piece's place in its document of total ids, the end id with them. A rest has crc null
    and its ids; a whole sequence has the CRC-32 of its ids, and the ids only with whole_ids. ids are
    little-endian, of 16 bits each (32 if the encoder has larger ones). A document without ids has no row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-size["n"] // group_docs), -(-int(size["bytes"]) // GROUP_BYTES))
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        import xxhash

        own, before = encoder(kind, name), Counter()
        for rows in batches:
            for k in batches_of(lengths(rows.column("text"))):
                part = rows.slice(k.start, k.stop - k.start)
                out = []
                for i, h, found in zip(part.column("id").to_pylist(), part.column("h").to_pylist(), own.encode_batch(part.column("text").to_pylist()), strict=True):
                    ids = np.frombuffer(found + tail, "<u4")
                    nth, total = before[h], len(ids)
                    before[h] += 1
                    for a in range(0, total, length):
                        piece = ids[a : a + length]
                        grp = xxhash.xxh64_intdigest(f"{h} {nth} {a}") % groups
                        full = len(piece) == length
                        out.append((i, grp, a, len(piece), total, zlib.crc32(piece.tobytes()) if full else None, piece.astype(own.kind).tobytes() if whole_ids or not full else None))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 7, [pa.string(), *[pa.int64()] * 5, pa.binary()], strict=True)], names=["id", "grp", "start", "n", "total", "crc", "ids"])

    return docs.select(F.col(id_col).try_cast("long").cast("string").alias("id"), F.xxhash64(F.col(id_col), text).alias("h"), text.alias("text")).mapInArrow(run, _ROW)


def by_id(rows: pd.DataFrame) -> pd.DataFrame:
    """A group's rows in order; those without an id come last."""
    own = rows.assign(id=rows["id"].astype("Int64"), ids=rows["ids"].where(rows["ids"].notna(), b""))
    own = own.sort_values(["id", "start", "total", "ids"], na_position="last", ignore_index=True)
    return own.astype({c: np.int64 for c in ("start", "n", "total")})


def ids_kind(ids: bytes, n: int) -> str:
    """The type of n packed ids."""
    return "<u2" if len(ids) == 2 * n else "<u4"


def pack_first_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, tokenizer: str = TOKENIZER, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """A row for each piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Each row of docs is a document of its own, also if its id repeats; null and empty texts have the
    end id alone. Each id of a document is in exactly one piece. Sequences hold `length` ids at most.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = by_id(rows)
        grp = int(rows["grp"].iloc[0]) << 32
        rest = np.flatnonzero(rows["crc"].isna()).tolist()
        whole = np.flatnonzero(rows["crc"].notna()).tolist()
        names, starts, sizes, totals, crcs = (rows[c].tolist() for c in ("id", "start", "n", "total", "crc"))
        ids = [np.frombuffer(b, ids_kind(b, n)).astype("<u4") for b, n in zip(rows["ids"], sizes, strict=True)] if with_ids else None
        out = []
        for s, k in enumerate(whole):
            out.append((names[k], starts[k], sizes[k], crcs[k], totals[k], grp + s, 0) + ((ids[k].tobytes(),) if with_ids else ()))
        for s, pieces in enumerate(first_fit([sizes[k] for k in rest], length), len(whole)):
            offset = 0
            for d, a, n in pieces:
                k = rest[d]
                own = np.frombuffer(rows["ids"][k], ids_kind(rows["ids"][k], sizes[k]))[a : a + n].astype("<u4").tobytes()
                out.append((names[k], starts[k] + a, n, zlib.crc32(own), totals[k], grp + s, offset) + ((own,) if with_ids else ()))
                offset += n
        frame = pd.DataFrame(out, dtype=object, columns=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)
        return frame.astype({c: "Int64" for c in frame.columns if c != "ids"})

    schema = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return tokenised(docs, "word", tokenizer, end, id_col, text_col, length, group_docs, with_ids).groupBy("grp").applyInPandas(run, schema)
