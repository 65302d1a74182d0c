"""SimHash fingerprints and covering locality-sensitive hashing.

Bit masks: each of the 64 bit positions gets a vector of RADIUS+1 bits, and the mask of each of the
2**(RADIUS+1)-1 non-zero vectors v keeps the positions whose vector has an odd product with v. For
any RADIUS positions some v is orthogonal to all their vectors, so two fingerprints that differ in
RADIUS bits at most agree under that v's mask: they collide in some table for certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.llm.common import LOWER, fresh, written
from featlab.llm.components import components

RADIUS = 2
SHINGLE = 3
#: Buckets up to this many fingerprints are compared pair by pair, larger ones through neighbours.
BUCKET = 32
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """Bit i is set if more than half the shingles' XXH64 (seed 42) have it; no words: 0."""
    import xxhash

    flat = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split())
    if not flat:
        return 0
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(flat)]))
    n = max(1, len(starts) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(ends)) - 1 :].tolist()
    view, digest, total = memoryview(flat), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        h = np.fromiter((digest(view[a:b], 42) for a, b in zip(starts[k : k + _CHUNK], ends[k : k + _CHUNK], strict=True)), np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * total > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """(id, fp), fp the fingerprint's 64 bits as a signed long; one row for each row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fp = np.array([fingerprint(t, words) for t in rows["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": rows["id"], "fp": fp})

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "id string, fp long").withColumn("id", F.col("id").try_cast("long"))


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks as unsigned 64-bit numbers; positions get the non-zero vectors in turn."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(64)]
    return [sum(1 << i for i, x in enumerate(vectors) if bin(x & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct: one column fp, no repeats. (a, b) links that connect exactly the fingerprints within radius.

    A bucket of a table holds fingerprints that agree under its mask. Small buckets are compared pair
    by pair, at most BUCKET/2 a row. In larger ones each fingerprint is sent to its variants with up to
    radius // 2 bits flipped outside the mask; two within an even radius share a variant, and those that
    share one are within it, so linking each to its variant's least one joins the same components
    without a pair for each link.
    """
    if radius % 2:
        raise ValueError("an even radius is needed")
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks(radius))])
    rows = distinct.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = written(rows.join(sizes, ["t", "key"]), "buckets")
    small = held.where(F.col("n") <= BUCKET).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    left = small.select("t", "key", F.explode("fps").alias("a"), "fps")
    pairs = left.select("a", F.explode(F.filter("fps", lambda b: (b > F.col("a")) & (F.bit_count(b.bitwiseXOR(F.col("a"))) <= radius))).alias("b"))
    large = held.where(F.col("n") > BUCKET)
    full = sum(1 << i for i in range(64))
    free = F.element_at(F.array(*[F.lit(_signed(full ^ m)) for m in masks(radius)]), F.col("t") + 1)
    flips = [0]
    step = [0]
    for _ in range(radius // 2):
        step = sorted({x ^ (1 << i) for x in step for i in range(64)} - set(flips))
        flips += step
    flip = F.array(*[F.lit(_signed(x)) for x in flips])
    variants = large.select("t", "fp", F.explode(F.filter(flip, lambda x: x.bitwiseAND(free) == x)).alias("flip")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    least = variants.groupBy("t", "variant").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    star = least.select("a", F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(star).distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id_col, fingerprint, component_id), one row for each row of docs.

    fingerprint: 16 lowercase hex digits. Rows link when their fingerprints differ in radius bits at
    most; component_id is the least id reachable, null if no row of the component has an id. Null
    and empty texts have fingerprint zero and link like any other.
    """
    fp = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    least = written(fp.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct")
    linked = components(near_links(least.select("fp"), radius), "a", "b")
    joined = least.join(linked, least["fp"] == linked["node"], "left").select("fp", "least_id", F.coalesce("component_id", "fp").alias("c"))
    ids = joined.groupBy("c").agg(F.min("least_id").alias("component_id"))
    named = joined.join(ids, "c").select("fp", "component_id")
    return fp.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_least(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with the row of the least id of each component. rows: (id_col, component_id, ...), one for each row of docs."""
    key = fresh("_id", docs)
    kept = written(rows.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(F.col(id_col).alias(key)).agg(F.count("*").alias("n_rows")), "kept")
    same = F.col(id_col).try_cast("long").eqNullSafe(F.col(key))
    out = docs.join(kept.where("n_rows = 1"), same, "left_semi")
    again = kept.where("n_rows > 1")
    if not again.isEmpty():
        out = out.unionByName(docs.join(again, same, "left_semi").dropDuplicates([id_col]))
    return out.select(*docs.columns)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with the row of the least id of each component; all columns stay as they are. Of several rows with that id, one stays."""
    return keep_least(docs, near_components(docs, id_col, text_col, words, radius), id_col)
