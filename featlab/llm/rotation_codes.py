"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

Equal vectors of a label count once from here on. Each distinct unit vector o is rotated at random;
its code is the signs of the rotated components, x = sign(Po)/sqrt(D), and its correction factor is
<x, Po>. For another unit vector q, <x, Pq> / <x, Po> estimates <o, q> without bias, and the error is
at most EPSILON * sqrt((1 - f^2) / f^2 / (D - 1)) with f the factor, but for a probability that falls
with exp(-c EPSILON^2). Only pairs whose bound reaches the threshold are computed again in double
precision, and those alone decide.

Candidates come from further rotations: tables of sign bits, within a label. A pair at the threshold's
angle shares a table's bits with probability (1 - angle/180)**bits, and there are as many tables as keep
the share of such pairs that all tables miss at MISS; pairs that are more similar are missed less (with 16
bits 0.13 % at cosine 0.93, 0.007 % at 0.95). The bits grow with the vectors of the largest label, one for
each doubling from LEAST_BITS on, so unrelated vectors don't crowd the buckets. Buckets over TILE vectors
are cut into tiles, so that no task holds a whole group; tasks count links and pass on one tree of links a
tile, not the pairs. Vectors travel as they came, in single precision where that loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.llm.common import parts, written
from featlab.llm.components import components

COSINE, MISS, TILE, EPSILON, SEED = 0.93, 0.0013, 512, 5.0, 17
#: Sign bits of a table at least and at most, and vectors a label for each bucket from which on more bits are taken.
LEAST_BITS, MOST_BITS, CROWD = 16, 32, 256


def tables_for(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(tables, bits) for n vectors in the largest label."""
    bits = min(MOST_BITS, max(LEAST_BITS, (n // CROWD).bit_length()))
    shared = (1 - np.arccos(cosine) / np.pi) ** bits
    return int(np.ceil(np.log(MISS) / np.log1p(-shared))), bits


TABLES, BITS = tables_for(0)


@lru_cache(maxsize=64)
def rotation(dim: int, k: int, seed: int = SEED) -> np.ndarray:
    """The k-th random rotation of dim dimensions, the same on every machine up to the last digits."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, k]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def sign_tables(unit: np.ndarray, tables: int = TABLES, bits: int = BITS) -> np.ndarray:
    """(n, tables) keys of `bits` signs each, from as many rotations as it takes."""
    dim, need = unit.shape[1], tables * bits
    signs = np.concatenate([unit @ rotation(dim, 1 + k).T > 0 for k in range(-(-need // dim))], axis=1)[:, :need]
    return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def links_within(ids: np.ndarray, mult: np.ndarray, unit: np.ndarray, earlier: np.ndarray, side: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted links of each vector in one tile, and a tree of links for each class of them.

    side: 0 or 1; where both occur, only pairs across count. earlier: (n, t) keys of the tables before
    this one; a pair that shares one is counted there, but may be in the tree.
    """
    n, dim = unit.shape
    rotated = unit @ rotation(dim, 0).T
    codes = np.where(rotated >= 0, 1.0, -1.0) / np.sqrt(dim)
    factor = np.einsum("ij,ij->i", codes, rotated)
    estimate = codes.astype(np.float32) @ rotated.T.astype(np.float32) / factor[:, None].astype(np.float32)
    bound = EPSILON * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, dim - 1))
    likely = estimate + bound[:, None].astype(np.float32) >= cosine
    across = side.min() != side.max()
    likely &= (side[:, None] < side[None, :]) if across else np.triu(np.ones((n, n), bool), 1)
    a, b = np.nonzero(likely)
    exact = np.concatenate([np.einsum("ij,ij->i", unit[a[k : k + 65536]], unit[b[k : k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0)])
    a, b = a[exact >= cosine], b[exact >= cosine]
    fresh = np.concatenate([~(earlier[a[k : k + 65536]] == earlier[b[k : k + 65536]]).any(axis=1) for k in range(0, len(a), 65536)] or [np.zeros(0, bool)])
    counts = np.bincount(a[fresh], mult[b[fresh]], n) + np.bincount(b[fresh], mult[a[fresh]], n)
    parent = np.arange(n)
    tree = []
    if len(a):
        while True:  # labels fall to the least position among neighbours until nothing changes
            low = np.minimum(parent[a], parent[b])
            new = parent.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == parent).all():
                break
            parent = new
        tree = [(int(ids[i]), int(ids[p])) for i, p in enumerate(parent.tolist()) if i != p]
    return counts.astype(np.int64), tree


def _valid(vector):
    v = F.col(vector)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def units(vectors: np.ndarray) -> np.ndarray:
    out = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of very large or small ones stay finite
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _packed(v: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        short = v.astype("<f4")
    return (short if (short == v).all() else v.astype("<f8")).tobytes()


def _unpacked(data: list[bytes], dim: int) -> np.ndarray:
    kind = {4 * dim: "<f4", 8 * dim: "<f8"}
    if len({*map(len, data)}) == 1:
        return np.frombuffer(b"".join(data), kind[len(data[0])]).astype(np.float64).reshape(len(data), dim)
    return np.array([np.frombuffer(d, kind[len(d)]) for d in data], np.float64)


def _width(bits: int) -> int:
    """Bytes of a table's key."""
    return 2 if bits <= 16 else 4


def _keyed(reps: DataFrame, tables: int, bits: int) -> DataFrame:
    """(rep, label, mult, dim, keys, vec): all tables' keys and the vector, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for dim, part in rows.groupby(rows["vector"].map(len)):
                vec = np.array(part["vector"].tolist(), np.float64).reshape(len(part), dim)
                flat = sign_tables(units(vec), tables, bits).astype(f"<u{_width(bits)}")
                yield pd.DataFrame({"rep": part["rep"], "label": part["label"], "mult": part["mult"], "dim": dim, "keys": [k.tobytes() for k in flat], "vec": [_packed(v) for v in vec]})

    return reps.mapInPandas(run, "rep long, label long, mult long, dim int, keys binary, vec binary")


def _tables(keyed: DataFrame, tables: int, bits: int) -> DataFrame:
    """(rep, label, dim, t, key) from the packed keys; key: the table's bytes."""
    w = _width(bits)
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.substring(F.col("keys"), t * w + 1, w)))
    return keyed.select("rep", "label", "dim", at.alias("t", "key"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int | None = None, bits: int | None = None, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine reaches the threshold. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of
    different lengths. Equal vectors of a label link with each other; a repeated row is a vector of its
    own. A row without vec_id, or with one that is no whole number, counts as a link of others but names no
    component. tables, bits: those of tables_for unless given.
    """
    rows = vectors.select(F.col("vec_id").try_cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.withColumn("valid", F.coalesce(_valid("vector"), F.lit(False)))
    reps = rows.where("valid").groupBy("label", "vector").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("mult"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")  # numbers are settled once written
    if tables is None or bits is None:
        tables, bits = tables_for(reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0, cosine)
    keyed = written(_keyed(reps, tables, bits), "codes")
    at = _tables(keyed, tables, bits)
    sizes = at.groupBy("label", "dim", "t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = at.join(sizes, ["label", "dim", "t", "key"])
    # bucket cells: g chunks; a vector of chunk i goes to the tiles (i, j) and (j, i)
    g = F.ceil(F.col("n") / tile).cast("int")
    chunk = F.pmod(F.xxhash64("rep", F.lit(7)), g).cast("int")
    shared = shared.withColumn("g", g).withColumn("chunk", chunk)
    to = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    tiles = shared.select("rep", "t", "chunk", "label", "dim", "key", to.alias("other"))
    tiles = tiles.select("rep", "t", (F.col("chunk") > F.col("other")).cast("int").alias("side"), F.xxhash64("label", "dim", "t", "key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"))
    held = tiles.join(keyed.select("rep", "mult", "dim", "keys", "vec"), "rep")
    n = parts(vectors.sparkSession)
    held = held.repartition(n, "cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for part in batches:
            part = part if kept is None else pd.concat([kept, part], ignore_index=True)
            cell = part["cell"].to_numpy()
            cut = int(np.searchsorted(cell, cell[-1], "left"))  # the last cell may go on in the next batch
            kept = part[cut:]
            if cut:
                yield _cells(part[:cut], cosine, bits)
        if kept is not None:
            yield _cells(kept, cosine, bits)

    found = written(held.mapInPandas(run, "a long, b long, n long"), "found")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    linked = components(found.where("b IS NOT NULL"), "a", "b")
    classes = reps.select("rep", "least_id", "mult").join(linked, reps["rep"] == linked["node"], "left").select("rep", "least_id", "mult", F.coalesce("component_id", "rep").alias("c"))
    names = classes.groupBy("c").agg(F.min("least_id").alias("component_id"))
    named = classes.join(names, "c").join(counts, "rep", "left").select("rep", "component_id", (F.col("mult") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    member = rows.where("valid").join(reps.select("label", "vector", "rep"), ["label", "vector"]).select("vec_id", "rep")
    out = member.unionByName(rows.where("NOT valid").select("vec_id", F.lit(None).cast("long").alias("rep"))).join(named, "rep", "left")
    component = F.when(F.col("rep").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _cells(rows: pd.DataFrame, cosine: float, bits: int) -> pd.DataFrame:
    """Counts (a, null, n) and links (a, b, 0) of all cells of a sorted frame."""
    cell = rows["cell"].to_numpy()
    edge = np.flatnonzero(np.diff(cell)) + 1
    a, b, n = [], [], []
    for lo, hi in zip([0, *edge], [*edge, len(cell)], strict=True):
        if hi - lo < 2:
            continue
        part = rows[lo:hi]
        t = int(part["t"].iloc[0])
        ids = part["rep"].to_numpy()
        unit = units(_unpacked(list(part["vec"]), int(part["dim"].iloc[0])))
        keys = np.frombuffer(b"".join(part["keys"]), f"<u{_width(bits)}").reshape(hi - lo, -1)
        counts, tree = links_within(ids, part["mult"].to_numpy(), unit, keys[:, :t], part["side"].to_numpy(), cosine)
        for i in np.flatnonzero(counts).tolist():
            a.append(int(ids[i]))
            b.append(None)
            n.append(int(counts[i]))
        for x, y in tree:
            a.append(x)
            b.append(y)
            n.append(0)
    return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "n": pd.array(n, "Int64")})
