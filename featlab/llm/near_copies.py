"""Near copies: rows whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two sides. SimHash fingerprints of the sets that differ in at most two bits are found
by covering masks (`simhash`); no radius that can be covered reaches all pairs at 0.8, so candidates also
share one of BANDS buckets, each keyed by DEPTH min-hashes of the set: a pair at exactly 0.8 is missed by
these with probability (1 - 0.8**5)**20 = 0.035 %, more similar ones less. Each candidate is then checked
on the shingles themselves, so no link is below the limit.

A bucket's rows are first compared with three of its rows only. Buckets that these links leave in
several components are then compared in full, in tiles: a row is sent to the tiles of its bucket with
its shingles, a tile counts the shingles that rows outside its largest component share with all by a matrix product and returns a tree of links between
its components. So the components are those of all candidate pairs, but no table of pairs is made, no
task holds a whole bucket, and a bucket whose rows are alike is never compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.llm.common import LOWER, fresh, lean, parts, written
from featlab.llm.components import components
from featlab.llm.exact_dedup import marked
from featlab.llm.simhash import near_links

WORDS = 5
#: Least Jaccard similarity as a fraction, so that the limit is exact.
SIMILARITY = (4, 5)
BANDS, DEPTH = 20, 5
#: Tasks that share the rows of a component.
SALT = 32
#: Rows, and shingles of all rows, of one side of a tile; cells of a matrix at a time.
TILE, TILE_SHINGLES, _CELLS = 512, 1 << 19, 1 << 22
_CHUNK = 1 << 10
_MIX = np.random.default_rng(20).integers(0, 1 << 63, (2, BANDS * DEPTH), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct XXH64 of the runs of `words` words, sorted; a shorter text is one run, no words: none."""
    import xxhash

    flat = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split())
    if not flat:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(flat)]))
    n = max(1, len(starts) - words + 1)
    view, digest = memoryview(flat), xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(words, len(ends)) - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(view[a:b], 42) for a, b in spans), np.uint64, n))


def bands(own: np.ndarray) -> list[int]:
    """The set's bucket in each band, as signed longs."""
    import xxhash

    if not len(own):
        return []
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), _CHUNK):
        np.minimum(least, (own[k : k + _CHUNK, None] * _MIX[0] + _MIX[1]).min(0), out=least)
    digests = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, DEPTH))]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def fingerprint(own: np.ndarray) -> int:
    """The set's SimHash as a signed long: a bit is 1 if more than half the shingles have it; no shingles: 0."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(own), _CHUNK):
        total += np.unpackbits(own[k : k + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(own), bitorder="little").view("<i8")[0])


def _digest(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).view(np.int64))


def _signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, t, s, n, fp, keys), one row for each row of docs: digests of the text and of its set, the set's size, fingerprint and buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sets = [shingles(t, words) for t in rows["text"]]
            yield pd.DataFrame({"id": rows["id"], "t": rows["t"], "s": [_digest(x) for x in sets], "n": [len(x) for x in sets], "fp": [fingerprint(x) for x in sets], "keys": [bands(x) for x in sets]})

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text.alias("text")).withColumn("t", F.xxhash64("text"))
    return rows.mapInPandas(lean(run), "id string, t long, s long, n long, fp long, keys array<long>").withColumn("id", F.col("id").try_cast("long"))


def _sets(docs: DataFrame, text_col: str, words: int, needed: DataFrame) -> DataFrame:
    """(s, own): the shingles of each set that is needed. needed: (t), texts that hold them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in range(0, len(rows), 100):
                sets = [shingles(t, words) for t in rows["text"][k : k + 100]]
                yield pd.DataFrame({"s": [_digest(x) for x in sets], "own": [x.tobytes() for x in sets]})

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = marked(docs.select(text).withColumn("t", F.xxhash64("text")), F.col("t"), needed, "may").where("may").join(needed, "t", "left_semi")
    return rows.select("text").mapInPandas(lean(run), "s long, own binary").dropDuplicates(["s"])


def _checked(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keep = []
            for x, y in zip(rows["x"], rows["y"], strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(both * similarity[1] >= ((len(x) + len(y)) // 8 - both) * similarity[0])
            yield rows.loc[np.array(keep, bool), ["a", "b"]]

    left, right = sets.select(F.col("s").alias("a"), F.col("own").alias("x")), sets.select(F.col("s").alias("b"), F.col("own").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(lean(run), "a long, b long")


def common_shingles(some: list[np.ndarray], sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of some shares with each of the sets."""
    names = np.unique(np.concatenate(some))
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    held = names[at] == flat
    right = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[held], at[held]
    left = np.repeat(np.arange(len(some)), [len(x) for x in some]), np.searchsorted(names, np.concatenate(some))
    both, width = np.zeros((len(some), len(sets)), np.float32), min(max(1, len(names)), max(1, _CELLS // len(sets)))
    for k in range(0, len(names), width):
        x, y = np.zeros((len(some), width), np.float32), np.zeros((len(sets), width), np.float32)
        for out, (row, col) in ((x, left), (y, right)):
            here = (col >= k) & (col < k + width)
            out[row[here], col[here] - k] = 1
        both += x @ y.T
    return both


def links_between(ids: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """A tree of links that joins the components whose rows are similar enough."""
    names, c = np.unique(comp, return_inverse=True)
    if len(names) < 2:
        return []
    rest = np.flatnonzero(c != np.bincount(c).argmax())  # a link has an end outside the largest component
    n, both = np.array([len(x) for x in sets], np.float32), common_shingles([sets[i] for i in rest], sets)
    a, b = np.nonzero((both * similarity[1] >= (n[rest, None] + n[None, :] - both) * similarity[0]) & (c[rest, None] != c[None, :]))
    a = rest[a]
    parent, out = list(range(len(names))), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(int(c[i])), root(int(c[j]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _across(mixed: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """mixed: (key, s, n, c), buckets with several components c. (a, b) links that join components, by tiles."""
    size = mixed.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    g = F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("total") / TILE_SHINGLES)).cast("int")
    rows = mixed.join(size.select("key", g.alias("g")), "key").withColumn("chunk", F.pmod(F.xxhash64("s", F.lit(7)), "g").cast("int"))
    rows = rows.select("key", "s", "c", "chunk", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    rows = rows.select("s", "c", F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"))
    several = rows.groupBy("cell").agg(F.min("c").alias("p"), F.max("c").alias("q")).where("p <> q").select("cell")
    held = rows.join(several, "cell", "left_semi").join(sets, "s").repartition(parts(mixed.sparkSession), "cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[int, int, np.ndarray]] = []
        now = None

        def found() -> pd.DataFrame:
            links = links_between(np.array([s for s, _, _ in kept]), np.array([c for _, c, _ in kept]), [x for _, _, x in kept], similarity)
            return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

        for part in batches:
            for cell, s, c, own in zip(part["cell"], part["s"], part["c"], part["own"], strict=True):
                if cell != now and kept:
                    yield found()
                    kept = []
                now = cell
                kept.append((s, c, np.frombuffer(own, np.int64)))
        if kept:
            yield found()

    return held.select("cell", "s", "c", "own").mapInPandas(lean(run), "a long, b long").distinct()


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """nodes: (s, fp). (a, b) sets to check: each with the least set of its fingerprint, and the least sets of fingerprints within simhash.RADIUS bits."""
    least = written(nodes.groupBy("fp").agg(F.min("s").alias("c"), F.count("*").alias("m")), "fingerprints")
    same = nodes.join(least.where("m > 1"), "fp").where("s <> c").select(F.least("s", "c").alias("a"), F.greatest("s", "c").alias("b"))
    links = near_links(least.select("fp"))
    one, two = least.select(F.col("fp").alias("a"), F.col("c").alias("p")), least.select(F.col("fp").alias("b"), F.col("c").alias("q"))
    return same.unionByName(links.join(one, "a").join(two, "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(id, t, s) of each row of docs, t and s digests of its text and its set, and (s, c) of the sets that are not alone, c their component."""
    rows = written(_signatures(docs, id_col, text_col, words), "signatures")
    nodes = written(rows.groupBy("s").agg(F.min("t").alias("t"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("keys").alias("keys")), "nodes")
    spread = nodes.select("s", "n", F.explode("keys").alias("key"))
    centres = spread.groupBy("key").agg(F.count("*").alias("size"), F.min("s").alias("c0"), F.max("s").alias("c1"), F.min_by("s", F.xxhash64("s")).alias("c2")).where("size > 1")
    held = written(spread.join(centres, "key"), "buckets")
    ends = held.select("s", F.explode(F.array("c0", "c1", "c2")).alias("c")).where("s <> c").select(F.least("s", "c").alias("a"), F.greatest("s", "c").alias("b")).distinct()
    first = written(ends.unionByName(_by_fingerprint(nodes.where("n > 0"))).distinct(), "pairs")
    ends_too = first.select(F.explode(F.array("a", "b")).alias("s"))
    needed = nodes.join(held.select("s").unionByName(ends_too).distinct(), "s", "left_semi").select("t")
    sets = written(_sets(docs, text_col, words, needed), "sets")
    links = written(_checked(first, sets, similarity), "near-links")
    linked = written(components(links, "a", "b"), "near-stars")
    # What may still join two components: pairs of a bucket that were not checked, in different components.
    named = held.where("size > 2").join(linked.withColumnRenamed("node", "s"), "s", "left").select("key", "s", "n", F.coalesce("component_id", "s").alias("c"))
    named = written(named, "named")
    mixed = named.join(named.groupBy("key").agg(F.min("c").alias("p"), F.max("c").alias("q")).where("p <> q").select("key"), "key")
    more = written(_across(mixed, sets, similarity), "near-links")
    if not more.isEmpty():
        linked = components(links.unionByName(more), "a", "b")
    return rows.select("id", "t", "s"), written(linked.select(F.col("node").alias("s"), F.col("component_id").alias("c")), "classes")


def _with_least(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, t, first, least_id): each row, with the id and text digest of the row of its component that comes first: the least id, nulls last, then the least t."""
    member = rows.join(classes, "s", "left")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "t").alias("own")
    firsts = member.groupBy(F.coalesce("c", "s").alias("c"), F.col("c").isNotNull().alias("linked")).agg(F.min(own).alias("first"))
    alone = member.where("c IS NULL").join(firsts.where("NOT linked").select(F.col("c").alias("s"), "first"), "s")
    # a component can hold a third of all rows: its first row goes to SALT tasks
    salted = firsts.where("linked").select("c", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    joined = member.where("c IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("t", "id"), F.lit(SALT)).cast("int")).join(salted, ["c", "salt"])
    return alone.select("id", "t", "first").unionByName(joined.select("id", "t", "first"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(id_col, component_id), one row for each row of docs; component_id is the least id reachable, null if no row of the component has an id.

    Null and empty texts have no shingles and link with each other.
    """
    return _with_least(*_classes(docs, id_col, text_col, words, similarity)).select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs with the first row of each component: the least id, rows without one last, then the least digest of the text; of repeated
    rows one stays. All columns stay as they are."""
    rows = written(_with_least(*_classes(docs, id_col, text_col, words, similarity)), "first-rows")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t") == F.col("first.t"))
    keys = rows.groupBy("id", "t").agg(F.bool_or(stays).alias("stays"), F.count("*").alias("n"))
    key = F.xxhash64(F.col(id_col).try_cast("long"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    h, may = fresh("_h", docs), fresh("_may", docs)
    touched = written(keys.where("NOT stays OR n > 1").select(F.xxhash64("id", "t").alias(h), "stays"), "touched")  # all other rows stay as they are
    own = marked(docs.withColumn(h, key), F.col(h), touched.select(h), may)
    some = own.where(may)
    out = own.where(~F.col(may)).unionByName(some.join(touched, h, "left_anti"))
    again = touched.where("stays")
    if not again.isEmpty():
        out = out.unionByName(some.join(again, h, "left_semi").dropDuplicates([h]))
    return out.select(*docs.columns)
