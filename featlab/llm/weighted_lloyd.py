"""Lloyd's clustering of quantised vectors by weighted deduplication.

Each component x of a vector becomes the integer floor(scale * x). Identical quantised vectors are grouped
with their multiplicities once; all rounds run over the distinct ones, and a vector that stands for n rows
adds n times itself to the sums of its cluster. Distances and sums are exact integers: a task's sums leave
it cut into digits of 32 bits, the digits are added by an aggregation, and the driver puts together the
k x dim sums and divides. At the end the assignment of each distinct vector is joined back to the rows by a
digest of the quantised vector, so a row travels as its id and 32 bytes, and a third of all rows with one
vector is one row in all rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.llm.common import written

CLUSTERS, ROUNDS, DIM, SCALE, SALT = 40, 5, 64, 256, "2"
#: Up to this size of components all numbers of a distance are whole and below 2**53, so products of float matrices are exact.
EXACT = 1 << 22
LONGEST = (1 << 63) - 1


def quantised(vector, dim: int = DIM, scale: int = SCALE):
    """floor(scale * x) of each component, as doubles without a fraction; null where the vector isn't kept."""
    v = F.transform(vector, lambda x: x.cast("double") * scale)
    usable = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    return F.when(usable, whole)


def nearest(q: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row, the smaller one of equals, and the exact squared distance."""
    most = max(max(map(abs, c)) for c in centroids)
    small = (np.abs(q).max(axis=1, initial=0) <= EXACT) & (most <= EXACT)
    at, distance = np.zeros(len(q), np.int64), np.zeros(len(q), object)
    if small.any():
        c, x = np.array(centroids, float), q[small]
        d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T)
        at[small] = d.argmin(1)
        distance[small] = [int(v) for v in d.min(1)]
    for i in np.flatnonzero(~small):
        x = [int(v) for v in q[i]]
        all_ = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids]
        distance[i] = min(all_)
        at[i] = all_.index(distance[i])
    return at, distance


def digits(value: int) -> list[int]:
    """Of base 2**32, the least first; the last one has the sign."""
    out = []
    while not -(1 << 31) <= value < 1 << 31:
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return [*out, value]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    q = batch.column("q")
    return q.flatten().to_numpy(zero_copy_only=False).reshape(len(q), -1)


def weighted_sums(distinct: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(cluster, j, digit, v): digits of the sum of n times component j over a cluster; j = -1: of n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not len(batch):
                continue
            q, n = _matrix(batch), batch.column("n").to_numpy()
            at, _ = nearest(q, centroids)
            for c in np.unique(at):
                own, weight = q[at == c], n[at == c]
                if np.abs(own).max() * float(weight.sum()) < 2.0**53:
                    total = [int(v) for v in weight.astype(float) @ own]
                else:
                    total = [sum(int(w) * int(v) for w, v in zip(weight, column, strict=True)) for column in own.T]
                for j, v in enumerate([int(weight.sum()), *total], -1):
                    sums[int(c), j] = sums.get((int(c), j), 0) + v
        rows = [(c, j, k, v) for (c, j), s in sums.items() for k, v in enumerate(digits(s))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "j", "digit", "v"])

    parts = distinct.mapInArrow(run, "cluster int, j int, digit int, v long")
    return parts.groupBy("cluster", "j", "digit").agg(F.sum("v").alias("v"))


def moved(sums: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid as the floor of its rows' mean; empty ones stay. sums has clusters x (components + 1) numbers of a few digits."""
    whole: dict[tuple[int, int], int] = {}
    for r in sums.collect():
        whole[r["cluster"], r["j"]] = whole.get((r["cluster"], r["j"]), 0) + (r["v"] << 32 * r["digit"])
    return [[whole[k, j] // whole[k, -1] for j in range(len(c))] if whole.get((k, -1)) else c for k, c in enumerate(centroids)]


def assigned(distinct: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(digest, n, cluster, distance); distances beyond a long are the largest long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at, distance = nearest(_matrix(batch), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n"), pa.array(at, pa.int32()), pa.array([min(d, LONGEST) for d in distance], pa.int64())], ["digest", "n", "cluster", "distance"])

    return distinct.mapInArrow(run, "digest binary, n long, cluster int, distance long")


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT, seen: Callable[[list[list[int]]], None] | None = None) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each row whose vector is kept.

    Kept are vectors with dim components, none of them null, not finite, or so large that scale times it
    isn't finite. The k kept rows with the least sha256 of `salt:id` start as centroids, in that order (of
    repeated ids the lesser vector first); rows without an id are clustered but start none. Fewer than k
    rows with an id give fewer centroids; without any the result is empty. `seen` is given the centroids
    after each round. Ids that are no whole number count as null. Distances and inertias beyond a long are
    the largest long.
    """
    spark = vectors.sparkSession
    q = vectors.select(F.col(id_col).try_cast("long").alias("id"), quantised(F.col(vector_col), dim, scale).alias("q")).where("q IS NOT NULL")
    keyed = q.withColumn("digest", F.unhex(F.sha2(F.concat_ws(",", F.col("q").cast("array<string>")), 256)))
    distinct = written(keyed.groupBy("digest").agg(F.first("q").alias("q"), F.count("*").alias("n")), "distinct")
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = q.where("id IS NOT NULL").orderBy(order, "q").limit(k).collect()
    centroids = [[int(v) for v in r["q"]] for r in first]
    schema = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = moved(weighted_sums(distinct, centroids), centroids)
        if seen:
            seen(centroids)
    of = written(assigned(distinct, centroids), "assigned")
    per = of.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")).alias("s"))
    per = {r["cluster"]: int(r["s"]) for r in per.collect()}  # k rows at most
    total = min(sum(per.values()), LONGEST)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(c, min(s, LONGEST), sha[c]) for c, s in per.items()], "cluster int, cluster_inertia long, centroid_sha256 string")
    out = keyed.select("id", "digest").join(of.select("digest", "cluster", "distance"), "digest").join(F.broadcast(about), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
