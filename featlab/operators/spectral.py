"""Multi-cluster selection over all rows of a distributed matrix.

The eigenvectors of the neighbour graph come from a block of vectors that a Chebyshev filter drives towards the largest
eigenvalues. Rows are dealt to shares; a share's task holds its own edges and rows of the vectors, and gets of the other shares
the rows that its edges need, one share at a time. The driver sees sums of block by block numbers; least-angle regression needs
features by features, and features by vectors. No task holds all rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.operators import graphs, selectors, solvers
from featlab.operators.selectors import ranked

#: Rows up to which the dense form runs in a task; rows of a share at most; vectors beyond those wanted; products with the graph between
#: two rotations, and at most; the residual at which a vector counts as found.
DENSE, SHARE_ROWS, SPARE, DEGREE, MOST, TOL = 2047, 16384, 16, 10, 2000, 1e-6
_STATE = "share int, kind int, origin int, links binary, before binary, now binary"


def _start(ids: np.ndarray, m: int) -> np.ndarray:
    """Numbers from -0.5 to 0.5 that depend on the id and the place alone."""
    h = ids.view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 - 0.5


def _linked(src: np.ndarray, dst: np.ndarray, w: np.ndarray, to: np.ndarray) -> dict:
    """A share's rows, one over the root of their degree, and by other share: edges (row here, place there, weight) by row, and the rows here that it needs.

    Edges go both ways, so the rows here with an edge to a share are those that the share's edges need, in order of id on both sides.
    """
    ids, at = np.unique(src, return_inverse=True)
    edges, needed = {}, {}
    for b in np.unique(to):
        own = np.flatnonzero(to == b)
        own = own[np.argsort(at[own], kind="stable")]
        edges[int(b)] = at[own], np.unique(dst[own], return_inverse=True)[1], w[own]
        needed[int(b)] = np.unique(at[own])
    return {"ids": ids, "root": 1 / np.sqrt(np.maximum(np.bincount(at, w), 1e-12)), "edges": edges, "needed": needed}


def _rows(share: int, links: dict, packed: bytes, before: np.ndarray, now: np.ndarray, sums: list | None = None) -> pd.DataFrame:
    """What a share hands on: itself, the rows that others need, and sums for the driver."""
    out = [(share, 0, share, packed, before.tobytes(), now.tobytes())]
    scaled = links["root"][:, None] * now
    out += [(b, 1, share, None, None, scaled[rows].tobytes()) for b, rows in links["needed"].items()]
    if sums is not None:
        out.append((share, 2, share, None, None, np.concatenate([s.ravel() for s in sums]).tobytes()))
    return pd.DataFrame(out, columns=["share", "kind", "origin", "links", "before", "now"])


def _began(edges: DataFrame, shares: int, m: int) -> DataFrame:
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(shares)).cast("int")
    dealt = edges.select(share("src").alias("share"), share("dst").alias("to"), "src", "dst", "w").repartition(shares, "share").sortWithinPartitions("share", "src", "dst")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for part in batches:
            for share, own in part.groupby("share"):
                held.setdefault(int(share), []).append([own[c].to_numpy() for c in ("src", "dst", "w", "to")])
        for share, some in held.items():
            links = _linked(*(np.concatenate([s[c] for s in some]) for c in range(4)))
            v = _start(links["ids"], m)
            yield _rows(share, links, pickle.dumps(links), v, v)

    return dealt.mapInPandas(run, _STATE)


def _stepped(state: DataFrame, shares: int, m: int, kind: str, turn: np.ndarray | None = None, middle: float = 0.0, half: float = 1.0) -> DataFrame:
    """The state after a product with the graph. kind: "measure" leaves (v, graph v) and sums; "turned" goes on from there with the vectors v turn
    to the second Chebyshev polynomial, "filter" to the next one; middle and half: the interval that is damped."""

    def ended(share: int, links: dict, packed: bytes, before: np.ndarray, now: np.ndarray, product: np.ndarray) -> pd.DataFrame:
        product *= links["root"][:, None]
        if kind == "measure":
            return _rows(share, links, packed, now, product, [now.T @ now, now.T @ product, product.T @ product])
        if kind == "turned":
            v, first, second = before @ turn, now @ turn, product @ turn
            one = (first - middle * v) / half
            return _rows(share, links, packed, one, 2 * ((second - middle * first) / half - middle * one) / half - v)
        return _rows(share, links, packed, now, 2 * (product - middle * now) / half - before)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in batches:
            for share, which, origin, packed, before, now in part.itertuples(index=False, name=None):
                if which == 0:
                    if held is not None:
                        yield ended(*held)
                    links = pickle.loads(packed)
                    v = [np.frombuffer(x, float).reshape(-1, m) for x in (before, now)]
                    held = share, links, packed, *v, np.zeros_like(v[1])
                else:
                    row, place, w = held[1]["edges"][origin]
                    x = w[:, None] * np.frombuffer(now, float).reshape(-1, m)[place]
                    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    held[5][row[first]] += np.add.reduceat(x, first)
        if held is not None:
            yield ended(*held)

    return state.where("kind < 2").repartition(shares, "share").sortWithinPartitions("share", "kind", "origin").mapInPandas(run, _STATE)


def _turn(sums: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rotation to Ritz vectors, their values from the largest, and the residuals."""
    g, h, k = sums.reshape(3, m, m)
    d = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    e, q = np.linalg.eigh(d[:, None] * (g + g.T) / 2 * d)
    kept = e > 1e-11 * e[-1]
    basis = d[:, None] * q[:, kept] / np.sqrt(e[kept])
    value, r = np.linalg.eigh(basis.T @ (h + h.T) / 2 @ basis)
    turn, value = (basis @ r)[:, ::-1], value[::-1]
    return turn, value, np.sqrt(np.maximum(0, np.einsum("ij,ik,kj->j", turn, k, turn) - value**2))


def leading_vectors(edges: DataFrame, n: int, wanted: int) -> DataFrame:
    """(id, y): of the graph's matrix, divided by the roots of both degrees, the eigenvectors from the second largest eigenvalue on, wanted of them in ascending
    order of the eigenvalues, divided by the roots of the degrees. edges: (src, dst, w), both directions of each, read once."""
    m = min(n, wanted + 1 + SPARE)
    spark = edges.sparkSession
    shares = max(1, -(-n // SHARE_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // DENSE)))
    state = _began(edges, shares, m).localCheckpoint()
    products = 0

    def went(kind: str, *options) -> None:
        nonlocal state, products
        state, old = _stepped(state, shares, m, kind, *options).localCheckpoint(), state
        old.unpersist()
        products += 1

    while True:
        went("measure")
        total = sum(np.frombuffer(r["now"], float) for r in state.where("kind = 2").orderBy("share").select("now").collect())  # 3 m x m numbers a share
        turn, value, residual = _turn(total, m)
        if residual[: wanted + 1].max() <= TOL or len(value) == n:
            break
        if products >= MOST:
            raise RuntimeError(f"the graph's eigenvectors have residuals of {residual[: wanted + 1].max()} after {products} products")
        spark.sparkContext._jvm.System.gc()  # lets Spark remove the shuffle files of products that are over
        cut = min(value[-1], 1 - 1e-6)
        middle, half = (cut - 1) / 2, (cut + 1) / 2
        went("turned", turn, middle, half)
        m = turn.shape[1]
        for _ in range(DEGREE - 2):
            went("filter", None, middle, half)
    last = turn[:, 1 : wanted + 1][:, ::-1]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for packed, before in zip(part["links"], part["before"], strict=True):
                links = pickle.loads(packed)
                yield pd.DataFrame({"id": links["ids"], "y": list(links["root"][:, None] * (np.frombuffer(before, float).reshape(len(links["ids"]), -1) @ last))})

    return state.where("kind = 0").select("links", "before").mapInPandas(read, "id long, y array<double>")


def multi_cluster(wide: DataFrame, k: int) -> DataFrame:
    """(rank, j, score): as selectors.multi_cluster, on all rows; the same form where there are few."""
    n, classes = wide.agg(F.count("*"), F.count_distinct("label")).first()
    if n <= DENSE:
        return selectors.select(wide, selectors.multi_cluster, k)
    p = len(wide.select("features").first()["features"])
    edges = graphs.affinity(wide, classes, "knn", "heat_kernel", t=float(p)).persist(StorageLevel.DISK_ONLY)
    try:
        vectors = leading_vectors(edges, n, classes)
    finally:
        edges.unpersist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for part in batches:
            if len(part):
                x, y = (np.array(part[c].tolist(), float) for c in ("features", "y"))
                total = total + x.T @ np.concatenate((x, y), axis=1)
        if not np.isscalar(total):
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    sums = wide.select("id", "features").join(vectors, "id").mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy().reshape(p, -1)
    return solvers._frame(wide, *ranked(selectors.cluster_weights(sums[:, :p], sums[:, p:], n, k).max(1), k))
