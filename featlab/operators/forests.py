"""Trees grown over all rows of a distributed matrix, level by level from histograms.

Features are cut into bins once, at approximate quantiles; a row travels as its id, label and one byte a
feature. Growing a level is one job for all trees of a forest (more where their histograms have over
HISTOGRAM numbers): each task sends its rows down the trees so far and adds them to histograms over (open
node, candidate feature, bin, class), the histograms of a tree are added up in one place, and only the
chosen splits come back. The driver and a task hold trees and histograms, whose size depends on features,
bins, classes and nodes, never on rows. Nothing is sampled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.operators import learn

BINS = 64
#: Numbers of all histograms of one job at most, but for one tree's.
HISTOGRAM = 1 << 22
#: Numbers of a matrix in a task.
TASK = 1 << 24


@dataclass
class Binned:
    """rows: (id, y, b), y the place of the label among labels, b one byte a feature: how many of its edges are below the value. blocks: the same, packed (ids, y, b); tasks: their partitions."""

    rows: DataFrame
    blocks: RDD
    tasks: int
    edges: list[np.ndarray]
    labels: list[int]

    @property
    def p(self) -> int:
        return len(self.edges)


def bin_edges(wide: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """The distinct values at `bins` quantiles of each feature, but the largest: P x bins numbers. A value is in the bin of the first edge that isn't below it."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins + 1)])
    cells = wide.select(F.posexplode("features").alias("j", "x")).where("x IS NOT NULL AND NOT isnan(x)")
    rows = cells.groupBy("j").agg(F.percentile_approx("x", shares, 100 * bins).alias("q")).collect()
    found = {r["j"]: np.unique(r["q"])[:-1] for r in rows}
    return [found.get(j, np.zeros(0)) for j in range(max(found, default=-1) + 1)]


def in_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


@contextmanager
def binned(wide: DataFrame, bins: int = BINS) -> Iterator[Binned]:
    """wide (id, label, features) in bins; kept in memory or on disk until the block ends. Rows without a label are left out."""
    wide = wide.where("label IS NOT NULL")
    sizes = {r["label"]: r["count"] for r in wide.groupBy("label").count().collect()}  # a row for each class
    labels, edges = sorted(sizes), bin_edges(wide, bins)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                b = in_bins(np.array(part["features"].tolist(), float), edges)
                yield pd.DataFrame({"id": part["id"], "y": np.searchsorted(labels, part["label"]).astype(np.int32), "b": [v.tobytes() for v in b]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in run(batches):
            yield pd.DataFrame({"id": [part["id"].to_numpy(np.int64).tobytes()], "y": [part["y"].to_numpy().tobytes()], "b": [b"".join(part["b"])]})

    def block(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(bytes(r["id"]), np.int64)
        return ids, np.frombuffer(bytes(r["y"]), np.int32), np.frombuffer(bytes(r["b"]), np.uint8).reshape(len(ids), len(edges))

    cells = wide.select(F.coalesce("id", F.lit(0).cast("long")).alias("id"), "label", "features")
    rows = cells.mapInPandas(run, "id long, y int, b binary").persist()
    tasks = max(wide.sparkSession.sparkContext.defaultParallelism, -(-sum(sizes.values()) * len(edges) // TASK))
    blocks = cells.repartition(tasks).mapInPandas(pack, "id binary, y binary, b binary").rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield Binned(rows, blocks, tasks, edges, labels)
    finally:
        rows.unpersist()
        blocks.unpersist()


@dataclass
class Grown:
    """A tree over bins; number counts nodes as a heap does, so a node's draws don't depend on the others. sums: of its rows' statistics."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    number: list[int] = field(default_factory=list)
    sums: list[np.ndarray | None] = field(default_factory=list)
    gain: dict[int, float] = field(default_factory=dict)

    def add(self, number: int, sums: np.ndarray | None) -> int:
        for column, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.number, number), (self.sums, sums)):
            column.append(v)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(v) for v in (self.feature, self.cut, self.left, self.right))

    def leaves(self, b: np.ndarray) -> np.ndarray:
        return walked(self.arrays(), b)

    def importance(self, p: int) -> np.ndarray:
        """Each feature's share of the impurity that the splits take away."""
        out = np.zeros(p)
        for j, g in self.gain.items():
            out[j] = g
        return out / out.sum() if out.sum() > 0 else out

    def tree(self, edges: list[np.ndarray], value: Callable[[np.ndarray], np.ndarray], weight: Callable[[np.ndarray], float]) -> learn.Tree:
        """The same over values: a cut at a bin is a limit at its edge."""
        limit = [float(edges[j][c]) if j >= 0 else 0.0 for j, c in zip(self.feature, self.cut, strict=True)]
        return learn.Tree(list(self.feature), limit, list(self.left), list(self.right), [value(s) for s in self.sums], [weight(s) for s in self.sums], self.importance(len(edges)))


def walked(tree: tuple[np.ndarray, ...], b: np.ndarray) -> np.ndarray:
    """The leaf of each row in (feature, cut, left, right)."""
    f, cut, lo, hi = tree
    at = np.zeros(len(b), np.int64)
    while True:
        rows = np.flatnonzero(f[at] >= 0)
        if not len(rows):
            return at
        k = at[rows]
        at[rows] = np.where(b[rows, f[k]] <= cut[k], lo[k], hi[k])


def _gini(s: np.ndarray) -> np.ndarray:
    w = s.sum(-1)
    return w - (s * s).sum(-1) / np.maximum(w, 1e-300)


def _squares(s: np.ndarray) -> np.ndarray:
    """Of (sum of targets, anything, rows): the sum of squares around the mean, but for a constant of the parent."""
    return -s[..., 0] ** 2 / np.maximum(s[..., -1], 1e-300)


IMPURITY = {"gini": _gini, "squares": _squares}
SIZE = {"gini": lambda s: s.sum(-1), "squares": lambda s: s[..., -1]}


def draws(seed: int, tree: int, number: int, p: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """A node's m candidate features, and a number below 1 for each."""
    rng = np.random.default_rng([seed, tree, number])
    return rng.permutation(p)[:m], rng.random(m)


def best_cut(h: np.ndarray, kind: str, u: np.ndarray | None) -> tuple[int, int, float, np.ndarray, np.ndarray] | None:
    """h: (candidates, bins, statistics) of one node. (candidate, cut, gain, sums left, sums right) of the split with the greatest gain, the
    first of equals, or None without one. u: each candidate has one cut only, at that share of the way from its first to its last bin with rows."""
    impurity, size = IMPURITY[kind], SIZE[kind]
    left = h.cumsum(1)
    own = left[:, -1:]
    right = own - left
    gain = impurity(own) - impurity(left) - impurity(right)
    gain[(size(left) <= 1e-9) | (size(right) <= 1e-9)] = -np.inf
    if u is not None:
        some = size(h) > 1e-9
        lo, hi = some.argmax(1), h.shape[1] - 1 - some[:, ::-1].argmax(1)
        only = np.zeros(gain.shape, bool)
        only[np.arange(len(h)), lo + np.floor(u * (hi - lo)).astype(int)] = True
        gain[~only] = -np.inf
    at = int(gain.argmax())
    i, c = np.unravel_index(at, gain.shape)
    if not gain[i, c] > 1e-12 * max(1.0, float(size(own[i, 0]))):
        return None
    return int(i), int(c), float(gain[i, c]), left[i, c], right[i, c]


#: Statistics of some rows for a tree: (tree, ids, labels, bins) to (rows, statistics).
Statistics = Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _splits(data: Binned, work: dict[int, tuple[Grown, list[int], np.ndarray]], statistics: Statistics, width: int, kind: str, seed: int, extra: bool) -> list:
    """work: by tree, the tree, its open nodes and their candidates (open nodes, candidates). A row for each open node: (tree, node, feature or -1, cut, gain, left, right, own)."""
    p, bins = data.p, max((len(e) for e in data.edges), default=0) + 1

    def add(blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, tuple[bytes, bytes]]]:
        total: dict[int, np.ndarray] = {}
        for ids, y, b in blocks:
            for t, (tree, open_, candidates) in work.items():
                place = np.full(len(tree.feature), -1)
                place[open_] = np.arange(len(open_))
                at = place[tree.leaves(b)]
                rows = np.flatnonzero(at >= 0)
                m, at = candidates.shape[1], at[rows]
                s = statistics(t, ids[rows], y[rows], b[rows])
                cell = ((at[:, None] * m + np.arange(m)) * bins + b[rows[:, None], candidates[at]]).ravel()
                size = len(open_) * m * bins
                if kind == "gini":  # a row counts for its own class only
                    own = np.bincount(cell * width + np.repeat(y[rows], m), np.repeat(s[np.arange(len(rows)), y[rows]], m), size * width).reshape(size, width)
                else:
                    own = np.stack([np.bincount(cell, np.repeat(s[:, c], m), size) for c in range(width)], axis=1)
                total[t] = total[t] + own if t in total else own
        for t, h in total.items():
            at = np.flatnonzero(h)
            yield t, (at.astype(np.int32).tobytes(), h.ravel()[at].tobytes()) if 2 * len(at) < h.size < 1 << 31 else (b"", h.tobytes())

    def chosen(t: int, some: list[tuple[bytes, bytes]]) -> list[tuple]:
        tree, open_, candidates = work[t]
        # sorted, so that the sums don't depend on the order in which the tasks end
        h = np.zeros(len(open_) * candidates.shape[1] * bins * width)
        for at, v in sorted(some):  # places and numbers where most are zero, else all numbers
            if v:  # a task may have no row in the open nodes
                h[np.frombuffer(at, np.int32) if at else slice(None)] += np.frombuffer(v)
        h = h.reshape(len(open_), candidates.shape[1], bins, width)
        out = []
        for k, node in enumerate(open_):
            own = h[k, 0].sum(0)
            u = draws(seed, t, tree.number[node], p, candidates.shape[1])[1] if extra else None
            found = best_cut(h[k], kind, u)
            i, cut, gain, left, right = found or (0, 0, 0.0, own, own)
            out.append((t, node, int(candidates[k, i]) if found else -1, cut, gain, left.tolist(), right.tolist(), own.tolist()))
        return out

    parts = data.blocks.mapPartitions(add)
    if data.tasks * sum(c.size for _, _, c in work.values()) * bins * width <= HISTOGRAM:  # all tasks' histograms together are small: a shuffle less
        some = defaultdict(list)
        for t, h in parts.collect():
            some[t].append(h)
        return [row for t, h in some.items() for row in chosen(t, h)]

    return parts.groupByKey(min(len(work), 4 * data.tasks)).flatMap(lambda own: chosen(own[0], list(own[1]))).collect()


def grow(data: Binned, trees: list[int], statistics: Statistics, width: int, depth: int, kind: str = "gini", seed: int = 0, features: int | None = None, extra: bool = False) -> dict[int, Grown]:
    """The trees of some numbers. features: candidates at a node, drawn by (seed, tree, node), all of them if None; extra: one random cut for each."""
    p = data.p
    m = min(p, features or p)
    bins = max((len(e) for e in data.edges), default=0) + 1
    out = {t: Grown() for t in trees}
    open_ = {t: [g.add(0, None)] for t, g in out.items()}
    for _ in range(depth if p else 0):
        left = [t for t in trees if open_[t]]
        while left:
            work, numbers = {}, 0
            while left and (not work or numbers + len(open_[left[0]]) * m * bins * width <= HISTOGRAM):
                t = left.pop(0)
                numbers += len(open_[t]) * m * bins * width
                g = out[t]
                candidates = np.stack([draws(seed, t, g.number[n], p, m)[0] if m < p or extra else np.arange(p) for n in open_[t]])
                work[t] = (g, open_[t], candidates)
            rows = sorted(_splits(data, work, statistics, width, kind, seed, extra), key=lambda r: r[:2])
            for t in work:
                open_[t] = []
            for t, node, feature, cut, gain, low, high, own in rows:
                g = out[t]
                g.sums[node] = np.array(own)
                if feature >= 0:
                    g.feature[node], g.cut[node] = feature, cut
                    g.gain[feature] = g.gain.get(feature, 0.0) + gain
                    a, b = np.array(low), np.array(high)
                    g.left[node] = g.add(2 * g.number[node] + 1, a)
                    g.right[node] = g.add(2 * g.number[node] + 2, b)
                    open_[t] += [n for n, s in ((g.left[node], a), (g.right[node], b)) if kind != "gini" or np.count_nonzero(s > 1e-9) > 1]
    return out


def _hashed(ids: np.ndarray, *more: int) -> np.ndarray:
    """A number below 1 for each id."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64)
        for v in (*more, 0x5851):
            h = (h ^ np.uint64(v)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)) / float(1 << 53)


#: Shares of rows that a sample with replacement holds at most 0, 1, 2, ... times.
_TIMES = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 16)]))


def class_counts(classes: int, bootstrap: bool, seed: int) -> Statistics:
    """One for a row's class; with bootstrap as often as the row is drawn for the tree, by a hash of id, tree and seed."""

    def of(tree: int, ids: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(y), classes))
        out[np.arange(len(y)), y] = np.searchsorted(_TIMES, _hashed(ids, tree, seed), "right") if bootstrap else 1.0
        return out

    return of


def _share(s: np.ndarray | None) -> np.ndarray:
    return s / max(s.sum(), 1e-300)


def forest(data: Binned, trees: int = 200, depth: int = 3, extra: bool = True, seed: int = 0, features: int | None = None) -> list[learn.Tree]:
    """Extra trees (random cuts, all rows) or a random forest (rows drawn with replacement, the best of all cuts), as trees over values.

    features: candidates at a node, by default the root of their number. A node of whose candidates none splits it is a leaf.
    """
    classes = len(data.labels)
    m = features or max(1, int(np.sqrt(data.p)))
    grown = grow(data, list(range(trees)), class_counts(classes, not extra, seed), classes, depth, "gini", seed, m, extra)
    return [g.tree(data.edges, _share, lambda s: float(s.sum())) for g in grown.values() if g.sums[0] is not None]


@dataclass
class Members:
    """Boosted trees, each as arrays with its nodes' guesses, with their weights, and the logarithm of what their rounds' weights were divided by."""

    grown: list[tuple[tuple[np.ndarray, ...], np.ndarray]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    shift: float = 0.0


def ada_boost(data: Binned, n: int = 100, rate: float = 5.0, depth: int = 5, seed: int = 0) -> tuple[list[tuple[float, learn.Tree]], np.ndarray]:
    """(members, importance). Each tree is grown on rows weighted by the errors of those before it, a member's weight is rate (log odds of its
    accuracy + log(classes - 1)). Ends with n members, one without errors, or one that is no better than a guess. A tree's error comes from
    its leaves' sums, so a round is `depth` jobs. A member's part in a row's weight is at most exp(500)."""
    classes, held = len(data.labels), Members()

    def weighted(tree: int, ids: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
        log = np.full(len(y), -held.shift)
        for (g, guess), a in zip(held.grown, held.weights, strict=True):
            log += np.minimum(a * (guess[walked(g, b)] != y), 500)
        out = np.zeros((len(y), classes))
        out[np.arange(len(y)), y] = np.exp(np.minimum(log, 700))
        return out

    members = []
    for k in range(n):
        g = grow(data, [k], weighted, classes, depth, "gini", seed)[k]
        if g.sums[0] is None:
            break
        leaves = [s for s, f in zip(g.sums, g.feature, strict=True) if f < 0]
        total = sum(float(s.sum()) for s in leaves)
        e = sum(float(s.sum() - s.max()) for s in leaves) / total if total > 0 else 0.0
        tree = g.tree(data.edges, _share, lambda s: float(s.sum()))
        if e <= 1e-12:
            members.append((1.0, tree))
            break
        if e >= 1 - 1 / classes:
            break
        a = rate * (np.log((1 - e) / e) + np.log(max(classes - 1, 1)))
        members.append((float(a), tree))
        held.grown.append((g.arrays(), np.array([int(s.argmax()) for s in g.sums])))
        held.weights.append(float(a))
        held.shift += float(np.log(total) + np.logaddexp(np.log(1 - e), np.log(e) + min(a, 500)))
        if not np.isfinite(held.shift):
            break
    whole = sum(a for a, _ in members) or 1.0
    return members, sum((a * t.gain for a, t in members), np.zeros(data.p)) / whole


def boosting(data: Binned, n: int = 100, rate: float = 0.1, depth: int = 3, seed: int = 0) -> list[learn.Tree]:
    """Gradient boosting of the logistic loss, two classes: trees on the gradient, a leaf's value is rate times a Newton step."""
    grown: list[Grown] = []
    n_rows, ones = data.rows.agg(F.count("*"), F.sum(F.col("y"))).first()
    p = min(max((ones or 0) / max(1, n_rows), 1e-6), 1 - 1e-6)
    start = float(np.log(p / (1 - p)))
    step = lambda s: np.array([rate * s[0] / max(s[1], 1e-9)])

    def gradients(tree: int, ids: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
        f = np.full(len(y), start)
        for g in grown:
            f += np.array([step(s)[0] for s in g.sums])[g.leaves(b)]
        q = 1 / (1 + np.exp(-f))
        return np.stack((y - q, q * (1 - q), np.ones(len(y))), axis=1)

    for k in range(n):
        g = grow(data, [k], gradients, 3, depth, "squares", seed)[k]
        if g.sums[0] is None:
            break
        grown.append(g)
    return [g.tree(data.edges, step, lambda s: float(s[2])) for g in grown]


def importances(wide: DataFrame, trees: int = 200, depth: int = 3, extra: bool = True, seed: int = 0, bins: int = BINS) -> DataFrame:
    """(j, score): each feature's mean share of the impurity that a forest's splits take away."""
    with binned(wide, bins) as data:
        grown = forest(data, trees, depth, extra, seed)
        score = np.mean([t.gain for t in grown], axis=0) if grown else np.zeros(data.p)
    return wide.sparkSession.createDataFrame([(j, float(s)) for j, s in enumerate(score)], "j int, score double")


def boosted_importances(wide: DataFrame, n: int = 100, rate: float = 5.0, depth: int = 5, seed: int = 0, bins: int = BINS) -> DataFrame:
    """(j, score) of ada_boost."""
    with binned(wide, bins) as data:
        score = ada_boost(data, n, rate, depth, seed)[1]
    return wide.sparkSession.createDataFrame([(j, float(s)) for j, s in enumerate(score)], "j int, score double")


def probabilities(rows: DataFrame, trees: list[learn.Tree]) -> DataFrame:
    """(id, label, p array) of (id, label, features): the trees travel, not the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                x = np.array(part["features"].tolist(), float)
                yield pd.DataFrame({"id": part["id"], "label": part["label"], "p": list(np.mean([t.predict(x) for t in trees], axis=0))})

    return rows.select("id", "label", "features").mapInPandas(run, "id long, label int, p array<double>")


# --- explanations ---


def shap_importance(wide: DataFrame, trees: list[learn.Tree], scale: float = 1.0, block: int = 256) -> DataFrame:
    """(j, score): mean over all rows and outputs of |sum of the trees' Shapley values|. The trees travel; a task's rows give P sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = 0.0, 0
        for part in batches:
            if len(part):
                x = np.array(part["features"].tolist(), float)
                total, n = total + learn.shap_importance(trees, x, block) * len(x), n + len(x)
        if n:
            yield pd.DataFrame({"j": np.arange(len(total), dtype=np.int32), "s": total, "n": n})

    return wide.select("features").mapInPandas(run, "j int, s double, n long").groupBy("j").agg((F.sum("s") / F.sum("n") * scale).alias("score"))


def shap_rows(wide: DataFrame, trees: list[learn.Tree], labels: list[int], block: int = 256) -> DataFrame:
    """(id, class, j, contribution): what each feature adds to a row's probability of a class in a forest, zeros left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for a in range(0, len(part), block):
                own = part.iloc[a : a + block]
                x = np.array(own["features"].tolist(), float)
                s = sum(learn.tree_shap(t, x) for t in trees) / len(trees)
                i, j, c = np.nonzero(np.abs(s) > 0)
                yield pd.DataFrame({"id": own["id"].to_numpy()[i], "class": np.array(labels, np.int32)[c], "j": j.astype(np.int32), "contribution": s[i, j, c]})

    return wide.select("id", "features").mapInPandas(run, "id long, class int, j int, contribution double")


def shap_select(wide: DataFrame, n: int = 100, rate: float = 0.1, depth: int = 3, seed: int = 0, bins: int = BINS) -> DataFrame:
    """(j, score): features by their mean absolute Shapley values, of gradient boosting for two classes, else of a random forest."""
    with binned(wide, bins) as data:
        two = len(data.labels) == 2
        trees = boosting(data, n, rate, depth, seed) if two else forest(data, n, depth, False, seed)
    return shap_importance(wide, trees, 1.0 if two else 1.0 / max(1, len(trees)))
