"""Folds judged by Spark's sums over all rows, whatever the matrix's size.

Selectors, fits, predictions, metrics and importances are those of `spread`, `solvers`, `forests`, `graphs`
and `permutation`; the logistic models of all folds and K step together, in one pass over all rows a step.
Only random forests of full depth are grown in tasks that each hold the selected features of a fold's rows,
a share of the trees in each.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.operators import forests, graphs, learn, metrics, permutation, solvers, splits
from featlab.operators.selectors import ranked
from featlab.plans import spread
from featlab.sources.matrices import slice_features

#: Groups of trees of a forest of full depth.
GROVES = 32


@dataclass
class Side:
    """A fold's rows (id, label, features), those of the selected features, and their labels in order."""

    train: DataFrame
    test: DataFrame
    labels: list[int]
    p: int


#: (id, label, p array) of the test rows, probabilities by label in order, and the importance of the features.
Judged = tuple[DataFrame, np.ndarray]


def _mapped(rows: DataFrame, predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield pd.DataFrame({"id": part["id"], "label": part["label"], "p": list(predict(np.array(part["features"].tolist(), float)))})

    return rows.select("id", "label", "features").mapInPandas(run, "id long, label int, p array<double>")


def _forest_importance(s: Side, seed: int, trees: int = 120) -> np.ndarray:
    with forests.binned(s.train) as data:
        return np.mean([t.gain for t in forests.forest(data, trees, 3, True, seed)], axis=0)


def _extra_trees(s: Side, seed: int) -> Judged:
    with forests.binned(s.train) as data:
        trees = forests.forest(data, 200, 3, True, seed)
    return forests.probabilities(s.test, trees), np.mean([t.gain for t in trees], axis=0)


def _discriminant(s: Side, seed: int) -> Judged:
    with solvers.training(s.train) as rows:
        model = solvers.discriminant(rows)
    told = permutation.importance(s.train, model.predict, 5, seed).toPandas().sort_values("j")  # a number for each feature
    return _mapped(s.test, lambda x: learn.softmax(x @ model.w + model.b)), told["score"].to_numpy()


def _neighbours(s: Side, seed: int) -> Judged:
    with solvers.training(s.train) as rows:
        total = solvers.added(rows.blocks, lambda x, y: np.concatenate((x.sum(0), (x * x).sum(0))), 2 * s.p)
        n = rows.n
    mean = total[: s.p] / n
    var = total[s.p :] / n - mean**2
    scale = np.where(var > 1e-12 * np.maximum(mean**2, 1e-300), np.sqrt(np.maximum(var, 0)), 1.0)
    scaled = lambda rows: _mapped(rows, lambda x: (x - mean) / scale).withColumnRenamed("p", "features")
    near = graphs.neighbours(scaled(s.test), 5, against=scaled(s.train))
    votes = F.array(*[F.avg((F.col("dst_label") == c).cast("double")) for c in s.labels])
    return near.groupBy(F.col("src").alias("id"), F.col("src_label").cast("int").alias("label")).agg(votes.alias("p")), _forest_importance(s, seed)


def _kernel(s: Side, seed: int) -> Judged:
    with solvers.training(s.train) as rows:
        model = solvers.kernel_machine(rows)

    def predict(x: np.ndarray) -> np.ndarray:
        d = model.features(x) @ model.w[:, :-1].T + model.w[:, -1]
        return learn.softmax(2 * (d if d.shape[1] > 1 else np.concatenate((-d, d), axis=1)))

    return _mapped(s.test, predict), _forest_importance(s, seed)


def _random_forest(s: Side, seed: int, trees: int = 300) -> Judged:
    labels, groves = np.array(s.labels), min(GROVES, trees)
    both = s.train.withColumn("test", F.lit(False)).unionByName(s.test.withColumn("test", F.lit(True)))
    copies = both.withColumn("grove", F.explode(F.sequence(F.lit(0), F.lit(groves - 1))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["test", "id"])
        x, test, y = np.array(part["features"].tolist(), float), part["test"].to_numpy(bool), np.searchsorted(labels, part["label"])
        seeds = range(int(part["grove"].iloc[0]), trees, groves)
        model = learn.Forest(depth=None, extra=False, seeds=seeds).fit(x[~test], y[~test], len(labels), seed)
        share = len(seeds) / trees
        told = pd.DataFrame({"id": part["id"][test], "label": part["label"][test], "p": list(share * model.predict_proba(x[test]))})
        return pd.concat((told, pd.DataFrame({"id": [None], "label": [None], "p": [share * model.importance]})), ignore_index=True).astype({"id": "Int64", "label": "Int32"})

    parts = copies.repartition(groves, "grove").groupBy("grove").applyInPandas(run, "id long, label int, p array<double>").persist()
    summed = lambda rows, by, m: rows.groupBy(*by).agg(F.array(*[F.sum(F.get("p", F.lit(c))) for c in range(m)]).alias("p"))
    imp = np.array(summed(parts.where("label IS NULL"), [], s.p).first()["p"])
    return summed(parts.where("label IS NOT NULL"), ["id", "label"], len(labels)), imp


EVALUATE = {"ETREE": _extra_trees, "LDA": _discriminant, "KNN": _neighbours, "SVM": _kernel, "RF": _random_forest}


def logistics(blocks: RDD, labels: list[int], problems: list[tuple[int, list[int]]], extra: dict[int, list[int]], c: float = 1.0, steps: int = 200) -> list[np.ndarray]:
    """Weights (columns + 1, classes), constant last, of `solvers.logistic` for each (fold left out, columns) of packed rows, the fold their last feature. extra: by fold, the classes whose rows count in spite of it."""
    classes = len(labels)
    sizes = [(len(cols) + 1) ** 2 if len(cols) < solvers.WIDE else len(cols) + 1 for _, cols in problems]

    def used(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A problem's rows, with a constant, and their labels."""
        fold, cols = problems[k]
        use = (x[:, -1] != fold) | np.isin(y, extra.get(fold, []))
        return np.concatenate((x[:, cols][use], np.ones((use.sum(), 1))), axis=1), y[use]

    grams = np.split(solvers.added(blocks, lambda x, y: np.concatenate([solvers.products(used(x, y, k)[0]) for k in range(len(problems))]), sum(sizes)), np.cumsum(sizes)[:-1])
    divide = [solvers.curvature(g if n == len(cols) + 1 else g.reshape(len(cols) + 1, -1), classes, c) for g, n, (_, cols) in zip(grams, sizes, problems, strict=True)]

    def evaluate(asked: list[tuple[int, np.ndarray]]) -> list[tuple[float, np.ndarray]]:
        sizes = [(len(problems[k][1]) + 1) * classes + 1 for k, _ in asked]

        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = []
            for k, z in asked:
                a, own = used(x, y, k)
                q = learn.softmax(a @ z.reshape(-1, classes))
                f = -np.log(np.maximum(q[np.arange(len(own)), own], 1e-300)).sum()
                q[np.arange(len(own)), own] -= 1
                out.append(np.append((a.T @ q).ravel(), f))
            return np.concatenate(out)

        total, out, at = c * solvers.added(blocks, of, sum(sizes)), [], 0
        for (_, z), n in zip(asked, sizes, strict=True):
            w, g = z.reshape(-1, classes), total[at : at + n - 1].reshape(-1, classes)
            g[:-1] += w[:-1]
            out.append((total[at + n - 1] + 0.5 * (w[:-1] ** 2).sum(), g.ravel()))
            at += n
        return out

    runs = [solvers._descent(np.zeros((len(cols) + 1) * classes), steps, own) for (_, cols), own in zip(problems, divide, strict=True)]
    return [w.reshape(-1, classes) for w in solvers.together(runs, evaluate)]


def _metrics(told: list[DataFrame], labels: list[int], threshold: float) -> list[list[float]]:
    """accuracy, auc, precision, recall, f1 of each of several frames (id, label, p), as learn.judged, from counts by label and guess and from counts by score, for all of them at once."""
    codes, two = F.array(*[F.lit(c) for c in labels]), len(labels) == 2
    best = F.when(F.get("p", F.lit(1)) >= threshold, labels[1]).otherwise(labels[0]) if two else F.element_at(codes, F.array_position("p", F.array_max("p")).cast("int"))
    rows = reduce(DataFrame.unionAll, [t.select(F.lit(k).alias("run"), "label", "p", best.alias("predicted")) for k, t in enumerate(told)]).persist()
    at, n = {c: i for i, c in enumerate(labels)}, np.zeros((len(told), len(labels), len(labels)))
    for r in rows.groupBy("run", "label", "predicted").count().collect():  # classes x classes numbers a run
        n[r["run"], at[r["label"]], at[r["predicted"]]] = r["count"]
    each = rows.select("run", "label", F.posexplode("p").alias("at", "score")).where("at = 1" if two else "true")
    by = metrics._auc(each.select("run", "at", (F.col("label") == F.element_at(codes, F.col("at") + 1)).cast("int").alias("y"), "score"), ["run", "at"])
    auc = {r["run"]: r["auc"] for r in by.groupBy("run").agg(F.avg("auc").alias("auc")).collect()}
    rows.unpersist()
    out = []
    for k, c in enumerate(n):
        tp, of, given = np.diag(c), c.sum(1), c.sum(0)
        pr, re, w = tp / np.maximum(given, 1), tp / np.maximum(of, 1), of / of.sum()
        f = 2 * pr * re / np.where(pr + re > 0, pr + re, 1)
        out.append([float(tp.sum() / c.sum()), float("nan") if auc.get(k) is None else auc[k], float(pr @ w), float(re @ w), float(f @ w)])
    return out


def runs(wide: DataFrame, algorithm: str | None, ks: list[int], evaluators: list[str], folds: int, seed: int, threshold: float) -> list[tuple]:
    """As pipeline.fold_runs: a row for each fold, K and evaluator."""
    wide = wide.where("label IS NOT NULL AND features IS NOT NULL")
    tasks = 2 * wide.sparkSession.sparkContext.defaultParallelism
    kept = splits.stratified_folds(wide, folds, seed).select("id", "label", "features", "fold").repartition(tasks, "id").persist()
    count = {(r["label"], r["fold"]): r["count"] for r in kept.groupBy("label", "fold").count().collect()}  # a row for each class and fold
    labels, p = sorted({c for c, _ in count}), kept.select(F.max(F.size("features"))).first()[0]
    there = sorted({f for _, f in count})
    only = {f: [c for c in labels if all(g == f for d, g in count if d == c)] for f in there}
    found = []

    def selected(fold: int) -> list[tuple[int, list[int], Side, float]]:
        """(K, features, side, seconds of the selection) of a fold."""
        out, none = [], [c for c in labels if (c, fold) not in count]
        train, test = ((F.col("fold") != fold) | F.col("label").isin(only[fold])), ((F.col("fold") == fold) | F.col("label").isin(none))
        a, b, whole, fs_seconds = kept.where(train).drop("fold"), kept.where(test).drop("fold"), None, 0.0
        for k in sorted({min(k, p) for k in ks}, reverse=True):
            began = time.perf_counter()
            if algorithm is None:
                own = list(range(p))
            elif whole is not None and spread.REGISTRY[algorithm].prefix:
                own = whole[:k]
            else:
                own = whole = spread.select(a, algorithm, k, seed)
            fs_seconds = time.perf_counter() - began
            if not own:
                continue
            out.append((k, own, Side(slice_features(a, own).persist(), slice_features(b, own), labels, len(own)), fs_seconds))
        return out

    def judged(at: tuple[int, int, list[int], Side, float, str]) -> tuple:
        fold, k, own, side, fs_seconds, name = at
        began = time.perf_counter()
        told, imp = EVALUATE[name.upper()](side, seed)
        return fold, k, name, told, imp, time.perf_counter() - began, fs_seconds, own

    # a job of a fold leaves cores idle while its sums are gathered and its next step is planned, so folds and evaluators run side by side
    with ThreadPoolExecutor(wide.sparkSession.sparkContext.defaultParallelism) as pool:
        by_fold = list(zip(there, pool.map(selected, there), strict=True))
        each = [(fold, *s, name) for fold, some in by_fold for s in some for name in evaluators]
        found += pool.map(judged, [x for x in each if x[-1].upper() != "LR"])
    later = [(fold, k, name, own, side.test, fs_seconds) for fold, k, own, side, fs_seconds, name in each if name.upper() == "LR"]
    sides = [x[2].train for _, some in by_fold for x in some]
    if later:
        began = time.perf_counter()
        y = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col("label")) - 1
        used = sorted({j for x in later for j in x[3]})
        frame = slice_features(kept, used).select(y.cast("int").alias("y"), F.concat("features", F.array(F.col("fold").cast("double"))).alias("features"))
        blocks = solvers.packed(frame, sum(count.values()) * len(used))
        codes = {f: [labels.index(c) for c in only[f]] for f in there}
        fitted = logistics(blocks, labels, [(x[0], [used.index(j) for j in x[3]]) for x in later], codes)
        blocks.unpersist()
        each = (time.perf_counter() - began) / len(later)
        for (fold, k, name, own, test, fs_seconds), w in zip(later, fitted, strict=True):
            told = _mapped(test, lambda x, w=w: learn.softmax(x @ w[:-1] + w[-1]))
            found.append((fold, k, name, told, np.abs(w[:-1]).mean(1), each, fs_seconds, own))
    out, began = [], time.perf_counter()
    scored = _metrics([x[3] for x in found], labels, threshold) if found else []
    each = (time.perf_counter() - began) / max(1, len(found))  # all runs are predicted and judged together
    for (fold, k, name, _, imp, seconds, fs_seconds, own), m in zip(found, scored, strict=True):
        best = ranked(imp, len(own))[0]
        out.append((fold, k, name, *m, seconds + each, fs_seconds, [own[i] for i in best], [float(imp[i]) for i in best]))
    for frame in (kept, *sides):
        frame.unpersist()
    return out
