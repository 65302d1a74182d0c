"""Linear models, discriminants and spectral selectors over all rows of a distributed matrix.

Each step is one pass in which a task adds up what its rows contribute (gradients, Gram matrices of the rows
that count, scatter within classes) and ships these sums; the driver takes the step. What it holds, and what
a task ships, depends on features and classes only: P x classes numbers for the logistic model, P x P for
the others. Several problems that need the same kind of pass (classes, folds, candidate features) step
together. Nothing is sampled, and no matrix has a row or column for a row of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.operators import learn, moments, permutation
from featlab.operators.selectors import ranked


@dataclass
class Rows:
    """frame: (label place y, features) of a training set; blocks: the same, packed; both are kept until the block ends. p features, labels in order, n rows of each."""

    frame: DataFrame
    blocks: RDD
    p: int
    labels: list[int]
    counts: np.ndarray

    @property
    def n(self) -> int:
        return int(self.counts.sum())


@contextmanager
def training(wide: DataFrame) -> Iterator[Rows]:
    """Rows without a label or features are left out; ValueError where none is left."""
    own = wide.where("label IS NOT NULL AND features IS NOT NULL")
    about = own.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("p")).orderBy("label").collect()
    if not about:
        raise ValueError("no labelled rows")
    labels = [r["label"] for r in about]
    y = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col("label")) - 1
    rows = own.select(y.cast("int").alias("y"), "features")
    p, counts = max(r["p"] for r in about), np.array([r["n"] for r in about], float)
    kept, blocks = rows.persist(), packed(rows, int(counts.sum()) * p)
    try:
        yield Rows(kept, blocks, p, labels, counts)
    finally:
        kept.unpersist()
        blocks.unpersist()


#: Numbers of a matrix in a task; numbers that tasks send straight to the driver, all together; numbers added up in one place.
TASK, STRAIGHT, PIECE = 1 << 22, 1 << 20, 1 << 16


def packed(rows: DataFrame, numbers: int) -> RDD:
    """(y, matrix) blocks of rows (y, features), dealt evenly to all cores and kept, so that a pass costs no more than its sums. numbers: of the matrix, about."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield pd.DataFrame({"y": [part["y"].to_numpy(np.int32).tobytes()], "x": [np.array(part["features"].tolist(), float).tobytes()]})

    def block(r) -> tuple[np.ndarray, np.ndarray]:
        y = np.frombuffer(bytes(r["y"]), np.int32)
        return y, np.frombuffer(bytes(r["x"])).reshape(len(y), -1)

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-numbers // TASK))
    return rows.repartition(tasks).mapInPandas(pack, "y binary, x binary").rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)


def added(blocks: RDD, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what `of` gives for a block (matrix, y): `size` numbers."""

    def run(own: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        total = None
        for y, x in own:
            some = of(x, y)
            total = some if total is None else total + some
        if total is not None:
            yield np.asarray(total, float)

    if blocks.getNumPartitions() * size <= STRAIGHT:
        return sum(blocks.mapPartitions(run).collect(), np.zeros(size))

    def pieces(own: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        for total in run(own):
            for at in range(0, size, PIECE):
                yield at, total[at : at + PIECE]

    out = np.zeros(size)
    for at, own in blocks.mapPartitions(pieces).reduceByKey(np.add, min(blocks.getNumPartitions(), -(-size // PIECE))).collect():
        out[at : at + len(own)] = own
    return out


# --- the logistic model ---


#: Columns up to which the logistic model's steps know the products of all columns; beyond, those of each with itself.
WIDE = 2048


def products(a: np.ndarray) -> np.ndarray:
    return (a.T @ a if a.shape[1] <= WIDE else (a * a).sum(0)).ravel()


def curvature(gram: np.ndarray, classes: int, c: float) -> Callable[[np.ndarray], np.ndarray]:
    """gram: products() of the columns, the constant last. What divides a gradient (columns x classes) by the logistic loss's second derivatives, as they are about where all classes are even."""
    own, penalty = c * gram * (1 - 1 / classes) / classes, np.ones(len(gram))
    penalty[-1] = 1e-9
    if gram.ndim == 1:
        return lambda v: (v.reshape(-1, classes) / (own + penalty)[:, None]).ravel()
    inverse = np.linalg.pinv(own + np.diag(penalty), hermitian=True)
    return lambda v: (inverse @ v.reshape(-1, classes)).ravel()


def _descent(z: np.ndarray, steps: int, divide: Callable[[np.ndarray], np.ndarray], memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS with halving steps, from second derivatives that `divide` knows about: yields where it wants the loss and its gradient, returns the minimum."""
    f, g = yield z
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = -g, []
        for s, y in reversed(pairs):
            a = s @ d / (y @ s)
            kept.append(a)
            d = d - a * y
        d = divide(d)
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ divide(y))
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            d = d + s * (a - y @ d / (y @ s))
        slope, t = g @ d, 1.0
        if slope >= 0:
            d, slope = -g, -(g @ g)
        while True:
            new = z + t * d
            fn, gn = yield new
            if fn <= f + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        if (new - z) @ (gn - g) > 1e-12:
            pairs = [*pairs, (new - z, gn - g)][-memory:]
        done = abs(f - fn) <= 1e-13 * max(1.0, abs(f)) or np.abs(gn).max() < 1e-5
        z, f, g = new, fn, gn
        if done:
            break
    return z


def together(runs: list[Generator], evaluate: Callable[[list[tuple[int, np.ndarray]]], list]) -> list:
    """Drives generators that yield questions until they return; evaluate answers the open ones, (number, question), at once."""
    out: list = [None] * len(runs)
    asked = {k: next(r) for k, r in enumerate(runs)}
    while asked:
        answers = evaluate(list(asked.items()))
        now = {}
        for (k, _), answer in zip(asked.items(), answers, strict=True):
            try:
                now[k] = runs[k].send(answer)
            except StopIteration as end:
                out[k] = end.value
        asked = now
    return out


@dataclass
class Linear:
    """Scores x @ w + b by label; importance: mean |w|, or its norm, over the labels."""

    w: np.ndarray
    b: np.ndarray
    labels: list[int]
    importance: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.labels)[(x @ self.w + self.b).argmax(1)]

    def scored(self, rows: DataFrame) -> DataFrame:
        """(id, label, p array, predicted) of (id, label, features): probabilities by label in order, and the label of the greatest."""
        w, b, labels = self.w, self.b, np.array(self.labels)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                if len(part):
                    p = learn.softmax(np.array(part["features"].tolist(), float) @ w + b)
                    yield pd.DataFrame({"id": part["id"], "label": part["label"], "p": list(p), "predicted": labels[p.argmax(1)].astype(np.int32)})

        return rows.select("id", "label", "features").mapInPandas(run, "id long, label int, p array<double>, predicted int")


def logistic(rows: Rows, c: float = 1.0, steps: int = 200) -> Linear:
    """Multinomial, with an L2 penalty of 1 / (2 c) on all weights but the constant ones."""
    p, classes = rows.p + 1, len(rows.labels)
    constant = lambda x: np.concatenate((x, np.ones((len(x), 1))), axis=1)

    def loss(z: np.ndarray) -> tuple[float, np.ndarray]:
        w = z.reshape(p, classes)

        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            a = constant(x)
            q = learn.softmax(a @ w)
            f = -np.log(np.maximum(q[np.arange(len(y)), y], 1e-300)).sum()
            q[np.arange(len(y)), y] -= 1
            return np.append((a.T @ q).ravel(), f)

        total = c * added(rows.blocks, of, p * classes + 1)
        g = total[:-1].reshape(p, classes)
        g[:-1] += w[:-1]
        return total[-1] + 0.5 * (w[:-1] ** 2).sum(), g.ravel()

    gram = added(rows.blocks, lambda x, y: products(constant(x)), p * p if p <= WIDE else p)
    divide = curvature(gram.reshape(p, p) if p <= WIDE else gram, classes, c)
    w = together([_descent(np.zeros(p * classes), steps, divide)], lambda asked: [loss(z) for _, z in asked])[0].reshape(p, classes)
    return Linear(w[:-1], w[-1], rows.labels, np.abs(w[:-1]).mean(1))


# --- linear support vectors ---


def _newton(p: int, c: float, most: int = 30) -> Generator[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The squared hinge with an L2 penalty: yields weights (None at first: all rows count), is told the Gram matrix of the rows within the
    margin there and their signed sum, and steps to the minimum of that quadratic."""
    w = np.zeros(p)
    gram, sums = yield None
    for _ in range(most):
        new = np.linalg.solve(np.eye(p) + 2 * c * gram, 2 * c * sums)
        moved, w = np.abs(new - w).max(), new
        if moved < 1e-9:
            break
        gram, sums = yield w
    return w


def support_vectors(rows: Rows, columns: list[list[int]], c: float = 1.0) -> list[np.ndarray]:
    """For each list of columns the weights (classes, columns + 1), constant last, of one class against the rest; two classes have one row.

    All classes and lists step together: a pass adds up, for each of them, the Gram matrix of the rows within its margin.
    """
    classes = len(rows.labels)
    targets = list(range(classes)) if classes > 2 else [1]
    which = [(cols, t) for cols in columns for t in targets]

    def evaluate(asked: list[tuple[int, np.ndarray | None]]) -> list[tuple[np.ndarray, np.ndarray]]:
        sizes = [len(which[k][0]) + 1 for k, _ in asked]

        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            a, out = np.concatenate((x, np.ones((len(x), 1))), axis=1), []
            for k, w in asked:
                cols, target = which[k]
                own, s = a[:, [*cols, a.shape[1] - 1]], np.where(y == target, 1.0, -1.0)
                active = np.ones(len(s), bool) if w is None else s * (own @ w) < 1
                m = own[active]
                out += [(m.T @ m).ravel(), m.T @ s[active]]
            return np.concatenate(out)

        total = added(rows.blocks, of, sum(n * n + n for n in sizes))
        out, at = [], 0
        for n in sizes:
            out.append((total[at : at + n * n].reshape(n, n), total[at + n * n : at + n * n + n]))
            at += n * n + n
        return out

    found = together([_newton(len(cols) + 1, c) for cols, _ in which], evaluate)
    return [np.stack(found[k : k + len(targets)]) for k in range(0, len(found), len(targets))]


def hinge_accuracy(rows: Rows, columns: list[list[int]], weights: list[np.ndarray]) -> list[float]:
    """The share of rows that each list's weights put in their own class."""

    def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = []
        for cols, w in zip(columns, weights, strict=True):
            d = x[:, cols] @ w[:, :-1].T + w[:, -1]
            hat = d.argmax(1) if d.shape[1] > 1 else (d[:, 0] > 0).astype(int)
            out.append(float((hat == y).sum()))
        return np.array(out)

    return (added(rows.blocks, of, len(columns)) / max(1, rows.n)).tolist()


def svc_select(wide: DataFrame, k: int, c: float = 1.0) -> DataFrame:
    """(rank, j, score): at most k features, those whose weights' norm over the classes reaches the mean; in column order."""
    with training(wide) as rows:
        s = np.linalg.norm(support_vectors(rows, [list(range(rows.p))], c)[0][:, :-1], axis=0)
    best = sorted(j for j in ranked(s, k)[0] if s[j] >= s.mean())
    return _frame(wide, best, [s[j] for j in best])


def svm_wrapper(wide: DataFrame, k: int, forward: bool = True, c: float = 1.0, fit: Callable[..., list[np.ndarray]] = support_vectors) -> DataFrame:
    """(rank, j, score): features added (or left out) one at a time, each time the one with the best accuracy of linear support vectors on
    all rows, of equals the first (backward: the last to go). All candidates of a step are fitted together."""
    with training(wide) as rows:
        chosen, scores = [] if forward else list(range(rows.p)), []
        while len(chosen) < min(k, rows.p) if forward else len(chosen) > k:
            options = [j for j in range(rows.p) if j not in chosen] if forward else list(chosen)
            columns = [[*chosen, j] if forward else [q for q in chosen if q != j] for j in options]
            value = dict(zip(options, hinge_accuracy(rows, columns, fit(rows, columns, c)), strict=True))
            best = max(options, key=lambda j: (round(value[j], 12), -j))
            chosen = [*chosen, best] if forward else [q for q in chosen if q != best]
            scores.append(value[best])
        if not forward:
            scores = hinge_accuracy(rows, [chosen], fit(rows, [chosen], c)) * len(chosen)
    return _frame(wide, chosen, scores)


def sparse_support_vectors(rows: Rows, columns: list[list[int]], c: float = 0.1, steps: int = 30, tol: float = 0.05) -> list[np.ndarray]:
    """As `support_vectors` with an L1 penalty on all weights, by accelerated proximal steps, `steps` at most. A pass adds up the gradients of
    all classes and lists that still move; the step's size comes from one Gram matrix."""
    classes, p = len(rows.labels), rows.p + 1
    targets = list(range(classes)) if classes > 2 else [1]

    def constant(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.ones((len(x), 1))), axis=1)

    gram = added(rows.blocks, lambda x, y: (constant(x).T @ constant(x)).ravel(), p * p).reshape(p, p)
    use = np.zeros((p, len(columns) * len(targets)), bool)
    size = np.zeros(use.shape[1])
    for k, cols in enumerate(columns):
        own = [*cols, p - 1]
        here = slice(k * len(targets), (k + 1) * len(targets))
        use[own, here] = True
        size[here] = 1 / (2 * c * np.linalg.eigvalsh(gram[np.ix_(own, own)])[-1] + 1e-12)
    target = np.tile(targets, len(columns))
    w, v, t = np.zeros(use.shape), np.zeros(use.shape), 1.0
    moving = np.arange(use.shape[1])
    for _ in range(steps):
        now = v[:, moving]

        def of(x: np.ndarray, y: np.ndarray, now=now, target=target[moving]) -> np.ndarray:
            a, out = constant(x), np.zeros(now.shape)
            for at in range(0, len(a), 1024):
                b = a[at : at + 1024]
                s = np.where(y[at : at + 1024, None] == target[None], 1.0, -1.0)
                out += b.T @ (s * np.maximum(0, 1 - s * (b @ now)))
            return out.ravel()

        slope = added(rows.blocks, of, now.size).reshape(now.shape)
        z = now + size[moving] * 2 * c * slope
        new = np.where(use[:, moving], np.sign(z) * np.maximum(np.abs(z) - size[moving], 0), 0.0)
        tn = (1 + np.sqrt(1 + 4 * t * t)) / 2
        done = np.abs(new - w[:, moving]).max(0) < tol * np.maximum(1e-6, np.abs(new).max(0))
        v[:, moving] = new + (t - 1) / tn * (new - w[:, moving])
        w[:, moving], t, moving = new, tn, moving[~done]
        if not len(moving):
            break
    return [np.stack([w[[*cols, p - 1], k * len(targets) + i] for i in range(len(targets))]) for k, cols in enumerate(columns)]


def _frame(wide: DataFrame, chosen: list[int], scores) -> DataFrame:
    return wide.sparkSession.createDataFrame([(r, int(j), float(s)) for r, (j, s) in enumerate(zip(chosen, scores, strict=True), 1)], "rank int, j int, score double")


# --- from scatter and second moments ---


def discriminant(rows: Rows) -> Linear:
    """Linear discriminant analysis on standardised features: class means and the scatter within classes, from one pass over (x, x²) sums by
    class and one Gram matrix; the pseudo-inverse of the pooled covariance gives the scores."""
    p, classes = rows.p, len(rows.labels)

    def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.concatenate((np.stack([x[y == c].sum(0) for c in range(classes)]).ravel(), (x.T @ x).ravel()))

    total = added(rows.blocks, of, classes * p + p * p)
    sums, gram, n = total[: classes * p].reshape(classes, p), total[classes * p :].reshape(p, p), rows.n
    mean = sums.sum(0) / n
    var = np.maximum(np.diag(gram) / n - mean**2, 0)
    scale = np.where(var > 1e-12 * np.maximum(mean**2, 1e-300), np.sqrt(var), 1.0)
    m = (sums / rows.counts[:, None] - mean) / scale
    within = ((gram - n * np.outer(mean, mean)) / np.outer(scale, scale) - (m * rows.counts[:, None]).T @ m) / max(1, n - classes)
    inv = np.linalg.pinv((within + within.T) / 2, hermitian=True)
    w = inv @ m.T
    b = -0.5 * np.einsum("cp,pq,cq->c", m, inv, m) + np.log(rows.counts / n)
    w = w / scale[:, None]
    return Linear(w, b - mean @ w, rows.labels, np.abs(w).mean(1))


def _symmetric(entries: DataFrame, value: str = "v") -> np.ndarray:
    """The whole matrix of (i, j, value), i <= j: P x P numbers."""
    rows = entries.toPandas()
    p = int(rows["j"].max()) + 1 if len(rows) else 0
    out = np.zeros((p, p))
    out[rows["i"], rows["j"]] = rows[value]
    out[rows["j"], rows["i"]] = rows[value]
    return out


def _sum_of_k(wide: DataFrame, scores: np.ndarray, k: int) -> DataFrame:
    return _frame(wide, *ranked(scores, k))


def thresholded_eigen(wide: DataFrame, k: int, t: float = 1.0) -> DataFrame:
    """(rank, j, score): |entries| summed over the k leading eigenvectors of the thresholded second-moment matrix."""
    v = np.linalg.eigh(_symmetric(moments.thresholded(wide, t)))[1][:, ::-1][:, :k]
    return _sum_of_k(wide, np.abs(v).sum(1), k)


def leading_eigenvector(wide: DataFrame, k: int) -> DataFrame:
    """(rank, j, score): |entries| of the covariance's leading eigenvector."""
    return _sum_of_k(wide, np.abs(np.linalg.eigh(_symmetric(moments.covariance(wide)))[1][:, -1]), k)


def robust_regression(wide: DataFrame, k: int, gamma: float = 0.01, max_iter: int = 1000, tol: float = 1e-3) -> DataFrame:
    """(rank, j, score): rows of W that minimise the l2,1 norms of the residual and, times gamma, of W.

    Reweighted least squares from the P x P side: with a row's weight d and a feature's e, W = (XᵀDX + gamma E)⁻¹ XᵀDY. The weights of
    rows follow from the W before, so a step is one pass, which also gives the objective there; no matrix has a row's size.
    """
    with training(wide) as rows:
        p, classes = rows.p, len(rows.labels)
        w, e, before = None, np.ones(p), np.inf
        for _ in range(max_iter):

            def of(x: np.ndarray, y: np.ndarray, w=w) -> np.ndarray:
                t = learn.one_hot(y, classes)
                norm = np.zeros(len(x)) if w is None else np.linalg.norm(x @ w - t, axis=1)
                d = np.full(len(x), 1 / gamma) if w is None else 0.5 / np.maximum(norm, 1e-12)
                xd = x * d[:, None]
                return np.concatenate(((xd.T @ x).ravel(), (xd.T @ t).ravel(), [norm.sum()]))

            total = added(rows.blocks, of, p * p + p * classes + 1)
            if w is not None:
                now = total[-1] + gamma * np.linalg.norm(w, axis=1).sum()
                if abs(before - now) < tol:
                    break
                before = now
            w = np.linalg.solve(total[: p * p].reshape(p, p) + gamma * np.diag(e) + 1e-12 * np.eye(p), total[p * p : -1].reshape(p, classes))
            e = 0.5 / np.maximum(np.linalg.norm(w, axis=1), 1e-12)
    return _sum_of_k(wide, np.linalg.norm(w, axis=1), k)


def graph_fused(wide: DataFrame, k: int, lambda1: float = 0.8, lambda2: float = 0.8, rho: float = 0.1, max_iter: int = 300, limit: float = 0.8) -> DataFrame:
    """(rank, j, score): |w| of the lasso fused over pairs of features whose correlation exceeds limit in size, by ADMM from XᵀX and XᵀY alone."""
    with training(wide) as rows:
        p = rows.p

        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.concatenate(((x.T @ x).ravel(), x.sum(0), x.T @ y.astype(float)))

        total, n = added(rows.blocks, of, p * p + 2 * p), rows.n
    gram, mean, xy = total[: p * p].reshape(p, p), total[p * p : -p] / n, total[-p:]
    cov = gram / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    fit = sd > 1e-9 * np.maximum(np.abs(mean), 1e-300)
    r = np.where(np.outer(fit, fit), np.abs(cov) / np.where(np.outer(fit, fit), np.outer(sd, sd), 1), 0)
    i, j = np.nonzero(np.triu(r > limit, 1))
    w, q, mu = np.zeros(p), np.zeros(p), np.zeros(p)
    a, va, b, vb = (np.zeros(len(i)) for _ in range(4))
    degree = np.bincount(i, minlength=p) + np.bincount(j, minlength=p)
    inv = np.linalg.inv(gram + rho * (np.eye(p) + np.diag(degree)))
    soft = lambda v, c: np.sign(v) * np.maximum(np.abs(v) - c, 0)
    for _ in range(max_iter):
        back = np.bincount(i, rho * a - va, p) - np.bincount(j, rho * b - vb, p)
        w = inv @ (xy + rho * q - mu + back)
        q, a, b = soft(w + mu / rho, lambda1 / rho), soft(w[i] + va / rho, lambda2 / rho), soft(-w[j] + vb / rho, lambda2 / rho)
        mu, va, vb = mu + rho * (w - q), va + rho * (w[i] - a), vb + rho * (-w[j] - b)
    return _sum_of_k(wide, np.abs(w), k)


# --- the kernel machine ---

#: Rows that span the kernel's features; more rows of the table don't change what a task or the driver holds.
LANDMARKS = 256


@dataclass
class KernelMachine:
    """Linear support vectors on Nyström features of the RBF kernel of standardised rows."""

    mean: np.ndarray
    scale: np.ndarray
    gamma: float
    landmarks: np.ndarray
    root: np.ndarray
    w: np.ndarray
    labels: list[int]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        d = (z * z).sum(1)[:, None] + (self.landmarks * self.landmarks).sum(1)[None] - 2 * z @ self.landmarks.T
        return np.exp(-self.gamma * np.maximum(d, 0)) @ self.root

    def predict(self, x: np.ndarray) -> np.ndarray:
        d = self.features(x) @ self.w[:, :-1].T + self.w[:, -1]
        return np.array(self.labels)[d.argmax(1) if d.shape[1] > 1 else (d[:, 0] > 0).astype(int)]


def kernel_machine(rows: Rows, c: float = 1.0, landmarks: int = LANDMARKS) -> KernelMachine:
    """RBF with gamma 1 / (P x variance of the standardised rows). Landmarks are the rows with the least hashes of their content, all rows
    where there are no more; the root of the pseudo-inverse of their kernel maps rows to features, on which the squared hinge is solved
    as in `support_vectors`, from sums over all rows."""
    products = moments.Products(rows.frame)
    mean, var = products.sums / rows.n, np.maximum(products.squares / rows.n - (products.sums / rows.n) ** 2, 0)
    fit = var > 1e-12 * np.maximum(mean**2, 1e-300)
    scale = np.where(fit, np.sqrt(var), 1.0)
    drawn = rows.frame.select("features").distinct().withColumn("h", F.xxhash64("features")).orderBy("h").limit(landmarks).toPandas()
    own = (np.array(drawn["features"].tolist(), float) - mean) / scale
    gamma = 1 / (rows.p * max(1e-12, fit.mean()))
    d = (own * own).sum(1)[:, None] + (own * own).sum(1)[None] - 2 * own @ own.T
    value, vector = np.linalg.eigh(np.exp(-gamma * np.maximum(d, 0)))
    keep = value > 1e-9 * value.max()
    out = KernelMachine(mean, scale, gamma, own, vector[:, keep] / np.sqrt(value[keep]), np.zeros((0, 0)), rows.labels)

    blocks = rows.blocks.map(lambda b: (b[0], out.features(b[1]))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        width = int(keep.sum())
        out.w = support_vectors(Rows(rows.frame, blocks, width, rows.labels, rows.counts), [list(range(width))], c)[0]
    finally:
        blocks.unpersist()
    return out


def kernel_select(wide: DataFrame, k: int, c: float = 1.0, repeats: int = 10, seed: int = 0) -> DataFrame:
    """(rank, j, score): by how much the kernel machine's accuracy on all rows falls when the feature is permuted."""
    with training(wide) as rows:
        model = kernel_machine(rows, c)
    found = permutation.importance(wide.where("label IS NOT NULL AND features IS NOT NULL"), model.predict, repeats, seed).toPandas().sort_values("j")
    return _sum_of_k(wide, found["score"].to_numpy(), k)
