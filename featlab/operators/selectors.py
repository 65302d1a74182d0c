"""Feature selectors on one fold's dense matrix.

Each takes a Fold and its parameters and returns features, best first, with scores where it has them.
`select` runs one of them for every group of a wide frame, in parallel over groups, on all rows of the
group; only a caller that sets `max_rows` gets a hash sample, and then a column that tells. A group has to
fit in a task. What needs a matrix of rows by rows raises ValueError where that has over learn.SQUARE
numbers; the filters of operators.filters have no such bound.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.operators import learn

@dataclass
class Fold:
    x: np.ndarray
    y: np.ndarray
    classes: int
    k: int
    seed: int = 0
    xt: np.ndarray | None = None
    yt: np.ndarray | None = None

    @property
    def p(self) -> int:
        return self.x.shape[1]

    def rng(self, *more: int):
        return np.random.default_rng([self.seed, self.k, *more])


def ranked(scores: np.ndarray, k: int) -> tuple[list[int], list[float]]:
    """The k best; ties go to the lower number."""
    s = np.round(np.nan_to_num(np.asarray(scores, float), nan=-np.inf), 12)
    best = np.lexsort((np.arange(len(s)), -s))[:k]
    return best.tolist(), [float(v) for v in s[best]]


# --- filters, in the same terms as operators.filters ---


def variance(f: Fold, **_):
    return ranked(f.x.var(0), f.k)


def second_moment(f: Fold, **_):
    return ranked((f.x**2).mean(0), f.k)


def skewness(f: Fold, skew_threshold: float = 1.0, **_):
    d = f.x - f.x.mean(0)
    v = (d**2).mean(0)
    s = np.abs(np.where(v > 0, (d**3).mean(0) / np.where(v > 0, v, 1) ** 1.5, 0))
    limit = skew_threshold if f.p / len(f.x) > 2 else skew_threshold / 2
    return ranked(np.where(s > limit, s, -np.inf) if (s > limit).sum() >= f.k else s, f.k)


def anova(f: Fold) -> np.ndarray:
    n = np.bincount(f.y, minlength=f.classes)
    m = np.stack([f.x[f.y == c].mean(0) if n[c] else np.zeros(f.p) for c in range(f.classes)])
    c = np.count_nonzero(n)
    between = (n[:, None] * (m - f.x.mean(0)) ** 2).sum(0) / max(1, c - 1)
    within = ((f.x - m[f.y]) ** 2).sum(0) / max(1, len(f.x) - c)
    return np.where(within > 0, between / np.where(within > 0, within, 1), 0)


def univariate(f: Fold, score_func: str = "chi2", **_):
    if score_func == "chi2":
        o = learn.one_hot(f.y, f.classes).T @ f.x
        e = np.bincount(f.y, minlength=f.classes)[:, None] / len(f.y) * f.x.sum(0)
        s = ((o - e) ** 2 / np.where(e > 0, e, 1)).sum(0)
    else:
        s = anova(f)
    best, _s = ranked(s, f.k)
    best = sorted(best)
    return best, [float(s[j]) for j in best]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    learn.square(len(a), len(b))
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)


def heat_graph(x: np.ndarray, k: int, t: float) -> np.ndarray:
    d = _distances(x, x)
    np.fill_diagonal(d, 0)
    near = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
    w = np.zeros_like(d)
    np.put_along_axis(w, near, np.exp(-np.take_along_axis(d, near, 1) / (2 * t * t)), 1)
    return np.maximum(w, w.T)


def laplacian(f: Fold, **_):
    w = heat_graph(f.x, f.classes, f.p)
    d = w.sum(1)
    top = (d[:, None] * f.x**2).sum(0) - (f.x * (w @ f.x)).sum(0)
    return ranked(top / np.where(d @ f.x != 0, d @ f.x, 1), f.k)


def relieff(f: Fold, n_neighbors: int = 10, **_):
    k, d = min(f.classes, n_neighbors), _distances(f.x, f.x)
    np.fill_diagonal(d, np.inf)
    spread, prior = np.ptp(f.x, axis=0), np.bincount(f.y, minlength=f.classes) / len(f.y)
    s = np.zeros(f.p)
    for c in range(f.classes):
        at = np.flatnonzero(f.y == c)
        for i in range(len(f.x)):
            near = at[np.argsort(d[i, at], kind="stable")[:k]]
            near = near[np.isfinite(d[i, near])]
            if len(near):
                w = -1.0 if c == f.y[i] else prior[c] / max(1e-12, 1 - prior[f.y[i]])
                s += w * np.abs(f.x[near] - f.x[i]).mean(0)
    return ranked(np.where(spread > 0, s / np.where(spread > 0, spread, 1), 0) / len(f.x), f.k)


def mrmr(f: Fold, relevance: str = "f", denominator: str = "mean", **_):
    rel = anova(f)
    with np.errstate(invalid="ignore", divide="ignore"):
        red = np.maximum(0.001, np.nan_to_num(np.abs(np.corrcoef(f.x, rowvar=False)), nan=0.001))
    left, out, scores = [j for j in range(f.p) if rel[j] > 0], [], []
    while left and len(out) < f.k:
        if out:
            own = red[np.ix_(left, out)]
            d = own.max(1) if denominator == "max" else own.mean(1)
            v = rel[left] / np.where(d == 1.0, np.inf, d)
        else:
            v = rel[left]
        i = int(np.round(v, 9).argmax())
        out.append(left.pop(i))
        scores.append(float(v[i]))
    return out, scores


def alpha_investing(f: Fold, w0: float = 10.0, dw: float = 0.01, **_):
    from featlab.operators.redundancy import AlphaInvesting, residual_share

    x, y = f.x - f.x.mean(0), f.y - f.y.mean()
    gram, cross, total = x.T @ x, x.T @ y, float(y @ y)
    run = AlphaInvesting(len(x), w0, dw)
    for j in range(f.p):
        if len(run.chosen) == f.k:
            break
        cols = [*run.chosen, j]
        run.offer(j, residual_share(gram[np.ix_(cols, cols)], cross[cols], total))
    return run.chosen, [1.0 - i / max(1, len(run.chosen)) for i in range(len(run.chosen))]


def entropy_merit(f: Fold, t: int = 5, bins: int = 10, **_):
    lo, r = f.x.min(0), np.ptp(f.x, axis=0)
    b = np.minimum(bins - 1, np.floor(np.where(r > 0, (f.x - lo) / np.where(r > 0, r, 1), 0) * bins).astype(int))

    def h(*v):
        _, n = np.unique(np.stack(v, 1), axis=0, return_counts=True)
        q = n / n.sum()
        return float(-(q * np.log2(q)).sum())

    def su(u, v):
        a, c = h(u), h(v)
        return 2 * (a + c - h(u, v)) / (a + c) if a + c > 0 else 0.0

    with_y = [su(b[:, j], f.y) for j in range(f.p)]
    pair: dict[tuple[int, int], float] = {}
    out, kept, best, stale, sums, cross = [], [], 0.0, 0, 0.0, 0.0
    while len(out) < min(f.k, f.p) and stale < t:
        def between(j):
            total = 0.0
            for g in out:
                key = (min(j, g), max(j, g))
                if key not in pair:
                    pair[key] = su(b[:, key[0]], b[:, key[1]])
                total += pair[key]
            return total

        merits = {j: (sums + with_y[j]) / np.sqrt(len(out) + 1 + 2 * (cross + between(j))) for j in range(f.p) if j not in out}
        j = max(merits, key=lambda q: (round(merits[q], 12), -q))
        cross, sums = cross + between(j), sums + with_y[j]
        out.append(j)
        if merits[j] > best + 1e-12:
            best, stale, kept = merits[j], 0, list(out)
        else:
            stale += 1
    return kept, [with_y[j] for j in kept]


# --- spectral ---


def thresholded_eigen(f: Fold, t: float = 1.0, **_):
    s = f.x.T @ f.x / len(f.x)
    off = ~np.eye(f.p, dtype=bool)
    s[off & (s < t / np.sqrt(len(f.x)))] = 0
    v = np.linalg.eigh(s)[1][:, ::-1][:, : f.k]
    return ranked(np.abs(v).sum(1), f.k)


def leading_eigenvector(f: Fold, **_):
    return ranked(np.abs(np.linalg.eigh(np.cov(f.x, rowvar=False))[1][:, -1]), f.k)


def lars(x: np.ndarray, y: np.ndarray, nonzero: int) -> np.ndarray:
    """Least-angle regression without an intercept until `nonzero` features are in, or no correlation is left."""
    return angles(x.T @ x, x.T @ y, min(nonzero, len(x)))


def angles(gram: np.ndarray, xy: np.ndarray, nonzero: int) -> np.ndarray:
    """The same from the features' products with each other and the target."""
    p = len(gram)
    beta, active = np.zeros(p), []
    for _ in range(min(nonzero, p)):
        c = xy - gram @ beta
        top = np.abs(c).max()
        if top < 1e-10:
            break
        j = max((q for q in range(p) if q not in active), key=lambda q: abs(c[q]))
        active.append(j)
        s = np.sign(c[active])
        g = np.linalg.pinv(s[:, None] * gram[np.ix_(active, active)] * s)
        a = 1 / np.sqrt(max(g.sum(), 1e-12))
        w = a * g.sum(1)
        corr, step = gram[:, active] @ (w * s), top / a
        for q in range(p):
            if q not in active:
                for v in ((top - c[q]) / (a - corr[q]) if abs(a - corr[q]) > 1e-12 else np.inf, (top + c[q]) / (a + corr[q]) if abs(a + corr[q]) > 1e-12 else np.inf):
                    if 1e-12 < v < step:
                        step = v
        # the last step goes as far as the next feature would come in
        beta[active] += step * w * s
    return beta


def cluster_weights(gram: np.ndarray, xy: np.ndarray, n: int, k: int) -> np.ndarray:
    """The coefficients of each target. An eigenvector's sign is open: each is turned so that its largest product with a feature is positive."""
    xy = xy * np.where(np.take_along_axis(xy, np.abs(xy).argmax(0)[None], 0) < 0, -1.0, 1.0)
    return np.stack([angles(gram, xy[:, i], min(k, n)) for i in range(xy.shape[1])], axis=1)


def multi_cluster(f: Fold, **_):
    w = heat_graph(f.x, f.classes, f.p)
    w = (w + w.T) / 2
    d = 1 / np.sqrt(np.maximum(w.sum(1), 1e-12))
    w = d[:, None] * w * d[None]
    w = np.maximum(w, w.T)
    u = np.linalg.eigh(w)[1]
    y = d[:, None] * u[:, -f.classes - 1 : -1]
    return ranked(cluster_weights(f.x.T @ f.x, f.x.T @ y, len(f.x), f.k).max(1), f.k)


def robust_regression(f: Fold, gamma: float = 0.01, max_iter: int = 1000, **_):
    n, y = len(f.x), learn.one_hot(f.y, f.classes)
    a, d = np.concatenate((f.x, gamma * np.eye(n)), axis=1), np.ones(f.p + n)
    before = np.inf
    for _i in range(max_iter):
        da = a.T / d[:, None]
        u = da @ np.linalg.solve(a @ da + 1e-6 * np.eye(n), y)
        norms = np.linalg.norm(u, axis=1)
        d = 0.5 / np.maximum(norms, 1e-16)
        w = u[: f.p]
        now = np.linalg.norm(f.x @ w - y, axis=1).sum() + gamma * np.linalg.norm(w, axis=1).sum()
        if abs(before - now) < 1e-3:
            break
        before = now
    return ranked(np.linalg.norm(u[: f.p], axis=1), f.k)


def graph_fused(f: Fold, lambda1: float = 0.8, lambda2: float = 0.8, rho: float = 0.1, max_iter: int = 300, **_):
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.nan_to_num(np.abs(np.corrcoef(f.x, rowvar=False)))
    i, j = np.nonzero(np.triu(r > 0.8, 1))
    t = np.zeros((2 * len(i), f.p))
    t[np.arange(len(i)), i] = 1
    t[len(i) + np.arange(len(i)), j] = -1
    m, xy = f.x.T @ f.x + rho * (np.eye(f.p) + t.T @ t), f.x.T @ f.y.astype(float)
    inv = np.linalg.inv(m)
    soft = lambda v, c: np.sign(v) * np.maximum(np.abs(v) - c, 0)
    q, mu, p, v = np.zeros(f.p), np.zeros(f.p), np.zeros(len(t)), np.zeros(len(t))
    for _i in range(max_iter):
        w = inv @ (xy + rho * q - mu + t.T @ (rho * p - v))
        q, p = soft(w + mu / rho, lambda1 / rho), soft(t @ w + v / rho, lambda2 / rho)
        mu, v = mu + rho * (w - q), v + rho * (t @ w - p)
    return ranked(np.abs(w), f.k)


# --- embedded ---


def extra_trees(f: Fold, n_estimators: int = 200, max_depth: int = 3, **_):
    return ranked(learn.Forest(n_estimators, max_depth).fit(f.x, f.y, f.classes, f.seed).importance, f.k)


def ada_boost(f: Fold, n_estimators: int = 100, learning_rate: float = 5.0, max_depth: int = 5, **_):
    return ranked(learn.AdaBoost(n_estimators, learning_rate, max_depth).fit(f.x, f.y, f.classes, f.seed).importance, f.k)


def linear_svc(f: Fold, C: float = 1.0, penalty: str = "l2", **_):
    """At most k features, those whose weight reaches the mean, so there may be fewer; in column order."""
    s = learn.LinearSVM(C, penalty).fit(f.x, f.y, f.classes).importance
    best = sorted(j for j in ranked(s, f.k)[0] if s[j] >= s.mean())
    return best, [float(s[j]) for j in best]


def shapley(f: Fold, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3, **_):
    if f.classes == 2:
        trees = learn.Boosting(n_estimators, learning_rate, max_depth).fit(f.x, f.y).trees
        scale = 1.0
    else:
        trees = learn.Forest(n_estimators, max_depth, False).fit(f.x, f.y, f.classes, f.seed).trees
        scale = 1.0 / len(trees)
    return ranked(scale * learn.shap_importance(trees, f.x), f.k)


def kernel_svm(f: Fold, C: float = 1.0, repeats: int = 10, **_):
    model = learn.KernelSVM(C).fit(f.x, f.y, f.classes)
    score = lambda z: float((model.decision(z).argmax(1) == f.y).mean())
    return ranked(learn.permutation_importance(score, f.x, repeats, f.seed), f.k)


# --- wrappers ---


def _greedy(f: Fold, score: Callable[[list[int]], float], forward: bool) -> tuple[list[int], list[float]]:
    chosen, scores = [] if forward else list(range(f.p)), []
    while len(chosen) < min(f.k, f.p) if forward else len(chosen) > f.k:
        options = [j for j in range(f.p) if j not in chosen] if forward else chosen
        value = {j: score([*chosen, j] if forward else [q for q in chosen if q != j]) for j in options}
        best = max(value, key=lambda j: (round(value[j], 12), -j))
        if forward:
            chosen = [*chosen, best]
            scores.append(value[best])
        else:
            chosen = [q for q in chosen if q != best]
    return chosen, scores if forward else [score(chosen)] * len(chosen)


def _svm_score(f: Fold, c: float, penalty: str, tol: float, steps: int):
    def score(cols: list[int]) -> float:
        m = learn.LinearSVM(c, penalty, steps, tol).fit(f.x[:, cols], f.y, f.classes)
        return float((m.decision(f.x[:, cols]).argmax(1) == f.y).mean())

    return score


def svm_forward(f: Fold, C: float = 1.0, **_):
    return _greedy(f, _svm_score(f, C, "l2", 1e-3, 100), True)


def svm_backward(f: Fold, C: float = 0.1, penalty: str = "l1", tol: float = 0.05, **_):
    return _greedy(f, _svm_score(f, C, penalty, tol, 30), False)


def _tree_score(f: Fold, max_depth: int, min_samples_split: int, min_samples_leaf: int, max_leaf_nodes: int):
    w = learn.balanced_weights(f.y, f.classes)

    def score(cols: list[int]) -> float:
        m = learn.DecisionTree(depth=max_depth, features=max(1, int(np.sqrt(len(cols)))), min_split=min_samples_split, min_leaf=min_samples_leaf, max_leaves=max_leaf_nodes)
        return float((m.fit(f.x[:, cols], f.y, f.classes, f.seed, w).predict_proba(f.x[:, cols]).argmax(1) == f.y).mean())

    return score


def tree_forward(f: Fold, max_depth: int = 4, min_samples_split: int = 10, min_samples_leaf: int = 5, max_leaf_nodes: int = 15, **_):
    return _greedy(f, _tree_score(f, max_depth, min_samples_split, min_samples_leaf, max_leaf_nodes), True)


def tree_backward(f: Fold, max_depth: int = 4, min_samples_split: int = 10, min_samples_leaf: int = 5, max_leaf_nodes: int = 15, **_):
    return _greedy(f, _tree_score(f, max_depth, min_samples_split, min_samples_leaf, max_leaf_nodes), False)


def cei_scores(f: Fold) -> np.ndarray:
    out = np.zeros(f.p)
    for j in range(f.p):
        y = f.y[np.argsort(f.x[:, j], kind="stable")]
        share = [1 - n / (at[-1] - at[0] + 1) for at, n in ((np.flatnonzero(y == c), (y == c).sum()) for c in np.unique(y))]
        out[j] = 1 - min(share)
    return out


def evolved(width: int, fitness: Callable[[list[np.ndarray]], list[float]], rng, ga_beta: float = 2, ga_pop: int = 20, ga_gen: int = 50) -> np.ndarray:
    """The fittest mask after generations of tournaments and bit flips. fitness: of the masks of a generation that weren't seen before; an empty one has 0."""
    known: dict[bytes, float] = {}

    def judged(pop: np.ndarray) -> np.ndarray:
        new = list({m.tobytes(): m for m in pop if m.tobytes() not in known}.values())
        known.update({m.tobytes(): 0.0 for m in new if not m.any()})
        new = [m for m in new if m.any()]
        if new:
            known.update({m.tobytes(): v for m, v in zip(new, fitness(new), strict=True)})
        return np.array([known[m.tobytes()] for m in pop])

    pop = rng.random((ga_pop, width)) < 0.5
    for _g in range(ga_gen):
        fit = judged(pop)
        duel = np.stack([rng.choice(ga_pop, 2, replace=False) for _i in range(ga_pop)])
        pop = pop[np.where(fit[duel[:, 0]] >= fit[duel[:, 1]], duel[:, 0], duel[:, 1])] ^ (rng.random(pop.shape) < 1 / (ga_beta * width))
    return pop[int(judged(pop).argmax())]


def class_span_genetic(f: Fold, pre_keep: int = 50, ga_beta: float = 2, ga_pop: int = 20, ga_gen: int = 50, cv_splits: int = 5, folds: np.ndarray | None = None, **_):
    """Features with the highest spans, then masks of them that evolve; fitness: accuracy of the nearest neighbour in other folds. folds: of the rows, dealt at random if not given."""
    s = cei_scores(f)
    keep = ranked(s, min(pre_keep, f.p))[0]
    rng, fold = f.rng(), folds
    if fold is None:
        fold = np.zeros(len(f.y), int)
        for c in range(f.classes):
            at = rng.permutation(np.flatnonzero(f.y == c))
            fold[at] = np.arange(len(at)) % cv_splits
    apart = fold[:, None] == fold[None]
    learn.square(len(f.x), len(f.x), len(keep))
    parts = [(f.x[:, [j]] - f.x[:, [j]].T) ** 2 for j in keep]

    def fitness(mask: np.ndarray) -> float:
        d = sum(parts[i] for i in np.flatnonzero(mask))
        return float((f.y[np.where(apart, np.inf, d).argmin(1)] == f.y).mean())

    best = evolved(len(keep), lambda masks: [fitness(m) for m in masks], rng, ga_beta, ga_pop, ga_gen)
    chosen = [j for j, use in zip(keep, best, strict=True) if use][: f.k]
    return chosen, [float(s[j]) for j in chosen]


# --- networks ---


class Concrete:
    """k soft one-hot rows choose inputs that a 320-320-p decoder rebuilds. state: of another one, its weights and moments, to go on from."""

    def __init__(self, k: int, p: int, rng, learning_rate: float = 1e-3, state: np.ndarray | None = None):
        self.rng, first = rng, rng if state is None else np.random.default_rng(0)
        self.logits = (first.standard_normal((k, p)) * 0.01).astype(np.float32)
        self.net, self.adam = learn.Net([k, 320, 320, p], ["relu", "relu", "sigmoid"], first, learning_rate, np.float32), learn.Adam([self.logits], learning_rate)
        if state is not None:
            self.net.adam.t = self.adam.t = round(float(state[-1]))
            at = 0
            for v in self._parts():
                v[...] = state[at : at + v.size].reshape(v.shape)
                at += v.size

    def _parts(self) -> list[np.ndarray]:
        return [v for a in (self.adam, self.net.adam) for some in (a.p, a.m, a.v) for v in some]

    def state(self) -> np.ndarray:
        return np.concatenate([*[v.ravel() for v in self._parts()], [np.float32(self.adam.t)]]).astype(np.float32)

    def train(self, x: np.ndarray, began: int, epochs: int, num_epochs: int, batch_size: int, start_temp: float, min_temp: float) -> None:
        """Some of num_epochs epochs from the one numbered began; the temperature falls from start to end over all of them."""
        each, (k, p), rng = max(1, len(x) // batch_size), self.logits.shape, self.rng
        steps = num_epochs * each
        for i in range(began * each, (began + epochs) * each):
            t = start_temp * (min_temp / start_temp) ** (i / max(1, steps - 1))
            b = x[rng.integers(0, len(x), min(batch_size, len(x)))]
            noise = -np.log(-np.log(rng.uniform(1e-9, 1 - 1e-9, (k, p)))).astype(np.float32)
            m = learn.softmax((self.logits + noise) / np.float32(t))
            g = self.net.backward(2 * (self.net.forward(b @ m.T) - b) / b.size)
            gm = g.T @ b
            self.adam.step([m * (gm - (gm * m).sum(1, keepdims=True)) / t])


def concrete_autoencoder(f: Fold, num_epochs: int = 800, batch_size: int = 16, learning_rate: float = 1e-3, start_temp: float = 10.0, min_temp: float = 0.1, **_):
    """The inputs that a Concrete chooses. Score: mean logit of a feature."""
    x = learn.Scaler(f.x)(f.x)
    model = Concrete(min(f.k, f.p), f.p, f.rng(), learning_rate)
    model.train((1 / (1 + np.exp(-x))).astype(np.float32), 0, num_epochs, num_epochs, batch_size, start_temp, min_temp)
    return ranked(model.logits.mean(0), f.k)


def fractal_autoencoder(f: Fold, epochs_number: int = 200, batch_size_value: int = 16, loss_weight_1: float = 0.0078125, p_learning_rate: float = 1e-3, **_):
    """A linear autoencoder behind a kernel that scales inputs by its squares; the loss adds, to a small share of the error with all inputs, that with the k largest only. All features that reach the k-th kernel."""
    rng, x = f.rng(), learn.Scaler(f.x)(f.x)
    p, k, h = f.p, min(f.k, f.p), max(1, min(f.k, f.p))
    kernel, e, d = rng.uniform(0.999, 1.0, p), rng.standard_normal((p, h)) / np.sqrt(p), rng.standard_normal((h, p)) / np.sqrt(h)
    adam = learn.Adam([kernel, e, d], p_learning_rate)
    order = rng.permutation(len(x))
    train, held = x[order[: max(1, int(0.8 * len(x)))]], x[order[int(0.8 * len(x)) :]]
    best, stale, saved = np.inf, 0, kernel.copy()

    def parts(b):
        s = kernel**2
        top = s >= np.sort(s)[-k]
        return [(w, b * (s * m), m) for w, m in ((loss_weight_1, np.ones(p)), (1.0, top.astype(float)))]

    for _e in range(epochs_number):
        for at in range(0, len(train), batch_size_value):
            b = train[at : at + batch_size_value]
            gk, ge, gd = np.zeros(p), np.zeros_like(e), np.zeros_like(d)
            for w, z, m in parts(b):
                u = z @ e
                g = 2 * w * (u @ d - b) / b.size
                gd += u.T @ g
                gu = g @ d.T
                ge += z.T @ gu
                gk += ((gu @ e.T) * b).sum(0) * 2 * kernel * m
            adam.step([gk, ge, gd])
        if len(held):
            loss = sum(w * (((z @ e) @ d - held) ** 2).mean() for w, z, _m in parts(held))
            if loss < best - 1e-6:
                best, stale, saved = loss, 0, kernel.copy()
            else:
                stale += 1
                if stale >= 10:
                    break
        else:
            saved = kernel.copy()
    s = saved**2
    kth = np.sort(s)[-k]
    chosen = [j for j in ranked(s, p)[0] if s[j] >= kth]
    return chosen, [float(s[j]) for j in chosen]


def dual_network(f: Fold, data_batch_size: int = 16, mask_batch_size: int = 16, s: int = 5, s_p: int = 2, phase_2_start: int = 600, max_batches: int = 1500, early_stopping_patience: int = 60, **_):
    """An operator net learns labels from inputs under masks, a selector net learns each mask's loss; the best mask follows the selector's gradient. Score: how much a feature's bit lowers the predicted loss."""
    rng, x, p = f.rng(), learn.Scaler(f.x)(f.x), f.p
    size = max(1, min(s if f.k <= 0 else f.k, p))
    y = learn.one_hot(f.y, f.classes)
    op = learn.Net([2 * p, 60, 30, 20, f.classes], ["relu", "relu", "relu", "linear"], rng)
    sel = learn.Net([p, 100, 50, 10, 1], ["relu", "relu", "relu", "linear"], rng)

    def random_masks(n):
        m = np.zeros((n, p))
        for r in m:
            r[rng.choice(p, size, replace=False)] = 1
        return m

    def gradient(m):
        sel.forward(m)
        return sel.backward(np.ones((len(m), 1)), update=False)

    def optimal(steps):
        m = np.zeros(p)
        m[np.argsort(gradient(np.full((1, p), size / p))[0], kind="stable")[:size]] = 1
        for _s in range(steps):
            g = gradient(m[None])[0]
            on, off = np.flatnonzero(m), np.flatnonzero(m == 0)
            if not len(off):
                break
            a, b = on[g[on].argmax()], off[g[off].argmin()]
            if g[a] <= g[b]:
                break
            trial = m.copy()
            trial[a], trial[b] = 0, 1
            if sel.forward(trial[None])[0, 0] >= sel.forward(m[None])[0, 0]:
                break
            m = trial
        return m

    best_loss, best_mask, stale, seen = np.inf, random_masks(1)[0], 0, []
    for batch in range(max_batches):
        masks, weight = random_masks(mask_batch_size), np.ones(mask_batch_size)
        if batch >= phase_2_start:
            half = mask_batch_size // 2
            opt = optimal(5)
            masks[half], masks[half + 1], weight[half], weight[half + 1] = opt, best_mask, 5, 10
            for q in range(half + 2, mask_batch_size):
                masks[q] = opt
                on, off = np.flatnonzero(opt), np.flatnonzero(opt == 0)
                n = min(s_p, len(on), len(off))
                masks[q][rng.choice(on, n, replace=False)] = 0
                masks[q][rng.choice(off, n, replace=False)] = 1
        rows = rng.integers(0, len(x), data_batch_size)
        xb, yb = np.repeat(x[rows], len(masks), 0), np.repeat(y[rows], len(masks), 0)
        mb = np.tile(masks, (len(rows), 1))
        prob = learn.softmax(op.forward(np.concatenate((xb * mb, mb), axis=1)))
        loss = -np.log(np.maximum((prob * yb).sum(1), 1e-12)).reshape(len(rows), -1).mean(0)
        w = np.tile(weight, len(rows))[:, None]
        op.backward((prob - yb) * w / w.sum())
        seen.append((masks, loss, weight))
        if batch % 8 == 7:
            m, target, w = (np.concatenate([q[i] for q in seen]) for i in range(3))
            seen = []
            sel.backward(2 * w[:, None] * (sel.forward(m) - target[:, None]) / w.sum())
        if batch >= phase_2_start:
            if loss[mask_batch_size // 2] < best_loss - 1e-4:
                best_loss, best_mask, stale = float(loss[mask_batch_size // 2]), masks[mask_batch_size // 2].copy(), 0
            else:
                stale += 1
                if stale >= early_stopping_patience:
                    break
    return ranked(-gradient(optimal(12)[None])[0], f.k)


def graph_gradient(full: np.ndarray, y: np.ndarray, chosen: list[int], w0: np.ndarray, noisy: list[tuple], alpha: float, cells: int = 1 << 22) -> np.ndarray:
    """The loss gradients of the input weights of all features, summed over noisy copies (wl, wr, wo), in the graph of all rows.

    The graph is made anew in blocks of about `cells` cosines, so that memory stays linear in the rows.
    """
    xb, n = full[:, chosen], len(full)
    z = xb / np.maximum(1e-12, np.linalg.norm(xb, axis=1, keepdims=True))
    step = max(1, cells // n)

    def blocks():
        for at in range(0, n, step):
            c = np.abs(z[at : at + step] @ z.T)
            a = (c >= np.quantile(c, alpha, axis=1, keepdims=True)).astype(float)
            yield slice(at, at + step), a / a.sum(1, keepdims=True)

    h0 = np.maximum(xb @ w0, 0)
    near = np.empty_like(h0)
    for at, a in blocks():
        near[at] = a @ h0
    own, others = np.zeros_like(h0), np.zeros_like(h0)
    for wl, wr, wo in noisy:
        z1 = near @ wl + h0 @ wr
        g1 = ((learn.softmax(np.maximum(z1, 0) @ wo) - y) / n @ wo.T) * (z1 > 0)
        own += g1 @ wr.T
        others += g1 @ wl.T
    for at, a in blocks():
        own += a.T @ others[at]
    return full.T @ (own * (h0 > 0))


def graph_network(f: Fold, epochs: int = 5, learning_rate: float = 1e-3, q: float = 2, n_dropouts: int = 10, dropout_prob: float = 0.5, batch_size: int = 16, alpha: float = 0.95, sigma: float = 0.1, f_correct: float = 0.0, hidden: tuple[int, int] = (64, 32), **_):
    """A subset grows by the feature whose input weights have the largest loss gradient in a graph network, averaged over noisy copies with units left out.

    Rows of a batch are neighbours when their cosine reaches the alpha quantile of the row.
    """
    rng = f.rng()
    x = np.concatenate((np.ones((len(f.x), 1)), learn.Scaler(f.x)(f.x)), axis=1)
    y = learn.one_hot(f.y, f.classes)
    anova_ = anova(f)
    anova_ = anova_ / (np.linalg.norm(anova_) or 1)

    def adjacency(h):
        z = h / np.maximum(1e-12, np.linalg.norm(h, axis=1, keepdims=True))
        c = np.abs(z @ z.T)
        a = (c >= np.quantile(c, alpha, axis=1, keepdims=True)).astype(float)
        return a / a.sum(1, keepdims=True)

    def run(par, xb, yb):
        w0, wl, wr, wo = par
        h0 = np.maximum(xb @ w0, 0)
        a = adjacency(xb)
        z1 = a @ h0 @ wl + h0 @ wr
        h1 = np.maximum(z1, 0)
        g = (learn.softmax(h1 @ wo) - yb) / len(xb)
        go = h1.T @ g
        g1 = (g @ wo.T) * (z1 > 0)
        gl, gr = (a @ h0).T @ g1, h0.T @ g1
        g0 = (a.T @ g1 @ wl.T + g1 @ wr.T) * (h0 > 0)
        return [xb.T @ g0, gl, gr, go]

    chosen, scores = [0], []
    shape = lambda a, b: rng.standard_normal((a, b)) * np.sqrt(2 / (a + b))
    wl, wr, wo = shape(*hidden), shape(*hidden), shape(hidden[1], f.classes)
    w0 = shape(1, hidden[0])
    while len(chosen) <= min(f.k, f.p):
        par = [w0, wl, wr, wo]
        adam = learn.Adam(par, learning_rate)
        for _e in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch_size):
                rows = order[at : at + batch_size]
                adam.step(run(par, x[rows][:, chosen], y[rows]))
        copies = []
        for _d in range(n_dropouts):
            keep0, keep1 = rng.random(hidden[0]) >= dropout_prob, rng.random(hidden[1]) >= dropout_prob
            copies.append(((wl + sigma * rng.standard_normal(wl.shape)) * keep0[:, None], (wr + sigma * rng.standard_normal(wr.shape)) * keep0[:, None], wo * keep1[:, None]))
        total = graph_gradient(x, y, chosen, w0, copies, alpha)
        norm = (np.abs(total / n_dropouts) ** q).sum(1) ** (1 / q)
        norm = norm / (np.linalg.norm(norm) or 1)
        norm[1:] = (1 - f_correct) * norm[1:] + f_correct * anova_
        norm[chosen] = -1
        new = int(norm.argmax())
        scores.append(float(norm[new]))
        chosen.append(new)
        w0 = np.concatenate((w0, shape(1, hidden[0])))
    return [j - 1 for j in chosen[1:]], scores


def _thinned(wide: DataFrame, by: list[str], seed: int, max_rows: int) -> DataFrame:
    """About max_rows rows of each group by a hash of the id, with n_rows, how many there were."""
    n = wide.groupBy(*by).agg(F.count("*").alias("n_rows"))
    rows = wide.join(n, by) if by else wide.crossJoin(F.broadcast(n))  # one row
    return rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * max_rows / F.greatest(F.col("n_rows"), F.lit(max_rows)))


def select(wide: DataFrame, fn: Callable, k: int, params: dict | None = None, seed: int = 0, by: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """(by, rank, j, score) by one selector for each group of wide (by, id, label, features). With max_rows also n_rows and rows_used: about as many rows of each group are used."""
    by = by or []
    rows = wide if max_rows is None else _thinned(wide, by, seed, max_rows)
    told = [] if max_rows is None else ["n_rows", "rows_used"]
    names = by or ["_all"]
    rows = rows.withColumn("_all", F.lit(0))
    options = dict(params or {})

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        codes, y = np.unique(part["label"].to_numpy(), return_inverse=True)
        order, scores = fn(Fold(np.array(part["features"].tolist(), float), y, len(codes), k, seed), **options)
        out = pd.DataFrame({"rank": np.arange(1, len(order) + 1, dtype=np.int32), "j": np.array(order, np.int32), "score": np.array(scores, float)})
        for c in reversed(names):
            out.insert(0, c, part[c].iloc[0])
        return out.assign(n_rows=part["n_rows"].iloc[0], rows_used=len(part)) if told else out

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", rank int, j int, score double" + "".join(f", {c} long" for c in told)
    return rows.groupBy(*names).applyInPandas(run, schema).select(*by, "rank", "j", "score", *told)


def forest_importance(wide: DataFrame, classes: int, trees: int = 200, depth: int | None = 3, extra: bool = True, seed: int = 0, tasks: int = 8, max_rows: int | None = None) -> DataFrame:
    """(j, score): mean importance over trees that grow in several tasks, each on all rows. With max_rows each task has a hash sample of its own of about as many, and a column n_rows tells how many there were."""
    tasks = max(1, min(tasks, trees))
    copies = wide.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    n = None
    if max_rows is not None:
        n = wide.count()
        copies = copies.where(F.pmod(F.xxhash64("id", "task", F.lit(seed)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * max_rows / max(n, max_rows))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        task = int(part["task"].iloc[0])
        _, y = np.unique(part["label"].to_numpy(), return_inverse=True)
        seeds = range(task, trees, tasks)
        f = learn.Forest(depth=depth, extra=extra, seeds=seeds).fit(np.array(part["features"].tolist(), float), y, classes, seed)
        return pd.DataFrame({"j": np.arange(len(f.importance), dtype=np.int32), "s": f.importance * len(seeds)})

    out = copies.groupBy("task").applyInPandas(run, "j int, s double").groupBy("j").agg((F.sum("s") / trees).alias("score"))
    return out if n is None else out.withColumn("n_rows", F.lit(n))
