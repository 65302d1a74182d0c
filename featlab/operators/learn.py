"""Small learners on dense matrices, for one fold's rows in a pandas group. Labels are 0 to classes - 1."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def one_hot(y: np.ndarray, classes: int) -> np.ndarray:
    return np.eye(classes)[y]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Scaler:
    def __init__(self, x: np.ndarray):
        self.m, s = x.mean(0), x.std(0)
        self.s = np.where(s > 0, s, 1.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.m) / self.s


# --- trees ---


@dataclass
class Tree:
    """Nodes in arrays; feature -1 is a leaf. value: class shares, or one number for regression."""

    feature: list[int] = field(default_factory=list)
    limit: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    gain: np.ndarray | None = None

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        f, t, lo, hi = (np.array(v) for v in (self.feature, self.limit, self.left, self.right))
        while True:
            rows = np.flatnonzero(f[at] >= 0)
            if not len(rows):
                break
            k = at[rows]
            at[rows] = np.where(x[rows, f[k]] <= t[k], lo[k], hi[k])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)]


def _impurity(s: np.ndarray, w: np.ndarray, kind: str) -> np.ndarray:
    """s: sums of targets (…, c), w: weights (…). Gini, or variance up to a constant of the parent."""
    w = np.maximum(w, 1e-300)
    return w - (s * s).sum(-1) / w if kind == "gini" else -(s * s).sum(-1) / w


def grow(x: np.ndarray, t: np.ndarray, w: np.ndarray, rng, depth: int | None = None, features: int | None = None, random_limits: bool = False, min_split: int = 2, min_leaf: int = 1, max_leaves: int | None = None, kind: str = "gini") -> Tree:
    """t: one-hot targets, or (n, 1) numbers for kind "variance". The best node by gain grows first."""
    n, p = x.shape
    tree, gain = Tree(), np.zeros(p)
    tw = t * w[:, None]

    def leaf(rows):
        total = w[rows].sum()
        tree.feature.append(-1)
        tree.limit.append(0.0)
        tree.left.append(-1)
        tree.right.append(-1)
        tree.value.append(tw[rows].sum(0) / max(total, 1e-300))
        tree.weight.append(total)
        return len(tree.feature) - 1

    def best(rows, level):
        if len(rows) < min_split or (depth is not None and level >= depth):
            return None
        parent = _impurity(tw[rows].sum(0), w[rows].sum(), kind)
        if kind == "gini" and parent < 1e-12:
            return None
        order = rng.permutation(p)
        found, tried, k = None, 0, features or p
        while tried < p and (found is None or tried < k):
            some = order[tried : tried + k]
            tried += len(some)
            v = x[np.ix_(rows, some)]
            if random_limits:
                lo, hi = v.min(0), v.max(0)
                limit = lo + rng.random(len(some)) * (hi - lo)
                mask = v <= limit
                ok = (hi > lo) & (mask.sum(0) >= min_leaf) & ((~mask).sum(0) >= min_leaf)
                s, c = mask.T.astype(float) @ tw[rows], mask.T.astype(float) @ w[rows]
                g = parent - _impurity(s, c, kind) - _impurity(tw[rows].sum(0) - s, w[rows].sum() - c, kind)
                g[~ok] = -np.inf
                j = int(g.argmax())
                if g[j] > 1e-12 and (found is None or g[j] > found[0]):
                    found = (float(g[j]), int(some[j]), float(limit[j]))
            else:
                o = v.argsort(0, kind="stable")
                sv = np.take_along_axis(v, o, 0)
                s, c = tw[rows][o].cumsum(0)[:-1], w[rows][o].cumsum(0)[:-1]
                g = parent - _impurity(s, c, kind) - _impurity(tw[rows].sum(0) - s, w[rows].sum() - c, kind)
                g[sv[1:] <= sv[:-1]] = -np.inf
                if min_leaf > 1:
                    g[: min_leaf - 1] = -np.inf
                    g[len(g) - min_leaf + 1 :] = -np.inf
                if g.size:
                    i, j = np.unravel_index(g.argmax(), g.shape)
                    if g[i, j] > 1e-12 and (found is None or g[i, j] > found[0]):
                        found = (float(g[i, j]), int(some[j]), float((sv[i, j] + sv[i + 1, j]) / 2))
        return found

    rows = np.arange(n)
    open_ = [(leaf(rows), rows, 0, best(rows, 0))]
    leaves = 1
    while open_ and (max_leaves is None or leaves < max_leaves):
        at = max(range(len(open_)), key=lambda i: open_[i][3][0] if open_[i][3] else -1.0) if max_leaves else len(open_) - 1
        node, rows, level, split = open_.pop(at)
        if split is None:
            if max_leaves:
                break
            continue
        g, j, limit = split
        gain[j] += g
        mask = x[rows, j] <= limit
        a, b = rows[mask], rows[~mask]
        tree.feature[node], tree.limit[node] = j, limit
        tree.left[node], tree.right[node] = leaf(a), leaf(b)
        leaves += 1
        open_ += [(tree.left[node], a, level + 1, best(a, level + 1)), (tree.right[node], b, level + 1, best(b, level + 1))]
    tree.gain = gain / gain.sum() if gain.sum() > 0 else gain
    return tree


def since(group: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The running sum of v from the start of each stretch of equal groups."""
    total = v.cumsum()
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return total - np.repeat(total[first] - v[first], np.diff(np.append(first, len(v))))


def grow_whole(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, rng, features: int | None = None, rank: np.ndarray | None = None) -> Tree:
    """As `grow` without a bound of depth, all nodes of a level together. rank: of each value among its feature's, ascending."""
    n, p = x.shape
    k = min(p, features or p)
    rank = np.stack([np.unique(v, return_inverse=True)[1] for v in x.T], axis=1) if rank is None else rank
    span = int(rank.max(initial=0)) + 1
    rows, at, made, gains = np.arange(n), np.zeros(n, np.int64), 1, np.zeros(p)
    nodes, levels = np.zeros(1, np.int64), []
    while len(nodes):
        m = len(nodes)
        s = np.bincount(at * classes + y[rows], w[rows], m * classes).reshape(m, classes)
        size = s.sum(1)
        level = [np.full(m, -1), np.zeros(m), np.full(m, -1), np.full(m, -1), s / np.maximum(size, 1e-300)[:, None], size]
        levels.append(level)
        parent = _impurity(s, size, "gini")
        wanted = (parent >= 1e-12) & (np.bincount(at, minlength=m) > 1)
        order, best = rng.random((m, p)).argsort(1), np.zeros(m)
        for r in range(p):
            if r % k == 0:
                todo = wanted if r == 0 else wanted & (level[0] < 0)
            here = np.flatnonzero(todo[at])
            if not len(here):
                break
            key = at[here] * span + rank[rows[here], order[at[here], r]]
            o = here[key.argsort(kind="stable")]
            node, own = at[o], rank[rows[o], order[at[o], r]]
            edge = np.flatnonzero((node[1:] == node[:-1]) & (own[1:] != own[:-1]))  # the last row on a cut's left
            if not len(edge):
                continue
            c, v = y[rows[o]], w[rows[o]]
            alike = (node * classes + c).argsort(kind="stable")
            same = np.empty(len(o))  # weight of the row's class in its node before it
            same[alike] = since((node * classes + c)[alike], v[alike]) - v[alike]
            # of what is left of a cut: weight, squares of the classes' weights, their products with the node's
            a, aa, as_ = (since(node, q)[edge] for q in (v, 2 * v * same + v * v, s[node, c] * v))
            cut = node[edge]
            b = size[cut] - a
            g = parent[cut] - (a - aa / a) - (b - ((s * s).sum(1)[cut] - 2 * as_ + aa) / b)
            begin = np.flatnonzero(np.append(True, cut[1:] != cut[:-1]))
            most = np.maximum.reduceat(g, begin)
            top = np.flatnonzero(g == np.repeat(most, np.diff(np.append(begin, len(g)))))
            top = top[np.append(True, cut[top][1:] != cut[top][:-1])]  # the first of equals
            top = top[(g[top] > 1e-12) & (g[top] > best[cut[top]])]
            d = cut[top]
            j = order[d, r]
            lo, hi = x[rows[o[edge[top]]], j], x[rows[o[edge[top] + 1]], j]
            middle = (lo + hi) / 2
            best[d], level[0][d], level[1][d] = g[top], j, np.where(middle < hi, middle, lo)
        split = np.flatnonzero(level[0] >= 0)
        level[2][split], level[3][split] = made + 2 * np.arange(len(split)), made + 2 * np.arange(len(split)) + 1
        gains += np.bincount(level[0][split], best[split], p)
        rows, at = rows[level[0][at] >= 0], at[level[0][at] >= 0]
        place = np.zeros(m, np.int64)
        place[split] = np.arange(len(split))
        at = 2 * place[at] + (x[rows, level[0][at]] > level[1][at])
        nodes, made = made + np.arange(2 * len(split)), made + 2 * len(split)
    return Tree(*[np.concatenate(v) for v in zip(*levels, strict=True)], gains / gains.sum() if gains.sum() > 0 else gains)


class Forest:
    """Extra trees (random limits, all rows) or a random forest (bootstrap)."""

    def __init__(self, trees: int = 200, depth: int | None = 3, extra: bool = True, seeds=None):
        self.n, self.depth, self.extra, self.seeds = trees, depth, extra, seeds

    def fit(self, x, y, classes, seed=0):
        t, m = one_hot(y, classes), max(1, int(np.sqrt(x.shape[1])))
        self.trees = []
        whole = self.depth is None and not self.extra
        rank = np.stack([np.unique(v, return_inverse=True)[1] for v in np.asarray(x).T], axis=1) if whole else None
        for s in self.seeds if self.seeds is not None else range(self.n):
            rng = np.random.default_rng([seed, int(s)])
            w = np.ones(len(x)) if self.extra else np.bincount(rng.integers(0, len(x), len(x)), minlength=len(x)).astype(float)
            rows = np.flatnonzero(w)
            if whole:
                self.trees.append(grow_whole(x[rows], y[rows], w[rows], classes, rng, m, rank[rows]))
            else:
                self.trees.append(grow(x[rows], t[rows], w[rows], rng, self.depth, m, self.extra))
        self.importance = np.mean([q.gain for q in self.trees], axis=0)
        return self

    def predict_proba(self, x):
        return np.mean([q.predict(x) for q in self.trees], axis=0)


class DecisionTree:
    def __init__(self, **options):
        self.options = options

    def fit(self, x, y, classes, seed=0, weight=None):
        w = np.ones(len(x)) if weight is None else weight
        self.tree = grow(x, one_hot(y, classes), w, np.random.default_rng(seed), **self.options)
        self.importance = self.tree.gain
        return self

    def predict_proba(self, x):
        return self.tree.predict(x)


def balanced_weights(y: np.ndarray, classes: int) -> np.ndarray:
    c = np.bincount(y, minlength=classes)
    return (len(y) / (np.count_nonzero(c) * np.maximum(c, 1)))[y]


class AdaBoost:
    """SAMME over trees of some depth; a member's weight is rate (log odds of its accuracy + log(classes - 1))."""

    def __init__(self, n: int = 100, rate: float = 5.0, depth: int = 5):
        self.n, self.rate, self.depth = n, rate, depth

    def fit(self, x, y, classes, seed=0):
        w, self.members = np.full(len(x), 1 / len(x)), []
        for k in range(self.n):
            t = DecisionTree(depth=self.depth).fit(x, y, classes, seed + k, w)
            wrong = t.predict_proba(x).argmax(1) != y
            e = w[wrong].sum() / w.sum()
            if e <= 0:
                self.members.append((1.0, t))
                break
            if e >= 1 - 1 / classes:
                break
            a = self.rate * (np.log((1 - e) / e) + np.log(max(classes - 1, 1)))
            self.members.append((a, t))
            w = w * np.exp(np.minimum(a * wrong, 500))
            w /= w.sum()
            if not np.isfinite(w).all() or w.max() > 1 - 1e-12:
                break
        self.classes = classes
        total = sum(a for a, _ in self.members) or 1.0
        self.importance = sum((a * t.importance for a, t in self.members), np.zeros(x.shape[1])) / total
        return self


    def predict_proba(self, x):
        """Shares of the members' weights; even ones without members."""
        votes = np.zeros((len(x), self.classes))
        for a, t in self.members:
            votes[np.arange(len(x)), t.predict_proba(x).argmax(1)] += a
        total = votes.sum(1, keepdims=True)
        return np.where(total > 0, votes / np.where(total > 0, total, 1), 1 / self.classes)


class Boosting:
    """Gradient boosting of the logistic loss, two classes."""

    def __init__(self, n: int = 100, rate: float = 0.1, depth: int = 3):
        self.n, self.rate, self.depth = n, rate, depth

    def fit(self, x, y, classes=2, seed=0):
        p = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.start = f = np.full(len(x), np.log(p / (1 - p)))
        self.trees, self.start = [], float(f[0]) if len(f) else 0.0
        for k in range(self.n):
            prob = 1 / (1 + np.exp(-f))
            g = y - prob
            t = grow(x, g[:, None], np.ones(len(x)), np.random.default_rng([seed, k]), self.depth, kind="variance")
            at = t.leaves(x)
            top, low = np.bincount(at, g, len(t.feature)), np.bincount(at, prob * (1 - prob), len(t.feature))
            t.value = [np.array([v]) for v in self.rate * top / np.maximum(low, 1e-9)]
            f = f + t.predict(x)[:, 0]
            self.trees.append(t)
        return self


def tree_shap(tree: Tree, x: np.ndarray) -> np.ndarray:
    """(n, p, outputs) Shapley values of a tree whose unknown features follow the training weights, exact.

    Leaf by leaf: with some features known, a leaf is reached with the product of o (1 if the row meets the path's conditions on a known
    feature, else 0) and w (the share of weight that the path keeps at its splits on an unknown one). Sums over all subsets of the path's
    features go by their sizes, as coefficients of the product of w + o z.
    """
    from math import factorial

    out = np.zeros((len(x), x.shape[1], len(tree.value[0])))

    def visit(node: int, path: dict[int, tuple[np.ndarray, float]]) -> None:
        f = tree.feature[node]
        if f >= 0:
            low = x[:, f] <= tree.limit[node]
            whole = tree.weight[tree.left[node]] + tree.weight[tree.right[node]]
            for child, meets in ((tree.left[node], low), (tree.right[node], ~low)):
                o, w = path.get(f, (np.ones(len(x), bool), 1.0))
                visit(child, path | {f: (o & meets, w * tree.weight[child] / whole)})
            return
        d = len(path)
        for f, (o, w) in path.items():
            by_size = np.ones((1, len(x)))
            for g, (og, wg) in path.items():
                if g != f:
                    grown = np.zeros((len(by_size) + 1, len(x)))
                    grown[:-1] += wg * by_size
                    grown[1:] += og * by_size
                    by_size = grown
            share = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
            out[:, f] += ((o - w) * (share @ by_size))[:, None] * tree.value[node]

    visit(0, {})
    return out


def shap_importance(trees: list[Tree], x: np.ndarray, block: int = 256) -> np.ndarray:
    """The mean over all rows and outputs of the absolute sum of the trees' Shapley values, by feature; blocks of rows bound the memory."""
    total = np.zeros(x.shape[1])
    for at in range(0, len(x), block):
        s = np.abs(sum(tree_shap(t, x[at : at + block]) for t in trees))
        total += s.mean(2).sum(0)
    return total / max(1, len(x))


# --- linear and kernel ---


def minimise(loss, z: np.ndarray, steps: int = 100, memory: int = 10) -> np.ndarray:
    """L-BFGS with halving steps; loss gives value and gradient."""
    f, g = loss(z)
    ss, ys = [], []
    for _ in range(steps):
        d = -g
        alphas = []
        for s, y in zip(reversed(ss), reversed(ys), strict=True):
            a = s @ d / (y @ s)
            alphas.append(a)
            d = d - a * y
        if ss:
            d = d * (ss[-1] @ ys[-1]) / (ys[-1] @ ys[-1])
        for (s, y), a in zip(zip(ss, ys, strict=True), reversed(alphas), strict=True):
            d = d + s * (a - y @ d / (y @ s))
        t, slope = 1.0, g @ d
        if slope >= 0:
            d, slope = -g, -(g @ g)
        while True:
            new = z + t * d
            fn, gn = loss(new)
            if fn <= f + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = new - z, gn - g
        if s @ y > 1e-12:
            ss, ys = [*ss, s][-memory:], [*ys, y][-memory:]
        done = abs(f - fn) <= 1e-9 * max(1, abs(f)) or np.abs(gn).max() < 1e-5
        z, f, g = new, fn, gn
        if done:
            break
    return z


class Logistic:
    """Multinomial with an L2 penalty of 1/(2C)."""

    def __init__(self, c: float = 1.0, steps: int = 200):
        self.c, self.steps = c, steps

    def fit(self, x, y, classes, seed=0):
        t, a = one_hot(y, classes), np.concatenate((x, np.ones((len(x), 1))), axis=1)

        def loss(z):
            w = z.reshape(a.shape[1], classes)
            p = softmax(a @ w)
            f = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum() * self.c + 0.5 * (w[:-1] ** 2).sum()
            g = self.c * a.T @ (p - t)
            g[:-1] += w[:-1]
            return f, g.ravel()

        self.w = minimise(loss, np.zeros(a.shape[1] * classes), self.steps).reshape(a.shape[1], classes)
        self.importance = np.abs(self.w[:-1]).mean(1)
        return self

    def predict_proba(self, x):
        return softmax(x @ self.w[:-1] + self.w[-1])


class LinearSVM:
    """One class against the rest, squared hinge; L2 by Newton steps on the active rows, L1 by accelerated proximal steps."""

    def __init__(self, c: float = 1.0, penalty: str = "l2", steps: int = 200, tol: float = 1e-3):
        self.c, self.penalty, self.steps, self.tol = c, penalty, steps, tol

    def _l2(self, a, s):
        w = np.zeros(a.shape[1])
        reg = np.eye(a.shape[1])
        active = np.ones(len(a), bool)
        for _ in range(30):
            m = a[active]
            new = np.linalg.solve(reg + 2 * self.c * m.T @ m, 2 * self.c * m.T @ s[active])
            now = s * (a @ new) < 1
            done = (now == active).all() or np.abs(new - w).max() < 1e-9
            w, active = new, now
            if done:
                break
        return w

    def _l1(self, a, s):
        w = v = np.zeros(a.shape[1])
        step, t = 1 / (2 * self.c * np.linalg.norm(a, 2) ** 2 + 1e-12), 1.0
        for _ in range(self.steps):
            slack = np.maximum(0, 1 - s * (a @ v))
            z = v + step * 2 * self.c * a.T @ (s * slack)
            new = np.sign(z) * np.maximum(np.abs(z) - step, 0)
            tn = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v = new + (t - 1) / tn * (new - w)
            done = np.abs(new - w).max() < self.tol * max(1e-6, np.abs(new).max())
            w, t = new, tn
            if done:
                break
        return w

    def fit(self, x, y, classes, seed=0):
        a = np.concatenate((x, np.ones((len(x), 1))), axis=1)
        targets = range(classes) if classes > 2 else [1]
        fit = self._l1 if self.penalty == "l1" else self._l2
        self.w = np.stack([fit(a, np.where(y == c, 1.0, -1.0)) for c in targets])
        self.importance = np.linalg.norm(self.w[:, :-1], axis=0)
        return self

    def decision(self, x):
        d = x @ self.w[:, :-1].T + self.w[:, -1]
        return d if d.shape[1] > 1 else np.concatenate((-d, d), axis=1)


#: Numbers of a rows x rows matrix that a task holds at most (4 GB).
SQUARE = 1 << 29


def square(n: int, m: int, copies: int = 1) -> None:
    """ValueError where matrices of n x m numbers are too large for a task."""
    if n * m * copies > SQUARE:
        raise ValueError(f"{copies} matrices of {n} x {m} rows don't fit in a task; set max_rows, or take a selector without them")


class KernelSVM:
    """RBF, one class against the rest, the dual by coordinate steps; the offset is part of the kernel. gamma: scale."""

    def __init__(self, c: float = 1.0, sweeps: int = 20):
        self.c, self.sweeps = c, sweeps

    def kernel(self, x):
        square(len(x), len(self.x))
        d = (x * x).sum(1)[:, None] + (self.x * self.x).sum(1)[None] - 2 * x @ self.x.T
        return np.exp(-self.gamma * np.maximum(d, 0)) + 1.0

    def fit(self, x, y, classes, seed=0):
        self.scale = Scaler(x)
        self.x = self.scale(x)
        v = self.x.var()
        self.gamma = 1 / (x.shape[1] * v) if v > 0 else 1.0
        k = self.kernel(self.x)
        self.a = np.zeros((len(x), classes))
        diag = np.diag(k)
        for c in range(classes):
            s, a, f = np.where(y == c, 1.0, -1.0), np.zeros(len(x)), np.zeros(len(x))
            for _ in range(self.sweeps):
                moved = 0.0
                for i in range(len(x)):
                    new = min(self.c, max(0.0, a[i] + (1 - s[i] * f[i]) / diag[i]))
                    if abs(new - a[i]) > 1e-6:
                        f += (new - a[i]) * s[i] * k[:, i]
                        moved = max(moved, abs(new - a[i]))
                        a[i] = new
                if moved < 1e-3:
                    break
            self.a[:, c] = a * s
        return self

    def decision(self, x):
        z = self.scale(x)
        return np.concatenate([self.kernel(z[k : k + 1024]) @ self.a for k in range(0, len(z), 1024)]) if len(z) else np.zeros((0, self.a.shape[1]))

    def predict_proba(self, x):
        return softmax(2 * self.decision(x))


class KNN:
    def __init__(self, k: int = 5):
        self.k = k

    def fit(self, x, y, classes, seed=0):
        self.scale = Scaler(x)
        self.x, self.t = self.scale(x), one_hot(y, classes)
        return self

    def predict_proba(self, x):
        z, out = self.scale(x), []
        for at in range(0, len(z), 1024):
            q = z[at : at + 1024]
            d = (q * q).sum(1)[:, None] + (self.x * self.x).sum(1)[None] - 2 * q @ self.x.T
            out.append(self.t[np.argsort(d, axis=1, kind="stable")[:, : self.k]].mean(1))
        return np.concatenate(out) if out else np.zeros((0, self.t.shape[1]))


class LDA:
    def fit(self, x, y, classes, seed=0):
        self.scale = Scaler(x)
        z = self.scale(x)
        n = np.bincount(y, minlength=classes)
        m = np.stack([z[y == c].mean(0) if n[c] else np.zeros(z.shape[1]) for c in range(classes)])
        r = z - m[y]
        inv = np.linalg.pinv(r.T @ r / max(1, len(z) - np.count_nonzero(n)))
        self.w = inv @ m.T
        self.b = -0.5 * np.einsum("cp,pq,cq->c", m, inv, m) + np.log(np.maximum(n / n.sum(), 1e-12))
        return self

    def predict_proba(self, x):
        return softmax(self.scale(x) @ self.w + self.b)


def evaluator(name: str):
    """The classifiers that judge selections, with the benchmark's settings."""
    return {"LR": Logistic, "SVM": KernelSVM, "RF": lambda: Forest(300, None, False), "KNN": KNN, "ETREE": Forest, "LDA": LDA, "ADABOOST": AdaBoost}[name.upper()]()


# --- metrics ---


def auc(y: np.ndarray, s: np.ndarray) -> float:
    """Of 0/1 labels, mean ranks for ties; nan with one class."""
    pos = int(y.sum())
    if pos in (0, len(y)):
        return float("nan")
    _, at, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = np.cumsum(n) - (n - 1) / 2
    return float((rank[at][y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))


def judged(y: np.ndarray, p: np.ndarray, threshold: float = 0.5) -> dict[str, float]:
    """Accuracy, AUC (over classes for more than two) and weighted precision, recall and F1."""
    classes = p.shape[1]
    hat = (p[:, 1] >= threshold).astype(int) if classes == 2 else p.argmax(1)
    a = auc(y == 1, p[:, 1]) if classes == 2 else float(np.nanmean([auc(y == c, p[:, c]) for c in range(classes)]))
    n = np.bincount(y, minlength=classes)
    tp = np.array([((hat == c) & (y == c)).sum() for c in range(classes)])
    given = np.bincount(hat, minlength=classes)
    pr, re = tp / np.maximum(given, 1), tp / np.maximum(n, 1)
    f = 2 * pr * re / np.where(pr + re > 0, pr + re, 1)
    w = n / n.sum()
    return {"accuracy": float((hat == y).mean()), "auc": a, "precision": float(pr @ w), "recall": float(re @ w), "f1": float(f @ w)}


def permutation_importance(score, x: np.ndarray, repeats: int, seed: int = 0) -> np.ndarray:
    """The mean drop of score(x) when a column is shuffled."""
    rng, base = np.random.default_rng(seed), score(x)
    out = np.zeros(x.shape[1])
    for j in range(x.shape[1]):
        z = x.copy()
        for _ in range(repeats):
            z[:, j] = x[rng.permutation(len(x)), j]
            out[j] += (base - score(z)) / repeats
    return out


# --- networks ---


class Net:
    """Dense layers with manual gradients and Adam. acts: relu, tanh, sigmoid or linear for each layer."""

    def __init__(self, sizes: list[int], acts: list[str], rng, rate: float = 1e-3, kind=np.float64):
        self.w = [(rng.standard_normal((a, b)) * np.sqrt(2 / (a + b))).astype(kind) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b, kind) for b in sizes[1:]]
        self.acts, self.adam = acts, Adam([*self.w, *self.b], rate)

    def forward(self, x):
        self.h = [x]
        for w, b, a in zip(self.w, self.b, self.acts, strict=True):
            z = self.h[-1] @ w + b
            self.h.append(np.maximum(z, 0) if a == "relu" else np.tanh(z) if a == "tanh" else 1 / (1 + np.exp(-np.clip(z, -50, 50))) if a == "sigmoid" else z)
        return self.h[-1]

    def backward(self, g, update: bool = True):
        """g: the loss's gradient at the output. The gradient at the input; parameters move if update."""
        gw, gb = [], []
        for k in range(len(self.w) - 1, -1, -1):
            h, a = self.h[k + 1], self.acts[k]
            g = g * ((h > 0) if a == "relu" else 1 - h * h if a == "tanh" else h * (1 - h) if a == "sigmoid" else 1.0)
            gw.append(self.h[k].T @ g)
            gb.append(g.sum(0))
            g = g @ self.w[k].T
        if update:
            self.adam.step([*gw[::-1], *gb[::-1]])
        return g


class Adam:
    def __init__(self, params, rate=1e-3):
        self.p, self.rate, self.t = params, rate, 0
        self.m, self.v, self.own = ([np.zeros_like(p) for p in params] for _ in range(3))

    def step(self, grads):
        self.t += 1
        for p, g, m, v, own in zip(self.p, grads, self.m, self.v, self.own, strict=True):  # in place: most of the time goes into memory
            m *= 0.9
            np.multiply(g, 0.1, out=own)
            m += own
            v *= 0.999
            own *= g
            own *= 0.01
            v += own
            np.multiply(v, 1 / (1 - 0.999**self.t), out=own)
            np.sqrt(own, out=own)
            own += 1e-8
            np.divide(m, own, out=own)
            own *= self.rate / (1 - 0.9**self.t)
            p -= own
