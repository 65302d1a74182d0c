"""Filter scores: one aggregation over the long frame (id, label, j, x), partial sums before each shuffle.

What joins cells to a row for each feature names the features' side as the one to broadcast: left to itself, Spark may find that the
cells compress well enough to be it, and the driver then holds all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlab.operators.prefix import below
from featlab.operators.rank import column_order, top_k


def variance(long: DataFrame) -> DataFrame:
    return long.groupBy("j").agg(F.var_pop("x").alias("score"))


def low_variance_floor(long: DataFrame, p: float = 0.1) -> DataFrame:
    """One row: the variance floor p(1-p), p/10 if no feature passes, else 0, and how many pass."""
    passed = lambda t: F.count(F.when(F.col("score") > t, 1))
    row = variance(long).agg(passed(p * (1 - p)).alias("a"), passed(p / 10).alias("b"), F.count("*").alias("n"))
    return row.select(F.when(F.col("a") > 0, p * (1 - p)).when(F.col("b") > 0, p / 10).otherwise(0.0).alias("floor"), F.when(F.col("a") > 0, F.col("a")).when(F.col("b") > 0, F.col("b")).otherwise(F.col("n")).alias("n_pass"))


def low_variance(long: DataFrame, k: int, p: float = 0.1) -> DataFrame:
    """Ranking is by the variance of all features; the floor only tells how many pass."""
    return top_k(variance(long), k)


def second_moment(long: DataFrame) -> DataFrame:
    return long.groupBy("j").agg(F.avg(F.col("x") * F.col("x")).alias("score"))


def skewness(long: DataFrame) -> DataFrame:
    """|g1| from central moments; 0 for a constant feature. Null cells don't count."""
    m = long.groupBy("j").agg(F.avg("x").alias("_m"))
    c = long.join(F.broadcast(m), "j").withColumn("d", F.col("x") - F.col("_m"))
    parts = c.groupBy("j").agg(F.avg(F.col("d") ** 2).alias("m2"), F.avg(F.col("d") ** 3).alias("m3"))
    return parts.select("j", F.when(F.col("m2") > 0, F.abs(F.col("m3") / F.pow("m2", F.lit(1.5)))).otherwise(0.0).alias("score"))


def skewness_select(long: DataFrame, k: int, n: int, p: int, threshold: float = 1.0) -> DataFrame:
    """Features over the threshold (half of it unless p > 2n); all features if fewer than k pass."""
    limit = threshold if p / n > 2 else threshold / 2
    scores = skewness(long).withColumn("pass", (F.round("score", 9) > limit).cast("int")).withColumn("n_pass", F.sum("pass").over(Window.partitionBy(F.lit(0))))
    return top_k(scores.where((F.col("n_pass") < k) | (F.col("pass") == 1)), k)


def chi2(long: DataFrame) -> DataFrame:
    """Observed sums by class against those expected from the class shares."""
    cell = long.groupBy("j", "label").agg(F.sum("x").alias("o"), F.count("*").alias("n"))
    total = cell.groupBy("j").agg(F.sum("o").alias("s"), F.sum("n").alias("t"))
    e = F.col("n") / F.col("t") * F.col("s")
    return cell.join(total, "j").groupBy("j").agg(F.sum((F.col("o") - e) ** 2 / F.nullif(e, F.lit(0.0))).alias("score"))


def f_classif(long: DataFrame) -> DataFrame:
    """One-way analysis of variance."""
    cell = long.where("x IS NOT NULL").groupBy("j", "label").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    total = cell.groupBy("j").agg(F.sum("n").alias("t"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"), F.count("*").alias("c"))
    between = F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2) / (F.first("c") - 1)
    within = F.sum(F.col("n") * F.col("v")) / (F.first("t") - F.first("c"))
    return cell.join(total, "j").groupBy("j").agg((between / F.nullif(within, F.lit(0.0))).alias("score"))


def f_regression(long: DataFrame, target: str = "label") -> DataFrame:
    """F of a straight line: r² (n - 2) / (1 - r²)."""
    y = F.col(target).cast("double")
    s = long.where("x IS NOT NULL").groupBy("j").agg(F.count("*").alias("n"), F.covar_pop("x", y).alias("c"), F.stddev_pop("x").alias("a"), F.stddev_pop(y).alias("b"))
    r = F.col("c") / F.nullif(F.col("a") * F.col("b"), F.lit(0.0))
    return s.select("j", F.coalesce(r * r * (F.col("n") - 2) / F.nullif(1 - r * r, F.lit(0.0)), F.lit(0.0)).alias("score"))


def ks(long: DataFrame) -> DataFrame:
    """Mean over classes of the greatest distance between the class's distribution and the rest's.

    Counts by value first; sums over smaller values then go by buckets of values, so no task holds a feature.
    """
    value = long.groupBy("j", "x", "label").agg(F.count("*").alias("n"))
    totals = value.groupBy("j", "label").agg(F.sum("n").alias("nc"))
    whole = totals.groupBy("j").agg(F.sum("nc").alias("nt"))
    points = value.groupBy("j", "x").agg(F.sum("n").alias("all"))
    every = below(points, ["j"], "x", ["all"]).select("j", "x", (F.col("below_all") + F.col("all")).alias("upto"))
    own = below(value, ["j", "label"], "x", ["n"]).select("j", "label", "x", F.col("below_n").alias("a0"), (F.col("below_n") + F.col("n")).alias("a1"))
    # the distance is greatest just before or at a value of the class: between two of them only the rest rises
    at = own.join(every, ["j", "x"]).join(points, ["j", "x"]).join(totals, ["j", "label"]).join(whole, "j")
    rest = F.nullif(F.col("nt") - F.col("nc"), F.lit(0))
    now = F.abs(F.col("a1") / F.col("nc") - (F.col("upto") - F.col("a1")) / rest)
    before = F.abs(F.col("a0") / F.col("nc") - (F.col("upto") - F.col("all") - F.col("a0")) / rest)
    gap = at.groupBy("j", "label").agg(F.max(F.greatest(now, before)).alias("d"))
    return gap.groupBy("j").agg(F.avg("d").alias("score"))


def cei(long: DataFrame) -> DataFrame:
    """1 less the least share of other labels inside a class's span, rows in order of value, then id.

    A span is the class's first and last row; the rows inside it are counted by one aggregation over (feature, class),
    so nothing is sorted.
    """
    at = F.struct("x", "id")
    span = long.groupBy("j", "label").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n"))
    spans = span.groupBy("j").agg(F.collect_list(F.struct("label", "lo", "hi", "n")).alias("spans"))  # a struct for each class
    inside = long.join(F.broadcast(spans), "j").select("j", F.explode(F.filter("spans", lambda s: (at >= s["lo"]) & (at <= s["hi"]))).alias("s"))
    held = inside.groupBy("j", F.col("s.label").alias("label")).agg(F.count("*").alias("m"), F.max("s.n").alias("n"))
    share = 1 - F.col("n").cast("double") / F.col("m")
    return held.groupBy("j").agg((1 - F.min(share)).alias("score"))


def binned(long: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins of each feature, 0 for a constant one."""
    edge = long.groupBy("j").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins).cast("int"))
    return long.join(F.broadcast(edge), "j").select("id", "label", "j", F.coalesce(b, F.lit(0)).alias("b"))


def _entropy(counts: DataFrame, by: list[str]) -> DataFrame:
    t = counts.groupBy(*by).agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return counts.join(t, by).groupBy(*by).agg(F.sum(-p * F.log2(p)).alias("h"))


def symmetrical_uncertainty(bins: DataFrame) -> DataFrame:
    """(j, score): 2 (H(f) + H(y) - H(f, y)) / (H(f) + H(y)) of binned features and the label."""
    h1 = _entropy(bins.groupBy("j", "b").agg(F.count("*").alias("n")), ["j"]).withColumnRenamed("h", "h1")
    h2 = _entropy(bins.groupBy("j", "label").agg(F.count("*").alias("n")), ["j"]).withColumnRenamed("h", "h2")
    h12 = _entropy(bins.groupBy("j", "b", "label").agg(F.count("*").alias("n")), ["j"]).withColumnRenamed("h", "h12")
    top = F.col("h1") + F.col("h2")
    return h1.join(h2, "j").join(h12, "j").select("j", F.coalesce(2 * (top - F.col("h12")) / F.nullif(top, F.lit(0.0)), F.lit(0.0)).alias("score"))


def feature_uncertainty(bins: DataFrame, of: list[int] | None = None, known: list[int] | None = None) -> DataFrame:
    """(i, j, su): symmetrical uncertainty of two binned features, each pair once, i < j. of: i is one of these (then j may be less),
    j no feature of `known`."""
    a, b = bins.select("id", F.col("j").alias("i"), F.col("b").alias("bi")), bins.select("id", "j", "b")
    wanted = F.col("i") < F.col("j")
    if of is not None:
        a, wanted = a.where(F.col("i").isin(of)), wanted | ~F.col("j").isin(of)
    if known:
        b = b.where(~F.col("j").isin(known))
    both = a.join(b, "id").where(wanted).groupBy("i", "j", "bi", "b").agg(F.count("*").alias("n"))
    h12 = _entropy(both, ["i", "j"]).withColumnRenamed("h", "h12")
    h = _entropy(bins.groupBy("j", "b").agg(F.count("*").alias("n")), ["j"])
    top = F.col("ha") + F.col("hb")
    return h12.join(h.select(F.col("j").alias("i"), F.col("h").alias("ha")), "i").join(h.select("j", F.col("h").alias("hb")), "j").select("i", "j", F.coalesce(2 * (top - F.col("h12")) / F.nullif(top, F.lit(0.0)), F.lit(0.0)).alias("su"))


def cfs_select(long: DataFrame, k: int, patience: int = 5, bins: int = 10) -> list[int]:
    """Greedy merit: sum of su(f, y) over the root of m + 2 sum su(f, f'); ends when `patience` steps bring no better merit."""
    b = binned(long, bins).persist()
    try:
        return _greedy_merit(b, k, patience)
    finally:
        b.unpersist()


#: Pairs of features that a pass of CFS compares, about; the chosen feature's with all others at least.
CFS_PAIRS = 4096


def _greedy_merit(b: DataFrame, k: int, patience: int) -> list[int]:
    with_y = {r["j"]: r["score"] for r in symmetrical_uncertainty(b).collect()}  # a number for each feature
    by_use, fetched, with_f = sorted(with_y, key=lambda f: (-with_y[f], f)), [], {}

    def fetch(f: int) -> None:
        """What f, and features likely to follow it, share with all others."""
        if f in with_f:
            return
        new = [f, *[g for g in by_use if g != f and g not in with_f][: max(1, CFS_PAIRS // len(by_use)) - 1]]
        rows = feature_uncertainty(b, new, fetched).collect()
        with_f.update({g: {h: with_f[h].get(g, 0.0) for h in fetched} for g in new})
        for r in rows:
            with_f[r["i"]][r["j"]] = r["su"]
            if r["j"] in with_f:
                with_f[r["j"]][r["i"]] = r["su"]
        fetched.extend(new)

    shared = dict.fromkeys(with_y, 0.0)  # with what is chosen
    chosen, best, stale, sums, cross = [], 0.0, 0, 0.0, 0.0
    kept = []
    while len(chosen) < min(k, len(with_y)):
        def merit(f):
            return (sums + with_y[f]) / (len(chosen) + 1 + 2 * (cross + shared[f])) ** 0.5

        f = max((f for f in sorted(with_y) if f not in chosen), key=lambda f: (round(merit(f), 12), -f))
        now = merit(f)
        cross += shared[f]
        sums += with_y[f]
        chosen.append(f)
        if now > best + 1e-12:
            best, stale, kept = now, 0, list(chosen)
        else:
            stale += 1
            if stale >= patience:
                break
        if len(chosen) < min(k, len(with_y)):
            fetch(f)
            shared = {g: v + with_f[f].get(g, 0.0) for g, v in shared.items()}
    return kept


def univariate(long: DataFrame, k: int, score: str = "chi2") -> DataFrame:
    """The k best by chi2 or f_classif, in column order."""
    return column_order(top_k({"chi2": chi2, "f_classif": f_classif}[score](long), k))


def min_max_scaled(long: DataFrame) -> DataFrame:
    """To [0, 1]; a constant feature becomes 0."""
    edge = long.groupBy("j").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    return long.join(F.broadcast(edge), "j").withColumn("x", F.coalesce((F.col("x") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))).drop("_lo", "_hi")


def standardised(long: DataFrame) -> DataFrame:
    """Mean 0 and population deviation 1; a constant feature becomes 0."""
    m = long.groupBy("j").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    return long.join(F.broadcast(m), "j").withColumn("x", (F.col("x") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_m", "_s")


def label_profile(wide: DataFrame) -> DataFrame:
    """One row: the majority class (of equals the least), its count and percentage, number of classes and one over it."""
    c = wide.groupBy("label").agg(F.count("*").alias("n"))
    best = c.agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("majority"), F.max("n").alias("n_majority"), F.sum("n").alias("n"), F.count("*").alias("classes"))
    return best.select("majority", "n_majority", F.round(F.col("n_majority") * 100.0 / F.col("n"), 3).alias("majority_percent"), "classes", F.round(1.0 / F.col("classes"), 6).alias("class_fraction"))
