"""Scalar rules of the benchmark as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def performance_label(metric: Column, high: float = 0.9, low: float = 0.7) -> Column:
    """High above the upper limit, Low below the lower one, else Fair."""
    return F.when(metric > high, "High").when(metric < low, "Low").otherwise("Fair")


def hardness_label(metric: Column, high: float = 0.9, low: float = 0.7) -> Column:
    """High from the upper limit on, Low below the lower one, else Ok."""
    return F.when(metric >= high, "High").when(metric < low, "Low").otherwise("Ok")


def dataset_category(no_fs: Column, fs: Column) -> Column:
    """Fragile where selection makes the label worse, else Easy, Medium or Hard by the label with selection."""
    order = lambda c: F.when(c == "Low", 1).when(c == "Fair", 2).when(c == "High", 3)
    return F.when(order(fs) < order(no_fs), "Fragile").when(fs == "High", "Easy").when(fs == "Fair", "Medium").when(fs == "Low", "Hard")


def pn_class(ratio: Column) -> Column:
    return F.when(ratio < 1, "Below 1").when(ratio < 10, "Between 1 to 10").otherwise("Above 10")


def custom_round(x: Column) -> Column:
    """Three decimals from 0.001 on; below, the first digit that isn't zero, cut off; 0 stays."""
    size = F.abs(x)
    scale = F.pow(F.lit(10.0), -F.floor(F.log10(size)))
    return F.when(size >= 0.001, F.round(x, 3)).when(size > 0, F.signum(x) * F.floor(size * scale + 1e-9) / scale).otherwise(F.lit(0.0))


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.round(x.cast("double") * 100, digits))


def mean_std_label(mean: Column, std: Column, label: Column) -> Column:
    return F.concat(percent(mean, 1), F.lit(" ± "), percent(std, 2), F.lit(" ("), label, F.lit(")"))


def run_key(*parts: Column) -> Column:
    """Dataset, algorithm, N, P, K, hyperparameters, threshold and, if there, evaluator, joined by underscores."""
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def _parsed(key: Column, pick) -> Column:
    ok = F.filter(F.split(key, " ; "), lambda k: F.size(F.split(k, "_")) >= 6)
    many = F.array_join(F.transform(ok, lambda k: pick(F.split(k, "_"))), " ; ")
    return F.when(F.contains(key, F.lit(" ; ")), many).when(F.size(F.split(key, "_")) >= 6, pick(F.split(key, "_")))


def key_algorithm(key: Column) -> Column:
    """The second part of a key; of several keys joined by " ; ", all of theirs. Null with under six parts."""
    return _parsed(key, lambda p: F.get(p, F.lit(1)))


def key_hyperparameters(key: Column) -> Column:
    """The parts of a key from the sixth on."""
    return _parsed(key, lambda p: F.array_join(F.slice(p, F.lit(6), F.size(p)), "_"))


def dataset_name(name: Column) -> Column:
    """Without the suffix that sampling adds."""
    return F.regexp_replace(name, r"_\d+_samples", "")


def soft_threshold(a: Column, b: Column) -> Column:
    return F.signum(a) * F.greatest(F.abs(a) - b, F.lit(0.0))


def threshold_label(probability: Column, threshold: float, positive: int = 1, negative: int = 0) -> Column:
    return F.when(probability >= threshold, positive).otherwise(negative)


def k_percent(k: Column, p: Column) -> Column:
    return F.round(k * 100.0 / p, 3)


def ln_k(k: Column, p: Column) -> Column:
    """Of the ratio, not of the percentage."""
    return F.round(F.ln(k / p), 3)


def l2_normalised(features: Column) -> Column:
    """A row over its length, which counts as 1e-12 at least."""
    norm = F.greatest(F.sqrt(F.aggregate(features, F.lit(0.0), lambda a, v: a + v * v)), F.lit(1e-12))
    return F.transform(features, lambda v: v / norm)
