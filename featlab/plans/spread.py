"""The selectors by name, over all rows of a distributed matrix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.operators import filters, forests, genetic, graphs, networks, redundancy, selectors, solvers, spectral
from featlab.operators.rank import top_k
from featlab.plans.registry import REGISTRY, SETTINGS
from featlab.sources.matrices import to_long


def _classes(wide: DataFrame) -> int:
    return wide.select("label").distinct().count()


def _laplacian(wide: DataFrame, k: int, seed: int) -> DataFrame:
    p = len(wide.select("features").first()["features"])
    return top_k(graphs.laplacian_score(wide, graphs.affinity(wide, _classes(wide), "knn", "heat_kernel", t=float(p))), k)


def _skewness(wide: DataFrame, k: int, seed: int) -> DataFrame:
    n, p = wide.agg(F.count("*"), F.max(F.size("features"))).first()
    return filters.skewness_select(to_long(wide), k, n, p)


#: Each gives (rank, j, score) of a frame (id, label, features), with the registry's settings. A selector that is not here runs in one task.
SPREAD: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {
    "ETree": lambda wide, k, seed: top_k(forests.importances(wide, seed=seed), k),
    "AdaBoost": lambda wide, k, seed: top_k(forests.boosted_importances(wide, seed=seed), k),
    "Univariate": lambda wide, k, seed: filters.univariate(to_long(wide), k),
    "low_variance": lambda wide, k, seed: filters.low_variance(to_long(wide), k),
    "SVC": lambda wide, k, seed: solvers.svc_select(wide, k),
    "LS": _laplacian,
    "MCFS": lambda wide, k, seed: spectral.multi_cluster(wide, k),
    "DT": lambda wide, k, seed: top_k(filters.second_moment(to_long(wide)), k),
    "Skewness": _skewness,
    "alpha_investing": lambda wide, k, seed: redundancy.alpha_investing(wide, k),
    "SHAP": lambda wide, k, seed: top_k(forests.shap_select(wide, seed=seed), k),
    "ReliefF": lambda wide, k, seed: top_k(graphs.relieff(wide, min(_classes(wide), 10)), k),
    "mRMR": lambda wide, k, seed: redundancy.mrmr(wide, k),
    "CT": lambda wide, k, seed: solvers.thresholded_eigen(wide, k),
    "LeadingEV": lambda wide, k, seed: solvers.leading_eigenvector(wide, k),
    "RFS": lambda wide, k, seed: solvers.robust_regression(wide, k),
    "SVM_RBF": lambda wide, k, seed: solvers.kernel_select(wide, k, seed=seed),
    "CEI_GA": lambda wide, k, seed: genetic.class_span_genetic(wide, k, seed=seed),
    "CAE": lambda wide, k, seed: networks.concrete_autoencoder(wide, k, seed=seed),
    "SVM_Forward": lambda wide, k, seed: solvers.svm_wrapper(wide, k),
    "SVM_Backward": lambda wide, k, seed: solvers.svm_wrapper(wide, k, False, 0.1, solvers.sparse_support_vectors),
    "GRAPH": lambda wide, k, seed: solvers.graph_fused(wide, k),
}


def select(wide: DataFrame, name: str, k: int, seed: int = 0) -> list[int]:
    """The selected features, best first."""
    found = SPREAD[name](wide, k, seed) if name in SPREAD else selectors.select(wide, REGISTRY[name].fn, k, SETTINGS.get(name), seed)
    return [r["j"] for r in found.orderBy("rank").select("j").collect()]
