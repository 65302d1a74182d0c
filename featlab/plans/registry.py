"""The selectors by name, their settings and groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from featlab.operators import selectors as S

# The benchmark's K grid, folds, evaluators and settings.
K_LIST = (1, 5, 10, 30, 60)
FOLDS, FALLBACK_FOLDS, SEED, THRESHOLD = 5, 2, 0, 0.5
EVALUATORS = ("ETREE", "LR", "SVM", "RF", "KNN", "LDA")
SETTINGS: dict[str, dict[str, object]] = {
    "Skewness": {"skew_threshold": 1},
    "CFS": {"t": 5},
    "MCFS": {"metric": "euclidean", "neighbor_mode": "knn", "weight_mode": "heat_kernel"},
    "RFS": {"gamma": 0.01, "max_iter": 1000},
    "ReliefF": {"n_neighbors": 10},
    "GRAPH": {"lambda1": 0.8, "lambda2": 0.8, "rho": 0.1, "max_iter": 300},
    "low_variance": {"p": 0.1},
    "LS": {"metric": "euclidean", "neighbor_mode": "knn", "weight_mode": "heat_kernel"},
    "SVM_RBF": {"C": 1, "gamma": "scale"},
    "CEI_GA": {"pre_keep": 50, "ga_beta": 2, "ga_pop": 20, "ga_gen": 50, "cv_splits": 5},
    "SVM_Forward": {"C": 1},
    "SHAP": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
    "SVM_Backward": {"C": 0.1, "penalty": "l1", "tol": 0.05},
    "DecisionTree_Backward": {"max_depth": 4, "min_samples_split": 10, "min_samples_leaf": 5, "max_leaf_nodes": 15},
    "DecisionTree_Forward": {"max_depth": 4, "min_samples_split": 10, "min_samples_leaf": 5, "max_leaf_nodes": 15},
    "AdaBoost": {"n_estimators": 100, "learning_rate": 5, "max_depth": 5},
    "ETree": {"n_estimators": 200, "max_depth": 3},
    "CT": {"t": 1},
    "CAE": {"num_epochs": 800, "batch_size": 16},  # the published training, beyond the 16 that its run identity names
    "DLFS": {"data_batch_size": 16, "mask_batch_size": 16, "s": 5, "s_p": 2, "phase_2_start": 600, "max_batches": 1500, "early_stopping_patience": 60},
    "UFS": {"epochs_number": 200, "batch_size_value": 16, "loss_weight_1": 0.0078125, "p_learning_rate": 0.001},
    "SVC": {"C": 1, "penalty": "l2"},
    "Univariate": {"score_func": "chi2"},
    "alpha_investing": {"w0": 10, "dw": 0.01},
    "mRMR": {"relevance": "f", "denominator": "mean"},
    "GRACES": {"epochs": 5, "learning_rate": 0.001, "q": 2, "n_dropouts": 10, "dropout_prob": 0.5, "batch_size": 16, "alpha": 0.95, "sigma": 0.1, "f_correct": 0},
    "DT": {},
    "LeadingEV": {},
}
# The order of each group's work list.
GROUPS: dict[str, tuple[str, ...]] = {
    "All": ("ETree", "AdaBoost", "Univariate", "low_variance", "SVC", "LS", "MCFS", "DT", "Skewness", "alpha_investing", "SHAP", "ReliefF", "mRMR", "CT", "LeadingEV", "RFS", "SVM_Forward", "CEI_GA", "SVM_RBF", "DecisionTree_Forward", "DecisionTree_Backward", "SVM_Backward", "DLFS", "GRAPH", "CAE", "GRACES", "UFS"),
    "Fast": ("ETree", "AdaBoost", "Univariate", "low_variance", "SVC", "LS", "MCFS", "DT", "Skewness", "alpha_investing", "SHAP", "ReliefF", "mRMR", "CT", "LeadingEV", "RFS", "SVM_RBF", "SVM_Forward", "CEI_GA"),
    "GPU": ("DLFS", "CAE", "GRACES", "SVM_RBF", "UFS"),
    "Slow": ("GRAPH", "RFS", "DecisionTree_Backward", "SVM_Backward"),
}


@dataclass
class Entry:
    fn: Callable
    prefix: bool  #: the selection at a smaller K is the first part of that at a larger one
    kind: str


REGISTRY: dict[str, Entry] = {
    "ETree": Entry(S.extra_trees, True, "supervised"),
    "AdaBoost": Entry(S.ada_boost, True, "supervised"),
    "Univariate": Entry(S.univariate, False, "supervised"),
    "low_variance": Entry(S.variance, True, "unsupervised"),
    "SVC": Entry(S.linear_svc, False, "supervised"),
    "LS": Entry(S.laplacian, True, "unsupervised with classes"),
    "MCFS": Entry(S.multi_cluster, False, "unsupervised with classes"),
    "DT": Entry(S.second_moment, True, "unsupervised"),
    "Skewness": Entry(S.skewness, False, "unsupervised"),
    "alpha_investing": Entry(S.alpha_investing, True, "supervised"),
    "SHAP": Entry(S.shapley, True, "supervised"),
    "ReliefF": Entry(S.relieff, True, "supervised with classes"),
    "mRMR": Entry(S.mrmr, True, "supervised"),
    "CT": Entry(S.thresholded_eigen, False, "unsupervised"),
    "LeadingEV": Entry(S.leading_eigenvector, True, "unsupervised"),
    "RFS": Entry(S.robust_regression, True, "supervised"),
    "SVM_Forward": Entry(S.svm_forward, True, "supervised"),
    "CEI_GA": Entry(S.class_span_genetic, True, "supervised"),
    "SVM_RBF": Entry(S.kernel_svm, True, "supervised"),
    "DecisionTree_Forward": Entry(S.tree_forward, True, "supervised"),
    "DecisionTree_Backward": Entry(S.tree_backward, False, "supervised"),
    "SVM_Backward": Entry(S.svm_backward, False, "supervised"),
    "DLFS": Entry(S.dual_network, False, "network"),
    "GRAPH": Entry(S.graph_fused, True, "supervised"),
    "CAE": Entry(S.concrete_autoencoder, False, "network"),
    "GRACES": Entry(S.graph_network, True, "network"),
    "UFS": Entry(S.fractal_autoencoder, False, "network"),
    "CFS": Entry(S.entropy_merit, False, "supervised"),
}


def register_selector(name: str, fn: Callable, prefix: bool = False, kind: str = "supervised", settings: dict | None = None) -> None:
    """fn takes a selectors.Fold and its settings as keywords and returns features, best first, and scores."""
    REGISTRY[name], SETTINGS[name] = Entry(fn, prefix, kind), settings or {}


def algorithms(group: str) -> list[str]:
    if group not in GROUPS:
        raise ValueError(f"no such group: {group}; there are {', '.join(GROUPS)}")
    return [a for a in GROUPS[group] if a in REGISTRY]


def comment(name: str) -> str:
    """The identity of a setting."""
    return "; ".join(f"{k}={v}" for k, v in SETTINGS.get(name, {}).items()) or "No_hyperparamters"


def settings_table(spark: SparkSession) -> DataFrame:
    """(algorithm, setting_no, comment, params map)."""
    rows = [(a, 1, comment(a), {k: str(v) for k, v in s.items()}) for a, s in SETTINGS.items()]
    return spark.createDataFrame(rows, "algorithm string, setting_no int, comment string, params map<string,string>")
