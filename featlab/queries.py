"""The registered queries of the reference's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featlab.functions import expressions as X
from featlab.operators import consensus, encoders, filters, forests, genetic, graphs, metrics, moments, networks, permutation, redundancy, selectors, solvers, spectral, splits
from featlab.operators.rank import at_least_kth, column_order, reversed_rank, tier, top_k
from featlab.plans import hard, peeling, pipeline, registry, results
from featlab.session import ensure_importable
from featlab.sources import matrices as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
K = 10
KS = [1, 5, 10, 30, 60]
EVALUATORS = ["ETREE", "LR", "SVM", "RF", "KNN", "LDA"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_importable(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])  # no minus zero


def _emb(spark, d):
    return M.embeddings(spark, d)


def _emb_long(spark, d):
    return M.to_long(_emb(spark, d))


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """A results table made from lineitem and part."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    ds = F.col("l_suppkey") % 20
    rows = li.join(part, "l_partkey").select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("seq"),
        F.concat(F.lit("R"), (F.col("l_suppkey") % 3).cast("string")).alias("repository"),
        F.concat(F.lit("D"), ds.cast("string")).alias("dataset"),
        F.when(F.col("l_linestatus") == "O", "FS").otherwise("HD").alias("fs"),
        F.col("p_type").alias("algorithm"),
        (100 + ds * 10).cast("int").alias("n"),
        (20 + ds * 5).cast("int").alias("p"),
        F.element_at(F.array(*[F.lit(k) for k in KS]), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("k"),
        F.concat(F.lit("h="), (F.col("l_linenumber") % 2).cast("string")).alias("hyper"),
        F.element_at(F.array(*[F.lit(e) for e in EVALUATORS]), (F.col("l_orderkey") % 6 + 1).cast("int")).alias("evaluator"),
        F.lit("Y").alias("perform_cv"),
        F.lit(5).alias("folds"),
        F.lit("0.5").alias("threshold"),
        F.round(0.55 + F.col("l_discount") * 4.4, 3).alias("avg_accuracy"),
        F.round(0.5 + F.col("l_tax") * 6, 3).alias("avg_auc"),
        F.round(F.col("l_quantity") / 1000, 3).alias("std_accuracy"),
        F.round(F.col("l_quantity") / 500, 3).alias("std_auc"),
    )
    return rows.withColumn("run_key", X.run_key(*[F.col(c) for c in ("dataset", "algorithm", "n", "p", "k", "hyper", "threshold", "evaluator")]))


# --- filters ---


@query
def fs_low_variance_topk(spark, d):
    return rounded(filters.low_variance(_emb_long(spark, d), K))


@query
def fs_low_variance_floor(spark, d):
    return filters.low_variance_floor(_emb_long(spark, d), 0.1)


@query
def fs_dt_diag_topk(spark, d):
    return rounded(top_k(filters.second_moment(_emb_long(spark, d)), K))


@query
def fs_skewness_topk(spark, d):
    wide = _emb(spark, d)
    shape = M.shape(wide).first()
    return rounded(filters.skewness_select(M.to_long(wide), K, shape["n"], shape["p"]))


@query
def fs_chi2_topk(spark, d):
    return rounded(filters.univariate(_emb_long(spark, d), K))


@query
def fs_chi2_lines(spark, d):
    return rounded(top_k(filters.chi2(M.to_long(M.lines_binary(spark, d))), 4), 3)


@query
def fs_f_classif_topk(spark, d):
    return rounded(top_k(filters.f_classif(_emb_long(spark, d)), K))


@query
def fs_f_classif_lines(spark, d):
    return rounded(top_k(filters.f_classif(M.to_long(M.lines_multi(spark, d))), 4))


@query
def fs_f_regression_topk(spark, d):
    return rounded(top_k(filters.f_regression(_emb_long(spark, d)), K))


@query
def fs_ks_topk(spark, d):
    return rounded(top_k(filters.ks(_emb_long(spark, d)), K))


@query
def fs_cei_rank(spark, d):
    return rounded(top_k(filters.cei(_emb_long(spark, d)), 50))


@query
def fs_cfs_entropy(spark, d):
    return rounded(top_k(filters.symmetrical_uncertainty(filters.binned(_emb_long(spark, d))), K))


@query
def cfs_feature_uncertainty(spark, d):
    return rounded(filters.feature_uncertainty(filters.binned(_emb_long(spark, d))))


@query
def topk_ascending(spark, d):
    return rounded(reversed_rank(top_k(filters.variance(_emb_long(spark, d)), K), K))


@query
def topk_column_order(spark, d):
    return rounded(column_order(top_k(filters.variance(_emb_long(spark, d)), K)))


@query
def kth_largest_mask(spark, d):
    scores = filters.second_moment(_emb_long(spark, d)).select("j", F.round("score", 4).alias("score"))
    return at_least_kth(scores, K)


@query
def second_tier(spark, d):
    return rounded(tier(filters.variance(_emb_long(spark, d)), K, 2))


# --- scaling and labels ---


@query
def matrix_shape(spark, d):
    return M.shape(_emb(spark, d))


@query
def matrix_long(spark, d):
    return rounded(_emb_long(spark, d))


@query
def column_slice(spark, d):
    wide = M.slice_features(_emb(spark, d), [5, 0, 63])
    return rounded(M.to_long(wide))


@query
def slice_by_selection(spark, d):
    long = _emb_long(spark, d)
    return rounded(M.slice_long(long, filters.low_variance(long, 3)).groupBy("j").agg(F.count("*").alias("n"), F.sum("x").alias("s")))


@query
def minmax_scale_stats(spark, d):
    return rounded(filters.min_max_scaled(M.to_long(M.lines_binary(spark, d))).groupBy("j").agg(F.avg("x").alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi")))


@query
def zscore_stats(spark, d):
    z = filters.standardised(M.to_long(M.lines_binary(spark, d)))
    return rounded(z.groupBy("j", "label").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var")))


@query
def row_l2_normalise(spark, d):
    wide = _emb(spark, d).withColumn("features", X.l2_normalised(F.col("features")))
    return rounded(M.to_long(wide))


@query
def label_profile(spark, d):
    return filters.label_profile(_emb(spark, d))


@query
def class_counts(spark, d):
    return _emb(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query
def label_rebase(spark, d):
    shifted = _emb(spark, d).withColumn("label", F.col("label") - 3)
    return M.rebase_labels(shifted).groupBy("label").agg(F.count("*").alias("n"))


@query
def label_dense_codes(spark, d):
    gaps = _emb(spark, d).withColumn("label", F.col("label") * 7 - 5)
    return M.dense_labels(gaps).groupBy("label").agg(F.count("*").alias("n"))


@query
def one_hot_counts(spark, d):
    hot = M.one_hot(_emb(spark, d), 10)
    return hot.select(F.posexplode("hot").alias("c", "v")).groupBy("c").agg(F.sum("v").alias("n"))


# --- P x P matrices ---


@query
def second_moment_matrix(spark, d):
    return rounded(moments.second_moments(_emb(spark, d)))


@query
def thresholded_covariance(spark, d):
    return rounded(moments.thresholded(_emb(spark, d), 1.0), 5)


@query
def sample_covariance(spark, d):
    return rounded(moments.covariance(_emb(spark, d)))


@query
def feature_correlation(spark, d):
    return rounded(moments.correlation(_emb(spark, d)), 5)


@query
def correlation_edges(spark, d):
    return moments.correlation_edges(_emb(spark, d), 0.1)


# --- graphs ---


@query
def knn_graph_binary(spark, d):
    return graphs.affinity(_emb(spark, d), 5, "knn", "binary")


@query
def knn_graph_binary_cosine(spark, d):
    return graphs.affinity(_emb(spark, d), 5, "knn", "binary", "cosine")


@query
def knn_graph_heat(spark, d):
    return rounded(graphs.affinity(_emb(spark, d), 5, "knn", "heat_kernel", t=1.0))


@query
def knn_graph_cosine(spark, d):
    return rounded(graphs.affinity(_emb(spark, d), 5, "knn", "cosine"))


@query
def supervised_fisher_graph(spark, d):
    return rounded(graphs.affinity(_emb(spark, d), 5, "supervised", "fisher"))


@query
def supervised_knn_graph(spark, d):
    return graphs.affinity(_emb(spark, d), 5, "supervised", "binary")


@query
def supervised_knn_graph_cosine(spark, d):
    return graphs.affinity(_emb(spark, d), 5, "supervised", "binary", "cosine")


@query
def supervised_heat_graph(spark, d):
    return rounded(graphs.affinity(_emb(spark, d), 5, "supervised", "heat_kernel"))


@query
def supervised_cosine_graph(spark, d):
    return rounded(graphs.affinity(_emb(spark, d), 5, "supervised", "cosine"))


@query
def relieff_graph(spark, d):
    return rounded(graphs.affinity(_emb(spark, d), 3, "supervised", "relieff"))


@query
def laplacian_score(spark, d):
    wide = _emb(spark, d)
    return rounded(top_k(graphs.laplacian_score(wide, graphs.affinity(wide, 10, "knn", "heat_kernel", t=64.0)), K))


@query
def relieff_score(spark, d):
    return rounded(top_k(graphs.relieff(_emb(spark, d), 10), K))


@query
def knn_classify(spark, d):
    wide = splits.train_test(_emb(spark, d), 0.5)
    return graphs.knn_votes(wide.where("train").drop("train"), wide.where("NOT train").drop("train"), 5)


@query
def one_nn_accuracy(spark, d):
    return rounded(graphs.nearest_other_accuracy(_emb(spark, d)))


# --- redundancy ---


@query
def mrmr_select(spark, d):
    return rounded(redundancy.mrmr(_emb(spark, d), 3))


@query
def mrmr_ks_max(spark, d):
    return rounded(redundancy.mrmr(_emb(spark, d), K, "ks", "max"))


@query
def alpha_investing_select(spark, d):
    return rounded(redundancy.alpha_investing(_emb(spark, d), 2))


# --- splits ---


@query
def stratified_folds(spark, d):
    return splits.stratified_folds(_emb(spark, d)).select("id", "label", "fold")


@query
def train_test_split(spark, d):
    return splits.train_test(_emb(spark, d), 0.2).select("id", "label", "train")


@query
def class_presence_repair(spark, d):
    wide = _emb(spark, d)
    train, test = splits.repair_classes(wide.where("id % 2 = 0 AND label <> 3"), wide.where("id % 2 = 1 AND label <> 4"))
    side = lambda df, s: df.groupBy("label").agg(F.count("*").alias("n")).withColumn("side", F.lit(s))
    return side(train, "train").unionByName(side(test, "test"))


@query
def singleton_duplication(spark, d):
    wide = _emb(spark, d).withColumn("label", F.when(F.col("id") < 3, F.col("id").cast("int") + 100).otherwise(F.col("label")))
    return splits.duplicate_singletons(wide).groupBy("label").agg(F.count("*").alias("n"))


@query
def peel_downsample(spark, d):
    return splits.peel(_emb(spark, d), 3).select("id", "label")


# --- metrics ---


def _pred(spark, d):
    """Predictions made from events: label, score and predicted class."""
    e = _events(spark, d)
    label = F.pmod(F.col("user_id"), F.lit(3)).cast("int")
    score = F.floor("value") / 100
    return e.select(F.col("event_id").alias("id"), label.alias("label"), score.alias("score"), F.pmod(F.col("user_id") + F.col("event_id") % 2, F.lit(3)).cast("int").alias("predicted"))


@query
def confusion_matrix(spark, d):
    return metrics.confusion(_pred(spark, d))


@query
def weighted_prf(spark, d):
    return rounded(metrics.weighted_prf(_pred(spark, d)))


@query
def auc_binary(spark, d):
    return rounded(metrics.auc_binary(_pred(spark, d)))


def _class_scores(spark, d):
    p = _pred(spark, d)
    cls = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return p.withColumn("class", cls).withColumn("score", F.round(F.col("score") * (F.col("class") + 1) % 1.0, 2))


@query
def auc_ovr(spark, d):
    return rounded(metrics.auc_ovr(_class_scores(spark, d)))


@query
def auc_ovo(spark, d):
    return rounded(metrics.auc_ovo(_class_scores(spark, d)))


@query
def pr_curve(spark, d):
    return rounded(metrics.pr_curve(_pred(spark, d)))


@query
def threshold_predict(spark, d):
    return _pred(spark, d).groupBy("label", X.threshold_label(F.col("score"), 0.5).alias("predicted")).agg(F.count("*").alias("n"))


# --- consensus and robustness ---


def _ranks(spark, d):
    """Fold lists from events: fold event_type, feature user_id % 40, importance value; each feature at its best value in a fold, the 30 best."""
    best = _events(spark, d).groupBy(F.col("event_type").alias("fold"), (F.col("user_id") % 40).cast("int").alias("j")).agg(F.max(F.round("value", 4)).alias("importance"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("importance"), "j"))).where("rank <= 30")


@query
def consensus_frequency(spark, d):
    return consensus.by_frequency(_ranks(spark, d), K)


@query
def consensus_avg_rank(spark, d):
    return rounded(consensus.by_average_rank(_ranks(spark, d), K))


@query
def consensus_mean_fi(spark, d):
    return rounded(consensus.by_mean_importance(_ranks(spark, d), K))


def _two_sets(spark, d):
    r = _ranks(spark, d)
    return r.where("fold = 'click' AND rank <= 20"), r.where("fold = 'view' AND rank <= 15")


@query
def feature_overlap(spark, d):
    return consensus.overlap(*_two_sets(spark, d)).select("common", "only_first", "only_second", F.round("overlap", 6).alias("overlap"))


@query
def feature_mi(spark, d):
    return rounded(consensus.overlap(*_two_sets(spark, d)).select("mutual_information"))


@query
def feature_set_difference(spark, d):
    a, b = _two_sets(spark, d)
    mark = lambda df, s: df.select("j", F.lit(s).alias("side"))
    return mark(a.select("j").intersect(b.select("j")), "both").unionByName(mark(a.select("j").exceptAll(b.select("j")), "first")).unionByName(mark(b.select("j").exceptAll(a.select("j")), "second"))


# --- results ---


@query
def run_key_build(spark, d):
    return runs(spark, d).groupBy("run_key").agg(F.count("*").alias("n_rows"))


@query
def run_key_parse(spark, d):
    keys = runs(spark, d).select("run_key").distinct()
    two = keys.select(F.concat("run_key", F.lit(" ; "), F.reverse("run_key")).alias("run_key"))
    bad = keys.select(F.substring("run_key", 1, 4).alias("run_key")).distinct()
    return keys.unionByName(two).unionByName(bad).select("run_key", X.key_algorithm(F.col("run_key")).alias("algorithm"), X.key_hyperparameters(F.col("run_key")).alias("hyper"))


@query
def pn_classification(spark, d):
    r = runs(spark, d).select("dataset", "n", (F.col("p") * F.col("k")).alias("p")).distinct()
    return r.select("dataset", "n", "p", F.round(F.col("p") / F.col("n"), 3).alias("pn"), X.pn_class(F.col("p") / F.col("n")).alias("pn_class"))


@query
def k_ratios(spark, d):
    return runs(spark, d).select("p", "k").distinct().select("p", "k", X.k_percent(F.col("k"), F.col("p")).alias("k_percent"), X.ln_k(F.col("k"), F.col("p")).alias("ln_k"))


@query
def k_limit(spark, d):
    return results.k_limit(runs(spark, d)).groupBy("dataset", "k").agg(F.count("*").alias("n_rows"))


@query
def equality_filter(spark, d):
    return results.filter_runs(runs(spark, d), "D3", "PROMO", 130, 35, "h=1", "Y", 5).select("seq", "k", "evaluator")


def _settings(spark, d):
    return runs(spark, d).select("dataset", "algorithm", "p").distinct()


@query
def worklist_missing(spark, d):
    r = runs(spark, d)
    done = r.where("fs = 'FS' AND seq % 29 = 0")  # an unfinished table
    return results.worklist(_settings(spark, d), KS, EVALUATORS, done).select("dataset", "algorithm", "p", "k", F.array_join("missing", ",").alias("missing"))


@query
def hd_presence(spark, d):
    return results.baseline_presence(_settings(spark, d), EVALUATORS, runs(spark, d).where("seq % 97 = 0"))


def _halves(spark, d):
    r = runs(spark, d)
    return r.where("seq % 3 <> 0"), r.where("seq % 3 = 0")


@query
def results_upsert_first(spark, d):
    old, new = _halves(spark, d)
    return results.upsert(old, new, ["run_key", "perform_cv", "folds", "fs"], "first", "seq").select("run_key", "fs", "seq", "avg_accuracy")


@query
def changelog_upsert_last(spark, d):
    old, new = _halves(spark, d)
    return results.upsert(old, new, ["repository", "dataset", "fs", "k"], "last", "seq").select("repository", "dataset", "fs", "k", "seq", "avg_auc")


@query
def union_all_counts(spark, d):
    old, new = _halves(spark, d)
    return results.ensure_columns(old.drop("std_auc"), new.schema).unionByName(new).groupBy("dataset").agg(F.count("*").alias("n_rows"), F.count("std_auc").alias("with_std"))


_BIC = ["seq", "algorithm_max", "dataset_max", "algorithm_best", "dataset_best", "dataset_min_std", "best"]


@query
def bic_algorithm(spark, d):
    rows = results.best_by_algorithm(runs(spark, d), "avg_accuracy", "std_accuracy")
    return rows.select(*_BIC, F.array_join("algorithm_best_ks", ",").alias("ks"), F.array_join("algorithm_best_hyper", ",").alias("hypers"), F.array_join("dataset_best_ks", ",").alias("dataset_ks"), F.array_join("dataset_best_algorithms", ",").alias("dataset_algorithms"))


_BY_METRIC = {"avg_accuracy": "std_accuracy", "avg_auc": "std_auc"}


@query
def bic_dataset(spark, d):
    return results.best_by_dataset(runs(spark, d), _BY_METRIC)


@query
def bic_summary(spark, d):
    s = results.summary(results.best_by_dataset(runs(spark, d), _BY_METRIC))
    return s.select("dataset", "metric", "category", "no_fs_algorithm", "fs_algorithm", "no_fs_hyper", "fs_hyper", "no_fs_average", "fs_average", "no_fs_std", "fs_std", "no_fs", "fs")


@query
def hardness_score(spark, d):
    return peeling.hardness_columns(runs(spark, d)).select("seq", "accuracy_score", "auc_score")


@query
def performance_labels(spark, d):
    return runs(spark, d).groupBy(X.performance_label(F.col("avg_accuracy")).alias("label")).agg(F.count("*").alias("n_rows"))


@query
def dataset_category(spark, d):
    s = results.summary(results.best_by_dataset(runs(spark, d), _BY_METRIC))
    return s.groupBy("metric", "category").agg(F.count("*").alias("datasets"))


@query
def light_results(spark, d):
    return results.light(runs(spark, d), "seq", ["avg_auc", "avg_accuracy"]).select("seq", "dataset", "avg_auc", "avg_accuracy")


@query
def wide_flatten(spark, d):
    return results.flatten(runs(spark, d), ["dataset", "algorithm"], EVALUATORS, ["avg_accuracy", "avg_auc"])


@query
def fold_statistics(spark, d):
    folds = runs(spark, d).select("dataset", "evaluator", F.col("seq").alias("fold"), F.col("avg_auc").alias("auc"))
    return results.fold_summary(folds, ["dataset", "evaluator"], ("auc",)).select("dataset", "evaluator", "avg_auc", "std_auc", "max_auc", F.size("auc_list").cast("long").alias("folds"))


@query
def best_evaluator(spark, d):
    r = runs(spark, d).groupBy("dataset", "evaluator").agg(F.round(F.avg("avg_auc"), 6).alias("auc"))
    return r.withColumn("rn", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("auc"), "evaluator"))).where("rn = 1").select("dataset", "evaluator", "auc")


@query
def change_log_pivot(spark, d):
    return results.change_log(runs(spark, d), ["dataset", "fs"], ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"], "avg_auc")


@query
def custom_round(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    x = F.col("l_discount") * F.col("l_tax") * F.col("l_tax") / 100
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.round(X.custom_round(F.round(x, 12)), 9).alias("y"))


@query
def soft_threshold(spark, d):
    return rounded(M.to_long(M.lines_binary(spark, d)).groupBy("j").agg(F.sum(X.soft_threshold(F.col("x") - 1, F.lit(0.5))).alias("s")), 3)


@query
def dataset_name_cleanup(spark, d):
    r = runs(spark, d).select(F.concat("dataset", F.lit("_"), F.col("n").cast("string"), F.lit("_samples")).alias("raw")).distinct()
    return r.select("raw", X.dataset_name(F.col("raw")).alias("name"))


@query
def gt_contribution(spark, d):
    absolute, percent, label = peeling.ground_truth_contribution(F.col("avg_auc"), F.col("avg_accuracy"))
    return runs(spark, d).select("seq", absolute.alias("absolute"), F.round(percent, 2).alias("percent"), label.alias("label"))


@query
def fs_contribution(spark, d):
    best = results.best_by_dataset(runs(spark, d), {"avg_auc": "std_auc"})
    side = lambda fs, c: best.where(F.col("fs") == fs).select("dataset", F.col("best").alias(c))
    gain, flag = peeling.fs_contribution(F.col("a"), F.col("b"))
    return side("FS", "a").join(side("No FS", "b"), "dataset").select("dataset", gain.alias("gain"), flag.alias("contributes"))


@query
def top_features_slice(spark, d):
    lists = _ranks(spark, d).groupBy("fold").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "j"))), lambda s: s["j"]).alias("js"))
    return lists.select("fold", F.array_join(peeling.top_features(F.col("js"), 25, 10), ",").alias("js"))


@query
def json_cell(spark, d):
    return results.as_json(runs(spark, d), ["dataset"], ["seq", "k"])


@query
def repositories(spark, d):
    return runs(spark, d).select("repository").distinct()


@query
def file_stems(spark, d):
    r = runs(spark, d).select(F.concat("dataset", F.lit(".mat")).alias("file")).distinct()
    return r.select("file", M.file_stem(F.col("file")).alias("stem"))


# --- selectors that need dense matrices ---


def _selector(name: str, k: int = K):
    def run(spark, d):
        return rounded(selectors.select(_emb(spark, d), registry.REGISTRY[name].fn, k, registry.SETTINGS.get(name)))

    run.__name__ = "fs_" + {"LeadingEV": "leading_ev", "DecisionTree_Forward": "dt_forward", "DecisionTree_Backward": "dt_backward"}.get(name, name.lower())
    query(run)


for _name, _k in (("DecisionTree_Forward", 3), ("DecisionTree_Backward", 60), ("UFS", K), ("DLFS", K), ("GRACES", 5), ("CFS", K)):
    _selector(_name, _k)


@query
def fs_mcfs(spark, d):
    return rounded(spectral.multi_cluster(_emb(spark, d), K))


@query
def fs_cei_ga(spark, d):
    return rounded(genetic.class_span_genetic(_emb(spark, d), K))


@query
def fs_cae(spark, d):
    return rounded(networks.concrete_autoencoder(_emb(spark, d), K))


@query
def fs_etree(spark, d):
    return rounded(top_k(forests.importances(_emb(spark, d)), K))


@query
def fs_adaboost(spark, d):
    return rounded(top_k(forests.boosted_importances(_emb(spark, d)), K))


@query
def fs_shap(spark, d):
    return rounded(top_k(forests.shap_select(_emb(spark, d)), K))


@query
def fs_svc(spark, d):
    return rounded(solvers.svc_select(_emb(spark, d), K))


@query
def fs_svm_forward(spark, d):
    return rounded(solvers.svm_wrapper(_emb(spark, d), K))


@query
def fs_svm_backward(spark, d):
    return rounded(solvers.svm_wrapper(_emb(spark, d), 60, False, 0.1, solvers.sparse_support_vectors))


@query
def fs_ct(spark, d):
    return rounded(solvers.thresholded_eigen(_emb(spark, d), K))


@query
def fs_leading_ev(spark, d):
    return rounded(solvers.leading_eigenvector(_emb(spark, d), K))


@query
def fs_rfs(spark, d):
    return rounded(solvers.robust_regression(_emb(spark, d), K))


@query
def fs_graph(spark, d):
    return rounded(solvers.graph_fused(_emb(spark, d), K))


@query
def fs_svm_rbf(spark, d):
    return rounded(solvers.kernel_select(_emb(spark, d), K))


@query
def lda_permutation_importance(spark, d):
    wide = _emb(spark, d)
    with solvers.training(wide) as rows:
        model = solvers.discriminant(rows)
    return rounded(permutation.importance(wide, model.predict, 5))


def _judged(spark, d, fit):
    """Fitted on one side of a split, judged on the other, all by Spark's sums."""
    wide = _split(spark, d)
    with solvers.training(wide.where("train")) as rows:
        model = fit(rows)
    scored = model.scored(wide.where("NOT train"))
    each = scored.select("id", "label", F.posexplode("p").alias("at", "score"))
    codes = F.array(*[F.lit(c) for c in model.labels])
    auc = metrics.auc_ovr(each.select("id", "label", F.element_at(codes, F.col("at") + 1).alias("class"), "score"))
    return rounded(metrics.weighted_prf(scored).crossJoin(auc))  # one row each


@query
def logistic_evaluation(spark, d):
    return _judged(spark, d, solvers.logistic)


@query
def lda_evaluation(spark, d):
    return _judged(spark, d, solvers.discriminant)


@query
def mrmr_forest_relevance(spark, d):
    return rounded(redundancy.mrmr(_emb(spark, d), 3, "forest"))


@query
def cv_pipeline(spark, d):
    return pipeline.cross_validate(_emb(spark, d), "embeddings", "low_variance", "driver", [5, 10], ["LR", "KNN", "LDA", "ETREE"])


@query
def cv_pipeline_svm_rf(spark, d):
    return pipeline.cross_validate(_emb(spark, d), "embeddings", "low_variance", "driver", [5], ["SVM", "RF"])


@query
def cv_baseline(spark, d):
    return pipeline.cross_validate(_emb(spark, d), "embeddings", None, "driver", None, ["KNN", "LDA"])


@query
def hyperparameter_sheets(spark, d):
    t = registry.settings_table(spark)
    return t.select("algorithm", "setting_no", "comment", F.size("params").alias("n_params"))


# --- single splits and hard variants ---


def _split(spark, d):
    return splits.train_test(_emb(spark, d), 0.5)


@query
def single_split_evaluation(spark, d):
    return rounded(hard.single_split(_split(spark, d), "low_variance", [5, 10]))


@query
def ground_truth_rescore(spark, d):
    best = [r["j"] for r in filters.low_variance(_emb_long(spark, d), 10).orderBy("rank").collect()]  # ten features
    return rounded(hard.rescored(_split(spark, d), best))


@query
def hard_baseline(spark, d):
    rows = splits.train_test(splits.peel(_emb(spark, d), 5), 0.5)
    both = hard.single_split(rows, None, [64]).unionByName(hard.single_split(rows, None, [64], "ADABOOST"))
    return rounded(both)


@query
def shap_contributions(spark, d):
    return rounded(hard.shap_contributions(_emb(spark, d), trees=10))


@query
def training_size(spark, d):
    return hard.train_sizes(_emb(spark, d))


@query
def selection_sweep(spark, d):
    return rounded(hard.sweep(_split(spark, d), 0.7, 0.9, 3, [5], "Fast"))


@query
def fold_importances(spark, d):
    runs_ = pipeline.fold_runs(_emb(spark, d), "low_variance", [5], ["ETREE", "LR", "KNN", "LDA"])
    cell = runs_.select("fold", "evaluator", F.posexplode(F.arrays_zip("selected", "importance")).alias("p", "x"))
    return cell.select("fold", "evaluator", (F.col("p") + 1).alias("rank"), F.col("x.selected").alias("j"), F.round("x.importance", 6).alias("importance"))


# --- further matrix and table operators ---


@query
def extreme_matrix_entries(spark, d):
    m = moments.second_moments(_emb(spark, d)).where("i < j")
    both = moments.extreme_entries(m, 5).withColumn("side", F.lit("largest")).unionByName(moments.extreme_entries(m, 5, False).withColumn("side", F.lit("smallest")))
    return rounded(both)


@query
def l21_norm(spark, d):
    return rounded(moments.l21_norm(_emb_long(spark, d)), 4)


@query
def masked_inputs(spark, d):
    masks = spark.range(4).select(F.col("id").alias("mask_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: (j % 4 == F.col("id")).cast("int")).alias("mask"))
    rows = moments.masked(_emb(spark, d), masks)
    return rounded(rows.select("id", "mask_id", F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("s")))


@query
def leading_algorithms(spark, d):
    return results.leaders(runs(spark, d), ["dataset", "fs"], "avg_accuracy")


def _categories(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.concat("l_returnflag", (F.col("l_suppkey") % 7).cast("string")).alias("category"), (F.col("l_linestatus") == "O").cast("int").alias("y"))


def _encoded(df):
    return rounded(df.groupBy("category", "y").agg(F.count("*").alias("n"), F.avg("encoded").alias("encoded")))


@query
def encode_target(spark, d):
    return _encoded(encoders.target_mean(_categories(spark, d), "category", "y"))


@query
def encode_leave_one_out(spark, d):
    return _encoded(encoders.leave_one_out(_categories(spark, d), "category", "y"))


@query
def encode_james_stein(spark, d):
    return _encoded(encoders.james_stein(_categories(spark, d), "category", "y"))


@query
def full_results_upsert(spark, d):
    r = runs(spark, d).select("seq", "repository", "dataset", "fs", "algorithm", "k", "hyper", "evaluator", "avg_auc", F.lit(0.7).alias("hard_t"), F.lit(50.0).alias("training_percent"), F.lit(10.0).alias("removed_percent"))
    return results.upsert_table("full_results", r.where("seq % 3 <> 0"), r.where("seq % 3 = 0"), "seq").select("repository", "dataset", "fs", "algorithm", "k", "hyper", "evaluator", "seq")


@query
def selected_importance(spark, d):
    """Shares of importance of the ten features with the most variance, from trees on all features."""
    imp = forests.importances(_emb(spark, d))
    chosen = filters.low_variance(_emb_long(spark, d), 10).select("j")
    total = imp.agg(F.sum("score").alias("t"))
    return imp.join(chosen, "j").crossJoin(F.broadcast(total)).select("j", X.custom_round(F.col("score") / F.col("t")).alias("importance"))


@query
def directory_listing(spark, d):
    """Stems of the tables; a folder of part files counts as one."""
    return M.list_datasets(spark, d, "*.parquet").select("dataset")


def _variants(spark, d):
    """Runs as rows of the tables of hard variants."""
    return runs(spark, d).select("seq", "repository", "dataset", "fs", "algorithm", "k", "n", "p", (F.col("k") / 10.0).alias("hard_t"), (F.col("folds") * 10.0).alias("training_percent"), F.lit(10.0).alias("removed_percent"), F.col("n").alias("training_length"), "avg_auc")


def _variant_halves(spark, d):
    r = _variants(spark, d)
    return r.where("seq % 3 <> 0"), r.where("seq % 3 = 0")


@query
def original_fs_upsert(spark, d):
    return results.upsert_table("original_fs", *_variant_halves(spark, d), "seq").select("repository", "dataset", "hard_t", "training_percent", "algorithm", "k", "seq")


@query
def dataset_labels_upsert(spark, d):
    return results.upsert_table("dataset_labels", *_variant_halves(spark, d), "seq").select("repository", "dataset", "hard_t", "training_percent", "n", "p", "fs", "algorithm", "seq")


@query
def change_log_upsert(spark, d):
    return results.upsert_table("change_log", *_variant_halves(spark, d), "seq").select("repository", "dataset", "removed_percent", "fs", "hard_t", "training_percent", "seq")


@query
def mrmr_same_domain(spark, d):
    return rounded(redundancy.mrmr(_emb(spark, d), K, same_domain=lambda j: str(j % 4)))


@query
def outcome_row(spark, d):
    """The documentation row of a hard variant: half of the rows train, three tenths of each class are peeled off for the variant."""
    wide = _emb(spark, d)
    rows, variant = (splits.train_test(w, 0.5) for w in (wide, splits.peel(wide, 3)))
    score = lambda r, name, k: hard.single_split(r, name, [k])
    known = hard.single_split(variant, None, [K], selected=[r["j"] for r in filters.low_variance(_emb_long(spark, d), K).collect()])  # K features
    sizes = {"n": wide.count(), "p": 64, "classes": 10, "hard_t": 0.7, "removed_percent": 30.0, "removed_percent_fs": 30.0}
    out = hard.document(spark, "embeddings", sizes, score(rows, None, 64), score(rows, "low_variance", K), score(variant, None, 64), score(variant, "DT", K), {"auc": known, "accuracy": known})
    return rounded(out)
