"""DuckDB SQL for the registered queries, written from the definitions, not from the plans."""

from __future__ import annotations

_EMB = """emb AS (SELECT vec_id AS id, label, list_transform(embedding, lambda v: abs(v::DOUBLE)) AS f FROM embeddings),
x AS (SELECT id, label, (unnest(range(len(f))))::INT AS j, unnest(f) AS x FROM emb)"""
_LI = """li AS (SELECT l_orderkey * 8 + l_linenumber AS id, (l_linestatus = 'O')::INT AS y2,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y3, [l_quantity, l_extendedprice, l_discount, l_tax] AS f FROM lineitem),
lx AS (SELECT id, y2, y3, (unnest(range(4)))::INT AS j, abs(unnest(f)) AS x FROM li)"""
_RUNS = """runs AS (SELECT *, concat_ws('_', dataset, algorithm, n, p, k, hyper, threshold, evaluator) AS run_key FROM (
  SELECT (l_orderkey * 8 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey AS seq, 'R' || (l_suppkey % 3) AS repository, 'D' || (l_suppkey % 20) AS dataset,
    CASE l_linestatus WHEN 'O' THEN 'FS' ELSE 'HD' END AS fs, p_type AS algorithm, (100 + l_suppkey % 20 * 10)::INT AS n, (20 + l_suppkey % 20 * 5)::INT AS p,
    ([1, 5, 10, 30, 60])[l_linenumber % 5 + 1] AS k, 'h=' || (l_linenumber % 2) AS hyper,
    (['ETREE', 'LR', 'SVM', 'RF', 'KNN', 'LDA'])[l_orderkey % 6 + 1] AS evaluator, 'Y' AS perform_cv, 5 AS folds, '0.5' AS threshold,
    round(0.55::DOUBLE + l_discount * 4.4::DOUBLE, 3) AS avg_accuracy, round(0.5::DOUBLE + l_tax * 6, 3) AS avg_auc, round(l_quantity / 1000, 3) AS std_accuracy, round(l_quantity / 500, 3) AS std_auc
  FROM lineitem JOIN part ON p_partkey = l_partkey))"""
_EV = """pr AS (SELECT event_id AS id, (user_id % 3)::INT AS label, floor(value) / 100 AS score, ((user_id + event_id % 2) % 3)::INT AS predicted FROM events)"""
_RANKS = """best AS (SELECT event_type AS fold, (user_id % 40)::INT AS j, max(round(value, 4)) AS importance FROM events GROUP BY ALL),
ranks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY importance DESC, j) AS rank FROM best) WHERE rank <= 30)"""


def _top(scores: str, k: int = 10, base: str = _EMB, digits: int = 6, order: str = "DESC") -> str:
    return f"""WITH {base}, s AS ({scores}), r AS (SELECT row_number() OVER (ORDER BY round(score, 9) {order}, j) AS rank, j, round(score, 9) AS score FROM s)
SELECT rank::INT AS rank, j, round(score, {digits}) AS score FROM r WHERE rank <= {k}"""


_CHI2 = """SELECT j, sum((o - e) ** 2 / nullif(e, 0)) AS score FROM (SELECT j, o, n / sum(n) OVER (PARTITION BY j) * sum(o) OVER (PARTITION BY j) AS e
  FROM (SELECT j, {y} AS y, sum(x) AS o, count(*) AS n FROM {t} GROUP BY ALL)) GROUP BY j"""
_F = """SELECT j, (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS score FROM (SELECT *, sum(n * m) OVER (PARTITION BY j) / sum(n) OVER (PARTITION BY j) AS g
  FROM (SELECT j, {y} AS y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM {t} GROUP BY ALL)) GROUP BY j"""
_VAR = "SELECT j, var_pop(x) AS score FROM x GROUP BY j"
_KS = """SELECT j, avg(d) AS score FROM (SELECT j, c, max(abs(a / nc - b / (nt - nc))) AS d FROM (
  SELECT j, c, sum(own) OVER w AS a, sum(oth) OVER w AS b, sum(own) OVER (PARTITION BY j, c) AS nc, sum(own + oth) OVER (PARTITION BY j, c) AS nt
  FROM (SELECT j, c, x, sum((label = c)::INT)::DOUBLE AS own, sum((label <> c)::INT)::DOUBLE AS oth FROM x CROSS JOIN (SELECT DISTINCT label AS c FROM emb) GROUP BY ALL)
  WINDOW w AS (PARTITION BY j, c ORDER BY x)) GROUP BY ALL) GROUP BY j"""
_BIN = """b AS (SELECT id, label, j, coalesce(least(9, floor((x - lo) / nullif(hi - lo, 0) * 10)::INT), 0) AS b FROM (SELECT *, min(x) OVER (PARTITION BY j) AS lo, max(x) OVER (PARTITION BY j) AS hi FROM x))"""


def _pairs(within: str = "true", self_too: bool = True) -> str:
    return f"""pairs AS (SELECT a.id AS src, b.id AS dst, a.label AS src_label, b.label AS dst_label,
  round(greatest(0, list_sum(list_transform(list_zip(a.f, b.f), lambda z: (z[1] - z[2]) ** 2))), 9) AS d,
  round(list_dot_product(a.f, b.f) / (sqrt(list_dot_product(a.f, a.f)) * sqrt(list_dot_product(b.f, b.f))), 9) AS c FROM emb a, emb b WHERE {within} {'' if self_too else 'AND a.id <> b.id'})"""


def _graph(k: int, weight: str, cosine: bool = False, within: str = "true") -> str:
    by = "c DESC" if cosine else "d"
    w = {"binary": "1.0::DOUBLE", "heat": "exp(-d / 2)", "cosine": "c"}[weight]
    return f"""WITH {_EMB}, {_pairs(within)}, near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY {by}, dst) AS rank FROM pairs),
e AS (SELECT src, dst, {w} AS w FROM near WHERE rank <= {k + 1})
SELECT src, dst, round(max(w), 6) AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY ALL"""


_MEANS = "m AS (SELECT j, avg(x) AS m FROM x GROUP BY j), n AS (SELECT count(*)::DOUBLE AS n FROM emb)"
_PAIRS_J = "pj AS (SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS s FROM x a JOIN x b ON a.id = b.id AND a.j <= b.j GROUP BY ALL)"
_COV = "cov AS (SELECT i, pj.j, (s - n * a.m * b.m) / (n - 1) AS v FROM pj JOIN m a ON a.j = i JOIN m b ON b.j = pj.j CROSS JOIN n)"
_CORR = "r AS (SELECT c.i, c.j, c.v / sqrt(a.v * b.v) AS r FROM cov c JOIN cov a ON a.i = c.i AND a.j = c.i JOIN cov b ON b.i = c.j AND b.j = c.j WHERE c.i < c.j)"
_LABEL = "CASE WHEN {m} > 0.9 THEN 'High' WHEN {m} < 0.7 THEN 'Low' ELSE 'Fair' END"
_CROUND = "CASE WHEN abs({x}) >= 0.001 THEN round({x}, 3) WHEN abs({x}) > 0 THEN sign({x}) * floor(abs({x}) * pow(10.0::DOUBLE, -floor(log10(abs({x})))) + 1e-9) / pow(10.0::DOUBLE, -floor(log10(abs({x})))) ELSE 0.0::DOUBLE END"
_BICD = f"""long AS (SELECT dataset, fs, run_key, 'avg_accuracy' AS metric, avg_accuracy AS mean, std_accuracy AS std FROM runs UNION ALL SELECT dataset, fs, run_key, 'avg_auc', avg_auc, std_auc FROM runs),
top AS (SELECT * FROM long QUALIFY mean = max(mean) OVER (PARTITION BY dataset, fs, metric)), low AS (SELECT * FROM top QUALIFY std = min(std) OVER (PARTITION BY dataset, fs, metric)),
bicd AS (SELECT dataset, CASE fs WHEN 'HD' THEN 'No FS' ELSE fs END AS fs, metric, {_CROUND.format(x='mean')} AS best, {_CROUND.format(x='std')} AS std, {_LABEL.format(m='mean')} AS label, string_agg(run_key, ' ; ' ORDER BY run_key) AS keys FROM low GROUP BY dataset, fs, metric, mean, std)"""
_KEY = "CASE WHEN contains({k}, ' ; ') THEN array_to_string(list_transform(list_filter(string_split({k}, ' ; '), lambda s: len(string_split(s, '_')) >= 6), lambda s: {one_s}), ' ; ') WHEN len(string_split({k}, '_')) >= 6 THEN {one_k} END"


def _key(k: str, part: str) -> str:
    one = (lambda s: f"string_split({s}, '_')[2]") if part == "algorithm" else (lambda s: f"array_to_string(string_split({s}, '_')[6:], '_')")
    return _KEY.format(k=k, one_s=one("s"), one_k=one(k))


_PCT = "printf('%.{d}f%%', round({x} * 100, {d}))"
_CAT = """CASE WHEN o(f.label) < o(h.label) THEN 'Fragile' WHEN f.label = 'High' THEN 'Easy' WHEN f.label = 'Fair' THEN 'Medium' ELSE 'Hard' END"""


def _category(f: str, h: str) -> str:
    order = lambda c: f"CASE {c} WHEN 'Low' THEN 1 WHEN 'Fair' THEN 2 ELSE 3 END"
    return f"CASE WHEN ({order(f)}) < ({order(h)}) THEN 'Fragile' WHEN {f} = 'High' THEN 'Easy' WHEN {f} = 'Fair' THEN 'Medium' ELSE 'Hard' END"


_SUM = f"""sm AS (SELECT h.dataset, h.metric, {_category('f.label', 'h.label')} AS category, h.best AS hb, h.std AS hs, h.label AS hl, h.keys AS hk, f.best AS fb, f.std AS fsd, f.label AS fl, f.keys AS fk
  FROM bicd h JOIN bicd f ON h.dataset = f.dataset AND h.metric = f.metric AND h.fs = 'No FS' AND f.fs = 'FS')"""
_FOLD = "row_number() OVER (PARTITION BY label ORDER BY md5('0-' || id), id)"
_AUC = """SELECT {by} sum(pos * (below + (n - pos) / 2)) / nullif(sum(pos) * sum(n - pos), 0) AS auc FROM (
  SELECT *, coalesce(sum(n - pos) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT {by} score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM {t} GROUP BY ALL)) {group}"""
_CLS = "cs AS (SELECT id, label, class, round(score * (class + 1) % 1.0::DOUBLE, 2) AS score FROM pr CROSS JOIN (SELECT unnest([0, 1, 2]) AS class))"
_SETS = "a AS (SELECT j FROM ranks WHERE fold = 'click' AND rank <= 20), b AS (SELECT j FROM ranks WHERE fold = 'view' AND rank <= 15)"
_SETN = "u AS (SELECT j, j IN (SELECT j FROM a) AS ia, j IN (SELECT j FROM b) AS ib FROM (SELECT j FROM a UNION SELECT j FROM b))"

_ALGORITHMS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

_CAT_ROWS = """c AS (SELECT l_returnflag || (l_suppkey % 7) AS category, (l_linestatus = 'O')::INT AS y FROM lineitem),
st AS (SELECT category, y, count(*) OVER w AS k, (sum(y) OVER w)::DOUBLE AS s, avg(y) OVER w AS m, coalesce(var_samp(y) OVER w, 0) AS v, avg(y) OVER () AS g, var_samp(y) OVER () AS gv FROM c WINDOW w AS (PARTITION BY category))"""

def _greedy(rel: str, k: int, of: str, where: str = "true") -> str:
    """mRMR step by step: relevance over the mean or greatest |correlation| with the features chosen before."""
    steps = ["s1 AS (SELECT 1 AS rank, j, score FROM rel ORDER BY round(score, 9) DESC, j LIMIT 1)", "c1 AS (SELECT * FROM s1)"]
    for n in range(2, k + 1):
        red = f"SELECT rr.i AS j, {of}(rr.r) AS d FROM rr JOIN c{n - 1} c ON rr.j = c.j WHERE {where} GROUP BY rr.i"
        steps.append(f"s{n} AS (SELECT {n} AS rank, rel.j, CASE WHEN d IS NULL THEN score WHEN d = 1 THEN 0 ELSE score / d END AS v FROM rel LEFT JOIN ({red}) q ON q.j = rel.j WHERE rel.j NOT IN (SELECT j FROM c{n - 1}) ORDER BY round(v, 9) DESC, rel.j LIMIT 1)")
        steps.append(f"c{n} AS MATERIALIZED (SELECT * FROM c{n - 1} UNION ALL SELECT * FROM s{n})")
    return f"""WITH {_EMB}, {_MEANS}, {_PAIRS_J}, {_COV}, {_CORR}, rel AS MATERIALIZED (SELECT * FROM ({rel}) WHERE score > 0),
rr AS MATERIALIZED (SELECT i, j, greatest(0.001, abs(r)) AS r FROM r UNION ALL SELECT j, i, greatest(0.001, abs(r)) FROM r), {", ".join(steps)}
SELECT rank::INT AS rank, j, round(score, 6) AS score FROM c{k}"""


ORACLES: dict[str, str] = {
    "fs_low_variance_topk": _top(_VAR),
    "fs_low_variance_floor": f"WITH {_EMB}, s AS ({_VAR}), c AS (SELECT count(*) FILTER (score > 0.1 * (1 - 0.1)) AS a, count(*) FILTER (score > 0.01) AS b, count(*) AS n FROM s) SELECT (CASE WHEN a > 0 THEN 0.1::DOUBLE * (1 - 0.1::DOUBLE) WHEN b > 0 THEN 0.01::DOUBLE ELSE 0 END)::DOUBLE AS floor, CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE n END AS n_pass FROM c",
    "fs_dt_diag_topk": _top("SELECT j, avg(x * x) AS score FROM x GROUP BY j"),
    "fs_skewness_topk": f"""WITH {_EMB}, c AS (SELECT j, x - avg(x) OVER (PARTITION BY j) AS d FROM x), s AS (SELECT j, round(abs(avg(d ** 3) / pow(avg(d ** 2), 1.5)), 9) AS score FROM c GROUP BY j),
t AS (SELECT *, score > 0.5 AS pass, count(*) FILTER (score > 0.5) OVER () AS np FROM s), r AS (SELECT row_number() OVER (ORDER BY score DESC, j) AS rank, j, score FROM t WHERE pass OR np < 10)
SELECT rank::INT AS rank, j, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "fs_chi2_topk": f"WITH t AS ({_top(_CHI2.format(y='label', t='x'))}) SELECT row_number() OVER (ORDER BY j)::INT AS rank, j, score FROM t",
    "fs_chi2_lines": _top(_CHI2.format(y="y2", t="lx"), 4, _LI, 3),
    "fs_f_classif_topk": _top(_F.format(y="label", t="x")),
    "fs_f_classif_lines": _top(_F.format(y="y3", t="lx"), 4, _LI),
    "fs_f_regression_topk": _top("SELECT j, r * r * (n - 2) / (1 - r * r) AS score FROM (SELECT j, corr(x, label) AS r, count(*) AS n FROM x GROUP BY j)"),
    "fs_ks_topk": _top(_KS),
    "fs_cei_rank": _top("SELECT j, 1 - min(1 - n::DOUBLE / (b - a + 1)) AS score FROM (SELECT j, label, min(p) AS a, max(p) AS b, count(*) AS n FROM (SELECT j, label, row_number() OVER (PARTITION BY j ORDER BY x, id) AS p FROM x) GROUP BY ALL) GROUP BY j", 50),
    "fs_cfs_entropy": _top("SELECT h1.j, coalesce(2 * (h1.h + h2.h - h12.h) / nullif(h1.h + h2.h, 0), 0) AS score FROM (SELECT j, entropy(b) AS h FROM b GROUP BY j) h1 JOIN (SELECT j, entropy(label) AS h FROM b GROUP BY j) h2 USING (j) JOIN (SELECT j, entropy(b * 100 + label) AS h FROM b GROUP BY j) h12 USING (j)", 10, f"{_EMB}, {_BIN}"),
    "cfs_feature_uncertainty": f"WITH {_EMB}, {_BIN}, h AS (SELECT j, entropy(b) AS h FROM b GROUP BY j), p AS (SELECT a.j AS i, c.j AS j, entropy(a.b * 100 + c.b) AS h FROM b a JOIN b c ON a.id = c.id AND a.j < c.j GROUP BY ALL) SELECT p.i, p.j, round(coalesce(2 * (a.h + c.h - p.h) / nullif(a.h + c.h, 0), 0), 6) AS su FROM p JOIN h a ON a.j = p.i JOIN h c ON c.j = p.j",
    "topk_ascending": f"WITH t AS ({_top(_VAR)}) SELECT 11 - rank AS rank, j, score FROM t",
    "topk_column_order": f"WITH t AS ({_top(_VAR)}) SELECT row_number() OVER (ORDER BY j)::INT AS rank, j, score FROM t",
    "kth_largest_mask": f"WITH {_EMB}, s AS (SELECT j, round(avg(x * x), 4) AS score FROM x GROUP BY j) SELECT j, score FROM s WHERE score >= (SELECT min(score) FROM (SELECT score FROM s ORDER BY score DESC LIMIT 10))",
    "second_tier": f"WITH t AS ({_top(_VAR, 20)}) SELECT * FROM t WHERE rank > 10",
    "matrix_shape": f"WITH {_EMB} SELECT count(*) AS n, max(len(f)) AS p FROM emb",
    "matrix_long": f"WITH {_EMB} SELECT id, label, j, round(x, 6) AS x FROM x",
    "column_slice": f"WITH {_EMB} SELECT id, label, CASE j WHEN 5 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS j, round(x, 6) AS x FROM x WHERE j IN (5, 0, 63)",
    "slice_by_selection": f"WITH {_EMB}, v AS ({_VAR}), t AS (SELECT j FROM v ORDER BY round(score, 9) DESC, j LIMIT 3) SELECT j, count(*) AS n, round(sum(x), 6) AS s FROM x WHERE j IN (SELECT j FROM t) GROUP BY j",
    "minmax_scale_stats": f"WITH {_LI}, s AS (SELECT j, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) AS x FROM lx WINDOW w AS (PARTITION BY j)) SELECT j, round(avg(x), 6) AS mean, min(x) AS lo, max(x) AS hi FROM s GROUP BY j",
    "zscore_stats": f"WITH {_LI}, s AS (SELECT j, y2 AS label, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x FROM lx WINDOW w AS (PARTITION BY j)) SELECT j, label, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM s GROUP BY ALL",
    "row_l2_normalise": f"WITH {_EMB}, s AS (SELECT id, label, j, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY id)), 1e-12) AS x FROM x) SELECT id, label, j, round(x, 6) AS x FROM s",
    "label_profile": "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS majority, max(n) AS n_majority, round(max(n) * 100.0::DOUBLE / sum(n), 3) AS majority_percent, count(*) AS classes, round(1.0::DOUBLE / count(*), 6) AS class_fraction FROM c",
    "class_counts": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "label_rebase": "SELECT (label - (SELECT min(label) FROM embeddings))::INT AS label, count(*) AS n FROM embeddings GROUP BY ALL",
    "label_dense_codes": "SELECT (dense_rank() OVER (ORDER BY label) - 1)::INT AS label, n FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY ALL)",
    "one_hot_counts": "SELECT c::INT AS c, (SELECT count(*) FROM embeddings WHERE label = c) AS n FROM range(10) t(c)",
    "second_moment_matrix": f"WITH {_EMB}, {_MEANS}, {_PAIRS_J} SELECT i, j, round(s / n, 6) AS v FROM pj CROSS JOIN n",
    "thresholded_covariance": f"WITH {_EMB}, {_MEANS}, {_PAIRS_J} SELECT i, j, round(CASE WHEN i <> j AND s / n < 1 / sqrt(n) THEN 0 ELSE s / n END, 5) AS v FROM pj CROSS JOIN n",
    "sample_covariance": f"WITH {_EMB}, {_MEANS}, {_PAIRS_J}, {_COV} SELECT i, j, round(v, 6) + 0 AS v FROM cov",
    "feature_correlation": f"WITH {_EMB}, {_MEANS}, {_PAIRS_J}, {_COV}, {_CORR} SELECT i, j, round(r, 5) + 0 AS r FROM r",
    "correlation_edges": f"WITH {_EMB}, {_MEANS}, {_PAIRS_J}, {_COV}, {_CORR} SELECT i, j FROM r WHERE abs(r) > 0.1",
    "knn_graph_binary": _graph(5, "binary"),
    "knn_graph_binary_cosine": _graph(5, "binary", True),
    "knn_graph_heat": _graph(5, "heat"),
    "knn_graph_cosine": _graph(5, "cosine", True),
    "supervised_fisher_graph": f"WITH {_EMB}, c AS (SELECT label, count(*) AS n FROM emb GROUP BY label) SELECT a.id AS src, b.id AS dst, round(1.0::DOUBLE / n, 6) AS w FROM emb a JOIN emb b USING (label) JOIN c USING (label)",
    "supervised_knn_graph": _graph(5, "binary", within="a.label = b.label"),
    "supervised_knn_graph_cosine": _graph(5, "binary", True, "a.label = b.label"),
    "supervised_heat_graph": _graph(5, "heat", within="a.label = b.label"),
    "supervised_cosine_graph": _graph(5, "cosine", True, "a.label = b.label"),
    "relieff_graph": f"""WITH {_EMB}, {_pairs('true', False)}, near AS (SELECT *, row_number() OVER (PARTITION BY src, dst_label ORDER BY d, dst) AS rank FROM pairs), k AS (SELECT count(DISTINCT label) AS nc FROM emb),
e AS (SELECT src, dst, CASE WHEN src_label = dst_label THEN 1.0::DOUBLE / 3 ELSE -1.0::DOUBLE / ((nc - 1) * 3) END AS w FROM near CROSS JOIN k WHERE rank <= 3 UNION ALL SELECT id, id, 1.0::DOUBLE FROM emb)
SELECT src, dst, round(max(w), 6) AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY ALL""",
    "laplacian_score": _top(
        "SELECT o.j, (dxx - wxx) / dx AS score FROM (SELECT x.j, sum(d * x * x) AS dxx, sum(d * x) AS dx FROM x JOIN (SELECT src, sum(w) AS d FROM g GROUP BY src) ON id = src GROUP BY x.j) o JOIN (SELECT a.j, sum(w * a.x * b.x) AS wxx FROM g JOIN x a ON a.id = src JOIN x b ON b.id = dst AND a.j = b.j GROUP BY a.j) c USING (j)",
        10,
        f"{_EMB}, {_pairs()}, near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM pairs), e AS (SELECT src, dst, exp(-d / 8192) AS w FROM near WHERE rank <= 11), g AS (SELECT src, dst, max(w) AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY ALL)",
    ),
    "relieff_score": _top(
        "SELECT a.j, sum(w * abs(a.x - b.x)) / any_value(r) / (SELECT count(*) FROM emb) AS score FROM w JOIN x a ON a.id = src JOIN x b ON b.id = dst AND a.j = b.j JOIN (SELECT j, max(x) - min(x) AS r FROM x GROUP BY j) s ON s.j = a.j GROUP BY a.j",
        10,
        f"""{_EMB}, {_pairs('true', False)}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst_label ORDER BY d, dst) AS rank FROM pairs) WHERE rank <= 10), p AS (SELECT label, count(*) / (SELECT count(*)::DOUBLE FROM emb) AS p FROM emb GROUP BY label),
w AS (SELECT src, dst, CASE WHEN src_label = dst_label THEN -1.0::DOUBLE ELSE b.p / (1 - a.p) END / count(*) OVER (PARTITION BY src, dst_label) AS w FROM near JOIN p a ON a.label = src_label JOIN p b ON b.label = dst_label)""",
    ),
    "knn_classify": f"""WITH {_EMB}, t AS (SELECT *, {_FOLD} <= round(count(*) OVER (PARTITION BY label) * 0.5::DOUBLE) AS train FROM emb), d AS (SELECT b.id, b.label, a.label AS y, row_number() OVER (PARTITION BY b.id ORDER BY round(list_sum(list_transform(list_zip(a.f, b.f), lambda z: (z[1] - z[2]) ** 2)), 9), a.id) AS rank FROM t a, t b WHERE a.train AND NOT b.train),
v AS (SELECT id, label, y, count(*) AS n FROM d WHERE rank <= 5 GROUP BY ALL) SELECT id, label, y AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, y) = 1""",
    "one_nn_accuracy": f"WITH {_EMB}, {_pairs('true', False)}, b AS (SELECT src_label = dst_label AS ok FROM pairs QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) = 1) SELECT round(avg(ok::INT), 6) AS accuracy FROM b",
    "mrmr_select": f"""WITH {_EMB}, {_MEANS}, {_PAIRS_J}, {_COV}, {_CORR}, rel AS ({_F.format(y='label', t='x')}), rr AS (SELECT i, j, greatest(0.001, abs(r)) AS r FROM r UNION ALL SELECT j, i, greatest(0.001, abs(r)) FROM r),
s1 AS (SELECT j, score FROM rel ORDER BY round(score, 9) DESC, j LIMIT 1), s2 AS (SELECT rel.j, rel.score / rr.r AS score FROM rel JOIN rr ON rr.i = rel.j JOIN s1 ON rr.j = s1.j ORDER BY round(rel.score / rr.r, 9) DESC, rel.j LIMIT 1),
s3 AS (SELECT rel.j, rel.score / ((a.r + b.r) / 2) AS score FROM rel JOIN rr a ON a.i = rel.j JOIN s1 ON a.j = s1.j JOIN rr b ON b.i = rel.j JOIN s2 ON b.j = s2.j ORDER BY round(rel.score / ((a.r + b.r) / 2), 9) DESC, rel.j LIMIT 1)
SELECT 1 AS rank, j, round(score, 6) AS score FROM s1 UNION ALL SELECT 2, j, round(score, 6) FROM s2 UNION ALL SELECT 3, j, round(score, 6) FROM s3""",
    "alpha_investing_select": f"""WITH {_EMB}, c AS (SELECT a.x AS p, b.x AS q, a.label::DOUBLE AS y FROM x a JOIN x b USING (id) WHERE a.j = 0 AND b.j = 1), s AS (SELECT corr(p, y) AS a, corr(q, y) AS b, corr(p, q) AS r FROM c)
SELECT 1 AS rank, 0 AS j, round(1 - a * a, 6) AS score FROM s UNION ALL SELECT 2, 1, round(1 - (a * a + b * b - 2 * a * b * r) / (1 - r * r), 6) FROM s""",
    "stratified_folds": f"WITH c AS (SELECT label, coalesce(sum(count(*)) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM embeddings GROUP BY label), e AS (SELECT vec_id AS id, label FROM embeddings) SELECT id, e.label, (({_FOLD.replace('label', 'e.label')} - 1 + off) % 5)::INT AS fold FROM e JOIN c ON c.label = e.label",
    "train_test_split": f"WITH e AS (SELECT vec_id AS id, label FROM embeddings) SELECT id, label, {_FOLD} <= round(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) AS train FROM e",
    "class_presence_repair": "WITH a AS (SELECT label FROM embeddings WHERE vec_id % 2 = 0 AND label <> 3), b AS (SELECT label FROM embeddings WHERE vec_id % 2 = 1 AND label <> 4), t AS (SELECT label, 'train' AS side FROM a UNION ALL SELECT label, 'train' FROM b WHERE label NOT IN (SELECT label FROM a) UNION ALL SELECT label, 'test' FROM b UNION ALL SELECT label, 'test' FROM a WHERE label NOT IN (SELECT label FROM b)) SELECT label, count(*) AS n, side FROM t GROUP BY ALL",
    "singleton_duplication": "SELECT label, CASE WHEN n = 1 THEN 2 ELSE n END AS n FROM (SELECT CASE WHEN vec_id < 3 THEN (vec_id + 100)::INT ELSE label END AS label, count(*) AS n FROM embeddings GROUP BY ALL)",
    "peel_downsample": f"WITH e AS (SELECT vec_id AS id, label FROM embeddings) SELECT id, label FROM e QUALIFY {_FOLD} > floor(count(*) OVER (PARTITION BY label) * 3 / 10)",
    "confusion_matrix": f"WITH {_EV} SELECT label, predicted, count(*) AS n FROM pr GROUP BY ALL",
    "weighted_prf": f"""WITH {_EV}, c AS (SELECT y, (SELECT count(*) FROM pr WHERE label = y AND predicted = y)::DOUBLE AS tp, (SELECT count(*) FROM pr WHERE label = y)::DOUBLE AS s, (SELECT count(*) FROM pr WHERE predicted = y)::DOUBLE AS g FROM (SELECT DISTINCT label AS y FROM pr)),
m AS (SELECT s, tp, coalesce(tp / nullif(g, 0), 0) AS p, tp / s AS q FROM c) SELECT round(sum(tp) / sum(s), 6) AS accuracy, round(sum(s * p) / sum(s), 6) AS precision, round(sum(s * q) / sum(s), 6) AS recall, round(sum(s * coalesce(2 * p * q / nullif(p + q, 0), 0)) / sum(s), 6) AS f1 FROM m""",
    "auc_binary": f"WITH {_EV}, t AS (SELECT (label = 1)::INT AS y, score FROM pr), a AS ({_AUC.format(by='', part='', t='t', group='')}) SELECT round(auc, 6) AS auc FROM a",
    "auc_ovr": f"WITH {_EV}, {_CLS}, t AS (SELECT class, (label = class)::INT AS y, score FROM cs), a AS ({_AUC.format(by='class,', part='PARTITION BY class', t='t', group='GROUP BY class')}) SELECT round(avg(auc), 6) AS auc FROM a",
    "auc_ovo": f"WITH {_EV}, {_CLS}, t AS (SELECT class, other, (label = class)::INT AS y, score FROM cs CROSS JOIN (SELECT unnest([0, 1, 2]) AS other) WHERE other <> class AND label IN (class, other)), a AS ({_AUC.format(by='class, other,', part='PARTITION BY class, other', t='t', group='GROUP BY class, other')}) SELECT round(avg(auc), 6) AS auc FROM a",
    "pr_curve": f"WITH {_EV}, v AS (SELECT score, sum((label = 1)::INT) AS pos, count(*) AS n FROM pr GROUP BY score) SELECT score, round(sum(pos) OVER w / sum(n) OVER w, 6) AS precision, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS recall FROM v WINDOW w AS (ORDER BY score DESC)",
    "threshold_predict": f"WITH {_EV} SELECT label, (score >= 0.5)::INT AS predicted, count(*) AS n FROM pr GROUP BY ALL",
    "consensus_frequency": f"WITH {_RANKS}, c AS (SELECT j, count(*) AS n, min((fold, rank)) AS met FROM ranks GROUP BY j) SELECT row_number() OVER (ORDER BY n DESC, met)::INT AS rank, j FROM c QUALIFY rank <= 10",
    "consensus_avg_rank": _top("SELECT j, avg(rank) AS score FROM ranks GROUP BY j", 10, _RANKS, 6, "ASC"),
    "consensus_mean_fi": _top("SELECT j, avg(importance) AS score FROM ranks GROUP BY j", 10, _RANKS),
    "feature_overlap": f"WITH {_RANKS}, {_SETS}, {_SETN} SELECT count(*) FILTER (ia AND ib) AS common, count(*) FILTER (ia AND NOT ib) AS only_first, count(*) FILTER (ib AND NOT ia) AS only_second, round(count(*) FILTER (ia AND ib) / nullif(count(*) FILTER (ia), 0)::DOUBLE, 6) AS overlap FROM u",
    "feature_mi": f"WITH {_RANKS}, {_SETS}, {_SETN}, c AS (SELECT ia, ib, count(*)::DOUBLE AS n FROM u GROUP BY ALL), t AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY ia) AS r, sum(n) OVER (PARTITION BY ib) AS s FROM c) SELECT round(sum(n / t * ln(n * t / (r * s))), 6) AS mutual_information FROM t",
    "feature_set_difference": f"WITH {_RANKS}, {_SETS}, {_SETN} SELECT j, CASE WHEN ia AND ib THEN 'both' WHEN ia THEN 'first' ELSE 'second' END AS side FROM u",
    "run_key_build": f"WITH {_RUNS} SELECT run_key, count(*) AS n_rows FROM runs GROUP BY run_key",
    "run_key_parse": f"WITH {_RUNS}, k AS (SELECT DISTINCT run_key FROM runs), u AS (SELECT run_key FROM k UNION ALL SELECT run_key || ' ; ' || reverse(run_key) FROM k UNION ALL SELECT DISTINCT substr(run_key, 1, 4) FROM k) SELECT run_key, {_key('run_key', 'algorithm')} AS algorithm, {_key('run_key', 'hyper')} AS hyper FROM u",
    "pn_classification": f"WITH {_RUNS}, r AS (SELECT DISTINCT dataset, n, (p * k)::INT AS p FROM runs) SELECT dataset, n, p, round(p / n::DOUBLE, 3) AS pn, CASE WHEN p / n::DOUBLE < 1 THEN 'Below 1' WHEN p / n::DOUBLE < 10 THEN 'Between 1 to 10' ELSE 'Above 10' END AS pn_class FROM r",
    "k_ratios": f"WITH {_RUNS} SELECT DISTINCT p, k, round(k * 100.0::DOUBLE / p, 3) AS k_percent, round(ln(k::DOUBLE / p), 3) AS ln_k FROM runs",
    "k_limit": f"WITH {_RUNS} SELECT dataset, k, count(*) AS n_rows FROM runs WHERE k <= p GROUP BY ALL",
    "equality_filter": f"WITH {_RUNS} SELECT seq, k, evaluator FROM runs WHERE dataset = 'D3' AND algorithm = 'PROMO' AND n = 130 AND p = 35 AND hyper = 'h=1'",
    "worklist_missing": f"WITH {_RUNS}, s AS (SELECT DISTINCT dataset, algorithm, p FROM runs), g AS (SELECT *, unnest(['ETREE', 'LR', 'SVM', 'RF', 'KNN', 'LDA']) AS evaluator FROM (SELECT *, unnest([1, 5, 10, 30, 60]) AS k FROM s) WHERE k <= p) SELECT dataset, algorithm, p, k, string_agg(evaluator, ',' ORDER BY evaluator) AS missing FROM g WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.fs = 'FS' AND r.seq % 29 = 0 AND r.dataset = g.dataset AND r.algorithm = g.algorithm AND r.k = g.k AND r.evaluator = g.evaluator) GROUP BY ALL",
    "hd_presence": f"WITH {_RUNS}, s AS (SELECT DISTINCT dataset, algorithm, p FROM runs), c AS (SELECT dataset, algorithm, count(DISTINCT evaluator) AS n FROM runs WHERE fs = 'HD' AND seq % 97 = 0 GROUP BY ALL) SELECT s.*, CASE WHEN n > 0 THEN 'Y' ELSE 'N' END AS present, coalesce(n, 0) >= 6 AS complete FROM s LEFT JOIN c USING (dataset, algorithm)",
    "results_upsert_first": f"WITH {_RUNS} SELECT run_key, fs, seq, avg_accuracy FROM runs QUALIFY row_number() OVER (PARTITION BY run_key, fs ORDER BY seq % 3 = 0, seq) = 1",
    "changelog_upsert_last": f"WITH {_RUNS} SELECT repository, dataset, fs, k, seq, avg_auc FROM runs QUALIFY row_number() OVER (PARTITION BY repository, dataset, fs, k ORDER BY seq % 3 = 0 DESC, seq DESC) = 1",
    "union_all_counts": f"WITH {_RUNS} SELECT dataset, count(*) AS n_rows, count(*) FILTER (seq % 3 = 0) AS with_std FROM runs GROUP BY dataset",
    "bic_algorithm": f"""WITH {_RUNS}, m AS (SELECT *, max(avg_accuracy) OVER (PARTITION BY repository, dataset, algorithm, n, p) AS am, max(avg_accuracy) OVER (PARTITION BY repository, dataset, n, p) AS dm FROM runs),
ga AS (SELECT repository, dataset, algorithm, n, p, string_agg(DISTINCT k::VARCHAR, ',') AS x, array_to_string(list_sort(list(DISTINCT k)), ',') AS ks, array_to_string(list_sort(list(DISTINCT hyper)), ',') AS hypers FROM m WHERE avg_accuracy = am GROUP BY ALL),
gd AS (SELECT repository, dataset, n, p, min(std_accuracy) AS ms, array_to_string(list_sort(list(DISTINCT k)), ',') AS dks, array_to_string(list_sort(list(DISTINCT algorithm)), ',') AS das FROM m WHERE avg_accuracy = dm GROUP BY ALL)
SELECT seq, am AS algorithm_max, dm AS dataset_max, CASE WHEN avg_accuracy = am THEN 'Y' ELSE 'N' END AS algorithm_best, CASE WHEN avg_accuracy = dm THEN 'Y' ELSE 'N' END AS dataset_best, ms AS dataset_min_std, CASE WHEN avg_accuracy = dm AND std_accuracy = ms THEN 'Y' ELSE '' END AS best,
ks, hypers, dks AS dataset_ks, das AS dataset_algorithms FROM m JOIN ga USING (repository, dataset, algorithm, n, p) JOIN gd USING (repository, dataset, n, p)""",
    "bic_dataset": f"WITH {_RUNS}, {_BICD} SELECT * FROM bicd",
    "bic_summary": f"WITH {_RUNS}, {_BICD}, {_SUM} SELECT dataset, metric, category, {_key('hk', 'algorithm')} AS no_fs_algorithm, {_key('fk', 'algorithm')} AS fs_algorithm, {_key('hk', 'hyper')} AS no_fs_hyper, {_key('fk', 'hyper')} AS fs_hyper, {_PCT.format(d=1, x='hb')} AS no_fs_average, {_PCT.format(d=1, x='fb')} AS fs_average, {_PCT.format(d=2, x='hs')} AS no_fs_std, {_PCT.format(d=2, x='fsd')} AS fs_std, {_PCT.format(d=1, x='hb')} || ' ± ' || {_PCT.format(d=2, x='hs')} || ' (' || hl || ')' AS no_fs, {_PCT.format(d=1, x='fb')} || ' ± ' || {_PCT.format(d=2, x='fsd')} || ' (' || fl || ')' AS fs FROM sm",
    "hardness_score": f"WITH {_RUNS} SELECT seq, CASE WHEN avg_accuracy >= 0.9 THEN 'High' WHEN avg_accuracy < 0.7 THEN 'Low' ELSE 'Ok' END AS accuracy_score, CASE WHEN avg_auc >= 0.9 THEN 'High' WHEN avg_auc < 0.7 THEN 'Low' ELSE 'Ok' END AS auc_score FROM runs",
    "performance_labels": f"WITH {_RUNS} SELECT {_LABEL.format(m='avg_accuracy')} AS label, count(*) AS n_rows FROM runs GROUP BY ALL",
    "dataset_category": f"WITH {_RUNS}, {_BICD}, {_SUM} SELECT metric, category, count(*) AS datasets FROM sm GROUP BY ALL",
    "light_results": f"WITH {_RUNS}, f AS (SELECT * FROM runs WHERE fs = 'FS'), a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY avg_auc DESC, seq) = 1), b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY avg_accuracy DESC, seq) = 1) SELECT seq, dataset, avg_auc, avg_accuracy FROM a UNION SELECT seq, dataset, avg_auc, avg_accuracy FROM b",
    "wide_flatten": f"WITH {_RUNS} SELECT dataset, algorithm, " + ", ".join(f"max(round({m}, 3)) FILTER (evaluator = '{e}') AS {e.lower()}_{m}" for e in ("ETREE", "LR", "SVM", "RF", "KNN", "LDA") for m in ("avg_accuracy", "avg_auc")) + " FROM runs GROUP BY dataset, algorithm",
    "fold_statistics": f"WITH {_RUNS} SELECT dataset, evaluator, round(avg(avg_auc), 3) AS avg_auc, round(stddev_pop(avg_auc), 3) AS std_auc, max(avg_auc) AS max_auc, count(*) AS folds FROM runs GROUP BY ALL",
    "best_evaluator": f"WITH {_RUNS}, r AS (SELECT dataset, evaluator, round(avg(avg_auc), 6) AS auc FROM runs GROUP BY ALL) SELECT dataset, evaluator, auc FROM r QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY auc DESC, evaluator) = 1",
    "change_log_pivot": f"WITH {_RUNS}, w AS (SELECT dataset, fs, " + ", ".join(f"max(avg_auc) FILTER (algorithm = '{a}') AS {a}" for a in _ALGORITHMS) + " FROM runs GROUP BY dataset, fs) SELECT dataset, fs, " + ", ".join(f"CASE WHEN {a} = greatest({', '.join(_ALGORITHMS)}) THEN '**' || {a} || '**' ELSE {a}::VARCHAR END AS {a}" for a in _ALGORITHMS) + " FROM w",
    "custom_round": f"SELECT l_orderkey * 8 + l_linenumber AS seq, round({_CROUND.format(x='x')}, 9) AS y FROM (SELECT *, round(l_discount * l_tax * l_tax / 100, 12) AS x FROM lineitem)",
    "soft_threshold": f"WITH {_LI} SELECT j, round(sum(sign(x - 1) * greatest(abs(x - 1) - 0.5, 0)), 3) AS s FROM lx GROUP BY j",
    "dataset_name_cleanup": f"WITH {_RUNS} SELECT DISTINCT dataset || '_' || n || '_samples' AS raw, dataset AS name FROM runs",
    "gt_contribution": f"WITH {_RUNS}, g AS (SELECT seq, round(avg_auc - avg_accuracy, 3) AS absolute, round((avg_auc / nullif(avg_accuracy, 0) - 1) * 100, 3) AS percent FROM runs) SELECT seq, absolute, round(percent, 2) AS percent, CASE WHEN percent >= 10 THEN 'Hard Interesting' ELSE '' END AS label FROM g",
    "fs_contribution": f"WITH {_RUNS}, {_BICD} SELECT f.dataset, round(f.best - h.best, 3) AS gain, CASE WHEN round(f.best - h.best, 3) > 0 THEN 'Yes' ELSE 'No' END AS contributes FROM bicd f JOIN bicd h ON f.dataset = h.dataset AND f.metric = 'avg_auc' AND h.metric = 'avg_auc' AND f.fs = 'FS' AND h.fs = 'No FS'",
    "top_features_slice": f"WITH {_RANKS}, l AS (SELECT fold, list(j ORDER BY rank) AS js FROM ranks GROUP BY fold) SELECT fold, array_to_string(js[1:CASE WHEN len(js) >= 25 THEN 25 ELSE 10 END], ',') AS js FROM l",
    "json_cell": f"WITH {_RUNS} SELECT dataset, '[' || string_agg('{{\"seq\":' || seq || ',\"k\":' || k || '}}', ',' ORDER BY seq, k) || ']' AS json FROM runs GROUP BY dataset",
    "repositories": f"WITH {_RUNS} SELECT DISTINCT repository FROM runs",
    "file_stems": f"WITH {_RUNS} SELECT DISTINCT dataset || '.mat' AS file, dataset AS stem FROM runs",
    "extreme_matrix_entries": f"WITH {_EMB}, {_MEANS}, {_PAIRS_J}, mm AS (SELECT i, j, s / n AS v FROM pj CROSS JOIN n WHERE i < j), a AS (SELECT *, 'largest' AS side FROM mm ORDER BY round(v, 9) DESC, i, j LIMIT 5), b AS (SELECT *, 'smallest' AS side FROM mm ORDER BY round(v, 9), i, j LIMIT 5) SELECT i, j, round(v, 6) AS v, side FROM (SELECT * FROM a UNION ALL SELECT * FROM b)",
    "l21_norm": f"WITH {_EMB} SELECT round(sum(n), 4) AS norm FROM (SELECT sqrt(sum(x * x)) AS n FROM x GROUP BY id)",
    "masked_inputs": f"WITH {_EMB} SELECT id, (j % 4)::BIGINT AS mask_id, round(sum(x), 6) AS s FROM x GROUP BY ALL",
    "leading_algorithms": f"WITH {_RUNS}, t AS (SELECT * FROM runs QUALIFY avg_accuracy = max(avg_accuracy) OVER (PARTITION BY dataset, fs)) SELECT dataset, fs, max(avg_accuracy) AS best, array_to_string(list_sort(list(DISTINCT algorithm)), ',') AS algorithms FROM t GROUP BY ALL",
    "encode_target": f"WITH {_CAT_ROWS} SELECT category, y, count(*) AS n, round(avg(m), 6) AS encoded FROM st GROUP BY ALL",
    "encode_leave_one_out": f"WITH {_CAT_ROWS} SELECT category, y, count(*) AS n, round(avg(coalesce((s - y) / nullif(k - 1, 0), g)), 6) AS encoded FROM st GROUP BY ALL",
    "encode_james_stein": f"WITH {_CAT_ROWS} SELECT category, y, count(*) AS n, round(avg((1 - v / (v + gv)) * m + v / (v + gv) * g), 6) AS encoded FROM st GROUP BY ALL",
    "full_results_upsert": f"WITH {_RUNS} SELECT repository, dataset, fs, algorithm, k, hyper, evaluator, seq FROM runs QUALIFY row_number() OVER (PARTITION BY repository, dataset, fs, algorithm, k, hyper, evaluator ORDER BY seq % 3 = 0 DESC, seq DESC) = 1",
    "original_fs_upsert": f"WITH {_RUNS}, v AS (SELECT *, k / 10.0::DOUBLE AS hard_t, folds * 10.0::DOUBLE AS training_percent, 10.0::DOUBLE AS removed_percent FROM runs) SELECT repository, dataset, hard_t, training_percent, algorithm, k, seq FROM v QUALIFY row_number() OVER (PARTITION BY repository, dataset, hard_t, training_percent, algorithm, k ORDER BY seq % 3 = 0 DESC, seq DESC) = 1",
    "dataset_labels_upsert": f"WITH {_RUNS}, v AS (SELECT *, k / 10.0::DOUBLE AS hard_t, folds * 10.0::DOUBLE AS training_percent, 10.0::DOUBLE AS removed_percent FROM runs) SELECT repository, dataset, hard_t, training_percent, n, p, fs, algorithm, seq FROM v QUALIFY row_number() OVER (PARTITION BY repository, dataset, hard_t, training_percent, n, p, fs, algorithm ORDER BY seq % 3 = 0 ASC, seq ASC) = 1",
    "change_log_upsert": f"WITH {_RUNS}, v AS (SELECT *, k / 10.0::DOUBLE AS hard_t, folds * 10.0::DOUBLE AS training_percent, 10.0::DOUBLE AS removed_percent FROM runs) SELECT repository, dataset, removed_percent, fs, hard_t, training_percent, seq FROM v QUALIFY row_number() OVER (PARTITION BY repository, dataset, removed_percent, fs, hard_t, training_percent ORDER BY seq % 3 = 0 DESC, seq DESC) = 1",
    "directory_listing": "SELECT * FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'), ('documents'), ('embeddings'), ('pages'), ('benchmark'), ('labels'), ('conversations')) t(dataset)",
    "training_size": "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), s AS (SELECT i, round(0.5 - i * 0.01, 2) AS share FROM range(50) t(i)), t AS (SELECT i, share, sum(round_even(n * share, 0))::BIGINT AS a, sum(n)::BIGINT AS n FROM c CROSS JOIN s GROUP BY ALL), b AS (SELECT * FROM t WHERE least(a, n - a) >= 50 AND least(share, 1 - share) >= 0.3 ORDER BY i LIMIT 1) SELECT share::DOUBLE AS share, a AS n_train, n - a AS n_test FROM b",
    "hyperparameter_sheets": """SELECT algorithm, setting_no::INT AS setting_no, comment, n_params::INT AS n_params FROM (VALUES ('Skewness', 1, 'skew_threshold=1', 1), ('CFS', 1, 't=5', 1), ('MCFS', 1, 'metric=euclidean; neighbor_mode=knn; weight_mode=heat_kernel', 3), ('RFS', 1, 'gamma=0.01; max_iter=1000', 2), ('ReliefF', 1, 'n_neighbors=10', 1), ('GRAPH', 1, 'lambda1=0.8; lambda2=0.8; rho=0.1; max_iter=300', 4), ('low_variance', 1, 'p=0.1', 1), ('LS', 1, 'metric=euclidean; neighbor_mode=knn; weight_mode=heat_kernel', 3), ('SVM_RBF', 1, 'C=1; gamma=scale', 2), ('CEI_GA', 1, 'pre_keep=50; ga_beta=2; ga_pop=20; ga_gen=50; cv_splits=5', 5), ('SVM_Forward', 1, 'C=1', 1), ('SHAP', 1, 'n_estimators=100; learning_rate=0.1; max_depth=3', 3), ('SVM_Backward', 1, 'C=0.1; penalty=l1; tol=0.05', 3), ('DecisionTree_Backward', 1, 'max_depth=4; min_samples_split=10; min_samples_leaf=5; max_leaf_nodes=15', 4), ('DecisionTree_Forward', 1, 'max_depth=4; min_samples_split=10; min_samples_leaf=5; max_leaf_nodes=15', 4), ('AdaBoost', 1, 'n_estimators=100; learning_rate=5; max_depth=5', 3), ('ETree', 1, 'n_estimators=200; max_depth=3', 2), ('CT', 1, 't=1', 1), ('CAE', 1, 'num_epochs=800; batch_size=16', 2), ('DLFS', 1, 'data_batch_size=16; mask_batch_size=16; s=5; s_p=2; phase_2_start=600; max_batches=1500; early_stopping_patience=60', 7), ('UFS', 1, 'epochs_number=200; batch_size_value=16; loss_weight_1=0.0078125; p_learning_rate=0.001', 4), ('SVC', 1, 'C=1; penalty=l2', 2), ('Univariate', 1, 'score_func=chi2', 1), ('alpha_investing', 1, 'w0=10; dw=0.01', 2), ('mRMR', 1, 'relevance=f; denominator=mean', 2), ('GRACES', 1, 'epochs=5; learning_rate=0.001; q=2; n_dropouts=10; dropout_prob=0.5; batch_size=16; alpha=0.95; sigma=0.1; f_correct=0', 9), ('DT', 1, 'No_hyperparamters', 0), ('LeadingEV', 1, 'No_hyperparamters', 0)) t(algorithm, setting_no, comment, n_params)""",
    "mrmr_ks_max": _greedy(_KS, 10, "max"),
    "mrmr_same_domain": _greedy(_F.format(y="label", t="x"), 10, "avg", "rr.i % 4 = rr.j % 4"),
}
