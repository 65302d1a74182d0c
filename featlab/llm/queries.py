"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlab.llm import binary_output, chat, context_tree, exact_dedup, filter_audit, packing, pieces, pii, quality, rotation_codes, simhash, warc, weighted_lloyd
from featlab.llm.common import scratch, table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation_codes.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.conversation_digests(own.unionByName(extra))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_first_fit(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_ids", F.sha2("ids", 256).alias("ids_sha256"), "exact")


def op9_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices are written, then read back: a row for each sequence with digests of what the files hold."""
    path = scratch(spark, "matrices")
    binary_output.write_packed(binary_output.packed_rows(table(spark, sf_dir, "documents")), path)
    rows = spark.read.parquet(path)
    used = F.element_at("cu_seqlens", -1).cast("long")
    return rows.select("sequence_id", used.alias("n_ids"), F.size("doc_ids").cast("long").alias("n_segments"), "cu_seqlens", "doc_ids", "starts", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_lloyd.clusters(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are written, then read back."""
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).drop("payload", "url")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(replace(replace(replace(role, '\', '\0'), '<', '\1'), '[', '\2')) + len(replace(replace(replace(text, '\', '\0'), '<', '\1'), '[', '\2')) + 20 AS k FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS lost, sum(k)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars FROM g
"""
OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
             row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) AS nth FROM d)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""

OP12_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, t, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS top FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(h, 5 * k + 1, 5))::INT) AS v FROM d)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
       array_to_string(list_transform(v, lambda x: list_reduce(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> k) & 31) + 1, 1)), lambda a, c: a || c)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""
OP13_SQL = r"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(least < w.doc_id, false)::INT AS mask FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
n AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b | f2.b | f3.b | f4.b | f5.b = 31),
s AS (SELECT filter_order, k::INT AS step, bits[k] AS b, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, range(1, 6) r(k))
SELECT part, filter_order, step, sum(CASE WHEN mask & (before + b) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN mask & before = 0 AND mask & b > 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN mask & before > 0 AND mask & b > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN mask = b THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & b > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN mask & before = 0 AND mask & b > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost, sum(CASE WHEN mask & b > 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM s, n GROUP BY part, filter_order, step
"""


def lloyd_sql(clusters: int = weighted_lloyd.CLUSTERS, rounds: int = weighted_lloyd.ROUNDS) -> str:
    """Lloyd's rounds one after another, over all rows instead of the distinct vectors."""
    out = [
        """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
     WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1)::INT AS cluster, q AS c FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('2:' || vec_id), q LIMIT {clusters})",
    ]
    near = "SELECT vec_id, q, cluster, c, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v, c{k}"
    best = "a{k} AS MATERIALIZED (SELECT vec_id, q, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (" + near + ") GROUP BY vec_id, q)"
    for k in range(rounds):
        out += [
            best.format(k=k),
            f"s{k} AS MATERIALIZED (SELECT cluster, j, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range(64)) AS j FROM a{k}) GROUP BY cluster, j)",
            f"c{k + 1} AS MATERIALIZED (SELECT c{k}.cluster, coalesce(m.c, c{k}.c) AS c FROM c{k} LEFT JOIN (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{k} GROUP BY cluster) m ON m.cluster = c{k}.cluster)",
        ]
    out.append(best.format(k=rounds))
    return ",\n".join(out) + f"""
SELECT a.vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_binary_output": op9_binary_output,
    "op10_pii": op10_pii,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_warc": op12_warc,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {"op2_chat_formatting": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op11_centroid_clustering": lloyd_sql(), "op12_warc": OP12_SQL, "op13_filter_audit": OP13_SQL}
