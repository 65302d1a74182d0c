"""Quality classifier: interpolated modified Kneser-Ney n-grams, perplexity, quantiles by language.

A text is its bytes, with one space between words and an end byte; a word that repeats the word before it
has the byte SAME, which UTF-8 never holds, before it: what is rare in prose then costs many bits. N-grams of ORDER bytes are counted on trusted
text only, packed by shard: all grams with the same last two context bytes are in one. A shard knows the
counts, contexts and left neighbours of orders 3 and up; those of orders 1 and 2, 65,536 numbers at most,
and the discounts are summed over shards.

Scoring is a sharded count join. Documents are read in blocks; a block's distinct n-grams are the question,
packed by shard, which a shard answers with log probabilities, in the question's order. The answers meet the
block's texts, read once more, and each document's are summed. So an n-gram crosses the network once a block,
however many documents hold it, and nothing of the model is sent to all executors but the low orders.

Thresholds are empirical quantiles, by language, of all trusted rows that the model was not trained on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.llm.common import fresh, give_back, lean, text_or_empty, written
from featlab.llm.context_tree import END, Block, Shards, answers, merged, packed, unpacked
from featlab.llm.exact_dedup import marked

ORDER, SAME, SHARDS = 5, b"\xff", 64
#: Bytes of text in a block.
BLOCK_BYTES = 12_000_000
#: Trusted rows that the model is trained on, at most: those with the least hash of their id among three quarters of them.
TRUSTED_ROWS = 18_000
#: The share of a language's trusted rows, of those that the model was not trained on, that its threshold rejects.
LOST = 0.001
#: A language with fewer calibrating rows takes the median of all.
MEDIAN_ROWS = 20
#: Bytes at the language's median that are added to each text, so that a few odd words don't condemn a short one.
PRIOR = 120


def stream(text: str | None) -> bytes:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return b" ".join([*(SAME + b if a == b else b for a, b in zip([None, *words], words, strict=False)), END])


class Orders:
    """The counts of orders ORDER to 3 of one shard, from its grams of the highest order: counts there, distinct left neighbours below."""

    def __init__(self, gram: np.ndarray, c: np.ndarray, order: int = ORDER):
        self.levels = {order: (gram, c)}
        for n in range(order - 1, 1, -1):
            self.levels[n] = np.unique(self.levels[n + 1][0] & ((1 << (8 * n)) - 1), return_counts=True)

    def log2(self, asked: np.ndarray, discounts: dict[int, list[float]], low: np.ndarray) -> np.ndarray:
        """Of each asked gram. low: the probabilities of order 2, dense."""
        p = low[asked & 0xFFFF]
        for n in sorted(self.levels)[1:]:
            part, weight = interpolation(*self.levels[n], discounts[n], asked & ((1 << (8 * n)) - 1))
            p = part + weight * p
        return np.log2(p)


def interpolation(gram: np.ndarray, c: np.ndarray, discount: list[float], asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each asked gram its discounted part, and its context's weight of the lower order."""
    if not len(gram):
        return np.zeros(len(asked)), np.ones(len(asked))
    d = np.array(discount)[np.minimum(c, 3) - 1]
    context, start = np.unique(gram >> 8, return_index=True)
    total, held = np.add.reduceat(c.astype(float), start), np.add.reduceat(d, start)
    k = np.minimum(np.searchsorted(context, asked >> 8), len(context) - 1)
    seen = context[k] == asked >> 8
    i = np.minimum(np.searchsorted(gram, asked), len(gram) - 1)
    part = np.where(gram[i] == asked, (c[i] - d[i]) / total[k], 0.0)
    return part, np.where(seen, held[k] / total[k], 1.0)


def discounts(seen: dict[int, int]) -> list[float]:
    """Of counts 1, 2 and 3 or more, from how many grams have each count."""
    n1, n2, n3, n4 = (seen.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]


def _counts_of(c: np.ndarray) -> dict[int, int]:
    return {i: int((c == i).sum()) for i in (1, 2, 3, 4)}


class KneserNey:
    """counts: (kind, shard, data), the packed grams of the highest order; what scoring needs beside them is here."""

    def __init__(self, counts: DataFrame, order: int = ORDER):
        self.counts, self.order = counts, order

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for data in rows["data"]:
                    own = Orders(*unpacked(data, "i"), order)
                    gram, c = own.levels[2]
                    yield pd.DataFrame({"n": 2, "key": gram, "c": c})
                    for n in range(3, order + 1):
                        few = _counts_of(own.levels[n][1])
                        yield pd.DataFrame({"n": n, "key": list(few), "c": list(few.values())}, dtype=np.int64)

        # 65,536 rows and four for each order at most
        rows = counts.select("data").mapInPandas(lean(sums), "n long, key long, c long").groupBy("n", "key").agg(F.sum("c").alias("c")).toPandas()
        self.discounts = {n: discounts(dict(rows.loc[rows["n"] == n, ["key", "c"]].itertuples(index=False, name=None))) for n in range(3, order + 1)}
        two = rows[rows["n"] == 2].sort_values("key")
        gram, c = two["key"].to_numpy(np.int64), two["c"].to_numpy(np.int64)
        one, one_c = np.unique(gram & 255, return_counts=True)
        part, weight = interpolation(one, one_c, discounts(_counts_of(one_c)), np.arange(256))
        p = part + weight / 256
        part, weight = interpolation(gram, c, discounts(_counts_of(c)), np.arange(1 << 16))
        self.low = part + weight * np.tile(p, 256)

    def answer(self):
        discount, low, order = self.discounts, self.low, self.order

        def prepare(kind: int, data: bytes):
            own = Orders(*unpacked(data, "i"), order)
            return lambda asked: own.log2(unpacked(asked, "")[0], discount, low).astype("<f4").tobytes()

        return prepare


def _by_shard(keys: np.ndarray, shards: Shards) -> Iterator[tuple[int, np.ndarray]]:
    shard = shards.of(keys)
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange(shards.n + 1))
    return ((k, order[a:b]) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if a < b)


def train(texts: DataFrame, order: int = ORDER, shards: int = SHARDS, block_bytes: int = BLOCK_BYTES) -> KneserNey:
    """texts: a column text."""
    deal = Shards(shards)

    def frames(streams: list[bytes]) -> Iterator[pd.DataFrame]:
        block = Block(streams, order - 1, deal)
        for r in range(len(block.ranges)):
            gram, c = block.counted(r)
            if len(gram):
                yield pd.DataFrame([(int(gram[0]), 2, k, packed(gram[m], c[m])) for k, m in _by_shard(gram, deal)], columns=["block", "kind", "shard", "data"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for rows in batches:
            for s in map(stream, rows["text"]):
                held.append(s)
                size += len(s)
                if size >= block_bytes:
                    yield from frames(held)
                    held, size = [], 0
        if held:
            yield from frames(held)

    counted = texts.select(text_or_empty().alias("text")).mapInPandas(lean(run), "block long, kind int, shard int, data binary")
    return KneserNey(merged(written(counted, "counts")), order)


class _Rows:
    """Some rows on their way into a block. Its number is a digest of the task, its place there and all streams, so a block of the
    second reading finds the answers to its own questions or none."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, row: tuple, s: bytes) -> None:
        self.rows.append((row, s))
        self.size += len(s)

    def number(self, k: int) -> int:
        import xxhash
        from pyspark import TaskContext

        h = xxhash.xxh64(f"{TaskContext.get().partitionId()} {k}".encode())
        for _, s in self.rows:
            h.update(s)
        return h.intdigest() >> 1


def _blocks(docs: DataFrame, schema: str, frames, block_bytes: int) -> DataFrame:
    """docs: text and further columns. frames(block, rows) makes the output of each block of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, k = _Rows(), 0
        for part in batches:
            rest = part.drop(columns="text").astype(object).where(part.drop(columns="text").notna(), None)
            for row, text in zip(rest.itertuples(index=False, name=None), part["text"], strict=True):
                held.add(row, stream(text))
                if held.size >= block_bytes:
                    yield from frames(held.number(k), held.rows)
                    held, k = _Rows(), k + 1
        if held.rows:
            yield from frames(held.number(k), held.rows)

    return docs.mapInPandas(lean(run), schema)


def scored(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", shards: int = SHARDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, lang, h, g, bits, n), one row for each row of docs: two hashes of its id, language and text, code length in bits and number of bytes.

    docs is read twice and has to give its rows in the same order each time, as a table does; else RuntimeError.
    """
    order, deal = model.order, Shards(shards)
    key = [F.col(id_col).cast("string"), F.col(lang_col).cast("string"), F.col(text_col).cast("string")]
    rows = docs.select(F.col(id_col).try_cast("long").cast("string").alias("id"), key[1].alias("lang"), F.xxhash64(*key).alias("h"), F.hash(*key).alias("g"), text_or_empty(text_col).alias("text"))

    def questions(block: int, held: list) -> Iterator[pd.DataFrame]:
        own = Block([s for _, s in held], order - 1, deal)
        for r in range(len(own.ranges)):
            gram, _ = own.counted(r)
            if len(gram):
                yield pd.DataFrame([(block, 2, k, packed(gram[m])) for k, m in _by_shard(gram, deal)], columns=["block", "kind", "shard", "data"])

    def texts(block: int, held: list) -> Iterator[pd.DataFrame]:
        import zstandard

        data = zstandard.ZstdCompressor(level=3).compress(b"".join(s for _, s in held))
        yield pd.DataFrame({"block": [block], "data": [data], "more": [pickle.dumps(([r for r, _ in held], [len(s) for _, s in held]))]})

    asked = written(_blocks(rows, "block long, kind int, shard int, data binary", questions, block_bytes), "questions")
    given = answers(asked, model.counts, model.answer()).withColumnRenamed("block", "to_block")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        if len(left) != 1 or not len(right):
            raise RuntimeError("the rows came in another order the second time; write them as a table first")
        give_back()  # a group is a whole block
        own, sizes = pickle.loads(left["more"].iloc[0])
        data = zstandard.ZstdDecompressor().decompress(left["data"].iloc[0])
        ends = np.cumsum(sizes).tolist()
        block = Block([data[b - n : b] for b, n in zip(ends, sizes, strict=True)], order - 1, deal)
        found, bits = dict(zip(right["shard"], right["data"], strict=True)), np.zeros(len(sizes))
        for r in range(len(block.ranges)):
            gram, _ = block.counted(r)
            value = np.zeros(len(gram))
            for k, m in _by_shard(gram, deal):
                value[m] = -np.frombuffer(found[k], "<f4")
            block.add_sums(bits, r, gram, value)
        ids, langs, h, g = zip(*own, strict=True)
        return pd.DataFrame({"id": pd.array([None if i is None else int(i) for i in ids], "Int64"), "lang": langs, "h": h, "g": g, "bits": bits, "n": sizes})

    left = _blocks(rows, "block long, data binary, more binary", texts, block_bytes)
    return left.groupBy("block").cogroup(given.groupBy("to_block")).applyInPandas(run, "id long, lang string, h long, g int, bits double, n long")


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> tuple[DataFrame, DataFrame]:
    """(id) of the rows that train, at most `most`, and of all other trusted rows, which calibrate: a quarter at least."""
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").try_cast("long").alias("id")).where("id IS NOT NULL").distinct()
    trainers = written(ids.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) != 0).orderBy(F.xxhash64("id"), "id").limit(most), "trainers")
    return trainers, ids.join(trainers, "id", "left_anti")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRUSTED_ROWS) -> tuple[KneserNey, DataFrame]:
    """The model, trained on one row of docs for each trusted id that trains, and the ids that calibrate."""
    trainers, others = trusted_ids(labels, most)
    known = docs.select(F.col("doc_id").try_cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(trainers), "id")  # `most` rows at most
    return train(written(known.groupBy("id").agg(F.min("text").alias("text")).select("text"), "trusted-text")), others


def thresholds(scores: DataFrame, calibrates: DataFrame, lost: float = LOST, prior: int = PRIOR) -> DataFrame:
    """scores: (id, lang, bits, n). (lang, median, threshold, pooled), bits a byte, a row for each language of the rows that calibrate and
    one, with lang null, for all others; no row if nothing calibrates.

    threshold: the empirical quantile 1 - lost of a language's calibrating rows, if it has 1 / lost of them at least. Else pooled: that
    quantile, over the calibrating rows of all languages, of what a row has beyond its language's median, plus the median.
    A language of fewer than MEDIAN_ROWS rows takes the median of all.
    """
    own = written(scores.join(calibrates, "id").select("lang", (F.col("bits") / F.col("n")).alias("x"), "bits", "n"), "calibrating")
    at = lambda c, q: F.percentile_approx(c, q, 1_000_000)
    all_ = own.agg(at("x", 0.5).alias("of_all")).where("of_all IS NOT NULL")
    each = own.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("k"), at("x", 0.5).alias("of_lang")).crossJoin(F.broadcast(all_))  # one row
    medians = each.select("lang", "k", F.when(F.col("k") >= MEDIAN_ROWS, F.col("of_lang")).otherwise(F.col("of_all")).alias("median"))
    medians = written(medians.unionByName(all_.select(F.lit(None).cast("string").alias("lang"), F.lit(0).cast("long").alias("k"), F.col("of_all").alias("median"))), "medians")
    y = (F.col("bits") + prior * F.col("median")) / (F.col("n") + prior)
    rows = _of_language(own, medians, ["median"]).select("lang", y.alias("y"), (y - F.col("median")).alias("beyond"))
    beyond = rows.agg(at("beyond", 1 - lost).alias("beyond"))  # one row
    high = rows.where("lang IS NOT NULL").groupBy("lang").agg(at("y", 1 - lost).alias("high"))
    shown = F.col("k") >= F.ceil(F.lit(1 / lost))
    out = medians.join(high, "lang", "left").crossJoin(F.broadcast(beyond))
    return written(out.select("lang", "median", F.when(shown, F.col("high")).otherwise(F.col("median") + F.col("beyond")).alias("threshold"), (~shown).alias("pooled")), "thresholds")


def _of_language(rows: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """rows with columns of the table's row for their language, or else of its row for all."""
    each = table.where("lang IS NOT NULL").select(F.col("lang").alias("_lang"), *[F.col(c).alias(f"_{c}") for c in columns])
    first = table.where("lang IS NULL").first()
    out = rows.join(each, rows["lang"] == each["_lang"], "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_{c}"), F.lit(None if first is None else first[c]).cast(table.schema[c].dataType)).alias(c) for c in columns])


def _judged(docs: DataFrame, labels: DataFrame, most: int, lost: float = LOST, prior: int = PRIOR) -> DataFrame:
    """(id, lang, h, g, n, log2_perplexity, threshold, pooled, kept)"""
    model, calibrates = fit(docs, labels, most)
    scores = written(scored(docs, model), "scores")
    rows = _of_language(scores, thresholds(scores, calibrates, lost, prior), ["median", "threshold", "pooled"])
    rows = rows.withColumn("log2_perplexity", F.coalesce((F.col("bits") + prior * F.col("median")) / (F.col("n") + prior), F.col("bits") / F.col("n")))
    return rows.withColumn("kept", F.coalesce((F.col("n") <= 1) | (F.col("log2_perplexity") <= F.col("threshold")), F.lit(True)))


def quality(docs: DataFrame, labels: DataFrame, most: int = TRUSTED_ROWS, lost: float = LOST, prior: int = PRIOR) -> DataFrame:
    """(doc_id, lang, n_bytes, log2_perplexity, threshold, pooled, kept), one row for each row of docs.

    log2_perplexity, bits a byte, is shrunk to the language's median by `prior` bytes. A row is kept if that is no more than its
    language's threshold, so a row at the threshold is. lost: the share of a language's trusted rows that the threshold rejects;
    pooled: the language has too few of them to show it (see thresholds). Null and empty texts have one byte, their end, and are kept.
    Without trusted rows that calibrate every document is kept and threshold and pooled are null. Languages without any, and a null
    one, have the pooled threshold. Ids that are no whole number are null. docs is read several times and has to be a table or the like
    (see scored).
    """
    return _judged(docs, labels, most, lost, prior).select(F.col("id").alias("doc_id"), "lang", F.col("n").alias("n_bytes"), "log2_perplexity", "threshold", "pooled", "kept")


def drop_low_quality(docs: DataFrame, labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """docs without the rows that the classifier rejects. Rows are told apart by two hashes (96 bits) of id, language and text.

    A bit filter over the rejected rows is sent to all tasks; only rows that it holds, few but the rejected ones, are joined with them.
    """
    h, g, maybe = fresh("_h", docs), fresh("_g", docs), fresh("_maybe", docs)
    gone = written(_judged(docs, labels, most).where("NOT kept").select(F.col("h").alias(h), F.col("g").alias(g)).distinct(), "rejected")
    key = [F.col(c).cast("string") for c in ("doc_id", "lang", "text")]
    shown = marked(docs, F.xxhash64(*key), gone.select(h), maybe)
    out = shown.where(~F.col(maybe)).unionByName(shown.where(maybe).join(gone, (F.xxhash64(*key) == gone[h]) & (F.hash(*key) == gone[g]), "left_anti"))
    return out.select(*docs.columns)
