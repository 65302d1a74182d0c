"""Exact deduplication by a log-structured merge index over text digests.

Each row's (id, digest) goes to a log, dealt to MEMTABLES memtables by a hash of the id. A memtable
merges its copies, first in each task and then by digest, and is flushed as a run: (digest, least_id, n)
sorted by digest over all its files, with Parquet statistics and Bloom filters on the digest, so a
lookup reads only the row groups that may hold it. Compaction merges FAN_IN runs of a level into one of
the next by ranges of the digest, least id and sum of n, as often as it takes; one run is left.

Digests with several rows are hits. Hits receive byte verification: a bit filter over the hits, sized by
their number, lets their texts and few others pass a second scan, which groups by the digest and the
text itself, so equal keys mean equal bytes. Copies are merged before each shuffle, so a group with a
third of all rows costs a row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.llm.common import SPACE, fresh, parts, scratch, text_or_empty, written

MEMTABLES, FAN_IN = 4, 4
#: The filter over hits has 2**FILTER_WORDS rows of 64 bits (8 Mbit), and more where there are more than a bit for FILTER_BITS
#: of them: up to 2**FILTER_MOST rows (128 Mbit). Beyond 8 million hits more texts that are none pass and are grouped.
FILTER_WORDS, FILTER_MOST, FILTER_BITS = 17, 21, 16


def normalised(column: str = "text"):
    return F.regexp_replace(text_or_empty(column), SPACE, " ")


def _digest(norm):
    return F.unhex(F.sha2(norm, 256))


class DigestIndex:
    """Runs (digest, least_id, n) in the shared folder, each sorted by digest; levels[k] holds those merged k times."""

    def __init__(self, spark, fan_in: int = FAN_IN):
        self.spark, self.fan_in, self.levels = spark, fan_in, [[]]

    def _write(self, rows: DataFrame, level: int) -> None:
        path = scratch(self.spark, f"run-{level}")
        rows.select("digest", "least_id", "n").sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", "100000").parquet(path)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(path)

    def _by_range(self, rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange(parts(self.spark), "digest")

    def flush(self, rows: DataFrame) -> None:
        """rows: (id, digest), one memtable. Its copies are merged, then it becomes a run."""
        self._write(self._by_range(rows.groupBy("digest").agg(F.min("id").alias("least_id"), F.count("*").alias("n"))), 0)

    def compact(self) -> None:
        """Merges fan_in runs of a level at a time, from the lowest level up, until one run is left."""
        while sum(map(len, self.levels)) > 1:
            level = next(k for k, runs in enumerate(self.levels) if runs)
            some, self.levels[level] = self.levels[level][: self.fan_in], self.levels[level][self.fan_in :]
            if len(some) == 1:  # nothing to merge it with here
                self.levels += [[] for _ in range(level + 2 - len(self.levels))]
                self.levels[level + 1].append(some[0])
            else:
                rows = self._by_range(self.spark.read.parquet(*some))
                self._write(rows.groupBy("digest").agg(F.min("least_id").alias("least_id"), F.sum("n").alias("n")), level + 1)

    def compacted(self) -> DataFrame:
        """(digest, least_id, n) of all memtables flushed."""
        self.compact()
        return self.spark.read.parquet(*[path for runs in self.levels for path in runs])

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """The rows of some digests; statistics and Bloom filters skip the row groups that hold none of them."""
        return self.compacted().where(F.col("digest").isin([bytearray(d) for d in digests]))

    def hits(self) -> DataFrame:
        return self.compacted().where("n > 1").select("digest")


def filter_words(hits: int) -> int:
    """log2 of the rows of the filter over so many hits."""
    return min(FILTER_MOST, max(FILTER_WORDS, (hits * FILTER_BITS // 64).bit_length()))


def bit_place(digest, words: int):
    h = F.xxhash64(digest)
    return F.pmod(h, F.lit(1 << words)).cast("int"), F.shiftright(h, 40).bitwiseAND(F.lit(63)).cast("int")


def hit_filter(hits: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """(word, bits), 2**words rows at most."""
    word, bit = bit_place(F.col("digest"), words)
    one = F.expr("shiftleft(1L, bit)")
    return hits.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(one).alias("bits"))


def marked(rows: DataFrame, key, keys: DataFrame, name: str) -> DataFrame:
    """rows with a column `name`: false if key is certainly not among keys (one column). The filter over keys is what is broadcast."""
    held = keys.select(F.col(keys.columns[0]).alias("digest"))
    words = filter_words(keys.count())
    word, bit = bit_place(key, words)
    at, held_bits, taken = fresh("_word", rows), fresh("_bits", rows), rows.columns
    bits = hit_filter(held, words).select(F.col("word").alias(at), F.col("bits").alias(held_bits))
    joined = rows.withColumn(at, word).join(F.broadcast(bits), at, "left")
    return joined.select(*taken, F.coalesce(F.getbit(held_bits, bit) == 1, F.lit(False)).alias(name))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """(id, norm, digest)"""
    norm = normalised(text_col)
    return docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("digest", F.substring(_digest(F.col("norm")), 1, digest_bytes))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """(id_col, keep_id, group_size, kept, digest), one row for each row of docs.

    Texts are equal when identical after each run of white space becomes one space; null is empty.
    The row with the least id stays; of repeated rows with one id and text, one. Null ids come after
    all others: keep_id is null only if no row of the group has an id. digest: the first digest_bytes
    of the SHA-256 of the normalised text; texts that share a digest are told apart by their bytes.
    """
    index = DigestIndex(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col, digest_bytes)
    path = scratch(docs.sparkSession, "log")
    log = keyed.select("id", "digest", F.pmod(F.xxhash64("id"), F.lit(MEMTABLES)).cast("int").alias("memtable"))
    log.write.partitionBy("memtable").parquet(path)  # a memtable's rows are read alone
    log = docs.sparkSession.read.schema(log.schema).parquet(path)
    for k in range(MEMTABLES):
        index.flush(log.where(F.col("memtable") == k))
    hits = index.hits()

    words = filter_words(hits.count())
    word, bit = bit_place(F.col("digest"), words)
    passed = keyed.withColumn("word", word).withColumn("bit", bit).join(F.broadcast(hit_filter(hits, words)), "word").where(F.expr("shiftright(bits, bit) & 1L") == 1)
    groups = passed.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    verified = written(groups.select("digest", F.xxhash64("norm").alias("text_hash"), "keep_id", "group_size").join(hits, "digest", "left_semi"), "verified")
    each = log.groupBy("id", "digest").agg(F.count("*").alias("n_rows"))
    shared = verified.groupBy("digest").count().where("count > 1").select("digest")
    if shared.isEmpty():
        out = each.join(verified.select("digest", "keep_id", "group_size"), "digest", "left")
    else:  # the same with the whole text as the key, for the digests that stand for several texts
        alone = each.join(shared, "digest", "left_anti").join(verified.select("digest", "keep_id", "group_size"), "digest", "left")
        clashing = passed.join(shared, "digest", "left_semi").groupBy("id", "digest", "norm").agg(F.count("*").alias("n_rows"))
        own = groups.join(shared, "digest", "left_semi")
        out = alone.unionByName(clashing.join(own, ["digest", "norm"]).select(*alone.columns))
    single = F.col("group_size").isNull()
    out = out.select("id", F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "digest", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("nth"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", ((F.col("nth") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups doesn't keep; all columns stay as they are."""
    kept = exact_groups(docs, id_col, text_col)
    # a text whose row stays is a (_id, _digest); more than one row there: repeated rows
    key, digest, own = (fresh(c, docs) for c in ("_id", "_digest", "_own"))
    kept = written(kept.groupBy(F.col(id_col).alias(key), F.col("digest").alias(digest)).agg(F.max("kept").alias("stays"), F.count("*").alias("n_rows")).where("stays").drop("stays"), "kept")
    shown = docs.withColumn(own, _digest(normalised(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(own) == F.col(digest))
    out = shown.join(kept.where("n_rows = 1"), same, "left_semi")
    again = kept.where("n_rows > 1")
    if not again.isEmpty():
        out = out.unionByName(shown.join(again, same, "left_semi").dropDuplicates([id_col, own]))
    return out.select(*docs.columns)
