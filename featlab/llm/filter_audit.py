"""How document filters overlap: for every order of five filters and every step, what it removes, by part.

Each document gets a mask of the filters that it fails. Duplicates are found by sorting: rows are dealt by
ranges of the text's fingerprint, its SHA-256 and the id, each task sorts its range by fingerprint, SHA-256,
text and id, and compares each text with the one before it. (The digest stands for the text where ranges are
drawn, since the range sampler sends keys to the driver; the texts themselves are compared inside a task.) A
text whose rows lie in several ranges is a boundary case: each task names the text of its last run and that
run's least id, one row a task, and the rows that a task couldn't decide, those at the head of its first run,
are decided by the least id that any task named for their text. Rows repeated whole are dealt to several
ranges, too, so one group of copies or one repeated row never makes a task longer.

Masks merge into counters by part, mask and label; 32 masks a part give all orders and steps, because what
a step removes depends on the masks alone: clear[S] counts the documents that fail no filter of S.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.llm.common import framed, parts, text_or_empty, written

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
_MARKS = re.compile(r"[#$%&*|]")
_NO_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
E_BIT = 1 << FILTERS.index("E")


def own_mask(text: str, least_words: int = LEAST_WORDS, distinct_percent: int = DISTINCT_PERCENT, capital_percent: int = CAPITAL_PERCENT) -> int:
    """The filters A to D that a text fails, bit 0 for A."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes are split at ASCII white space only
    n = len(words)
    return (
        (n < least_words)
        | (100 * len(set(words)) < distinct_percent * n) << 1
        | (100 * len(data.translate(None, _NO_CAPITAL)) > capital_percent * len(text)) << 2
        | (_MARKS.search(text) is not None) << 3
    )


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", **limits: int) -> DataFrame:
    """(id, part, mask, open, digest, least), one row for each row of docs; written.

    open: E isn't decided by this row's task; digest is then its text's, as it is at the last row of a task,
    where least has the least id of the task's last run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, least, head, held = None, None, True, None
        for rows in batches:
            out = []
            for id_, text, part in zip(rows["id"], rows["text"], rows["part"], strict=True):
                id_ = None if id_ is None else int(id_)
                if before is not None and text != before:
                    head, least = False, None
                if text != before:
                    own, digest = own_mask(text, **limits), None
                before = text
                if least is None:
                    least = id_
                if id_ is not None and least < id_:
                    out.append([id_, part, own | E_BIT, False, None, None])
                else:
                    if head and digest is None:
                        digest = _digest(text)
                    out.append([id_, part, own, head, digest if head else None, None])
            if out:
                if held is not None:
                    yield held
                held = framed(out, ["id", "part", "mask", "open", "digest", "least"], ("id", "mask", "least"))
        if held is not None:
            at = held.index[-1]
            held.at[at, "digest"] = digest or _digest(before)
            if least is not None:
                held.at[at, "least"] = least
            yield held

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).try_cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("fingerprint", F.xxhash64("text")).withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("nth", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parts(docs.sparkSession), "fingerprint", "sha", "id", "nth").sortWithinPartitions("fingerprint", "sha", "text", "id")
    return written(dealt.select(F.col("id").cast("string").alias("id"), "text", "part").mapInPandas(run, "id long, part string, mask int, open boolean, digest binary, least long"), "masks")


def decided(rows: DataFrame) -> DataFrame:
    """(id, part, mask) with E decided across the tasks of masks()."""
    named = rows.where("least IS NOT NULL").groupBy("digest").agg(F.min("least").alias("first"))  # one row a task at most
    late = rows.where("open").select("id", "part", "mask", "digest").join(F.broadcast(named), "digest", "left")
    late = late.select("id", "part", F.when(F.col("first") < F.col("id"), F.col("mask").bitwiseOR(F.lit(E_BIT))).otherwise(F.col("mask")).alias("mask"))
    return rows.where("NOT open").select("id", "part", "mask").unionByName(late)


def counters(marked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic)"""
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.select(F.col(id_col).try_cast("long").alias("id"), "quality", "toxic").where("id IS NOT NULL").groupBy("id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    merged = marked.groupBy("id", "part", "mask").agg(F.count("*").alias("n"))  # a repeated row is one from here on
    each = merged.join(known, "id", "left")
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", **limits: int) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each part.

    Filters: A fewer than least_words words; B distinct words under distinct_percent of the words; C capitals
    A-Z over capital_percent of the code points; D any of # $ % & * |; E the text of a row with a smaller id.
    Rows without an id (or with one that is no whole number) fail E never, nor make others fail it; rows that
    repeat an id and text fail it only if a smaller id has the text. A null text is empty, a null part the
    empty string. A document is good or toxic if any row of labels says so. No documents, no rows.
    """
    found = counters(decided(masks(docs, id_col, text_col, part_col, **limits)), labels, id_col)
    names, filters = ("n", "good", "toxic"), len(FILTERS)
    by = found.groupBy("part").agg(F.collect_list(F.struct("mask", *names)).alias("m"))  # 2**5 at most

    def total(c: str, keep):
        return F.aggregate(F.filter("m", keep), F.lit(0).cast("long"), lambda a, r: a + r[c])

    without = lambda c: lambda s: total(c, lambda r: r["mask"].bitwiseAND(s) == 0)
    clear = [F.transform(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), without(c)).alias(c) for c in names]
    only = lambda b: lambda r: r["mask"] == 1 << b
    holds = lambda b: lambda r: r["mask"].bitwiseAND(F.lit(1 << b)) != 0
    alone = F.array(*[total("n", only(b)) for b in range(filters)]).alias("alone")
    # a filter comes first among the failures of a document in 120 / (number of them) of the orders
    share = [F.aggregate(F.filter("m", holds(b)), F.lit(0).cast("long"), lambda a, r: a + r["n"] * (F.lit(120) / F.bit_count(r["mask"])).cast("long")) for b in range(filters)]
    by = by.select("part", *clear, alone, F.array(*share).alias("share"))
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [(order, k + 1, FILTERS.index(order[k]), bit[order[k]], sum(bit[f] for f in order[:k])) for order in map("".join, permutations(FILTERS)) for k in range(filters)]
    fields = ("filter_order", "step", "b", "own", "before")
    every = F.from_json(F.lit(json.dumps([dict(zip(fields, row, strict=True)) for row in steps])), "array<struct<filter_order:string,step:int,b:int,own:int,before:int>>")
    rows = by.withColumn("s", F.explode(every)).select("*", "s.*")
    after = F.col("before") + F.col("own")
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, after)
    fails = F.get("n", F.lit(0)) - F.get("n", F.col("own"))
    return rows.select(
        "part", "filter_order", "step", F.get("n", after).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"),
        F.get("alone", F.col("b")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("share", F.col("b")).alias("shapley"),
    )
