"""Chat formatting of reply trees, by DataFrame functions only.

Root-to-leaf paths come from iterative self-joins: round k joins the table of ancestors 2**k replies up
with itself, so a tree of depth n takes log2(n) rounds; the tables then unfold every leaf into its
ancestors, each reached once by the binary digits of its distance. Paths rank by their mean score in the
tree; each chosen one becomes a conversation.

A turn is written as <s>[INST]role[/INST]text</s>. In roles and texts a backslash, < and [ are written
as backslash and 0, 1 or 2, so no control string can occur in them, and reading is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlab.llm.common import written

OPEN, BETWEEN, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_CODES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))


def escaped(c: Column) -> Column:
    for plain, code in _CODES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for plain, code in reversed(_CODES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def reply_paths(nodes: DataFrame) -> DataFrame:
    """nodes: (tree, node, parent). (tree, leaf, node, up): each leaf with all nodes on its path, up replies above it.

    A parent that is null or not in the tree makes its node a root. A reply loop raises ValueError.
    """
    ids = nodes.select("tree", "node")
    parents = nodes.where("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("anc"))
    jump = written(parents.join(ids.select("tree", F.col("node").alias("anc")), ["tree", "anc"], "left_semi").select("tree", "node", "anc"), "jump")
    leaves = ids.join(jump.select("tree", F.col("anc").alias("node")), ["tree", "node"], "left_anti")
    jumps, most = [], nodes.count().bit_length() + 1
    while not jump.isEmpty():
        if len(jumps) > most:
            raise ValueError("a reply loop")
        jumps.append(jump)
        further = jump.select("tree", F.col("node").alias("anc"), F.col("anc").alias("next"))
        jump = written(jump.join(further, ["tree", "anc"]).select("tree", "node", F.col("next").alias("anc")), "jump")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(jumps) - 1, -1, -1):
        paths = written(paths.unionByName(paths.join(jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("anc").alias("node"), (F.col("up") + (1 << k)).alias("up"))), "paths")
    return paths


def format_trees(nodes: DataFrame, best: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """nodes: (tree string, node long, parent long, score double, role, text). One row for each chosen path:
    (tree, leaf, branch_rank, branch_score, n_turns, formatted, loss_spans).

    best: paths for each tree, those with the best mean score (ties: the least leaf); None: all.
    loss_spans: start and end, in code points of formatted, of each text of loss_role. Null roles and
    texts are empty, null scores 0. Node numbers are unique in a tree.
    """
    paths = reply_paths(nodes)
    full = paths.join(nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree", "node"])
    if best is not None:
        rank = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
        chosen = full.groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score")).withColumn("branch_rank", F.row_number().over(rank)).where(F.col("branch_rank") <= best)
        full = full.join(chosen.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(BETWEEN))
    body = escaped(F.col("text"))
    order = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    turns = full.select("tree", "leaf", "up", "score", (F.col("role") == loss_role).alias("loss"), head.alias("head"), body.alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    end = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(CLOSE)
    turns = turns.withColumn("end", end).withColumn("start", F.col("end") - F.length("body"))
    span = F.when(F.col("loss"), F.struct("start", "end"))
    rows = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("k"), "piece"))).alias("pieces"), F.sort_array(F.collect_list(span)).alias("loss_spans"), F.avg("score").alias("branch_score"), F.count("*").alias("n_turns"))
    by = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    return rows.select("tree", "leaf", F.row_number().over(by).alias("branch_rank"), "branch_score", "n_turns", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame, keys: list[str]) -> DataFrame:
    """The turns of formatted rows (keys, formatted, loss_spans): (keys, pos, role, text, loss); loss: the mask covers the text."""
    parts = formatted.select(*keys, F.posexplode(F.split("formatted", r"\Q" + CLOSE + r"\E")).alias("pos", "piece"))
    parts = parts.where(F.length("piece") > 0)  # what follows the last turn
    order = Window.partitionBy(*keys).orderBy("pos")
    end = F.sum(F.length("piece") + len(CLOSE)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(CLOSE)
    cut = F.split("piece", r"\Q" + BETWEEN + r"\E", 2)
    parts = parts.select(*keys, "pos", end.alias("end"), F.substr(cut[0], F.lit(len(OPEN) + 1)).alias("role"), cut[1].alias("body"))
    spans = formatted.select(*keys, F.explode("loss_spans").alias("s")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lit(True).alias("masked"))
    parts = parts.withColumn("start", F.col("end") - F.length("body"))
    return parts.join(spans, [*keys, "start", "end"], "left").select(*keys, "pos", unescaped(F.col("role")).alias("role"), unescaped(F.col("body")).alias("text"), F.coalesce("masked", F.lit(False)).alias("loss"))


def chains(conversations: DataFrame) -> DataFrame:
    """Nodes of (conv_id, turn, role, text): each turn replies to the one before. Turns that tie go by role, then text; rows without conv_id are one conversation."""
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    tree = F.when(F.col("conv_id").isNull(), F.lit("-")).otherwise(F.col("conv_id").cast("string"))
    rows = conversations.select(tree.alias("tree"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the formatted texts."""
    rows = written(format_trees(written(chains(conversations), "nodes")), "formatted")
    turns = read_back(rows, ["tree", "leaf"])
    said = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    per = turns.groupBy("tree", "leaf").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("pos", said.alias("x")))).alias("said"), F.sort_array(F.collect_list(F.when(F.col("loss"), F.struct("pos", F.col("text").alias("x"))))).alias("lost"))
    lost = F.array_join(F.col("lost.x"), "")
    out = per.join(rows.select("tree", "leaf", F.length("formatted").cast("long").alias("formatted_chars")), ["tree", "leaf"])
    return out.select(F.when(F.col("tree") != "-", F.col("tree").cast("long")).alias("conv_id"), F.col("n_turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.col("said.x"), ""), 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars")
