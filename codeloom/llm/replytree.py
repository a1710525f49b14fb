"""Conversations from reply trees: all root-to-leaf paths, their rank by score, and each chosen path as one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize


def leaf_paths(messages: DataFrame) -> DataFrame:
    """(conv, leaf, node, dist): every message on the way from each leaf up, by self-joins whose reach doubles.

    The ancestors 2^k steps up come from joining the ancestors 2^(k-1) steps up with themselves, so that a thread of depth d takes about
    log2(d) joins. No way is longer than its conversation has messages; a chain that runs into a cycle is followed for at most twice that.
    """
    sizes = messages.groupBy("conv").agg(F.count(F.lit(1)).alias("size"))
    up = materialize(messages.where("parent is not null").join(sizes, "conv").select("conv", "id", F.col("parent").alias("up"), "size"), "up")
    leaves = messages.join(up.select("conv", F.col("up").alias("id")).distinct(), ["conv", "id"], "left_anti")
    paths = materialize(leaves.select("conv", F.col("id").alias("leaf"), F.col("id").alias("node"), F.lit(0).cast("bigint").alias("dist")), "paths")
    step = 1
    while not up.isEmpty():
        more = paths.join(up.select("conv", F.col("id").alias("node"), "up"), ["conv", "node"]).select("conv", "leaf", F.col("up").alias("node"), (F.col("dist") + step).alias("dist"))
        old = paths, up
        paths = materialize(paths.unionByName(more), "paths")
        further = up.select("conv", F.col("id").alias("up"), F.col("up").alias("far"))
        # where the way is longer than the conversation it goes round
        up = materialize(up.where(F.col("size") > 2 * step).join(further, ["conv", "up"]).select("conv", "id", F.col("far").alias("up"), "size"), "up")
        for table in old:
            discard(table)
        step *= 2
    discard(up)
    return paths


def chosen_conversations(
    messages: DataFrame, conv_col: str = "conv_id", id_col: str = "turn", parent_col: str = "parent", role_col: str = "role", text_col: str = "text", score_col: str = "score", branches: int = 1, begin: str = "<|im_start|>", end: str = "<|im_end|>"
) -> DataFrame:
    """(conv_id, root, leaf, branch, n_messages, score, text): the best `branches` root-to-leaf paths of each tree, each as one text.

    A path's score is the mean of its messages' scores that aren't NULL, 0 without any; ties go to the lesser leaf. Each message
    becomes begin + role + newline + text + end, joined by newlines; a NULL role is written `user`, a NULL text as empty. A message whose
    parent is NULL or doesn't exist is a root. Texts are taken whole; other columns take no part. Rows without conversation or message id take no part; of rows that repeat both the least
    (parent, role, text, score; NULLs first) counts. Chains that end in a cycle have no root and are dropped. Depth is not limited. An empty table
    gives no row.
    """
    pick = {"conv": conv_col, "id": id_col, "parent": parent_col, "role": role_col, "text": text_col, "score": score_col}
    rows = messages.select(*[F.col(f"`{c}`").alias(n) for n, c in pick.items()]).where("conv is not null and id is not null")
    rows = rows.groupBy("conv", "id").agg(F.min(F.struct("parent", "role", "text", F.col("score").cast("double").alias("score"))).alias("m")).select("conv", "id", "m.*")
    there = rows.select("conv", F.col("id").alias("parent"), F.lit(True).alias("there"))
    rows = materialize(rows.join(there, ["conv", "parent"], "left").withColumn("parent", F.when(F.col("there"), F.col("parent"))).drop("there"), "messages")

    # what scoring needs, without the texts
    path = leaf_paths(rows.select("conv", "id", "parent"))
    scored = path.join(rows.select("conv", F.col("id").alias("node"), F.col("parent").isNull().alias("is_root"), "score"), ["conv", "node"])
    per_leaf = scored.groupBy("conv", "leaf").agg(F.max(F.when(F.col("is_root"), F.col("node"))).alias("root"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"), F.count(F.lit(1)).alias("n_messages")).where("root is not null")
    best = per_leaf.withColumn("branch", F.row_number().over(Window.partitionBy("conv", "root").orderBy(F.desc("score"), "leaf"))).where(F.col("branch") <= branches)

    one = F.concat(F.lit(begin), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end))
    told = path.join(best, ["conv", "leaf"]).join(rows.select("conv", F.col("id").alias("node"), one.alias("message")), ["conv", "node"])
    ordered = F.sort_array(F.collect_list(F.struct("dist", "message")), asc=False)
    out = told.groupBy("conv", "leaf", "root", "branch", "n_messages", "score").agg(F.array_join(F.transform(ordered, lambda m: m["message"]), "\n").alias("text"))
    return out.select(F.col("conv").alias("conv_id"), "root", "leaf", "branch", "n_messages", "score", "text")


def reply_tree_of_threads(conversations: DataFrame) -> DataFrame:
    """The table's linear threads (conv_id, turn, role, text) as reply trees with a score.

    The table names no parent. A message replies to the turn before it; but one whose text length is a multiple of 4 counts as another
    answer to what the message two turns earlier answered, so it replies to turn - 3 and opens a branch. Answers of the assistant score
    their length in characters, other messages have no score. Rows are passed on one by one: NULLs stay NULL (a NULL text opens no branch and has no
    score), repeated rows stay, an empty table stays empty.
    """
    again = (F.char_length("text") % 4 == 0) & (F.col("turn") >= 3)
    return conversations.select("conv_id", "turn", "role", "text", F.when(again, F.col("turn") - 3).when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"), F.when(F.col("role") == "assistant", F.char_length("text").cast("double")).alias("score"))
