"""Chat formatting: root-to-leaf paths of reply trees, ranked by score, each written as one conversation with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import scratch
from quern.llm.arrays import between, running

OPEN, CLOSE = "<turn:", "</turn>\n"


def escaped(text: Column) -> Column:
    """No ``<`` is left, so no text can hold a mark of the template; :func:`unescaped` is the exact inverse."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit(">"), F.lit("&gt;")), F.lit(">"))


def paths(nodes: DataFrame, max_paths: int | None = None) -> DataFrame:
    """Root-to-leaf paths of ``nodes(tree, node, parent, score)`` as rows ``tree, leaf, rank, node, depth`` (leaf: depth 0).

    Iterative self-joins: pointers to the ancestor 2^k levels up are doubled until none is left; then round k joins the paths
    found so far with those pointers. A chain of a million replies takes 20 rounds, and every round carries keys only. A path's score is the mean
    score of its nodes (null: 0); paths of a tree rank by score, then by leaf, and ``max_paths`` keeps the best.
    A parent that the tree lacks makes its child a root. Nodes on or below a cycle reach no root and are left out.
    Null tree or node: left out. A repeated (tree, node) counts once, with its smallest parent.
    """
    nodes = nodes.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    nodes = scratch.written(nodes, "chat-nodes")
    known = nodes.select("tree", F.col("node").alias("parent"))
    jump = scratch.written(nodes.where("parent is not null").join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up")), "chat-up")
    inner = jump.select("tree", F.col("up").alias("node")).distinct()
    jumps, most = [jump], None  # ancestors 1, 2, 4, ... levels up
    while jumps[-1].limit(1).count():
        if len(jumps) > 6:  # a very deep tree, or a cycle: no path is longer than its table
            most = most or nodes.count()
            if 2 ** (len(jumps) - 1) > most:
                break
        twice = jumps[-1].alias("a").join(jumps[-1].alias("b"), F.expr("a.tree = b.tree and a.up = b.node")).select("a.tree", "a.node", "b.up")
        jumps.append(scratch.written(twice, "chat-up"))
    last = jumps.pop()
    endless = last.select("tree", F.col("node").alias("leaf")).distinct()
    leaves = nodes.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("depth"))
    found = leaves.join(endless, ["tree", "leaf"], "left_anti")
    for k, jump in enumerate(jumps):
        far = found.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("depth") + 2**k).alias("depth"))
        before, found = found, scratch.written(found.unionByName(far), "chat-paths")
        scratch.drop(before)
    if jumps:  # else the paths still read the last table
        scratch.drop(*jumps, last)
    ranked = found.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("path_score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    if max_paths is not None:
        ranked = ranked.where(F.col("rank") <= max_paths)
    return found.join(ranked.select("tree", "leaf", "rank"), ["tree", "leaf"])


def formatted(nodes: DataFrame, max_paths: int | None = None, trained_role: str = "assistant") -> DataFrame:
    """Each chosen path of ``nodes(tree, node, parent, score, role, text)`` as one conversation.

    Returns ``tree, leaf, rank, n_turns, formatted, loss_mask``: the turns from the root as
    ``<turn:ROLE>TEXT</turn>\\n`` with escaped texts, and the (start, length) code-point spans of the texts of ``trained_role``.
    Null role or text: empty. A node id that repeats in its tree keeps its smallest (role, text). Rows without a tree or node are left out. Empty table:
    no rows. Other columns are ignored. A conversation is one row, so its turns meet in one task; its time grows with their number and length, as
    places are running sums of lengths.
    """
    chosen = paths(nodes, max_paths)
    said = nodes.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("said"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("at"), "said"))), lambda t: t["said"])
    out = chosen.join(said, ["tree", "node"]).groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), turns.alias("turns"))
    pieces = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), _head(t["role"]).alias("head"), escaped(t["text"]).alias("body")))
    out = out.select("tree", "leaf", "rank", F.size("turns").cast("bigint").alias("n_turns"), pieces.alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    lengths = F.transform("pieces", lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).cast("bigint"))
    out = out.select("tree", "leaf", "rank", "n_turns", text.alias("formatted"), "pieces", lengths.alias("lengths"))
    out = out.withColumn("ends", running(F.col("lengths"), kind="bigint"))
    own = F.filter(F.arrays_zip(F.col("pieces").alias("p"), F.col("ends").alias("e")), lambda z: z["p"]["role"] == trained_role)

    def span(z: Column) -> Column:
        n = F.length(z["p"]["body"]).cast("bigint")
        return F.struct((z["e"] - len(CLOSE) - n + 1).alias("start"), n.alias("length"))

    return out.select("tree", "leaf", "rank", "n_turns", "formatted", F.transform(own, span).alias("loss_mask"))


def read_back(text: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>."""
    rows = F.split(text, CLOSE)
    return F.transform(
        F.slice(rows, 1, F.size(rows) - 1),
        lambda t: F.struct(
            unescaped(F.replace(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), ">", 1), F.lit("&gt;"), F.lit(">"))).alias("role"),
            unescaped(F.substr(t, F.instr(t, ">") + 1)).alias("text"),
        ),
    )


def loss_text(cut: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order, nothing between, of a formatted conversation cut by :func:`quern.llm.arrays.pieces`, a column of its own."""
    return F.array_join(F.transform(mask, lambda s: unescaped(between(cut, s["start"] - 1, s["start"] - 1 + s["length"]))), "")


def reply_chain(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as trees of one branch: every turn answers the one before.

    Turns order by turn, then role and text; null turns come first. ``tree`` is a struct of the conv_id, so that rows without one are one conversation as well.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.struct("conv_id").alias("tree"), F.row_number().over(order).cast("bigint").alias("node"), F.lit(0.0).alias("score"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
