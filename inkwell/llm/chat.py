"""Chat formatting: reply trees to root-to-leaf paths to one formatted conversation each. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkwell.llm.common import checkpointed

START, END = "<|im_start|>", "<|im_end|>"


def escape(col: Column) -> Column:
    """Follow every ``<|`` by another ``|``: no control string is left, and removing those bars again is exact."""
    return F.replace(col, F.lit("<|"), F.lit("<||"))


def unescape(col: Column) -> Column:
    return F.replace(col, F.lit("<||"), F.lit("<|"))


def escape_role(col: Column) -> Column:
    """A role ends at the first line break, so its own line breaks become ``<|n|>``, which no escaped text holds."""
    return F.replace(escape(col), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(col: Column) -> Column:
    return unescape(F.replace(col, F.lit("<|n|>"), F.lit("\n")))


def leaf_paths(nodes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """All root-to-leaf paths of reply trees: rows ``(tree, leaf, node, up)``, ``up`` the steps from the leaf.

    ``nodes(tree, node, parent)`` has unique (tree, node); a null or unknown parent makes a root. The self-join is
    iterated by doubling: round k knows each node's ancestor 2^k steps up, and extends every path by what lies above
    its last 2^k steps, so a path of d nodes takes log2(d) joins, each on the unique key (tree, node). A null tree is a
    tree like others: joins see it inside a struct, which is never null. Replies that run into a loop have no root and
    form no path.
    """
    nodes = nodes.withColumn("tree", F.struct("tree"))
    known = nodes.select("tree", F.col("node").alias("parent"))
    jump = nodes.select("tree", "node", "parent").join(known, ["tree", "parent"], "left_semi").where("parent <> node")
    jump = checkpointed(jump.select("tree", "node", F.col("parent").alias("anc")))
    inner = jump.select("tree", F.col("anc").alias("node")).distinct()
    paths = checkpointed(nodes.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    step, last = 1, None
    for _ in range(max_rounds):
        more = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("anc").alias("node"), (F.col("up") + step).alias("up"))
        higher = jump.alias("a").join(jump.alias("b"), (F.col("a.tree") == F.col("b.tree")) & (F.col("a.anc") == F.col("b.node")))
        jump = checkpointed(higher.select("a.tree", "a.node", F.col("b.anc").alias("anc")))
        paths = checkpointed(paths.unionByName(more))
        step *= 2
        left = jump.count()
        if left in (0, last):  # some chain that ends would have ended in this round, so only loops are left
            rooted = paths.join(jump.select("tree", F.col("node").alias("leaf")), ["tree", "leaf"], "left_anti") if left else paths
            return rooted.withColumn("tree", F.col("tree.tree"))
        last = left
    raise RuntimeError("a reply chain is deeper than 2^max_rounds")


def format_trees(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """Format the ``top`` best branches of every tree (all, if None), each as one conversation string.

    ``nodes(tree, node, parent, score, role, text)``; a branch's score is the mean score of its nodes (null: 0), ties
    go to the smaller leaf. Null roles and texts are empty. Returns ``(tree, leaf, rank, n_turns, formatted)``. An
    empty table gives no rows. Repeated (tree, node) rows keep one, the smallest by (role, text). Rows of a null tree form
    one tree, whose key is null in the result.
    """
    nodes = nodes.withColumn("tree", F.struct("tree"))
    first = W.partitionBy("tree", "node").orderBy("role", "text", "parent")
    nodes = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    nodes = checkpointed(nodes.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n"))
    paths = leaf_paths(nodes.select("tree", "node", "parent"))
    scored = paths.join(nodes.select("tree", "node", "score"), ["tree", "node"])
    branches = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    branches = branches.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if top is not None:
        branches = branches.where(F.col("rank") <= top)
    turn = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    turns = paths.join(branches.drop("score"), ["tree", "leaf"]).join(nodes.select("tree", "node", turn.alias("turn")), ["tree", "node"])
    packed = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("o"), "turn"))).alias("t"))
    return packed.select("tree.tree", "leaf", "rank", F.size("t").cast("long").alias("n_turns"), F.array_join(F.col("t.turn"), "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as ``array<struct<role, text>>``, unescaped."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def one(part: Column) -> Column:
        body = F.substring(part, len(START) + 1, 2**31 - 1)
        role = F.substring_index(body, "\n", 1)
        text = body.substr(F.length(role) + 2, F.greatest(F.length(body) - F.length(role) - 1, F.lit(0)))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, one)


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """What the loss mask covers: the texts of ``role``, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")
