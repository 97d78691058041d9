"""Chat formatting of reply trees, with DataFrame functions only.

Nodes (tree, node, parent, role, text, score) form trees. Iterative self-joins double each node's pointer to its ancestors, which gives
depth and path score of every node in a logarithmic number of rounds; leaves rank their root-to-leaf paths by mean score; the
chosen paths are enumerated by following the kept pointers down from the largest. Each path becomes one conversation.

Template, for each turn: <|start|>role NEWLINE text <|end|>. Inside roles and texts control strings are escaped by
entities, and entities themselves too, so that parsing gives back the same turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

START, END = "<|start|>", "<|end|>"
#: Order matters: entities first. Every control string of this template and of common others.
ESCAPES = (("&amp;", "&amp;amp;"), ("&lt;", "&amp;lt;"), ("&lbr;", "&amp;lbr;"), ("&nl;", "&amp;nl;"), ("<|", "&lt;|"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&lbr;INST]"), ("[/INST]", "&lbr;/INST]"))
UNESCAPES = (("&lt;", "<"), ("&lbr;", "["), ("&amp;", "&"))
TRAINED_ROLE = "assistant"


def _replaced(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(text: Column) -> Column:
    return _replaced(text, ESCAPES)


def unescape(text: Column) -> Column:
    return _replaced(text, UNESCAPES)


def turn_text(role: Column, text: Column) -> Column:
    role = F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("&nl;"))
    return F.concat(F.lit(START), role, F.lit("\n"), escape(F.coalesce(text, F.lit(""))), F.lit(END))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|start\|>", -1), lambda x, i: i > 0)

    def turn(x: Column) -> Column:
        body = F.substring(x, F.lit(1), F.char_length(x) - len(END))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape(F.replace(role, F.lit("&nl;"), F.lit("\n"))).alias("role"), unescape(F.substring(body, F.char_length(role) + 2, F.char_length(body))).alias("text"))

    return F.transform(parts, turn)


def ranked_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """nodes (tree, node, parent, score) -> (tree, leaf, rank, node, depth): the nodes of each tree's `keep` best root-to-leaf paths.

    Ranks by mean score, then by length, then by leaf id; null scores count as 0. A node whose parent is null or missing is a root. Nodes on
    a cycle belong to no path. A repeated (tree, node) keeps one of its rows, the smallest. The null tree is a tree; a null node is no node. Other columns
    are ignored. An empty table gives no paths.
    """
    return _ranked(_as_keys(nodes).select("tree", "node", "parent", "score"), keep).withColumn("tree", F.col("tree.id"))


def _as_keys(nodes: DataFrame) -> DataFrame:
    """nodes with tree in a struct, in which nulls are equal: so the null tree joins like any other."""
    return nodes.where("node is not null").withColumn("tree", F.struct(F.col("tree").alias("id")))


def _ranked(nodes: DataFrame, keep: int) -> DataFrame:
    n = nodes.groupBy("tree", "node").agg(F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("r")).select("tree", "node", "r.parent", F.col("r.score").alias("score"))
    has = n.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    n = materialize(n.join(has, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"), "nodes")
    jump, levels, left = n.select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), [], None
    while True:
        levels.append(jump)
        now = jump.where("up is not null").count()
        if not now or now == left:  # the rest, if any, lies on cycles
            break
        left = now
        above = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        moved = jump.where("up is not null").join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total"))
        jump = materialize(jump.where("up is null").union(moved), "jump")
    leaves = jump.where("up is null").join(n.select("tree", F.col("parent").alias("node")).where("node is not null"), ["tree", "node"], "left_anti")
    best = W.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    path = materialize(leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).select("tree", F.col("node").alias("leaf"), "rank", "node"), "leaves")
    for level in reversed(levels[:-1]):  # the last has only roots, or cycles
        more = path.join(level.select("tree", "node", "up").where("up is not null"), ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"))
        path = materialize(path.union(more).distinct(), "path")
    return path.join(jump.select("tree", "node", "depth"), ["tree", "node"]).select("tree", "leaf", "rank", "node", "depth")


def format_trees(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """nodes (tree, node, parent, role, text, score) -> (tree, leaf, rank, formatted), one row for each chosen path, chosen as by ranked_paths.

    Null roles and texts are empty. One conversation is one string, so its turns must fit a task.
    """
    nodes = _as_keys(nodes)
    path = _ranked(nodes.select("tree", "node", "parent", "score"), keep)
    said = nodes.groupBy("tree", "node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("r")).select("tree", "node", turn_text(F.col("r.role"), F.col("r.text")).alias("turn"))
    turns = path.join(said, ["tree", "node"]).groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "turn"))).alias("turns"))
    return turns.select("tree.id", "leaf", "rank", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted")).withColumnRenamed("id", "tree")


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, formatted) -> the digest columns of what parsing the output gives. A null formatted text has no turns."""
    parsed = formatted.select("tree", "formatted", F.coalesce(parse_turns(F.col("formatted")), F.array().cast("array<struct<role:string,text:string>>")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == TRAINED_ROLE), lambda x: x["text"]), "")
    all_ = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return parsed.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(all_, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def conversation_nodes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees: each row answers the one before it by (turn, role, text).

    Repeated rows are turns of their own. Null turns come first; null texts and roles are empty. Rows of a null conv_id form one conversation, whose id stays
    null. Other columns are ignored; an empty table has no nodes.
    """
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    t = turns.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = t.withColumn("node", F.row_number().over(order).cast("long"))
    return at.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
