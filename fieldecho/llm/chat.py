"""Reply trees as chat conversations, in DataFrame operations only.

Messages name their parent. Self-joins that double the distance, and joins that halve it again, enumerate every root-to-leaf path;
a path's score is the mean score of its messages; the best paths of a tree are formatted, each as
one conversation.

The template opens a turn with ``<|turn|>``, parts role and text with ``<|text|>`` and closes with
``<|end|>`` and a line feed. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|``, so no text can forge a marker and every text can be read back. The loss mask covers the
escaped text of assistant turns.

Null roles, texts and scores count as empty strings and 0. A message whose parent is not in its
tree is a root. Messages on or below a cycle of parents are on no path. Of messages that share tree
and id the first by (parent, role, text) counts. Equal scores rank by leaf id. A null tree id is a
tree of its own. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

OPEN, TEXT, CLOSE = "<|turn|>", "<|text|>", "<|end|>\n"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def linear(turns: DataFrame, tree: str = "conv_id") -> DataFrame:
    """Messages of conversations that are plain lists of turns: each answers the one before. Turns with equal numbers follow by role and text."""
    at = F.row_number().over(Window.partitionBy(tree).orderBy("turn", "role", "text"))
    rows = turns.select(F.col(tree).alias("tree"), at.cast("long").alias("id"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(0.0))


def _same(a: list[str], b: list[str]) -> Column:
    cond = F.lit(True)
    for x, y in zip(a, b):
        cond = cond & F.col(x).eqNullSafe(F.col(y))
    return cond


def _target(jump: DataFrame) -> DataFrame:
    return jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, dist): every message on the path of every leaf, ``dist`` steps above it. ``messages`` have one row per (tree, id)."""
    nodes = messages.select("tree", F.col("id").alias("node"), F.col("parent").alias("up"))
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    steps = stored(nodes.join(known, _same(["tree", "up"], ["_t", "_n"]), "left_semi").filter("up is not null"), "replies")
    above = steps.select(F.col("tree").alias("_t"), F.col("up").alias("_n")).distinct()
    leaves = nodes.join(above, _same(["tree", "node"], ["_t", "_n"]), "left_anti")
    longest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps = [steps] if longest > 1 else []
    while 1 << len(jumps) < longest:  # jumps[k] leads 2 ** k steps up
        far = _target(jumps[-1])
        jumps.append(stored(jumps[-1].join(far, _same(["tree", "up"], ["_t", "_n"])).select("tree", "node", F.col("_up").alias("up")), "replies"))
    out = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("dist"))
    here = F.struct(F.col("node").alias("node"), F.col("dist").alias("dist"))
    for k in reversed(range(len(jumps))):  # so far every 2 ** (k + 1)th message of a path, and now those between
        there = F.struct(F.col("_up").alias("node"), (F.col("dist") + (1 << k)).alias("dist"))
        both = F.when(F.col("_up").isNull(), F.array(here)).otherwise(F.array(here, there))
        met = out.join(_target(jumps[k]), _same(["tree", "node"], ["_t", "_n"]), "left")
        out = met.select("tree", "leaf", F.explode(both).alias("x")).select("tree", "leaf", "x.node", "x.dist")
    out = stored(out, "paths")
    rooted = out.join(steps.select(F.col("tree").alias("_t"), F.col("node").alias("_n")), _same(["tree", "node"], ["_t", "_n"]), "left_anti")
    rooted = rooted.select(F.col("tree").alias("_t"), F.col("leaf").alias("_n")).distinct()
    return out.join(rooted, _same(["tree", "leaf"], ["_t", "_n"]), "left_semi")


def conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` paths of each tree: (tree, leaf, rank, score, n_turns, formatted, loss), ``loss`` being the spans of the formatted
    text under the loss mask, in code points, end exclusive."""
    first = F.row_number().over(Window.partitionBy("tree", "id").orderBy("parent", "role", "text"))
    own = stored(messages.select("tree", "id", "parent", "role", "text", "score").withColumn("_k", first).filter("_k = 1").drop("_k"), "messages")
    all_paths = stored(paths(own), "rooted-paths")
    said = own.select(F.col("tree").alias("_t"), F.col("id").alias("_n"), "role", "text", "score")
    on_path = _same(["tree", "node"], ["_t", "_n"])
    scored = all_paths.join(said.select("_t", "_n", "score"), on_path).groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    best = (scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).filter(F.col("rank") <= top)
            .withColumnsRenamed({"tree": "_tree", "leaf": "_leaf"}))
    rows = all_paths.join(best, _same(["tree", "leaf"], ["_tree", "_leaf"])).join(said.drop("score"), on_path)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, body = F.concat(F.lit(OPEN), escaped(role), F.lit(TEXT)), escaped(text)
    rows = rows.select("tree", "leaf", "rank", "score", "dist", head.alias("head"), body.alias("body"), (role == "assistant").alias("learn"))
    turn = F.concat("head", "body", F.lit(CLOSE))
    before = Window.partitionBy("tree", "leaf", "rank", "score").orderBy(F.desc("dist")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length(turn)).over(before), F.lit(0)) + F.char_length("head"))
    kept = F.when(F.col("learn"), F.struct(F.col("at").alias("start"), (F.col("at") + F.char_length("body")).alias("end")))
    per = rows.groupBy("tree", "leaf", "rank", "score").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("k"), turn.alias("turn")))).alias("turns"),
        F.sort_array(F.collect_list(kept)).alias("loss"))
    return per.select("tree", "leaf", "rank", "score", "n_turns", F.array_join("turns.turn", "").alias("formatted"), "loss")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    def turn(x: Column) -> Column:
        role = F.substring_index(x, TEXT, 1)
        start = F.char_length(role) + len(TEXT) + 1
        text = F.substr(x, start, F.char_length(x) - start + 1 - len(CLOSE))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))
    parts = F.split(formatted, r"<\|turn\|>", -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def learned(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, span after span."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
