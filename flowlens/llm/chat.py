"""Reply trees as chat transcripts: the best branch of each tree, its template, and the loss mask.

Only DataFrame operations. Ancestors are found by joining the tree with itself with doubled
steps, so a tree of depth d takes about log2(d) joins on (tree, node), a key that is unique.
A transcript is one row, so the turns of one chosen branch meet in one task; a branch must
fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import materialized

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Strings that chat templates use as control marks.
CONTROLS = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escaped(text: Column) -> Column:
    """A backslash doubles, and each control string gets one after its first character."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROLS:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chosen_paths(nodes: DataFrame, *, top: int = 1) -> DataFrame:
    """The ``top`` best root-to-leaf paths per tree: columns tree, path, node, position (from 0).

    ``nodes`` has tree, node, parent (null for a root), score. A path's score is the sum over
    its nodes (null counts 0); ties go to the longer path, then to the smaller leaf. A parent
    that is not in the tree makes its child a root. Nodes of a cycle are on no path. Node ids
    must be unique in their tree.
    """
    ids = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    parents = ids.select("tree", F.col("node").alias("parent"))
    step = _joined(ids.where("parent is not null"), parents, "parent").select("tree", "node", F.col("parent").alias("up"), "total")
    # jumps[k] leads from each node that is deep enough to the ancestor 2 ** k above it
    jumps = [materialized(step, "reply-jump")]
    largest = ids.groupBy("tree").count().agg(F.max("count")).head()[0] or 0
    while jumps[-1].limit(1).count() and 2 << (len(jumps) - 1) < largest:
        far = jumps[-1].toDF("tree", "up", "far", "far_total")
        step = _joined(jumps[-1], far, "up").select("tree", "node", F.col("far").alias("up"), (F.col("total") + F.col("far_total")).alias("total"))
        jumps.append(materialized(step, "reply-jump"))
    inner = jumps[0].select("tree", F.col("up").alias("node")).distinct().withColumn("inner", F.lit(True))
    leaves = _joined(ids, inner, "node", "left").where("inner is null")
    walk = leaves.select("tree", F.col("node").alias("path"), "node", F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("steps"))
    for level in range(len(jumps) - 1, -1, -1):
        walk = _joined(walk, jumps[level], "node", "left").select(
            "tree", "path", F.coalesce("up", "node").alias("node"), (F.col("sum") + F.coalesce("total", F.lit(0.0))).alias("sum"),
            (F.col("steps") + F.when(F.col("up").isNotNull(), 1 << level).otherwise(0)).alias("steps"),
        )
    roots = _joined(ids, jumps[0].select("tree", "node", "up"), "node", "left").where("up is null").select("tree", "node", "total")
    ended = _joined(walk, roots, "node").withColumn("total", F.col("sum") + F.col("total"))
    best = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("steps"), "path")
    chosen = ended.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    paths = chosen.select("tree", "path", F.col("path").alias("node"), F.col("steps").alias("position"))
    paths = materialized(paths, "reply-paths")
    for level in range(len(jumps) - 1, -1, -1):
        above = _joined(paths.where(F.col("position") >= 1 << level), jumps[level].drop("total"), "node")
        above = above.select("tree", "path", F.col("up").alias("node"), (F.col("position") - (1 << level)).alias("position"))
        paths = materialized(paths.unionByName(above), "reply-paths")
    return paths


def _joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on tree and ``key``; a null tree is a tree like any other, a null key joins nothing."""
    right = right.withColumnRenamed("tree", "_tree").withColumnRenamed(key, "_key")
    return left.join(right, F.col("tree").eqNullSafe(F.col("_tree")) & (left[key] == F.col("_key")), how).drop("_tree", "_key")


def linked(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of turns as reply trees of one branch each: every turn answers the one before.

    Ties of ``turn`` are ordered by role, then text; nulls come first. Null roles and texts
    are empty.
    """
    order = Window.partitionBy(conversation).orderBy(turn, role, text)
    place = F.row_number().over(order).cast("long")
    return turns.select(
        F.col(conversation).alias("tree"), place.alias("node"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(0.0).alias("score"),
    ).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def formatted(nodes: DataFrame, *, top: int = 1, learn: str = "assistant") -> DataFrame:
    """One transcript per chosen path: tree, path, n_turns, formatted, mask.

    ``nodes`` as in :func:`chosen_paths`, with role and text. ``mask`` lists the spans
    (first character from 0, length) of the escaped texts of the role to ``learn``.
    """
    kept = materialized(nodes.select("tree", "node", "parent", "score", "role", "text"), "reply-nodes")
    rows = _joined(chosen_paths(kept, top=top), kept.select("tree", "node", "role", "text"), "node")
    body = escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(TURN), escaped(F.coalesce("role", F.lit(""))), F.lit(TEXT))
    rows = rows.select("tree", "path", "position", "role", head.alias("head"), body.alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "path").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    rows = rows.withColumn("span", F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    turns = F.array_sort(F.collect_list(F.struct("position", "piece", "role", "span")))
    rows = rows.groupBy("tree", "path").agg(turns.alias("turns"))
    return rows.select(
        "tree", "path", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == learn), lambda t: t["span"]).alias("mask"),
    )


def read_turns(transcript: Column) -> Column:
    """The turns of a transcript, as (role, text) structs."""
    quoted = [rf"\Q{mark}\E" for mark in (END, TEXT)]
    pieces = F.split(transcript, quoted[0], -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        parts = F.split(F.substr(piece, F.lit(len(TURN) + 1)), quoted[1], 2)
        return F.struct(unescaped(parts[0]).alias("role"), unescaped(parts[1]).alias("text"))

    return F.transform(pieces, turn)


def read_masked(transcript: Column, mask: Column) -> Column:
    """The unescaped texts below the loss mask."""
    return F.transform(mask, lambda s: unescaped(F.substr(transcript, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
