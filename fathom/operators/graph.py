"""Graphs of modules: reversal, transitive closure, impact and census."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.order import cut, cut_at, numbered

#: Levels that a closure takes one by one before it follows nodes with a single successor by leaps.
PLAIN = 4
MODES = ("self", "referrers", "importers", "all")


def reverse(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    return edges.select(F.col(target).alias(source), F.col(source).alias(target))


def _step(front: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    return front.withColumnRenamed("node", "src").join(edges, "src").select(*keys[:-1], F.col("dst").alias("node")).distinct()


class Leaps:
    """Where 2 ** k steps lead from nodes that, all along, have one successor each; a table for each k, made when it is needed."""

    def __init__(self, edges: DataFrame):
        single = edges.groupBy("src").agg(F.min("dst").alias("dst"), F.count("*").alias("n")).where("n = 1")
        self.tables, self.rounds = [cut(single.select("src", "dst"))], 0

    def table(self, k: int) -> DataFrame:
        while len(self.tables) <= k:
            far = self.tables[-1]
            self.tables.append(cut(far.join(far.select(F.col("src").alias("dst"), F.col("dst").alias("_far")), "dst").select("src", F.col("_far").alias("dst"))))
        return self.tables[k]

    def along(self, front: DataFrame, keys: list[str]) -> DataFrame:
        """``front`` and all that its nodes reach over single successors, in rounds that double the steps."""
        n, k = front.count(), 0
        while True:
            more = cut(front.unionByName(_step(front, self.table(k), keys)).distinct())
            self.rounds, k, before, n = self.rounds + 1, k + 1, n, more.count()
            if n == before:
                return more
            front = more


def closure(seeds: DataFrame, edges: DataFrame, origin: bool = False, told: dict | None = None) -> DataFrame:
    """Nodes reached from ``seeds`` (node) over ``edges`` (src, dst) in one step or more: a seed only if reached again.

    With ``origin`` each seed has its own closure and the result is (origin, node).  Each round joins only the last round's new nodes, and
    only writes them.  After PLAIN levels, long runs of nodes with one successor are followed by doubling leaps, in rounds logarithmic in their
    length; so rounds are as many as levels with a branch.  ``told`` gets their number.
    """
    keys = ["origin", "node"] if origin else ["node"]
    edges = cut(edges.select("src", "dst").distinct())
    start = seeds.select(*([F.col("node").alias("origin")] if origin else []), "node").distinct()
    front, path = cut_at(_step(start, edges, keys))
    paths, rounds, leaps = [path], 1, None

    def seen() -> DataFrame:
        return front.sparkSession.read.schema(front.schema).parquet(*paths)

    while not front.isEmpty():
        rounds += 1
        if rounds > PLAIN:
            leaps = leaps or Leaps(edges)
            run, path = cut_at(leaps.along(front, keys).join(seen(), keys, "left_anti"))
            front = front.unionByName(run)
            paths.append(path)
        front, path = cut_at(_step(front, edges, keys).join(seen(), keys, "left_anti"))
        paths.append(path)
    if told is not None:
        told["rounds"] = rounds + (leaps.rounds if leaps else 0)
    return seen()


def reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, block, bits): for each node the set of nodes it reaches over ``edges`` (src, dst), itself included, as bitmaps.

    Nodes are numbered; a bitmap holds a block of 32,768 numbers, so a node has a row for each block it reaches into and no pair of nodes is ever a
    row.  Each round hands on only the bitmaps that the last one changed, until none does: rounds are as many as the longest of all shortest
    paths, cycles or not.
    """
    own = nodes.select("node").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    named = cut(numbered(own.unionByName(ends).where("node is not null").distinct(), [F.col("node")]).withColumn("id", F.col("id") + 1))
    end = lambda c: named.select(F.col("node").alias(c), F.col("id").alias(f"_{c}"))
    links = cut(edges.select("src", "dst").distinct().where("src <> dst").join(end("src"), "src").join(end("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))
    sets = cut(named.groupBy("id", F.expr("bitmap_bucket_number(id)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(id))").alias("bits")))
    changed = sets
    while not changed.isEmpty():
        sent = links.join(changed.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "block").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
        after = sets.withColumn("old", F.lit(True)).unionByName(sent.withColumn("old", F.lit(False))).groupBy("id", "block")
        after = cut(after.agg(F.expr("bitmap_or_agg(bits)").alias("bits"), F.max(F.when(F.col("old"), F.col("bits"))).alias("was")))
        sets, changed = after.drop("was"), after.where(F.col("was").isNull() | (F.col("was") != F.col("bits"))).drop("was")
    return sets.join(named.join(own, "node", "left_semi"), "id").select("node", "block", "bits")


def reached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, n): how many nodes each reaches, itself included."""
    return reach(nodes, edges).groupBy("node").agg(F.sum(F.expr("bitmap_count(bits)")).alias("n"))


def impact(changed: DataFrame, imports: DataFrame, refs: DataFrame, nodes: DataFrame, mode: str) -> DataFrame:
    """Nodes (node) whose pages a change can alter: themselves, direct referrers, transitive importers, or all.

    ``imports`` and ``refs``: (src, dst), src imports or refers to dst.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    own = changed.select("node").distinct()
    if mode == "self":
        return own
    if mode == "all":
        return nodes.select("node").distinct()
    if mode == "referrers":
        near = refs.where("src <> dst").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
    else:
        near = closure(own, reverse(imports))
    return own.unionByName(near).distinct().join(nodes.select("node").distinct(), "node", "left_semi")


def census(nodes: DataFrame, imports: DataFrame, refs: DataFrame, declarations: DataFrame) -> DataFrame:
    """For each node: declarations, imports, imported_by, importers (transitive, without itself) and referrers.

    ``declarations``: (node, declarations).
    """
    own = nodes.select("node").distinct()
    inside = imports.select("src", "dst").distinct().join(own.withColumnRenamed("node", "dst"), "dst", "left_semi").join(own.withColumnRenamed("node", "src"), "src", "left_semi")
    near = refs.select("src", "dst").distinct().where("src <> dst").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")
    count = lambda df, key, name: df.groupBy(F.col(key).alias("node")).agg(F.count("*").alias(name))
    far = reached(own, reverse(inside)).select("node", (F.col("n") - 1).alias("importers"))
    out = own.join(declarations, "node", "left")
    for part in (count(inside, "src", "imports"), count(inside, "dst", "imported_by"), far, count(near, "dst", "referrers")):
        out = out.join(part, "node", "left")
    return out.na.fill(0, ["declarations", "imports", "imported_by", "importers", "referrers"])


def summary(selection: DataFrame, entries: DataFrame) -> DataFrame:
    """Modules, declarations and bytes of a selection (node) over ``entries`` (node, declarations, bytes)."""
    return entries.join(selection.distinct(), "node", "left_semi").agg(F.count("*").alias("modules"), F.coalesce(F.sum("declarations"), F.lit(0)).alias("declarations"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def closure_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, size): nodes reached, the node itself included once."""
    return reached(nodes, edges).withColumnRenamed("n", "size")


def missing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Targets of edges that aren't nodes."""
    return edges.select(F.col("dst").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti")


def transitive(direct: DataFrame, edges: DataFrame, origin: str = "direct", far: str = "transitive") -> DataFrame:
    """(node, kind): nodes that have a fact themselves (``direct``: node), and those that only reach one over ``edges`` (src, dst)."""
    own = direct.select("node").distinct()
    reached = closure(own, reverse(edges)).join(own, "node", "left_anti")
    return own.select("node", F.lit(origin).alias("kind")).unionByName(reached.select("node", F.lit(far).alias("kind")))
