"""Group-by-collect indexes: name map, used-by, imported-by, instances, dictionaries, slices and counts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.names import utf16_key
from fathom.operators.order import cut, dealt, numbered


def sorted_set(values: Column) -> Column:
    """Distinct values in the order of UTF-16 units, as an aggregate; nulls don't count."""
    pairs = F.array_sort(F.collect_set(F.struct(utf16_key(values).alias("k"), values.alias("v"))))
    return F.transform(F.filter(pairs, lambda p: p["v"].isNotNull()), lambda p: p["v"])


def name_map(facts: DataFrame, name: str, value: list[str], order: list[str]) -> DataFrame:
    """The last row of each name in ``order`` wins."""
    return facts.where(F.col(name).isNotNull()).groupBy(name).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("v")).select(name, *[F.col(f"v.{x}").alias(x) for x in value])


def own_over_dependency(own: DataFrame, dependency: DataFrame, name: str, module: str) -> DataFrame:
    """Name to module: a package's own declaration beats a dependency's."""
    other = dependency.select(name, F.col(module).alias("_other"))
    return own.select(name, module).join(other, name, "full").select(name, F.coalesce(module, "_other").alias(module))


def used_by(refs: DataFrame, declared: DataFrame, target: str, user: str) -> DataFrame:
    """Users of each declared target that has any; ``refs``: (target, user), ``declared``: (target)."""
    return refs.select(target, user).distinct().join(declared.select(target).distinct(), target, "left_semi").groupBy(target).agg(sorted_set(F.col(user).cast("string")).alias("users"))


def used_by_counts(refs: DataFrame, declared: DataFrame, target: str, user: str) -> DataFrame:
    users = dealt(refs.select(target, user), target, user).distinct().groupBy(target).agg(F.count(user).alias("n"))
    return users.join(declared.select(target).distinct(), target, "left_semi").agg(F.count("*").alias("targets"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))


def imported_by(nodes: DataFrame, edges: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """Importers of every node; nodes without any have an empty list."""
    found = edges.select(F.col(target).alias(node), F.col(source)).groupBy(node).agg(sorted_set(F.col(source).cast("string")).alias("importers"))
    return nodes.select(node).distinct().join(found, node, "left").select(node, F.coalesce("importers", F.array().cast("array<string>")).alias("importers"))


def instances(facts: DataFrame, by: str, name: str) -> DataFrame:
    return facts.where(F.col(by).isNotNull()).groupBy(by).agg(sorted_set(F.col(name)).alias("instances"))


def slices(entries: DataFrame, root: Column, name: str, module: str) -> DataFrame:
    """Name maps of each root, in byte order of names."""
    return entries.groupBy(root.alias("root")).agg(F.array_sort(F.collect_set(F.struct(name, module))).alias("entries"))


def dictionary(values: DataFrame, value: str, limit: int | None = None) -> DataFrame:
    """(value, id): ids from 0 in the order of UTF-16 units; ``limit`` refuses larger dictionaries."""
    distinct = values.select(value).where(F.col(value).isNotNull()).distinct()
    out = numbered(distinct, [utf16_key(F.col(value))])
    if limit is not None:
        out = out.withColumn("id", F.when(F.col("id") < limit, F.col("id")).otherwise(F.raise_error(F.lit(f"more than {limit} entries in the dictionary")).cast("long")))
    return out


def head_constant(spans: Column) -> Column:
    """Name of the leftmost constant span (start, stop, kind, name); ties keep the first."""
    constants = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["kind"].alias("kind"), s["name"].alias("name"))), lambda s: s["kind"] == 1)
    return F.array_min(constants)["name"]


def suppressed(declarations: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """Declarations that are no member of any declaration."""
    return declarations.join(members.select(name).distinct(), name, "left_anti")


def contained(intervals: DataFrame, group: str, name: str, start: str, stop: str) -> DataFrame:
    """(group, outer, inner): other intervals of the group that lie inside an interval, ends included; equal ones lie inside each other.

    A sweep: intervals are dealt into ranges by group and start, and each range is read in order of start, the longer first.  The open ones
    are kept in order of their stops, so those that hold the next are found by bisection, and those that ended before it are dropped.  An
    interval that reaches into later ranges of its group is sent there too.  Work is that of sorting and of the pairs found, however many
    intervals a group has.  Rows with a null group, start or stop lie in none.
    """
    spark = intervals.sparkSession
    rows = intervals.select(F.col(group).alias("g"), F.col(name).alias("name"), F.col(start).alias("a"), F.col(stop).alias("b")).where("g is not null and a is not null and b is not null")
    order = [F.col("g"), F.col("a"), F.desc("b")]
    rows = cut(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    heads = rows.groupBy("range").agg(F.min(F.struct("g", "a")).alias("h")).select(F.col("range").alias("later"), F.col("h.g").alias("hg"), F.col("h.a").alias("ha"))
    reaching = rows.join(F.broadcast(heads), (F.col("g") == F.col("hg")) & (F.col("later") > F.col("range")) & (F.col("ha") <= F.col("b")))  # heads: a row for each range
    dealt = rows.withColumn("own", F.lit(True)).unionByName(reaching.select("g", "name", "a", "b", F.col("later").alias("range"), F.lit(False).alias("own")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("range", "own", "g", "a", "b", "name").repartition(parts, "range").sortWithinPartitions("range", "own", *order)
    kind = {f.name: f.dataType.simpleString() for f in dealt.schema}
    return dealt.mapInArrow(_sweep, f"`{group}` {kind['g']}, outer {kind['name']}, inner {kind['name']}")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, own, g, a, b, name); those that reach into a range, all of its first group, come first and are only held."""
    at = None
    stops: list = []  # of the open intervals, ascending; beside them their starts and names
    opened: list[tuple] = []
    flat = lambda x: tuple(x.values()) if isinstance(x, dict) else x
    for batch in batches:
        found: list[tuple] = []
        for range_, own, g, a, b, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (range_, g) != at:
                at, stops, opened = (range_, g), [], []
            a, b = flat(a), flat(b)
            while stops and stops[0] < a:
                del stops[0], opened[0]
            if own:
                for i in range(bisect_left(stops, b), len(stops)):
                    start, other = opened[i]
                    if other != name:
                        found.append((g, other, name))
                        if start == a and stops[i] == b:
                            found.append((g, name, other))
            i = bisect_right(stops, b)
            stops.insert(i, b)
            opened.insert(i, (a, name))
        columns = zip(*found, strict=True) if found else ((), (), ())
        kinds = [batch.schema.field("g").type, *[batch.schema.field("name").type] * 2]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["g", "outer", "inner"])


def limited_equations(equations: Column, limit: int = 200) -> Column:
    """(kept, dropped): equations under ``limit`` code points, and whether any other was there."""
    return F.struct(F.filter(equations, lambda e: F.length(e) < limit).alias("kept"), F.exists(equations, lambda e: F.length(e) >= limit).alias("dropped"))


def page_order(items: DataFrame) -> list[Column]:
    return [F.col("line"), F.col("col"), F.col("seq")]


def first_owner(constants: DataFrame, name: str, order: str) -> DataFrame:
    """The first module in input order owns a name."""
    return constants.groupBy(name).agg(F.min_by(F.struct("*"), F.col(order)).alias("_row")).select("_row.*")


def used_by_rows(refs: DataFrame, declared: DataFrame, target: str, user: str) -> DataFrame:
    """``used_by`` as a table, a row for each target and user: for targets whose list of users would be too long for one row."""
    return refs.select(target, user).distinct().join(declared.select(target).distinct(), target, "left_semi")


def counts(declared: DataFrame, dependencies: DataFrame, facts: DataFrame, refs: DataFrame, name: str = "name") -> DataFrame:
    """One row: declarations, dependency_names, classes, types, targets and edges.

    ``declared`` and ``dependencies``: (name); ``facts``: (class, type), null where a declaration is no instance; ``refs``: (name, user).
    """
    own = declared.select(name).distinct()
    one = own.agg(F.count("*").alias("declarations"))
    one = one.crossJoin(dependencies.select(name).distinct().join(own, name, "left_anti").agg(F.count("*").alias("dependency_names")))  # one row each
    one = one.crossJoin(facts.agg(F.countDistinct("class").alias("classes"), F.countDistinct("type").alias("types")))
    return one.crossJoin(used_by_counts(refs, own, name, "user"))


def subscripts(rows: DataFrame, values: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the number that ``dictionary`` gives ``value``."""
    return rows.join(dictionary(values, value).withColumnRenamed("id", name), value, "left")
