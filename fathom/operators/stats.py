"""Statistics over run logs, closures and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators.order import numbered


def phase_stats(events: DataFrame, phase: str, value: str) -> DataFrame:
    rows = events.where(F.col(phase).isNotNull()).groupBy(phase).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    return rows.orderBy(F.desc("total"), phase)


def counter_sums(events: DataFrame, phase: str, counters: Column) -> DataFrame:
    """Sums of every numeric counter of a map, by phase and counter."""
    rows = events.select(phase, F.explode(counters).alias("counter", "value"))
    return rows.groupBy(phase, "counter").agg(F.sum("value").alias("total"))


def process_pivot(events: DataFrame, process: str, phase: str, value: str, phases: list[str], top: int = 25) -> DataFrame:
    """Phases as columns by process, the ``top`` processes by total."""
    wide = events.groupBy(process).pivot(phase, phases).agg(F.sum(value)).na.fill(0)
    total = sum((F.col(f"`{p}`") for p in phases), F.lit(0))
    return wide.withColumn("total", total).orderBy(F.desc("total"), process).limit(top)


def run_series(runs: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Median, least and most of each series without its first, cold run."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    rows = runs.withColumn("_n", nth).where("_n > 1")
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def variants(runs: DataFrame, group: list[str], value: str, agrees: Column) -> DataFrame:
    return runs.groupBy(*group).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.bool_and(agrees).alias("agree"))


def floor_percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Elements at index floor((n - 1) p) of the sorted values; not an interpolation.

    Values are counted first, so a group costs as many rows as it has different values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(group).orderBy(value))
    n = F.sum("c").over(Window.partitionBy(group))
    ranked = counts.withColumn("_to", upto).withColumn("_n", n)
    at = lambda p: F.min(F.when(F.col("_to") > F.floor((F.col("_n") - 1) * F.lit(p)), F.col(value)))
    return ranked.groupBy(group).agg(F.max("_n").alias("n"), *[at(p).alias(name) for name, p in shares.items()])


def character_histogram(texts: DataFrame, text: str, top: int | None = None) -> DataFrame:
    """Counts of characters outside ASCII."""
    only = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    rows = texts.select(F.explode(F.split(only, "")).alias("char")).where("char <> ''").groupBy("char").agg(F.count("*").alias("n"))
    return rows if top is None else rows.orderBy(F.desc("n"), "char").limit(top)


def systematic_sample(rows: DataFrame, order: list[str], step: int) -> DataFrame:
    """Every ``step``-th row in order, from the first."""
    return numbered(rows, [F.col(c) for c in order], "_n").where(F.col("_n") % step == 0).drop("_n")


def capped(rows: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """At most so many rows a group, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def span_tally(spans: Column, text: Column) -> Column:
    """(total, const, sort, other): numbers of spans by kind."""
    count = lambda keep: F.size(F.filter(spans, keep))
    return F.struct(
        F.size(spans).alias("total"),
        count(lambda s: s["kind"] == 1).alias("const"),
        count(lambda s: s["kind"] == 2).alias("sort"),
        count(lambda s: s["kind"] == 0).alias("other"),
        F.length(F.regexp_replace(text, r"\S", "")).alias("blank"),
    )


def token_census(tokens: DataFrame, full: DataFrame, short: DataFrame, token: str) -> DataFrame:
    """Tokens by what they name: a full name, a last component, or nothing known."""
    rows = tokens.select(token).join(full.select(token).distinct().withColumn("_f", F.lit(True)), token, "left")
    rows = rows.join(short.select(token).distinct().withColumn("_s", F.lit(True)), token, "left")
    kind = F.when(F.col("_f"), "full").when(F.col("_s"), "short").otherwise("unmatched")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct(token).alias("different"))


def miss_rates(refs: DataFrame, hit: Column, weight: Column) -> DataFrame:
    return refs.agg(F.sum(weight).alias("refs"), F.sum(F.when(~hit, weight).otherwise(0)).alias("misses"))


def shape_histogram(names: DataFrame, shape: Column, top: int = 12) -> DataFrame:
    return names.groupBy(shape.alias("shape")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape").limit(top)


def stratified(urls: DataFrame, root: str, url: str, most: int) -> DataFrame:
    """The first ``most`` distinct URLs of each root, with the number of all."""
    rows = urls.select(root, url).distinct()
    n = F.count("*").over(Window.partitionBy(root))
    nth = F.row_number().over(Window.partitionBy(root).orderBy(url))
    return rows.withColumn("urls", n).withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def tree_totals(modules: DataFrame, references: DataFrame) -> DataFrame:
    """One row over module files: modules, declarations, imports, members, equations, distinct referenced names and pairs.

    ``modules``: (module, imports, declarations); ``references``: (user, name).
    """
    own = modules.agg(
        F.count("*").alias("modules"),
        F.sum(F.size("imports")).alias("imports"),
        F.sum(F.size("declarations")).alias("declarations"),
        F.sum(F.aggregate("declarations", F.lit(0), lambda n, d: n + F.greatest(F.size(d["members"]), F.lit(0)))).alias("members"),
        F.sum(F.aggregate("declarations", F.lit(0), lambda n, d: n + F.greatest(F.size(d["equations"]), F.lit(0)))).alias("equations"),
    )
    edges = references.agg(F.countDistinct("name").alias("names"), F.countDistinct("user", "name").alias("pairs"))
    return own.crossJoin(edges)  # one row each


def tactics_by_module(tactics: DataFrame, module: str, order: str) -> DataFrame:
    """Tactics of one enumeration, by the module that defines them."""
    rest = [c for c in tactics.columns if c != module]
    return tactics.groupBy(module).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("tactics"))


def link_report(roots: DataFrame, known: DataFrame, module_root: Column) -> DataFrame:
    """(root, base, sample): every dependency with its base address and the least known module below it."""
    least = known.groupBy(module_root.alias("root")).agg(F.min("module").alias("sample"))
    return roots.select("root", "base").join(least, "root", "left")


def full_passes(reads: DataFrame, kind: str, modules: int) -> DataFrame:
    """Reads by kind, and how many passes over all modules they amount to."""
    return reads.groupBy(kind).agg(F.count("*").alias("reads")).withColumn("passes", F.col("reads") / F.lit(max(1, modules)))


def name_collisions(refs: DataFrame, binders: DataFrame) -> DataFrame:
    """(declaration, collisions, shadowed): last components that several references of a declaration share, and binders that hide one.

    ``refs``: (declaration, name), ``binders``: (declaration, binder).
    """
    short = F.substring_index("name", ".", -1)
    leaves = refs.groupBy("declaration", short.alias("short")).agg(F.count("*").alias("n"))
    clash = leaves.where("n > 1").groupBy("declaration").agg(F.count("*").alias("collisions"))
    hidden = binders.select("declaration", F.col("binder").alias("short")).distinct().join(leaves, ["declaration", "short"], "left_semi")
    hidden = hidden.groupBy("declaration").agg(F.count("*").alias("shadowed"))
    out = refs.select("declaration").distinct().join(clash, "declaration", "left").join(hidden, "declaration", "left")
    return out.na.fill(0, ["collisions", "shadowed"])


def tree_bytes(entries: DataFrame) -> DataFrame:
    """Files and bytes of an index's entries."""
    return entries.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
