"""Integrity gates: each gives the rows that break a rule, and says whether there was anything to check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.order import dealt


def both_ways(a: DataFrame, b: DataFrame, keys: list[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Keys of only one side, with the side."""
    x, y = dealt(a.select(*keys), *keys).distinct(), dealt(b.select(*keys), *keys).distinct()
    only_a = x.join(y, keys, "left_anti").withColumn("side", F.lit(names[0]))
    return only_a.unionByName(y.join(x, keys, "left_anti").withColumn("side", F.lit(names[1])))


def disagreeing(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    x, y = a.select(key, F.col(value).alias("_a")), b.select(key, F.col(value).alias("_b"))
    return x.join(y, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


def dead_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Internal links (page, target, fragment) without a page, or whose page lacks the fragment; ``pages``: (target, anchors)."""
    rows = links.join(pages.select("target", "anchors"), "target", "left")
    reason = F.when(F.col("anchors").isNull(), "no page").when(F.col("fragment").isNotNull() & (F.col("fragment") != "") & ~F.array_contains("anchors", F.col("fragment")), "no anchor")
    return rows.withColumn("reason", reason).where("reason is not null").select("page", "target", "fragment", "reason")


def site_closure(pages: DataFrame, parts: DataFrame, modules: DataFrame, index: DataFrame, labels: int, names: DataFrame, instances: DataFrame, instances_for: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Does a site close over itself?  (check, item) of all that breaks a rule, and (check, n): how much each check compared.

    ``pages``: (page); ``parts``: (page, kind, value) as ``ir.page_parts`` has them; ``modules``: (id, module, page); ``index``: (name, module_id, kind_id);
    ``names``: (name, module), dependencies too; ``instances`` and ``instances_for``: (key, name).  The checks:
      modules have pages            every module names a page that is there
      modules resolve, kinds resolve  a declaration's numbers are those of a module and of one of ``labels`` kinds
      index on pages                every declaration is an anchor on its module's page
      pages in index                every declaration anchor of a module's page is in the index
      index equals names            index and name map say the same of the package's own names
      instances, instances for      the names of both tables are declarations
      resources                     no page loads anything from another host
    """
    page, module = F.col("page"), F.col("module")
    own = index.join(modules.withColumnRenamed("id", "module_id"), "module_id", "left")
    anchors = parts.where("kind = 'anchor'").select("page", F.col("value").alias("name")).distinct()
    decls = parts.where("kind = 'decl'").join(modules.select("page").distinct(), "page", "left_semi").select("page", F.col("value").alias("name")).distinct()
    known = index.select("name").distinct()
    indexed, mapped = own.where("module is not null").select("name", "module"), names.join(modules.select("module"), "module", "left_semi").select("name", "module")
    side = lambda df, s: df.select("name", F.concat_ws(" ", "name", F.lit(s), "module").alias("item"), "module")
    apart = side(indexed, "in index of").join(mapped, ["name", "module"], "left_anti").unionByName(side(mapped, "in map of").join(indexed, ["name", "module"], "left_anti"))
    kind = F.col("kind_id").isNull() | (F.col("kind_id") < 0) | (F.col("kind_id") >= labels)
    away = parts.where("kind = 'resource'").where(F.col("value").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"))
    pairs = lambda df: df.join(known, "name", "left_anti").select(F.concat_ws(" ", "key", "name").alias("item"))
    found = {
        "modules have pages": (modules.join(pages.select("page"), "page", "left_anti").select(F.coalesce(page, module).alias("item")), modules),
        "modules resolve": (own.where("module is null").select(F.col("name").alias("item")), index),
        "kinds resolve": (index.where(kind).select(F.col("name").alias("item")), index),
        "index on pages": (own.where("module is not null").join(anchors, ["page", "name"], "left_anti").select(F.concat_ws(" ", "name", "page").alias("item")), index),
        "pages in index": (decls.join(known, "name", "left_anti").select(F.concat_ws(" ", "name", "page").alias("item")), decls),
        "index equals names": (apart.select("item"), mapped),
        "instances": (pairs(instances), instances),
        "instances for": (pairs(instances_for), instances_for),
        "resources": (away.select(F.concat_ws(" ", "page", "value").alias("item")), pages),
    }
    broken = compared = None
    for check, (rows, seen) in found.items():
        rows, n = rows.select(F.lit(check).alias("check"), "item"), seen.agg(F.lit(check).alias("check"), F.count("*").alias("n"))
        broken, compared = (rows, n) if broken is None else (broken.unionByName(rows), compared.unionByName(n))
    return broken, compared


def closed(broken: DataFrame, compared: DataFrame) -> None:
    """Raise if a rule of ``site_closure`` is broken, or if one of its checks compared nothing."""
    if idle := [r["check"] for r in compared.where("n = 0").collect()]:  # a row for each check
        raise AssertionError(f"nothing was compared: {', '.join(idle)}")
    gate(broken, compared)


def gate(broken: DataFrame, compared: DataFrame) -> None:
    """Raise if a rule is broken, or if nothing was compared: an empty comparison proves nothing."""
    if compared.isEmpty():
        raise AssertionError("nothing was compared")
    if rows := broken.limit(20).collect():
        raise AssertionError("broken: " + "; ".join(str(r.asDict()) for r in rows))


def work_bound(extracted: int, rendered: int, modules: int, map_reused: bool) -> list[str]:
    """What is wrong with the work of a build after one module changed: it must be noticed, and cost neither all pages nor a new link map."""
    wrong = []
    if extracted < 1:
        wrong.append("no module was extracted")
    if not 1 <= rendered < modules:
        wrong.append(f"{rendered} of {modules} pages were rendered")
    if not map_reused:
        wrong.append("the link map was written anew")
    return wrong
