"""A build kept up to date over stored tables: suppliers are modules, parts the names they declare, line items references, customers mentions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import checks, incremental, snapshot
from fathom.operators.order import cut, scratch
from fathom.plans.catalog import query, table
from fathom.sources import ir, sinks
from fathom.sources.versions import Store

#: States of the world in the order of the builds, and the world of each: as it is, with moved names, without some modules, with a new one.
STATES = {"base": 0, "rerun": 0, "modified": 1, "removed": 2, "added": 3, "restored": 0, "stale state": 0}


def _declared(d: str, spark: SparkSession, n: int, world: int) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("p"))
    own = F.col("p") % n if world == 0 else F.when(F.col("p") % 40 == 7, (F.col("p") + 3) % n).otherwise(F.col("p") % n)
    rows = part.select("p", own.alias("m"))
    if world >= 2:
        rows = rows.where("m % 10 <> 9" + (" or p % 40 = 9" if world == 3 else ""))
    if world == 3:
        rows = rows.withColumn("m", F.when(F.col("p") % 40 == 9, n).otherwise(F.col("m")))
    return rows.select(F.concat(F.lit("M"), "m").alias("module"), F.col("p").cast("string").alias("name"))


def _named(key: str, n: int) -> Column:
    return F.concat(F.lit("M"), F.col(key) % n).alias("module")


def _digests(rows: DataFrame, path: str) -> DataFrame:
    """A digest of the file that holds a module's rows (module, name) of one kind."""
    return rows.groupBy("module").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("name")), "\n"), 256).alias("digest")).withColumn("path", F.lit(path))


def _sources(spark: SparkSession, d: str, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is alike in all worlds: the users of each name, kept; the tokens, read where they are extracted; the digests of the modules' files of both, kept."""
    lines = table(spark, d, "lineitem").where("l_partkey is not null").select(F.col("l_partkey").alias("p"), (F.col("l_suppkey") % n).alias("m")).repartition("p")  # few repeat on one side of a shuffle
    users = cut(lines.groupBy("p").agg(F.collect_set("m").alias("users")).select(F.col("p").cast("string").alias("name"), "users"))
    tokens = table(spark, d, "customer").select(_named("c_custkey", n), F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("name"))
    uses = users.select(F.explode("users").alias("m"), "name").select(_named("m", n), "name")
    return users, tokens, cut(_digests(uses, "references").unionByName(_digests(tokens, "tokens")))


def _world(spark: SparkSession, d: str, n: int, world: int, source: str, sources: tuple[DataFrame, DataFrame, DataFrame]) -> incremental.World:
    mods = spark.range(n + (world == 3)).where("id % 10 <> 9" if world == 2 else f"id % 10 <> 9 or id = {n}" if world == 3 else "true")
    mods = mods.select(F.concat(F.lit("M"), "id").alias("module"))
    declared, (users, tokens, digests) = _declared(d, spark, n, world), sources
    owned = users.join(declared.select(F.col("module").alias("owner"), "name"), "name", "left")  # before the rows of each use are made
    rows = {
        "declarations": declared,
        "references": owned.select(F.explode("users").alias("m"), F.coalesce("owner", F.lit("-")).alias("owner"), "name").select(_named("m", n), "owner", "name"),
        "imports": mods.select("module", F.lit("M0").alias("target")),
        "tokens": tokens,
    }
    hashes = snapshot.fingerprints(digests.unionByName(_digests(declared, "declarations")), "module", "path", "digest", "path")
    listed = cut(mods.join(hashes, "module", "left").select("module", F.coalesce("hash", F.lit("none")).alias("hash")))
    return incremental.World(listed, lambda chosen: {k: x.join(chosen, "module", "left_semi") for k, x in rows.items()}, _pages, {"schema": "1"}, {"source": source})


def _pages(chosen: DataFrame, tables: dict[str, DataFrame], owners: DataFrame) -> DataFrame:
    mine = lambda name: tables[name].join(chosen, "module", "left_semi")
    lines = mine("declarations").select("module", F.concat(F.lit("d "), "name").alias("line"))
    lines = lines.unionByName(mine("references").select("module", F.concat(F.lit("r "), "owner", F.lit(" "), "name").alias("line")))
    lines = lines.unionByName(mine("tokens").join(owners, "name", "left").select("module", F.concat_ws(" ", F.lit("t"), "name", F.coalesce("owner", F.lit("-"))).alias("line")))
    page = lines.groupBy("module").agg(F.md5(F.array_join(F.sort_array(F.collect_list("line")), "|")).alias("page"))
    return chosen.join(page, "module", "left").select("module", F.coalesce("page", F.md5(F.lit(""))).alias("page"))


@query("""WITH s AS (SELECT count(*) AS n FROM supplier), w AS (SELECT unnest([0, 1, 2, 3]) AS w),
m AS (SELECT w, k AS m FROM w, s, range(1000001) r(k) WHERE k < n + CAST(w = 3 AS INT) AND (w < 2 OR k % 10 <> 9 OR (w = 3 AND k = n))),
d AS (SELECT * FROM (SELECT w, p_partkey AS p, CASE WHEN w = 3 AND p_partkey % 40 = 9 THEN n WHEN w > 0 AND p_partkey % 40 = 7 THEN (p_partkey + 3) % n ELSE p_partkey % n END AS m FROM part, w, s) JOIN m USING (w, m)),
r AS (SELECT DISTINCT l_suppkey % n AS m, l_partkey AS p FROM lineitem, s),
lines AS (SELECT w, m, 'd ' || p AS line FROM d UNION ALL SELECT w.w, r.m, 'r ' || coalesce('M' || d.m, '-') || ' ' || r.p FROM r CROSS JOIN w LEFT JOIN d ON d.p = r.p AND d.w = w.w
  UNION ALL SELECT w.w, c_custkey % n, 't ' || c_custkey || ' ' || coalesce('M' || d.m, '-') FROM customer CROSS JOIN s CROSS JOIN w LEFT JOIN d ON d.p = c_custkey AND d.w = w.w),
pages AS (SELECT w, 'M' || m AS module, md5(coalesce(string_agg(line, '|' ORDER BY line), '')) AS page FROM m LEFT JOIN lines USING (w, m) GROUP BY w, m)
SELECT state, module, page FROM pages JOIN (VALUES ('base', 0), ('rerun', 0), ('modified', 1), ('removed', 2), ('added', 3), ('restored', 0), ('stale state', 0)) v(state, w) USING (w)""")
def incremental_states(spark, d):
    """The pages after each of seven builds, each from the last; the SQL builds every state anew."""
    n, out = table(spark, d, "supplier").count(), None
    store, sources = Store(spark, f"{scratch(spark)}-{uuid.uuid4().hex[:8]}", buckets=16), _sources(spark, d, n)
    for state, world in STATES.items():
        incremental.run(store, _world(spark, d, n, world, "new" if state == "stale state" else "old", sources))
        pages = store.table("pages", incremental.PAGES, store.manifest()).select(F.lit(state).alias("state"), "module", "page")
        out = pages if out is None else out.unionByName(pages)
    return out


@query("""WITH m AS (SELECT DISTINCT p_size AS id FROM part), c AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT 'modules have pages' AS "check", 'm' || id || '.html' AS item FROM m WHERE id % 17 = 5
UNION ALL SELECT 'modules resolve', 'D' || k FROM c WHERE k % 101 = 3 AND k % 83 <> 6 UNION ALL SELECT 'kinds resolve', 'D' || k FROM c WHERE k % 97 = 4 AND k % 83 <> 6
UNION ALL SELECT 'index on pages', 'D' || k || ' m' || s || '.html' FROM c WHERE k % 101 <> 3 AND k % 83 <> 6 AND (k % 89 = 5 OR s % 17 = 5)
UNION ALL SELECT 'pages in index', 'D' || k || ' m' || s || '.html' FROM c WHERE k % 83 = 6 AND k % 89 <> 5 AND s % 17 <> 5
UNION ALL SELECT 'index equals names', 'D' || k || ' in index of M' || s FROM c WHERE k % 101 <> 3 AND k % 83 <> 6 AND k % 79 = 7
UNION ALL SELECT 'index equals names', 'D' || k || ' in map of M' || s FROM c WHERE k % 79 <> 7 AND (k % 101 = 3 OR k % 83 = 6)
UNION ALL SELECT 'instances', 'C' || k % 7 || ' D' || k FROM c WHERE k % 83 = 6 AND k % 2 = 0 UNION ALL SELECT 'instances for', 'T' || k % 5 || ' D' || k FROM c WHERE k % 83 = 6 AND k % 2 = 1
UNION ALL SELECT 'resources', 'm' || id || '.html https://cdn.example/x' || id || '.js' FROM m WHERE id % 13 = 2 AND id % 17 <> 5""")
def site_closure(spark, d):
    """A written site with planted breaks of each rule: pages by part size, declarations by part."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    name = F.concat(F.lit("D"), "k")
    section = F.when(F.col("k") % 89 != 5, F.concat(F.when(F.col("k") % 3 == 0, F.lit("<section class='decl' id=")).otherwise(F.lit('<section\n class="x decl" id="')), name, F.when(F.col("k") % 3 == 0, F.lit(">")).otherwise(F.lit('">')), F.lit("</section>")))
    body = part.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(section)), "").alias("body"))
    script = F.when(F.col("s") % 13 == 2, F.concat(F.lit("<script src='https://cdn.example/x"), "s", F.lit(".js'>'<section class=decl id=no>'</script>"))).otherwise(F.lit("<script src=own.js></script><!-- <img src='//no'> -->"))
    site = scratch(spark)
    sinks.write_files(body.where("s % 17 <> 5").select(F.concat(F.lit("m"), "s", F.lit(".html")).alias("path"), F.concat(F.lit("<html>"), script, "body", F.lit("</html>")).alias("body")), site)
    html = ir.html_files(spark, site)
    modules = body.select(F.col("s").cast("long").alias("id"), F.concat(F.lit("M"), "s").alias("module"), F.concat(F.lit("m"), "s", F.lit(".html")).alias("page"))
    index = part.where("k % 83 <> 6").select(name.alias("name"), F.when(F.col("k") % 101 == 3, -1).otherwise(F.col("s")).cast("long").alias("module_id"), F.when(F.col("k") % 97 == 4, 9).otherwise(F.col("k") % 9).alias("kind_id"))
    names = part.where("k % 79 <> 7").select(name.alias("name"), F.concat(F.lit("M"), "s").alias("module")).unionAll(part.where("k % 79 = 7").select(name, F.lit("Dependency")))
    pairs = lambda odd, letter, n: part.where(f"k % 2 = {odd}").select(F.concat(F.lit(letter), F.col("k") % n).alias("key"), name.alias("name"))
    return checks.site_closure(html, ir.page_parts(html), modules, index, 9, names, pairs(0, "C", 7), pairs(1, "T", 5))[0]
