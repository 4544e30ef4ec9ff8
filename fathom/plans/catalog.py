"""Queries over the driver's tables, with the DuckDB SQL that must give the same rows.

The tables hold no documented code, so each query runs an operator with other columns in the roles of modules,
declarations and references: a part is a declaration, a line item refers to it, an order uses it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import names as N
from fathom.operators import checks, graph, index, links, search, snapshot, stats
from fathom.operators.order import numbered
from fathom.sources import ir
from fathom.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: str):
    return F.col(c).cast("long")


@query("""SELECT l_partkey AS part, string_agg(u, ',' ORDER BY u) AS users, count(*) AS n_users
FROM (SELECT DISTINCT l_partkey, CAST(l_orderkey AS VARCHAR) AS u FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)) GROUP BY 1""")
def used_by(spark, d):
    refs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("user"))
    out = index.used_by(refs, table(spark, d, "part").select(F.col("p_partkey").alias("part")), "part", "user")
    return out.select("part", F.array_join("users", ",").alias("users"), F.size("users").cast("long").alias("n_users"))


@query("SELECT count(DISTINCT l_partkey) AS targets, count(*) AS edges FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey)")
def used_by_edges(spark, d):
    refs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("user"))
    return index.used_by_counts(refs, table(spark, d, "part").select(F.col("p_partkey").alias("part")), "part", "user")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id IS NOT NULL) WHERE r = 1""")
def name_map_last_wins(spark, d):
    return index.name_map(table(spark, d, "events"), "user_id", ["event_type", "event_id"], ["ts", "event_id"])


@query("""SELECT coalesce(a.k, b.k) AS name, coalesce(a.m, b.m) AS module FROM (SELECT c_nationkey AS k, min(c_name) AS m FROM customer GROUP BY 1) a
FULL JOIN (SELECT n_nationkey AS k, n_name AS m FROM nation) b ON a.k = b.k""")
def own_over_dependency(spark, d):
    own = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("name")).agg(F.min("c_name").alias("module"))
    other = table(spark, d, "nation").select(F.col("n_nationkey").alias("name"), F.col("n_name").alias("module"))
    return index.own_over_dependency(own, other, "name", "module")


@query("SELECT p_type AS type, string_agg(p_brand, ',' ORDER BY p_brand) AS instances FROM (SELECT DISTINCT p_type, p_brand FROM part) GROUP BY 1")
def instances_by_type(spark, d):
    out = index.instances(table(spark, d, "part").withColumnRenamed("p_type", "type"), "type", "p_brand")
    return out.select("type", F.array_join("instances", ",").alias("instances"))


@query("""SELECT c_custkey AS node, coalesce(i, '') AS importers FROM customer LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS i FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def imported_by_with_empty(spark, d):
    out = index.imported_by(table(spark, d, "customer").select(F.col("c_custkey").alias("node")), table(spark, d, "orders"), "node", "o_orderkey", "o_custkey")
    return out.select("node", F.array_join("importers", ",").alias("importers"))


@query("""SELECT root, string_agg(p_name || '>' || p_brand, ',' ORDER BY p_name, p_brand) AS entries FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS root, p_name, p_brand FROM part) GROUP BY 1""")
def dependency_slices(spark, d):
    out = index.slices(table(spark, d, "part"), F.split_part("p_name", F.lit(" "), F.lit(1)), "p_name", "p_brand")
    return out.select("root", F.array_join(F.transform("entries", lambda e: F.concat_ws(">", e["p_name"], e["p_brand"])), ",").alias("entries"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def suppressed_members(spark, d):
    return index.suppressed(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS id FROM (SELECT DISTINCT p_type FROM part)")
def kind_dictionary(spark, d):
    out = index.dictionary(table(spark, d, "part"), "p_type", 255)
    return out.select("p_type", F.col("id").cast("long").alias("id"))


@query("""SELECT a.l_orderkey AS g, a.l_linenumber AS "outer", b.l_linenumber AS "inner" FROM lineitem a JOIN lineitem b USING (l_orderkey)
WHERE a.l_linenumber <> b.l_linenumber AND a.l_quantity <= b.l_quantity AND b.l_quantity + b.l_linenumber <= a.l_quantity + a.l_linenumber""")
def containment_pairs(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_quantity") + F.col("l_linenumber")).alias("b"))
    return index.contained(rows, "g", "l_linenumber", "a", "b")


@query("""SELECT event_type, count(value) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, max(value) AS most FROM events GROUP BY 1""")
def phase_stats(spark, d):
    out = stats.phase_stats(table(spark, d, "events"), "event_type", "value")
    return out.select("event_type", "n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "most")


@query("""SELECT event_type, j.key AS counter, CAST(sum(CAST(j.value AS BIGINT)) AS BIGINT) AS total FROM events, json_each(props) AS j GROUP BY 1, 2""")
def phase_counters(spark, d):
    return stats.counter_sums(table(spark, d, "events"), "event_type", F.from_json("props", "map<string,bigint>"))


_PHASES = ("click", "view", "purchase", "signup")


@query(
    "SELECT user_id, "
    + ", ".join(f"count(*) FILTER (event_type = '{p}') AS {p}" for p in _PHASES)
    + f""", count(*) FILTER (event_type IN {_PHASES}) AS total FROM events GROUP BY 1 ORDER BY total DESC, user_id LIMIT 25"""
)
def process_pivot_top(spark, d):
    rows = table(spark, d, "events").withColumn("one", F.lit(1).cast("long"))
    return stats.process_pivot(rows, "user_id", "event_type", "one", list(_PHASES))


@query("""SELECT user_id, count(*) AS n, round(median(value), 6) AS median, min(value) AS least, max(value) AS most
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r > 1 GROUP BY 1""")
def run_series_median(spark, d):
    return stats.run_series(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").withColumn("median", F.round("median", 6))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, median(l_quantity) AS median, min(l_quantity) AS least, max(l_quantity) AS most, bool_and(l_discount < 0.1) AS agree FROM lineitem GROUP BY 1, 2""")
def variant_groups(spark, d):
    return stats.variants(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", F.col("l_discount") < 0.1)


@query("""SELECT l_returnflag, count(*) AS n, list_sort(list(l_quantity))[1 + CAST(floor((count(*) - 1) * 0.5) AS BIGINT)] AS p50, list_sort(list(l_quantity))[1 + CAST(floor((count(*) - 1) * 0.9) AS BIGINT)] AS p90, max(l_quantity) AS most FROM lineitem GROUP BY 1""")
def floor_percentiles(spark, d):
    return stats.floor_percentiles(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", {"p50": 0.5, "p90": 0.9, "most": 1.0})


@query("""SELECT c AS char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE unicode(c) > 127 GROUP BY 1""")
def char_histogram(spark, d):
    return stats.character_histogram(table(spark, d, "documents"), "text")


@query("SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE (r - 1) % 37 = 0")
def systematic_sample(spark, d):
    return stats.systematic_sample(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 37)


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 20")
def capped_per_group(spark, d):
    return stats.capped(table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"], 20)


@query("""SELECT host, url, urls FROM (SELECT *, count(*) OVER (PARTITION BY host) AS urls, row_number() OVER (PARTITION BY host ORDER BY url) AS r
FROM (SELECT DISTINCT split_part(split_part(url, '://', 2), '/', 1) AS host, url FROM pages)) WHERE r <= 5""")
def stratified_sample(spark, d):
    rows = table(spark, d, "pages").select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), "url")
    return stats.stratified(rows, "host", "url", 5)


@query("""SELECT CASE WHEN b THEN 'full' WHEN s THEN 'short' ELSE 'unmatched' END AS kind, count(*) AS n, count(DISTINCT t) AS different FROM (
SELECT t, t IN (SELECT p_type FROM part) AS b, t IN (SELECT split_part(p_type, ' ', 1) FROM part) AS s FROM (SELECT p_type AS t FROM part UNION ALL SELECT split_part(p_name, ' ', 1) FROM part UNION ALL SELECT split_part(p_type, ' ', 1) FROM part)) GROUP BY 1""")
def token_census(spark, d):
    part = table(spark, d, "part")
    head = lambda c: part.select(F.split_part(c, F.lit(" "), F.lit(1)).alias("t"))
    tokens = part.select(F.col("p_type").alias("t")).unionAll(head("p_name")).unionAll(head("p_type"))
    return stats.token_census(tokens, part.select(F.col("p_type").alias("t")), head("p_type"), "t")


@query("""SELECT CASE WHEN c_name LIKE '%0' THEN 'round' WHEN c_mktsegment LIKE 'A%' THEN 'segment' ELSE 'other' END AS shape, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, shape LIMIT 12""")
def shape_histogram(spark, d):
    shape = F.when(F.col("c_name").endswith("0"), "round").when(F.col("c_mktsegment").startswith("A"), "segment").otherwise("other")
    return stats.shape_histogram(table(spark, d, "customer"), shape)


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS refs, CAST(sum(CASE WHEN l_quantity >= 25 THEN l_linenumber ELSE 0 END) AS BIGINT) AS misses FROM lineitem")
def miss_rates(spark, d):
    return stats.miss_rates(table(spark, d, "lineitem"), F.col("l_quantity") < 25, F.col("l_linenumber"))


@query("""SELECT o_custkey AS module, sha256(string_agg(o_orderkey || ' ' || o_orderstatus, chr(10) ORDER BY o_orderdate, o_orderkey)) AS hash, count(*) AS files FROM orders GROUP BY 1""")
def fingerprint(spark, d):
    rows = table(spark, d, "orders").withColumn("o_orderkey", long("o_orderkey"))
    return snapshot.fingerprints(rows.withColumnRenamed("o_custkey", "module"), "module", "o_orderkey", "o_orderstatus", "o_orderdate")


_CUT = "TIMESTAMP '1998-01-01'"


def _orders_before(spark, d):
    return table(spark, d, "orders").where("o_orderdate < timestamp_ntz'1998-01-01'").groupBy(F.col("o_custkey").alias("module")).agg(F.max("o_orderkey").alias("hash"))


def _orders_now(spark, d):
    recent = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1997-06-01'").groupBy(F.col("o_custkey").alias("module")).agg(F.max("o_orderkey").alias("hash"))
    listed = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("module"))
    return listed.join(recent, "module", "left")


_BEFORE = f"(SELECT o_custkey AS module, max(o_orderkey) AS hash FROM orders WHERE o_orderdate < {_CUT} GROUP BY 1)"
_NOW = "(SELECT c_custkey AS module, hash FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS hash FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' GROUP BY 1) ON c_custkey = o_custkey WHERE c_custkey % 5 <> 0)"
_DETECT = f"""SELECT coalesce(a.module, b.module) AS module, CASE WHEN b.hash IS NULL THEN 'removed' WHEN a.module IS NULL THEN 'added' WHEN a.hash = b.hash THEN 'same' ELSE 'changed' END AS state
FROM {_BEFORE} a FULL JOIN {_NOW} b ON a.module = b.module"""


@query(_DETECT)
def snapshot_detect(spark, d):
    return snapshot.detect(_orders_before(spark, d), _orders_now(spark, d), "module", "hash")


@query(f"SELECT module FROM ({_DETECT}) WHERE state IN ('changed', 'added')")
def snapshot_stale(spark, d):
    return snapshot.stale(snapshot_detect(spark, d), "module", F.lit(False))


_YEARS = "(SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS v FROM nation WHERE n_nationkey {0})"


@query(f"SELECT coalesce(a.k, b.k) AS k FROM {_YEARS.format('< 20')} a FULL JOIN (SELECT k, CASE WHEN k % 4 = 0 THEN v || '!' ELSE v END AS v FROM {_YEARS.format('> 3')}) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v")
def key_diff(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("v"))
    after = rows.where("k > 3").withColumn("v", F.when(F.col("k") % 4 == 0, F.concat("v", F.lit("!"))).otherwise(F.col("v")))
    return snapshot.key_diff(rows.where("k < 20"), after, "k", "v")


_SUPPLY = "(SELECT DISTINCT l_suppkey AS module, l_partkey AS name FROM lineitem WHERE {0})"


@query(f"""WITH base AS {_SUPPLY.format("l_linenumber <= 2")}, fresh AS {_SUPPLY.format("l_linenumber BETWEEN 2 AND 4")},
lost AS (SELECT * FROM base EXCEPT SELECT * FROM fresh), gained AS (SELECT * FROM fresh EXCEPT SELECT * FROM base),
refs AS (SELECT DISTINCT l_orderkey AS "user", l_suppkey AS module, l_partkey AS name FROM lineitem WHERE l_orderkey % 3 <> 0)
SELECT DISTINCT "user", CASE WHEN EXISTS (SELECT 1 FROM lost l WHERE l.module = refs.module AND l.name = refs.name) THEN 'lost owner' ELSE 'moved elsewhere' END AS reason
FROM refs WHERE EXISTS (SELECT 1 FROM lost l WHERE l.module = refs.module AND l.name = refs.name)
OR (EXISTS (SELECT 1 FROM gained g WHERE g.name = refs.name) AND NOT EXISTS (SELECT 1 FROM gained g WHERE g.name = refs.name AND g.module = refs.module))""")
def ownership_stale(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("module"), F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("user"), "l_linenumber")
    exclude = items.where("user % 3 = 0").select("user")
    return snapshot.ownership(items.where("l_linenumber <= 2"), items.where("l_linenumber between 2 and 4"), items, exclude)


@query("""SELECT o_orderkey, o_orderstatus, 'base' AS side FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, o_orderstatus, 'fresh' FROM orders WHERE o_orderkey % 4 = 0""")
def merge_upsert(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    base = rows.where("o_orderkey % 5 <> 0").withColumn("side", F.lit("base"))
    fresh = rows.where("o_orderkey % 4 = 0").withColumn("side", F.lit("fresh"))
    return snapshot.merge(base, fresh, rows.where("o_orderkey % 3 = 0"), "o_orderkey")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 101 = 0 THEN 'only in a' WHEN o_orderkey % 103 = 0 THEN 'only in b' ELSE 'differs' END AS difference FROM orders
WHERE (o_orderkey % 101 = 0 AND o_orderkey % 103 <> 0) OR (o_orderkey % 103 = 0 AND o_orderkey % 101 <> 0) OR (o_orderkey % 97 = 0 AND o_orderkey % 101 <> 0 AND o_orderkey % 103 <> 0)""")
def verify_trees(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_totalprice")
    other = rows.where("k % 101 <> 0").withColumn("o_totalprice", F.when(F.col("k") % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return snapshot.verify(rows.where("k % 103 <> 0"), other, "k", ["o_orderstatus", "o_totalprice"])


@query("""SELECT l_orderkey AS module, (list(l_partkey ORDER BY l_linenumber, l_partkey))[1] AS witness FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY 1""")
def delta_affected(spark, d):
    tokens = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("module"), F.col("l_partkey").alias("name"), "l_linenumber")
    return snapshot.delta(table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("name")), tokens, "name", "module", "l_linenumber")


@query("SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-02-15')")
def prune_orphans(spark, d):
    live = table(spark, d, "lineitem").where("l_shipdate < timestamp_ntz'1995-02-15'").select(F.col("l_partkey").alias("k"))
    return snapshot.orphans(table(spark, d, "part").select(F.col("p_partkey").alias("k")), live, "k")


@query("SELECT o_orderkey AS k, o_custkey AS module, c_acctbal AS facts FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = o_custkey")
def facts_cache(spark, d):
    cache = table(spark, d, "customer").select(F.col("c_custkey").alias("module"), F.col("c_acctbal").alias("facts"), "c_mktsegment")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("module"))
    return snapshot.cached_facts(rows, cache, ["module"], "facts", "c_mktsegment", "BUILDING").select("k", "module", "facts")


def _turns(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    node = lambda turn: F.concat_ws("/", F.col("conv_id"), turn)
    edges = rows.where("turn > 0").select(node(F.col("turn")).alias("src"), node(F.col("turn") - 1).alias("dst"))
    return rows.select(node(F.col("turn")).alias("node"), "turn"), edges


@query("""WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations), r AS (
SELECT conv_id, turn - 1 AS turn FROM t WHERE turn % 4 = 3 UNION SELECT t.conv_id, t.turn - 1 FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn WHERE t.turn > 0)
SELECT conv_id || '/' || turn AS node FROM r""")
def closure_dag(spark, d):
    nodes, edges = _turns(spark, d)
    return graph.closure(nodes.where("turn % 4 = 3"), edges)


_RING = "(SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey * 7) % 25 FROM nation WHERE n_nationkey % 4 = 1)"


def _ring(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"))
    return rows.select("src", ((F.col("src") * 2 + 1) % 25).alias("dst")).unionAll(rows.where("src % 4 = 1").select("src", (F.col("src") * 7 % 25).alias("dst")))


_REACH = f"WITH RECURSIVE e AS {_RING}, r AS (SELECT src AS origin, dst AS node FROM e UNION SELECT origin, dst FROM r JOIN e ON src = node)"


@query(f"{_REACH} SELECT DISTINCT node FROM r WHERE origin IN (2, 5)")
def closure_cyclic(spark, d):
    seeds = table(spark, d, "nation").where("n_nationkey in (2, 5)").select(F.col("n_nationkey").alias("node"))
    return graph.closure(seeds, _ring(spark, d))


@query(f"{_REACH} SELECT n_nationkey AS node, 1 + (SELECT count(*) FROM r WHERE origin = n_nationkey AND node <> origin) AS size FROM nation")
def closure_sizes(spark, d):
    return graph.closure_sizes(table(spark, d, "nation").select(F.col("n_nationkey").alias("node")), _ring(spark, d))


@query(f"""{_REACH}, i AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY 1), o AS (SELECT src AS node, count(*) AS n FROM e GROUP BY 1),
t AS (SELECT node, count(*) AS n FROM r WHERE origin <> node GROUP BY 1), f AS (SELECT dst AS node, count(*) AS n FROM e WHERE src <> dst GROUP BY 1)
SELECT n_nationkey AS node, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS declarations, coalesce(o.n, 0) AS imports, coalesce(i.n, 0) AS imported_by, coalesce(t.n, 0) AS importers, coalesce(f.n, 0) AS referrers
FROM nation LEFT JOIN i ON i.node = n_nationkey LEFT JOIN o ON o.node = n_nationkey LEFT JOIN t ON t.node = n_nationkey LEFT JOIN f ON f.node = n_nationkey""")
def impact_census(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    counts = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count("*").alias("declarations"))
    return graph.census(nodes, _ring(spark, d), _ring(spark, d), counts)


@query(f"{_REACH} SELECT 'importers' AS mode, origin AS node FROM r WHERE node = 3 UNION SELECT 'importers', 3 UNION SELECT 'referrers', src FROM e WHERE dst = 3 AND src <> dst UNION SELECT 'referrers', 3 UNION SELECT 'self', 3 UNION SELECT 'all', n_nationkey FROM nation")
def impact_modes(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    changed, edges = nodes.where("node = 3"), _ring(spark, d)
    out = None
    for mode in graph.MODES:
        part = graph.impact(changed, edges, edges, nodes, mode).select(F.lit(mode).alias("mode"), "node")
        out = part if out is None else out.unionAll(part)
    return out


_LINKS = "(SELECT DISTINCT o_custkey % 997 AS src, (o_orderkey * 31) % 997 AS dst FROM orders WHERE o_orderkey % (SELECT greatest(1, count(*) // 2000) FROM orders) = 0)"


def _links(spark, d):
    """About 2,000 edges over 997 nodes: with cycles, a large strong component and a fringe."""
    orders = table(spark, d, "orders")
    every = orders.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 2000)).alias("every"))
    rows = orders.crossJoin(every).where(F.col("o_orderkey") % F.col("every") == 0)  # one row on the right
    edges = rows.select((F.col("o_custkey") % 997).alias("src"), (F.col("o_orderkey") * 31 % 997).alias("dst")).distinct()
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), edges


_FAR = f"WITH RECURSIVE e AS {_LINKS}, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r AS (SELECT src AS origin, dst AS node FROM e UNION SELECT origin, dst FROM r JOIN e ON src = node)"


@query(f"{_FAR} SELECT node, 1 + coalesce(n, 0) AS size FROM v LEFT JOIN (SELECT origin AS node, count(*) AS n FROM r WHERE origin <> node GROUP BY 1) USING (node)")
def reachable_sizes(spark, d):
    """How many nodes each reaches, by bitmaps: no row for a pair."""
    return graph.closure_sizes(*_links(spark, d))


@query(f"""{_FAR}, i AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY 1), o AS (SELECT src AS node, count(*) AS n FROM e GROUP BY 1), t AS (SELECT node, count(*) AS n FROM r WHERE origin <> node GROUP BY 1),
f AS (SELECT dst AS node, count(*) AS n FROM e WHERE src <> dst GROUP BY 1), c AS (SELECT o_custkey % 997 AS node, count(*) AS n FROM orders GROUP BY 1)
SELECT node, coalesce(c.n, 0) AS declarations, coalesce(o.n, 0) AS imports, coalesce(i.n, 0) AS imported_by, coalesce(t.n, 0) AS importers, coalesce(f.n, 0) AS referrers
FROM v LEFT JOIN c USING (node) LEFT JOIN i USING (node) LEFT JOIN o USING (node) LEFT JOIN t USING (node) LEFT JOIN f USING (node)""")
def reachable_census(spark, d):
    nodes, edges = _links(spark, d)
    counts = table(spark, d, "orders").groupBy((F.col("o_custkey") % 997).alias("node")).agg(F.count("*").alias("declarations"))
    return graph.census(nodes, edges, edges, counts)


@query("""WITH o AS (SELECT o_orderkey AS k, sum(CAST(o_orderkey % 1009 = 0 AS INT)) OVER (ORDER BY o_orderkey) AS run FROM orders),
s AS (SELECT run, min(k) AS first FROM o WHERE k % 5 = 3 GROUP BY 1) SELECT k AS node FROM o JOIN s USING (run) WHERE k > first""")
def closure_deep(spark, d):
    """Chains of about a thousand orders each, by their keys: from each order to the next, but for every 1,009th key."""
    rows = numbered(table(spark, d, "orders").select(F.col("o_orderkey").alias("node")), [F.col("node")])
    after = rows.select(F.col("node").alias("dst"), (F.col("id") - 1).alias("id")).where("dst % 1009 <> 0")
    edges = rows.join(after, "id").select(F.col("node").alias("src"), "dst")
    return graph.closure(rows.where("node % 5 = 3").select("node"), edges)


_SCORE = """CASE WHEN starts_with(regexp_extract(lower(n), '[^ ]*$'), 'bo') THEN 3000 - length(regexp_extract(lower(n), '[^ ]*$')) WHEN starts_with(lower(n), 'bo') THEN 2000 - length(n)
WHEN instr(lower(n), 'bo') > 1 THEN 1000 - (instr(lower(n), 'bo') - 1) ELSE 0 END"""


@query(f"SELECT n AS name, score, row_number() OVER (ORDER BY score DESC, length(n), n) AS rank FROM (SELECT n, {_SCORE} AS score FROM (SELECT DISTINCT p_name AS n FROM part)) WHERE score > 0 ORDER BY score DESC, length(n), n LIMIT 200")
def search_rank(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    out = search.search(names, "  BO", 200, ident="name", separator=" ")
    return out.select("name", F.col("score").cast("int").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS id, lag(n) OVER (ORDER BY n) AS b FROM (SELECT DISTINCT p_name AS n FROM part)),
s AS (SELECT n, id, CASE WHEN id % 16 = 0 THEN 0 ELSE len(list_filter(range(1, least(length(n), length(b), 254) + 1), lambda i: left(n, CAST(i AS INT)) = left(b, CAST(i AS INT)))) END AS shared FROM o)
SELECT n AS p_name, id, shared, substr(n, shared + 1) AS suffix FROM s""")
def front_coding(spark, d):
    out = search.front_coded(table(spark, d, "part"), "p_name")
    return out.select("p_name", F.col("id").cast("long").alias("id"), F.col("shared").cast("long").alias("shared"), "suffix")


@query("""SELECT path, parent, depth, bool_or(path = n) AS has_page FROM (SELECT n, array_to_string(w[1:i], ' ') AS path, array_to_string(w[1:i-1], ' ') AS parent, i AS depth
FROM (SELECT n, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT DISTINCT p_name AS n, string_split(p_name, ' ') AS w FROM part))) GROUP BY 1, 2, 3""")
def trie_nodes(spark, d):
    return search.tree(table(spark, d, "part"), "p_name", " ").withColumn("depth", F.col("depth").cast("long"))


@query("""WITH h AS (SELECT DISTINCT replace(p_name, ' ', '.') AS m FROM part), w AS (SELECT DISTINCT regexp_extract(m, '[^.]*$') AS n FROM h UNION SELECT 'x.' || m FROM h)
SELECT n AS name, min(m) AS match FROM w JOIN h ON m = n OR ends_with(m, '.' || n) OR ends_with(n, '.' || m) GROUP BY 1""")
def suffix_match(spark, d):
    have = table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit(".")).alias("name")).distinct()
    want = have.select(F.substring_index("name", ".", -1).alias("name")).unionAll(have.select(F.concat(F.lit("x."), "name")))
    return links.suffix_match(want, have.withColumn("ord", F.col("name")))


@query("""WITH k AS (SELECT DISTINCT replace(p_name, ' ', '.') AS n FROM part), w AS (SELECT n || '.a.1' AS n FROM k UNION SELECT n || '._x' FROM k UNION SELECT split_part(n, '.', 1) FROM k)
SELECT w.n AS name, arg_max(k.n, length(k.n)) AS parent FROM w JOIN k ON contains(k.n, '.') AND (w.n = k.n OR starts_with(w.n, k.n || '.')) GROUP BY 1""")
def linkable_parents(spark, d):
    known = table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit(".")).alias("name")).distinct()
    want = known.select(F.concat("name", F.lit(".a.1")).alias("name")).unionAll(known.select(F.concat("name", F.lit("._x")))).unionAll(known.select(F.substring_index("name", ".", 1)))
    return links.linkable_parent(want, known)


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.m IS NULL THEN 'only a' WHEN a.m IS NULL THEN 'only b' WHEN a.m = b.m THEN 'same' ELSE 'moved' END AS state,
CASE WHEN b.m IS NULL THEN a.m IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 2) WHEN a.m IS NULL THEN b.m IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 1) END AS known
FROM (SELECT l_partkey AS k, min(l_suppkey) AS m FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, min(l_suppkey) AS m FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) b ON a.k = b.k""".replace(
    "a.m IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 2)", "a.m IN (SELECT min(l_suppkey) FROM lineitem WHERE l_linenumber = 2 GROUP BY l_partkey)"
).replace("b.m IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 1)", "b.m IN (SELECT min(l_suppkey) FROM lineitem WHERE l_linenumber = 1 GROUP BY l_partkey)"))
def compare_maps(spark, d):
    side = lambda n: table(spark, d, "lineitem").where(F.col("l_linenumber") == n).groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_suppkey").alias("m"))
    return links.compare_maps(side(1), side(2), "k", "m")


@query(r"""SELECT page_id, href, count(*) AS n, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:|^//') THEN 'external' WHEN starts_with(href, '#') THEN 'fragment' ELSE 'internal' END AS kind
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""")
def href_scan(spark, d):
    rows = ir.pages(table(spark, d, "pages"), "page_id", "html").select("page_id", F.explode("hrefs").alias("href"))
    return rows.groupBy("page_id", "href").agg(F.count("*").alias("n")).withColumn("kind", links.target_kind(F.col("href")))


@query("""SELECT page_id, regexp_replace(p, '\\.', '/', 'g') || '.html' AS path, './' || repeat('../', len(string_split(p, '.')) - 1) AS root
FROM (SELECT page_id, replace(regexp_extract(url, '^[a-z]+://([^/]+/[^?#.]*)', 1), '/', '.') AS p FROM pages)""".replace("\\\\", "\\"))
def page_paths(spark, d):
    module = F.replace(F.regexp_extract("url", r"^[a-z]+://([^/]+/[^?#.]*)", 1), F.lit("/"), F.lit("."))
    return table(spark, d, "pages").select("page_id", N.page_path(module).alias("path"), N.page_root(module).alias("root"))


@query("SELECT k, side FROM (SELECT o_orderkey AS k, 'orders' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) UNION ALL SELECT DISTINCT l_orderkey, 'items' FROM lineitem WHERE l_quantity > 40 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders))")
def both_direction_check(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    b = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("k"))
    return checks.both_ways(a, b, ["k"], ("orders", "items"))


@query("""SELECT DISTINCT o_custkey AS module, o_orderpriority AS name FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)""")
def dependency_refs(spark, d):
    own = table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("module"))
    return snapshot.dependency_refs(table(spark, d, "orders").select(F.col("o_custkey").alias("module"), F.col("o_orderpriority").alias("name")), own, "module", "name")


@query("SELECT p_name, 'c:' || CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'def' ELSE split_part(p_type, ' ', 1) END AS kind, replace(replace(replace(replace(p_brand || '<&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS safe FROM (SELECT DISTINCT p_name, p_type, p_brand FROM part)")
def kinds_and_escapes(spark, d):
    kind = F.when(F.split_part("p_type", F.lit(" "), F.lit(1)) == "ECONOMY", "definition").otherwise(F.split_part("p_type", F.lit(" "), F.lit(1)))
    rows = table(spark, d, "part").select("p_name", "p_type", "p_brand").distinct()
    return rows.select("p_name", F.concat(F.lit("c:"), N.kind_class(kind)).alias("kind"), N.escape_html(F.concat("p_brand", F.lit("<&>"))).alias("safe"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, event_type <> 'purchase' AS work, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT user_id, n, event_id, event_type AS previous, CAST(NULL AS VARCHAR) AS acted, CASE WHEN work THEN 'settling' ELSE 'idle' END AS step FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, e.event_id, e.event_type, CASE WHEN e.work AND e.event_type = s.previous AND e.event_type IS DISTINCT FROM s.acted THEN e.event_type ELSE s.acted END,
CASE WHEN NOT e.work THEN 'idle' WHEN e.event_type <> s.previous THEN 'settling' WHEN e.event_type IS NOT DISTINCT FROM s.acted THEN 'skip' ELSE 'rebuild' END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT CAST(user_id AS VARCHAR) AS target, event_id AS seq, previous AS digest, step FROM s""")
def watch_settle(spark, d):
    """Every user's events as polled readings: the digest is the type, purchases are no work."""
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("target"), F.col("event_id").alias("seq"), F.col("event_type").alias("digest"), (F.col("event_type") != "purchase").alias("work"))
    return watch.steps_of_batch(rows)
