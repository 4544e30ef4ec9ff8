"""More queries over the driver's tables: names, environments, links, search and snapshots, with the DuckDB SQL that must give the same rows.

As in the catalog, columns of the tables take the roles of modules, declarations and references.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import names as N
from fathom.operators import checks, environment, graph, index, links, search, snapshot, stats
from fathom.plans.catalog import long, query, table
from fathom.sources import ir

#: A dotted name for each part, with a component that needs guillemets.
_PART = "SELECT DISTINCT 'Pkg.«' || p_brand || '».' || replace(p_name, ' ', '.') AS n, p_brand AS b, p_name AS p FROM part"


def _parts(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit("Pkg.«"), "p_brand", F.lit("»."), F.replace("p_name", F.lit(" "), F.lit("."))).alias("n"), F.col("p_brand").alias("b"), F.col("p_name").alias("p"))
    return rows.distinct()


# ---- scalar functions


@query("""SELECT doc_id, length(text) AS units, CASE WHEN length(text) >= 9 THEN substr(text, 3, 7) END AS part FROM documents WHERE text IS NOT NULL""")
def utf16_units(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", N.utf16_length(c).cast("long").alias("units"), N.utf16_slice(c, F.lit(2), F.lit(9)).alias("part"))


@query("SELECT s, row_number() OVER (ORDER BY s) AS nth FROM (SELECT DISTINCT left(text, 12) AS s FROM documents WHERE text <> '')")
def utf16_order(spark, d):
    out = index.dictionary(table(spark, d, "documents").where("text <> ''").select(F.left("text", F.lit(12)).alias("s")), "s")
    return out.select("s", (F.col("id") + 1).alias("nth"))


@query(f"SELECT n, 'Pkg' AS root, 'Pkg|' || b || '|' || replace(p, ' ', '|') AS parts, n AS escaped, 'Pkg/' || b || '/' || replace(p, ' ', '/') AS path FROM ({_PART})")
def name_components(spark, d):
    c = F.col("n")
    parts = N.components(c)
    return _parts(spark, d).select("n", N.module_root(c).alias("root"), F.array_join(parts, "|").alias("parts"), N.escape_module(parts).alias("escaped"), N.module_path(c).alias("path"))


@query(f"SELECT x, x NOT LIKE '%#%' OR x LIKE '%«%' AS name FROM (SELECT n AS x FROM ({_PART}) UNION SELECT 'Pkg.' || b || '.x' FROM ({_PART}) UNION SELECT replace(p, ' ', '._') FROM ({_PART}))")
def name_literals(spark, d):
    rows = _parts(spark, d)
    other = rows.select(F.concat(F.lit("Pkg."), "b", F.lit(".x")).alias("x")).unionAll(rows.select(F.replace("p", F.lit(" "), F.lit("._")).alias("x")))
    rows = rows.select(F.col("n").alias("x")).unionAll(other).distinct()
    return rows.select("x", N.is_name(F.col("x")).alias("name"))


@query("""SELECT x, row_number() OVER (ORDER BY len(string_split(x, '.')), string_split(x, '.')) AS nth FROM (
SELECT DISTINCT replace(p_name, ' ', '.') AS x FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part UNION SELECT replace(p_name, ' ', '.') || '.' || p_type FROM part)""")
def depth_first_order(spark, d):
    part = table(spark, d, "part")
    dotted = F.replace("p_name", F.lit(" "), F.lit("."))
    rows = part.select(dotted.alias("x")).unionAll(part.select(F.split_part("p_name", F.lit(" "), F.lit(1)))).unionAll(part.select(F.concat_ws(".", dotted, "p_type"))).distinct()
    key = N.depth_first_key(F.col("x"))
    out = index.numbered(rows, [key["depth"], key["parts"]], "nth")
    return out.select("x", (F.col("nth") + 1).alias("nth"))


@query("""SELECT DISTINCT p_partkey AS k, 'https://github.com/o/r/blob/x/' || replace(p_name, ' ', '/') || '.lean' AS url, '<span class="name">' || split_part(p_name, ' ', 1) || '</span>.<span class="name">' || split_part(p_name, ' ', 2) || '</span>' AS broken,
split_part(p_name, ' ', 1) AS prefix, 'Org' || p_size || '/' || p_type AS repository FROM part""")
def source_links(spark, d):
    dotted = F.replace("p_name", F.lit(" "), F.lit("."))
    remotes = [F.concat(F.lit(a), F.lit("Org"), "p_size", F.lit("/"), "p_type", F.lit(b)) for a, b in (("git@github.com:", ".git"), ("https://github.com/", ""), ("https://me@github.com/", ".git"), ("ssh://git@github.com/", "/"))]
    remote = F.get(F.array(*remotes), F.col("p_partkey") % 4)
    url = N.source_url(F.lit("https://github.com/o/r/blob/x/"), dotted)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), url.alias("url"), N.break_within(dotted).alias("broken"), N.sort_prefix(F.col("p_name")).alias("prefix"), N.github_path(remote).alias("repository"))


@query("""SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN 'Known.html' WHEN 1 THEN '#' || p_name WHEN 2 THEN 'https://x/' || p_name ELSE '../' || p_name END AS link FROM part""")
def docstring_targets(spark, d):
    size = F.col("p_size") % 4
    target = F.when(size == 0, F.concat(F.lit("##"), "p_name")).when(size == 1, F.concat(F.lit("#"), "p_name")).when(size == 2, F.concat(F.lit("https://x/"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), N.absolute_link(target, F.lit("../"), F.lit("Known.html")).alias("link"))


@query("""SELECT o_orderkey AS k, format('{:,}', CAST(o_orderkey * 997 AS BIGINT)) AS grouped, CAST(o_orderkey % 3 AS INT) AS leading, CAST(o_orderkey % 3 + length(o_orderpriority) + 2 AS INT) AS total, 2 AS trailing FROM orders""")
def widths_and_groups(spark, d):
    text = F.concat(F.repeat(F.lit(" "), (F.col("o_orderkey") % 3).cast("int")), "o_orderpriority", F.lit(" \t"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), N.grouped(F.col("o_orderkey") * 997).alias("grouped"), N.trim_widths(text).alias("w"))
    return rows.select("k", "grouped", "w.leading", "w.total", "w.trailing")


@query(r"""SELECT p_partkey AS k, '"a\\' || p_name || '\"\n\t\x01"' AS quoted FROM part""")
def quoted_texts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), N.quoted(F.concat(F.lit("a\\"), "p_name", F.lit('"\n\t\x01'))).alias("quoted"))


@query("""WITH w AS (SELECT doc_id, string_split(replace(left(text, 200), chr(10), ' '), ' ') AS w FROM documents WHERE length(text) > 200)
SELECT doc_id, w[1] || '.' || w[2] || '|' || w[2] || '|' || w[3] || '|x/' || w[4] || '.y|y' AS tokens FROM w WHERE regexp_matches(w[1] || w[2] || w[3] || w[4], '^[A-Za-z]+$') AND w[1] <> '' AND w[2] <> '' AND w[3] <> '' AND w[4] <> ''""")
def autolink_tokens(spark, d):
    rows = table(spark, d, "documents").where("length(text) > 200").select("doc_id", F.split(F.replace(F.left("text", F.lit(200)), F.lit("\n"), F.lit(" ")), " ").alias("w"))
    w = [F.col("w")[i] for i in range(4)]
    rows = rows.where(F.concat(*w).rlike("^[A-Za-z]+$") & (w[0] != "") & (w[1] != "") & (w[2] != "") & (w[3] != ""))
    doc = F.concat(F.lit("See `"), w[0], F.lit("."), w[1], F.lit(" "), w[2], F.lit("` or [it](x/"), w[3], F.lit(".y) `not\nclosed`"))
    return rows.select("doc_id", F.array_join(N.link_tokens(doc), "|").alias("tokens"))


@query(r"""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(left(text, 80), '[\p{P}\p{Z}\p{C}]+'), lambda x: x <> ''), '-') AS anchor FROM documents WHERE text IS NOT NULL""")
def heading_anchors(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", N.heading_id(F.left("text", F.lit(80))).alias("anchor"))


@query("""SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 4 = 0 THEN 'user' || l_partkey ELSE 'A.user' || l_partkey END AS name, CASE WHEN l_linenumber % 4 <> 0 THEN NULL ELSE 'M.N' END AS module FROM lineitem""")
def private_names(spark, d):
    name = F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("_private.M.N.0.user"), "l_partkey")).otherwise(F.concat(F.lit("A.user"), "l_partkey"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), N.private_user_name(name).alias("name"), N.private_module(name).alias("module"))


@query("SELECT c_custkey AS k, CASE WHEN c_nationkey % 3 = 0 THEN 'sorry' WHEN c_nationkey % 2 = 0 THEN 'unknown' ELSE 'clean' END AS fact FROM customer")
def three_valued_facts(spark, d):
    value = F.when(F.col("c_nationkey") % 3 == 0, "sorry")
    version = F.when(F.col("c_nationkey") % 2 == 0, 4).otherwise(6)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), N.known_or(version, value, 5).alias("fact"))


# ---- environments

_SORTS = ("axiom", "theorem", "opaque", "definition", "inductive", "constructor", "quotient", "recursor")
_FLAGS = "SELECT l_partkey * 10 + l_linenumber AS k, l_partkey, l_suppkey, l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q FROM lineitem"


def _constants(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    flag = lambda n, r: (F.col("q") % n == r)
    return rows.select(
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("name"),
        F.concat_ws("/", "l_orderkey", "l_suppkey").alias("module"),
        F.struct("l_orderkey", "l_suppkey", "q").alias("module_ord"),
        F.get(F.array(*[F.lit(s) for s in _SORTS]), (F.col("l_partkey") % 8).cast("int")).alias("constant"),
        flag(2, 0).alias("instance"), flag(11, 3).alias("projection"), flag(3, 0).alias("structure"), flag(5, 0).alias("class"),
        (~flag(7, 0)).alias("has_range"), flag(13, 1).alias("internal"), flag(17, 2).alias("recursor"),
        F.when(F.col("q") % 19 != 0, flag(23, 5)).alias("matcher"), F.lit(False).alias("aux_recursor"), F.lit(None).cast("boolean").alias("no_confusion"), F.lit(False).alias("internal_detail"),
        flag(4, 1).alias("unsafe"), flag(6, 1).alias("noncomputable"), flag(9, 1).alias("abbrev"), flag(10, 1).alias("partial"),
    )


_ENVIRONMENT = f"""WITH f AS ({_FLAGS}), o AS (SELECT k, arg_min(struct_pack(p := l_partkey, m := l_orderkey || '/' || l_suppkey, q := q), struct_pack(a := l_orderkey, b := l_suppkey, c := q)) AS r FROM f GROUP BY k),
e AS (SELECT k, r.m AS module, r.q AS q, ({list(_SORTS)})[r.p % 8 + 1] AS s FROM o),
v AS (SELECT *, CASE WHEN s IN ('theorem', 'definition') THEN CASE WHEN q % 2 = 0 AND q % 11 <> 3 THEN 'instance' ELSE s END
WHEN s = 'inductive' THEN CASE WHEN q % 3 = 0 AND q % 5 = 0 THEN 'class' WHEN q % 3 = 0 THEN 'structure' WHEN q % 5 = 0 THEN 'class_inductive' ELSE 'inductive' END
WHEN s = 'quotient' THEN 'opaque' WHEN s = 'recursor' THEN NULL ELSE s END AS kind FROM e WHERE q % 11 = 3 OR (q % 7 <> 0 AND q % 13 <> 1 AND q % 17 <> 2 AND NOT (q % 19 <> 0 AND q % 23 = 5)))"""


@query(f"""{_ENVIRONMENT} SELECT k AS name, module, kind, CASE WHEN s = 'axiom' AND q % 4 = 1 THEN 'unsafe' WHEN s = 'opaque' AND q % 10 = 1 THEN 'partial' WHEN s = 'opaque' AND q % 4 = 1 THEN 'unsafe'
WHEN s = 'definition' THEN concat_ws(',', CASE WHEN q % 4 = 1 THEN 'unsafe' END, CASE WHEN q % 6 = 1 THEN 'noncomputable' END, CASE WHEN kind = 'definition' AND q % 9 = 1 THEN 'abbrev' END)
WHEN kind = 'inductive' AND q % 4 = 1 THEN 'unsafe' ELSE '' END AS modifiers FROM v WHERE kind IS NOT NULL""")
def environment_scan(spark, d):
    """Constants under their first module, shown ones only, with kind and modifiers."""
    return environment.scan(_constants(spark, d)).select("name", "module", "kind", F.array_join("modifiers", ",").alias("modifiers"))


@query(f"""{_ENVIRONMENT} SELECT kind, m AS modifiers, CASE WHEN kind IN ('definition', 'instance') THEN CASE WHEN m LIKE '%unsafe%' THEN 'unsafe ' ELSE '' END || CASE WHEN m LIKE '%noncomputable%' THEN 'noncomputable ' ELSE '' END
|| CASE WHEN kind = 'instance' THEN 'instance' WHEN m LIKE '%abbrev%' THEN 'abbrev' ELSE 'def' END WHEN kind = 'opaque' AND m = 'partial' THEN 'partial def' WHEN kind IN ('axiom', 'opaque', 'inductive') AND m = 'unsafe' THEN 'unsafe ' || kind
WHEN kind = 'class_inductive' THEN 'class inductive' ELSE kind END AS words, CAST(n AS BIGINT) AS n FROM (SELECT kind, m, count(*) AS n FROM (SELECT kind, CASE WHEN s = 'axiom' AND q % 4 = 1 THEN 'unsafe' WHEN s = 'opaque' AND q % 10 = 1 THEN 'partial'
WHEN s = 'opaque' AND q % 4 = 1 THEN 'unsafe' WHEN s = 'definition' THEN concat_ws(',', CASE WHEN q % 4 = 1 THEN 'unsafe' END, CASE WHEN q % 6 = 1 THEN 'noncomputable' END, CASE WHEN kind = 'definition' AND q % 9 = 1 THEN 'abbrev' END)
WHEN kind = 'inductive' AND q % 4 = 1 THEN 'unsafe' ELSE '' END AS m FROM v WHERE kind IS NOT NULL) GROUP BY 1, 2)""")
def kind_descriptions(spark, d):
    rows = environment.scan(_constants(spark, d)).groupBy("kind", "modifiers").agg(F.count("*").alias("n"))
    return rows.select("kind", F.array_join("modifiers", ",").alias("modifiers"), N.kind_words(F.col("kind"), F.col("modifiers")).alias("words"), "n")


@query("""SELECT p_partkey AS k, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'simp' END, CASE WHEN p_size % 7 = 0 THEN 'csimp' END, CASE WHEN p_size % 3 = 0 THEN 'reducible' END, 'tag1', p_type, CASE WHEN p_size % 5 = 0 THEN 'inline' END,
'extern ' || p_brand, CASE WHEN p_size % 4 <> 0 THEN 'instance ' || p_size END, CASE WHEN p_size % 11 = 0 THEN 'defaultInstance 50' END], lambda x: x IS NOT NULL), ', ') AS attributes FROM part""")
def attributes_in_order(spark, d):
    size = F.col("p_size")
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("k"), (size % 2 == 0).alias("simp"), F.when(size % 7 == 0, True).alias("csimp"), F.when(size % 3 == 0, "reducible").when(size % 3 == 1, "semireducible").alias("reducibility"),
        F.array(F.lit("tag1"), "p_type").alias("tags"), F.when(size % 5 == 0, "inline").alias("inline"), F.array(F.array(F.lit("extern"), "p_brand")).alias("parametric"),
        F.when(size % 4 == 0, 1000).otherwise(size).alias("priority"), F.when(size % 11 == 0, 50).alias("default_priority"),
    )
    return rows.select("k", F.array_join(F.transform(environment.attributes(), N.attribute_text), ", ").alias("attributes"))


@query("""SELECT l_orderkey AS k, array_to_string(list(CASE WHEN l_linenumber = 2 THEN '_builtin_prop' WHEN l_linenumber = 3 THEN '_builtin_typeu' WHEN l_linenumber = 4 THEN '_builtin_sortu' ELSE 'c' || l_partkey END ORDER BY l_linenumber, l_partkey)
FILTER (l_quantity > 10 AND l_linenumber <> 5), ',') AS types FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity > 10 AND l_linenumber <> 5) > 0""")
def instance_index(spark, d):
    sort = F.when(F.col("l_linenumber") == 2, "zero").when(F.col("l_linenumber") == 3, "succ").when(F.col("l_linenumber") == 4, "max")
    argument = F.struct("l_linenumber", "l_partkey", (F.col("l_quantity") > 10).alias("explicit"), sort.alias("sort"), F.when(F.col("l_linenumber") != 5, F.concat(F.lit("c"), "l_partkey")).alias("head"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(argument)).alias("a"))
    return rows.select("k", environment.instance_types(F.col("a")).alias("t")).where("size(t) > 0").select("k", F.array_join("t", ",").alias("types"))


_RING = "(SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation WHERE n_nationkey % 3 <> 0)"


@query(f"""WITH RECURSIVE e AS {_RING}, r AS (SELECT src AS node FROM e WHERE dst IN (3, 7) UNION SELECT e.src FROM r JOIN e ON e.dst = r.node)
SELECT node, CASE WHEN node IN (3, 7) THEN 'direct' ELSE 'transitive' END AS kind FROM (SELECT node FROM r UNION SELECT 3 UNION SELECT 7)""")
def sorry_facts(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"))
    edges = nation.where("src % 3 <> 0").select("src", ((F.col("src") * 2 + 1) % 25).alias("dst"))
    direct = nation.where("src in (3, 7)").select(F.col("src").alias("node"))
    return environment.sorry_facts(direct, edges)


@query("SELECT c_custkey AS k, CASE WHEN c_nationkey % 4 = 0 THEN NULL WHEN c_nationkey % 4 = 1 THEN 'direct' ELSE 'transitive' END AS sorry FROM customer")
def sorry_kinds(spark, d):
    n = F.col("c_nationkey") % 4
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), environment.sorry(n != 0, F.when(n == 1, True).when(n == 2, False)).alias("sorry"))


@query("""WITH s AS (SELECT 'S' || p_partkey AS s, p_size FROM part) SELECT s || '.ext' AS name, s AS origin FROM s WHERE p_size % 2 = 0 AND p_size % 3 = 0 AND p_size % 5 <> 0
UNION ALL SELECT s || '.ext_iff', s || '.ext' FROM s WHERE p_size % 2 = 0 AND p_size % 5 <> 0""")
def generated_origins(spark, d):
    s = table(spark, d, "part").select(F.concat(F.lit("S"), "p_partkey").alias("s"), "p_size")
    declared = s.select(F.concat("s", F.lit(".ext")).alias("name"), (F.col("p_size") % 5 != 0).alias("same_range")).unionAll(s.select(F.concat("s", F.lit(".ext_iff")), F.col("p_size") % 5 != 0))
    structures = s.where("p_size % 3 = 0").select(F.col("s").alias("name"))
    return environment.generated_origin(declared, structures, s.where("p_size % 2 = 0").select(F.concat("s", F.lit(".ext")).alias("name")))


@query("""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) < 200)) AS kept, len(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 200)) > 0 AS dropped FROM documents WHERE text IS NOT NULL""")
def equation_limit(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", index.limited_equations(F.split("text", "\n")).alias("e"))
    return rows.select("doc_id", F.size("e.kept").cast("long").alias("kept"), "e.dropped")


@query("""SELECT l_orderkey AS k, arg_min(l_partkey, struct_pack(a := l_quantity, b := l_linenumber, c := l_partkey)) AS name FROM lineitem WHERE l_linenumber % 3 = 1 GROUP BY 1""")
def head_constants(spark, d):
    span = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("start"), (F.col("l_quantity") + 1).cast("int").alias("stop"), (F.col("l_linenumber") % 3).alias("kind"), F.col("l_partkey").alias("name"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(span)).alias("s"))
    return rows.select("k", index.head_constant(F.col("s")).alias("name")).where("name is not null")


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 6 = 0 THEN 'private name' WHEN p_size % 6 IN (1, 2, 3) THEN 'name shape' WHEN p_retailprice > 1000 THEN 'module absent' ELSE 'unclassified' END AS cause FROM part""")
def miss_causes(spark, d):
    heads = [F.concat(F.lit("_private.M.0."), "p_type"), F.concat("p_type", F.lit(".match_1")), F.concat("p_type", F.lit("._x.y")), F.concat("p_type", F.lit(".casesOn")), F.concat("p_type", F.lit(".matched")), F.col("p_type")]
    name = F.get(F.array(*heads), F.col("p_size") % 6)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), links.miss_cause(name, F.col("p_retailprice") <= 1000).alias("cause"))


@query("SELECT page_id, concat_ws(' + ', CASE WHEN page_id % 2 = 0 THEN 'prefix' END, CASE WHEN page_id % 3 = 0 THEN 'path' END, CASE WHEN page_id % 5 = 0 THEN 'anchor' END) AS differs FROM pages")
def href_differences(spark, d):
    url, n = F.col("url"), F.col("page_id")
    other = lambda k, c: F.when(n % k == 0, F.concat(c, F.lit("!"))).otherwise(c)
    parts = {"prefix": (2, F.lit("../")), "path": (3, url), "anchor": (5, F.lit(None).cast("string"))}
    generated = {k: F.when(n % m == 0, F.lit("x")).otherwise(c) if k == "anchor" else other(m, c) for k, (m, c) in parts.items()}
    return table(spark, d, "pages").select("page_id", links.href_difference({k: c for k, (_, c) in parts.items()}, generated).alias("differs"))


# ---- indexes and statistics


@query("""SELECT count(DISTINCT l_partkey) AS declarations, (SELECT count(DISTINCT o_custkey + 100000000) FROM orders) AS dependency_names, (SELECT count(DISTINCT p_brand) FROM part) AS classes, (SELECT count(DISTINCT p_type) FROM part) AS types,
count(DISTINCT l_partkey) AS targets, count(DISTINCT (l_partkey, l_orderkey)) AS edges FROM lineitem""")
def index_counts(spark, d):
    refs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("user"))
    deps = table(spark, d, "orders").select((F.col("o_custkey") + 100000000).alias("name")).unionAll(refs.select("name"))
    return index.counts(refs.select("name"), deps, table(spark, d, "part").select(F.col("p_brand").alias("class"), F.col("p_type").alias("type")), refs)


@query("SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS id FROM orders")
def module_subscripts(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return index.subscripts(rows, rows, "o_orderpriority", "id").withColumn("id", long("id"))


@query("SELECT module, string_agg(seq || ':' || name, ',' ORDER BY seq) AS tactics FROM (SELECT user_id AS module, event_id AS seq, event_type AS name FROM events) GROUP BY 1")
def tactic_buckets(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("module"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"))
    out = stats.tactics_by_module(rows, "module", "seq")
    return out.select("module", F.array_join(F.transform("tactics", lambda t: F.concat_ws(":", t["seq"], t["name"])), ",").alias("tactics"))


@query("""SELECT l_orderkey AS k, count(*) AS total, count(*) FILTER (l_linenumber % 3 = 1) AS const, count(*) FILTER (l_linenumber % 3 = 2) AS sort, count(*) FILTER (l_linenumber % 3 = 0) AS other, 2 AS blank FROM lineitem GROUP BY 1""")
def span_tallies(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct((F.col("l_linenumber") % 3).alias("kind"))).alias("s"))
    rows = rows.select("k", stats.span_tally(F.col("s"), F.lit("a b\tc")).alias("t"))
    return rows.select("k", *[F.col(f"t.{c}").cast("long").alias(c) for c in ("total", "const", "sort", "other", "blank")])


@query("SELECT event_type AS kind, count(*) AS reads, count(*) / CAST(40 AS DOUBLE) AS passes FROM events GROUP BY 1")
def read_passes(spark, d):
    return stats.full_passes(table(spark, d, "events").withColumnRenamed("event_type", "kind"), "kind", 40)


@query("SELECT n_name AS root, n_regionkey AS base, (SELECT min(n_name || '.' || c_name) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS sample FROM nation")
def link_reports(spark, d):
    nation = table(spark, d, "nation")
    known = table(spark, d, "customer").where("c_acctbal > 9000").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(".", "n_name", "c_name").alias("module"))
    return stats.link_report(nation.select(F.col("n_name").alias("root"), F.col("n_regionkey").alias("base")), known, N.module_root(F.col("module")))


@query("""SELECT count(*) AS modules, CAST(sum(n) AS BIGINT) AS imports, CAST(sum(n) AS BIGINT) AS declarations, CAST(sum(m) AS BIGINT) AS members, CAST(sum(e) AS BIGINT) AS equations,
(SELECT count(DISTINCT l_partkey) FROM lineitem) AS names, (SELECT count(DISTINCT (l_orderkey, l_partkey)) FROM lineitem) AS pairs
FROM (SELECT l_orderkey, count(*) AS n, sum(l_linenumber) AS m, sum(CAST(l_quantity AS INT) % 3) AS e FROM lineitem GROUP BY 1)""")
def tree_totals(spark, d):
    items = table(spark, d, "lineitem")
    some = lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: i)).otherwise(F.array().cast("array<int>"))
    decl = F.struct(some(F.col("l_linenumber")).alias("members"), some(F.col("l_quantity").cast("int") % 3).alias("equations"))
    mods = items.groupBy(F.col("l_orderkey").alias("module")).agg(F.collect_list("l_partkey").alias("imports"), F.collect_list(decl).alias("declarations"))
    return stats.tree_totals(mods, items.select(F.col("l_orderkey").alias("user"), F.col("l_partkey").alias("name")))


@query("SELECT count(*) AS files, CAST(sum(o_orderkey) AS BIGINT) AS bytes FROM orders WHERE o_custkey % 3 = 1")
def tree_sizes(spark, d):
    """Files and bytes of the entries of an index."""
    entries = table(spark, d, "orders").where("o_custkey % 3 = 1").select(F.col("o_orderkey").cast("long").alias("bytes"))
    return stats.tree_bytes(entries)


@query("""WITH r AS (SELECT l_orderkey AS declaration, l_suppkey % 20 AS short FROM lineitem), n AS (SELECT declaration, short, count(*) AS n FROM r GROUP BY 1, 2)
SELECT declaration, count(*) FILTER (n > 1) AS collisions, count(*) FILTER (short = declaration % 20) AS shadowed FROM n GROUP BY 1""")
def name_collisions(spark, d):
    items = table(spark, d, "lineitem")
    refs = items.select(F.col("l_orderkey").alias("declaration"), F.concat_ws(".", F.lit("A"), "l_partkey", (F.col("l_suppkey") % 20).cast("string")).alias("name"))
    binders = items.select(F.col("l_orderkey").alias("declaration"), (F.col("l_orderkey") % 20).cast("string").alias("binder"))
    return stats.name_collisions(refs, binders)


@query("SELECT count(*) AS modules, CAST(sum(l_linenumber) AS BIGINT) AS declarations, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS bytes FROM lineitem WHERE l_orderkey % 7 = 3")
def impact_summary(spark, d):
    entries = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("declarations"), F.floor("l_extendedprice").cast("long").alias("bytes"))
    return graph.summary(entries.where("node % 7 = 3").select("node"), entries)


@query("SELECT DISTINCT o_custkey + 7 AS node FROM orders WHERE o_custkey + 7 NOT IN (SELECT c_custkey FROM customer)")
def missing_imports(spark, d):
    edges = table(spark, d, "orders").select((F.col("o_custkey") + 7).alias("dst"))
    return graph.missing(edges, table(spark, d, "customer").select(F.col("c_custkey").alias("node")))


@query("SELECT l_partkey AS name, arg_min(l_suppkey, struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey)) AS owner FROM lineitem GROUP BY 1")
def first_owners(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("owner"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("ord"))
    return index.first_owner(rows, "name", "ord").select("name", "owner")


# ---- links


@query("""WITH k AS (SELECT DISTINCT replace(p_name, ' ', '.') AS n FROM part), r AS (SELECT n || '.x.1' AS name, NULL AS ref FROM k UNION ALL SELECT n, 'Own' FROM k UNION ALL SELECT '_private.Mod.0.' || n || '._y', NULL FROM k
UNION ALL SELECT '_private.Mod.0.zz' || split_part(n, '.', 1), NULL FROM k UNION ALL SELECT 'zz.' || n, NULL FROM k)
SELECT DISTINCT name, CASE WHEN ref IS NOT NULL THEN ref WHEN name LIKE '%.x.1' THEN 'M.' || split_part(name, '.', 1) WHEN name LIKE '%._y' THEN 'M.' || split_part(name, '.', 4) WHEN name LIKE '_private.%' THEN 'Mod' END AS module,
CASE WHEN ref IS NOT NULL THEN name WHEN name LIKE '%.x.1' THEN left(name, length(name) - 4) WHEN name LIKE '%._y' THEN substr(name, 16, length(name) - 18) END AS anchor FROM r""")
def constant_links(spark, d):
    names = table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit(".")).alias("n")).distinct()
    none = F.lit(None).cast("string")
    refs = names.select(F.concat("n", F.lit(".x.1")).alias("name"), none.alias("ref_module")).unionAll(names.select("n", F.lit("Own"))).unionAll(names.select(F.concat(F.lit("_private.Mod.0."), "n", F.lit("._y")), none))
    refs = refs.unionAll(names.select(F.concat(F.lit("_private.Mod.0.zz"), F.substring_index("n", ".", 1)), none)).unionAll(names.select(F.concat(F.lit("zz."), "n"), none))
    return links.constant_module(refs, names.select(F.col("n").alias("name"), F.concat(F.lit("M."), F.substring_index("n", ".", 1)).alias("module"))).distinct()


@query("""SELECT c_custkey AS k, CASE WHEN n % 5 = 0 THEN 'https://docs/N' || n || '#c' || c_custkey WHEN n % 5 = 1 THEN 'https://src/N' || n || '/A.lean' || CASE WHEN c_custkey % 2 = 0 THEN '#L' || c_custkey || '-L' || (c_custkey + 3) ELSE '' END
WHEN n % 5 = 2 THEN NULL WHEN n % 5 = 3 THEN './N' || n || '/A.html#c' || c_custkey END AS url FROM (SELECT c_custkey, c_nationkey AS n FROM customer)""")
def external_links(spark, d):
    """A docs site, else the source with its lines, else nothing for a dependency without either, else the local page."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.concat(F.lit("N"), "n_nationkey").alias("root"), F.concat(F.lit("N"), "n_nationkey", F.lit(".A")).alias("module"))
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("N"), "c_nationkey", F.lit(".A")).alias("module"), F.concat(F.lit("c"), "c_custkey").alias("anchor"))
    docs = n.where("n % 5 = 0").select("module", F.concat(F.lit("https://docs/"), "root").alias("docs_url"))
    sources = n.where("n % 5 in (0, 1, 2)").select("root", F.when(F.col("n") % 5 != 2, F.lit("https://src/")).alias("base"))
    ranges = rows.where("c_custkey % 2 = 0").select(F.col("anchor").alias("name"), F.col("c_custkey").alias("line_from"), (F.col("c_custkey") + 3).alias("line_to"))
    out = links.external_link(rows.select("module", "anchor"), docs, sources, n.where("n % 5 = 3").select("module"), ranges)
    return out.select(F.substring("anchor", 2, 20).cast("long").alias("k"), "url")


@query("""WITH m AS (SELECT DISTINCT 'Lib.' || split_part(p_name, ' ', 1) || '.' || split_part(p_name, ' ', 2) AS m FROM part), p AS (SELECT replace(m, '.', '/') AS path FROM m UNION SELECT replace(substr(m, 5), '.', '/') FROM m UNION SELECT split_part(m, '.', 3) FROM m UNION SELECT 'no/where')
SELECT path, coalesce((SELECT m FROM m WHERE m = replace(path, '/', '.')), (SELECT CASE WHEN count(*) = 1 THEN min(m) END FROM m WHERE ends_with(m, '.' || replace(path, '/', '.')))) AS module FROM p""")
def source_modules(spark, d):
    m = table(spark, d, "part").select(F.concat(F.lit("Lib."), F.replace("p_name", F.lit(" "), F.lit("."))).alias("module")).distinct()
    slash = lambda c: F.replace(c, F.lit("."), F.lit("/"))
    paths = m.select(slash(F.col("module")).alias("path")).unionAll(m.select(slash(F.substring("module", 5, 100)))).unionAll(m.select(F.substring_index("module", ".", -1))).unionAll(spark.sql("select 'no/where'"))
    return links.source_module(paths, m)


@query("""SELECT s AS spelling, min(m) AS module FROM (SELECT DISTINCT 'A.' || p_type || '.x' AS s, 'A.«' || p_type || '».x' AS m FROM part UNION SELECT DISTINCT 'A.' || p_type || '.x', 'A.' || p_type || '.x' FROM part WHERE p_type LIKE 'S%' UNION SELECT 'B.' || p_brand, 'B.«' || p_brand || '»' FROM part) GROUP BY 1 HAVING count(*) = 1""")
def unescaped_spellings(spark, d):
    part = table(spark, d, "part")
    rows = part.select(F.concat(F.lit("A.«"), "p_type", F.lit("».x")).alias("module")).unionAll(part.where("p_type like 'S%'").select(F.concat(F.lit("A."), "p_type", F.lit(".x")))).unionAll(part.select(F.concat(F.lit("B.«"), "p_brand", F.lit("»"))))
    return links.unescaped(rows)


@query("""SELECT 'all' AS mode, count(*) AS n FROM orders UNION ALL SELECT 'own', count(*) FILTER (o_custkey % 3 = 0) FROM orders UNION ALL SELECT 'others', count(*) FILTER (o_custkey % 3 <> 0) FROM orders""")
def sliced_maps(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("module"))
    own = rows.where("module % 3 = 0")
    out = None
    for mode in ("all", "own", "others"):
        part = links.slice_map(rows, own, mode).agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = part if out is None else out.unionAll(part)
    return out


@query("""SELECT c_custkey AS k, CASE c_nationkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'elsewhere' ELSE 'found' END AS state FROM customer""")
def verified_docs(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("name"), F.concat(F.lit("M."), "c_nationkey").alias("module"), "c_nationkey")
    page = F.concat(F.lit("./M/"), F.when(F.col("c_nationkey") % 4 == 1, F.lit("X")).otherwise(F.col("c_nationkey").cast("string")), F.lit(".html#"), "name")
    docs = rows.where("c_nationkey % 4 <> 0").select("name", page.alias("docLink"))
    return links.verified_docs(rows, docs).select(F.col("name").cast("long").alias("k"), "state")


@query("""SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) THEN 'exact' WHEN l_quantity < 20 THEN 'explained' ELSE 'mismatch' END AS verdict FROM lineitem WHERE l_orderkey % 5 = 0""")
def emitted_urls(spark, d):
    items = table(spark, d, "lineitem")
    first, last = F.col("l_quantity").cast("int"), F.col("l_quantity").cast("int") + 1
    emitted = items.where("l_orderkey % 5 = 0").select(F.concat_ws("/", "l_partkey", "l_orderkey", "l_linenumber").alias("url"), F.col("l_linenumber").alias("module"), first.alias("first"), last.alias("last"))
    expected = items.join(table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey").select(F.concat_ws("/", "l_partkey", "l_orderkey", "l_linenumber").alias("url"))
    ranges = items.where("l_quantity < 20").select(F.col("l_linenumber").alias("module"), first.alias("first"), last.alias("last"))
    out = links.emitted_urls(emitted, expected, ranges)
    at = lambda i: F.split_part("url", F.lit("/"), F.lit(i)).cast("long")
    return out.select(at(2).alias("k"), at(3).cast("int").alias("n"), at(1).alias("p"), "verdict")


@query("SELECT k FROM (SELECT p_partkey AS k, p_size AS a, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS b FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT p_partkey, p_size, NULL FROM part WHERE p_partkey % 10 = 0) WHERE a IS DISTINCT FROM b")
def index_against_names(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    b = a.where("k % 10 <> 0").withColumn("v", F.when(F.col("v") % 4 != 0, F.col("v")))
    return checks.disagreeing(a, b, "k", "v")


@query(r"""SELECT page_id, href, CASE WHEN href LIKE '%a' THEN 'no page' ELSE 'no anchor' END AS reason FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages) WHERE href LIKE '%a' OR href LIKE '%t'""")
def dead_page_links(spark, d):
    rows = ir.pages(table(spark, d, "pages"), "page_id", "html").select(F.col("page_id").alias("page"), F.explode("hrefs").alias("target")).distinct()
    rows = rows.withColumn("fragment", F.when(F.col("target").endswith("t"), "x").when(F.col("target").endswith("e"), "y"))
    pages = rows.where("target not like '%a'").select("target", F.array(F.lit("y")).alias("anchors")).distinct()
    return checks.dead_links(rows, pages).select(F.col("page").alias("page_id"), F.col("target").alias("href"), "reason")


# ---- search


@query("""WITH n AS (SELECT DISTINCT p_name AS n FROM part), h AS (SELECT n, CASE WHEN starts_with(regexp_extract(n, '[^ ]*$'), 'bol') THEN 3000 - length(regexp_extract(n, '[^ ]*$')) WHEN starts_with(n, 'bol') THEN 2000 - length(n) WHEN instr(n, 'bol') > 1 THEN 1000 - (instr(n, 'bol') - 1) ELSE 0 END AS score FROM n)
SELECT n AS name, score, row_number() OVER (ORDER BY score DESC, length(n), n) AS rank FROM h WHERE score > 0 ORDER BY rank LIMIT 30""")
def narrowed_search(spark, d):
    """A longer query searches only what a shorter one found, and finds the same."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    out = search.narrowed(search.hits(names, "bo", separator=" "), "bol", 30, ident="name", separator=" ")
    return out.select("name", F.col("score").cast("int").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH n AS (SELECT DISTINCT p_name AS n FROM part), q AS (SELECT p_partkey AS query_id, lower(trim(substr(p_name, CAST(p_partkey % 5 + 1 AS INT), CAST(2 + p_partkey % 6 AS INT)))) AS q FROM part),
h AS (SELECT query_id, n, CASE WHEN starts_with(regexp_extract(lower(n), '[^ ]*$'), q) THEN 3000 - length(regexp_extract(lower(n), '[^ ]*$')) WHEN starts_with(lower(n), q) THEN 2000 - length(n) WHEN instr(lower(n), q) > 1 THEN 1000 - (instr(lower(n), q) - 1) ELSE 0 END AS score FROM q JOIN n ON length(q) >= 2 AND contains(lower(n), q)),
r AS (SELECT query_id, n, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(n), n) AS rank FROM h WHERE score > 0)
SELECT query_id, CAST(rank AS INT) AS rank, CAST(score AS INT) AS score, n AS name FROM r WHERE rank <= 10""")
def many_searches(spark, d):
    """A query from each part's name against all names, at once."""
    part = table(spark, d, "part")
    asked = part.select(F.col("p_partkey").alias("query_id"), F.substring("p_name", F.col("p_partkey") % 5 + 1, 2 + F.col("p_partkey") % 6).alias("query"))
    names = part.select(F.col("p_name").alias("name")).distinct().withColumn("id", F.col("name"))
    return search.search_all(names, asked, 10, separator=" ").select("query_id", "rank", F.col("score").cast("int").alias("score"), "name")


@query(r"""SELECT page_id, CASE WHEN f <> '' THEN f ELSE replace(regexp_replace(regexp_replace(p, '#.*$', ''), '(^/+)|(\.html$)', '', 'g'), '/', '.') END AS suggestion FROM (SELECT page_id, p, regexp_extract(p, '#(.*)$', 1) AS f
FROM (SELECT page_id, regexp_replace(url, '^[a-z]+:/', '') || CASE WHEN page_id % 3 = 0 THEN '.html' ELSE '' END AS p FROM pages))""".replace("\\\\", "\\"))
def page_suggestions(spark, d):
    path = F.concat(F.regexp_replace("url", "^[a-z]+:/", ""), F.when(F.col("page_id") % 3 == 0, ".html").otherwise(""))
    return table(spark, d, "pages").select("page_id", search.suggestion(path).alias("suggestion"))


@query("SELECT row_number() OVER (ORDER BY n) - 1 AS id, n AS name FROM (SELECT DISTINCT url AS n FROM pages)")
def decoded_names(spark, d):
    out = search.front_decoded(search.front_coded(table(spark, d, "pages"), "url"))
    return out.select(F.col("id").cast("long").alias("id"), "name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size = 3)")
def found_names(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return search.find_names(part.select("p_partkey", "p_name"), part.where("p_size = 3"), "p_name")


# ---- snapshots


@query("""SELECT o_custkey AS module, sha256(string_agg(o_orderkey || ' ' || o_orderstatus, chr(10) ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR))) AS hash, count(*) AS files, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END) AS BIGINT) AS bytes FROM orders GROUP BY 1""")
def ledger_entries(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("module"), F.col("o_orderdate").alias("ord"), F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(F.col("o_orderkey")).cast("long").alias("bytes"), F.col("o_orderstatus").alias("hash"))
    entries = snapshot.ledger(rows.select("module"), rows)
    size = F.aggregate("files", F.lit(0).cast("long"), lambda n, f: n + F.greatest(f["bytes"], F.lit(0)))
    return entries.select("module", "hash", F.size("files").cast("long").alias("files"), size.alias("bytes"))


@query("SELECT count(DISTINCT o_custkey) AS modules, count(*) AS files, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END) AS BIGINT) AS bytes FROM orders")
def ledger_totals(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("module"), F.col("o_orderdate").alias("ord"), F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(F.col("o_orderkey")).cast("long").alias("bytes"), F.col("o_orderstatus").alias("hash"))
    return snapshot.ledger_totals(snapshot.ledger(rows.select("module"), rows))


@query("""SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'extract' ELSE 'render' END AS scope, n_name AS key FROM nation WHERE n_nationkey % 7 = 0 OR n_nationkey % 5 = 0""")
def moved_keys(spark, d):
    rows = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "extract").otherwise("render").alias("scope"), F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"), "n_nationkey")
    after = rows.where("n_nationkey % 5 <> 0").withColumn("value", F.when(F.col("n_nationkey") % 7 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    return snapshot.moved_keys(rows, after)


_STATES = "(SELECT c_custkey AS k, (['same', 'changed', 'added', 'removed'])[c_custkey % 4 + 1] AS state FROM customer)"


def _states(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.get(F.array(*[F.lit(x) for x in ("same", "changed", "added", "removed")]), (F.col("c_custkey") % 4).cast("int")).alias("state"))


@query(f"SELECT 'extract' AS moved, k FROM {_STATES} WHERE state <> 'removed' UNION ALL SELECT 'render', k FROM {_STATES} WHERE state IN ('changed', 'added')")
def stale_by_keys(spark, d):
    """A moved extract key makes all present modules stale, a moved render key none."""
    out = None
    for scope in ("extract", "render"):
        moved = spark.createDataFrame([(scope, "k")], "scope string, key string")
        part = snapshot.stale_by_keys(_states(spark, d), "k", moved).select(F.lit(scope).alias("moved"), "k")
        out = part if out is None else out.unionAll(part)
    return out


@query(f"SELECT k % 10 AS g, sha256(string_agg(state || ' ' || k || ' -', chr(10) ORDER BY state, k)) AS digest, count(*) AS changes FROM {_STATES} WHERE state <> 'same' GROUP BY 1")
def watch_digests(spark, d):
    rows = _states(spark, d).withColumn("g", F.col("k") % 10).withColumn("hash", F.lit(None).cast("string"))
    return snapshot.change_digest(rows, "k", ["g"])


@query("SELECT 'all' AS choice, c_custkey AS k FROM customer UNION ALL SELECT 'some', c_custkey FROM customer WHERE c_custkey % 6 = 0")
def rendered_subset(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    some, none = rows.where("k % 6 = 0"), rows.limit(0)
    out = snapshot.render_subset(rows, None, "k").select(F.lit("all").alias("choice"), "k")
    for name, chosen in (("some", some), ("none", none)):
        out = out.unionAll(snapshot.render_subset(rows, chosen, "k").select(F.lit(name).alias("choice"), "k"))
    return out


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey = 7 THEN '' ELSE o_orderstatus END AS hash FROM orders")
def touched(spark, d):
    return snapshot.touch(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("hash")), "k", "hash", 7)


@query("SELECT o_orderkey AS k, 'merged' AS side FROM orders WHERE o_orderkey % 9 = 0 AND o_orderkey % 8 <> 0 UNION ALL SELECT o_orderkey, 'listed' FROM orders WHERE o_orderkey % 8 = 0 AND o_orderkey % 9 <> 0")
def merge_order(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return snapshot.order_mismatch(rows.where("k % 9 <> 0"), rows.where("k % 8 <> 0"), "k")


@query("""WITH RECURSIVE s AS (SELECT n_nationkey AS k, 0 AS round FROM nation WHERE n_nationkey % 9 = 1 UNION ALL SELECT k * 2 + 1, round + 1 FROM s WHERE k * 2 + 1 < 25) SELECT k, CAST(min(round) AS INT) AS round FROM s GROUP BY 1""")
def stale_rounds(spark, d):
    """Work that a round makes stale is done in the next, until a round makes none."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))

    def step(state):
        done, todo, n = state
        done = todo.withColumn("round", F.lit(n)) if done is None else done.unionByName(todo.withColumn("round", F.lit(n)))
        more = nation.join(todo.select((F.col("k") * 2 + 1).alias("k")), "k", "left_semi").join(done.select("k"), "k", "left_anti")
        return (done, more, n + 1), not more.isEmpty()

    return snapshot.until_stable(step, (None, nation.where("k % 9 = 1"), 0))[0]


@query("SELECT o_custkey AS module, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice, o_orderkey) AS nth FROM orders")
def page_items(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("module"), "o_orderkey", F.col("o_orderdate").alias("line"), F.col("o_totalprice").alias("col"), F.col("o_orderkey").alias("seq"))
    nth = F.row_number().over(Window.partitionBy("module").orderBy(*index.page_order(rows)))
    return rows.select("module", "o_orderkey", nth.cast("long").alias("nth"))


@query("SELECT l_partkey AS target, CAST(l_orderkey AS BIGINT) AS user FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25))")
def used_by_rows(spark, d):
    refs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("user"))
    return index.used_by_rows(refs, table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("target")), "target", "user")


@query("""WITH w AS (SELECT DISTINCT o_custkey % 50 AS page, 'x.p' || o_orderkey % 97 AS name FROM orders), d AS (SELECT DISTINCT o_custkey % 50 AS page, 'A.x.p' || o_orderkey % 97 AS m FROM orders WHERE o_orderkey % 5 = 0)
SELECT w.page, w.name, CASE WHEN nr % 4 = 0 THEN 'Home' WHEN nr % 4 = 1 THEN w.name ELSE CAST(w.page AS VARCHAR) END AS module, CASE WHEN nr % 4 = 0 THEN w.name WHEN nr % 4 = 1 THEN NULL ELSE m END AS anchor
FROM (SELECT *, CAST(substr(name, 4) AS INT) AS nr FROM w) w LEFT JOIN d ON d.page = w.page AND d.m = 'A.' || w.name WHERE nr % 4 < 2 OR m IS NOT NULL""")
def docstring_name_links(spark, d):
    orders = table(spark, d, "orders").select((F.col("o_custkey") % 50).cast("string").alias("page"), (F.col("o_orderkey") % 97).alias("nr"), "o_orderkey")
    wanted = orders.select("page", F.concat(F.lit("x.p"), "nr").alias("name"), "nr")
    known = wanted.where("nr % 4 = 0").select("name", F.lit("Home").alias("module")).distinct()
    declared = orders.where("o_orderkey % 5 = 0").select("page", F.concat(F.lit("A.x.p"), "nr").alias("name"), F.col("nr").alias("ord")).distinct()
    out = links.docstring_links(wanted, known, wanted.where("nr % 4 = 1").select(F.col("name").alias("module")), declared)
    return out.withColumn("page", F.col("page").cast("long"))
