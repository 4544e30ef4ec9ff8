"""Queries that write files of the formats below the shared folder and read them back, with the SQL over the tables they came from."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from fathom.operators import render, search, snapshot, stats
from fathom.operators.order import scratch
from fathom.plans.catalog import query, table
from fathom.sources import ir, serve, sinks


def _modules(spark, d):
    """A module for each nation: its customers are declarations that refer to another nation's module."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    ref = F.array(F.concat(F.lit("Pkg.N"), F.col("n_regionkey")), F.concat(F.lit("r"), F.col("c_custkey") % 10))
    member = F.struct(F.lit("field").alias("label"), F.concat("c_name", F.lit(".x")).alias("name"), F.lit(True).alias("isDirect"))
    decl = F.struct(F.col("c_name").alias("name"), F.lit("definition").alias("kind"), F.col("c_custkey").alias("line"), F.lit(0).alias("col"), F.array(ref).alias("refs"), F.array("c_mktsegment").alias("attrs"), F.array(member).alias("members"))
    body = rows.groupBy(F.concat(F.lit("Pkg.N"), "n_nationkey").alias("module"), F.col("n_regionkey")).agg(F.array_sort(F.collect_list(decl)).alias("declarations"))
    text = F.to_json(F.struct(F.lit(5).alias("schemaVersion"), "module", F.array(F.concat(F.lit("Pkg.N"), "n_regionkey")).alias("imports"), "declarations"))
    return body.select("module", text.alias("body"))


def _tree(spark, d):
    root = scratch(spark)
    deps = table(spark, d, "part").select(F.col("p_brand").alias("package"), F.col("p_name").alias("name"), F.col("p_type").alias("module"))
    deps = deps.groupBy("package", "name").agg(F.min("module").alias("module"))
    sinks.write_tree(_modules(spark, d), root, deps, facts={"generator": "g"})
    return root


@query("""SELECT 'Pkg.N' || c_nationkey AS module, count(*) AS declarations, 5 AS version, (SELECT count(DISTINCT c_nationkey) FROM customer) AS modules, true AS hashed FROM customer GROUP BY c_nationkey""")
def tree_index(spark, d):
    """The index of a written tree: counts, and hashes and sizes that are those of the files."""
    root = _tree(spark, d)
    entries = ir.entries(ir.open_tree(spark, root)).crossJoin(ir.open_unvalidated(spark, root).select("schemaVersion", "moduleCount"))  # one row on the right
    files = ir.fingerprints(spark, f"{root}/modules").select(F.concat(F.lit("modules/"), F.substring_index("path", "/", -1)).alias("file"), F.col("bytes").alias("_bytes"), "hash")
    rows = entries.join(files, "file")
    return rows.select("module", "declarations", F.col("schemaVersion").alias("version"), F.col("moduleCount").alias("modules"), ((F.col("contentHash") == F.col("hash")) & (F.col("bytes") == F.col("_bytes"))).alias("hashed"))


@query("""SELECT 'Pkg.N' || c_nationkey AS user_module, c_name AS user, 'Pkg.N' || n_regionkey AS module, 'r' || c_custkey % 10 AS name, c_mktsegment AS attribute, c_name || '.x' AS member FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def tree_references(spark, d):
    """References, attributes and members of all modules of a written tree."""
    decls = ir.declarations(ir.modules(spark, _tree(spark, d)))
    rest = decls.select(F.col("module").alias("user_module"), F.col("name").alias("user"), F.get(ir.attributes(F.col("attrs")), F.lit(0))[0].alias("attribute"), F.col("members")[0]["name"].alias("member"))
    return ir.references(decls).join(rest, ["user_module", "user"])


@query("SELECT p_brand AS package, p_name AS name, min(p_type) AS module FROM part GROUP BY 1, 2")
def tree_dependencies(spark, d):
    return ir.dependency_maps(spark, _tree(spark, d))


@query("""SELECT 'D' || p_partkey AS name, 'M' || p_size AS module, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS line_from, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 5 END AS line_to FROM part WHERE p_size <> 7
UNION ALL SELECT NULL, 'M' || p_size, NULL, NULL FROM (SELECT DISTINCT p_size FROM part WHERE p_size <> 7) UNION ALL SELECT NULL, 'E' || n_nationkey, NULL, NULL FROM nation""")
def link_map_files(spark, d):
    """A written link map, without one module, read again: entries with their lines, and known modules."""
    part = table(spark, d, "part")
    entries = part.select(F.concat(F.lit("M"), "p_size").alias("module"), F.concat(F.lit("D"), "p_partkey").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("line_from"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey") + 5).alias("line_to"))
    modules = entries.select("module").unionAll(table(spark, d, "nation").select(F.concat(F.lit("E"), "n_nationkey"))).distinct()
    path = f"{scratch(spark)}/a.lidx"
    sinks.write_link_map(entries, modules, path, modules.where("module = 'M7'"))
    rows, known = ir.link_map(spark, path)
    none = lambda t: F.lit(None).cast(t)
    return rows.select("name", "module", "line_from", "line_to").unionByName(known.select(none("string").alias("name"), "module", none("long").alias("line_from"), none("long").alias("line_to")))


@query("SELECT DISTINCT p_type AS module FROM part WHERE p_type NOT LIKE '#%'")
def module_lists(spark, d):
    """A set as a file of sorted lines, read again as a list of modules; an empty set is an empty file."""
    root = scratch(spark)
    rows = table(spark, d, "part").select("p_type").unionAll(spark.sql("select '# a note' union all select '  '"))
    sinks.write_lines(rows, "p_type", f"{root}/modules.txt")
    sinks.write_lines(rows.limit(0), "p_type", f"{root}/none.txt")
    return ir.module_list(spark, f"{root}/modules.txt").unionAll(ir.module_list(spark, f"{root}/none.txt"))


@query("SELECT 'S.N' || n_nationkey AS module, 'A' || n_regionkey AS import, length(n_name) + 93 AS bytes, sha256('import A' || n_regionkey || chr(10) || '-- ' || n_name || chr(10) || 'def x' || chr(10) || 'import B' || repeat(' ', 66 - length(CAST(n_regionkey AS VARCHAR)))) AS hash FROM nation")
def source_scans(spark, d):
    """Source files below a folder: their modules, the imports before the first other line, and their fingerprints."""
    root = scratch(spark)
    line = F.concat(F.lit("import A"), "n_regionkey", F.lit("\n-- "), "n_name", F.lit("\ndef x\nimport B"), F.repeat(F.lit(" "), 66 - F.length(F.col("n_regionkey").cast("string"))))
    files = table(spark, d, "nation").select(F.concat(F.lit("S/N"), "n_nationkey", F.lit(".lean")).alias("path"), line.alias("body"))
    sinks.write_files(files, root)
    texts = files.select(F.regexp_replace(F.replace("path", F.lit("/"), F.lit(".")), r"\.lean$", "").alias("module"), "body")
    hashes = ir.fingerprints(spark, root, "*.lean").select(F.replace(F.regexp_extract("path", r"(S/N[0-9]+)\.lean$", 1), F.lit("/"), F.lit(".")).alias("module"), F.col("bytes"), "hash")
    return ir.source_modules(spark, root).join(ir.imports(texts, "module", "body"), "module").join(hashes, "module").select("module", "import", F.col("bytes").cast("long").alias("bytes"), "hash")


@query("SELECT event_type AS phase, user_id AS pid, CAST(event_id AS BIGINT) AS us, 'M' || user_id AS module, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def run_logs(spark, d):
    root = scratch(spark)
    rows = table(spark, d, "events").select(F.col("event_type").alias("phase"), F.col("user_id").alias("pid"), F.col("event_id").alias("us"), F.concat(F.lit("M"), "user_id").alias("module"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.lit("text").alias("note"))
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{root}/log")
    log = ir.run_log(spark, f"{root}/log")
    return log.where("size(counters) = 1").select("phase", "pid", "us", "module", F.col("counters")["k"].alias("k"))


@query("""SELECT string_agg(phase || '=' || us, ',' ORDER BY phase) AS phases, (SELECT CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS DOUBLE) FROM events) AS k FROM (SELECT event_type AS phase, CAST(sum(event_id) AS BIGINT) AS us FROM events GROUP BY 1)""")
def folded_timings(spark, d):
    out = ir.folded_timings(run_logs(spark, d).withColumn("counters", F.create_map(F.lit("k"), "k")))
    entries = F.transform(F.map_entries("phases"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select(F.array_join(entries, ",").alias("phases"), F.col("counters")["k"].alias("k"))


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer")
def state_caches(spark, d):
    """A cache is used under its own version and dropped whole under any other."""
    root = scratch(spark)
    table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit("7").alias("version")).write.parquet(f"{root}/state")
    return ir.cached_state(spark, f"{root}/state", {"version": "7"}).unionAll(ir.cached_state(spark, f"{root}/state", {"version": "8"})).select("k", "v")


@query("""SELECT 'declaration' AS section, 'P' || p_partkey AS name, 'T/' || p_type || '.html' AS link FROM part WHERE p_size < 20 UNION ALL SELECT 'module', 'N' || n_nationkey || '.A', 'u' || n_nationkey FROM nation WHERE n_nationkey IN (3, 4)""")
def external_tables(spark, d):
    """Wanted declarations and modules of a dependency's table of declarations."""
    part = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("k"), F.struct(F.lit("def").alias("kind"), F.concat(F.lit("T/"), "p_type", F.lit(".html")).alias("docLink")).alias("v"), "p_size")
    nation = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey", F.lit(".A")).alias("k"), F.struct(F.array().cast("array<string>").alias("importedBy"), F.concat(F.lit("u"), "n_nationkey").alias("url")).alias("v"))
    whole = part.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("declarations")).crossJoin(nation.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("modules")))  # one row each
    root = scratch(spark)
    sinks.write_files(whole.select(F.lit("d.json").alias("path"), F.to_json(F.struct("*")).alias("body")), root)
    decls, mods = ir.external_table(spark, f"{root}/d.json", part.where("p_size < 20").select(F.col("k").alias("name")), ["N3", "N4"])
    return decls.select(F.lit("declaration").alias("section"), "name", F.col("docLink").alias("link")).unionAll(mods.select(F.lit("module"), "module", "url"))


@query("SELECT 'library' AS kind, 'Lib' AS name, NULL AS value UNION ALL SELECT 'package', 'p', repeat('a', 40) UNION ALL SELECT 'package', 'q', NULL UNION ALL SELECT 'config', 'title', 'T' UNION ALL SELECT 'marker', 'complete', 'true'")
def configurations(spark, d):
    """Build file, manifest, site configuration and the marker of a run."""
    root = Path(scratch(spark))
    sinks.write_assets({"build.toml": b'[[lean_lib]]\nname = "Lib"\n', "manifest.json": json.dumps({"packages": [{"name": "p", "url": "u", "rev": "a" * 40}, {"name": "q", "rev": "main"}]}).encode(), "site.toml": b'title = "T"\n'}, str(root))
    sinks.write_marker(str(root / "marker.json"), {"complete": True})
    rows = [("library", x, None) for x in ir.libraries(str(root / "build.toml"))] + [("package", p["name"], p["rev"]) for p in ir.manifest(str(root / "manifest.json"))]
    rows += [("config", k, v) for k, v in ir.site_config(str(root / "site.toml")).items()] + [("marker", k, json.dumps(v)) for k, v in json.loads((root / "marker.json").read_text()).items()]
    return spark.createDataFrame(rows, "kind string, name string, value string")


@query("SELECT o_custkey AS module, sha256(string_agg(o_orderkey || ' ' || o_orderstatus, chr(10) ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR))) AS hash, count(*) AS files, 'extract:a=1,render:b=2' AS keys FROM orders WHERE o_custkey % 10 = 1 GROUP BY 1")
def ledger_files(spark, d):
    rows = table(spark, d, "orders").where("o_custkey % 10 = 1").select(F.col("o_custkey").cast("string").alias("module"), F.col("o_orderdate").alias("ord"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").cast("long").alias("bytes"), F.col("o_orderstatus").alias("hash"))
    path = f"{scratch(spark)}/ledger.json"
    sinks.write_ledger(snapshot.ledger(rows.select("module"), rows), path, {"ledgerSchema": 2, "algorithm": "sha256", "target": "t", "libDir": "l"}, {"a": "1"}, {"b": "2"})
    entries, keys = sinks.read_ledger(spark, path)
    said = keys.agg(F.array_join(F.array_sort(F.collect_list(F.concat("scope", F.lit(":"), "key", F.lit("="), "value"))), ",").alias("keys"))
    return entries.crossJoin(said).select(F.col("module").cast("long").alias("module"), "hash", F.size("files").cast("long").alias("files"), "keys")  # one row on the right


@query("SELECT 'N' || n_nationkey AS root, 'https://' || n_name AS base, count(c_custkey) AS requested, count(c_custkey) FILTER (c_custkey % 2 = 0) AS declarations, min(CASE WHEN c_custkey % 2 = 0 THEN c_name || '.html' END) AS link FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def docs_map_files(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    n = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("requestedNames"))
    sites = nation.join(n, "n_nationkey", "left").select(F.concat(F.lit("N"), "n_nationkey").alias("root"), F.concat(F.lit("https://"), "n_name").alias("base"), F.coalesce("requestedNames", F.lit(0)).cast("long").alias("requestedNames"))
    links_ = customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("N"), "c_nationkey").alias("root"), F.col("c_name").alias("name"), F.concat("c_name", F.lit(".html")).alias("link"))
    path = f"{scratch(spark)}/map.json"
    sinks.write_docs_map(sites, links_, links_.where("name = ''"), path, "fathom")
    roots, decls, mods = sinks.read_docs_map(spark, path)
    per = decls.unionAll(mods).groupBy("root").agg(F.count("*").alias("declarations"), F.min("link").alias("link"))
    return roots.join(per, "root", "left").select("root", "base", F.col("requestedNames").alias("requested"), F.coalesce("declarations", F.lit(0)).alias("declarations"), "link")


@query("SELECT row_number() OVER (ORDER BY n) - 1 AS id, n AS name, k AS kind, CAST(m AS BIGINT) AS module_id, lower(n) AS folded FROM (SELECT 'Pkg.' || replace(p_name, ' ', '.') || '.É' || p_partkey AS n, 'k' || p_size % 3 AS k, p_size AS m FROM part)")
def search_index_files(spark, d):
    """The binary search index of all names, decoded again with its folded names."""
    rows = table(spark, d, "part").select(F.concat(F.lit("Pkg."), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".É"), "p_partkey").alias("name"), F.concat(F.lit("k"), F.col("p_size") % 3).alias("kind"), F.col("p_size").alias("module_id"))
    coded = search.front_coded(rows, "name").select("id", "name").join(rows, "name")
    path = f"{scratch(spark)}/search-index.bin"
    sinks.write_search_index(coded, ["k0", "k1", "k2"], path)
    return spark.createDataFrame(sinks.read_search_index(path), "id long, name string, kind string, module_id long, folded string")


@query("SELECT c_custkey AS k, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def site_artifacts(spark, d):
    """The nine files of a site; the name map is read back."""
    root = scratch(spark)
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.col("n_name").alias("name"))
    found = {path: b"x" for path in sinks.ARTIFACTS} | {"declarations/name-map.json": (rows, ["name", "k"])}
    sinks.write_artifacts(found, root)
    return spark.read.schema("k long, name string").json(f"{root}/{sinks.ARTIFACTS[0]}", multiLine=True)


@query("SELECT 'kept' AS state, 'p' || n_nationkey || '/N.html' AS page FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 'served', 'p1/N.html:<p>NATION_1</p>' UNION ALL SELECT 'missing', '404'")
def written_pages(spark, d):
    """Pages are written by tasks, orphans pruned, and the rest served; a page that was pruned isn't found."""
    import urllib.error
    import urllib.request

    root = scratch(spark)
    rows = table(spark, d, "nation").select(F.concat(F.lit("p"), "n_nationkey", F.lit("/N.html")).alias("path"), F.concat(F.lit("<p>"), "n_name", F.lit("</p>")).alias("html"), "n_nationkey")
    render.write_pages(rows, root)
    gone = snapshot.orphans(rows, rows.where("n_nationkey % 3 <> 0"), "path")
    render.prune_pages(root, gone)
    out = [("kept", str(p.relative_to(root))) for p in sorted(Path(root).rglob("*.html"))]
    with serve.serving(root) as base:
        ir.download(f"{base}/p1/N.html", f"{root}/copy/x")
        out.append(("served", f"p1/N.html:{Path(root, 'copy/x').read_text()}"))
        try:
            urllib.request.urlopen(f"{base}/p3/N.html")
        except urllib.error.HTTPError as e:
            out.append(("missing", str(e.code)))
    return spark.createDataFrame(out, "state string, page string")


# ---- rendering


@query("""SELECT p_partkey AS k, '<p>' || p_name || ' &lt; <em>' || p_type || '</em> and <code>' || p_brand || '</code></p><ul><li>a</li><li><strong>b</strong></li></ul>' AS html, 0 AS failures FROM part""")
def docstring_pages(spark, d):
    text = F.concat("p_name", F.lit(" < *"), "p_type", F.lit("* and `"), "p_brand", F.lit("`\n\n- a\n- **b**\n"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), render.docstrings(text, F.create_map().cast("map<string,string>"), F.lit("./")).alias("r"))
    return rows.select("k", "r.html", "r.failures")


@query("""SELECT p_partkey AS k, '<span class="fn">f <a href="' || 'N' || p_size || '.html">x' || p_size || '</a></span>' AS html, true AS linked FROM part""")
def code_fragments(spark, d):
    name = F.concat(F.lit("x"), "p_size")
    n = F.length(name)
    span = lambda a, b, kind, c: F.struct(F.lit(a).alias("start"), b.alias("stop"), F.lit(kind).alias("kind"), c.alias("name"), F.lit(0).alias("front"), F.lit(0).alias("back"))
    spans = F.array(span(0, n + 2, 0, F.lit(None).cast("string")), span(2, n + 2, 1, name))
    known = F.create_map(name, F.concat(F.lit("N"), "p_size", F.lit(".html")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), render.fragments(F.concat(F.lit("f "), name), spans, known, F.lit("./")).alias("r"))
    return rows.select("k", "r.html", "r.linked")


@query("SELECT s.k, s.n, s.shown FROM (SELECT o_custkey % 40 AS k, count(*) AS n, string_agg(CASE WHEN r <= 3 THEN CAST(o_orderkey AS VARCHAR) END, ',' ORDER BY o_orderkey) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1) s")
def capped_witnesses(spark, d):
    """All of a group are counted, the first few shown."""
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("k"), "o_orderkey")
    shown = stats.capped(rows, ["k"], ["o_orderkey"], 3).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("shown"))
    return rows.groupBy("k").agg(F.count("*").alias("n")).join(shown, "k")
