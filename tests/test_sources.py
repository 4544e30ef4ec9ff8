import hashlib
import json
import random
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from fathom.operators import order, search, snapshot
from fathom.sources import ir, serve, sinks


def declaration(name, **more):
    return {"name": name, "kind": "definition", "line": 1, "col": 0, "index": 0, "refs": [], "attrs": [], **more}


def write(root, mods, **index):
    (root / "modules").mkdir(parents=True)
    (root / "deps").mkdir()
    listed = []
    for m, body in mods.items():
        text = json.dumps({"schemaVersion": 5, "module": m, "imports": [], "moduleDocs": [], "tactics": [], "declarations": [], **body})
        (root / "modules" / f"{m}.json").write_text(text)
        listed.append({"module": m, "file": f"modules/{m}.json", "bytes": len(text), "declarations": 0, "contentHash": m})
    (root / "deps" / "Dep.json").write_text(json.dumps({"schemaVersion": 5, "package": "Dep", "declarations": {"Dep.f": "Dep.Home"}}))
    (root / "index.json").write_text(json.dumps({"schemaVersion": 5, "moduleCount": len(mods), "modules": listed, "dependencyMaps": [], **index}))
    return str(root)


def test_tree(spark, tmp_path):
    decl = declaration("A.f", refs=[["Dep.Home", "Dep.f"]], attrs=["simp", ["deprecated", "2024"]], typeCode=[[0, 4, 1, "Nat"], [5, 6, 0], [7, 9, 1, "Int", 1, 0]])
    root = write(tmp_path / "t", {"A": {"declarations": [decl]}, "B": {}})
    mods = ir.modules(spark, root)
    assert sorted(r.module for r in mods.collect()) == ["A", "B"]
    decls = ir.declarations(mods)
    assert [tuple(r) for r in ir.references(decls).collect()] == [("A", "A.f", "Dep.Home", "Dep.f")]
    assert decls.select(ir.attributes(F.col("attrs"))).first()[0] == [["simp"], ["deprecated", "2024"]]
    spans = decls.select(ir.spans(F.col("typeCode"))).first()[0]
    assert (spans[0].kind, spans[0].name, spans[1].name, spans[2].front) == (1, "Nat", None, 1)
    assert [tuple(r) for r in ir.dependency_maps(spark, root).collect()] == [("Dep", "Dep.f", "Dep.Home")]


@pytest.mark.parametrize(("mods", "index", "why"), [({"A": {"surprise": 1}}, {}, "unknown keys"), ({"A": {"module": "Z"}}, {}, "holds"), ({"A": {}}, {"schemaVersion": 4}, "schema version"), ({"A": {}}, {"ablations": ["refs"]}, "left out")])
def test_refusals(spark, tmp_path, mods, index, why):
    root = write(tmp_path / "t", mods, **index)
    with pytest.raises(Exception, match=why):
        rows = ir.modules(spark, root).collect() if "schemaVersion" not in index and "ablations" not in index else ir.open_tree(spark, root).collect()
        assert rows
    assert ir.open_unvalidated(spark, root).count() == 1


def test_link_map(spark, tmp_path):
    (tmp_path / "a.lidx").write_text("# note\n@Empty\nMod.A\n\tMod.A.f\t3\t9\n\tMod.A.g\n@Other\n\tMod.A.h\nMod.B\n\tMod.A.g\t1\t2\n")
    entries, modules = ir.link_map(spark, str(tmp_path / "a.lidx"))
    assert {r.name: (r.module, r.line_from, r.line_to) for r in entries.collect()} == {"Mod.A.f": ("Mod.A", 3, 9), "Mod.A.g": ("Mod.B", 1, 2), "Mod.A.h": ("Mod.A", None, None)}
    assert sorted(r.module for r in modules.collect()) == ["Empty", "Mod.A", "Mod.B", "Other"]
    sinks.write_link_map(entries, modules, str(tmp_path / "b.lidx"))
    again, known = ir.link_map(spark, str(tmp_path / "b.lidx"))
    assert again.exceptAll(entries).isEmpty() and entries.exceptAll(again).isEmpty() and known.exceptAll(modules).isEmpty()


def test_texts(spark, tmp_path):
    (tmp_path / "list").write_text("A\n\n# no\n B \n")
    assert [r.module for r in ir.module_list(spark, str(tmp_path / "list")).collect()] == ["A", "B"]
    (tmp_path / "src" / "A").mkdir(parents=True)
    (tmp_path / "src" / "A" / "B.lean").write_text("x")
    (tmp_path / "src" / "A.lean").write_text("y")
    assert [r.module for r in ir.source_modules(spark, str(tmp_path / "src")).collect()] == ["A", "A.B"]
    assert ir.fingerprints(spark, str(tmp_path / "src"), "*.lean").count() == 2
    texts = spark.createDataFrame([("M", "/- import No -/\nimport A.B\nimport C -- why\n\ndef x := 1\nimport Late\n")], "module string, text string")
    assert [r[1] for r in ir.imports(texts, "module", "text").collect()] == ["A.B", "C"]
    (tmp_path / "log").write_text('{"phase":"a","pid":1,"us":5,"n":2}\n{"phase":"a","pid":1,"us":7,"n":3,"s":"x"}\n')
    log = ir.run_log(spark, str(tmp_path / "log"))
    row = ir.folded_timings(log).first()
    assert row.phases == {"a": 12} and row.counters == {"n": 5.0}


def test_configuration(tmp_path):
    (tmp_path / "lakefile.toml").write_text('[[lean_lib]]\nname = "Pkg"\n[[lean_lib]]\nname = "Extra"\n')
    assert ir.libraries(str(tmp_path / "lakefile.toml")) == ["Pkg", "Extra"]
    with pytest.raises(ValueError):
        ir.libraries("lakefile.lean")
    (tmp_path / "m.json").write_text(json.dumps({"packages": [{"name": "d", "url": "u", "rev": "a" * 40}, {"name": "e", "url": "u", "rev": "main"}]}))
    assert [p["rev"] for p in ir.manifest(str(tmp_path / "m.json"))] == ["a" * 40, None]
    (tmp_path / "c.toml").write_text('title = "T"\nother = 1\n')
    with pytest.raises(ValueError):
        ir.site_config(str(tmp_path / "c.toml"))
    assert ir.site_config(str(tmp_path / "none.toml")) == {}


def test_external_table(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"declarations": {"A.f": {"kind": "def", "docLink": "x"}, "B.g": {"kind": "def", "docLink": "y"}}, "modules": {"A.M": {"importedBy": [], "url": "u"}, "C": {"importedBy": [], "url": "v"}}}))
    decls, mods = ir.external_table(spark, str(tmp_path / "d.json"), spark.createDataFrame([("A.f",)], "name string"), ["A"])
    assert [r.name for r in decls.collect()] == ["A.f"] and [r.module for r in mods.collect()] == ["A.M"]
    (tmp_path / "e.json").write_text(json.dumps({"modules": {}}))
    with pytest.raises(ValueError):
        ir.external_table(spark, str(tmp_path / "e.json"), decls, ["A"])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "x string")
    assert sinks.write_lines(rows, "x", str(tmp_path / "o" / "l")) == 2 and (tmp_path / "o" / "l").read_text() == "a\nb\n"
    assert sinks.write_lines(rows.limit(0), "x", str(tmp_path / "e")) == 0 and (tmp_path / "e").read_text() == ""
    sinks.write_artifact(rows.dropna().distinct(), str(tmp_path / "a.json"), ["x"])
    assert json.loads((tmp_path / "a.json").read_text()) == [{"x": "a"}, {"x": "b"}]
    names = spark.createDataFrame([(f"Pkg.n{i:03}", "def" if i % 2 else "theorem") for i in range(40)] + [("Pkg.\U0001d49c" + "x" * 400, "def")], "name string, kind string")
    coded = search.front_coded(names, "name").join(names, "name").withColumn("module_id", F.lit(3))
    assert sinks.write_search_index(coded, ["def", "theorem"], str(tmp_path / "i.bin")) == 41
    assert sorted((n, k, m) for _, n, k, m, _ in sinks.read_search_index(str(tmp_path / "i.bin"))) == sorted((r.name, r.kind, 3) for r in names.collect())
    n = sinks.write_tree(spark.createDataFrame([("A", json.dumps({"schemaVersion": 5, "module": "A", "declarations": []}))], "module string, body string"), str(tmp_path / "tree"))
    assert n == 1 and [r.module for r in ir.modules(spark, str(tmp_path / "tree")).collect()] == ["A"]


def test_tree_has_hashes_and_dependency_maps(spark, tmp_path):
    bodies = [(m, json.dumps({"schemaVersion": 5, "module": m, "declarations": [{"name": f"{m}.f", "members": [{"name": "x"}]}] * n})) for m, n in (("A", 1), ("B.C", 2))]
    deps = spark.createDataFrame([("Dep", "Dep.f", "Dep.M"), ("Dep", "Dep.g", "Dep.N"), ("Other", "o", "O")], "package string, name string, module string")
    root = str(tmp_path / "tree")
    assert sinks.write_tree(spark.createDataFrame(bodies, "module string, body string"), root, deps) == 2
    listed = {r.module: r for r in ir.entries(ir.open_tree(spark, root)).collect()}
    for m, body in bodies:
        assert listed[m].contentHash == hashlib.sha256(body.encode()).hexdigest() and listed[m].bytes == len(body) and listed[m].declarations == len(json.loads(body)["declarations"])
    assert sorted(tuple(r) for r in ir.dependency_maps(spark, root).collect()) == [("Dep", "Dep.f", "Dep.M"), ("Dep", "Dep.g", "Dep.N"), ("Other", "o", "O")]


@pytest.mark.parametrize("where", ["declaration", "member", "doc", "tactic", "index", "dependency"])
def test_unknown_keys_at_any_depth_are_refused(spark, tmp_path, where):
    odd = lambda which, **rest: rest | ({"odd": 1} if which == where else {})
    body = {"schemaVersion": 5, "module": "A", "moduleDocs": [odd("doc", line=1, col=0, text="t")], "tactics": [odd("tactic", userName="t")], "declarations": [{"name": "A.e"}, odd("declaration", name="A.f", members=[{"name": "x"}, odd("member", name="y")])]}
    (tmp_path / "modules").mkdir()
    (tmp_path / "modules" / "A.json").write_text(json.dumps(body))
    index = {"schemaVersion": 5, "modules": [odd("index", module="A", file="modules/A.json")], "dependencyMaps": [odd("dependency", package="P", file="deps/P.json")]}
    (tmp_path / "index.json").write_text(json.dumps(index))
    with pytest.raises(Exception, match="unknown keys.*odd"):
        ir.modules(spark, str(tmp_path)).collect()


def test_link_map_over_blocks(spark, tmp_path, monkeypatch):
    """Entries find the last header, however far before; entries before any header are dropped."""
    monkeypatch.setattr(ir, "BLOCK", 7)
    rng = random.Random(3)
    lines, head, want, listed = ["\tlost"], None, {}, set()
    for i in range(300):
        kind = rng.random()
        if kind < 0.06:
            head = f"M{i}"
            lines.append(head)
            listed.add(head)
        elif kind < 0.1:
            lines.append(rng.choice(["# note", "", f"@L{i}"]))
            listed |= {lines[-1][1:]} if lines[-1].startswith("@") else set()
        else:
            name = f"n{rng.randrange(150)}"
            lines.append(f"\t{name}\t{i}\t{i + 1}" if i % 3 else f"\t{name}")
            if head:
                want[name] = (head, i if i % 3 else None)
    (tmp_path / "a.lidx").write_text("\n".join(lines))
    rows, modules = ir.link_map(spark, str(tmp_path / "a.lidx"))
    assert {r.name: (r.module, r.line_from) for r in rows.collect()} == want and {r.module for r in modules.collect()} == listed


def test_ledger_docs_map_and_artifacts(spark, tmp_path):
    files = spark.createDataFrame([("B", 1, "b.x", 5, "h1"), ("A", 2, "a.y", -1, "h2"), ("A", 1, "a.x", 7, "h3")], "module string, ord int, path string, bytes long, hash string")
    listed = spark.createDataFrame([("A",), ("B",)], "module string")
    entries = snapshot.ledger(listed, files)
    assert tuple(snapshot.ledger_totals(entries).first()) == (2, 3, 12)
    path = str(tmp_path / "ledger.json")
    sinks.write_ledger(entries, path, {"ledgerSchema": 2, "algorithm": "sha256", "target": "t", "libDir": "l"}, {"k": "v"}, None)
    text = (tmp_path / "ledger.json").read_text()
    assert list(json.loads(text)) == ["ledgerSchema", "algorithm", "target", "libDir", "extractKey", "modules"] and text.endswith("]}\n") and ", " not in text
    back, keys = sinks.read_ledger(spark, path)
    digest = hashlib.sha256(b"a.x h3\na.y h2").hexdigest()
    assert {r.module: r.hash for r in back.collect()} == {r.module: r.hash for r in entries.collect()} and [tuple(r) for r in keys.collect()] == [("extract", "k", "v")]
    assert next(r.hash for r in back.collect() if r.module == "A") == digest
    with pytest.raises(Exception, match="no file of module C"):
        snapshot.ledger(listed.unionByName(spark.createDataFrame([("C",)], "module string")), files).collect()
    assert snapshot.ledger(spark.createDataFrame([("C",)], "module string"), files, strict=False).first().hash is None
    sites = spark.createDataFrame([("Dep", "https://d/", 2)], "root string, base string, requestedNames long")
    links = spark.createDataFrame([("Dep", "Dep.f", "Dep/M.html#Dep.f")], "root string, name string, link string")
    sinks.write_docs_map(sites, links, links.limit(0), str(tmp_path / "d.json"), "tool")
    got = sinks.read_docs_map(spark, str(tmp_path / "d.json"))
    assert [x.count() for x in got] == [1, 1, 0] and got[1].first().link == "Dep/M.html#Dep.f"
    with pytest.raises(ValueError):
        sinks.read_docs_map(spark, str(tmp_path / "d.json"), version=9)
    found = {x: b"x" for x in sinks.ARTIFACTS} | {"modules.json": (listed, ["module"])}
    assert sinks.write_artifacts(found, str(tmp_path / "site")) == list(sinks.ARTIFACTS) and len([x for x in (tmp_path / "site").rglob("*") if x.is_file()]) == 9
    with pytest.raises(ValueError):
        sinks.write_artifacts({"index.html": b""}, str(tmp_path / "site"))


def test_server_and_download(tmp_path):
    site = tmp_path / "site"
    (site / "A").mkdir(parents=True)
    (site / "A" / "B.html").write_text("page")
    (site / "404.html").write_text("none here")
    (tmp_path / "secret").write_text("no")
    with serve.serving(str(site)) as base:
        assert ir.download(f"{base}/A/B.html", str(tmp_path / "got" / "b")) == 4 and (tmp_path / "got" / "b").read_text() == "page"
        for path in ("/nothing.html", "/../secret", "/%2e%2e/secret", "/A/"):
            with pytest.raises(urllib.error.HTTPError) as error:
                urllib.request.urlopen(base + path)
            assert error.value.code == 404 and error.value.read() == b"none here"
    with pytest.raises(ValueError):
        ir.download("file:///etc/passwd", str(tmp_path / "x"))


def test_link_map_over_splits(spark, tmp_path):
    """A file of many splits: an entry takes the last header, however many splits before."""
    lines, want = [], {}
    for m in range(6):
        lines.append(f"M{m}")
        for i in range(3000 if m == 2 else 40):
            name = f"n{m}.{i}" if i % 7 else f"same{i}"
            lines.append(f"\t{name}\t{i}")
            want[name] = (f"M{m}", i)
        lines.append("# a comment" if m % 2 else f"@E{m}")
    (tmp_path / "a.lidx").write_text("\r\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows, modules = ir.link_map(spark, str(tmp_path / "a.lidx"))
        assert spark.read.text(str(tmp_path / "a.lidx")).rdd.getNumPartitions() > 10
        assert {r.name: (r.module, r.line_from) for r in rows.collect()} == want
        assert {r.module for r in modules.collect()} == {f"M{m}" for m in range(6)} | {"E0", "E2", "E4"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_page_parts(spark, tmp_path):
    html = """<!-- <a href="no"> --><SECTION Class='x decl' ID=a&lt;b><a title="it's > this" href='p.html#a'>t</a><a id=z>no link</a></section>
<script src="//h/x.js">'<p id="no">'</script><style><p id=no></style><img src=i.png alt=">"><link rel=x href="https://h/s.css"><section id="plain" class="declared"><p data-id="no" id="">"""
    (tmp_path / "d e").mkdir()
    (tmp_path / "d e" / "p.html").write_text(html)
    (tmp_path / "x.txt").write_text(html)
    got = sorted(tuple(r) for r in ir.page_parts(ir.html_files(spark, str(tmp_path))).collect())
    want = [("anchor", ""), ("anchor", "a<b"), ("anchor", "plain"), ("anchor", "z"), ("decl", "a<b"), ("href", "p.html#a"), ("resource", "//h/x.js"), ("resource", "https://h/s.css"), ("resource", "i.png")]
    assert got == [("d e/p.html", *w) for w in want]


def test_plain_files_refuse_other_file_systems(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", "x")], "path string, body string")
    for root in ("hdfs://nn/ck", "s3a://b/c"):
        with pytest.raises(ValueError, match="only a plain path"):
            sinks.write_files(rows, root)
    assert [tuple(r) for r in sinks.write_files(rows, f"file://{tmp_path}/out").collect()] == [("a", 1, "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881")]
    assert (tmp_path / "out" / "a").read_text() == "x"
    monkeypatch.setattr(order, "_shared", lambda spark: "hdfs://nn/ck")
    with pytest.raises(ValueError, match="only to a plain path"):
        order.scratch(spark)
