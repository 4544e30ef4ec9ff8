import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import checks, graph, index, links, search, snapshot, stats

MODULES = ["Pkg", "Pkg.A", "Pkg.B", "Pkg.C", "Pkg.Leaf", "Pkg.X"]
IMPORTS = [("Pkg.A", "Pkg"), ("Pkg.B", "Pkg"), ("Pkg.B", "Pkg.A"), ("Pkg.C", "Pkg"), ("Pkg.Leaf", "Pkg"), ("Pkg.X", "Pkg")]
DECLS = [("Pkg", "Pkg.core"), ("Pkg.A", "Pkg.A.moved"), ("Pkg.A", "Pkg.A.stay"), ("Pkg.B", "Pkg.B.b"), ("Pkg.C", "Pkg.C.c"), ("Pkg.Leaf", "Pkg.Leaf.l"), ("Pkg.X", "Pkg.X.seed")]
REFS = [("Pkg.B", "Pkg.B.b", "Pkg.A", "Pkg.A.moved"), ("Pkg.C", "Pkg.C.c", "Dep.Home", "Dep.elsewhere"), ("Pkg.Leaf", "Pkg.Leaf.l", "Pkg.A", "Pkg.A.moved"), ("Pkg.X", "Pkg.X.seed", "Pkg.A", "Pkg.A.moved")]


@pytest.fixture
def world(spark):
    nodes = spark.createDataFrame([(m,) for m in MODULES], "node string")
    imports = spark.createDataFrame(IMPORTS, "src string, dst string")
    decls = spark.createDataFrame([(m, n, i) for i, (m, n) in enumerate(DECLS)], "module string, name string, ord int")
    refs = spark.createDataFrame(REFS, "user string, decl string, module string, name string")
    return nodes, imports, decls, refs


def ones(df, column=None):
    return sorted(r[column or 0] for r in df.collect())


def test_indexes(spark, world):
    nodes, imports, decls, refs = world
    users = index.used_by(refs, decls, "name", "decl").collect()
    assert [(r.name, r.users) for r in users] == [("Pkg.A.moved", ["Pkg.B.b", "Pkg.Leaf.l", "Pkg.X.seed"])]
    assert tuple(index.used_by_counts(refs, decls, "name", "decl").first()) == (1, 3)
    found = {r.node: r.importers for r in index.imported_by(nodes, imports, "node", "src", "dst").collect()}
    assert found["Pkg"] == ["Pkg.A", "Pkg.B", "Pkg.C", "Pkg.Leaf", "Pkg.X"] and found["Pkg.A"] == ["Pkg.B"] and found["Pkg.X"] == []
    deps = spark.createDataFrame([("Dep.elsewhere", "Dep.Home"), ("Pkg.core", "Dep.Home")], "name string, module string")
    both = {r.name: r.module for r in index.own_over_dependency(decls, deps, "name", "module").collect()}
    assert len(both) == 8 and both["Pkg.core"] == "Pkg"
    twice = spark.createDataFrame([("n", "A", 0), ("n", "B", 1)], "name string, module string, ord int")
    assert index.name_map(twice, "name", ["module"], ["ord"]).first().module == "B"
    assert index.first_owner(twice, "name", "ord").first().module == "A"
    with pytest.raises(Exception, match="more than 2"):
        index.dictionary(nodes, "node", 2).collect()


def test_impact(world):
    nodes, imports, decls, refs = world
    edges = refs.select(F.col("user").alias("src"), F.col("module").alias("dst"))
    at = lambda m, mode: ones(graph.impact(nodes.where(F.col("node") == m), imports, edges, nodes, mode))
    assert at("Pkg.A", "importers") == ["Pkg.A", "Pkg.B"]
    assert at("Pkg.A", "referrers") == ["Pkg.A", "Pkg.B", "Pkg.Leaf", "Pkg.X"]
    assert at("Pkg", "all") == MODULES and at("Pkg", "self") == ["Pkg"]
    assert ones(graph.closure(nodes.where("node = 'Pkg'"), graph.reverse(imports))) == MODULES[1:]
    with pytest.raises(ValueError):
        at("Pkg", "other")


def test_closures_of_cycle_and_chain(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z")], "src string, dst string")
    seed = lambda n: spark.createDataFrame([(n,)], "node string")
    assert ones(graph.closure(seed("a"), edges)) == ["a", "b", "c"]
    assert ones(graph.closure(seed("x"), edges)) == ["y", "z"]
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "node string")
    assert {r.node: r.size for r in graph.closure_sizes(nodes, edges).collect()} == {"a": 3, "b": 3, "c": 3, "x": 3, "y": 2, "z": 1}
    assert ones(graph.missing(edges, seed("a"))) == ["b", "c", "y", "z"]


def test_a_deep_chain_takes_few_rounds(spark):
    """Ten thousand nodes in a row, which end in a cycle, and a branch half way."""
    told = {}
    edges = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    edges = edges.unionAll(spark.createDataFrame([(10_000, 9_000), (5_000, 20_000), (20_000, 20_001)], "src long, dst long"))
    got = graph.closure(spark.createDataFrame([(100,)], "node long"), edges, told=told)
    assert sorted(r.node for r in got.collect()) == [*range(101, 10_001), 20_000, 20_001]
    assert told["rounds"] <= 40
    told = {}
    chain = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.closure(spark.createDataFrame([(0,)], "node long"), chain, told=told).count() == 10_000 and told["rounds"] <= 21


def test_reach_of_random_graphs(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)] + [("n1", "out")]
        df = spark.createDataFrame(edges, "src string, dst string")
        nodes = sorted({n for e in edges for n in e if n != "out"} | {"alone"})
        sizes = {r.node: r.n for r in graph.reached(spark.createDataFrame([(n,) for n in nodes], "node string"), df).collect()}
        for n in nodes:
            seen, front = {n}, [n]
            while front:
                front = [b for a, b in edges if a in front and b not in seen]
                seen |= set(front)
            assert sizes[n] == len(seen)
        assert set(sizes) == set(nodes)
    assert graph.reached(df.select(F.col("src").alias("node")).limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("state", ["no-op", "edit", "add", "delete", "move", "reorder"])
def test_incremental_equals_full(spark, state):
    before = [(m, n) for m, n in DECLS]
    after = {
        "no-op": before,
        "edit": before,
        "add": [*before, ("Pkg.New", "Pkg.New.n")],
        "delete": [x for x in before if x[0] != "Pkg.X"],
        "move": [("Pkg.Leaf" if n == "Pkg.A.moved" else m, n) for m, n in before],
        "reorder": before[::-1],
    }[state]
    digest = lambda rows, m: repr([n for x, n in rows if x == m]) + ("!" if state == "edit" and rows is after and m == "Pkg.B" else "")
    ledger = lambda rows: spark.createDataFrame([(m, digest(rows, m)) for m in sorted({m for m, _ in rows})], "module string, hash string")
    if state == "edit":
        after = list(before)
    states = snapshot.detect(ledger(before), ledger(after), "module", "hash")
    fresh_names = ones(snapshot.stale(states, "module", F.lit(False)))
    schema = "module string, decls array<string>"
    tree = lambda rows: spark.createDataFrame([(m, [n for x, n in rows if x == m]) for m in sorted({m for m, _ in rows})], schema)
    merged = snapshot.merge(tree(before), tree(after).where(F.col("module").isin(fresh_names)), states.where("state = 'removed'"), "module")
    assert snapshot.verify(merged, tree(after), "module", ["decls"]).isEmpty()
    assert snapshot.order_mismatch(tree(after), merged, "module").isEmpty()


def test_detect_edge_states(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, v string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("never", None)], "k string, v string")
    states = snapshot.detect(before, now, "k", "v")
    assert {r.k: r.state for r in states.collect()} == {"a": "same", "b": "changed", "c": "removed", "d": "added", "never": "removed"}
    assert ones(snapshot.stale(states, "k", F.lit(True))) == ["a", "b", "d"]
    touched = snapshot.touch(before, "k", "v", "a")
    assert {r.k: r.state for r in snapshot.detect(touched, now, "k", "v").collect()}["a"] == "changed"
    null = spark.createDataFrame([("x", None)], "k string, v string")
    assert snapshot.key_diff(null, null, "k", "v").isEmpty() and ones(snapshot.key_diff(null, before, "k", "v")) == ["a", "b", "c", "x"]


def test_ownership_rules(spark):
    base = spark.createDataFrame([("A", "n"), ("A", "m")], "module string, name string")
    fresh = spark.createDataFrame([("B", "n"), ("A", "m")], "module string, name string")
    refs = spark.createDataFrame([("U", "A", "n"), ("V", "C", "n"), ("W", "A", "m"), ("X", "A", "n"), ("Y", "B", "n")], "user string, module string, name string")
    exclude = spark.createDataFrame([("X",)], "user string")
    got = {r.user: r.reason for r in snapshot.ownership(base, fresh, refs, exclude).collect()}
    assert got == {"U": "lost owner", "V": "moved elsewhere"}


def test_delta_of_a_moved_declaration(spark):
    changed = spark.createDataFrame([("Pkg.A.moved",)], "name string")
    tokens = spark.createDataFrame([("Pkg", "Pkg.A.moved", 0), ("Pkg", "moved", 1), ("Pkg.B", "Pkg.A.moved", 0), ("Pkg.C", "l", 0)], "module string, name string, ord int")
    assert sorted(tuple(r) for r in snapshot.delta(changed, tokens, "name", "module", "ord").collect()) == [("Pkg", "Pkg.A.moved"), ("Pkg.B", "Pkg.A.moved")]


def test_rounds():
    assert snapshot.until_stable(lambda n: (n + 1, n < 3), 0) == 4
    with pytest.raises(RuntimeError):
        snapshot.until_stable(lambda n: (n, True), 0)


def test_search(spark):
    names = ["NoDot", "Pkg.alpha", "Pkg.alphabet", "Pkg.Nested.deep.name", "Pkg.Γamma", "x" * 999 + "needle", "x" * 1000 + "needle"] + [f"Pkg.block.n{i:02}" for i in range(20)]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, id int")
    hits = lambda q: [r.name for r in search.search(rows, q, 30).orderBy("rank").collect()]
    assert hits("al") == ["Pkg.alpha", "Pkg.alphabet"] and hits("γamma") == ["Pkg.Γamma"] and hits("plh") == [] and hits("a") == []
    assert hits("needle") == [names[5]]
    assert len(hits(" BLOCK ")) == 20 and hits("nodot") == ["NoDot"]
    wide = search.search(rows, "al", 512)
    assert [r.name for r in search.narrowed(wide, "alphab", 30).collect()] == hits("alphab")
    coded = search.front_coded(rows, "name")
    assert sorted(r.name for r in search.front_decoded(coded).collect()) == sorted(names)
    assert all(r.shared == 0 for r in coded.where("id % 16 = 0").collect())
    ask = spark.createDataFrame([("/Foo/Bar.html",), ("/x.html#Foo.baz",)], "p string").select(search.suggestion(F.col("p")))
    assert [r[0] for r in ask.collect()] == ["Foo.Bar", "Foo.baz"]
    tree = {r.path: (r.parent, r.has_page) for r in search.tree(rows.where("id < 4"), "name").collect()}
    assert tree["Pkg"] == ("", False) and tree["Pkg.alpha"] == ("Pkg", True) and tree["Pkg.Nested.deep"] == ("Pkg.Nested", False)


def test_links(spark):
    known = spark.createDataFrame([("Foo", "M"), ("Foo.Bar", "M"), ("Foo.Bar.Baz", "N")], "name string, module string")
    want = spark.createDataFrame([("Foo",), ("Foo.Bar._x",), ("Foo.Bar.3",), ("Foo.Bar.Baz.q",), ("Foo.q",)], "name string")
    assert {r.name: r.parent for r in links.linkable_parent(want, known).collect()} == {"Foo.Bar._x": "Foo.Bar", "Foo.Bar.3": "Foo.Bar", "Foo.Bar.Baz.q": "Foo.Bar.Baz"}
    refs = spark.createDataFrame([("Foo.Bar", "Own"), ("Foo.Bar", None), ("_private.P.Q.0.Foo.Bar.Baz.aux", None), ("_private.P.Q.0.zip", None), ("None.such", None)], "name string, ref_module string")
    got = {(r.name, r.module): r.anchor for r in links.constant_module(refs, known).collect()}
    assert got == {("Foo.Bar", "Own"): "Foo.Bar", ("Foo.Bar", "M"): "Foo.Bar", ("_private.P.Q.0.Foo.Bar.Baz.aux", "N"): "Foo.Bar.Baz", ("_private.P.Q.0.zip", "P.Q"): None, ("None.such", None): None}
    ask = spark.createDataFrame([("Doc.A", "Doc.A.x"), ("Src.A", "Src.A.x"), ("Bare.A", None), ("Own.A", "Own.A.x"), ("Own.B", None)], "module string, anchor string")
    docs = spark.createDataFrame([("Doc.A", "https://docs/Doc/A.html")], "module string, docs_url string")
    sources = spark.createDataFrame([("Src", "https://src/blob/1"), ("Bare", None)], "root string, base string")
    pages = spark.createDataFrame([("Own.A",), ("Bare.A",)], "module string")
    ranges = spark.createDataFrame([("Src.A.x", 3, 9)], "name string, line_from int, line_to int")
    urls = {r.module: r.url for r in links.external_link(ask, docs, sources, pages, ranges).collect()}
    assert urls == {"Doc.A": "https://docs/Doc/A.html#Doc.A.x", "Src.A": "https://src/blob/1/Src/A.lean#L3-L9", "Bare.A": None, "Own.A": "./Own/A.html#Own.A.x", "Own.B": None}
    have = spark.createDataFrame([("Nat.succ", 1), ("Foo.Nat.succ", 0), ("zero", 2)], "name string, ord int")
    ask = spark.createDataFrame([("succ",), ("Nat.succ",), ("Other.zero",), ("ucc",)], "name string")
    assert {r.name: r.match for r in links.suffix_match(ask, have).collect()} == {"succ": "Foo.Nat.succ", "Nat.succ": "Foo.Nat.succ", "Other.zero": "zero"}
    paths = spark.createDataFrame([("A/B",), ("B",), ("C",), ("Odd-Name/In",)], "path string")
    mods = spark.createDataFrame([("A.B",), ("X.C",), ("Y.C",), ("Z.«Odd-Name».In",)], "module string")
    assert {r.path: r.module for r in links.source_module(paths, mods).collect()} == {"A/B": "A.B", "B": "A.B", "C": None, "Odd-Name/In": "Z.«Odd-Name».In"}


def test_dependency_docs(spark):
    expected = spark.createDataFrame([("A.f", "A.B"), ("A.g", "A.B"), ("A.h", "A.B")], "name string, module string")
    table = spark.createDataFrame([("A.f", "./A/B.html#A.f"), ("A.g", "./A/C.html#A.g")], "name string, docLink string")
    assert {r.name: r.state for r in links.verified_docs(expected, table).collect()} == {"A.f": "found", "A.g": "elsewhere", "A.h": "missing"}
    a = spark.createDataFrame([("A.f", "A"), ("A.g", "A"), ("B.x", "B")], "name string, module string")
    b = spark.createDataFrame([("A.f", "A"), ("A.g", "C"), ("D.y", "D")], "name string, module string")
    assert {r.name: (r.state, r.known) for r in links.compare_maps(a, b, "name", "module").collect()} == {"A.f": ("same", None), "A.g": ("moved", None), "B.x": ("only a", False), "D.y": ("only b", False)}
    urls = spark.createDataFrame([("u", "M", 1, 2), ("v", "M", 3, 4), ("w", "M", 5, 6)], "url string, module string, first int, last int")
    known = spark.createDataFrame([("M", 3, 4)], "module string, first int, last int")
    assert {r.url: r.verdict for r in links.emitted_urls(urls, urls.where("url = 'u'"), known).collect()} == {"u": "exact", "v": "explained", "w": "mismatch"}


def test_stats_and_gates(spark):
    rows = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4)], "g string, v double")
    assert tuple(stats.floor_percentiles(rows, "g", "v", {"p50": 0.5, "p90": 0.9}).first()) == ("g", 4, 2.0, 3.0)
    runs = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate((99, 1, 2, 4, 8))], "g string, run int, v double")
    assert tuple(stats.run_series(runs, ["g"], ["run"], "v").first()) == ("g", 4, 3.0, 1.0, 8.0)
    assert ones(stats.systematic_sample(spark.range(100), ["id"], 30)) == [0, 30, 60, 90]
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted(tuple(r) for r in checks.both_ways(a, b, ["k"]).collect()) == [(1, "left"), (3, "right")]
    checks.gate(checks.both_ways(a, a, ["k"]), a)
    with pytest.raises(AssertionError, match="broken"):
        checks.gate(checks.both_ways(a, b, ["k"]), a)
    with pytest.raises(AssertionError, match="nothing"):
        checks.gate(checks.both_ways(a, a, ["k"]), a.limit(0))
    pages = spark.createDataFrame([("p", ["x"])], "target string, anchors array<string>")
    hrefs = spark.createDataFrame([("q", "p", "x"), ("q", "p", "y"), ("q", "z", None)], "page string, target string, fragment string")
    assert sorted(r.reason for r in checks.dead_links(hrefs, pages).collect()) == ["no anchor", "no page"]


@pytest.mark.parametrize("seed", range(3))
def test_contained_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        a = rng.randrange(60)
        rows.append((rng.choice(["hot"] * 4 + ["b", "c", None]), f"n{i // 2}", rng.choice([a, a, None]), a + rng.choice([0, 1, 5, 40, 200])))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "m string, name string, a int, b int").repartition(5)
    want = sorted((g, x, y) for g, x, a, b in rows if g and a is not None for h, y, c, d in rows if h == g and c is not None and x != y and a <= c and d <= b)
    assert sorted(tuple(r) for r in index.contained(df, "m", "name", "a", "b").collect()) == want
    assert index.contained(df.limit(0), "m", "name", "a", "b").count() == 0


def test_contained_in_one_module_of_very_many(spark):
    """200,000 disjoint declarations of one module, one that holds them all and one that reaches over the middle."""
    rows = spark.range(200_000).select(F.lit("M").alias("m"), F.col("id").alias("name"), (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 5).alias("b"))
    rows = rows.unionAll(spark.createDataFrame([("M", -1, -5, 3_000_000), ("M", -2, 1_000_001, 1_000_097)], "m string, name long, a long, b long"))
    found = index.contained(rows, "m", "name", "a", "b").groupBy("outer").agg(F.count("*"), F.min("inner"), F.max("inner")).collect()
    assert sorted(tuple(r) for r in found) == [(-2, 9, 100_001, 100_009), (-1, 200_001, -2, 199_999)]


def test_contained_by_line_and_column(spark):
    rows = [("M", "a", (1, 5), (9, 0)), ("M", "b", (1, 6), (1, 9)), ("M", "c", (9, 0), (9, 0)), ("M", "d", (9, 0), (9, 1))]
    df = spark.createDataFrame(rows, "m string, name string, a struct<l:int,c:int>, b struct<l:int,c:int>")
    assert sorted(tuple(r) for r in index.contained(df, "m", "name", "a", "b").collect()) == [("M", "a", "b"), ("M", "a", "c"), ("M", "d", "c")]


def test_many_searches_equal_single_ones(spark):
    rng = random.Random(4)
    names = [(i, ".".join("".join(rng.choice("abcÄß") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 4)))) for i in range(300)] + [(900, None), (901, "")]
    df = spark.createDataFrame(names, "id long, name string")
    asked = [(i, "".join(rng.choice("abcä.") for _ in range(rng.randrange(0, 5)))) for i in range(40)] + [(50, "  AB "), (51, None), (52, "ab"), (53, "zzzz")]
    got = {}
    for r in search.search_all(df, spark.createDataFrame(asked, "query_id long, query string"), 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.id, r.name))
    for i, q in asked:
        want = [] if q is None else [(r["rank"], r.score, r.id, r.name) for r in search.search(df, q, 7).collect()]
        assert sorted(got.get(i, [])) == sorted(want), q


def test_site_closure_refuses_an_empty_comparison(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    page, part = frame([("m.html",)], "page string"), frame([("m.html", "anchor", "x"), ("m.html", "decl", "x")], "page string, kind string, value string")
    modules, names = frame([(0, "M", "m.html")], "id long, module string, page string"), frame([("x", "M")], "name string, module string")
    index_, pairs = frame([("x", 0, 0)], "name string, module_id long, kind_id long"), frame([("C", "x")], "key string, name string")
    checks.closed(*checks.site_closure(page, part, modules, index_, 1, names, pairs, pairs))
    with pytest.raises(AssertionError, match="nothing was compared: instances$"):
        checks.closed(*checks.site_closure(page, part, modules, index_, 1, names, pairs.limit(0), pairs))
    with pytest.raises(AssertionError, match="kinds resolve"):
        checks.closed(*checks.site_closure(page, part, modules, index_, 0, names, pairs, pairs))


def test_counted_pairs_are_dealt_into_all_partitions(spark):
    """What a task holds must not grow with how few partitions Spark merges shuffles into."""
    refs = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, 1), (None, 1), (2, None)], "t long, u long")
    got = index.used_by_counts(refs, spark.createDataFrame([(1,), (2,), (2,), (None,), (9,)], "t long"), "t", "u")
    assert [tuple(r) for r in got.collect()] == [(2, 3)]
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_keys_of_both_sides_are_dealt_into_all_partitions(spark):
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "k long")
    got = checks.both_ways(keys(1, 1, 2, None), keys(2, 3, 3, None), ["k"], ("a", "b"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a"), (None, "a"), (3, "b"), (None, "b")], key=str)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
