"""The incremental run against full builds of the same world."""

import collections
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from fathom.operators import incremental as inc
from fathom.plans import builds
from fathom.sources.versions import POINTER, Store


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def world_of(spark, source, source_url="u", schema="5"):
    """``source``: module -> (declared names, referenced names, imports, tokens).  A reference's owner is what the world says when it is extracted."""
    owner = {}
    for m in sorted(source):
        owner |= dict.fromkeys(source[m][0], m)
    rows = {
        "declarations": [(m, n) for m, (d, *_) in source.items() for n in d],
        "references": [(m, owner[n], n) for m, (_, r, *_) in source.items() for n in r if n in owner],
        "imports": [(m, t) for m, (_, _, i, _) in source.items() for t in i],
        "tokens": [(m, k, n) for m, (*_, t) in source.items() for k, n in enumerate(t)],
    }
    asked = []

    def extract(chosen):
        asked.append(sorted(r.module for r in chosen.collect()))
        return {name: spark.createDataFrame(rows[name], schema).join(chosen, "module", "left_semi") for name, schema in inc.EXTRACTED.items()}

    listed = spark.createDataFrame([(m, hashlib.sha256(repr(x).encode()).hexdigest()) for m, x in source.items()], inc.LEDGER)
    return inc.World(listed, extract, render, {"schema": schema}, {"sourceUrl": source_url}), asked


def render(chosen, tables, owners):
    """A page shows what its module declares, where its references point, its importers, and what its tokens link to."""
    of = lambda name, text: tables[name].join(chosen, "module", "left_semi").select("module", text.alias("line"))
    lines = of("declarations", F.concat(F.lit("d "), "name")).unionByName(of("references", F.concat_ws(" ", F.lit("r"), "owner", "name")))
    tokens = tables["tokens"].join(chosen, "module", "left_semi").join(owners, "name", "left")
    lines = lines.unionByName(tokens.select("module", F.concat_ws(" ", F.lit("t"), "ord", F.coalesce("owner", F.lit("-"))).alias("line")))
    page = lines.groupBy("module").agg(F.array_join(F.sort_array(F.collect_set("line")), "|").alias("page"))
    return chosen.join(page, "module", "left").select("module", F.coalesce("page", F.lit("")).alias("page"))


def pages(store):
    return {r.module: r.page for r in store.table("pages", inc.PAGES, store.manifest()).collect()}


def full(source):
    """The pages of a full build, without any of the library."""
    owner = {}
    for m in sorted(source):
        owner |= dict.fromkeys(source[m][0], m)
    out = {}
    for m, (declared, refs, _, tokens) in source.items():
        lines = {f"d {n}" for n in declared} | {f"r {owner[n]} {n}" for n in refs if n in owner} | {f"t {k} {owner.get(n, '-')}" for k, n in enumerate(tokens)}
        out[m] = "|".join(sorted(lines))
    return out


BASE = {
    "Pkg": (["Pkg.x"], ["A.f"], ["Pkg.A"], []),
    "Pkg.A": (["A.f", "A.g"], [], [], []),
    "Pkg.B": (["B.h"], ["A.f", "A.g"], ["Pkg.A"], ["B.h"]),
    "Pkg.C": ([], [], [], ["Leaf.l", "Added.a"]),
    "Pkg.Leaf": (["Leaf.l"], ["B.h"], ["Pkg.B"], []),
}


def test_seven_states_equal_full_builds(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/live", buckets=4)
    steps = []

    def step(state, source, **more):
        world, asked = world_of(spark, source, **more)
        done = inc.run(store, world)
        assert pages(store) == full(source), state
        steps.append(state)
        return done, asked

    world, _ = world_of(spark, BASE)
    first = inc.run(store, world)
    assert first.version and first.changed == first.rendered == 5
    done, asked = step("base", BASE)
    assert done == inc.Run(None, 0, 0, 0, 0, 0, 0, "self") and asked == []
    assert step("rerun", BASE)[0].version is None and store.current() == first.version
    modified = BASE | {"Pkg.A": (["A.f", "A.g"], [], [], ["Leaf.l"])}
    done, asked = step("modified", modified)
    assert (done.changed, done.rounds, done.rendered) == (1, 1, 1) and asked == [["Pkg.A"]]
    left = {m: x for m, x in modified.items() if m != "Pkg.Leaf"}
    done, asked = step("removed", left)
    assert (done.changed, done.removed, done.rounds, done.from_names) == (0, 1, 1, 2) and asked == [] and "Pkg.Leaf" not in pages(store)
    done, _ = step("added", left | {"Pkg.Added": (["Added.a"], [], ["Pkg"], [])})
    assert (done.changed, done.from_names, done.rendered) == (1, 1, 2)
    assert step("restored", BASE)[0].removed == 1
    done, asked = step("stale-state", BASE, source_url="v")
    assert (done.changed, done.mode, done.rendered) == (0, "all", 5) and asked == []


def test_a_moved_name_goes_through_a_second_round(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/live", buckets=4)
    inc.run(store, world_of(spark, BASE)[0])
    moved = BASE | {"Pkg.A": (["A.f"], [], [], []), "Pkg.C": (["A.g"], [], [], ["Leaf.l", "Added.a"])}
    world, asked = world_of(spark, moved)
    done = inc.run(store, world)
    assert asked == [["Pkg.A", "Pkg.C"], ["Pkg.B"]] and (done.rounds, done.stale) == (2, 1)
    assert pages(store) == full(moved)
    world, asked = world_of(spark, moved, schema="6")
    done = inc.run(store, world)
    assert done.changed == 5 and asked == [sorted(moved)]
    with pytest.raises(RuntimeError, match="still 1 stale"):
        inc.run(store, world_of(spark, BASE, schema="6")[0], rounds=1)


def test_a_run_that_dies_leaves_the_last_version(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/live", buckets=4)
    inc.run(store, world_of(spark, BASE)[0])
    before, was = pages(store), store.current()
    changed = BASE | {"Pkg.B": (["B.h", "B.i"], ["A.f"], [], []), "Pkg.New": (["N"], ["B.i"], [], [])}

    def die(*_):
        raise OSError("the executor is gone")

    for at in ("extract", "render", "manifest", POINTER):
        world, _ = world_of(spark, changed)
        with monkeypatch.context() as m:
            if at in ("extract", "render"):
                m.setattr(world, at, die)
            else:
                put = store.files.put
                m.setattr(store.files, "put", lambda name, text, at=at, put=put: die() if name.startswith(at) else put(name, text))
            with pytest.raises(OSError):
                inc.run(store, world)
        assert store.current() == was and pages(store) == before
    assert inc.run(store, world_of(spark, changed)[0]).version
    assert pages(store) == full(changed)


def test_untouched_buckets_are_shared(spark, tmp_path):
    source = {f"M{i}": ([f"n{i}"], [f"n{(i + 1) % 40}"], [], []) for i in range(40)}
    store = Store(spark, f"file://{tmp_path}/live", buckets=16)
    inc.run(store, world_of(spark, source)[0])
    first = store.current()
    inc.run(store, world_of(spark, source | {"M7": (["n7"], ["n3"], [], [])})[0])
    held = store.manifest()["tables"]["references"]["buckets"]
    assert sum(v != first for v in held.values()) == 1 and len(held) > 8


def test_a_link_map_that_moves_renders_everything(spark, tmp_path):
    """Moved by somebody else, and by the run's own extraction; the next run has nothing to do."""
    store = Store(spark, f"file://{tmp_path}/live", buckets=4)
    now = ["m1"]

    def world(source):
        out, _ = world_of(spark, source)
        out.link_map = lambda: now[0]
        return out

    inc.run(store, world(BASE))
    now[0] = "m2"
    done = inc.run(store, world(BASE))
    assert (done.changed, done.mode, done.rendered) == (0, "all", 5)
    changed = world(BASE | {"Pkg.B": (["B.h"], [], [], [])})
    extract = changed.extract
    changed.extract = lambda chosen: now.__setitem__(0, "m3") or extract(chosen)
    done = inc.run(store, changed)
    assert (done.changed, done.mode, done.rendered) == (1, "all", 5)
    assert inc.run(store, world(BASE | {"Pkg.B": (["B.h"], [], [], [])})).version is None


def test_merged_tables_whose_joins_are_planned_anew(spark, tmp_path):
    """Tables so large that a join is planned as a merge and becomes a broadcast as it runs, in one part of a union and not in another."""
    n, modules = 40000, 1000
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "200k", "spark.sql.unionOutputPartitioning": "true"}
    before = {k: spark.conf.get(k) for k in settings}

    def world(moved):
        p = spark.range(n).withColumnRenamed("id", "p")
        at = F.when(F.col("p") % 40 == 7, (F.col("p") + 3) % modules).otherwise(F.col("p") % modules) if moved else F.col("p") % modules
        declared = p.select(F.concat(F.lit("M"), at).alias("module"), F.col("p").cast("string").alias("name"))
        uses = spark.range(3 * n).select(F.concat(F.lit("M"), F.col("id") % modules).alias("module"), (F.col("id") * 7 % n).cast("string").alias("name")).distinct()
        mods = spark.range(modules).select(F.concat(F.lit("M"), "id").alias("module"))
        hashes = declared.groupBy("module").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("name"))), 256).alias("hash"))
        rows = {
            "declarations": declared,
            "references": uses.join(declared.withColumnRenamed("module", "owner"), "name", "left"),
            "imports": mods.select("module", F.lit("M0").alias("target")),
            "tokens": p.where("p % 3 = 0").select(F.concat(F.lit("M"), (F.col("p") + 1) % modules).alias("module"), F.col("p").alias("ord"), F.col("p").cast("string").alias("name")),
        }
        listed = mods.join(hashes, "module", "left").select("module", F.coalesce("hash", F.lit("none")).alias("hash"))
        return inc.World(listed, lambda chosen: {k: x.join(chosen, "module", "left_semi") for k, x in rows.items()}, render, {"schema": "1"})

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        live, anew = Store(spark, f"file://{tmp_path}/live", buckets=4), Store(spark, f"file://{tmp_path}/anew", buckets=4)
        inc.run(live, world(False))
        done = inc.run(live, world(True))
        inc.run(anew, world(True))
        assert done.rounds == 2 and done.stale > 0 and done.from_names > 0
        assert inc.verify(live, anew, "pages", ["page"]).count() == 0 and len(pages(live)) == modules
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_seven_builds_read_line_items_once(spark, monkeypatch):
    """Line items are alike in all worlds; a module's hash moves only with what it declares."""
    read, worlds, table = collections.Counter(), [], builds.table
    monkeypatch.setattr(builds, "table", lambda spark, d, name: read.update([name]) or table(spark, d, name))
    monkeypatch.setattr(inc, "run", lambda store, world, *_: worlds.append(world))
    builds.incremental_states(spark, "/root/testdata/sf0.001")
    assert read["lineitem"] == 1 and len(worlds) == 7
    base, rerun, modified, removed = ({r.module: r.hash for r in w.listed.collect()} for w in worlds[:4])
    declared = [{(r.module, r.name) for r in w.extract(w.listed.select("module"))["declarations"].collect()} for w in worlds[:3:2]]
    moved = {m for m, _ in declared[0] ^ declared[1]}
    assert base == rerun and moved and {m for m in base if base[m] != modified[m]} == moved
    assert removed == {m: h for m, h in modified.items() if m in removed} and len(removed) < len(modified)


def test_a_bucket_is_written_by_many_tasks(spark, tmp_path):
    """Whole keys to each task, and rows added later join those before."""
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        store = Store(spark, f"file://{tmp_path}/live", buckets=2)
        inc.run(store, world_of(spark, {f"M{i}": ([f"n{i}"], [f"n{(i + k) % 200}" for k in range(5)], [], []) for i in range(200)})[0])
        rows = store.table("references", inc.EXTRACTED["references"], store.manifest())
        files = rows.groupBy(F.input_file_name().alias("file")).count().collect()
        assert rows.count() == 1000 and len(files) > 8
        assert rows.select("module", F.input_file_name()).distinct().count() == 200
        more = spark.createDataFrame([("M0", "M1", "again")], inc.EXTRACTED["references"])
        store.add(store.current(), {"references": (more, inc.EXTRACTED["references"])})
        assert store.table("references", inc.EXTRACTED["references"], store.manifest()).count() == 1001
        assert len(os.listdir(f"{tmp_path}/live/data/references")) == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
