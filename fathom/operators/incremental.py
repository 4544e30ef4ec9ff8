"""An incremental build as one call: what changed is extracted, merged and rendered, and the result is that of a full build.

The order is part of the meaning.  Detect what changed; in rounds extract it, find the modules whose references went stale since names moved, against
the tables as they were before the merge, and merge; then drop the pages of removed modules, find the pages that mention a name whose module moved,
render everything if an input of all pages moved, else the changed modules (widened by the mode) and those pages; commit.

Tables are those of a ``versions.Store``.  A run reads and writes only the buckets of the modules it touches, but for two semi-joins over all references and
tokens with the names that moved; these are the names of pairs (module, name) that a round lost or gained, so a round that moved none reads no reference.
Each round's rows are written once, as a part of the next version, and all that follows reads them there.  Only counts, keys of
configuration and numbers of buckets reach the driver.  A run that dies leaves the last version; the next run does its work again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators import graph, snapshot
from fathom.operators.order import cut
from fathom.sources.versions import Store, at_once

#: What an extraction gives of each module; ``owner`` is the module that declared ``name`` then.
EXTRACTED = {
    "declarations": "module string, name string",
    "references": "module string, owner string, name string",
    "imports": "module string, target string",
    "tokens": "module string, ord long, name string",
}
LEDGER, PAGES = "module string, hash string", "module string, page string"
ROUNDS = 5


@dataclass
class World:
    """What a build reads: ``listed`` (module, hash), functions of chosen modules (module), and the two sets of configuration keys.

    ``link_map`` gives the digest of the map of other packages that pages link into; an extraction may write it anew.
    """

    listed: DataFrame
    extract: Callable[[DataFrame], dict[str, DataFrame]]
    render: Callable[[DataFrame, dict[str, DataFrame], DataFrame], DataFrame]
    extract_keys: dict[str, str | None] = field(default_factory=dict)
    render_keys: dict[str, str | None] = field(default_factory=dict)
    link_map: Callable[[], str | None] = lambda: None


@dataclass
class Run:
    """What a run did; ``version`` is None where nothing was to be committed."""

    version: str | None
    rounds: int
    changed: int
    removed: int
    stale: int
    from_names: int
    rendered: int
    mode: str


def owners(declarations: DataFrame) -> DataFrame:
    """(name, owner): the greatest module that declares a name, which is the last in order."""
    return declarations.groupBy("name").agg(F.max("module").alias("owner"))


def run(store: Store, world: World, mode: str = "self", rounds: int = ROUNDS) -> Run:
    """Bring the store up to the world.  ``mode`` is one of ``graph.MODES``."""
    if mode not in graph.MODES:
        raise ValueError(f"mode must be one of {', '.join(graph.MODES)}")
    spark, manifest = store.spark, store.manifest()
    base = {name: store.table(name, schema, manifest) for name, schema in EXTRACTED.items()}

    # detect; a link map that somebody else changed is a moved key, one that this run changes is seen after the rounds
    linked = world.link_map()
    render_keys = world.render_keys | {"linkMap": linked}
    keys = snapshot.key_sets(spark, world.extract_keys, render_keys)
    known = spark.createDataFrame([tuple(x) for x in manifest["notes"].get("keys", [])], keys.schema)
    moved = snapshot.moved_keys(known, keys)
    moved_scopes = {r[0] for r in moved.select("scope").distinct().collect()}  # two at most
    states = cut(snapshot.detect(store.table("ledger", LEDGER, manifest), world.listed, "module", "hash"))
    seen = [cut(snapshot.stale(states, "module", F.lit(snapshot.EXTRACT in moved_scopes)))]
    removed = states.where("state = 'removed'").select("module")
    n_changed, n_removed = seen[0].count(), removed.count()

    # rounds of extract, ownership, merge
    version, known_names = store.fresh(), bool(manifest["tables"])
    now, n_rounds, n_stale, n_now = seen[0], 0, 0, n_changed
    differing: list[DataFrame] = []

    def all_seen() -> DataFrame:
        out = seen[0]
        for more in seen[1:]:
            out = out.unionByName(more)
        return out

    while n_now or (n_rounds == 0 and n_removed):
        n_rounds += 1
        if n_now:
            store.add(version, {name: (rows, EXTRACTED[name]) for name, rows in world.extract(now).items()})
        if not known_names:  # a first build: nothing refers to what moved
            break
        before = base["declarations"].join(now.unionByName(removed) if n_rounds == 1 else now, "module", "left_semi")
        so_far = store.merged({"tables": {}}, version, {"declarations": (EXTRACTED["declarations"], [])})
        after = store.table("declarations", EXTRACTED["declarations"], so_far).join(now, "module", "left_semi")
        lost, gained = at_once(cut, snapshot.lost_and_gained(before, after, "module", "name"))
        differ = cut(lost.unionByName(gained).select("name").distinct())
        if differ.isEmpty():
            break
        differing.append(differ)
        refs = base["references"].join(differ, "name", "left_semi").select(F.col("module").alias("user"), F.col("owner").alias("module"), "name")
        away = snapshot.stale_users(lost, gained, refs, all_seen().unionByName(removed).withColumnRenamed("module", "user"))
        now = cut(away.select(F.col("user").alias("module")).distinct())
        n_now = now.count()
        n_stale += n_now
        if n_now:
            if n_rounds >= rounds:
                raise RuntimeError(f"still {n_now} stale modules after {n_rounds} rounds")
            seen.append(now)
    taken = cut(all_seen().distinct()) if len(seen) > 1 else seen[0]
    touched = taken.unionByName(removed)

    # the rows that stay in buckets of what was touched; a bucket whose modules were all touched has none
    buckets = store.touched(touched)
    part = lambda name, schema, only: store.table(name, schema, manifest, only)
    staying = store.touched(part("ledger", LEDGER, buckets).join(touched, "module", "left_anti"))
    if staying:
        store.add(version, {name: (part(name, schema, staying).join(touched, "module", "left_anti"), schema) for name, schema in EXTRACTED.items()})
    changes = {name: (schema, buckets) for name, schema in EXTRACTED.items()}
    after_merge = store.merged(manifest, version, changes)
    tables = {name: store.table(name, schema, after_merge) for name, schema in EXTRACTED.items()}

    # names that moved, over the whole corpus: only one whose pairs differ can have another owner
    from_names, n_names = taken.limit(0), 0
    if differing:
        names = differing[0]
        for more in differing[1:]:
            names = names.unionByName(more)
        of = lambda decls: owners(decls.join(names.distinct(), "name", "left_semi"))
        elsewhere = snapshot.key_diff(of(base["declarations"]), of(tables["declarations"]), "name", "owner")
        from_names = cut(snapshot.delta(elsewhere, tables["tokens"], "name", "module", "ord").select("module"))
        n_names = from_names.count()

    # escalate, impact, render
    every = world.listed.where("hash is not null").select(F.col("module").alias("node"))
    linked_now = world.link_map()
    chosen_mode = snapshot.render_mode(moved, linked_now != linked, mode)
    edges = tables["imports"].select(F.col("module").alias("src"), F.col("target").alias("dst"))
    users = tables["references"].select(F.col("module").alias("src"), F.col("owner").alias("dst"))
    near = graph.impact(taken.withColumnRenamed("module", "node"), edges, users, every, chosen_mode).withColumnRenamed("node", "module")
    chosen = cut(near.unionByName(from_names.join(every.withColumnRenamed("node", "module"), "module", "left_semi")).distinct())
    n_rendered = chosen.count()
    done = Run(None, n_rounds, n_changed, n_removed, n_stale, n_names, n_rendered, chosen_mode)
    notes = {"keys": sorted([scope, k, v] for scope, own in ((snapshot.EXTRACT, world.extract_keys), (snapshot.RENDER, render_keys | {"linkMap": linked_now})) for k, v in own.items() if v is not None)}
    if not (n_changed or n_removed or n_rendered or moved_scopes):
        return done

    # commit: of each table only the buckets of what was touched
    page_buckets = store.touched(chosen.unionByName(removed))
    hashes = world.listed.where("hash is not null").select("module", "hash").join(taken, "module", "left_semi")
    ledger = part("ledger", LEDGER, buckets).join(touched, "module", "left_anti").unionByName(hashes)
    pages = part("pages", PAGES, page_buckets).join(chosen.unionByName(removed), "module", "left_anti")
    if n_rendered:
        pages = pages.unionByName(world.render(chosen, tables, owners(tables["declarations"])).select("module", "page"))
    store.add(version, {"ledger": (ledger, LEDGER), "pages": (pages, PAGES)})
    changes |= {"ledger": (LEDGER, buckets), "pages": (PAGES, page_buckets)}
    done.version = store.commit(store.merged(manifest, version, changes) | {"notes": notes}, version)
    return done


def verify(store: Store, full: Store, name: str, values: list[str]) -> DataFrame:
    """Differences of a table between two stores, as ``snapshot.verify`` has them; empty where an incremental build equals a full one."""
    rows = [s.table(name, PAGES, s.manifest()) for s in (store, full)]
    return snapshot.verify(*rows, "module", values)
