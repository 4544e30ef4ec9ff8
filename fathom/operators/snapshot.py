"""Snapshots: fingerprints, change detection, ownership, merge, verification, deltas and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digest_lines(lines: Column, *order: Column) -> Column:
    """sha256 of lines in order, joined by newlines, as an aggregate."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], lines.alias("line"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), 256)


def fingerprints(files: DataFrame, module: str, path: str, digest: str, order: str) -> DataFrame:
    """One hash a module from its files' ``path digest`` lines."""
    return files.groupBy(module).agg(digest_lines(F.concat_ws(" ", path, digest), F.col(order), F.col(path)).alias("hash"), F.count("*").alias("files"))


def detect(before: DataFrame, listed: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): changed, added, removed or same.

    A listed key without a value is removed even if it was never known, and so is a known key that isn't listed.
    """
    was = before.select(key, F.col(value).alias("_was"), F.lit(True).alias("_known"))
    now = listed.select(key, F.col(value).alias("_now"))
    state = F.when(F.col("_now").isNull(), "removed").when(F.col("_known").isNull(), "added").when(F.col("_was").eqNullSafe(F.col("_now")), "same").otherwise("changed")
    return was.join(now, key, "full").select(key, state.alias("state"))


def stale(states: DataFrame, key: str, everything: Column) -> DataFrame:
    """Keys to extract again: changed and added ones, or all present if ``everything``."""
    return states.where(F.col("state").isin("changed", "added") | (everything & (F.col("state") != "removed"))).select(key)


def key_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs, a missing one included; null is a value."""
    a = before.select(key, F.struct(F.col(value)).alias("_a"))
    b = after.select(key, F.struct(F.col(value)).alias("_b"))
    return a.join(b, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


def touch(ledger: DataFrame, key: str, value: str, which: str) -> DataFrame:
    """Forget one key's fingerprint, so that it is found changed."""
    return ledger.withColumn(value, F.when(F.col(key) == which, F.lit("")).otherwise(F.col(value)))


def lost_and_gained(base: DataFrame, fresh: DataFrame, owner: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(owner, name) pairs that only the base has, and that only the fresh side has."""
    a, b = base.select(owner, name).distinct(), fresh.select(owner, name).distinct()
    return a.join(b, [owner, name], "left_anti"), b.join(a, [owner, name], "left_anti")


def ownership(base: DataFrame, fresh: DataFrame, refs: DataFrame, exclude: DataFrame, owner: str = "module", name: str = "name", user: str = "user") -> DataFrame:
    """(user, reason): modules whose references went stale since names moved.

    ``base`` and ``fresh``: (owner, name) of the extracted modules before and after; ``refs``: (user, owner, name).
    A reference to a lost pair is `lost owner`; any other to a name that modules have gained, but not its owner, is
    `moved elsewhere`.  Users in ``exclude`` are never reported.
    """
    return stale_users(*lost_and_gained(base, fresh, owner, name), refs, exclude, owner, name, user)


def stale_users(lost: DataFrame, gained: DataFrame, refs: DataFrame, exclude: DataFrame, owner: str = "module", name: str = "name", user: str = "user") -> DataFrame:
    """``ownership`` where the lost and gained pairs are known; references to names of neither can be left out."""
    movers = gained.groupBy(name).agg(F.collect_set(owner).alias("_owners"))
    marked = refs.select(user, owner, name).distinct().join(exclude.select(user).distinct(), user, "left_anti")
    marked = marked.join(lost.withColumn("_lost", F.lit(True)), [owner, name], "left").join(movers, name, "left")
    reason = F.when(F.col("_lost"), "lost owner").when(F.col("_owners").isNotNull() & ~F.array_contains("_owners", F.col(owner)), "moved elsewhere")
    return marked.select(user, reason.alias("reason")).where("reason is not null").distinct()


def merge(base: DataFrame, fresh: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Upsert ``fresh`` and delete ``removed``; a key in both is upserted."""
    kept = base.join(fresh.select(key).unionByName(removed.select(key)).distinct(), key, "left_anti")
    return kept.unionByName(fresh.select(base.columns))


def order_mismatch(listed: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of only one side; a merge is refused unless this is empty."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(side))
    return only(listed, merged, "listed").unionByName(only(merged, listed, "merged"))


def dependency_refs(refs: DataFrame, own: DataFrame, module: str, name: str) -> DataFrame:
    """Distinct (module, name) references into other packages."""
    return refs.select(module, name).distinct().join(own.select(module).distinct(), module, "left_anti")


def verify(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, difference): only in a, only in b, or differs."""
    left = a.select(key, F.struct(*values).alias("_a"))
    right = b.select(key, F.struct(*values).alias("_b"))
    kind = F.when(F.col("_b").isNull(), "only in a").when(F.col("_a").isNull(), "only in b").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return left.join(right, key, "full").select(key, kind.alias("difference")).where("difference is not null")


def delta(changed: DataFrame, tokens: DataFrame, name: str, module: str, order: str) -> DataFrame:
    """(module, witness): modules with a token among the changed names, and their first such token."""
    hits = tokens.join(changed.select(name).distinct(), name, "left_semi")
    return hits.groupBy(module).agg(F.min(F.struct(order, name)).alias("_w")).select(module, F.col(f"_w.{name}").alias("witness"))


def orphans(pages: DataFrame, live: DataFrame, key: str) -> DataFrame:
    return pages.select(key).distinct().join(live.select(key).distinct(), key, "left_anti")


def cached_facts(entries: DataFrame, cache: DataFrame, keys: list[str], facts: str, derivation: str, now: str) -> DataFrame:
    """``entries`` with the facts cached under the same keys and derivation, null where they must be derived."""
    usable = cache.where(F.col(derivation) == now).select(*keys, facts)
    return entries.join(usable, keys, "left")


def until_stable(step, state, rounds: int = 5):
    """Repeat ``step(state) -> (state, work left)`` until no work is left; more than ``rounds`` is an error."""
    for _ in range(rounds):
        state, more = step(state)
        if not more:
            return state
    raise RuntimeError(f"references still stale after {rounds} rounds")


def ledger(listed: DataFrame, files: DataFrame, strict: bool = True) -> DataFrame:
    """(module, hash, files): the fingerprint of each listed module over its files, in their fixed order.

    ``listed``: (module); ``files``: (module, ord, path, bytes, hash), bytes -1 where only a hash was read.  A listed module without a file is an
    error if ``strict`` (a ledger is built whole or not at all), else it has no hash.
    """
    own = files.groupBy("module").agg(
        digest_lines(F.concat_ws(" ", "path", "hash"), F.col("ord"), F.col("path")).alias("hash"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "path", "bytes", F.col("hash").alias("digest")))), lambda f: F.struct(f["path"].alias("path"), f["bytes"].alias("bytes"), f["digest"].alias("hash"))).alias("files"),
    )
    out = listed.select("module").distinct().join(own, "module", "left")
    if strict:
        lacking = F.raise_error(F.concat(F.lit("no file of module "), F.col("module"))).cast("string")
        out = out.withColumn("hash", F.when(F.col("hash").isNull(), lacking).otherwise(F.col("hash")))
    return out


def ledger_totals(entries: DataFrame) -> DataFrame:
    """Modules, files and bytes of a ledger; a size that wasn't measured counts as 0."""
    size = F.aggregate("files", F.lit(0).cast("long"), lambda n, f: n + F.greatest(f["bytes"], F.lit(0)))
    return entries.agg(F.count("*").alias("modules"), F.coalesce(F.sum(F.size("files")), F.lit(0)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


#: Scopes of keys: what can change an extracted module, and what can change a page while the modules stay.
EXTRACT, RENDER = "extract", "render"


def key_sets(spark: SparkSession, extract: dict[str, str | None], render: dict[str, str | None]) -> DataFrame:
    """(scope, key, value) of both key sets; an input that doesn't exist (None) has no row, so that its coming or going is a change."""
    rows = [(scope, k, v) for scope, keys in ((EXTRACT, extract), (RENDER, render)) for k, v in keys.items() if v is not None]
    return spark.createDataFrame(rows, "scope string, key string, value string")


def moved_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """(scope, key) whose value moved, appeared or went between two key sets (scope, key, value)."""
    a, b = (x.select("scope", "key", F.struct("value").alias(n)) for x, n in ((before, "_a"), (after, "_b")))
    return a.join(b, ["scope", "key"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("scope", "key")


def stale_by_keys(states: DataFrame, key: str, moved: DataFrame) -> DataFrame:
    """``stale``, or all present keys if any key of the extract scope moved; decided by a join with one row."""
    everything = moved.agg(F.coalesce(F.max(F.col("scope") == EXTRACT), F.lit(False)).alias("_all"))
    rows = states.crossJoin(everything)  # one row on the right
    return rows.where(F.col("state").isin("changed", "added") | (F.col("_all") & (F.col("state") != "removed"))).select(key)


def render_mode(moved: DataFrame, map_moved: bool, otherwise: str) -> str:
    """`all` if a key of the render scope or the link map moved, else the mode asked for."""
    return "all" if map_moved or not moved.where(F.col("scope") == RENDER).isEmpty() else otherwise


def render_subset(modules: DataFrame, chosen: DataFrame | None, key: str = "module") -> DataFrame:
    """Modules to render: all of them without a choice; an empty choice chooses nothing."""
    return modules if chosen is None else modules.join(chosen.select(key).distinct(), key, "left_semi")


def change_digest(states: DataFrame, key: str, group: list[str] | None = None) -> DataFrame:
    """One digest of a change (key, state, hash): sha256 over its ordered lines; what a watcher compares between polls."""
    lines = states.where("state <> 'same'")
    return lines.groupBy(*(group or [])).agg(digest_lines(F.concat_ws(" ", "state", key, F.coalesce("hash", F.lit("-"))), F.col("state"), F.col(key)).alias("digest"), F.count("*").alias("changes"))
