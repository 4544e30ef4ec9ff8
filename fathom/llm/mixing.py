"""Mixing sources to target weights by hierarchical budgeting over a tree of domains, languages and sources.

The corpus has a token budget.  Each level shares its parent's budget among its children in proportion to their
weights, but gives no child more than it can supply: its tokens times MAX_EPOCHS.  What a child cannot supply goes to its
siblings, again by weight, until the budget is spent or all are exhausted; since a parent's supply is the sum of
its children's, a shortage reaches its siblings first and ancestors' siblings only when a whole subtree is exhausted.
Shares are exact: children are sorted by supply / weight, and the level of the water is read off running sums.

A leaf's budget is met by passes over the leaf, each in its own seeded order.  Whole epochs first, then the longest prefix of
the next epoch whose tokens fit.  The order within an epoch is by md5 of seed, epoch and doc_id.  No document is taken more than MAX_EPOCHS times.

Scale.  Tokens are summed by leaf and by the first digits of the order (parts of about PART rows, as many as tasks at least) with partial
aggregates, so the running sum is split: over the parts of a leaf, and over the places inside a part.  No task sorts a whole leaf.  The tree is one row for
a (domain, language, source).  Texts are read once for their token count and joined back once by none: the result is computed
from (doc_id, leaf, tokens).

Defined results.  A null text has no tokens: such a document costs nothing and is taken with the prefix that reaches it.  Null
languages and sources are the leaf `?`.  Rows that repeat a doc_id (or have none) share their place in the order and are added
together, by the tokens of each.  A weight that isn't given is 1.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.tables import cut, partitions, spare, table

#: The corpus budget as a share of its tokens.
SHARE = 0.9
MAX_EPOCHS = 2
SEED = 17
#: Documents of a part of a leaf's order, about.
PART = 20_000
#: A source is a name and a number; sources are dealt to domains by the number.
DOMAINS = ("web", "books", "reference", "code")
WEIGHTS = {"web": 5.0, "books": 2.0, "reference": 2.0, "code": 1.0, "en": 5.0, "de": 2.0, "fr": 2.0, "es": 2.0}


def tokens(text: Column) -> Column:
    """Words of a text, null: 0."""
    return F.coalesce(F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")) - F.when(text.rlike(r"^[\x20\x09-\x0D]"), F.length(F.regexp_extract(text, r"^[\x20\x09-\x0D]+", 0))).otherwise(0), F.lit(0)).cast("long")


def domain(source: Column) -> Column:
    number = F.coalesce(F.regexp_extract(source, r"([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.get(F.array(*[F.lit(d) for d in DOMAINS]), (number % len(DOMAINS)).cast("int"))


def weight(name: Column) -> Column:
    out = F.lit(1.0)
    for k, v in WEIGHTS.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def shares(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``children`` (parent columns, child, supply, weight, budget of the parent) with ``share``, the child's budget."""
    ratio = F.col("supply") / F.col("weight")
    own = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    upto = own.orderBy(ratio, child).rowsBetween(Window.unboundedPreceding, 0)
    rows = children.withColumn("full", F.sum("supply").over(upto)).withColumn("left", F.sum("weight").over(own) - F.sum("weight").over(upto))
    # the water stands at level x if all children up to here are full; the first child that stays below its supply sets it
    before, rest = F.col("full") - F.col("supply"), F.col("left") + F.col("weight")
    level = F.max(F.when(F.col("budget") - before < ratio * rest, (F.col("budget") - before) / rest)).over(own)
    return rows.withColumn("level", level).withColumn("share", F.when(F.col("level").isNull(), F.col("supply")).otherwise(F.least("supply", F.floor(F.col("level") * F.col("weight"))))).drop("full", "left", "level")


def budgets(leaves: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """(domain, language, source, tokens, budget) from (domain, language, source, tokens)."""
    leaves = leaves.withColumn("supply", F.col("tokens") * max_epochs)
    all_ = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)).alias("budget"))
    top = leaves.groupBy("domain").agg(F.sum("supply").alias("supply")).withColumn("weight", weight(F.col("domain"))).crossJoin(F.broadcast(all_))  # one row on the right
    top = shares(top, [], "domain").select("domain", F.col("share").alias("budget"))
    mid = leaves.groupBy("domain", "language").agg(F.sum("supply").alias("supply")).withColumn("weight", weight(F.col("language"))).join(top, "domain")
    mid = shares(mid, ["domain"], "language").select("domain", "language", F.col("share").alias("budget"))
    low = leaves.withColumn("weight", weight(F.col("source"))).join(mid, ["domain", "language"])
    return shares(low, ["domain", "language"], "source").select("domain", "language", "source", "tokens", F.col("share").alias("budget"))


def digits(rows: int, part: int, tasks: int = 1) -> int:
    """Hexadecimal digits of a hash that split so many rows into parts of about ``part``, and into as many parts as there are tasks."""
    return max(1, min(8, math.ceil(math.log(max(1, rows / part, tasks), 16))))


def _mixed(docs: DataFrame, share: float, max_epochs: int, seed: int) -> DataFrame:
    source, language = F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?"))
    rows = docs.select("doc_id", source.alias("source"), language.alias("language"), domain(source).alias("domain"), tokens(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("key"))
    rows = cut(rows)
    leaf = ["domain", "language", "source"]
    leaves = cut(budgets(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), share, max_epochs))
    sized = rows.join(F.broadcast(leaves) if leaves.count() <= 10_000 else leaves, leaf)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long")
    sized = sized.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    order = F.md5(F.concat_ws(":", F.lit(seed), "whole", F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).cast("binary"))
    sized = sized.withColumn("ord", order).withColumn("part", F.substring("ord", 1, digits(rows.count(), PART, partitions(docs.sparkSession))))
    # one row for a place in the order, so that rows without doc_id, however many, don't meet in one task
    places = sized.groupBy(*leaf, "part", "ord").agg(F.sum("n_tokens").alias("held"), F.first("rest").alias("rest"))
    before = Window.partitionBy(*leaf).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = places.groupBy(*leaf, "part").agg(F.sum("held").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    inside = Window.partitionBy(*leaf, "part").orderBy("ord")
    taken = (F.col("before") + F.sum("held").over(inside) <= F.col("rest")).cast("long")
    places = places.join(parts, [*leaf, "part"]).select(*leaf, "ord", taken.alias("taken"))
    joined = sized.join(places, [*leaf, "ord"])
    return joined.select("doc_id", "key", *leaf, "n_tokens", F.least(F.col("whole") + F.col("taken"), F.lit(max_epochs)).cast("long").alias("epochs"))


def mix(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, domain, language, source, n_tokens, epochs: how often each row is taken, rows taken 0 times included."""
    return _mixed(docs, share, max_epochs, seed).drop("key")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix`` of all documents; nulls, repeats and scale as the module says."""
    return mix(table(spark, sf_dir, "documents"))


def sampled(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken; all columns stay."""
    taken = _mixed(docs, share, max_epochs, seed).where("epochs > 0").groupBy("doc_id", "key", "source", "language").agg(F.max("epochs").alias("_epochs"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("source").alias("_source"), F.col("language").alias("_language"), "_epochs")
    own, origin, spoken, copy = spare(docs, "_own", "_from", "_in", "_copy")
    names = dict(zip(taken.columns, spare(docs, *taken.columns), strict=True))
    taken = taken.withColumnsRenamed(names)
    rows = docs.withColumn(own, F.xxhash64("text")).withColumn(origin, F.coalesce("source", F.lit("?"))).withColumn(spoken, F.coalesce("lang", F.lit("?")))
    same = F.col("doc_id").eqNullSafe(F.col(names["_id"])) & (F.col(own) == F.col(names["_key"])) & (F.col(origin) == F.col(names["_source"])) & (F.col(spoken) == F.col(names["_language"]))
    rows = rows.join(taken, same)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["_epochs"])))).select(docs.columns)


ORACLE = r"""
WITH r AS (
  SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS language,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents
), d AS (
  SELECT *, (['web', 'books', 'reference', 'code'])[1 + coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS INT), 0) % 4] AS domain FROM r
), wt(name, w) AS (VALUES ('web', 5.0::DOUBLE), ('books', 2.0), ('reference', 2.0), ('code', 1.0), ('en', 5.0), ('de', 2.0), ('fr', 2.0), ('es', 2.0)),
leaf AS (SELECT domain, language, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(2 * sum(n_tokens) AS BIGINT) AS supply FROM d GROUP BY ALL),
total AS (SELECT CAST(floor(sum(tokens) * CAST(0.9 AS DOUBLE)) AS BIGINT) AS budget FROM leaf),
a0 AS (SELECT domain, CAST(sum(supply) AS BIGINT) AS supply, any_value(coalesce(w, 1.0)) AS w, any_value(budget) AS budget FROM leaf LEFT JOIN wt ON name = domain, total GROUP BY domain),
a1 AS (SELECT *, sum(supply) OVER o - supply AS bef, sum(w) OVER (PARTITION BY 0) - sum(w) OVER o + w AS rest FROM a0 WINDOW o AS (ORDER BY supply / w, domain ROWS UNBOUNDED PRECEDING)),
a2 AS (SELECT *, max(CASE WHEN budget - bef < supply / w * rest THEN (budget - bef) / rest END) OVER () AS lv FROM a1),
a AS (SELECT domain, CASE WHEN lv IS NULL THEN supply ELSE least(supply, CAST(floor(lv * w) AS BIGINT)) END AS budget FROM a2),
b0 AS (SELECT leaf.domain, language, CAST(sum(supply) AS BIGINT) AS supply, any_value(coalesce(w, 1.0)) AS w, any_value(budget) AS budget FROM leaf JOIN a USING (domain) LEFT JOIN wt ON name = language GROUP BY leaf.domain, language),
b1 AS (SELECT *, sum(supply) OVER o - supply AS bef, sum(w) OVER (PARTITION BY domain) - sum(w) OVER o + w AS rest FROM b0 WINDOW o AS (PARTITION BY domain ORDER BY supply / w, language ROWS UNBOUNDED PRECEDING)),
b2 AS (SELECT *, max(CASE WHEN budget - bef < supply / w * rest THEN (budget - bef) / rest END) OVER (PARTITION BY domain) AS lv FROM b1),
b AS (SELECT domain, language, CASE WHEN lv IS NULL THEN supply ELSE least(supply, CAST(floor(lv * w) AS BIGINT)) END AS budget FROM b2),
c0 AS (SELECT domain, language, source, tokens, supply, 1.0::DOUBLE AS w, budget FROM leaf JOIN b USING (domain, language)),
c1 AS (SELECT *, sum(supply) OVER o - supply AS bef, sum(w) OVER (PARTITION BY domain, language) - sum(w) OVER o + w AS rest FROM c0 WINDOW o AS (PARTITION BY domain, language ORDER BY supply / w, source ROWS UNBOUNDED PRECEDING)),
c2 AS (SELECT *, max(CASE WHEN budget - bef < supply / w * rest THEN (budget - bef) / rest END) OVER (PARTITION BY domain, language) AS lv FROM c1),
c AS (SELECT domain, language, source, tokens, CASE WHEN lv IS NULL THEN supply ELSE least(supply, CAST(floor(lv * w) AS BIGINT)) END AS budget FROM c2),
s AS (SELECT d.*, c.budget, c.tokens, CASE WHEN c.tokens > 0 THEN CAST(floor(c.budget / c.tokens) AS BIGINT) ELSE 1 END AS whole FROM d JOIN c USING (domain, language, source)),
t AS (SELECT *, md5('17:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '?')) AS ord FROM s)
SELECT doc_id, domain, language, source, n_tokens,
       least(2, whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY ord) <= budget - whole * tokens THEN 1 ELSE 0 END) AS epochs
FROM t
"""
