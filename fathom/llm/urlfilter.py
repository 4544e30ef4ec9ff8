"""URL filters by temporal list join, in DataFrame operations only.

A list is a history of dated entries: from ``since`` on, ``pattern`` is listed (action add) or not (action remove).  A pattern is
a host, which also covers its subdomains, or a host with a path, which covers the path and what is below it.  Entries of one list
and pattern become validity intervals [since, next entry); neighbouring entries that don't change anything
merge.  A capture is evaluated as of the time it was fetched: it is blocked if an interval of any pattern that covers its URL
holds that time.  An allow list is a list whose intervals win over the others.

Scale.  A URL has one key for each of its host suffixes and path prefixes, so the range condition becomes an equality on the
key; keys are only made as deep as the longest host and the deepest path of the rules, which leaves no match out however long a URL is.  A capture
matches at most one interval for each key and list.  Intervals of a key are one row with a sorted array, and are
broadcast only if there are at most BROADCAST of them; else both sides are shuffled on (key, salt): the rules are repeated
SALT times, so a host with a third of all captures is spread.  Only distinct (host, path, time) keys that match anything return
to the captures, one row for a capture.  The html isn't read.

Defined results.  A null or empty URL, or one without host, has no keys and is never blocked; so is a capture without time.  Hosts
are compared in lower case without user, port and trailing dot; paths as they are, without query and fragment.  Entries with a
null pattern, time or action are ignored; of entries of one list, pattern and time a removal counts last.  Rows that repeat are each evaluated.
A column of the captures named like a result keeps its name, and the result's is lengthened by `_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.tables import spare, table

BROADCAST = 100_000
SALT = 16

#: The production list of the query: (list, pattern, since, action).
ENTRIES = (
    ("spam", "spam-farm.example.org", "2023-03-01", "add"),
    ("spam", "spam-farm.example.org", "2023-09-01", "remove"),
    ("spam", "spam-farm.example.org", "2024-02-15", "add"),
    ("spam", "cheap-pills.example.com", "2023-01-10", "add"),
    ("spam", "cheap-pills.example.com", "2024-06-01", "remove"),
    ("spam", "example.net/es", "2023-11-01", "add"),
    ("copyright", "tionsh.example.net", "2023-07-01", "add"),
    ("copyright", "tionsh.example.net", "2023-10-01", "remove"),
    ("copyright", "blog.tionble.example.com/en", "2023-05-05", "add"),
    ("copyright", "blog.tionble.example.com/en", "2024-05-05", "add"),
    ("copyright", "m.tiontion.example.com", "2024-01-01", "add"),
    ("allow", "www.cheap-pills.example.com", "2023-08-01", "add"),
    ("allow", "www.cheap-pills.example.com", "2024-01-01", "remove"),
)
ALLOW = "allow"


def host(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    netloc = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^[^/?#]*(/[^?#]*)", 1)


def keys(host_: Column, path_: Column, longest: int, deepest: int) -> Column:
    """Every pattern that covers a URL: host suffixes of up to ``longest`` labels, alone and with each path prefix of up to ``deepest`` steps."""
    labels = F.split(host_, r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - longest + 1)
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # further steps than asked for, which may be empty, are one piece
    steps = F.slice(F.filter(F.split(F.regexp_replace(path_, "/+", "/"), "/", deepest + 2), lambda s: s != ""), 1, deepest)
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.concat(F.array(F.lit("")), F.slice(steps, 1, i)), "/"))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.when((host_ != "") & host_.isNotNull(), F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until) from entries (list, pattern, since, action); until is null if the last entry stands."""
    one = entries.where("pattern is not null and since is not null and action in ('add', 'remove')")
    one = one.select("list", F.concat(host(F.col("pattern")), F.regexp_replace(path(F.col("pattern")), "/+$", "")).alias("key"), "since", (F.col("action") == "add").alias("on"))
    one = one.groupBy("list", "key", "since").agg(F.min("on").alias("on"))
    order = Window.partitionBy("list", "key").orderBy("since")
    changes = one.where("key <> ''").withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).where("on <> was")
    return changes.withColumn("until", F.lead("since").over(order)).where("on").select("list", "key", "since", "until")


def evaluate(captures: DataFrame, entries: DataFrame, allow: str = ALLOW) -> DataFrame:
    """``captures`` (url, fetched, and other columns) with host, blocked, lists and since, the oldest interval that blocks."""
    rules = intervals(entries).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("since", "until", "list"))).alias("spans"))
    depth = F.size(F.split("key", "/")) - 1
    labels = F.size(F.split(F.substring_index("key", "/", 1), r"\."))
    n_rules, longest, deepest = rules.agg(F.count("*"), F.coalesce(F.max(labels), F.lit(0)), F.coalesce(F.max(depth), F.lit(0))).first()
    seen = captures.select(host(F.col("url")).alias("_host"), path(F.col("url")).alias("_path"), F.col("fetched").alias("_at")).where("_host <> '' and _at is not null").distinct()
    asked = seen.withColumn("key", F.explode(keys(F.col("_host"), F.col("_path"), longest, deepest)))
    if n_rules <= BROADCAST:
        met = asked.join(F.broadcast(rules), "key")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = asked.withColumn("salt", F.pmod(F.xxhash64("_host", "_path", "_at"), F.lit(SALT)).cast("int")).join(salted, ["key", "salt"])
    valid = F.filter("spans", lambda s: (s["since"] <= F.col("_at")) & (s["until"].isNull() | (F.col("_at") < s["until"])))
    met = met.select("_host", "_path", "_at", F.explode(valid).alias("s"))
    at_host, at_path, at, host_, blocked, lists, since = spare(captures, "_host", "_path", "_at", "host", "blocked", "lists", "since")
    found = met.groupBy("_host", "_path", "_at").agg(
        F.max(F.col("s.list") == allow).alias("allowed"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("s.list") != allow, F.col("s.list")))), ",").alias("_lists"),
        F.min(F.when(F.col("s.list") != allow, F.col("s.since"))).alias("_since"),
    )
    found = found.where("not allowed and _lists <> ''")
    found = found.select(F.col("_host").alias(at_host), F.col("_path").alias(at_path), F.col("_at").alias(at), F.col("_lists").alias(lists), F.col("_since").alias(since))
    same = (host(F.col("url")) == F.col(at_host)) & (path(F.col("url")) == F.col(at_path)) & (F.col("fetched") == F.col(at))
    rows = captures.join(found, same, "left").withColumn(host_, host(F.col("url"))).withColumn(blocked, F.col(since).isNotNull())
    return rows.select(*captures.columns, host_, blocked, lists, since)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no time of their own: page n counts as fetched n mod 730 days after 2023-01-01."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2023-01-01', cast(page_id % 730 as int))").alias("fetched"))
    values = ", ".join(f"('{a}', '{b}', date'{c}', '{d}')" for a, b, c, d in ENTRIES)
    entries = spark.sql(f"select * from values {values} as t(list, pattern, since, action)")
    found = evaluate(pages, entries)
    return found.select("page_id", "url", "host", F.col("fetched").cast("string").alias("fetched"), "blocked", F.coalesce("lists", F.lit("")).alias("lists"), F.col("since").cast("string").alias("since"))


ORACLE = f"""
WITH e(list, pattern, since, action) AS (VALUES {", ".join(f"('{a}', '{b}', DATE '{c}', '{d}')" for a, b, c, d in ENTRIES)}),
c AS (SELECT list, pattern, since, action = 'add' AS on_, coalesce(lag(action = 'add') OVER (PARTITION BY list, pattern ORDER BY since), false) AS was FROM e),
k AS (SELECT * FROM c WHERE on_ <> was),
i AS (SELECT * FROM (SELECT list, pattern, since, on_, lead(since) OVER (PARTITION BY list, pattern ORDER BY since) AS until FROM k) WHERE on_),
""" + r"""
p AS (
  SELECT page_id, url, lower(regexp_replace(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '\.?(:[0-9]*)?$', '')) AS host,
         regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*(/[^?#]*)', 1) AS path,
         CAST(DATE '2023-01-01' + CAST(page_id % 730 AS INT) AS DATE) AS fetched
  FROM pages
), m AS (
  SELECT page_id, bool_or(list = 'allow') AS allowed, string_agg(DISTINCT list, ',' ORDER BY list) FILTER (list <> 'allow') AS lists, min(since) FILTER (list <> 'allow') AS since
  FROM p JOIN i ON fetched >= since AND (until IS NULL OR fetched < until)
   AND (host = split_part(pattern, '/', 1) OR ends_with(host, '.' || split_part(pattern, '/', 1)))
   AND (NOT contains(pattern, '/') OR split_part(path, '/', 2) = split_part(pattern, '/', 2))
  GROUP BY page_id
)
SELECT p.page_id, url, host, CAST(fetched AS VARCHAR) AS fetched, coalesce(NOT allowed AND lists IS NOT NULL, false) AS blocked,
       CASE WHEN NOT allowed THEN coalesce(lists, '') ELSE '' END AS lists, CASE WHEN NOT allowed THEN CAST(since AS VARCHAR) END AS since
FROM p LEFT JOIN m USING (page_id)
"""
