"""Ranked name search, front coding and the tree of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.names import fold, utf16_key, utf16_length
from fathom.operators.order import numbered

RESTART = 16
MOST_SHARED = 254


def score(name: Column, query: str | Column, separator: str = ".") -> Column:
    """Prefix of the last component, then of the name, then the first place inside; 0 and less don't count."""
    low, q = fold(name), query if isinstance(query, Column) else F.lit(query)
    last = F.substring_index(low, separator, -1)
    place = F.position(q, low)
    return (
        F.when(last.startswith(q), 3000 - utf16_length(last))
        .when(low.startswith(q), 2000 - utf16_length(low))
        .when(place > 1, 1000 - utf16_length(F.left(low, place - 1)))
        .otherwise(0)
    )


def normalized(query: str) -> str | None:
    """What is searched for, or None if it's too short."""
    query = query.strip().lower()
    return query if len(query) >= 2 else None


def hits(names: DataFrame, query: str, name: str = "name", separator: str = ".") -> DataFrame:
    """``names`` that a query finds, with their score, in no order: what a longer query searches again."""
    q = normalized(query)
    return names.withColumn("score", score(F.col(name), q, separator) if q else F.lit(0)).where("score > 0")


def search(names: DataFrame, query: str, limit: int, name: str = "name", ident: str = "id", separator: str = ".") -> DataFrame:
    """``names`` with rank and score of the hits: by score, length and id.  The rank of a page of hits is made in one task; ``limit`` is its size."""
    top = hits(names, query, name, separator)
    top = top.orderBy(F.desc("score"), utf16_length(F.col(name)), ident).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), utf16_length(F.col(name)), ident)))


def narrowed(found: DataFrame, query: str, limit: int, **names: str) -> DataFrame:
    """Search again among all ``hits`` of a query that this one extends; the same rows as a full search."""
    return search(found.drop("score", "rank"), query, limit, **names)


def _grams(text: Column, n: int) -> Column:
    """The different runs of n characters of a text."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def search_all(names: DataFrame, queries: DataFrame, limit: int, name: str = "name", ident: str = "id", separator: str = ".") -> DataFrame:
    """(query_id, rank, score, ident, name) of the first ``limit`` hits of each of many ``queries`` (query_id, query), as ``search`` gives them.

    Names are posted under their runs of three characters (two, for queries that short).  A query looks only under its rarest run, what is found there is
    scored exactly, and the best few are kept for each query before they are ranked: one pass over the names, whatever the number of queries.  A name
    holds a query only if it holds all its runs, so nothing is missed.  Only runs that some query has are posted.  Queries shorter than two characters find nothing.
    """
    asked = queries.select("query_id", F.lower(F.trim("query")).alias("q")).where(F.length("q") >= 2)
    distinct = asked.select("q").distinct()
    runs = distinct.select("q", F.explode(F.when(F.length("q") == 2, F.array("q")).otherwise(_grams(F.col("q"), 3))).alias("run"))
    low = fold(F.col(name))
    posted = names.select(F.col(ident).alias("_id"), F.col(name).alias("_name"), low.alias("_low")).where("_low is not null")
    posted = posted.withColumn("run", F.explode(F.concat(_grams(F.col("_low"), 2), _grams(F.col("_low"), 3)))).join(runs.select("run").distinct(), "run", "left_semi")
    many = posted.groupBy("run").agg(F.count("*").alias("n"))
    rare = runs.join(many, "run", "left").groupBy("q").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"))
    found = rare.join(posted, "run").where(F.contains("_low", "q")).withColumn("score", score(F.col("_name"), F.col("q"), separator)).where("score > 0")
    best = Window.partitionBy("q").orderBy(F.desc("score"), utf16_length(F.col("_name")), "_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return asked.join(found, "q").select("query_id", "rank", "score", F.col("_id").alias(ident), F.col("_name").alias(name))


def suggestion(path: Column) -> Column:
    """Query of a missing page: its path without the ending, or its fragment, as a dotted name."""
    fragment = F.regexp_extract(path, "#(.*)$", 1)
    plain = F.regexp_replace(F.regexp_replace(path, "#.*$", ""), r"(^/+)|(\.html$)", "")
    return F.when(fragment != "", fragment).otherwise(F.replace(plain, F.lit("/"), F.lit(".")))


def front_coded(names: DataFrame, name: str) -> DataFrame:
    """(id, shared, suffix): each name in UTF-16 order against the one before; every RESTART-th is whole.

    Shared characters are counted in code points and at most MOST_SHARED.
    """
    rows = numbered(names.select(name).distinct(), [utf16_key(F.col(name))])
    block = Window.partitionBy(F.floor(F.col("id") / RESTART)).orderBy("id")
    rows = rows.withColumn("_before", F.lag(name).over(block))
    n = F.least(F.length(name), F.length("_before"), F.lit(MOST_SHARED))
    longest = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.left(F.col(name), i) == F.left(F.col("_before"), i)))
    shared = F.when(F.col("_before").isNull() | (n < 1), 0).otherwise(longest)
    return rows.withColumn("shared", shared).select(name, "id", "shared", F.substring(F.col(name), F.col("shared") + 1, F.length(name)).alias("suffix"))


def front_decoded(coded: DataFrame) -> DataFrame:
    """(id, name) of (id, shared, suffix); blocks of RESTART are independent."""
    block = F.array_sort(F.collect_list(F.struct("id", "shared", "suffix")))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<struct<id:bigint,name:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        name = F.concat(F.left(acc["last"], x["shared"]), x["suffix"])
        return F.struct(name.alias("last"), F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), name.alias("name")))).alias("out"))

    rows = coded.groupBy(F.floor(F.col("id") / RESTART).alias("block")).agg(block.alias("rows"))
    return rows.select(F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("r")).select("r.id", "r.name")


def find_names(index: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    return index.join(wanted.select(name).distinct(), name, "left_semi")


def tree(names: DataFrame, name: str, separator: str = ".") -> DataFrame:
    """(path, parent, depth, has_page): nodes of the tree of dotted names; depth 1 has parent ''."""
    parts = F.split(name, "\\" + separator if separator == "." else separator)
    rows = names.select(F.col(name).alias("_whole"), parts.alias("_p")).distinct().withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("_p"))))
    path = F.array_join(F.slice("_p", 1, F.col("depth")), separator)
    parent = F.when(F.col("depth") == 1, "").otherwise(F.array_join(F.slice("_p", 1, F.col("depth") - 1), separator))
    return rows.select(path.alias("path"), parent.alias("parent"), "depth", (path == F.col("_whole")).alias("page")).groupBy("path", "parent", "depth").agg(F.max("page").alias("has_page"))
