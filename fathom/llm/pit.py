"""Point-in-time feature join: for each request the best version that could be used at its time, by a skyline staircase sweep.

A version of a key is usable at t if event <= t and arrival <= t < expiry.  Of the usable ones the latest event wins, then the earliest arrival,
then the greatest tie, then the latest expiry, then the greatest payload.

The sweep.  Rows of one key are read in order of time.  The active versions form a staircase: ordered by priority, with expiry increasing
downward.  A new version is put in its place by bisection, unless one above it expires no sooner; those below it that expire no later
are dominated for good and deleted.  Before a read the expired front is popped; the front is the answer.

Scale.  A key may hold a third of all rows, so time is cut into buckets and each (key, bucket) is swept apart.  Their width is a power of two
ticks, chosen so that the busiest bucket holds about an eighth of a task's share and at most MOST rows; two numbers reach the driver.  A version lies in its
first bucket from its start, in its last one until its expiry, and covers those between as a whole: as at most two nodes a level of a binary tree over
buckets.  In a covered bucket it neither starts nor ends, so of all that cover a node only the best matters, and so it is of
versions with equal bounds in a bucket.  Both are reduced before the shuffle, which leaves a bucket of w ticks at most w * (w + 1) / 2 + w + 1
versions, however many rows have its key, and a request's bucket one version a level of the tree.  Requests of one
key and tick are one row in the sweep; the answer is joined back, so a tick that very many ask about is split as any skewed join is.

Defined results.  Every request row gives one row.  A version with a null key, event, arrival or tie takes no part, a null expiry never comes; a
request with a null key or time finds none.  Repeated versions count once.  Requests keep their columns, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.tables import partitions, spare, table

#: Rows of a bucket: no more than MOST are aimed at, and no fewer than LEAST.
LEAST, MOST = 64, 65_536
#: Slots of the requests' span in which rows are counted to choose the width of buckets.
SLOTS = 4096
NEVER = (1 << 63) - 1
FIELDS = ("event", "arrival", "tie", "expiry")


class Staircase:
    """Active versions in ascending priority; expiry falls as priority rises, so the front is at the end."""

    def __init__(self) -> None:
        self.ranks: list[tuple] = []
        self.ends: list[int] = []
        self.rows: list[dict] = []

    def put(self, rank: tuple, end: int, row: dict) -> None:
        at = bisect_left(self.ranks, rank)
        if at < len(self.ends) and self.ends[at] >= end:
            return
        low = at
        while low and self.ends[low - 1] <= end:
            low -= 1
        self.ranks[low:at], self.ends[low:at], self.rows[low:at] = [rank], [end], [row]

    def best(self, t: int) -> dict | None:
        while self.ends and self.ends[-1] <= t:
            del self.ranks[-1], self.ends[-1], self.rows[-1]
        return self.rows[-1] if self.rows else None


def _sweep(keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (keys, bucket, at, kind, till, v) in this order; kind 0 is a version, 1 a request."""
        now, stairs = None, Staircase()
        for batch in batches:
            *places, at, kind, till, v = (c.to_pylist() for c in batch.columns)
            found, rows = [], []
            for i, place in enumerate(zip(*places, strict=True)):
                if place != now:
                    now, stairs = place, Staircase()
                if kind[i] == 0:
                    row = v[i]
                    rank = (row["event"], row["early"], row["tie"], NEVER if row["expiry"] is None else row["expiry"])
                    stairs.put(rank, NEVER if till[i] is None else till[i], row)
                elif (row := stairs.best(at[i])) is not None:
                    found.append(i)
                    rows.append(row)
            took = batch.take(pa.array(found, pa.int64()))
            columns = [*took.columns[:keys], took.column("at"), pa.array(rows, batch.schema.field("v").type)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:keys], "at", "v"])

    return run


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by)


def _pieces(first: Column, last: Column, start: Column, till: Column) -> Column:
    """(level, node, from, till) of a version: its bounds inside its first and last bucket, and the nodes that cover those between."""
    null = F.lit(None).cast("long")
    piece = lambda level, node, a, b: F.struct(F.lit(level).cast("int").alias("level"), node.alias("node"), a.alias("from"), b.alias("till"))
    low, high = first + 1, last  # low <= node < high

    def level(j: Column) -> Column:
        a, b = _shift(low + F.call_function("shiftleft", F.lit(1).cast("long"), j) - 1, j), _shift(high, j)
        node = lambda n: F.struct(j.alias("level"), n.alias("node"), null.alias("from"), null.alias("till"))
        left, right = F.when((a < b) & (a % 2 == 1), node(a)), F.when((a < b) & (b % 2 == 1), node(b - 1))
        return F.array(left, right)

    levels = F.when(high > low, F.sequence(F.lit(0), F.floor(F.log2((high - low).cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    covered = F.filter(F.flatten(F.transform(levels, level)), lambda x: x.isNotNull())
    return F.when(first == last, F.array(piece(0, first, start, till))).otherwise(F.concat(F.array(piece(0, first, start, null), piece(0, last, null, till)), covered))


def as_of(versions: DataFrame, requests: DataFrame, by: list[str], payload: list[str], name: str = "version", at: str = "at", fields: tuple[str, str, str, str] = FIELDS) -> DataFrame:
    """``requests`` with a struct ``name`` of the best version's event, arrival, tie, expiry and payload, null where there is none.

    ``versions`` has the columns ``by``, the four ``fields`` (event, arrival, tie, expiry; times in whole ticks) and ``payload``; ``requests`` has ``by`` and ``at``.
    """
    if name.lower() in {c.lower() for c in requests.columns} or set(payload) & set(FIELDS):
        raise ValueError("the name of the result or of a payload column is taken")
    spark, keys = versions.sparkSession, [f"k{i}" for i in range(len(by))]
    event, arrival, tie, expiry = (F.col(c) for c in fields)
    key = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    known = " and ".join(f"{k} is not null" for k in keys)
    asked = requests.select(*key, F.col(at).cast("long").alias("at")).where(f"at is not null and {known}")
    v = F.struct(event.cast("long").alias("event"), (-arrival.cast("long")).alias("early"), tie.alias("tie"), expiry.cast("long").alias("expiry"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)])
    rows = versions.select(*key, v.alias("v")).where(f"v.event is not null and v.early is not null and v.tie is not null and {known}")
    rows = rows.withColumns({"start": F.greatest("v.event", -F.col("v.early")), "till": F.coalesce("v.expiry", F.lit(NEVER))}).where("start < till")

    answer = F.struct(*[F.lit(None).cast(x.dataType).alias(x.name) for x in _answer_schema(rows, payload)])
    low, high = asked.agg(F.min("at"), F.max("at")).first()
    if low is None:
        return requests.withColumn(name, F.when(F.lit(False), answer))
    rows = rows.where((F.col("start") <= high) & (F.col("till") > low))
    shift = _width(rows, asked, keys, low, high, partitions(spark))
    bucket = lambda t: F.shiftright(t - F.lit(low), shift)

    start, till = F.greatest("start", F.lit(low)), F.least("till", F.lit(high + 1))
    cut_up = rows.select(*keys, "v", F.inline(_pieces(bucket(start), bucket(till - 1), start, till)))
    best = cut_up.groupBy(*keys, "level", "node", "from", "till").agg(F.max("v").alias("v"))
    null = F.lit(None).cast("long")
    moments = asked.distinct().withColumn("bucket", bucket(F.col("at")))
    all_rows = best.where("level = 0").select(*keys, F.col("node").alias("bucket"), F.col("from").alias("at"), F.lit(0).alias("kind"), "till", "v")
    top = ((high - low) >> shift).bit_length()
    if top > 1:
        above = F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(top)), lambda j: _shift(F.col("bucket"), j))).alias("level", "node")
        nodes = moments.select(*keys, "bucket").distinct().select(*keys, "bucket", above).withColumn("level", F.col("level") + 1)
        cover = nodes.join(best.where("level > 0"), [*keys, "level", "node"]).groupBy(*keys, "bucket").agg(F.max("v").alias("v"))
        all_rows = all_rows.unionByName(cover.select(*keys, "bucket", null.alias("at"), F.lit(0).alias("kind"), null.alias("till"), "v"))
    empty = F.lit(None).cast(all_rows.schema["v"].dataType)
    all_rows = all_rows.unionByName(moments.select(*keys, "bucket", "at", F.lit(1).alias("kind"), null.alias("till"), empty.alias("v")))
    dealt = all_rows.repartition(partitions(spark), *keys, "bucket").sortWithinPartitions(*keys, "bucket", "at", "kind")
    kinds = [f"{k} {all_rows.schema[k].dataType.simpleString()}" for k in keys]
    found = dealt.mapInArrow(_sweep(len(keys)), ", ".join([*kinds, "at long", f"v {all_rows.schema['v'].dataType.simpleString()}"]))

    fresh = spare(requests, *[f"_{k}" for k in keys], "_at")
    values = [F.col("v.event").alias("event"), (-F.col("v.early")).alias("arrival"), F.col("v.tie").alias("tie"), F.col("v.expiry").alias("expiry"), *[F.col(f"v.p{i}").alias(c) for i, c in enumerate(payload)]]
    found = found.select(*[F.col(k).alias(n) for k, n in zip([*keys, "at"], fresh, strict=True)], F.struct(*values).alias(name))
    same = [requests[c].cast("long") == found[n] if c == at else requests[c] == found[n] for c, n in zip([*by, at], fresh, strict=True)]
    on = same[0]
    for x in same[1:]:
        on &= x
    return requests.join(found, on, "left").drop(*fresh)


def _answer_schema(rows: DataFrame, payload: list[str]):
    held = rows.schema["v"].dataType
    named = dict(zip((f"p{i}" for i in range(len(payload))), payload, strict=True)) | {"early": "arrival"}
    for field in held.fields:
        field.name = named.get(field.name, field.name)
    return held.fields


def _width(rows: DataFrame, asked: DataFrame, keys: list[str], low: int, high: int, tasks: int) -> int:
    """The power of two that is a bucket's width; only the balance of tasks depends on it."""
    fine = max(0, ((high - low) // SLOTS).bit_length())
    slot = lambda t: F.shiftright(t - F.lit(low), fine).alias("slot")
    begun = rows.select(*keys, slot(F.greatest("start", F.lit(low)))).unionByName(asked.select(*keys, slot(F.col("at"))))
    most, total = begun.groupBy(*keys, "slot").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    aim = max(LEAST, min(MOST, total // (8 * tasks)))
    shift = fine + ((aim // most).bit_length() - 1 if aim >= most else -(most // aim).bit_length())
    return max(0, min(shift, (high - low).bit_length()))


#: The latest age, in seconds, of an answer that counts as fresh.
FRESH = 60


def op11_point_in_time_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``as_of`` for every label over the versions that `documents` holds; a repeated doc_id asks about the greatest of its sources."""
    group = lambda i: F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 8 * i + 1, 8), 16, 10).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    event = group(0) % 20_000
    versions = docs.select("source", "n_chars", "lang", event.alias("event"), (event - 60 + group(1) % 300).alias("arrival"), (event + group(2) % 900).alias("expiry"), F.col("doc_id").alias("tie"))
    home = docs.groupBy("doc_id").agg(F.max("source").alias("source"))
    requests = table(spark, sf_dir, "labels").select("doc_id", (group(3) % 20_000).alias("t")).join(home, "doc_id", "left")
    out = as_of(versions, requests, ["source"], ["n_chars", "lang"], at="t")
    age = F.col("t") - F.col("version.event")
    status = F.when(F.col("version").isNull(), "none").when(age > FRESH, "stale").otherwise("fresh")
    fresh = lambda c: F.when(status == "fresh", F.col(f"version.{c}")).alias(c)
    return out.select("doc_id", "t", F.col("version.tie").alias("version_id"), age.alias("age"), status.alias("status"), fresh("n_chars"), fresh("lang"))


ORACLE = """WITH hashed AS (SELECT doc_id, source, n_chars, lang, sha256(CAST(doc_id AS VARCHAR)) AS x FROM documents),
versions AS (SELECT doc_id, source, n_chars, lang, CAST('0x' || substr(x, 1, 8) AS BIGINT) % 20000 AS event, CAST('0x' || substr(x, 9, 8) AS BIGINT) % 300 - 60 AS late, CAST('0x' || substr(x, 17, 8) AS BIGINT) % 900 AS lasts FROM hashed),
home AS (SELECT doc_id, max(source) AS source FROM documents GROUP BY doc_id),
asked AS (SELECT row_number() OVER () AS i, l.doc_id, CAST('0x' || substr(sha256(CAST(l.doc_id AS VARCHAR)), 25, 8) AS BIGINT) % 20000 AS t, source FROM labels l LEFT JOIN home USING (doc_id)),
found AS (SELECT i, v.doc_id AS version_id, event, n_chars, lang, row_number() OVER (PARTITION BY i ORDER BY event DESC, event + late, v.doc_id DESC, n_chars DESC NULLS LAST, lang DESC NULLS LAST) AS place
  FROM asked a JOIN versions v ON a.source = v.source AND event <= t AND event + late <= t AND t < event + lasts)
SELECT doc_id, t, version_id, t - event AS age, CASE WHEN version_id IS NULL THEN 'none' WHEN t - event > 60 THEN 'stale' ELSE 'fresh' END AS status,
  CASE WHEN t - event <= 60 THEN n_chars END AS n_chars, CASE WHEN t - event <= 60 THEN lang END AS lang
FROM asked LEFT JOIN (SELECT * FROM found WHERE place = 1) USING (i)"""
