"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates of a text are the matches of the three base patterns and runs of TOKEN that mix letters of both cases and
digits.  The values of all candidates are hashed and counted over the corpus by distinct repositories and owners.  A
value that more than MAX_OWNERS owners or more than MAX_REPOSITORIES repositories hold is a widely copied example; any other looks live.  Base
spans stay whatever their count; live runs of TOKEN outside base spans are added as spans of kind `owned`.

Positions come from the pieces between matches: a match starts after the pieces and matches before it, in code
points, summed inside blocks of BLOCK matches and then over the blocks, so time follows the matches and not their square.  A pattern is
only split where the text matches it at all, and runs are only looked for where there is one of 20 characters.

Scale.  The texts are scanned once and never shuffled: a row keeps its candidates.  Hashes are counted over distinct
(hash, repository, owner) with map-side partial aggregates.  A text asks for each hash once; questions about one hash
are salted SALT ways (and split further by skew joins), so an example in a third of all documents is no hot key.  Answers return as one
row for a text.

Defined results.  A null text is empty.  Rows that repeat doc_id and text get the same result each.  A null source is
an owner of its own.  ``redact`` keeps every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.tables import cut, spare, table

#: The three base patterns, and the least length of what counts (group 2 of the first, whole matches of the others).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A run that may be a credential: long, of both cases and digits.  Every match of ACCESS and HEX that counts lies in such a run.
TOKEN, RUN = r"[A-Za-z0-9+/_=-]{20,}", r"[A-Za-z0-9+/_=-]{20}"
#: A value of more owners is an example that was copied around.
MAX_OWNERS = 2
#: So is a value of more repositories, whoever owns them.
MAX_REPOSITORIES = 4
SALT = 16
BLOCK = 64
KINDS = ("assign", "access", "hex", "owned")
_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    """An array (a lambda's variable) cut into arrays of BLOCK elements."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, F.lit(BLOCK)))


def _matches(text: Column, pattern: str, gate: Column, kind: int) -> Column:
    """Spans (start, kind, stop, value) of the leftmost non-overlapping matches; none where ``gate`` is false."""
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(between, whole, lambda p, m: F.struct(F.length(p).alias("before"), F.length(m).alias("own"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["before"]
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + x["own"]).alias("stop"), x["m"].alias("value"))
        return F.struct((at + x["own"]).alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    def shift(acc: Column, x: Column) -> Column:
        moved = F.transform(x["found"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["stop"] + acc["at"]).alias("stop"), s["value"].alias("value")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["found"], F.array(moved)).alias("found"))

    inside = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))
    over = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("found"))
    placed = lambda x: F.transform(_blocks(x), lambda b: F.aggregate(b, inside, step))
    found = _let(F.filter(lengths, lambda x: x["m"].isNotNull()), lambda x: F.flatten(F.aggregate(placed(x), over, shift, lambda acc: acc["found"])))
    return F.when(gate, found).otherwise(F.array().cast(_SPAN))


def candidates(text: Column, run: Column) -> Column:
    """All candidate spans of a text; the value of an assignment is what was assigned.  ``run``: whether the text has a RUN."""
    group = lambda m: F.regexp_extract(m, ASSIGN, 1)
    valued = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), group(s["value"]).alias("value"))
    assign = F.filter(F.transform(_matches(text, ASSIGN, text.rlike(ASSIGN), 0), valued), lambda s: F.length(s["value"]) >= LEAST["assign"])
    # runs are matched whole, so the least length can be part of the pattern
    access = _matches(text, r"AKIA[A-Z0-9]{16,}", run & text.rlike(r"AKIA[A-Z0-9]{16}"), 1)
    digits = _matches(text, r"[0-9a-f]{24,}", run & text.rlike(r"[0-9a-f]{24}"), 2)
    mixed = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]") & ~v.rlike(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    token = F.filter(_matches(text, TOKEN, run, 3), lambda s: mixed(s["value"]))

    def free(t: Column, blocks: Column) -> Column:
        """A run that meets no assignment; blocks of assignments are tried first."""
        meets = lambda a: (a["start"] < t["stop"]) & (t["start"] < a["stop"])
        return ~F.exists(blocks, lambda b: (F.get(b, F.lit(0))["start"] < t["stop"]) & (t["start"] < F.element_at(b, -1)["stop"]) & F.exists(b, meets))

    outside = lambda a: _let(_blocks(a), lambda blocks: F.filter(token, lambda t: free(t, blocks)))
    return F.array_sort(_let(assign, lambda a: F.concat(a, access, digits, outside(a))))


def owners(found: DataFrame) -> DataFrame:
    """hash, repositories, owners: how many distinct ones hold each candidate value.  ``found``: (hash, repository, owner)."""
    each = found.groupBy("hash", "repository", "owner").agg(F.lit(1).alias("one"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def scan(docs: DataFrame, repository: Column, owner: Column, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, key (xxhash64 of the text), found (base and added spans in order), n_example: a row for each row of ``docs``."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), repository.alias("repository"), owner.alias("owner"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("run", F.col("text").rlike(RUN))
    rows = rows.select("doc_id", "key", "repository", "owner", candidates(F.col("text"), F.col("run")).alias("found"))
    rows = rows.withColumn("found", F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.xxhash64(s["value"]).alias("hash"))))
    rows = cut(rows)
    held = rows.where("size(found) > 0").select("doc_id", "key", "repository", "owner", F.explode(F.array_distinct(F.transform("found", lambda s: s["hash"]))).alias("hash"))
    wide = owners(held).where((F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    asked = held.select("doc_id", "key", "hash", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALT)).cast("int").alias("salt")).distinct()
    copied = asked.join(wide, ["hash", "salt"], "left_semi").groupBy("doc_id", "key").agg(F.collect_set("hash").alias("copied"))
    copied = copied.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "copied")
    told = rows.join(copied, F.expr("doc_id <=> _id and key = _key"), "left")
    copied = F.coalesce("copied", F.array().cast("array<bigint>"))
    keep = F.filter("found", lambda s: (s["kind"] < 3) | ~F.array_contains(copied, s["hash"]))
    example = F.size(F.filter("found", lambda s: (s["kind"] < 3) & F.array_contains(copied, s["hash"])))
    return told.select("doc_id", "key", keep.alias("found"), example.cast("long").alias("n_example"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        count(3).alias("n_owned"),
        "n_example",
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``digest`` of all documents, a source for an owner and its part in a language for a repository; nulls, repeats and scale as the module says."""
    docs = table(spark, sf_dir, "documents")
    return digest(scan(docs, F.concat_ws("/", "source", "lang"), F.col("source")))


def redact(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets and n_chars (if it's there) counted anew.

    Spans of different kinds may overlap: the union of them is replaced, named after the first.
    """
    ident, key, spans, own, fresh = spare(docs, "_id", "_key", "_found", "_own", "_text")
    found = scan(docs, repository, owner).where("size(found) > 0").select(F.col("doc_id").alias(ident), F.col("key").alias(key), F.col("found").alias(spans))
    found = found.dropDuplicates([ident, key])
    rows = docs.withColumn(own, F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(own) == F.col(key)), "left")
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        inside = s["start"] < acc["at"]
        done = F.when(inside, acc["done"]).otherwise(F.concat(acc["done"], before, F.get(names, s["kind"])))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), done.alias("done"))

    none = F.col(spans).isNull()
    text = F.when(none, F.col("text")).otherwise(F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))))
    rows = rows.withColumn(fresh, text)
    out = [F.col(fresh).alias(c) if c == "text" else F.when(none, F.col(c)).otherwise(F.length(fresh)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return rows.select(out)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT r, 0 AS kind, regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS ms,
         regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS vs,
         regexp_split_to_array(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS ps FROM d
  UNION ALL SELECT r, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT r, 2, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_split_to_array(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT r, 3, regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}'), regexp_split_to_array(t, '[A-Za-z0-9+/_=-]{20,}') FROM d
), e AS (
  SELECT r, kind, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS s, unnest(vs) AS v, unnest(ps[1:len(ms)]) AS p FROM m WHERE len(ms) > 0
), placed AS (
  SELECT r, kind, s, v, CAST(sum(length(p)) OVER w + coalesce(sum(length(s)) OVER (PARTITION BY r, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
  FROM e WINDOW w AS (PARTITION BY r, kind ORDER BY i)
), c AS (
  SELECT r, kind, v, a, a + length(s) AS b FROM placed
  WHERE CASE kind WHEN 0 THEN length(v) >= 6 WHEN 1 THEN length(v) >= 20 WHEN 2 THEN length(v) >= 24
        ELSE regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') END
), base AS (SELECT * FROM c WHERE kind < 3),
tok AS (SELECT * FROM c WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = c.r AND base.a < c.b AND c.a < base.b)),
allc AS (SELECT * FROM base UNION ALL SELECT * FROM tok),
n AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) > 2 OR count(DISTINCT coalesce(source, chr(1)) || chr(2) || coalesce(lang, chr(1))) > 4 AS wide FROM allc JOIN d USING (r) GROUP BY v),
f AS (
  SELECT r, kind, a, b, wide, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' || a || ':' || b AS s
  FROM allc JOIN n USING (v) WHERE kind < 3 OR NOT wide
), g AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY a, kind) AS spans,
         count(*) FILTER (kind = 3) AS n_owned, count(*) FILTER (kind < 3 AND wide) AS n_example FROM f GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (r)
"""
