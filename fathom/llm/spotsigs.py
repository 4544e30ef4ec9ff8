"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

Words are runs of letters and digits in lower case.  An anchor is a word of ANCHORS; its chain is the next CHAIN
words after it that aren't anchors, SPACING apart.  A signature is a hash of anchor and chain; the fingerprint is the
sorted set of a text's signatures in base64, 40 bits each, a prefix of hashes of growing length.  A text without a
single anchor with a chain (code, junk) takes every word as the head of a chain instead, so that it has a fingerprint
too; one with fewer words than a chain has the hash of all its words.  Likeness is the Jaccard similarity of the sets, 1 for
two empty ones; two sets can be no more alike than the ratio of their lengths, which is tried first.

The query compares neighbours in the order of doc_id without a sort of the texts on one machine: doc_ids are dealt
into ranges by approximate quantiles, every range also gets the first document of the next one (the last range that
of the first), and a task walks its ranges in order.  A doc_id (or null) with more rows than two ranges should hold is dealt into ranges of its own
by the hashes of its texts, which is its order anyway.  Texts are shuffled once.  ``similar_texts`` is the general
operator: sets are partitioned by length so that only neighbouring partitions can hold partners.

Defined results.  A null text is empty; an empty text has an empty fingerprint.  Rows that repeat a doc_id are in the
order of their texts' hashes; a null doc_id comes first.  A table of one row has itself as next document.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.tables import partitions, table
from fathom.llm.text import hashes, mix

#: The anchors, common words of English, German, French and Spanish.
ANCHORS = frozenset(
    """
    a an and are as at be but by for from had has have he her his in is it its not of on or that the their they this
    to was were which with you
    als am auch auf aus bei das dem den der des die ein eine einen er es für hat ich im ist mit nicht sich sie sind
    und von werden wie wird zu zum zur
    au aux avec ce ces cette dans de du elle en est et il ils la le les leur mais ne nous ou par pas plus pour qu que
    qui sa se ses son sont sur un une vous
    al como con del el ella esta este ha las lo los más muy no para pero por se sin su sus una y ya
    """.split()
)
CHAIN, SPACING = 2, 1
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MASK = np.uint64((1 << 40) - 1)


def signatures(texts: list[str]) -> list[np.ndarray]:
    """Sorted 40-bit signatures of each text."""
    words = [_WORD.findall(t.lower()) for t in texts]
    flat = [x for ws in words for x in ws]
    first = np.concatenate(([0], np.cumsum([len(ws) for ws in words])))
    if not flat:
        return [np.zeros(0, np.uint64) for _ in texts]
    number: dict[str, int] = {}
    codes = np.fromiter((number.setdefault(x, len(number)) for x in flat), np.int64, len(flat))
    h = hashes([x.encode() for x in number])[codes]
    anchor = np.fromiter((x in ANCHORS for x in number), bool, len(number))[codes]
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    reach = 1 + (CHAIN - 1) * SPACING
    content = np.flatnonzero(~anchor)
    rank = np.cumsum(~anchor)  # content words up to and with each word

    def chains(heads: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        start = rank[heads] - skip
        heads, start = heads[start + reach <= len(content)], start[start + reach <= len(content)]
        same = doc[content[start + reach - 1]] == doc[heads]
        heads, start = heads[same], start[same]
        with np.errstate(over="ignore"):
            value = h[heads] * np.uint64(3 if skip == 0 else 5)
            for j in range(CHAIN):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + h[content[start + j * SPACING]])
        return doc[heads], value & _MASK

    owner, value = chains(np.flatnonzero(anchor), 0)
    poor = np.ones(len(texts), bool)
    poor[owner] = False
    extra, more = chains(content[poor[doc[content]]], 1)
    owner, value = np.concatenate((owner, extra)), np.concatenate((value, more))
    order = np.argsort(owner, kind="stable")
    owner, value = owner[order], value[order]
    edge = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = [np.unique(value[edge[d] : edge[d + 1]]) for d in range(len(texts))]
    for d, ws in enumerate(words):
        if ws and not len(out[d]):
            out[d] = hashes([" ".join(ws).encode()]) & _MASK
    return out


def fingerprint(signed: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(signed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; 0 where the lengths show that it is under ``least``."""
    small, large = sorted((len(a), len(b)))
    if large == 0:
        return 1.0
    if small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def edited(own: str, following: str) -> str:
    """The last half of ``own`` replaced by the first as many code points of ``following``."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_OUT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_GROUP_CHARS = 2_000_000


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are in the order of ranges; a row with guest set only serves as the next document."""
    held: list[tuple] = []  # (range, doc_id, text); the last one waits for its next document

    def out() -> pa.RecordBatch | None:
        done = [(d, t, held[i + 1][2]) for i, (r, d, t, guest) in enumerate(held[:-1]) if not guest and held[i + 1][0] == r]
        if not done:
            return None
        texts = [t for _, t, _ in done]
        after = [n for _, _, n in done]
        changed = [edited(t, n) for t, n in zip(texts, after, strict=True)]
        again = [i for i in range(len(done)) if i + 1 == len(done) or after[i] is not texts[i + 1]]
        signed = signatures(texts + changed + [after[i] for i in again])
        n = len(done)
        own, change, rest = signed[:n], signed[n : 2 * n], dict(zip(again, signed[2 * n :], strict=True))
        follow = [rest[i] if i in rest else own[i + 1] for i in range(n)]
        columns = [
            [d for d, _, _ in done],
            [len(t) for t in texts],
            [hashlib.sha256(x.encode()).hexdigest() for x in changed],
            [fingerprint(x) for x in own],
            [fingerprint(x) for x in change],
            [likeness(a, b) for a, b in zip(own, change, strict=True)],
            [likeness(a, b) for a, b in zip(own, follow, strict=True)],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    size = 0
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            for row in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(row)
                size += len(row[2])
                if size > _GROUP_CHARS:
                    if (x := out()) is not None:
                        yield x
                    held, size = held[-1:], 0
    if held and (x := out()) is not None:
        yield x


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses."""
    spark = docs.sparkSession
    bins = 4 * partitions(spark)
    at = [i / bins for i in range(1, bins)]
    # null comes first; as numbers of double precision the order of doc_ids stays, and equal ones stay together
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e19)).alias("at"))
    total, cuts = rows.agg(F.count("*"), F.percentile_approx("at", at, 10 * bins)).first()
    each = max(1, -(-total // bins))
    # a doc_id of more rows than a range should hold is a range of its own, dealt into parts by the hashes of its texts
    hot = {r["at"]: -(-r["n"] // each) for r in rows.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") > 2 * each).collect()}  # at most bins / 2
    edges = sorted({float(c) for c in cuts or [0.0]}.union(hot, (math.nextafter(x, math.inf) for x in hot)))
    number = [-math.inf, *edges, math.inf]
    parts = [hot.get(x, 1) for x in number[:-1]]
    offsets = [0, *accumulate(parts)][:-1]
    ranges = spark.createDataFrame([(float(i), p, o) for i, (p, o) in enumerate(zip(parts, offsets, strict=True))], "bin double, parts int, first int")
    hashed = F.xxhash64("text")
    part = F.least(F.floor((hashed.cast("double") / F.lit(2.0**64) + 0.5) * F.col("parts")).cast("int"), F.col("parts") - 1)
    rows = Bucketizer(splits=number, inputCol="at", outputCol="bin").transform(rows).join(F.broadcast(ranges), "bin")
    rows = rows.select("doc_id", "text", "at", hashed.alias("h"), (F.col("first") + part).alias("range"))
    firsts = rows.groupBy("range").agg(F.min(F.struct("at", "h")).alias("head")).orderBy("range").select("range", "head.*").collect()  # a row for each range
    # the first document of a range also goes, as a guest, behind the rows of the range before it; the first of all behind the last range
    heads = spark.createDataFrame([(r["at"], r["h"], firsts[i - 1]["range"]) for i, r in enumerate(firsts)], "at double, h long, before int")
    guests = rows.join(F.broadcast(heads), ["at", "h"]).groupBy("before").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    dealt = rows.select("range", "doc_id", "text", F.lit(False).alias("guest")).unionByName(guests.select(F.col("before").alias("range"), "doc_id", "text", F.lit(True).alias("guest")))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return dealt.repartition(bins, "range").sortWithinPartitions("range", "guest", *order).mapInArrow(_walk, _OUT_SQL)


def similar_texts(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness), a < b, of texts whose fingerprints differ and are at least so alike, found by partitions of set length.

    Fingerprints are grouped first, the least doc_id stands for equal ones.  Signatures of a set are sorted and only
    the first n - ceil(least * n) + 1 of them are indexed: two sets so alike share one of these.  The threshold is taken as the decimal
    fraction that it reads as, and compared in whole numbers, so pairs exactly at it are found.  Rows without doc_id take no part.
    """
    share = Fraction(str(least))
    p, q = (F.lit(x).cast("long") for x in (share.numerator, share.denominator))
    whole = lambda a, b: F.call_function("div", a, b)
    # lengths of two sets so alike are at most one part apart; the margin covers rounded logarithms
    at = lambda n: F.log(n) / (-math.log(least) if least < 1 else 1.0)
    margin = 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = signatures([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int64) for x in signed], pa.list_(pa.int64()))], names=["id", "sigs"])

    sets = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "id long, sigs array<long>").where("size(sigs) > 0")
    sets = sets.groupBy("sigs").agg(F.min("id").alias("id")).withColumn("n", F.size("sigs"))
    sets = sets.withColumn("head", F.explode(F.slice("sigs", 1, (F.col("n") - whole(p * F.col("n") + q - 1, q) + 1).cast("int"))))
    left = sets.select("id", "n", "sigs", "head", F.explode(F.sequence(F.floor(at("n") - margin), F.floor(at("n") + 1 + margin))).alias("part"))
    right = sets.select(F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("sigs").alias("sigs2"), "head", F.floor(at("n")).alias("part"))
    pairs = left.join(right, ["head", "part"]).where("id <> id2 and n <= n2 and (n < n2 or id < id2)").where(q * F.col("n") >= p * F.col("n2"))
    both = F.size(F.array_intersect("sigs", "sigs2"))
    pairs = pairs.withColumn("both", both).withColumn("all", F.col("n") + F.col("n2") - F.col("both")).where(q * F.col("both") >= p * F.col("all"))
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), (F.col("both") / F.col("all")).alias("likeness")).distinct()


def op5_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fingerprints`` of all documents; nulls, repeats and scale as the module says."""
    return fingerprints(table(spark, sf_dir, "documents"))
