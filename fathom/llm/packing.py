"""Packing by optimal length buckets: boundaries that minimise padding, then token-budget batches.

The global histogram of lengths goes through a dynamic program over at most MAX_BUCKETS boundaries: a document is
padded to the boundary above it, and the program finds the boundaries with the least padding in all (lower hulls of
lines make a step linear in the number of lengths).  Inside a bucket with boundary b, batches hold max(1, BUDGET // b)
documents, filled in a seeded order.

Scale.  The histogram of exact lengths is the only thing that reaches the driver, as two columns of numbers.  It has a row
for each different length: at most sqrt(2 * tokens) of them, since n different lengths have n * (n - 1) / 2 tokens at least, and in practice the
lengths of the longest documents end it long before.  Batch numbers are places in a bucket's seeded order, by md5 of seed,
doc_id and the text's hash; the order's first bits split a bucket into parts whose sizes are summed first, so no
task numbers a whole bucket, and only the last batch of a bucket can be short.

Defined results.  Null and empty texts have length 0 and are packed like others; if all lengths are 0 there is
one bucket with boundary 0 and BUDGET documents a batch.  A document longer than BUDGET is a batch alone.  Rows that repeat a doc_id
are packed each, those of different texts at places of their own.  A null doc_id is packed like others.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.mixing import digits, tokens
from fathom.llm.tables import cut, partitions, table

MAX_BUCKETS = 16
BUDGET = 65_536
#: Documents of a part of a bucket's order, about.
PART = 20_000
SEED = 5


def boundaries(lengths: list[int], counts: list[int], buckets: int = MAX_BUCKETS) -> list[int]:
    """Boundaries, the last of them the greatest length, with the least total padding; fewest of equally good ones."""
    if not lengths:
        return []
    order = np.argsort(lengths)
    size = [int(lengths[i]) for i in order]
    count = np.concatenate(([0], np.cumsum([int(counts[i]) for i in order]))).tolist()
    total = np.concatenate(([0], np.cumsum([int(lengths[i]) * int(counts[i]) for i in order]))).tolist()
    n = len(size)
    best = [0] + [None] * n  # type: ignore[list-item]
    came: list[list[int]] = []
    last: list[int | None] = best
    answer, used = None, 0
    for k in range(min(buckets, n)):
        # pad(i, j) = size[j-1] * (count[j] - count[i]) - (total[j] - total[i]): lines over i, asked at growing size[j-1]
        now: list[int | None] = [None] * (n + 1)
        back = [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # slope -count[i], height last[i] + total[i]
        at = 0
        for j in range(1, n + 1):
            i = j - 1
            if last[i] is not None:
                slope, high = -count[i], last[i] + total[i]
                while len(hull) >= 2 and (high - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                    hull.pop()
                hull.append((slope, high, i))
                at = min(at, len(hull) - 1)
            if hull:
                x = size[j - 1]
                while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                    at += 1
                now[j] = hull[at][0] * x + hull[at][1] + x * count[j] - total[j]
                back[j] = hull[at][2]
        came.append(back)
        if answer is None or now[n] < answer:
            answer, used = now[n], k
        last = now
    out, j = [], n
    for k in range(used, -1, -1):
        out.append(size[j - 1])
        j = came[k][j]
    return out[::-1]


def pack(docs: DataFrame, buckets: int = MAX_BUCKETS, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """Of each row of ``docs``: doc_id, n_tokens, bucket (from 0), padded (its boundary), batch (from 0 in a bucket), slot (from 0 in a batch)."""
    n = tokens(F.col("text"))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.xxhash64("text")).cast("binary"))
    rows = cut(docs.select("doc_id", n.alias("n_tokens"), order.alias("ord")))
    histogram = rows.groupBy("n_tokens").count().toArrow()  # a row for each length, see above
    lengths, counts = (histogram.column(i).to_pylist() for i in range(2))
    bounds = boundaries(lengths, counts, buckets)
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b < F.col("n_tokens"))) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", bucket).withColumn("padded", F.get(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), F.col("bucket")))
    rows = rows.withColumn("part", F.substring("ord", 1, digits(sum(counts), PART, partitions(docs.sparkSession))))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("bucket", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.col("before") + F.row_number().over(Window.partitionBy("bucket", "part").orderBy("ord", "n_tokens")) - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded"), F.lit(1)))).cast("long")
    out = rows.join(parts, ["bucket", "part"]).withColumn("place", place)
    return out.select("doc_id", "n_tokens", "bucket", "padded", F.floor(F.col("place") / each).alias("batch"), (F.col("place") % each).alias("slot"))


def op8_pack_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack`` of all documents; nulls, repeats and scale as the module says."""
    return pack(table(spark, sf_dir, "documents"))
