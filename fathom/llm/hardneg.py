"""Hard-negative mining: for an anchor and each of its nearest rows of the same label, the best rows of other labels inside a window of scores.

The score of a row is its inner product with the anchor, in integers.  An anchor's positives are its first rows of the same label; the negatives of
a positive with score p are the first rows of other labels with least * p <= 100 * score <= most * p (in percent).  Higher scores come first, then smaller vec_id.

Ball-tree branch and bound.  Each partition holds a forest, a ball tree for each label.  A query q has all its products with a ball of
centre c and radius r between qc - |q|r and qc + |q|r.  A node goes if its upper bound lies below the window, its lower bound above it, or
its upper bound strictly beneath the query's k-th best so far; the child nearer to the queries is opened first.  Blocks of queries descend together, each
leaving the tree where its own bounds say so.  Bounds are floating point with slack; scores are exact.

Scale.  Rows are dealt to shards by a number of their own, so neither a hot label nor copies of a row make a shard larger than the others; a shard has about CELL
numbers however large the table is.  Every anchor is sent to every shard, in blocks that stream past the forest, once for its positives and once, with its windows, for its
negatives: work is anchors times rows less what is pruned, and each shard answers with k rows a query at most, of which the best are kept by a window that
limits itself before its shuffle.  Nothing but the number of rows by length of vector reaches the driver.

Defined results.  Rows with a null label, a null or empty vector, or a null or non-finite component take no part.  Vectors of different lengths are never compared.  An
anchor leaves out its own row only: rows that repeat it are candidates, and repeated anchors give their results each.  A row without
vec_id comes after all others of its score.  Scores beyond 62 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.tables import cut, partitions, table

POSITIVES, NEGATIVES = 5, 10
#: The window of a negative's score, in percent of its positive's.
LEAST, MOST = 30, 90
SCALE = 256
#: Numbers in a shard's vectors, rows of the smallest shards, rows of a leaf, queries that descend together.
CELL, SMALL, LEAF, BLOCK = 4_000_000, 1024, 64, 1024
#: Beyond this product of lengths, scores are summed in integers: doubles would round.
EXACT = float(1 << 52)
#: No score reaches it.
BEYOND = 1 << 62
NONE = np.iinfo(np.int64).max


class BallTree:
    """Balls over some rows: each node has a centre, a radius and two children, or the rows of a leaf."""

    def __init__(self, points: np.ndarray, rows: np.ndarray):
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        self._grow(points, rows)

    def _grow(self, points: np.ndarray, rows: np.ndarray) -> int:
        own, at = points[rows], len(self.centre)
        centre = own.mean(0)
        away = np.sqrt(((own - centre) ** 2).sum(1))
        self.centre.append(centre)
        self.radius.append(float(away.max()))
        self.children.append(None)
        self.rows.append(rows)
        if len(rows) > LEAF and self.radius[at] > 0:
            a = own[away.argmax()]  # the row farthest out and the one farthest from it: each takes the rows nearer to it
            b = own[((own - a) ** 2).sum(1).argmax()]
            along = own @ (b - a)
            order = np.argsort(along, kind="stable")
            half = int((along < (a + b) @ (b - a) / 2).sum())
            if min(half, len(rows) - half) < len(rows) // 16:  # keeps the tree shallow
                half = len(rows) // 2
            self.rows[at] = rows[:0]
            self.children[at] = (self._grow(points, rows[order[:half]]), self._grow(points, rows[order[half:]]))
        return at


class Best:
    """The k best (score, smaller id first) rows of each query, among those inside its window."""

    def __init__(self, n: int, k: int, low: np.ndarray, high: np.ndarray):
        self.score = np.full((n, k), -np.inf)
        self.exact = np.zeros((n, k), np.int64)
        self.id = np.full((n, k), NONE)
        self.low, self.high, self.k = low, high, k

    def floor(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.low[q], self.score[q, -1])

    def put(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, out: np.ndarray) -> None:
        """Exact integer scores, a row for each query; ``out`` marks what it must not take."""
        seen = np.where(out | (score < self.low[q][:, None]) | (score > self.high[q][:, None]), -np.inf, score)
        some = np.flatnonzero((seen >= np.maximum(self.score[q, -1], -1e300)[:, None]).any(1))
        if not len(some):
            return
        q, seen, score = q[some], seen[some], score[some]
        s, e, i = (np.concatenate(x, 1) for x in ((self.score[q], seen), (self.exact[q], score.astype(np.int64)), (self.id[q], np.broadcast_to(ids, seen.shape))))
        order = np.lexsort((i, -e, -s), axis=1)[:, : self.k]
        self.score[q], self.exact[q], self.id[q] = (np.take_along_axis(x, order, 1) for x in (s, e, i))


class Forest:
    """A shard's rows under a ball tree for each label."""

    def __init__(self, points: np.ndarray, labels: list[str], ids: np.ndarray, own: np.ndarray):
        self.whole, self.points, self.ids, self.own = points, points.astype(np.float64), ids, own
        self.length = float(np.sqrt((self.points**2).sum(1).max()))
        codes = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        at = np.array([codes[x] for x in labels])
        self.trees = {x: BallTree(self.points, np.flatnonzero(at == i)) for x, i in codes.items()}
        self.opened = 0

    def scores(self, vectors: np.ndarray, length: float, rows: np.ndarray) -> np.ndarray:
        if length * self.length < EXACT:
            return vectors.astype(np.float64) @ self.points[rows].T
        return vectors @ self.whole[rows].T

    def search(self, vectors: np.ndarray, labels: list[str], own: np.ndarray, of: np.ndarray, best: Best, same: bool) -> None:
        """Fill ``best``, whose query i has the vector, label and row number at of[i], with rows of the same label or of others."""
        q = vectors.astype(np.float64)
        length = np.sqrt((q * q).sum(1))
        if len(q) and length.max() * self.length >= float(BEYOND):
            raise ValueError("scores exceed 62 bits")
        labels = np.array(labels, object)[of]
        for label, tree in self.trees.items():
            start = np.flatnonzero((labels == label) == same)
            stack = [(0, start)]
            while stack:
                node, active = stack.pop()
                if not len(active):
                    continue
                reach = length[of[active]] * tree.radius[node]
                middle = q[of[active]] @ tree.centre[node]
                slack = 1e-9 * (reach + np.abs(middle) + 1)
                active = active[(middle + reach + slack >= best.floor(active)) & (middle - reach - slack <= best.high[active])]
                if not len(active):
                    continue
                if (children := tree.children[node]) is not None:
                    a, b = children
                    nearer = float((q[of[active]] @ (tree.centre[a] - tree.centre[b])).sum()) >= 0
                    stack += [(b, active), (a, active)] if nearer else [(a, active), (b, active)]
                    continue
                rows = tree.rows[node]
                self.opened += len(active) * len(rows)
                each, back = np.unique(of[active], return_inverse=True)
                score = self.scores(vectors[each], float(length[each].max()), rows)[back]
                best.put(active, score, self.ids[rows], self.own[rows] == own[of[active]][:, None])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NONE).to_numpy(zero_copy_only=False)


def _answers(k: int, window: tuple[int, int] | None):
    """Of each shard first its rows, then the queries, which stream past its forest; without a window, for positives."""

    def block(forest: Forest, part: pa.RecordBatch, width: int) -> pa.RecordBatch:
        vectors, own = _matrix(part.column("vector"), width), part.column("own").to_numpy()
        pairs = part.column("pairs").to_pylist()
        if window is None:
            of = np.arange(len(own))
            place, positive, score = np.zeros(len(of), np.int32), np.full(len(of), NONE), np.zeros(len(of), np.int64)
            low, high = np.full(len(of), -BEYOND), np.full(len(of), BEYOND)
        else:
            of = np.repeat(np.arange(len(own)), [len(x) for x in pairs])
            place, positive, score = (np.array([NONE if p[c] is None else p[c] for x in pairs for p in x], np.int64) for c in ("place", "positive_id", "positive_score"))
            low, high = (np.array([max(-BEYOND, min(BEYOND, f(p))) for p in score.tolist()], np.int64) for f in (lambda p: -(-window[0] * p // 100), lambda p: window[1] * p // 100))
        best = Best(len(of), k, low, high)
        forest.search(vectors, part.column("label").to_pylist(), own, of, best, window is None)
        i, j = np.nonzero(np.isfinite(best.score))
        ids = lambda x: pa.array(x, pa.int64(), mask=x == NONE)
        return pa.RecordBatch.from_arrays(
            [pa.array(own[of[i]]), part.column("vec_id").take(pa.array(of[i], pa.int64())), pa.array(place[i], pa.int32()), ids(positive[i]), pa.array(score[i], pa.int64()), ids(best.id[i, j]), pa.array(best.exact[i, j])],
            names=["own", "anchor_id", "place", "positive_id", "positive_score", "found_id", "found_score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, forest = None, [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("width", "shard", "side")], 1)
            edge = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]).any(1), [True]))) if len(place) else np.zeros(1, int)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if tuple(place[a, :2]) != at:
                    at, held, forest = tuple(place[a, :2]), [], None
                part, width = batch.slice(a, b - a), int(place[a, 0])
                if place[a, 2] == 0:
                    held.append(part)
                    continue
                if forest is None and held:
                    forest = Forest(np.concatenate([_matrix(p.column("vector"), width) for p in held]), [x for p in held for x in p.column("label").to_pylist()], np.concatenate([_ids(p.column("vec_id")) for p in held]), np.concatenate([p.column("own").to_numpy() for p in held]))
                    held = []
                for c in range(0, part.num_rows, BLOCK) if forest else ():
                    yield block(forest, part.slice(c, BLOCK), width)

    return run


ANSWER = "own long, anchor_id long, place int, positive_id long, positive_score long, found_id long, found_score long"


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (LEAST, MOST), scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the ``rows`` (vec_id, label, embedding) that ``anchors`` marks.

    A component x counts as floor(scale * x).
    """
    spark = rows.sparkSession
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size("embedding") > 0)
    clean = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    vector = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    index = cut(clean.select(F.monotonically_increasing_id().alias("own"), "vec_id", F.col("label").cast("string").alias("label"), vector.alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asks")))  # written, so the numbers stay
    index = index.withColumn("width", F.size("vector"))
    sizes = {r.width: r["count"] for r in index.groupBy("width").count().collect()}  # a row for each length of vectors
    if not sizes:
        return _named(spark.createDataFrame([], ANSWER).withColumn("rank", F.lit(1)))
    shards = {w: max(-(-n * w // CELL), min(partitions(spark), -(-n // SMALL))) for w, n in sizes.items()}
    count = F.element_at(F.create_map(*[F.lit(int(x)) for pair in shards.items() for x in pair]), F.col("width"))
    none = F.lit(None).cast("array<struct<place:int,positive_id:bigint,positive_score:bigint>>")
    columns = ["width", "shard", "side", "own", "vec_id", "label", "vector", "pairs"]
    stored = index.withColumns({"shard": F.pmod(F.xxhash64("own"), count).cast("int"), "side": F.lit(0), "pairs": none}).select(columns)
    asked = index.where("asks")

    def answers(queries: DataFrame, k: int, bounds: tuple[int, int] | None) -> DataFrame:
        sent = queries.withColumns({"shard": F.explode(F.sequence(F.lit(0), count - 1)), "side": F.lit(1)}).select(columns)
        dealt = stored.unionByName(sent).repartition(2 * partitions(spark), "width", "shard").sortWithinPartitions("width", "shard", "side")
        order = Window.partitionBy("own", "place").orderBy(F.desc("found_score"), F.asc_nulls_last("found_id"))
        return dealt.mapInArrow(_answers(k, bounds), ANSWER).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = answers(asked.withColumn("pairs", none), positives, None)
    pair = F.struct(F.col("rank").alias("place"), F.col("found_id").alias("positive_id"), F.col("found_score").alias("positive_score"))
    pairs = first.groupBy("own").agg(F.collect_list(pair).alias("pairs"))
    return _named(answers(cut(asked.join(pairs, "own")), negatives, window))


def _named(out: DataFrame) -> DataFrame:
    return out.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("found_score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hard_negatives`` of the embeddings for those whose vec_id is divisible by 100; the labels of every seventh are moved on first."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = """WITH fine AS (SELECT row_number() OVER () AS own, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.own, a.vec_id AS anchor_id, a.label = r.label AS same, r.own AS other, r.vec_id, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM fine a JOIN fine r ON a.vec_id % 100 = 0 AND a.own <> r.own AND len(a.v) = len(r.v)),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5),
ranked AS (SELECT p.own, p.place, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.own, p.place ORDER BY n.score DESC, n.vec_id) AS place_n
  FROM positives p JOIN scored n ON p.own = n.own AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(place_n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE place_n <= 10"""
