"""Approximate nearest neighbours by stable projections under a kd-tree, with a chi-square stopping test.

Vectors are scaled to length one, so the nearest by cosine are the nearest by distance.  DIMS Gaussian (2-stable)
projections keep distances in law: for true distance d, (projected distance / d)^2 is chi-square with DIMS degrees
of freedom.  A kd-tree over projections gives a query its projected neighbours in growing order of distance; each is
verified by its exact cosine.  A query stops when its next projected distance r satisfies F(r^2 / d_k^2) >= CERTAIN,
with d_k the distance of its k-th nearest so far and F the chi-square distribution: a nearer vector that is still
unseen would be projected this far with probability 1 - CERTAIN at most.

Scale.  The upper levels of the kd-tree are fitted on about SAMPLE projected rows (those with the least hashes of vec_id, or any if there are
none) and split the space into cells, about CELL rows each while the table allows; the tree, the box of each cell (of all its rows) and its number of
shards are all that is broadcast.  Every row is indexed in its cell; a cell of more than 2 * CELL rows is dealt into shards by a hash, so a task
holds 2 * CELL rows or so however large the table is, as a smaller kd-tree with leaves of LEAF rows; queries stream past it.  A query
visits cells in rounds, in growing projected distance: its own cell, then STEP more, then STEP times as many each time, and after each round its
k-th distance is tighter and cells beyond the stopping radius fall away.  Vectors travel as they are stored (float stays float).
Equal vectors are stored once, with their k + 1 smallest ids (more cannot be among the k nearest of any query), so copies cannot fill a cell.

Defined results.  Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without vec_id: as queries they
give no rows.  A cosine exists between vectors of one length only: those of each length are searched apart.  Candidates are rows: several rows with
one vec_id are candidates each, a query leaves out one row with its own vec_id and vector, and query rows alike give their
results once each.  Cosines are computed in double precision from the original components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.tables import cut, partitions, table

DIMS = 8
SAMPLE = 20_000
CELL, LEAF = 2048, 128
CERTAIN = 0.98
K = 5
#: Cells that a query visits after its own; each further round visits so many times as many.
STEP = 6
#: Queries compared at once.
BLOCK = 1024


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """x with F(x) = p for an even number of degrees of freedom, by bisection."""
    half = dims // 2
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def projection(width: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((width, DIMS))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


class Tree:
    """A kd-tree over points: leaves are boxes; each split is at the median of the widest side."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.splits: list[tuple[int, float, int, int]] = []  # axis, value, left, right; a negative child is leaf -1 - child
        self.rows: list[np.ndarray] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        big = np.full(points.shape[1], np.inf)
        self.root = self._grow(points, np.arange(len(points)), -big, big, leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, leaf: int) -> int:
        own = points[rows]
        side = np.ptp(own, axis=0) if len(rows) else np.zeros(1)
        axis = int(side.argmax())
        value = float(np.median(own[:, axis])) if len(rows) > leaf else 0.0
        left = own[:, axis] < value if len(rows) > leaf else np.zeros(0, bool)
        if len(rows) <= leaf or side[axis] == 0 or not left.any():
            self.rows.append(rows)
            self.low.append(low)
            self.high.append(high)
            return -len(self.rows)
        at = len(self.splits)
        self.splits.append((0, 0.0, 0, 0))
        cut_high, cut_low = high.copy(), low.copy()
        cut_high[axis] = cut_low[axis] = value
        a = self._grow(points, rows[left], low, cut_high, leaf)
        b = self._grow(points, rows[~left], cut_low, high, leaf)
        self.splits[at] = (axis, value, a, b)
        return at

    def place(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point."""
        out = np.full(len(points), self.root)
        while (inner := out >= 0).any():
            table_ = np.array(self.splits)
            node = out[inner]
            axis, value = table_[node, 0].astype(int), table_[node, 1]
            out[inner] = np.where(points[inner, axis] < value, table_[node, 2], table_[node, 3]).astype(int)
        return -1 - out

    def gaps(self, points: np.ndarray) -> np.ndarray:
        """Distance of each point to the box of each leaf."""
        out = np.empty((len(points), len(self.low)))
        step = max(1, 2_000_000 // max(1, len(self.low) * DIMS))
        for a in range(0, len(points), step):
            p = points[a : a + step, None]
            gap = np.maximum(0, np.maximum(self.low - p, p - self.high))
            out[a : a + step] = np.sqrt((gap * gap).sum(2))
        return out


class Top:
    """The k best (score, smaller id first) candidates of each query."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.row = np.full((n, k), -1)
        self.k, self.least = k, least

    def put(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Candidates of some queries, a row for each; -inf is none."""
        if score.shape[1] > 4 * self.k:  # the best few first; ties at their end all stay
            cut_ = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            width = int((score >= cut_).sum(1).max())
            best = np.argpartition(-score, min(width, score.shape[1] - 1), axis=1)[:, :width] if width < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)
            score, ids, rows = (np.take_along_axis(np.broadcast_to(x, score.shape), best, 1) for x in (score, ids, rows))
        s, i, r = (np.concatenate(x, 1) for x in ((self.score[q], score), (self.id[q], np.broadcast_to(ids, score.shape)), (self.row[q], np.broadcast_to(rows, score.shape))))
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[q], self.id[q], self.row[q] = (np.take_along_axis(x, order, 1) for x in (s, i, r))

    def reach(self) -> np.ndarray:
        """Distance between unit vectors at the k-th score, or at ``least`` if that is greater; 2, the greatest, if there is none."""
        return np.sqrt(np.maximum(0, 2 - 2 * np.maximum(np.maximum(self.score[:, -1], self.least), -1)))


class Cell:
    """Rows of one cell or shard under a kd-tree; points are original vectors, ids their smallest ids, a row each (-1: none)."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, names: np.ndarray):
        self.points, self.ids, self.names = points, ids, names
        self.norm = np.sqrt((points * points).sum(1))
        projected = (points / self.norm[:, None]) @ projection(points.shape[1])
        self.tree = Tree(projected, LEAF)
        self.tree.low = np.array([projected[x].min(0) for x in self.tree.rows])
        self.tree.high = np.array([projected[x].max(0) for x in self.tree.rows])

    def search(self, queries: np.ndarray, own: np.ndarray, names: np.ndarray, least: np.ndarray, k: int, stop: float) -> tuple[Top, int]:
        """k best for each query (of those that reach ``least``), and how many vectors were verified; names are hashes of vectors."""
        norm = np.sqrt((queries * queries).sum(1))
        gaps = self.tree.gaps((queries / norm[:, None]) @ projection(queries.shape[1]))
        turns = np.argsort(gaps, axis=1, kind="stable")
        top = Top(len(queries), k, least)
        active, verified = np.arange(len(queries)), 0
        for t in range(len(self.tree.rows)):
            leaf = turns[active, t]
            go = gaps[active, leaf] <= top.reach()[active] * stop
            active, leaf = active[go], leaf[go]
            if not len(active):
                break
            for x in np.unique(leaf):
                q, rows = active[leaf == x], self.tree.rows[x]
                verified += len(q) * len(rows)
                score = queries[q] @ self.points[rows].T / (norm[q][:, None] * self.norm[rows])
                held = self.ids[rows]
                score = np.repeat(score, held.shape[1], axis=1)
                cand = held.ravel()
                score[:, cand == -1] = -np.inf
                same = np.flatnonzero(np.isin(names[q], self.names[rows]))
                for i in same.tolist():  # a query leaves out one row with its vector and id
                    mine = np.flatnonzero((cand == own[q[i]]) & np.repeat(self.names[rows] == names[q[i]], held.shape[1]))
                    score[i, mine[:1]] = -np.inf
                top.put(q, score, cand, np.repeat(rows, held.shape[1]))
        for i in range(k):  # the measure itself, whatever the order in which products were summed
            at = np.flatnonzero(np.isfinite(top.score[:, i]))
            row = top.row[at, i]
            top.score[at, i] = np.einsum("id,id->i", queries[at], self.points[row]) / (norm[at] * self.norm[row])
        return top, verified


class Directory:
    """Where the cells are: the upper tree, the box of each cell's rows, its number of shards."""

    def __init__(self, tree: Tree, shards: np.ndarray):
        self.tree, self.shards = tree, shards

    def order(self, projected: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of each query in growing distance, its own first, and the distances."""
        gaps = self.tree.gaps(projected)
        gaps[np.arange(len(gaps)), home] = -1
        turns = np.argsort(gaps, axis=1, kind="stable")
        return turns, np.take_along_axis(gaps, turns, 1)


def _clean(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<float> if it was, else array<double>) of the rows that take part."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    v = F.col("embedding") if single else F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", v.alias("embedding")).where("vec_id is not null and embedding is not null")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, certain: float = CERTAIN, told: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``vectors`` found for each row of ``queries`` (vec_id, embedding).

    ``told`` gets, for each length of vectors, the number of vectors verified in all and of rounds.
    """
    spark = vectors.sparkSession
    rows, asked = _clean(vectors), _clean(queries)
    widths = [r[0] for r in asked.select(F.size("embedding")).distinct().collect()]  # as many as there are models of vectors
    out = spark.createDataFrame([], RESULT)
    for width in sorted(widths):
        own = F.size("embedding") == width
        out = out.unionByName(_nearest(rows.where(own), asked.where(own), width, k, certain, told if told is not None else {}))
    return out


def _nearest(rows: DataFrame, queries: DataFrame, width: int, k: int, certain: float, told: dict) -> DataFrame:
    spark = rows.sparkSession
    total = rows.count()
    if not total:
        return spark.createDataFrame([], RESULT)
    kind = rows.schema["embedding"].dataType.simpleString()
    some = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / total))
    sample = rows.where(some).select("embedding").limit(2 * SAMPLE).toArrow()
    if not sample.num_rows:  # few different ids
        sample = rows.select("embedding").limit(SAMPLE).toArrow()
    points = _matrix(sample.column(0).combine_chunks(), width)
    upper = Tree(unit(points) @ projection(width), max(16, CELL * len(points) // total))
    cells = len(upper.rows)
    upper.rows = []
    stop = math.sqrt(chi_square_quantile(certain))
    sent = spark.sparkContext.broadcast(upper)
    verified = spark.sparkContext.accumulator(0)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = unit(_matrix(batch.column("embedding"), width)) @ projection(width)
                p = pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), DIMS).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.place(at), pa.int32()), p], names=[*batch.schema.names, "cell", "p"])

    # equal vectors once, with their k + 1 smallest ids; the limit in each map task comes before the shuffle
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    ids = rows.withColumn("n", nth).where(F.col("n") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    ids = ids.select("embedding", "ids", F.xxhash64("embedding").alias("name"))
    index = cut(ids.mapInArrow(placed, f"embedding {kind}, ids array<long>, name long, cell int, p array<double>"))
    sides = [f(F.get("p", F.lit(i))).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(DIMS)]
    boxes = index.groupBy("cell").agg(F.count("*").alias("n"), *sides).collect()  # a row for each cell
    low, high, shards = np.full((cells, DIMS), np.inf), np.full((cells, DIMS), np.inf), np.zeros(cells, np.int64)
    for r in boxes:
        low[r.cell], high[r.cell] = [r[f"min{i}"] for i in range(DIMS)], [r[f"max{i}"] for i in range(DIMS)]
        shards[r.cell] = -(-r.n // (2 * CELL))
    upper.low, upper.high = low, high  # empty cells are infinitely far
    where = spark.sparkContext.broadcast(Directory(upper, shards))
    dealt = F.pmod("name", F.element_at(F.array(*[F.lit(int(max(1, x))) for x in shards]), F.col("cell") + 1)).cast("int")
    null = lambda t: F.lit(None).cast(t)
    stored = index.select("cell", dealt.alias("shard"), F.lit(0).alias("side"), "embedding", "ids", "name", null("long").alias("vec_id"), null("double").alias("least"))

    same = queries.groupBy("vec_id", "embedding").agg(F.count("*").alias("times"))
    asked = cut(same.select("vec_id", "embedding", F.xxhash64("embedding").alias("name"), "times").mapInArrow(placed, f"vec_id long, embedding {kind}, name long, times long, cell int, p array<double>"))
    went = spark.sparkContext.accumulator(0)

    def visits(first: int, last: int):
        """The cells of a query at these places in its order that come nearer than its stopping radius, a row for each shard."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    if not part.num_rows:
                        continue
                    least = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                    least = np.where(np.isnan(least), -1.0, least)
                    turns, gaps = where.value.order(_matrix(part.column("p"), DIMS), part.column("cell").to_numpy(zero_copy_only=False))
                    near = gaps[:, first:last] <= (np.sqrt(np.maximum(0, 2 - 2 * least)) * stop)[:, None]
                    i, j = np.nonzero(near)
                    cell = turns[i, first + j]
                    n = where.value.shards[cell]
                    i, cell, shard = np.repeat(i, n), np.repeat(cell, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    if not len(i):
                        continue
                    went.add(len(i))
                    took = part.take(pa.array(i))
                    none = pa.nulls(len(i), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell, pa.int32()), pa.array(shard, pa.int32()), pa.array(np.ones(len(i)), pa.int32()), took.column("embedding"), none, took.column("name"), took.column("vec_id"), pa.array(least[i])],
                        names=["cell", "shard", "side", "embedding", "ids", "name", "vec_id", "least"],
                    )

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell and shard first its rows, then the queries, which stream past them."""
        at, held, cell = None, [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "shard", "side")], 1)
            edge = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]).any(1), [True]))) if len(place) else np.zeros(1, int)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if tuple(place[a, :2]) != at:
                    at, held, cell = tuple(place[a, :2]), [], None
                part = batch.slice(a, b - a)
                if place[a, 2] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if cell is None:
                    ids_ = [x for p in held for x in p.column("ids").to_pylist()]
                    table_ = np.full((len(ids_), k + 1), -1, np.int64)
                    for n, x in enumerate(ids_):
                        table_[n, : len(x)] = x
                    cell = Cell(np.concatenate([_matrix(p.column("embedding"), width) for p in held]), table_, np.concatenate([p.column("name").to_numpy() for p in held]))
                for c in range(0, part.num_rows, BLOCK):
                    block = part.slice(c, BLOCK)
                    own, name, least = (block.column(x).to_numpy(zero_copy_only=False) for x in ("vec_id", "name", "least"))
                    top, n = cell.search(_matrix(block.column("embedding"), width), own, name, least, k, stop)
                    verified.add(n)
                    q, j = np.nonzero(np.isfinite(top.score) & (top.score >= least[:, None] - 1e-9))
                    yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(name[q]), pa.array(top.id[q, j]), pa.array(top.score[q, j])], names=["query_id", "name", "vec_id", "score"])

    hits = spark.createDataFrame([], "query_id long, name long, vec_id long, score double")
    first, last, rounds = 0, 1, 0
    while first < cells:
        worst = hits.groupBy("query_id", "name").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        state = asked.join(worst.withColumnRenamed("query_id", "vec_id"), ["vec_id", "name"], "left")
        state = state.select("vec_id", "embedding", "name", "cell", "p", "least")
        before = went.value
        moved = state.mapInArrow(visits(first, last), f"cell int, shard int, side int, embedding {kind}, ids array<long>, name long, vec_id long, least double")
        both = stored.unionByName(moved)
        fresh = both.repartition(2 * partitions(spark), "cell", "shard").sortWithinPartitions("cell", "shard", "side").mapInArrow(search, "query_id long, name long, vec_id long, score double")
        best = F.row_number().over(Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "vec_id"))
        hits = cut(hits.unionByName(fresh).withColumn("rank", best).where(F.col("rank") <= k).drop("rank"))
        rounds += 1
        if went.value == before:  # no query has a cell left within its radius
            break
        first, last = last, last + STEP**rounds
    told[width] = {"verified": verified.value, "rounds": rounds, "rows": total, "cells": cells}
    rank = F.row_number().over(Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "vec_id"))
    out = hits.withColumn("rank", rank).join(asked.select(F.col("vec_id").alias("query_id"), "name", "times"), ["query_id", "name"])
    return out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nearest`` of all embeddings for those whose vec_id is divisible by 50; nulls, repeats and scale as the module says."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
