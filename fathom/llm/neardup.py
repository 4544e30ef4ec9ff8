"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A text is the multiset of its shingles of five words (a text of one to four words is one shingle).  The weight of
a shingle is its frequency in the text times 1 + idf, where idf is the mean over its words of log(N/df) / log(THETA),
held between 0 and 1 and rounded to fifteenths.  The idf is damped to one octave on purpose: an undamped one makes
the few edited words of a copy outweigh everything that the copies of a large group share, and loses them.

Occurrence j of a shingle is an element of its own, so the weighted Jaccard similarity of two texts is a sum over
common elements over a sum over all, in whole numbers.  Each of BANDS * ROWS samples is the element with the
least a = c / (y e^r) of consistent weighted sampling; (r, c, beta) come from 65,536 drawn triples that a hash of
the element picks, and a table holds ln a for each triple and weight.  ROWS samples make a band key.

Scale.  Equal texts become one representative first.  Only (band, id) rows are shuffled to find shared bands; then
the texts of representatives that share one travel, compressed, once to all bands with the same members.  Their task computes exact
similarities of its members and returns a spanning forest of the links >= THRESHOLD, so at most one row for a member.

A band of more than BLOCK texts or CELL_BYTES is crowded.  Its members are dealt into blocks, each also with the same PIVOTS members
or so, whatever the number of blocks: a group of near copies hangs together by its pivots, and costs what its members cost.  Where a
crowded band still holds several components, all members outside its largest one (strays) are compared with all its members, blocks of the ones with
blocks of the others, however many they are.  So no link is lost to a crowd, and work is quadratic only in the strays of a crowded band.

Classes are connected components (alternating large-star and small-star, cut in the shared folder each round).  The document frequencies
of all documents are counted; words in fewer than one in THETA documents all have the greatest idf, so only the others' matter.  If these are no more than
IDF_MOST they are broadcast; if they are more, the weights of its own words are joined to each text and travel with it.

Defined results.  Null, empty and wordless texts are alone: class_id is their own doc_id.  Rows with one word
sequence, and rows repeated, share a class.  A null doc_id cannot name a class: such rows take the least doc_id of
their class, or null.  Texts are compared whatever their doc_ids: different texts under one doc_id can be in different classes.
Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import text as tx
from fathom.llm.tables import arrow_batches, cut, partitions, spare, table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
#: Words in fewer than one in THETA documents have the greatest idf.
THETA = 1000
#: So many idf values are broadcast at most (16 bytes each).
IDF_MOST = 4_000_000
#: Texts of one band that a task compares, and their bytes, about; pivots of a crowded band, about.
BLOCK, CELL_BYTES, PIVOTS = 500, 4 << 20, 16
LEVELS = 16
#: The greatest idf of a word, in whole numbers.
UNIT = 3000
_TRIPLES = 1 << 16


def _ln_a() -> np.ndarray:
    """ln a of consistent weighted sampling for each weight level and triple, as sortable uint32."""
    rng = np.random.default_rng(20240817)
    r = rng.gamma(2.0, 1.0, _TRIPLES)
    c = rng.gamma(2.0, 1.0, _TRIPLES)
    beta = rng.random(_TRIPLES)
    weight = 1 + np.arange(LEVELS)[:, None] / (LEVELS - 1)
    t = np.floor(np.log(weight) / r + beta)
    bits = (np.log(c) - r * (t - beta) - r).astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64).ravel() << np.uint64(32)


def _factors() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _level(total: np.ndarray, words) -> np.ndarray:
    """The mean idf of so many words in fifteenths, in whole numbers so that it never depends on the place in a text."""
    return (2 * total * (LEVELS - 1) + words * UNIT) // (2 * words * UNIT)


class Idf:
    """idf of the words in at least one in THETA documents, by hash; other words have UNIT."""

    def __init__(self, words: np.ndarray, values: np.ndarray):
        order = np.argsort(words)
        self.words, self.values = words[order], values[order]

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), UNIT, np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.values[at], UNIT)


def elements(w: tx.Words, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Elements in the order of texts: text index, element (low four bits: its weight level)."""
    counts = w.counts()
    h = w.hashed()
    total = np.concatenate(([0], np.cumsum(idf.of(h))))
    at = np.flatnonzero(np.arange(w.n) + SHINGLE <= np.repeat(w.first[1:], counts))
    rolled = tx.rolling(h, SHINGLE)
    shingle, owner = rolled[at] if len(at) else np.zeros(0, np.uint64), w.doc()[at]
    level = _level(total[at + SHINGLE] - total[at], SHINGLE)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        a, b = w.first[short], w.first[short + 1]
        shingle = np.concatenate((shingle, np.fromiter((xxhash.xxh3_64_intdigest(w.joined(d)) for d in short.tolist()), np.uint64, len(short))))
        level = np.concatenate((level, _level(total[b] - total[a], b - a)))
        owner = np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        shingle, owner, level = shingle[order], owner[order], level[order]
    with np.errstate(over="ignore"):
        again = np.flatnonzero(pd.Series(shingle + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).duplicated(keep=False).to_numpy())
        if len(again):  # the later occurrences of a shingle in a text are elements of their own
            again = again[np.lexsort((shingle[again], owner[again]))]
            x, y = shingle[again], owner[again]
            head = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
            nth = np.arange(len(again)) - np.repeat(head, np.diff(np.concatenate((head, [len(again)]))))
            later = nth > 0
            shingle[again[later]] = tx.mix(x[later] + nth[later].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return owner, (shingle & np.uint64(0xFFFFFFFFFFFFFFF0)) | level.astype(np.uint64)


_TABLE: list = []


def samples(owner: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with elements, and their band keys (text, BANDS)."""
    if not _TABLE:
        _TABLE.extend((_ln_a(), _factors()))
    ln_a, factors = _TABLE
    head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    row = (element & np.uint64(15)) << np.uint64(16)
    keys = np.zeros((len(head), BANDS), np.uint64)
    low = np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            u = element * factors[k]
            u ^= u >> np.uint64(31)
            u *= np.uint64(0x94D049BB133111EB)
            a = ln_a[(row | (u >> np.uint64(48))).astype(np.int64)]
            a |= u & low
            band = k // ROWS
            keys[:, band] = keys[:, band] * np.uint64(0x9E3779B97F4A7C15) + tx.mix(np.minimum.reduceat(a, head) + np.uint64(k))
        return owner[head], tx.mix(keys + np.arange(BANDS, dtype=np.uint64))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each word, summed over a partition as far as memory allows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        words, n = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
        order = np.argsort(words)
        words = words[order]
        head = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        return words[head], np.add.reduceat(n[order], head)

    def out() -> pa.RecordBatch:
        words, n = summed()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "df"])

    for _, texts in tx.chunks(batches, "text"):
        w = tx.words_of(texts)
        if not w.n:
            continue
        h = w.hashed()
        with np.errstate(over="ignore"):
            once = ~pd.Series(h + w.doc().astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).duplicated().to_numpy()
        held.append((h[once], np.ones(int(once.sum()), np.int64)))
        size += len(held[-1][0])
        if size > 3_000_000:
            held = [summed()]
            size = len(held[0][0])
            if size > 1_500_000:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def inverse_frequencies(docs: DataFrame) -> DataFrame:
    """(word, idf) of the words in at least one in THETA documents."""
    n = docs.count()
    counted = docs.select("text").mapInArrow(_frequencies, "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
    share = F.log(F.lit(float(n)) / F.col("df")) / math.log(THETA)
    value = F.rint(UNIT * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).cast("int")
    return cut(counted.where(F.col("df") * THETA >= n).select("word", value.alias("idf")))


def _own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, word) of the different words of each text."""
    for batch, texts in tx.chunks(batches, "text", 1 << 20):
        w = tx.words_of(texts)
        h, owner = w.hashed(), w.doc()
        with np.errstate(over="ignore"):
            once = ~pd.Series(h + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).duplicated().to_numpy()
        at = pa.array(owner[once])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(h[once].view(np.int64))], names=["doc_id", "key", "word"])


def _weighed(rows: DataFrame) -> tuple[DataFrame, Idf]:
    """``rows`` (doc_id, text, key) with own, and the idf of words: in the table, or in own (the words and idf of a text) where they are too many."""
    values = inverse_frequencies(rows)
    if values.count() <= IDF_MOST:
        words, idf = (x.to_numpy() for x in values.toArrow().columns)
        return rows.withColumn("own", F.lit(None).cast(_OWN)), Idf(words.view(np.uint64), idf.astype(np.int64))
    own = rows.mapInArrow(_own_words, "doc_id long, key long, word long").distinct().join(values, "word")
    own = own.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_text")).agg(F.collect_list("word").alias("words"), F.collect_list("idf").alias("idf"))
    own = own.select("_doc", "_text", F.struct("words", "idf").alias("own"))
    joined = rows.join(own, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_text")), "left")
    return cut(joined.select("doc_id", "text", "key", "own")), Idf(np.zeros(0, np.uint64), np.zeros(0, np.int64))


_OWN = "struct<words:array<bigint>,idf:array<int>>"


def _known(idf: Idf, own: list[tuple[list[int], list[int]] | None]) -> Idf:
    """The broadcast idf, or that which came with the texts."""
    lists = [x for x in own if x]
    if not lists:
        return idf
    words, at = np.unique(np.concatenate([np.array(w, np.int64) for w, _ in lists]), return_index=True)
    return Idf(words.view(np.uint64), np.concatenate([np.array(v, np.int64) for _, v in lists])[at])


def _pairs_of(column: pa.Array) -> list[tuple[list[int], list[int]] | None]:
    return [x and (x["words"], x["idf"]) for x in column.to_pylist()]


_SIGNED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("words", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _signed(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tx.chunks(batches, "text"):
            w = tx.words_of(texts)
            counts = w.counts()
            has, keys = samples(*elements(w, _known(idf.value, _pairs_of(batch.column("own"))))) if w.n else (np.zeros(0, np.int64), np.zeros((0, BANDS), np.uint64))
            bands: list = [None] * len(texts)
            for d, k in zip(has.tolist(), keys.astype(np.int64).tolist(), strict=True):
                bands[d] = k
            names = [xxhash.xxh3_128_digest(w.joined(d)) if counts[d] else None for d in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.binary()), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(bands, _SIGNED.field("bands").type)], schema=_SIGNED)

    return run


_SENT = pa.schema([("cell", pa.int64()), ("id", pa.int64()), ("body", pa.binary()), ("own", pa.struct([("words", pa.list_(pa.int64())), ("idf", pa.list_(pa.int32()))]))])


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text, compressed, to its cells; of repeated rows, which come one after the other, one."""
    z = zstandard.ZstdCompressor(level=3)
    before = None
    for batch, texts in tx.chunks(batches, "text", 1 << 20):
        w = tx.words_of(texts)
        cells, ids, bodies, at = [], [], [], []
        for d, (i, to) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if i == before:
                continue
            before = i
            body = z.compress(w.joined(d))
            cells += to
            ids += [i] * len(to)
            bodies += [body] * len(to)
            at += [d] * len(to)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(ids, pa.int64()), pa.array(bodies, pa.binary()), batch.column("own").take(pa.array(at, pa.int64())).cast(_SENT.field("own").type)], schema=_SENT)


def _links(ids: np.ndarray, bodies: list[bytes], idf: Idf, threshold: float) -> Iterator[tuple[int, int, float]]:
    """A spanning forest of the pairs of texts whose weighted Jaccard similarity reaches the threshold."""
    z = zstandard.ZstdDecompressor()
    owner, element = elements(tx.words_of([z.decompress(b) for b in bodies]), idf)
    m = len(ids)
    weight = LEVELS - 1 + (element & np.uint64(15)).astype(np.int64)
    total = np.bincount(owner, weight, m)
    order = np.argsort(element, kind="stable")
    element, owner, weight = element[order], owner[order], weight[order]
    head = np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1])))
    df = np.diff(np.concatenate((head, [len(element)])))
    both = np.zeros(m * m)
    dense = df > max(8, m // 16)
    for n in np.unique(df[(df > 1) & ~dense]).tolist():  # elements of few texts: add their pairs
        at = head[df == n]
        step = max(1, 2_000_000 // (n * n))
        for a in range(0, len(at), step):
            texts = owner[at[a : a + step, None] + np.arange(n)]
            pair = texts[:, :, None] * m + texts[:, None, :]
            both += np.bincount(pair.ravel(), np.repeat(weight[at[a : a + step]], n * n), m * m)
    both = both.reshape(m, m).astype(np.float32)
    keep = np.repeat(dense, df)  # elements of many: multiply their columns
    column, owner, weight = np.repeat(np.cumsum(dense) - 1, df)[keep], owner[keep], weight[keep]
    width = max(256, 4_000_000 // m)
    for at in range(0, int(dense.sum()), width):
        a, b = np.searchsorted(column, (at, at + width))
        x = np.zeros((m, min(width, int(dense.sum()) - at)), np.float32)
        x[owner[a:b], column[a:b] - at] = np.sqrt(weight[a:b].astype(np.float32))
        both += x @ x.T
    both = np.rint(both)
    both /= total[:, None] + total[None, :] - both
    np.fill_diagonal(both, 0)
    free = np.ones(m, bool)
    for root in range(m):
        if not free[root]:
            continue
        free[root] = False
        front = [root]
        while front:
            u = front.pop()
            near = np.flatnonzero(free & (both[u] >= threshold - 1e-6))
            free[near] = False
            for v in near.tolist():
                yield int(ids[u]), int(ids[v]), float(both[u, v])
            front += near.tolist()


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def _verify(idf, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        at = None

        def out() -> list[tuple]:
            if len(held) < 2:
                return []
            ids = np.array(sorted(held), np.int64)
            bodies, own = zip(*(held[i] for i in ids.tolist()), strict=True)
            return list(_links(ids, list(bodies), _known(idf.value, list(own)), threshold))

        def table_of(rows: list[tuple]) -> pa.RecordBatch:
            a, b, s = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], schema=_EDGE)

        for batch in batches:
            for cell, i, body, own in zip(*(batch.column(c).to_pylist() for c in ("cell", "id", "body")), _pairs_of(batch.column("own")), strict=True):
                if cell != at:
                    if rows := out():
                        yield table_of(rows)
                    held, at = {}, cell
                held[i] = (body, own)
        if rows := out():
            yield table_of(rows)
        held = {}
        tx.released()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, class_id) for every end of an edge (a, b) but the least of its connected component, which is class_id."""
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        pairs = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark:
            return pairs.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("class_id"))
        mark = now


def _crowds(groups: DataFrame) -> DataFrame:
    """``groups`` (group, id, root, size) that hold several components, with stray (not of the largest), blocks and stray_blocks."""
    per = groups.groupBy("group", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    most = F.max_by("root", F.struct("n", "root")).alias("main")
    whole = per.groupBy("group").agg(most, F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("size").alias("bytes"), F.max("n").alias("largest"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / CELL_BYTES)).alias("blocks")
    strays = F.col("n") - F.col("largest")
    whole = whole.where("roots > 1").select("group", "main", blocks, F.ceil(F.greatest(strays / BLOCK, F.col("bytes") / F.col("n") * strays / CELL_BYTES)).alias("stray_blocks"))
    return groups.join(whole, "group").withColumn("stray", F.col("root") != F.col("main"))


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, key, root, class_id) of each row; key is xxhash64 of the text, root names the class, whatever its doc_ids, and is
    null for texts without words."""
    spark = docs.sparkSession
    rows, known = _weighed(docs.select("doc_id", "text", F.xxhash64("text").alias("key")))
    idf = spark.sparkContext.broadcast(known)
    with arrow_batches(spark, "8m"):
        signed = cut(rows.mapInArrow(_signed(idf), "doc_id long, key long, words binary, size long, bands array<long>"))
    signed = signed.withColumn("id", F.when(F.col("words").isNotNull(), F.xxhash64("words")))  # a vertex is a word sequence
    groups = signed.where("id is not null").groupBy("id")
    reps = groups.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "size", "bands")).alias("r"))
    reps = cut(reps.select("id", "r.doc_id", "r.key", "r.size", "r.bands"))
    banded = reps.select("id", "size", F.explode("bands").alias("band"))
    # bands with the same members have the same cell: counts and sums of two hashes of ids name a set of them
    name = F.xxhash64(F.count("*"), F.bit_xor(F.xxhash64("id")), F.sum(F.shiftright(F.xxhash64("id", F.lit(1)), 20)))
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), name.alias("group")).where("n > 1")
    shared = shared.withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / CELL_BYTES)))
    met = cut(banded.join(shared, "band"))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    draw = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks"))

    def compared(cells: DataFrame) -> DataFrame:
        """Links inside cells, from (id, cell)."""
        meets = cells.groupBy("id").agg(F.collect_set("cell").alias("cells"))
        meets = meets.join(reps.select("id", F.col("doc_id").alias("rep"), F.col("key").alias("rep_key")), "id")
        sent = rows.join(meets, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("key") == F.col("rep_key"))).select("id", "text", "cells", "own")
        dealt = sent.mapInArrow(_send, f"cell long, id long, body binary, own {_OWN}").repartition(2 * partitions(spark), "cell").sortWithinPartitions("cell")
        with arrow_batches(spark, "4m"):
            return cut(dealt.mapInArrow(_verify(idf, threshold), "a long, b long, similarity double"))

    pivot = (F.col("blocks") > 1) & (draw(2) * F.col("n") < PIVOTS * (1 << 30))
    cell = F.when(pivot, F.transform(numbers(F.col("blocks")), lambda j: F.xxhash64("group", j))).otherwise(F.array(F.xxhash64("group", mine)))
    links = compared(met.select("id", F.explode(cell).alias("cell")))
    joined = components(links)
    hot = met.where("blocks > 1")
    if not hot.isEmpty():
        crowded = hot.groupBy("group", "id").agg(F.min("size").alias("size"))
        crowded = crowded.join(joined, "id", "left").select("group", "id", F.coalesce("class_id", "id").alias("root"), "size")
        still = cut(_crowds(crowded))
        if not still.isEmpty():
            own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("stray_blocks"))
            as_member = F.transform(numbers(F.col("stray_blocks")), lambda s: F.xxhash64("group", s, mine))
            as_stray = F.transform(numbers(F.col("blocks")), lambda j: F.xxhash64("group", own, j))
            links = links.unionByName(compared(still.select("id", F.explode(F.when(F.col("stray"), F.array_union(as_member, as_stray)).otherwise(as_member)).alias("cell"))))
            joined = components(links)
    known = reps.select("id", "doc_id").join(joined, "id", "left").select("id", "doc_id", F.coalesce("class_id", "id").alias("root"))
    known = cut(known)
    least = known.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    known = known.join(least.where("n > 1").drop("n"), "root", "left").select("id", "root", F.coalesce("class_id", "doc_id").alias("class_id"))
    out = signed.where("id is not null").join(known, "id").select("doc_id", "key", "root", "class_id")
    alone = signed.where("id is null").select("doc_id", "key", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"))
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, key, class_id) of each row; key is xxhash64 of the text."""
    return _classes(docs, threshold).select("doc_id", "key", "class_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: a text of the least doc_id of each class stays, once; one with a null doc_id
    stays if its class has no other."""
    classes = cut(_classes(docs, threshold))
    one = classes.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("r"))
    stay = one.select("r.doc_id", "r.key").unionByName(classes.where("root is null").select("doc_id", "key").distinct())
    own, stays, told = spare(docs, "_key", "_stay", "_id")
    stay = stay.select(F.col("doc_id").alias(told), F.col("key").alias(stays))
    first = docs.withColumn(own, F.xxhash64("text")).join(stay, F.col("doc_id").eqNullSafe(F.col(told)) & (F.col(own) == F.col(stays)), "left_semi")
    return first.dropDuplicates(["doc_id", own]).select(docs.columns)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all documents; nulls, repeats and scale as the module says."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
