"""Substring dedup by super-k-mer partitioning.

Consecutive windows of ``k`` words that share a minimiser (the smallest hash of GRAM neighbouring words in the
window) travel as one packed string to the bucket of that minimiser, so equal windows always meet there.  The
bucket sorts its windows, compares equal neighbours word by word and knows for each window the smallest doc_id
it starts in; a window is a repeat in every document with a larger doc_id.  Covered words are removed.

Scale.  A first pass counts the windows of each minimiser; those of HEAVY_WINDOWS windows or more (a frequent phrase, a
passage in a third of all documents) are heavy and never share a bucket: their windows travel one by one under a 128-bit hash of
their words, once for a slice of input, the least doc_id of a window is an aggregate with partial sums, and the answer is joined back to
the slices, salted.  So a bucket holds about BUCKET_BYTES and less than one heavy minimiser more, however large the corpus is.
The heavy ones that are broadcast are at most 2 * HEAVY_MOST numbers: HEAVY_WINDOWS grows where the corpus would have more.  One
shuffle carries the packed strings, compressed per bucket; one joins the repeats (intervals of word positions) to the texts.

Defined results.  Null and empty texts have no words, n_removed 0 and the hash of the empty string.  Rows with a
null doc_id are neither changed nor counted.  Rows that repeat a doc_id are judged each on its own text (told apart by xxhash64); a
window of theirs is a repeat only if a smaller doc_id has it.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import text as tx
from fathom.llm.tables import arrow_batches, cut, partitions, table

K = 13
#: Words of a minimiser.
GRAM = 4
#: Packed bytes that one bucket should hold.
BUCKET_BYTES = 8 << 20
#: Tasks that the buckets are dealt to at most; a task holds one bucket at a time.
TASKS_MOST = 200_000
#: Windows of one minimiser that make it heavy, about an eighth of a bucket; and how many heavy ones there may be, about.
HEAVY_WINDOWS, HEAVY_MOST = 50_000, 1 << 22
#: Ways that the slices of a heavy window are dealt to the join with its answer.
SALT = 32
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _super_kmers(w: tx.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each super-k-mer: text index, first word, number of words, minimiser."""
    at = np.flatnonzero(np.arange(w.n) + k <= np.repeat(w.first[1:], w.counts()))
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    gram = min(GRAM, k)
    span, width = tx.rolling(w.hashed(), gram), 1
    want = k - gram + 1
    while width * 2 <= want:
        span = np.minimum(span[:-width], span[width:])
        width *= 2
    if width < want:
        shift = want - width
        span = np.minimum(span[:-shift], span[shift:])
    low, doc = span[at], w.doc()[at]
    run = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]))))
    return doc[run], at[run], np.diff(np.concatenate((run, [len(at)]))) + k - 1, low[run]


def _windows(k: int, least: int):
    """Windows of each minimiser; of a task only those with ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            low, n = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            order = np.argsort(low)
            head = np.flatnonzero(np.concatenate(([True], low[order][1:] != low[order][:-1])))
            return low[order][head], np.add.reduceat(n[order], head)

        def out(low: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(low[n >= least].view(np.int64)), pa.array(n[n >= least])], names=["low", "n"])

        for _, texts in tx.chunks(batches, "text"):
            _, _, words, low = _super_kmers(tx.words_of(texts), k)
            if len(low):
                held.append((low, words - k + 1))
                size += len(low)
            if size > 3_000_000:
                held = [summed()]
                size = len(held[0][0])
                if size > 1_500_000:  # the sum of what a task reports in turns is less by what no turn reports
                    yield out(*held[0])
                    held, size = [], 0
        if held:
            yield out(*summed())

    return run


def heavy_minimisers(rows: DataFrame, k: int, total: int, tasks: int) -> np.ndarray:
    """Sorted minimisers of about HEAVY_WINDOWS windows or more.  A minimiser of so many has a share of 1 / tasks of them in some task."""
    bound = max(HEAVY_WINDOWS, total // (2 * HEAVY_MOST))
    counted = rows.select("text").mapInArrow(_windows(k, max(1, bound // (2 * tasks))), "low long, n long")
    found = counted.groupBy("low").agg(F.sum("n").alias("n")).where(F.col("n") >= bound // 2).select("low").toArrow()  # at most 2 * HEAVY_MOST
    return np.sort(found.column(0).to_numpy().view(np.uint64))


_SENT = pa.schema([("bucket", pa.int32()), ("name", pa.binary()), ("least", pa.int64()), ("most", pa.int64()), ("blob", pa.binary())])
_SENT_SQL = "bucket int, name binary, least long, most long, blob binary"


def _pack(ids: np.ndarray, keys: np.ndarray, pos: np.ndarray, words: np.ndarray, body: bytes, z: zstandard.ZstdCompressor) -> bytes:
    head = struct.pack("<i", len(pos)) + np.diff(ids, prepend=0).astype("<i8").tobytes() + keys.astype("<i8").tobytes()
    return z.compress(head + pos.astype("<i4").tobytes() + words.astype("<i4").tobytes() + body)


def _unpack(blob: bytes, z: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    data = z.decompress(blob)
    (n,) = struct.unpack_from("<i", data)
    at, out = 4, []
    for kind, size in (("<i8", 8), ("<i8", 8), ("<i4", 4), ("<i4", 4)):
        out.append(np.frombuffer(data, kind, n, at))
        at += size * n
    out[0] = np.cumsum(out[0])
    return (*out, data[at:])


def _send(k: int, n_buckets: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        known = heavy.value
        for batch, texts in tx.chunks(batches, "text", 4 << 20):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            w = tx.words_of(texts)
            doc, first, words, low = _super_kmers(w, k)
            if not len(doc):
                continue
            whole = w.buf.tobytes()
            rows: list[tuple[int, bytes | None, int | None, int | None, bytes]] = []
            alone = known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low if len(known) else np.zeros(len(low), bool)
            if alone.any():  # each window by itself, once for this slice of input
                per = words[alone] - k + 1
                at = np.repeat(first[alone], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                who = np.repeat(doc[alone], per)
                value = tx.rolling(w.hashed(), k)[at]
                order = np.lexsort((ids[who], value))
                at, who, value = at[order], who[order], value[order]
                edge = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1], [True])))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    name = xxhash.xxh3_128_digest(whole[w.off[at[a]] : w.off[at[a] + k]])
                    own = who[a:b]
                    least, most = int(ids[own[0]]), int(ids[own[-1]])
                    blob = _pack(ids[own], keys[own], at[a:b] - w.first[own], np.full(b - a, k), b"", z)
                    rows.append((xxhash.xxh3_64_intdigest(name + struct.pack("<q", least)) % n_buckets, name, least, most, blob))
            left = np.flatnonzero(~alone)
            bucket = (tx.mix(low ^ _SALT) % np.uint64(n_buckets)).astype(np.int64)
            left = left[np.argsort(bucket[left], kind="stable")]
            edge = np.flatnonzero(np.concatenate(([True], bucket[left][1:] != bucket[left][:-1], [True]))) if len(left) else np.zeros(1, np.int64)
            lo, hi = w.off[first[left]].tolist(), w.off[first[left] + words[left]].tolist()
            pos = first - w.first[doc]
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = left[a:b]
                body = b"".join([whole[s:e] for s, e in zip(lo[a:b], hi[a:b], strict=True)])
                rows.append((int(bucket[part[0]]), None, None, None, _pack(ids[doc[part]], keys[doc[part]], pos[part], words[part], body, z)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)

    return run


_FOUND = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("name", pa.binary()), ("least", pa.int64()), ("most", pa.int64()), ("data", pa.binary())])
_FOUND_SQL = "doc_id long, key long, name binary, least long, most long, data binary"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)


def _covered(ids: np.ndarray, keys: np.ndarray, start: np.ndarray, k: int) -> Iterator[tuple]:
    """Intervals of words that repeated windows cover, a row for each text."""
    order = np.lexsort((start, keys, ids))
    ids, keys, start = ids[order], keys[order], start[order]
    other = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    new = np.concatenate(([True], other | (start[1:] > start[:-1] + k)))
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(start)])) - 1
    pairs = np.stack((start[head], start[tail] + k), 1).astype("<i4")
    text = np.flatnonzero(np.concatenate(([True], other))[head])
    for a, b in zip(text.tolist(), [*text[1:].tolist(), len(pairs)], strict=True):
        yield int(ids[head[a]]), int(keys[head[a]]), None, None, None, pairs[a:b].tobytes()


def _count(blobs: list[bytes], k: int, z: zstandard.ZstdDecompressor) -> Iterator[tuple]:
    """Sort the windows of one bucket and report the repeats."""
    parts = [_unpack(b, z) for b in blobs]
    ids, keys, pos, words = (np.concatenate([p[i] for p in parts]) for i in range(4))
    w = tx.from_packed(b"".join(p[4] for p in parts))
    del parts
    codes = w.codes()
    start = np.concatenate(([0], np.cumsum(words[:-1], dtype=np.int64)))
    per = words.astype(np.int64) - k + 1
    owner = np.repeat(np.arange(len(words)), per)
    inside = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(per[:-1]))), per)
    at = start[owner] + inside
    value = tx.rolling(w.hashed(), k)[at]
    order = np.argsort(value, kind="stable")
    same = np.flatnonzero(value[order][1:] == value[order][:-1])
    cols = np.arange(k)
    step = 200_000
    for a in range(0, len(same), step):
        x, y = at[order[same[a : a + step]]], at[order[same[a : a + step] + 1]]
        if (codes[x[:, None] + cols] != codes[y[:, None] + cols]).any():  # two windows with one hash: sort by the words themselves
            order = np.lexsort(tuple(codes[at + j] for j in range(k - 1, -1, -1)))
            value = np.zeros(len(at), np.int64)
            rows = codes[at[order][:, None] + cols]
            value[order] = np.concatenate(([0], np.cumsum((rows[1:] != rows[:-1]).any(1))))
            break
    new = np.flatnonzero(np.concatenate(([True], value[order][1:] != value[order][:-1])))
    least = np.empty(len(at), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[owner[order]], new), np.diff(np.concatenate((new, [len(at)]))))
    again = np.flatnonzero(least < ids[owner])
    if len(again):
        o = owner[again]
        yield from _covered(ids[o], keys[o], pos[o] + inside[again], k)


def _buckets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        held: list[bytes] = []
        at = None
        for batch in batches:
            out: list[tuple] = []
            for bucket, *heavy, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if heavy[0] is not None:  # a window of a heavy minimiser only passes through
                    out.append((None, None, *heavy, blob))
                    continue
                if bucket != at and held:
                    out += _count(held, k, z)
                    held = []
                at = bucket
                held.append(blob)
            if out:
                yield _found(out)
        if held and (out := list(_count(held, k, z))):
            yield _found(out)

    return run


def _released(k: int):
    """Repeats among the slices of heavy windows: those in documents beyond the least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            parts = []
            for blob, least in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, keys, pos, *_ = _unpack(blob, z)
                later = ids > least
                parts.append((ids[later], keys[later], pos[later]))
            ids, keys, pos = (np.concatenate([p[i] for p in parts]) for i in range(3)) if parts else (np.zeros(0, np.int64),) * 3
            if len(ids):
                yield _found(list(_covered(ids, keys, pos, k)))

    return run


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.large_string())])


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text, compressed for the shuffle to its intervals."""
    z = zstandard.ZstdCompressor(level=3)
    for batch, texts in tx.chunks(batches, "text"):
        w = tx.words_of(texts)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([z.compress(w.joined(d)) for d in range(len(texts))], pa.binary()), batch.column(2)], names=["doc_id", "text", "key"])


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch, texts in tx.chunks(batches, "text", 1 << 20):
            w = tx.words_of([z.decompress(t) for t in texts])
            counts = w.counts().tolist()
            removed, sha, kept = [], [], []
            for d, found in enumerate(batch.column(2).to_pylist()):
                data = w.joined(d)
                gone = 0
                if found:
                    drop = np.zeros(counts[d] + 1, np.int32)
                    pairs = np.frombuffer(b"".join(found), "<i4").reshape(-1, 2)
                    np.add.at(drop, pairs[:, 0], 1)
                    np.add.at(drop, pairs[:, 1], -1)
                    stay = np.cumsum(drop[:-1]) == 0
                    gone = int(len(stay) - stay.sum())
                    a = w.first[d]
                    size = np.diff(w.off[a : w.first[d + 1] + 1])
                    data = w.buf[w.off[a] : w.off[w.first[d + 1]]][np.repeat(stay, size)].tobytes()[:-1]
                removed.append(gone)
                sha.append(hashlib.sha256(data).hexdigest())
                kept.append(data if with_text else None)
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept, pa.large_binary()).cast(pa.large_string())]
            yield pa.RecordBatch.from_arrays(arrays[: 4 + with_text], schema=pa.schema(list(_KEPT)[: 4 + with_text]))

    return run


def repeated_words(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, key, found): for texts with repeats, lists of word intervals; key is a hash of the text, for rows that share a doc_id."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).where("doc_id is not null and text is not null")
    sizes = docs.select(F.octet_length("text").alias("n"), F.spark_partition_id().alias("task")).groupBy("task").agg(F.sum("n").alias("n"))
    total, tasks = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    heavy = spark.sparkContext.broadcast(heavy_minimisers(rows, k, total, max(1, tasks)))
    tasks = max(partitions(spark), min(-(-3 * total // (8 * BUCKET_BYTES)), TASKS_MOST))
    n_buckets = tasks * max(1, -(-3 * total // (tasks * BUCKET_BYTES)))  # as many for each task
    sent = rows.mapInArrow(_send(k, n_buckets, heavy), _SENT_SQL)
    with arrow_batches(spark, "8m"):
        found = cut(sent.repartitionById(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_buckets(k), _FOUND_SQL))
    waiting = found.where("name is not null").withColumn("salt", F.pmod(F.xxhash64("data"), F.lit(SALT)).cast("int"))
    answers = waiting.groupBy("name").agg(F.min("least").alias("first"), F.max("most").alias("last")).where("first < last")
    answers = answers.select("name", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    freed = waiting.join(answers, ["name", "salt"]).where("first < most").select("data", "first").mapInArrow(_released(k), _FOUND_SQL)
    both = found.where("name is null").unionByName(freed)
    return both.groupBy("doc_id", "key").agg(F.collect_list("data").alias("found"))


def substring_dedup(docs: DataFrame, k: int = K, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) of each row of ``docs``."""
    found = repeated_words(docs, k)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(_squeezed, "doc_id long, text binary, key long")
    joined = rows.join(found, ["doc_id", "key"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_kept(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``substring_dedup`` of all documents; nulls, repeats and scale as the module says."""
    return substring_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i:i+12], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), least AS (
  SELECT h, min(doc_id) AS d FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT win.doc_id, win.i + j AS p
  FROM win JOIN least USING (h), unnest(range(0, 13)) AS t(j)
  WHERE least.d < win.doc_id
), word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
