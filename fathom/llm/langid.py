"""Language identification by prediction by partial matching over bytes.

For each language a context tree of up to ORDER bytes is counted over labelled texts and then frozen.  A byte seen
after a context costs -log2(count / (total + kinds)); one not seen costs the escape, -log2(kinds / (total + kinds)),
plus its cost after the context without its first byte; below the empty context all 256 bytes are equally likely
(method C, no exclusions).  The language with the shortest code of the whole text is predicted.

Each tree is an automaton whose states are all contexts seen.  Contexts of up to DENSE bytes have a row for every byte: the
next state and the whole cost, escapes included.  Longer ones hold only the bytes seen after them, as a set of 256 bits and a place in a
list; a byte that isn't seen takes the escape to the context without its first byte.  Many texts advance together, a byte each.  Long
texts are cut into pieces that first read the ORDER bytes before them, which gives the same state and so exactly
the same code length.

Scale.  One pass over the text, no shuffle of it.  Every labelled language is learned, on at most SAMPLE labelled texts picked by a
hash of doc_id, of SAMPLE_BYTES in all unless the first alone is longer (the bounded sample); all contexts of the sample are kept, so code
lengths are exact and don't depend on the other languages.  A tree is grown by one task; only trees reach the driver and are
broadcast, as lists of what was seen: 12 bytes for each pair of a context and a byte, so ORDER + 1 times 12 bytes for a byte of the sample
at most (0.8 MB for 0.8 MB of prose).  Workers keep the automata of as many languages as fit in KEPT_BYTES and build the
others for each batch of texts.  Time grows in proportion to the languages.

Defined results.  A text that is null or has no letter is `und` with score 0.  The score is the probability of the
predicted language against the others when the code lengths per byte are taken CONFIDENCE bytes long: 1 if sure,
1 / languages if all are equal.  Ties take the first language by name.  With no labelled text, all rows are `und`.  The label `und`
says that a text has no language, so rows with it, null labels and empty texts aren't learned from.  Rows that repeat are learned once.
Rows with a null doc_id are held_out false (their remainder isn't 2) but never used for learning.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.tables import table
from fathom.llm.text import chunks

ORDER = 4
#: The bounded sample of a language: texts and bytes.
SAMPLE, SAMPLE_BYTES = 300, 4 << 20
#: Contexts of up to so many bytes have a row of all 256 bytes.
DENSE = ORDER - 2
#: Bytes of automata that a worker keeps.
KEPT_BYTES = 96 << 20
#: Texts advance together in pieces of so many bytes.
PIECE = 256
#: Bytes that a score is taken over.  Of 1 to 100 the one with the least log loss on held-out rows of sf0.1, for whole texts (0.0021; at 100 bytes
#: 0.0274, and 1.0 for almost all) and for pieces of one to three words (0.085; 0.102).
CONFIDENCE = 4
#: Bits a byte beyond which letters are in no language.  Measured on sf0.1, learned on 300 texts a language: held-out texts cost at
#: most 4.7 as a whole and 8.2 on their letters (9.0 in capitals), random letters 14.2 at least and random words 13.3.
REJECT = 12.0
#: The same for less than SHORT bytes of letters (held-out single words: at most 12.0), and for a language learned on less than
#: FEW bytes (held-out texts with 1 to 30 learned: at most 13.1), where noise can't be told from it.
REJECT_SHORT, SHORT = 18.0, 32
REJECT_FEW, FEW = 16.0, 100_000
_LETTER = regex.compile(r"\p{L}")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")


class Tree:
    """Frozen statistics of one language: its contexts, level by level, with what was seen after each."""

    def __init__(self, levels: list[int], parent: np.ndarray, byte: np.ndarray, shorter: np.ndarray, escape: np.ndarray, at: np.ndarray, cost: np.ndarray, learned: int):
        #: levels: the first state of each length; parent, byte, shorter: the context without its last byte, that byte, the
        #: context without its first; escape: bits of a byte not seen; at: state * 256 + byte of those seen, in order, and their cost;
        #: learned: bytes of its texts
        self.levels, self.parent, self.byte, self.shorter, self.escape, self.at, self.cost = levels, parent, byte, shorter, escape, at, cost
        self.learned = learned


class Automaton:
    """The tree as tables: ``advance`` gives cost and next state of many (state, byte) at once."""

    def __init__(self, tree: Tree):
        levels = tree.levels
        self.n = n = levels[min(DENSE + 1, len(levels) - 1)]
        step, cost = np.zeros((n, 256), np.int32), np.full((n, 256), 8.0, np.float32)
        for order, (a, b) in enumerate(zip(levels, levels[1 : DENSE + 2], strict=False)):
            if order:
                step[a:b], cost[a:b] = step[tree.shorter[a:b]], cost[tree.shorter[a:b]]
            c = levels[min(order + 2, len(levels) - 1)]
            step[tree.parent[b:c], tree.byte[b:c]] = np.arange(b, c, dtype=np.int32)
            cost[a:b] += tree.escape[a:b, None]
            i, j = np.searchsorted(tree.at, (a * 256, b * 256))
            cost.reshape(-1)[tree.at[i:j]] = tree.cost[i:j]
        self.step, self.cost = step.ravel(), cost.ravel()
        first = int(np.searchsorted(tree.at, n * 256))
        at, self.seen = tree.at[first:], tree.cost[first:]
        self.escape, self.shorter = tree.escape[n:], tree.shorter[n:]
        child = np.arange(levels[min(DENSE + 2, len(levels) - 1)], len(tree.escape))
        reached = tree.parent[child].astype(np.int64) * 256 + tree.byte[child]
        # the spaces before a text make contexts that are reached by a byte not seen after their parent: it leads there at the cost of an escape
        more = np.setdiff1d(reached, at)
        if len(more):
            at = np.concatenate((at, more))
            self.seen = np.concatenate((self.seen, self.escape[(more >> 8) - n] + self.cost[self.shorter[(more >> 8) - n].astype(np.int64) * 256 + (more & 255)]))
            order_ = np.argsort(at)
            at, self.seen = at[order_], self.seen[order_]
        word = (at - n * 256) >> 6
        self.bits = np.zeros((len(tree.escape) - n) * 4, np.uint64)
        np.bitwise_or.at(self.bits, word, np.uint64(1) << (at & 63).astype(np.uint64))
        #: the place behind the last byte of each word of the set
        self.over = np.searchsorted(word, np.arange(len(self.bits)), side="right").astype(np.int32)
        #: where a byte leads: to the context with it, or as the context without its first byte does
        self.next = np.zeros(len(at), np.int32)
        for a, b in zip(levels[DENSE + 1 :], levels[DENSE + 2 :], strict=False):
            i, j = np.searchsorted(at, (a * 256, b * 256))
            short, byte = tree.shorter[at[i:j] >> 8].astype(np.int64), at[i:j] & 255
            dense = short < n
            self.next[i:j][dense] = self.step[(short * 256 + byte)[dense]]
            self.next[i:j][~dense] = self.next[np.searchsorted(at, (short * 256 + byte)[~dense])]
            own = (tree.parent[child] >= a) & (tree.parent[child] < b)
            self.next[np.searchsorted(at, reached[own])] = child[own]

    def size(self) -> int:
        return sum(x.nbytes for x in (self.step, self.cost, self.seen, self.escape, self.shorter, self.bits, self.over, self.next))

    def advance(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each byte in its state, and the next states."""
        n = self.n
        own = state - n
        deep = np.flatnonzero(own >= 0)
        cell = (state << 8) | byte
        if not len(deep):
            return self.cost.take(cell), self.step.take(cell)
        bits = np.zeros(len(state), np.float32)
        after = np.empty(len(state), np.int32)
        done = np.zeros(len(state), bool)
        own, b = own.take(deep), byte.take(deep)
        while len(deep):
            word = (own << 2) | (b >> 6)
            above = self.bits.take(word) >> (b & 63).astype(np.uint64)  # the byte's own bit and those of greater bytes
            hit = (above & np.uint64(1)).astype(bool)
            seen, miss = np.flatnonzero(hit), np.flatnonzero(~hit)
            at = deep.take(seen)
            found = self.over.take(word.take(seen)) - np.bitwise_count(above.take(seen))
            bits[at] += self.seen.take(found)
            after[at] = self.next.take(found)
            done[at] = True
            deep, own, b = deep.take(miss), own.take(miss), b.take(miss)
            bits[deep] += self.escape.take(own)
            short = self.shorter.take(own)
            cell[deep] = (short << 8) | b
            still = np.flatnonzero(short >= n)
            deep, own, b = deep.take(still), short.take(still) - n, b.take(still)
        rest = np.flatnonzero(~done)
        cell = cell.take(rest)
        bits[rest] += self.cost.take(cell)
        after[rest] = self.step.take(cell)
        return bits, after


class Model:
    """The languages by name and a tree for each; automata are built once as far as KEPT_BYTES allow, others for each use."""

    def __init__(self, languages: list[str], trees: list[Tree]):
        self.languages, self.trees = languages, trees
        self._built: dict[int, Automaton] = {}
        self._left = KEPT_BYTES

    def automaton(self, k: int) -> Automaton:
        if k in self._built:
            return self._built[k]
        made = Automaton(self.trees[k])
        if made.size() <= self._left:
            self._built[k] = made
            self._left -= made.size()
        return made

    def __reduce__(self):
        return Model, (self.languages, self.trees)


def _counts(data: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each run of ``order`` + 1 bytes as a number, and how often it occurs; texts begin after spaces."""
    raw = np.frombuffer(b"".join(b" " * ORDER + x for x in data), np.uint8).astype(np.uint64)
    own = np.concatenate([np.arange(len(x) + ORDER) >= ORDER for x in data]) if data else np.zeros(0, bool)
    at = np.flatnonzero(own)
    key = np.zeros(len(at), np.uint64)
    for j in range(order, -1, -1):
        key = (key << np.uint64(8)) | raw[at - j]
    return np.unique(key, return_counts=True)


def grow(texts: list[bytes]) -> Tree:
    """The tree of one language with all contexts of its texts."""
    runs = [_counts(texts, order) for order in range(ORDER + 1)]
    number: dict[bytes, int] = {b"": 0}
    for order, (key, _) in enumerate(runs):  # every prefix and suffix of a context is one too
        for context in np.unique(key >> np.uint64(8)).tolist():
            number.setdefault(context.to_bytes(order, "big"), len(number))
    size = np.array([len(c) for c in number])
    levels = [int(x) for x in np.searchsorted(size, np.arange(ORDER + 2))]
    parent, shorter = (np.array([number[c] for c in x], np.int32) for x in ([c[:-1] for c in number], [c[1:] for c in number]))
    byte = np.array([c[-1] if c else 0 for c in number], np.uint8)
    names = list(number)
    at, seen = [], []
    for order, (key, n) in enumerate(runs):
        own = np.array([int.from_bytes(c, "big") for c in names[levels[order] : levels[order + 1]]], np.uint64)  # in order
        if len(own):
            context = key >> np.uint64(8)
            i = np.minimum(np.searchsorted(own, context), len(own) - 1)
            kept = own[i] == context
            at.append((levels[order] + i[kept]) * 256 + (key[kept] & np.uint64(255)).astype(np.int64))
            seen.append(n[kept])
    place, count = np.concatenate(at), np.concatenate(seen).astype(np.float64)
    total, kinds = np.bincount(place >> 8, count, len(number)), np.bincount(place >> 8, minlength=len(number))
    whole = np.maximum(1, total + kinds)
    escape = -np.log2(np.maximum(1, kinds) / whole)
    return Tree(levels, parent, byte, shorter, escape.astype(np.float32), place, -np.log2(count / whole[place >> 8]).astype(np.float32), sum(map(len, texts)))


def fit(texts: dict[str, list[bytes]]) -> Model:
    """A tree for each language."""
    return Model(sorted(texts), [grow(texts[x]) for x in sorted(texts)])


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Exact code length in bits of each text in each language."""
    out = np.zeros((len(texts), len(model.languages)))
    pieces = [(i, a) for i, t in enumerate(texts) for a in range(0, len(t), PIECE)]
    if not pieces:
        return out
    body = np.frombuffer(b"".join(b" " * ORDER + t for t in texts), np.uint8).astype(np.int32)
    start = np.concatenate(([0], np.cumsum([len(t) + ORDER for t in texts])))
    which = np.array([p[0] for p in pieces])
    at = start[which] + np.array([p[1] for p in pieces]) + ORDER
    length = np.minimum(PIECE, start[which + 1] - at)
    order = np.argsort(-length, kind="stable")
    which, at, length = which[order], at[order], length[order]
    active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    for k in range(len(model.languages)):
        automaton = model.automaton(k)
        state = np.zeros(len(at), np.int32)
        for j in range(-ORDER, 0):
            _, state = automaton.advance(state, body[at + j])
        bits = np.zeros(len(at))
        for j, n in enumerate(active.tolist()):
            cost, state = automaton.advance(state[:n], body[at[:n] + j])
            bits[:n] += cost
        out[:, k] = np.bincount(which, bits, len(texts))
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def score(model: Model | None, texts: list[bytes | None]) -> tuple[list[str], list[float], list[float]]:
    """Predicted language, score and bits a byte of each text."""
    if model is None:
        return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    letters = [bool(t and _LETTER.search(t.decode("utf-8", "replace"))) for t in texts]
    bits = code_lengths(model, [t if keep else b"" for t, keep in zip(texts, letters, strict=True)])
    size = np.array([max(1, len(t or b"")) for t in texts])
    best = bits.argmin(1)
    gap = (bits - bits.min(1, keepdims=True)) / size[:, None] * np.minimum(size, CONFIDENCE)[:, None]
    sure = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
    rate = bits.min(1) / size
    return [model.languages[b] if k else "und" for b, k in zip(best.tolist(), letters, strict=True)], [s if k else 0.0 for s, k in zip(sure.tolist(), letters, strict=True)], rate.tolist()


_TREE = "lang string, tree binary"


def _grown(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    tree = grow(sorted(x.encode() for x in rows["text"]))
    return pd.DataFrame({"lang": [key[0]], "tree": [pickle.dumps(tree)]})


def judged(model: Model, texts: list[bytes | None]) -> tuple[list[bool], list[str]]:
    """Whether each text is in a language, and in which: it has a letter, and all of it or its letters alone cost no more than the bound."""
    lang, _, rate = score(model, texts)
    learned = dict(zip(model.languages, (t.learned for t in model.trees), strict=True))
    stay = [x != "und" and r <= REJECT for x, r in zip(lang, rate, strict=True)]
    rest = [i for i, (x, s) in enumerate(zip(lang, stay, strict=True)) if x != "und" and not s]
    letters = [" ".join(_LETTERS.findall(texts[i].decode("utf-8", "replace"))).encode() for i in rest]
    best, _, rate = score(model, letters)
    for i, t, x, r in zip(rest, letters, best, rate, strict=True):
        stay[i] = r <= max(REJECT, REJECT_SHORT if len(t) < SHORT else 0.0, REJECT_FEW if learned[x] < FEW else 0.0)
    return stay, lang


def fits(model: Model, texts: list[bytes | None]) -> list[bool]:
    return judged(model, texts)[0]


def learn(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fit on the bounded sample of labelled rows of ``docs`` (doc_id, text, lang); every language with a text is learned."""
    key = F.xxhash64("text").alias("key")
    rows = docs.select("doc_id", "lang", "text", key).where("text <> '' and lang is not null and lang <> 'und' and doc_id is not null")
    labelled = rows.select("doc_id", "lang", "key", F.octet_length("text").alias("size")).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    names = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least"))
    # a share of the hashes first, about four times the sample, so that the exact cut sees few rows however many there are;
    # the least hash is always in it, however the ids of a language repeat
    share = F.least(F.lit(1.0), F.lit(4.0 * sample) / F.col("n")) * (1 << 30)
    some = labelled.join(F.broadcast(names), "lang").where((F.col("h") < share) | (F.col("h") == F.col("least")))
    some = some.select("doc_id", "lang", "key", "size", "h").distinct()
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "key")
    some = some.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample)
    some = some.withColumn("bytes", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    picked = some.where((F.col("nth") == 1) | (F.col("bytes") <= sample_bytes)).select("doc_id", "lang", "key")
    bounded = rows.join(F.broadcast(picked), ["doc_id", "lang", "key"], "left_semi").dropDuplicates(["doc_id", "lang", "key"]).select("lang", "text")
    trees = {r.lang: pickle.loads(r.tree) for r in bounded.groupBy("lang").applyInPandas(_grown, _TREE).collect()}  # a row a language
    return Model(sorted(trees), [trees[x] for x in sorted(trees)]) if trees else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            lang, sure, _ = score(sent.value, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(sure, pa.float64())], schema=_OUT)

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``predict`` for all documents, learned on those that aren't held out; nulls, repeats and scale as the module says."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs.where(~held_out(F.col("doc_id")))))


def accept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in some language, with all columns; a null or `und` lang becomes the predicted one.  Texts that are null, without a
    letter, or that no language's statistics code within the bound, as a whole or in their letters, go.  With no labelled text only the
    former go, and labels stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs))
    place = docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            if sent.value is None:
                stay = [bool(t and _LETTER.search(t.decode("utf-8", "replace"))) for t in texts]
            else:
                stay, found = judged(sent.value, texts)
                lang = [x if x is not None and x != "und" else y for x, y in zip(batch.column(place).to_pylist(), found, strict=True)]
                batch = batch.set_column(place, batch.schema.field(place), pa.array(lang, batch.schema.field(place).type))
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
