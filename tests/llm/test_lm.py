import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import lm


def tokens(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall("[^\x20\x09-\x0d]+", text or "")] + [None]


def brute(rows, held):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of rows (doc_id, text)."""
    c, texts = collections.Counter(), 0
    for i, text in rows:
        if not held(i):
            q, texts = ["<s>", *tokens(text)], texts + 1
            c.update(zip(q[1:]))
            c.update(zip(q, q[1:]))
            c.update(zip(q, q[1:], q[2:]))
    n, kinds = sum(v for k, v in c.items() if len(k) == 1), sum(len(k) == 1 for k in c)
    out = []
    for i, text in rows:
        q, base, score, known = ["<s>", *tokens(text)], 0.0, 0.0, 0
        for a in range(1, len(q)):
            w = q[a]
            p = (c[w,] + 1) / (n + kinds + 1)
            base, known = base + math.log10(p), known + (c[w,] > 0)
            v = texts if a == 1 else c[q[a - 1],]
            p = (c[q[a - 1], w] + lm.K2 * p) / (v + lm.K2)
            if a > 1:
                p = (c[q[a - 2], q[a - 1], w] + lm.K3 * p) / (c[q[a - 2], q[a - 1]] + lm.K3)
            score += math.log10(p)
        out.append((i, held(i), len(q) - 1, known, n, base, score))
    return out


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def held_column():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2


def same(got, want):
    got, want = (sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[-1])) for x in (map(tuple, got), want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("block", [64, 700, 1 << 20])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(block)
    words = np.array(["a", "B", "b", "the", "The", "é", "É", "x\x1cy", "日本", "0", " ", "long" * 40])
    rows = [(i, "".join(w + rng.choice([" ", "\n", "\t ", "\r\n"]) for w in rng.choice(words, rng.integers(0, 60)))) for i in range(60)]
    rows += [(61, None), (62, ""), (63, " \n "), (None, "a b the"), (None, None), (3, "a b"), rows[5], rows[5], (64, "w" * 3000), (65, "the b " * 3000), (2, "only here it is known")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, held int, key int")
    out = lm.score(docs, held_column(), block)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(out.collect(), brute(rows, is_held))


def test_very_long_text(spark):
    """A text of several MB is continued over blocks; its counts and scores are those of the whole."""
    rows = [(1, " ".join(f"w{i * i % 977}" for i in range(300_000))), (2, "w1 w4 w9"), (9, "w16")]
    same(lm.score(spark.createDataFrame(rows, "doc_id long, text string"), held_column(), 1 << 18).collect(), brute(rows, is_held))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, lm.score(docs, F.lit(True)).collect())) == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    assert lm.score(docs.limit(0), held_column()).collect() == []


def test_pieces_keep_two_words():
    text = b"aa b  cc\tdd e ff g hh i"
    found = list(lm.pieces(text, 5))
    assert [p[1:] for p in found] == [(True, 0, False), *[(False, 2, False)] * (len(found) - 2), (False, 2, True)]
    assert b" ".join(b" ".join(body.split()[lead:]) for body, _, lead, _ in found) == b" ".join(text.split())
    assert list(lm.pieces(b"wwwwwwww x", 3)) == [(b"wwwwwwww", True, 0, False), (b"wwwwwwww  x", True, 1, True)]
    assert list(lm.pieces(b"", 3)) == [(b"", True, 0, True)]


def test_better_than_words_alone_on_held_out_texts(spark):
    out = lm.op12_lm_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    base, model = (10 ** (-x / out[2]) for x in out[:2])
    assert model < 0.5 * base


@pytest.mark.parametrize("context", [("a", "b"), ("b", "c"), ("z", "a"), ("a", "z"), ("y", "z")])
def test_probabilities_sum_to_one(context):
    """After any two tokens, the known ones and one for all unknown ones have probability one together."""
    rows = [(1, "a b a b c"), (2, "b c"), (3, "a")]
    assert sum(_next(rows, context, t) for t in ["a", "b", "c", None, "unknown"]) == pytest.approx(1)


def _next(rows, context, w):
    c, texts = collections.Counter(), len(rows)
    for _, text in rows:
        q = ["<s>", *tokens(text)]
        c.update(zip(q[1:]))
        c.update(zip(q, q[1:]))
        c.update(zip(q, q[1:], q[2:]))
    n, kinds = sum(v for k, v in c.items() if len(k) == 1), sum(len(k) == 1 for k in c)
    places = lm.Tokens(np.zeros(3, int), np.zeros(3, bool), np.array([False, False, True]), np.array([0, 3]), np.zeros(0, np.uint64), [])
    at = [*context, w]
    counts = [np.array([c[at[i],] for i in range(3)]), np.array([0, c[at[0], at[1]], c[at[1], at[2]]]), np.array([0, 0, c[tuple(at)]])]
    return 10 ** lm.traverse(places, counts, n, kinds, texts)[0]
