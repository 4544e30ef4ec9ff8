import random
from itertools import combinations

import pytest

from fathom.llm import packing as p


def padding(lengths, counts, bounds):
    return sum((min(b for b in bounds if b >= n) - n) * c for n, c in zip(lengths, counts, strict=True))


@pytest.mark.parametrize("seed", range(12))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(60), rng.choice([1, 2, 5, 9]))
    counts = [rng.randrange(1, 50) for _ in lengths]
    for k in (1, 2, 3, 5):
        got = p.boundaries(lengths, counts, k)
        best = min(padding(lengths, counts, (*c, max(lengths))) for n in range(k) for c in combinations(sorted(set(lengths) - {max(lengths)}), min(n, len(lengths) - 1)))
        assert got == sorted(got) and got[-1] == max(lengths) and len(got) <= k and padding(lengths, counts, got) == best
    assert p.boundaries([], []) == []


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(p, "PART", 20)
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 3, 8, 40, 41, 300])) for i in range(300)] + [(400, None), (401, ""), (5, "w"), (5, "w"), (None, "a b"), (402, "w " * 9000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, batch int").repartition(3)
    got = p.pack(df, buckets=4, budget=200).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == sorted((-1 if d is None else d, len((t or "").split())) for d, t in rows)
    assert sorted(r.n_tokens for r in got) == sorted(len((t or "").split()) for _, t in rows)
    for bucket in {r.bucket for r in got}:
        own = [r for r in got if r.bucket == bucket]
        size = max(1, 200 // max(1, own[0].padded))
        assert {r.padded for r in own} == {own[0].padded} and all(r.n_tokens <= r.padded for r in own)
        assert sorted((r.batch, r.slot) for r in own) == [(i // size, i % size) for i in range(len(own))]
    bounds = sorted({r.padded for r in got})
    assert all(min(b for b in bounds if b >= r.n_tokens) == r.padded for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert p.pack(df).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.padded, r.batch, r.slot) for r in p.pack(only).collect()) == [(0, 0, 0), (0, 0, 1)]


def exact_padding(sizes, buckets):
    """The least padding by the plain quadratic program over exact lengths."""
    import numpy as np

    length, count = np.unique(np.array(sizes), return_counts=True)
    n, c, t = len(length), np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(length * count)))
    best = np.concatenate(([0], np.full(n, 1 << 60)))
    for _ in range(buckets):
        best = np.array([0] + [min(best[j], (best[:j] + length[j - 1] * (c[j] - c[:j]) - (t[j] - t[:j])).min()) for j in range(1, n + 1)])
    return int(best[n])


def test_padding_of_a_table_is_the_exact_optimum(spark):
    got = p.op8_pack_lengths(spark, "/root/testdata/sf0.1").select("n_tokens", "padded").collect()
    assert sum(r.padded - r.n_tokens for r in got) == exact_padding([r.n_tokens for r in got], p.MAX_BUCKETS)
    assert max(r.padded for r in got) == max(r.n_tokens for r in got) > 4096
