import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import hardneg as h

ROWS = "vec_id long, label string, embedding array<double>, own int"


def usable(r):
    return r[1] is not None and r[2] and all(x is not None and math.isfinite(x) for x in r[2])


def brute(rows, ask, positives=5, negatives=10, window=(30, 90)):
    fine = [(i, r[0], r[1], [math.floor(256 * x) for x in r[2]]) for i, r in enumerate(rows) if usable(r)]
    place = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for i, vec_id, label, v in fine:
        if vec_id is None or not ask(vec_id):
            continue
        scored = [(n, m == label, sum(a * b for a, b in zip(v, w, strict=True))) for j, n, m, w in fine if i != j and len(v) == len(w)]
        for p, score in sorted([(n, s) for n, same, s in scored if same], key=place)[:positives]:
            inside = [(n, s) for n, same, s in scored if not same and window[0] * score <= 100 * s <= window[1] * score]
            out += [(vec_id, p, k + 1, n, score, s) for k, (n, s) in enumerate(sorted(inside, key=place)[:negatives])]
    return sorted(out, key=repr)


def mined(spark, rows, **more):
    out = h.hard_negatives(spark.createDataFrame([(*r, 1) for r in rows], ROWS), F.col("vec_id") % 4 == 0, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(h, "SMALL", 40)
    rng = random.Random(seed)
    value = lambda: rng.choice([rng.gauss(0.3, 1), 0.5, -0.25])
    rows = [(rng.choice([i, i, i // 2, None]), rng.choice(["hot", "hot", "a", "b", str(i), None]), [value() for _ in range(rng.choice([3, 3, 3, 2]))]) for i in range(260)]
    rows += rows[:25] + [(4, "hot", None), (8, "hot", []), (8, "hot", [1.0, None, 2.0]), (12, "a", [float("nan")] * 3), (12, "a", [float("inf"), 0.0, 0.0]), (16, "a", [0.0] * 3), (20, "a", [1.0] * 7)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 4 == 0)
    assert mined(spark, rows, positives=2, negatives=3, window=(0, 200)) == brute(rows, lambda i: i % 4 == 0, 2, 3, (0, 200))


def test_empty_and_single(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(4, None, [1.0])]) == []
    assert mined(spark, [(4, "a", [1.0]), (5, "a", [1.0])]) == []


def test_large_components(spark):
    rows = [(4, "a", [5e6, 3.0]), (5, "a", [5e6 + 1, 2.0]), (6, "b", [4e6, 2.5]), (7, "b", [4e6, 2.25]), (8, "b", [4.5e6, 2.25])]
    assert mined(spark, rows) == brute(rows, lambda i: i % 4 == 0)
    with pytest.raises(Exception, match="62 bits"):
        mined(spark, [(4, "a", [1e13]), (5, "a", [1e13]), (6, "b", [1e13])])


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_trees_prune_and_stay_exact(spread):
    rng = np.random.default_rng(5)
    points = np.floor(256 * (rng.standard_normal((12, 8))[rng.integers(0, 12, 4000)] + spread * rng.standard_normal((4000, 8)))).astype(np.int64)
    labels = [str(x) for x in rng.integers(0, 3, 4000)]
    forest = h.Forest(points, labels, np.arange(4000), np.arange(4000))
    of = np.repeat(np.arange(20), 2)
    low, high = np.tile([-100_000, 20_000], 20), np.tile([50_000, 30_000], 20)
    best = h.Best(40, 10, low, high)
    forest.search(points[:20], labels[:20], np.arange(20), of, best, same=False)
    for i in range(40):
        score = points @ points[of[i]]
        fits = [j for j in range(4000) if labels[j] != labels[of[i]] and low[i] <= score[j] <= high[i]]
        want = sorted(fits, key=lambda j: (-score[j], j))[:10]
        assert best.id[i][: len(want)].tolist() == want
    if spread < 0.1:
        assert forest.opened < 40 * 4000 // 4  # clustered rows: most of the forest stays closed
