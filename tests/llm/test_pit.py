import random

import pytest
from pyspark.sql import functions as F

from fathom.llm import pit

VERSIONS = "who string, event long, arrival long, expiry long, tie long, city string"


def brute(versions, who, t):
    usable = [v for v in versions if None not in (v[0], v[1], v[2], v[4], who, t) and v[0] == who and v[1] <= t and v[2] <= t and (v[3] is None or t < v[3])]
    key = lambda v: (v[1], -v[2], v[4], pit.NEVER if v[3] is None else v[3], v[5] is not None, v[5] or "")
    return max(usable, key=key)[1:] if usable else None


def answers(spark, versions, requests, at="at", **more):
    out = pit.as_of(spark.createDataFrame(versions, VERSIONS), spark.createDataFrame(requests, f"who string, {at} long, k0 int"), ["who"], ["city"], at=at, **more)
    assert out.columns == ["who", at, "k0", "version"]
    return sorted(((r[0], r[1], r[2], r[3] and (r[3].event, r[3].arrival, r[3].expiry, r[3].tie, r[3].city)) for r in out.collect()), key=repr)


def expected(versions, requests):
    return sorted(((*r, brute(versions, r[0], r[1])) for r in requests), key=repr)


@pytest.mark.parametrize(("span", "lasts", "seed"), [(40, 6, 1), (3000, 900, 2), (200_000, 150_000, 3), (1, 2, 4)])
def test_equals_brute_force(spark, monkeypatch, span, lasts, seed):
    monkeypatch.setattr(pit, "LEAST", 4)
    rng = random.Random(seed)
    pick = lambda most: rng.choice([None, *[rng.randrange(-most, most) for _ in range(20)]])
    versions = []
    for i in range(400):
        event = pick(span)
        arrival = None if event is None else event + rng.randrange(-5, 30)
        expiry = rng.choice([None, (event or 0) + rng.randrange(-3, lasts), (event or 0) + rng.randrange(1, lasts)])
        versions.append((rng.choice(["hot"] * 6 + ["b", "c", "", None]), event, arrival, expiry, rng.choice([i, i // 3, None]), rng.choice(["x", "", None])))
    versions += versions[:30]
    requests = [(rng.choice(["hot"] * 6 + ["b", "c", "", "none", None]), pick(span), rng.choice([1, 2, None])) for _ in range(300)]
    requests += requests[:20]
    assert answers(spark, versions, requests) == expected(versions, requests)


def test_empty_tables(spark):
    assert answers(spark, [], [("a", 1, 1), (None, None, None)]) == expected([], [("a", 1, 1), (None, None, None)])
    assert answers(spark, [("a", 1, 1, 5, 1, "x")], []) == []
    assert answers(spark, [("a", 1, 1, 5, 1, "x")], [("a", None, 1)]) == [("a", None, 1, None)]


def test_names_that_clash(spark):
    versions, requests = [("a", 1, 1, 5, 1, "x")], [("a", 4, 1), ("a", 5, 2)]
    assert answers(spark, versions, requests, at="_at") == expected(versions, requests)
    with pytest.raises(ValueError, match="taken"):
        answers(spark, versions, requests, name="WHO")


def test_two_keys(spark):
    versions = spark.createDataFrame([("a", 1, 10, 10, None, 1, 7), ("a", 2, 10, 10, None, 1, 8)], "bucket string, n int, event long, arrival long, expiry long, tie long, v int")
    requests = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("a", 3, 11)], "bucket string, n int, at long")
    out = pit.as_of(versions, requests, ["bucket", "n"], ["v"]).orderBy("n").select("version.v")
    assert [r[0] for r in out.collect()] == [7, 8, None]


def test_a_hot_tick_holds_few_rows(spark):
    """Very many versions and requests of one key and second meet as few rows."""
    versions = spark.range(20_000).select(F.lit("a").alias("who"), (F.col("id") % 3).alias("event"), F.lit(1).cast("long").alias("arrival"), (F.col("id") % 5 + 3).alias("expiry"), F.col("id").alias("tie"), F.lit("x").alias("city"))
    requests = spark.range(20_000).select(F.lit("a").alias("who"), (F.col("id") % 4).alias("at"))
    out = pit.as_of(versions, requests, ["who"], ["city"]).groupBy("at").agg(F.count("*").alias("n"), F.max("version.tie").alias("tie"), F.min("version.tie").alias("least")).orderBy("at")
    rows = {r.at: (r.n, r.tie, r.least) for r in out.collect()}
    last = lambda m: max(i for i in range(19_970, 20_000) if i % 3 == m)
    assert rows == {0: (5000, None, None), 1: (5000, last(1), last(1)), 2: (5000, last(2), last(2)), 3: (5000, max(i for i in range(19_970, 20_000) if i % 3 == 2 and i % 5), max(i for i in range(19_970, 20_000) if i % 3 == 2 and i % 5))}


def test_staircase_drops_what_is_dominated():
    stairs = pit.Staircase()
    for rank, end in (((1,), 10), ((3,), 5), ((2,), 4), ((2,), 7), ((0,), 10)):
        stairs.put(rank, end, {"rank": rank})
    assert stairs.ranks == [(1,), (2,), (3,)] and stairs.ends == [10, 7, 5]
    assert stairs.best(5)["rank"] == (2,) and stairs.best(9)["rank"] == (1,) and stairs.best(10) is None
