import hashlib
import re

import pytest

from fathom.llm import substring
from fathom.llm.substring import substring_dedup


def brute(rows, k):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, ws in words:
        if d is not None:
            for i in range(len(ws) - k + 1):
                key = tuple(ws[i : i + k])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, ws in words:
        gone = set()
        for i in range(len(ws) - k + 1):
            if d is not None and least[tuple(ws[i : i + k])] < d:
                gone.update(range(i, i + k))
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "heavy"), [(4, 50_000), (13, 50_000), (2, 40), (13, 40), (13, 1)])
def test_same_as_brute_force(spark, monkeypatch, k, heavy):
    monkeypatch.setattr(substring, "HEAVY_WINDOWS", heavy)
    common = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"start{i} a b c\t{common}\n{'x ' * (i % 7)} end{i} " + " ".join(f"w{(i * j) % 17}" for j in range(40))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "é ü " * 40), (103, "é ü " * 30), (7, "other text of seven " + common), (7, "other text of seven " + common)]
    rows += [(None, common), (104, "one"), (105, "z " * 5000), (106, "z " * 5000)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, found string").repartition(3)
    got = sorted((tuple(r) for r in substring_dedup(df, k).collect()), key=repr)
    assert got == brute(rows, k)


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_minimiser_in_every_document(spark, monkeypatch):
    """A phrase in all documents is heavy: no bucket gets its windows, and the result stays the same."""
    monkeypatch.setattr(substring, "HEAVY_WINDOWS", 500)
    phrase = "the very same phrase in all of them again and again as ever before"
    rows = [(i, " ".join(f"a{i}x{j}" for j in range(12)) + f" {phrase} " + " ".join(f"b{i % 9}x{j}" for j in range(12))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    heavy = substring.heavy_minimisers(df.select("doc_id", "text"), 13, 10**6, 5)
    assert len(heavy)
    sent = [r.asDict() for r in df.selectExpr("doc_id", "text", "xxhash64(text) as key").mapInArrow(substring._send(13, 16, spark.sparkContext.broadcast(heavy)), substring._SENT_SQL).collect()]
    names = [r["name"] for r in sent if r["name"]]
    assert names and max(names.count(x) for x in set(names)) <= 5  # once for a slice of input
    got = sorted((tuple(r) for r in substring_dedup(df).collect()), key=repr)
    assert got == brute(rows, 13)
