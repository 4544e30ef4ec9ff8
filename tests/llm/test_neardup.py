import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathom.llm import neardup as nd
from fathom.llm.tables import table


def brute(rows, threshold):
    """Class of each row by comparing every pair of texts."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    df = Counter(x for ws in words for x in set(ws))
    n = len(rows)
    idf = {x: round(3000 * max(0, min(1, math.log(n / c) / math.log(nd.THETA)))) if c * nd.THETA >= n else 3000 for x, c in df.items()}
    bags = []
    for ws in words:
        k = min(nd.SHINGLE, len(ws))
        bags.append(Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if ws else Counter())
    weight = lambda s: 15 + (2 * sum(idf[x] for x in s) * 15 + len(s) * 3000) // (2 * len(s) * 3000)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(n):
        for b in range(a):
            low = sum(weight(s) * min(c, bags[b][s]) for s, c in bags[a].items())
            high = sum(weight(s) * c for s, c in (bags[a] | bags[b]).items())
            if high and low / high >= threshold:
                root[find(a)] = find(b)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return sorted((d, min(ids[find(i)])) for i, (d, _) in enumerate(rows))


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 60, 200, 400]))]
        for copy in range(rng.choice([1, 2, 9])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2]) * len(text) // 200):
                text[rng.randrange(len(text))] = "edit"
            rows.append((len(rows) + 10, ("  " if copy % 2 else " ").join(text)))
    rows += [(1, None), (2, ""), (3, " \n "), (4, "a"), (5, "a"), (6, "a b"), (7, "x " * 3000), (8, "x " * 2990), (9, "the common line of many texts here")]
    return rows + rows[:3]


@pytest.mark.parametrize(("block", "size", "pivots", "most"), [(500, 4 << 20, 16, 1000), (4, 4 << 20, 1, 0), (3, 4 << 20, 0, 1000), (500, 2000, 2, 0)])
def test_classes_equal_brute_force(spark, monkeypatch, block, size, pivots, most):
    """Also where bands are crowded, by texts or by bytes, and no pivot ties their blocks, and where word weights are too many to broadcast."""
    monkeypatch.setattr(nd, "IDF_MOST", most)
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "CELL_BYTES", size)
    monkeypatch.setattr(nd, "PIVOTS", pivots)
    rows = fixture()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class_id string").repartition(3)
    got = sorted((r.doc_id, r.class_id) for r in nd.near_duplicates(df).collect())
    want = brute([r for r in rows if (r[1] or "").split()], 0.8)
    alone = sorted((d, d) for d, t in rows if not (t or "").split())
    assert got == sorted(want + alone)
    kept = sorted(r.doc_id for r in nd.keep_one(df).collect())
    assert kept == sorted({c for _, c in got})


def test_components_of_a_chain_and_empty(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 1.0)], "a long, b long, similarity double")
    got = {r.id: r.class_id for r in nd.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert nd.components(edges.limit(0)).count() == 0
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    text = lambda k, edit="": " ".join(f"{'e' if edit else 'w'}{k}" if i == 90 else f"w{k}x{i}" for i in range(100)) + edit
    rows = [(None, text(1)), (None, text(1, " z")), (5, text(2)), (5, text(3)), (3, text(3, " z")), (7, text(2, " z")), (8, text(4)), (8, text(4, " z")), (9, text(5)), (None, text(5, " z"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.text): r.class_id for r in nd.near_duplicates(df).join(df.withColumn("key", F.xxhash64("text")), "key").select(df.doc_id, "text", "class_id").collect()}
    want = dict(zip(rows, [None, None, 5, 3, 3, 5, 8, 8, 9, 9], strict=True))
    assert got == want
    kept = [(r.doc_id, r.text) for r in nd.keep_one(df).collect()]
    assert len(kept) == 5 and {d for d, _ in kept} == {None, 5, 3, 8, 9}
    assert (5, text(2)) in kept and (3, text(3, " z")) in kept and (9, text(5)) in kept


def test_crowded_band_of_many_small_groups(spark, monkeypatch):
    """One long passage makes all texts share bands though the groups don't link; a chain links two groups without a pivot."""
    monkeypatch.setattr(nd, "BLOCK", 6)
    monkeypatch.setattr(nd, "PIVOTS", 1)
    passage = " ".join(f"p{i}" for i in range(120))
    rows = []
    for g in range(12):
        own = " ".join(f"g{g}x{i}" for i in range(40))
        rows += [(100 * g + c, f"{passage} {own} c{c}") for c in range(6)]
    rows += [(5000, passage + " " + " ".join(f"g{g}x{i}" for g in (0, 1) for i in range(0, 20)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.class_id) for r in nd.near_duplicates(df).collect())
    assert got == brute(rows, 0.8)


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_a_crowd_of_strays_loses_no_link(spark, monkeypatch, threshold):
    """A band with many more strays than a block: every two of its texts are compared, whatever other band they share."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(150)]
    rows = []
    for i in range(90):
        own = [f"o{i // 2 if i < 60 else i}x{j}" for j in range(rng.choice([20, 60, 110]))]
        rows.append((i, " ".join(passage[: rng.choice([110, 150])] + own + [f"c{i}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(nd, "_signed", _signed_here)
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "PIVOTS", 1)
    got = sorted((r.doc_id, r.class_id) for r in nd.near_duplicates(df, threshold).collect())
    assert got == brute(rows, threshold)


def _signed_here(idf):
    """``_signed`` whose workers put all texts into one band."""
    import pyarrow as pa

    signed = _REAL_SIGNED(idf)

    def run(batches):
        for batch in signed(batches):
            bands = [x and [7, *x[1:]] for x in batch.column("bands").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("bands"), batch.schema.field("bands"), pa.array(bands, batch.schema.field("bands").type))

    return run


_REAL_SIGNED = nd._signed


def test_work_of_a_large_group_grows_with_its_members(spark, monkeypatch):
    """Texts sent to cells for one group of near copies: members and a few pivots for each block, not a square."""
    monkeypatch.setattr(nd, "BLOCK", 20)
    monkeypatch.setattr(nd, "PIVOTS", 3)
    sent = []
    real = nd._send
    base = [f"w{i}" for i in range(300)]
    for n in (100, 400):
        rows = [(i, " ".join([*base[:150], f"e{i}", *base[151:]])) for i in range(n)]
        counted = spark.sparkContext.accumulator(0)

        def count(batches, counted=counted):
            for batch in real(batches):
                counted.add(batch.num_rows)
                yield batch

        monkeypatch.setattr(nd, "_send", count)
        got = {r.class_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
        assert got == {0}
        sent.append(counted.value)
    assert sent[1] < 6 * sent[0]


def test_helper_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, "x", 9), (2, "a b c d e f", 8, "y", 10), (None, None, 1, "z", 1)], "doc_id long, text string, _key long, _id string, _STAY long")
    kept = nd.keep_one(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.where("doc_id is not null").collect()) == [(1, "a b c d e f", 7, "x", 9)] and kept.count() == 2


def test_recall_on_a_table_against_all_pairs(spark):
    """Every pair of texts of 0.8 or more, by plain Jaccard of five words, shares a class."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    classes = {r.doc_id: r.class_id for r in nd.op9_near_duplicates(spark, "/root/testdata/sf0.01").collect()}
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for r in docs.select("doc_id", "text").collect() if len(w := (r.text or "").split()) >= 5}
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    both = Counter()
    for ids in where.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                both[min(a, b), max(a, b)] += 1
    near = [(a, b) for (a, b), n in both.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8]
    assert len(near) > 50 and all(classes[a] == classes[b] for a, b in near)
