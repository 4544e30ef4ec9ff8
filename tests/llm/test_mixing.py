import hashlib

import pytest
from pyspark.sql import functions as F

from fathom.llm import mixing as m


def water(children, budget):
    """Shares by repeated passes: {name: (supply, weight)}."""
    full = set()
    while True:
        rest = budget - sum(children[c][0] for c in full)
        weight = sum(w for c, (_, w) in children.items() if c not in full)
        if not weight:
            return {c: s for c, (s, _) in children.items()}
        over = {c for c, (s, w) in children.items() if c not in full and rest * w / weight >= s}
        if not over:
            return {c: s if c in full else int(rest * w / weight) for c, (s, w) in children.items()}
        full |= over


def brute(rows, share, epochs, seed):
    leaf = lambda r: (m.DOMAINS[(int("".join(x for x in (r[3] or "")[::-1] if x.isdigit())[::-1] or 0)) % 4], r[2] or "?", r[3] or "?")
    size = lambda r: len((r[1] or "").split())
    tokens = {}
    for r in rows:
        tokens[leaf(r)] = tokens.get(leaf(r), 0) + size(r)
    total = int(sum(tokens.values()) * share)
    supply = lambda keep: sum(t * epochs for k, t in tokens.items() if keep(k))
    w = lambda n: m.WEIGHTS.get(n, 1.0)
    budget = {}
    top = water({d: (supply(lambda k, d=d: k[0] == d), w(d)) for d in {k[0] for k in tokens}}, total)
    for d, b in top.items():
        mid = water({x: (supply(lambda k, x=x: k[:2] == (d, x)), w(x)) for x in {k[1] for k in tokens if k[0] == d}}, b)
        for x, b2 in mid.items():
            for s, b3 in water({s: (supply(lambda k, s=s: k == (d, x, s)), w(s)) for s in {k[2] for k in tokens if k[:2] == (d, x)}}, b2).items():
                budget[d, x, s] = b3
    out = []
    for k in tokens:
        own = [r for r in rows if leaf(r) == k]
        whole = budget[k] // tokens[k] if tokens[k] else 1
        key = lambda r: hashlib.md5(f"{seed}:{whole}:{'?' if r[0] is None else r[0]}".encode()).hexdigest()  # noqa: E731, B023
        for r in own:
            upto = sum(size(q) for q in own if key(q) <= key(r))
            out.append((r[0], size(r), min(epochs, whole + (upto <= budget[k] - whole * tokens[k]))))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("share", "epochs"), [(0.9, 2), (0.3, 1), (5.0, 2), (1.6, 3)])
def test_same_as_brute_force(spark, share, epochs):
    rows = [(i, "w " * (1 + i * 7 % 23), ["en", "de", "fr", None][i % 4], f"src{i % 7}") for i in range(120)]
    rows += [(200, None, "en", "src0"), (201, "", None, None), (202, "  a  b\n", "xx", "other"), (5, rows[5][1], "de", "src5"), (None, "q q q", "en", "src1")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, tokens int").repartition(3)
    got = sorted(((r.doc_id, r.n_tokens, r.epochs) for r in m.mix(df, share, epochs).collect()), key=repr)
    assert got == brute(rows, share, epochs, m.SEED)
    out = m.sampled(df, share, epochs)
    assert out.columns == df.columns and out.count() == sum(e for *_, e in got)


def test_tokens_and_empty(spark):
    df = spark.createDataFrame([(" a b",), ("a\t\n b ",), ("",), ("  ",), (None,), ("é x",)], "t string")
    assert [r[0] for r in df.select(m.tokens(F.col("t"))).collect()] == [2, 2, 0, 0, 0, 1]
    assert m.mix(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
