import hashlib
import re

import pytest

from fathom.llm import spotsigs as s


def rows():
    a = "the quick brown fox jumps over the lazy dog and the cat sees a big red ball in the garden " * 4
    return [(3, a), (1, "the of quick green turtle of deep water and the small fish " * 5), (7, a), (9, None), (12, ""), (15, "odd ### 123 zz yy"), (16, "one"), (20, "DER HUND UND DIE KATZE IM HAUS " * 4000), (20, "der hund und die katze im haus"), (None, "no id here at all")]


def test_neighbours_and_digests(spark):
    data = rows() + [(30 + i, f"text number {i} of the long series with words w{i} and v{i}") for i in range(40)]
    df = spark.createDataFrame([(d, t, "x") for d, t in data], "doc_id long, text string, bin string").repartition(5)
    got = s.fingerprints(df).collect()
    assert len(got) == len(data)
    order = sorted((r for r in got if r.doc_id not in (20,)), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    texts = {d: t or "" for d, t in data if d != 20}
    ids = [r.doc_id for r in order]
    for i, r in enumerate(order):
        following = ids[(i + 1) % len(ids)]
        if 20 in (following,) or (r.doc_id, following) == (16, 30):  # the rows of doc_id 20 come between
            continue
        own, after = texts[r.doc_id], texts[following]
        changed = s.edited(own, after)
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        x, y, z = s.signatures([own, changed, after])
        assert (r.fingerprint, r.edited_fingerprint) == (s.fingerprint(x), s.fingerprint(y))
        assert r.near_edited == s.likeness(x, y) and r.near_next == s.likeness(x, z)
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[3] == same[7] != same[1] and same[9] == same[12] == ""


def test_signatures_by_hand():
    one, two, three = s.signatures(["the red fox ran", "The, RED fox; ran!", "a red fox ran"])
    assert one.tolist() == two.tolist() and len(one) == 1 and one.tolist() != three.tolist()
    assert len(s.signatures(["the red"])[0]) == 1 and len(s.signatures([""])[0]) == 0
    assert s.likeness(one, one) == 1 and s.likeness(one, three) == 0 and s.likeness(one[:0], one[:0]) == 1


@pytest.mark.parametrize(("least", "share"), [(0.8, (4, 5)), (0.55, (11, 20)), (0.7, (7, 10)), (1.0, (1, 1))])
def test_similar_texts_equal_brute_force(spark, least, share):
    base = [f"the {chr(97 + i % 26)}{i} x{i} of y{i % 9} z{i}" for i in range(60)]
    data = [(k, " ".join(base[k % 3 : 50 + k % 4])) for k in range(12)] + [(50, " ".join(base[::-1])), (51, None)]
    data += [(60 + k, " ".join(f"the q{i} r{i} s{i}" for i in range(n))) for k, n in enumerate((11, 20, 22, 40, 55, 56, 100))]  # pairs exactly at 0.55
    df = spark.createDataFrame(data, "doc_id long, text string")
    signed = dict(zip([d for d, _ in data], s.signatures([t or "" for _, t in data]), strict=True))
    first = {}
    for d in sorted(signed):
        first.setdefault(signed[d].tobytes(), d)
    ids = sorted(d for d in first.values() if len(signed[d]))
    sets = {i: set(signed[i].tolist()) for i in ids}
    want = {(a, b) for a in ids for b in ids if a < b and share[1] * len(sets[a] & sets[b]) >= share[0] * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in s.similar_texts(df, least).collect()} == want and (want or least == 1)


def test_empty_and_single(spark):
    assert s.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = s.fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert len(row) == 1 and row[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row[0].near_next == 1


def by_loop(text):
    """Signatures as tuples, by a plain walk over the words."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    out = set()
    for strict in (True, False):
        for i, w in enumerate(words):
            if (w in s.ANCHORS) == strict:
                chain = [x for x in words[i + 1 :] if x not in s.ANCHORS][: s.CHAIN]
                if len(chain) == s.CHAIN:
                    out.add((w, *chain))
        if out:
            return out
    return {tuple(words)} if words else set()


def test_fingerprints_equal_a_plain_walk(spark):
    """Likenesses are those of the tuples; equal fingerprints are equal sets of tuples, rows of one doc_id and long texts included."""
    data = [(d, t) for d, t in rows()] + [(30 + i, f"text number {i % 7} of the long series with words w{i % 5} and v{i % 3} the end of it") for i in range(40)]
    data = [(d, t[:3000] if t else t) for d, t in data]
    got = s.fingerprints(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    texts = {}
    for d, t in data:
        texts.setdefault(d, []).append(t or "")
    order = [(None, texts[None][0])] + [(d, t) for d in sorted(x for x in texts if x is not None) for t in texts[d]]
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    prints = {}
    for i, (d, t) in enumerate(order):
        if d in (16, 20):  # which of the two rows of 20 comes first is up to a hash
            continue
        (r,) = found[d]
        after = order[(i + 1) % len(order)][1]
        assert abs(r.near_edited - jaccard(by_loop(t), by_loop(s.edited(t, after)))) < 1e-12 and abs(r.near_next - jaccard(by_loop(t), by_loop(after))) < 1e-12
        prints.setdefault(r.fingerprint, set()).add(frozenset(by_loop(t)))
    assert all(len(x) == 1 for x in prints.values()) and len(set.union(*map(set, prints.values()))) == len(prints)
    twenty = sorted(found[20], key=lambda r: r.n_chars)
    assert [r.n_chars for r in twenty] == sorted(len(t) for t in texts[20]) and {frozenset(by_loop(t)) for t in texts[20]} == {frozenset(by_loop(texts[20][0])), frozenset(by_loop(texts[20][1]))}
    ends = {(twenty[0].edited_sha256, twenty[1].edited_sha256)}
    a, b = sorted(texts[20], key=len)
    after = order[[d for d, _ in order].index(20) + 2][1]
    sha = lambda x, y: hashlib.sha256(s.edited(x, y).encode()).hexdigest()
    assert ends <= {(sha(a, b), sha(b, after)), (sha(a, after), sha(b, a))}


def test_a_third_of_all_rows_without_doc_id(spark):
    """Rows of one doc_id are in the order of their texts' hashes, over many ranges; copies of one row stand beside one another."""
    data = [(None, f"the text of row {i} and the rest of it {i * i}") for i in range(300)] + [(7, "the same text and the same end")] * 200 + [(10 + i, f"a text with number {i} in it") for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    got = s.fingerprints(df).collect()
    hashed = df.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    texts = [r.text for r in order]
    want = sorted((repr(r.doc_id), len(t), hashlib.sha256(s.edited(t, texts[(i + 1) % len(texts)]).encode()).hexdigest()) for i, (r, t) in enumerate(zip(order, texts, strict=True)))
    assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
