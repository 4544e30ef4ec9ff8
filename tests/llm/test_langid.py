import math
import random

from pyspark.sql import functions as F

from fathom.llm import langid
from fathom.llm.tables import table


def brute(model_texts, text):
    """Code length by walking the tree of one language with no table."""
    seen = {}
    for t in model_texts:
        data = b" " * langid.ORDER + t
        for i in range(langid.ORDER, len(data)):
            for order in range(langid.ORDER + 1):
                seen.setdefault(data[i - order : i], {}).setdefault(data[i], 0)
                seen[data[i - order : i]][data[i]] += 1
    bits, data = 0.0, b" " * langid.ORDER + text
    for i in range(langid.ORDER, len(data)):
        for order in range(langid.ORDER, -2, -1):
            if order < 0:
                bits += 8
                break
            found = seen.get(data[i - order : i])
            if found is None:
                continue
            total = sum(found.values()) + len(found)
            if data[i] in found:
                bits -= math.log2(found[data[i]] / total)
                break
            bits -= math.log2(len(found) / total)
    return bits


def test_code_lengths_equal_a_tree_walk():
    rng = random.Random(1)
    texts = {x: ["".join(rng.choice(letters) for _ in range(300)).encode() for _ in range(3)] for x, letters in (("aa", "abc "), ("bb", "bcdé "))}
    texts["cc"] = [b"a    b  c   d" * 40, b"    b", b"   "]
    model = langid.fit(texts)
    tests = [b"abcabc", "é d b".encode(), b"", b"zz", b"abcd " * 900, b"     a    b", bytes(range(256))]
    got = langid.code_lengths(model, tests)
    for i, t in enumerate(tests):
        for k, x in enumerate(model.languages):
            assert math.isclose(got[i, k], brute(texts[x], t), rel_tol=1e-4, abs_tol=1e-3)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_edge_rows(spark):
    rows = [(1, "le la", "fr"), (2, None, "fr"), (3, "", None), (4, "12 34 !", "en"), (None, "der die", "de"), (6, "the of and", "en"), (6, "the of and", "en"), (8, "the " * 60000, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 6, 8)] == ["fr", "und", "und", "und", "en", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].held_out is False
    kept = langid.accept(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 6, 6, 8]
    empty = docs.limit(0)
    assert langid.learn(empty) is None and langid.predict(empty, None).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_every_labelled_language_is_learned(spark):
    """More than 64 languages, each in letters of its own; the last has the fewest rows."""
    word = lambda k, n: "".join(chr(0x4E00 + 40 * k + (7 * n + j) % 40) for j in range(12))
    rows = [(100 * k + n, f"{word(k, n)} {word(k, n + 1)}", f"l{k:03}") for k in range(70) for n in range(5 if k < 69 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.learn(docs)
    assert model.languages == [f"l{k:03}" for k in range(70)]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert got == {d: x for d, _, x in rows}
    assert langid.accept(docs).count() == len(rows)


def test_contexts_of_a_language_do_not_depend_on_the_others():
    rng = random.Random(2)
    texts = {f"l{k:02}": ["".join(rng.choice("abcdefghij ") for _ in range(4000)).encode()] for k in range(40)}
    one = langid.code_lengths(langid.fit({"l00": texts["l00"]}), texts["l00"])
    assert langid.code_lengths(langid.fit(texts), texts["l00"])[0, 0] == one[0, 0]


def test_repeated_ids_and_null_texts_do_not_hide_a_language(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(50)] + [(d, "le chat et la souris", "fr") for d in (7, 8)] * 40 + [(i, None, "de") for i in range(100, 160)] + [(160, "der die das", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.learn(docs, sample=2).languages == ["de", "en", "fr"]


def test_noise_is_rejected_and_clean_texts_stay(spark):
    rows = [r.text.encode() for r in table(spark, "/root/testdata/sf0.1", "documents").where("lang = 'en' and text <> ''").orderBy("doc_id").select("text").limit(500).collect()]
    model = langid.fit({"en": rows[:300]})
    rng = random.Random(4)
    clean = rows[300:] + [x[:200].upper() for x in rows[300:350]] + [b" ".join(w if i % 3 != 1 else b"%d" % rng.randrange(10**6) for i, w in enumerate(x.split()[:60])) for x in rows[300:350]]
    assert all(langid.fits(model, clean)) and all(langid.fits(model, [x.split()[0] for x in rows[300:] if x.split()[0].isalpha()]))
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)).encode() for _ in range(50)]
    assert not any(langid.fits(model, noise))
    assert langid.fits(model, [None, b"", b"12 34"]) == [False] * 3
    few = langid.fit({"en": [b"the cat and the dog"]})
    assert langid.fits(few, [b"a quite different sentence about nothing at all"]) == [True]


def test_code_lengths_of_real_texts_are_exact_at_the_default_sample(spark):
    """All contexts of the learned texts count, however many there are."""
    rows = [r.text.encode() for r in table(spark, "/root/testdata/sf0.01", "documents").where("lang = 'de' and text <> ''").orderBy("doc_id").select("text").limit(60).collect()]
    model = langid.fit({"de": rows[:50]})
    got = langid.code_lengths(model, rows[50:])
    assert len(model.trees[0].escape) > 8000
    for i, t in enumerate(rows[50:53]):
        assert math.isclose(got[i, 0], brute(rows[:50], t), rel_tol=1e-4)


def test_the_sample_is_bounded_in_texts_and_bytes(spark):
    rows = [(i, "the cat " * 10, "en") for i in range(40)] + [(7, "le chat et " * 100, "fr")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.learn(docs, sample=12, sample_bytes=300)
    assert dict(zip(model.languages, [t.learned for t in model.trees], strict=True)) == {"en": 240, "fr": 1100}


def test_accepted_rows_without_a_label_get_the_predicted_one(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et la souris", "fr"), (3, "la souris", None), (4, "the dog", "und"), (5, "der hund und die katze", "de"), (6, "12", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang for r in langid.accept(docs).collect()} == {1: "en", 2: "fr", 3: "fr", 4: "en", 5: "de"}


def test_junk_goes_and_clean_text_stays(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "lang").limit(1500)
    rng = random.Random(6)
    junk = [(-1 - i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400)), None) for i in range(40)] + [(-100 - i, "%$ 12 #" * 30, None) for i in range(5)]
    kept = langid.accept(docs.unionByName(docs.sparkSession.createDataFrame(junk, "doc_id long, text string, lang string")))
    assert kept.where("doc_id < 0").isEmpty()
    clean = docs.where(F.length("text") > 0)
    assert kept.count() >= clean.count() - 3


def test_wrong_answers_score_lower(spark):
    """Pieces of one to three words of held-out texts: the mean score is near the share of right answers, and wrong ones have less."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.held_out(F.col("doc_id"))
    model = langid.learn(docs.where(~held))
    pieces = []
    for r in docs.where(held & F.col("lang").isNotNull()).select("text", "lang").collect():
        words = (r.text or "").split()
        pieces += [(" ".join(words[i : i + 1 + i % 3]).encode(), r.lang) for i in range(0, min(len(words), 60), 7)]
    found, scores, _ = langid.score(model, [t for t, _ in pieces])
    known = [(f == want, s) for f, s, (_, want) in zip(found, scores, pieces, strict=True) if f != "und"]
    right, wrong = ([s for ok, s in known if ok is kind] for kind in (True, False))
    mean = lambda x: sum(x) / len(x)
    assert len(wrong) > 5 and mean(wrong) < mean(right) - 0.15
    assert abs(mean([s for _, s in known]) - len(right) / len(known)) < 0.05
