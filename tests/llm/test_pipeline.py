from pyspark.sql import functions as F

import corpus_pipeline
from fathom.llm import langid, mixing, neardup, packing
from fathom.llm.tables import cut, table

DATA = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = table(spark, DATA, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "secret_scan", "mixing", "packing"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(cut(stage(spark, seen[-1], DATA)))
    assert all(x.columns == docs.columns for x in seen[:-1])
    accepted, single, redacted, mixed, packed = seen[1:]
    und = langid.predict(docs, langid.learn(docs)).where("lang_pred = 'und'").select("doc_id")
    assert accepted.exceptAll(docs.join(und, "doc_id", "left_anti").select(docs.columns)).isEmpty()
    classes = neardup.near_duplicates(accepted).select("class_id").distinct()
    assert single.select("doc_id").exceptAll(classes).isEmpty() and single.count() == classes.count()
    assert redacted.count() == single.count() and redacted.where("text rlike 'AKIA[A-Z0-9]{16}'").isEmpty()
    taken = mixing.mix(redacted).agg(F.sum("epochs")).first()[0]
    assert mixed.count() == taken == packed.count() == packing.pack(mixed).count()


def test_edge_rows_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, bucket string"
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s1", 0, "b"), (3, "the cat", None, None, 7, "c"), (3, "the cat", None, None, 7, "c"), (None, "the dog", "en", "s1", 7, None), (4, "the end " * 20000, "en", "s1", 1, "d")]
    rows += [(i, f"the cat and the dog of house {i} ran to the cat {i * i}", "en", f"s{i % 5}", 40, "e") for i in range(10, 40)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, DATA))
        assert docs.count() >= (10 if data else 0)


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 100
