"""The corpus pipeline: language ID, near-duplicate removal, secret redaction, mixing and packing of documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet, and what is read back is the
next one's docs.  All but the last return the columns of documents.  Each takes any table with these columns, an empty one too; other
columns stay, whatever their names.  Texts stay whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import langid, mixing, neardup, packing, secrets
from fathom.llm.tables import cut, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language stay, in one pass without a shuffle of texts; a null or `und` lang becomes the predicted one.

    Null, empty and letterless texts go, and texts that no learned language codes within the bound; repeated rows are judged alike.
    """
    return langid.accept(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: a text of the least doc_id.

    Texts are shuffled once to those they share a band with and never all to one task; a repeated row stays once, a null doc_id only where its
    class has no other, texts without words each.
    """
    return neardup.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets give way to their kind.

    Only candidates are shuffled and counted, and their answers joined back to the documents.  A null text stays null, a null source is an owner of its
    own, repeated rows are redacted alike.
    """
    return secrets.redact(docs, F.concat_ws("/", "source", "lang"), F.col("source"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the budgets of their sources take them, at most mixing.MAX_EPOCHS times.

    Sums by leaf and by part of a leaf's order decide; no task sorts a leaf.  Null languages and sources are the leaf `?`, a text without words
    costs nothing, rows that repeat a doc_id share a place in the order.
    """
    return mixing.sampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and slot; rows are doc_id, n_tokens, bucket, padded, batch, slot.

    Only the histogram of lengths reaches the driver.  Null and empty texts have length 0; repeated rows, as mixing makes them, are packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("secret_scan", redact),
    ("mixing", mix),
    ("packing", pack),
]
#: SQL can express neither the model of the first stage nor the classes of the second.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
