"""Numbering rows in a global order without one task that holds them all, and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; one is set only where none is."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fathom-"))
    return context._jsc.sc().getCheckpointDir().get()


def plain_unions(spark: SparkSession) -> None:
    """Let no plan rely on how the parts of a union are dealt.

    Spark 4.1 leaves out the shuffle after a union whose parts are dealt alike.  If one part is planned anew while the query runs (a join that becomes a
    broadcast), the union isn't dealt any more, but the shuffle stays left out: a join above it fails ("Can't zip RDDs with unequal numbers of partitions").
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def cut(df: DataFrame) -> DataFrame:
    """End the lineage: write ``df`` as Parquet below the shared folder and read it back."""
    return cut_at(df)[0]


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``cut``, and the folder of the written table."""
    path = f"{_shared(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` into as many partitions as the session has for shuffles, which Spark doesn't merge; so what a task holds doesn't depend on how few are busy."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one, as a path that both Spark and plain files know; a shared folder in another file system is refused."""
    path = re.sub(r"^file:/+", "/", f"{_shared(spark)}/files-{uuid.uuid4().hex}")
    if not path.startswith("/"):
        raise ValueError(f"plain files can't be written to {path}: only to a plain path or file:")
    return path


def numbered(rows: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """``rows`` with a number from 0 in ``order``, which must be total.

    Rows are dealt into ranges, and each range is numbered after the sizes of the ranges before it.  The ranges are cut,
    since their bounds come from a sample that another run would draw anew.
    """
    at = [f"_o{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(at, order, strict=True)))
    keyed = cut(keyed.repartitionByRange(*at).withColumn("_range", F.spark_partition_id()))
    sizes = keyed.groupBy("_range").agg(F.count("*").alias("_size"))  # a row for each range
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*at))
    out = keyed.withColumn("_nth", nth).join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return out.withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_range", "_nth", "_before", *at)
