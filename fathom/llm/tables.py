"""Table access and session facts used by the operators of this subpackage."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from fathom.operators.order import cut

__all__ = ["arrow_batches", "cut", "partitions", "spare", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened as long as ``df`` has a column of that name, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """While a job runs here, batches sent to Python hold at most so many bytes; then the session's setting is back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)
