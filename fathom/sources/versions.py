"""Versioned tables in a folder: a version is whole once a pointer names it, and shares with the last one what it doesn't change.

A table is kept in buckets of a key.  A new version writes the buckets it changes under a name of its own, then its manifest (the
schema of each table, and for each bucket the version that wrote it), and moves the pointer last, by one rename.  A
run that dies before leaves the old version as it was, and files that nobody reads.  All files are reached through Hadoop's file system, so the
folder may lie in any store that Spark knows.  The manifest has a line for each bucket, however large the tables are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.operators.order import plain_unions

POINTER = "CURRENT"
BUCKETS = 64


class Files:
    """Small files below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm, self._conf = root.rstrip("/"), spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self._conf)
        return fs, fs.makeQualified(path)

    def read(self, name: str) -> str | None:
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file so that a reader sees the old one or the new one."""
        fs, path = self._at(name)
        _, part = self._at(f"{name}.{uuid.uuid4().hex}.part")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        how = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(how.OVERWRITE.getClass(), 1)
        options[0] = how.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self._conf).rename(part, path, options)

    def folders(self, name: str) -> list[str]:
        fs, path = self._at(name)
        return [x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()] if fs.exists(path) else []


def at_once(act: Callable[[Any], Any], items: Iterable[Any]) -> list:
    """What ``act`` gives for each of a few items, whose Spark jobs run side by side."""
    items = list(items)
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        return list(pool.map(act, items))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Store:
    """Versions of some tables that all have the column ``key``."""

    def __init__(self, spark: SparkSession, root: str, key: str = "module", buckets: int = BUCKETS):
        plain_unions(spark)  # what a version merges is grouped and joined
        self.spark, self.files, self.key, self.buckets = spark, Files(spark, root), key, buckets

    def current(self) -> str | None:
        return self.files.read(POINTER)

    def manifest(self, version: str | None = None) -> dict:
        """Of a version, or of the current one: {tables: {name: {schema, buckets: {bucket: version}}}, notes}."""
        version = version or self.current()
        return json.loads(self.files.read(f"manifests/{version}.json")) if version else {"tables": {}, "notes": {}}

    def table(self, name: str, schema: str, manifest: dict, only: Iterable[int] | None = None) -> DataFrame:
        """A table of a version, or the buckets ``only`` of it; one that the version doesn't have is empty."""
        held = manifest["tables"].get(name)
        wanted = None if only is None else {str(b) for b in only}
        paths = [f"{self.files.root}/data/{name}/{v}/_bucket={b}" for b, v in (held["buckets"] if held else {}).items() if wanted is None or b in wanted]
        return self.spark.read.schema(T.StructType.fromJson(held["schema"])).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that hold some keys: at most ``buckets`` numbers."""
        return sorted(r[0] for r in keys.select(bucket_of(F.col(self.key), self.buckets)).distinct().collect())

    def fresh(self) -> str:
        """A name for the next version."""
        return f"{int(self.current().split('-')[0]) + 1 if self.current() else 1:08d}-{uuid.uuid4().hex[:8]}"

    def add(self, version: str, rows: dict[str, tuple[DataFrame, str]]) -> None:
        """Write rows, {name: (rows, schema)}, of a version that isn't committed yet, tables side by side; they join those it has got before.

        The rows of a bucket are dealt to as many tasks as the session's partitions allow, whole keys to each, and lie by key in their files.
        """
        deal = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)

        def write(item: tuple[str, tuple[DataFrame, str]]) -> None:
            name, (own, schema) = item
            typed = own.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(schema)], bucket_of(F.col(self.key), self.buckets).alias("_bucket"))
            dealt = typed.repartition("_bucket", F.pmod(F.hash(self.key), F.lit(deal)))
            dealt.sortWithinPartitions("_bucket", self.key).write.mode("append").partitionBy("_bucket").parquet(f"{self.files.root}/data/{name}/{version}")

        at_once(write, rows.items())

    def merged(self, manifest: dict, version: str, changed: dict[str, tuple[str, list[int]]]) -> dict:
        """``manifest`` with some buckets of some tables, {name: (schema, buckets)}, as the version has them so far."""
        tables = dict(manifest["tables"])
        for name, (schema, buckets) in changed.items():
            written = {x.removeprefix("_bucket="): version for x in self.files.folders(f"data/{name}/{version}") if x.startswith("_bucket=")}
            before = tables.get(name, {"buckets": {}})["buckets"]
            kept = {b: v for b, v in before.items() if int(b) not in buckets}
            tables[name] = {"schema": T.StructType.fromDDL(schema).jsonValue(), "buckets": kept | written}
        return manifest | {"tables": tables}

    def commit(self, manifest: dict, version: str) -> str:
        """Make a version, whose rows are written, the current one."""
        self.files.put(f"manifests/{version}.json", json.dumps(manifest))
        self.files.put(POINTER, version)
        return version
