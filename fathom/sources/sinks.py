"""Writers: line sets, JSON artifacts, link maps, ledgers and a binary search index."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.names import folds_apart, utf16_key
from fathom.operators.order import cut
from fathom.operators.search import MOST_SHARED, RESTART


def local(path: str | Path) -> Path:
    """A folder or file that all machines share under this path; a URI of another file system than the local one is refused."""
    text = str(path)
    if match := re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", text):
        if match[1].lower() != "file":
            raise ValueError(f"plain files can't be written to {text}: only a plain path or file:")
        text = re.sub(r"^file:/+", "/", text, flags=re.I)
    return Path(text)


def _put(path: str | Path, parts: Iterable[bytes]) -> int:
    """Write a file so that a reader sees the old one or the new one; returns its bytes."""
    target = local(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.{uuid.uuid4().hex}.part")
    n = 0
    with part.open("wb") as out:
        for data in parts:
            n += out.write(data)
    os.replace(part, target)
    return n


def _below(root: str, path: str) -> Path:
    base = local(root).resolve()
    target = (base / path).resolve()
    if base not in target.parents:
        raise ValueError(f"{path} is outside {root}")
    return target


def write_files(files: DataFrame, root: str) -> DataFrame:
    """A file for each row (path, body) below ``root``, a folder that driver and executors share; each task writes its own rows.

    A path that leaves the folder is refused.  A task that runs again writes the same files again.  Returns the other columns of ``files`` with path, and bytes
    and sha256 of what was written; it is a written table, so ``files`` runs once.
    """
    root = str(local(root))
    rest = [c for c in files.columns if c not in ("path", "body")]
    kinds = {f.name: f.dataType.simpleString() for f in files.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, sizes, hashes = batch.column("body").to_pylist(), [], []
            for path, body in zip(batch.column("path").to_pylist(), bodies, strict=True):
                sizes.append(_put(_below(root, path), [body]))
                hashes.append(hashlib.sha256(body).hexdigest())
            kept = [batch.column(c) for c in [*rest, "path"]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())], names=[*rest, "path", "bytes", "sha256"])

    rows = files.select(*rest, "path", F.col("body").cast("binary").alias("body"))
    return cut(rows.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in [*rest, "path"]] + ["bytes long", "sha256 string"])))


def write_table(df: DataFrame, path: str, keys: list[str]) -> None:
    """A table of any size, dealt out and sorted by its keys."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_lines(df: DataFrame, column: str, path: str) -> int:
    """A sorted set as a file of lines; an empty set is an empty file.  For answers that a person reads; they stream through the driver."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(utf16_key(F.col(column)))
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with target.open("w", encoding="utf-8") as out:
        for r in rows.toLocalIterator():
            out.write(r[0] + "\n")
            n += 1
    return n


def _array(df: DataFrame, keys: list[str], between: str = ",\n") -> Iterator[bytes]:
    """Rows in order of their keys as a JSON array, streamed: the driver holds a partition at a time."""
    rows = df.orderBy(*[utf16_key(F.col(k)) if dict(df.dtypes)[k] == "string" else F.col(k) for k in keys])
    yield b"["
    for i, r in enumerate(rows.select(F.to_json(F.struct(*df.columns)).alias("json")).toLocalIterator()):
        yield (between * (i > 0) + r.json).encode()
    yield b"]"


def write_artifact(df: DataFrame, path: str, keys: list[str]) -> None:
    """One JSON array, rows in order of their keys."""
    _put(path, (x for part in (_array(df, keys), [b"\n"]) for x in part))


#: The files of a site as a whole, in the order they are written.
ARTIFACTS = (
    "declarations/name-map.json",
    "index.html",
    "404.html",
    "search.html",
    "foundational_types.html",
    "modules.json",
    "search-index.bin",
    "instances.json",
    "declarations/used-by.json",
)


def write_artifacts(found: dict[str, bytes | tuple[DataFrame, list[str]]], root: str) -> list[str]:
    """All nine files of a site below ``root``, from bytes or from a table and its keys; one too many or too few is refused."""
    if set(found) != set(ARTIFACTS):
        raise ValueError(f"these files aren't as they should be: {', '.join(sorted(set(found) ^ set(ARTIFACTS)))}")
    for path in ARTIFACTS:
        body = found[path]
        _put(f"{root}/{path}", [body] if isinstance(body, bytes) else _array(*body))
    return list(ARTIFACTS)


def write_marker(path: str, facts: dict) -> None:
    _put(path, [(json.dumps(facts, sort_keys=True, ensure_ascii=False, indent=1) + "\n").encode()])


def write_ledger(entries: DataFrame, path: str, facts: dict, extract: dict[str, str], render: dict[str, str] | None) -> int:
    """A ledger (module, files, hash) as canonical JSON: its facts, its key sets and then its modules in the order of their names.

    ``facts``: ledgerSchema, algorithm, target, libDir, in this order.  Without a render key the file has none.
    """
    head = {**facts, "extractKey": extract} | ({"renderKey": render} if render is not None else {})
    begin = json.dumps(head, ensure_ascii=False, separators=(",", ":"))[:-1] + ',"modules":'
    rows = entries.select("module", "files", "hash")
    return _put(path, (x for part in ([begin.encode()], _array(rows, ["module"], ","), [b"}\n"]) for x in part))


LEDGER = "ledgerSchema BIGINT, algorithm STRING, target STRING, libDir STRING, extractKey MAP<STRING, STRING>, renderKey MAP<STRING, STRING>, modules ARRAY<STRUCT<module: STRING, files: ARRAY<STRUCT<path: STRING, bytes: BIGINT, hash: STRING>>, hash: STRING>>"


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(module, files, hash) and (scope, key, value) of a ledger."""
    row = spark.read.schema(LEDGER).json(path)
    keys = lambda scope, column: row.select(F.lit(scope).alias("scope"), F.explode(column).alias("key", "value"))
    return row.select(F.explode("modules").alias("m")).select("m.*"), keys("extract", "extractKey").unionByName(keys("render", "renderKey"))


DOCS_VERSION = 1


def write_docs_map(sites: DataFrame, declarations: DataFrame, modules: DataFrame, path: str, tool: str, version: int = DOCS_VERSION) -> int:
    """Where dependencies are documented, as one JSON file: ``sites`` (root, base, requestedNames) with the links of their ``declarations``
    and ``modules`` (root, name, link)."""
    links = lambda rows, name: rows.groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "link")))).alias(name))
    none = F.create_map().cast("map<string,string>")
    rows = sites.select("root", "base", "requestedNames")
    for part, name in ((declarations, "declarations"), (modules, "modules")):
        rows = rows.join(links(part, name), "root", "left").withColumn(name, F.coalesce(name, none))
    begin = f'{{"tool":{json.dumps(tool)},"version":{version},"roots":'
    return _put(path, (x for part in ([begin.encode()], _array(rows, ["root"]), [b"}\n"]) for x in part))


def read_docs_map(spark: SparkSession, path: str, version: int = DOCS_VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of a map of documentation; any other version, and a root without its parts, is refused."""
    schema = "version BIGINT, roots ARRAY<STRUCT<root: STRING, base: STRING, requestedNames: BIGINT, declarations: MAP<STRING, STRING>, modules: MAP<STRING, STRING>>>"
    row = spark.read.schema(schema).json(path, multiLine=True)
    found = row.select("version", F.col("roots").isNull().alias("none")).first()
    if found is None or found.version != version or found.none:
        raise ValueError(f"{path} is no map of documentation of version {version}")
    roots = row.select(F.explode("roots").alias("r")).select("r.*")
    lacking = roots.where("root is null or base is null or requestedNames is null or declarations is null or modules is null")
    if not lacking.isEmpty():
        raise ValueError(f"{path} has a root that lacks a part")
    links = lambda name: roots.select("root", F.explode(name).alias("name", "link"))
    return roots.select("root", "base", "requestedNames"), links("declarations"), links("modules")


def write_assets(files: dict[str, bytes], root: str) -> int:
    """Static files by name."""
    for name, data in files.items():
        _put(_below(root, name), [data])
    return len(files)


def write_link_map(entries: DataFrame, modules: DataFrame, path: str, omit: DataFrame | None = None) -> None:
    """Link map text, a module after another; ``omit`` (module) leaves modules out."""
    if omit is not None:
        entries, modules = entries.join(omit, "module", "left_anti"), modules.join(omit, "module", "left_anti")
    line = F.concat(F.lit("\t"), F.concat_ws("\t", "name", "line_from", "line_to"))
    body = entries.select("module", "name", line.alias("line")).groupBy("module").agg(F.array_sort(F.collect_list(F.struct("name", "line"))).alias("rows"))
    text = body.select("module", F.concat_ws("\n", F.col("module"), F.transform("rows", lambda r: r["line"])).alias("text")).unionByName(
        modules.join(body, "module", "left_anti").select("module", F.concat(F.lit("@"), "module").alias("text"))
    )
    write_lines_in_order(text, "text", "module", path)


def write_lines_in_order(df: DataFrame, column: str, key: str, path: str) -> None:
    target = local(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8") as out:
        for r in df.orderBy(utf16_key(F.col(key))).select(column).toLocalIterator():
            out.write(r[0] + "\n")


def write_tree(modules: DataFrame, root: str, dependencies: DataFrame | None = None, schema: int = 5, facts: dict | None = None) -> int:
    """A module tree: module files, dependency maps, and an index with counts, bytes and sha256 of what was written.

    ``modules``: (module, body), body a JSON text; ``dependencies``: (package, name, module).  Tasks write the files of their rows and report their sizes and hashes; the
    index, one entry a module, streams through the driver and is written last, so a tree that has one is whole.
    """
    n = F.coalesce(F.json_array_length(F.get_json_object("body", "$.declarations")), F.lit(0)).cast("long")
    rows = modules.select("module", "body", n.alias("declarations"), F.concat(F.lit("modules/"), "module", F.lit(".json")).alias("path"))
    listed = write_files(rows, root).select("module", F.col("path").alias("file"), "bytes", "declarations", F.col("sha256").alias("contentHash"))
    none = modules.sparkSession.createDataFrame([], "package string, name string, module string")
    maps = (none if dependencies is None else dependencies).groupBy("package").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "module")))).alias("declarations"))
    maps = maps.select("package", F.size("declarations").cast("long").alias("entries"), F.to_json(F.struct(F.lit(schema).alias("schemaVersion"), "package", "declarations")).alias("body"))
    maps = write_files(maps.withColumn("path", F.concat(F.lit("deps/"), "package", F.lit(".json"))), root)
    written, total = listed.agg(F.count("*"), F.coalesce(F.sum("declarations"), F.lit(0))).first()
    head = json.dumps({"schemaVersion": schema, **(facts or {}), "hashAlgorithm": "sha256", "moduleCount": written, "declarationCount": total}, ensure_ascii=False)[:-1]
    parts = ([f'{head}, "modules": '.encode()], _array(listed, ["module"]), [b', "dependencyMaps": '], _array(maps.select("package", F.col("path").alias("file"), "bytes", "entries"), ["package"]), [b"}\n"])
    _put(f"{root}/index.json", (x for part in parts for x in part))
    return written


#: The layout of a search index, little-endian.  A header of MAGIC, version, names, RESTART and nine numbers (offset and length of
#: the names, offset of the restarts, offset and length of the labels, offsets of kinds, modules and folds, length of the folds); then these
#: sections.  A name is the bytes it shares with the one before, the length of the rest (LONG: two more bytes hold it) and the rest.
MAGIC, VERSION, HEADER, LONG = b"LD4S", 2, 52, 255


def write_search_index(names: DataFrame, kinds: list[str], path: str) -> int:
    """Binary search index of (id, name, kind, module_id) in the order of id; kind is one of ``kinds``.  It is one file by its format, so it
    streams through the driver.  Returns the number of names."""
    if len(kinds) > 255:
        raise ValueError("a kind is one byte")
    body, restarts, kind_of, module_of, folds = bytearray(), bytearray(), bytearray(), bytearray(), bytearray()
    before, n, apart = b"", 0, 0
    number = {k: i for i, k in enumerate(kinds)}
    for r in names.select("id", "name", "kind", "module_id", folds_apart(F.col("name")).alias("fold")).orderBy("id").toLocalIterator():
        data = r.name.encode()
        if n % RESTART == 0:
            restarts += struct.pack("<I", len(body))
            before = b""
        shared = len(os.path.commonprefix([before[:MOST_SHARED], data]))
        rest = data[shared:]
        body += struct.pack("<BB", shared, len(rest)) if len(rest) < LONG else struct.pack("<BBH", shared, LONG, len(rest))
        body += rest
        kind_of.append(number[r.kind])
        module_of += struct.pack("<H", r.module_id)
        if r.fold is not None:
            apart += 1
            folds += struct.pack("<IH", n, len(r.fold.encode())) + r.fold.encode()
        before, n = data, n + 1
    labels = struct.pack("<I", len(kinds)) + b"".join(struct.pack("<B", len(k.encode())) + k.encode() for k in kinds)
    starts = [HEADER]
    for section in (body, restarts, labels, kind_of, module_of):
        starts.append(starts[-1] + len(section))
    head = MAGIC + struct.pack("<12I", VERSION, n, RESTART, starts[0], len(body), starts[1], starts[2], len(labels), starts[3], starts[4], starts[5], 4 + len(folds))
    _put(path, [head, bytes(body), bytes(restarts), labels, bytes(kind_of), bytes(module_of), struct.pack("<I", apart), bytes(folds)])
    return n


def read_search_index(path: str) -> list[tuple[int, str, str, int, str]]:
    """(id, name, kind, module_id, folded name) of a search index."""
    data = Path(path).read_bytes()
    if data[:4] != MAGIC or struct.unpack_from("<I", data, 4)[0] != VERSION:
        raise ValueError("not a search index of this version")
    n, every, at, _, _, labels, _, kind_at, module_at, fold_at, _ = struct.unpack_from("<11I", data, 8)
    names, last = [], b""
    for i in range(n):
        shared, size = data[at], data[at + 1]
        at += 2
        if size == LONG:
            (size,) = struct.unpack_from("<H", data, at)
            at += 2
        last = (b"" if i % every == 0 else last[:shared]) + data[at : at + size]
        at += size
        names.append(last.decode())
    kinds, at = [], labels + 4
    for _ in range(struct.unpack_from("<I", data, labels)[0]):
        kinds.append(data[at + 1 : at + 1 + data[at]].decode())
        at += 1 + data[at]
    folded, at = {}, fold_at + 4
    for _ in range(struct.unpack_from("<I", data, fold_at)[0]):
        i, size = struct.unpack_from("<IH", data, at)
        folded[i] = data[at + 6 : at + 6 + size].decode()
        at += 6 + size
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [(i, x, kinds[data[kind_at + i]], struct.unpack_from("<H", data, module_at + 2 * i)[0], folded.get(i, x.translate(low))) for i, x in enumerate(names)]
