"""Readers: module trees in JSON, link maps, module lists, run logs, site pages, import headers, configuration files."""

from __future__ import annotations

import json
import shutil
import tomllib
import urllib.parse
import urllib.request
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.names import utf16_key
from fathom.operators.order import cut

#: The wire format.  Spans and references are arrays of mixed scalars and load as arrays of strings.
OLDEST = 5
INDEX = (
    "schemaVersion BIGINT, generator STRING, leanVersion STRING, hashAlgorithm STRING, moduleCount BIGINT, declarationCount BIGINT, ablations ARRAY<STRING>, "
    "modules ARRAY<STRUCT<module: STRING, file: STRING, bytes: BIGINT, declarations: BIGINT, contentHash: STRING>>, "
    "dependencyMaps ARRAY<STRUCT<package: STRING, file: STRING, entries: BIGINT, bytes: BIGINT>>"
)
DECLARATION = (
    "name: STRING, kind: STRING, modifiers: ARRAY<STRING>, binders: ARRAY<STRING>, implicits: ARRAY<BOOLEAN>, binderCode: ARRAY<ARRAY<ARRAY<STRING>>>, type: STRING, "
    "typeCode: ARRAY<ARRAY<STRING>>, line: BIGINT, col: BIGINT, endLine: BIGINT, endCol: BIGINT, selectionRange: ARRAY<BIGINT>, index: BIGINT, "
    "members: ARRAY<STRUCT<label: STRING, name: STRING, text: STRING, code: ARRAY<ARRAY<STRING>>, binders: ARRAY<STRING>, implicits: ARRAY<BOOLEAN>, "
    "binderCode: ARRAY<ARRAY<ARRAY<STRING>>>, doc: STRING, isDirect: BOOLEAN>>, "
    "doc: STRING, equations: ARRAY<STRING>, equationCode: ARRAY<ARRAY<ARRAY<STRING>>>, refs: ARRAY<ARRAY<STRING>>, attrs: ARRAY<STRING>, "
    "instClass: STRING, instTypes: ARRAY<STRING>, sorry: STRING, generated: ARRAY<STRING>"
)
MODULE = (
    "schemaVersion BIGINT, module STRING, imports ARRAY<STRING>, moduleDocs ARRAY<STRUCT<line: BIGINT, col: BIGINT, text: STRING>>, "
    "tactics ARRAY<STRUCT<internalName: STRING, userName: STRING, tags: ARRAY<STRING>, docString: STRING>>, "
    f"declarations ARRAY<STRUCT<{DECLARATION}>>"
)
#: Lines of a link map that are searched for a header together.
BLOCK = 10_000
DEPENDENCY = "schemaVersion BIGINT, package STRING, declarations MAP<STRING, STRING>"


def _unknown(text: Column, kind: T.StructType, path: str = "") -> Column:
    """Keys of a JSON object, and of the objects in its arrays, that the schema doesn't have, with the way to them."""
    none = F.array().cast("array<string>")
    own = F.array_except(F.coalesce(F.json_object_keys(text), none), F.array(*[F.lit(f.name) for f in kind]))
    found = [F.transform(own, lambda k: F.concat(F.lit(path), k))]
    for field in kind:
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            parts = F.coalesce(F.from_json(F.get_json_object(text, f"$.{field.name}"), "array<string>"), none)
            found.append(F.flatten(F.transform(parts, _inside(field.dataType.elementType, f"{path}{field.name}."))))
    return F.array_distinct(F.concat(*found))


def _inside(kind: T.StructType, path: str):
    return lambda text: _unknown(text, kind, path)


def _read(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON files, one row each; a key that the schema doesn't have, at any depth, is refused."""
    raw = spark.read.text(pattern, wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
    extra = _unknown(F.col("value"), T.StructType.fromDDL(schema))
    raw = raw.withColumn("_extra", extra)
    known = F.when(F.size("_extra") > 0, F.raise_error(F.concat(F.lit("unknown keys: "), F.array_join("_extra", ", "), F.lit(" in "), F.col("_path"))))
    row = F.from_json(F.when(known.isNull(), F.col("value")), schema, {"mode": "FAILFAST"})
    return raw.select("_path", row.alias("r")).select("_path", "r.*")


def open_unvalidated(spark: SparkSession, root: str) -> DataFrame:
    """The index of a tree: one row."""
    return _read(spark, f"{root}/index.json", INDEX).drop("_path")


def open_tree(spark: SparkSession, root: str) -> DataFrame:
    """The index, refused if its schema is too old or the tree was written with parts left out."""
    old = F.when(F.coalesce("schemaVersion", F.lit(0)) < OLDEST, F.raise_error(F.concat(F.lit(f"schema version must be {OLDEST} or later, it is "), F.col("schemaVersion").cast("string"))))
    cut = F.when(F.size(F.coalesce("ablations", F.array().cast("array<string>"))) > 0, F.raise_error(F.lit("the tree was written with parts left out")))
    return open_unvalidated(spark, root).withColumn("schemaVersion", F.when(old.isNull() & cut.isNull(), F.col("schemaVersion")))


def entries(index: DataFrame) -> DataFrame:
    return index.select(F.posexplode("modules").alias("ord", "e")).select("ord", "e.*")


def modules(spark: SparkSession, root: str) -> DataFrame:
    """All module files in one scan; a file whose own name isn't the index's is refused."""
    rows = _read(spark, f"{root}/modules/*.json", MODULE).withColumn("file", F.regexp_extract("_path", r"(modules/[^/]+)$", 1))
    known = entries(open_tree(spark, root)).select(F.col("module").alias("_listed"), "file", "ord", "bytes", "contentHash")
    rows = rows.join(known, "file")
    wrong = F.when(F.col("module") != F.col("_listed"), F.raise_error(F.concat("file", F.lit(" holds "), "module", F.lit(", not "), "_listed")))
    return rows.withColumn("module", F.when(wrong.isNull(), F.col("module"))).drop("_path", "_listed")


def declarations(mods: DataFrame) -> DataFrame:
    """One row a declaration, with the order of its module and its own."""
    return mods.select("module", F.col("ord").alias("module_ord"), "schemaVersion", F.posexplode("declarations").alias("decl_ord", "d")).select("module", "module_ord", "schemaVersion", "decl_ord", "d.*")


def references(decls: DataFrame) -> DataFrame:
    """(user_module, user, module, name) of every reference."""
    return decls.select(F.col("module").alias("user_module"), F.col("name").alias("user"), F.explode("refs").alias("r")).select("user_module", "user", F.col("r")[0].alias("module"), F.col("r")[1].alias("name"))


def attributes(attrs: Column) -> Column:
    """Attributes as [name] or [name, value]; both wire shapes, a bare string and a pair, are accepted."""
    return F.transform(attrs, lambda a: F.when(a.startswith("["), F.from_json(a, "array<string>")).otherwise(F.array(a)))


def spans(code: Column) -> Column:
    """Mixed tuples as structs (start, stop, kind, name, front, back)."""
    at = lambda s, i: F.get(s, F.lit(i))
    return F.transform(
        code,
        lambda s: F.struct(
            at(s, 0).cast("int").alias("start"), at(s, 1).cast("int").alias("stop"), at(s, 2).cast("int").alias("kind"), at(s, 3).alias("name"), at(s, 4).cast("int").alias("front"), at(s, 5).cast("int").alias("back")
        ),
    )


def dependency_maps(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/deps/*.json", DEPENDENCY).select("package", F.explode("declarations").alias("name", "module"))


def link_map(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(name, module, line_from, line_to) and (module) of link maps.

    Lines are `#` comments, `@` modules, headers (a module), or entries under the last header, which begin with a tab.  A file of any size is read
    by many tasks, a split each; a line's place is where its split begins and its number there.  The lines of a split are cut into blocks of BLOCK lines; an
    entry takes the last header of its block or else the last one of the blocks and splits before, so no task walks a whole map.  Of repeated names the last wins.
    """
    text = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("line"))
    text = cut(text.where(~F.col("line").startswith("#") & (F.trim("line") != "")))  # written, so the numbers stay
    text = text.withColumns({"i": F.struct("start", "nth"), "block": F.struct("start", F.floor(F.col("nth") / BLOCK).alias("part"))})
    entry, listed = F.col("line").startswith("\t"), F.col("line").startswith("@")
    module = text.where(~entry).select(F.when(listed, F.substring("line", 2, 1 << 20)).otherwise(F.col("line")).alias("module")).distinct()
    head = F.when(~entry & ~listed, F.col("line"))
    last = text.withColumn("head", head).groupBy("path", "block").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("i"))).alias("own"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("path", "block", F.last("own", ignorenulls=True).over(earlier).alias("before"))
    inside = Window.partitionBy("path", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = text.withColumn("own", F.last(head, ignorenulls=True).over(inside)).where(entry).join(last, ["path", "block"])
    part = F.split("line", "\t")
    rows = found.select("path", "i", part[1].alias("name"), F.coalesce("own", "before").alias("module"), F.get(part, F.lit(2)).cast("long").alias("line_from"), F.get(part, F.lit(3)).cast("long").alias("line_to"))
    rows = rows.where("module is not null").groupBy("name").agg(F.max_by(F.struct("module", "line_from", "line_to"), F.struct("path", "i")).alias("v")).select("name", "v.*")
    return rows, module


def module_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("module")).where("module <> '' and not startswith(module, '#')")


def source_modules(spark: SparkSession, root: str, extension: str = "lean") -> DataFrame:
    """Modules of the source files below a folder, in UTF-16 order; no file at all is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(root).select("path")
    base = root.rstrip("/").removeprefix("file:")
    name = F.regexp_replace(F.substring_index("path", f"{base}/", -1), rf"\.{extension}$", "")
    rows = files.select(F.replace(name, F.lit("/"), F.lit(".")).alias("module")).distinct()
    if rows.isEmpty():
        raise FileNotFoundError(f"no source below {root}")
    return rows.orderBy(utf16_key(F.col("module")))


def fingerprints(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, hash) of files; a `.hash` file beside one holds its hash already."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = files.select("path", F.col("length").alias("bytes"), "content")
    sides = rows.where(F.col("path").endswith(".hash")).select(F.regexp_replace("path", r"\.hash$", "").alias("path"), F.trim(F.col("content").cast("string")).alias("_side"))
    own = rows.where(~F.col("path").endswith(".hash")).join(sides, "path", "left")
    return own.select("path", "bytes", F.coalesce("_side", F.sha2("content", 256)).alias("hash"))


def cached_state(spark: SparkSession, path: str, versions: dict[str, str]) -> DataFrame:
    """A cached table; all of it is dropped on any other version."""
    rows = spark.read.parquet(path)
    return rows.where(F.lit(True) if not versions else " and ".join(f"{k} = '{v}'" for k, v in versions.items()))


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """(phase, pid, us, module, counters): every other numeric key of a line is a counter."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    fields = F.from_json("value", "map<string,string>")
    numeric = F.map_filter(fields, lambda k, v: ~k.isin("phase", "pid", "us", "module") & v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"))
    return raw.select(fields.alias("f"), numeric.alias("c")).select(
        F.col("f.phase").alias("phase"), F.col("f.pid").cast("long").alias("pid"), F.col("f.us").cast("long").alias("us"), F.col("f.module").alias("module"), F.transform_values("c", lambda k, v: v.cast("double")).alias("counters")
    )


def folded_timings(log: DataFrame) -> DataFrame:
    """One record of a run: microseconds by phase, and all counters summed."""
    phases = log.groupBy("phase").agg(F.sum("us").alias("us")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "us")))).alias("phases"))
    sums = log.select(F.explode("counters").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("counters"))
    return phases.crossJoin(sums)  # one row each


def pages(html: DataFrame, page: str, text: str) -> DataFrame:
    """(page, ids, hrefs, resources) of HTML texts."""
    found = lambda pattern: F.regexp_extract_all(F.col(text), F.lit(pattern), 1)
    return html.select(page, found(r'\sid="([^"]*)"').alias("ids"), found(r'<a\s[^>]*?href="([^"]*)"').alias("hrefs"), found(r'<(?:script|img|link)\s[^>]*?(?:src|href)="([^"]*)"').alias("resources"))


#: A start tag with its attributes in any quotes, and one attribute.
_TAG = r"<([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
_ATTRIBUTE = r"([^\s\"'<>/=]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)"


def unescaped(text: Column) -> Column:
    """Text with the five escapes that pages are written with undone."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_files(spark: SparkSession, root: str) -> DataFrame:
    """(page, html) of the pages below a folder, by their paths in it."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html")
    base = root.rstrip("/").removeprefix("file:")
    return files.select(F.url_decode(F.substring_index(F.col("_metadata.file_path"), f"{base}/", -1)).alias("page"), F.col("value").alias("html"))


def page_parts(html: DataFrame) -> DataFrame:
    """(page, kind, value) of pages (page, html): `anchor` of every id, `decl` of those of sections of class decl, `href` of links, `resource` of
    what scripts, images and sheets load.  Comments and what scripts and styles hold are no tags; attributes have any quotes or none."""
    plain = F.regexp_replace("html", r"(?s)<!--.*?(?:-->|\z)", "")
    plain = F.regexp_replace(plain, r"(?is)(<(script|style)\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>).*?(?:</\2\s*>|\z)", "$1")
    tags = html.select("page", F.explode(F.regexp_extract_all(plain, F.lit(_TAG), 0)).alias("tag"))
    tags = tags.select("page", F.lower(F.regexp_extract("tag", _TAG, 1)).alias("name"), F.regexp_extract("tag", _TAG, 2).alias("rest"))
    pairs = F.transform(F.regexp_extract_all("rest", F.lit(_ATTRIBUTE), 0), lambda a: F.struct(F.lower(F.regexp_extract(a, _ATTRIBUTE, 1)).alias("k"), unescaped(F.regexp_replace(F.regexp_extract(a, _ATTRIBUTE, 2), "^[\"']|[\"']$", "")).alias("v")))
    tags = tags.withColumn("a", pairs)
    of = lambda key: F.get(F.filter("a", lambda x: x["k"] == key), F.lit(0))["v"]  # noqa: E731  the first of a name counts
    decl = (F.col("name") == "section") & F.array_contains(F.split(F.coalesce(of("class"), F.lit("")), r"\s+"), "decl")
    loads = F.when(F.col("name").isin("script", "img"), of("src")).when(F.col("name") == "link", of("href"))
    part = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    parts = F.array(part("anchor", of("id")), part("decl", F.when(decl, of("id"))), part("href", F.when(F.col("name") == "a", of("href"))), part("resource", loads))
    return tags.select("page", F.explode(F.filter(parts, lambda p: p["value"].isNotNull())).alias("p")).select("page", "p.kind", "p.value")


def imports(texts: DataFrame, module: str, text: str) -> DataFrame:
    """(module, import): import lines before the first line that is none, block comments skipped."""
    plain = F.regexp_replace(F.col(text), r"(?s)/-.*?-/", "")
    head = F.regexp_extract(plain, r"(?s)\A((?:\s*(?:--[^\n]*|prelude\b[^\n]*|module\b[^\n]*|(?:public\s+|meta\s+)*import\s+[^\n]*)(?:\n|\z))*)", 1)
    return texts.select(module, F.explode(F.regexp_extract_all(head, F.lit(r"(?m)^\s*(?:public\s+|meta\s+)*import\s+(?:all\s+)?([^\s]+)"), 1)).alias("import"))


def external_table(spark: SparkSession, path: str, wanted: DataFrame, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """Wanted declarations (name, kind, docLink) and modules (module, url) below the roots; both sections must be there."""
    schema = "declarations MAP<STRING, STRUCT<kind: STRING, docLink: STRING>>, modules MAP<STRING, STRUCT<importedBy: ARRAY<STRING>, url: STRING>>"
    row = spark.read.schema(schema).json(path, multiLine=True)
    whole = row.where(F.col("declarations").isNull() | F.col("modules").isNull())
    if not whole.isEmpty():
        raise ValueError(f"{path} lacks declarations or modules")
    decls = row.select(F.explode("declarations").alias("name", "d")).select("name", "d.*").join(wanted.select("name").distinct(), "name", "left_semi")
    mods = row.select(F.explode("modules").alias("module", "m")).select("module", "m.url").where(F.split_part("module", F.lit("."), F.lit(1)).isin(roots))
    return decls, mods


def libraries(path: str) -> list[str]:
    """Library names of a TOML build file."""
    if not path.endswith(".toml"):
        raise ValueError("only a TOML build file can be read")
    found = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("lean_lib", [])
    return [x["name"] for x in found if "name" in x]


def manifest(path: str) -> list[dict]:
    """Packages of a manifest: name, url and a full commit hash, or null for anything else."""
    packages = json.loads(Path(path).read_text(encoding="utf-8")).get("packages", [])
    full = lambda r: r if isinstance(r, str) and len(r) == 40 and set(r) <= set("0123456789abcdef") else None
    return [{"name": p.get("name"), "url": p.get("url"), "rev": full(p.get("rev"))} for p in packages]


def site_config(path: str, allowed: tuple[str, ...] = ("title", "intro")) -> dict:
    """A flat TOML file with no other keys than ``allowed``; a missing file has none."""
    file = Path(path)
    found = tomllib.loads(file.read_text(encoding="utf-8")) if file.exists() else {}
    if unknown := sorted(set(found) - set(allowed)):
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    return found


def download(url: str, path: str, timeout: float = 30.0) -> int:
    """Fetch a remote table to a file on the driver; readers then take the file.  Only http and https; returns its bytes."""
    if urllib.parse.urlsplit(url).scheme not in ("http", "https"):
        raise ValueError(f"not a web address: {url}")
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    with urllib.request.urlopen(url, timeout=timeout) as answer, part.open("wb") as out:  # noqa: S310
        shutil.copyfileobj(answer, out)
    part.replace(target)
    return target.stat().st_size
