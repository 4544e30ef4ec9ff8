"""HTML extraction by nearest-URL page differencing, after the page's own structure.

A page is cut into lines (the texts of its blocks).  Lines inside menus, headers, footers, sidebars, notices, adverts,
forms, scripts and reader comments go, by tag, role and class.  Every page is differenced: pages are paired by URL path within
their host (marked ones with marked ones, the others with each other), the lines of a page and of its pair are aligned by longest common subsequence, and shared lines are deleted.  A check by structure follows on pages that
mark their article (``article``, ``main``, or a class or id that says so): the text is all lines inside it, so shared ones that it holds come back, and what is around it goes.

So on a marked page the check has the last word.  Differencing alone would delete what the contract keeps (passages and
license lines that neighbouring articles share), and it misses boilerplate that the nearest page words differently.

Scale.  Each page is parsed twice, in time proportional to its length: for the hashes of its lines, of which the pairs are made, and for its text, so that no text is
written but for the one join with what was shared.  Keys (host, path) are sorted in ranges, neighbours
across ranges are matched from one row a range, and each page meets the hashes (64 bits) of the lines of one other page.  Pages of one host with the
same lines share one place in the order, so copies get a pair that differs, and are differenced once.  The alignment needs memory for one row of the
table of lengths (it divides the problem at the middle), whatever the number of lines.

Defined results.  Null html is empty; an empty page has an empty text.  A page alone on its host, or all of whose
lines are shared (it is a part of its pair), keeps them.  A null URL is a host of its own.  Rows that repeat are each extracted.
A tag that the page's end cuts off is dropped.  A marked ``main`` inside what is
dropped by class, role or as a form is kept, and so is an ``article``, there if the page marks no other; not inside ``aside``,
``dialog`` or what is hidden.  Inside an article classes say less: a container named header stays, one named as navigation goes only if all its text is in
links, one named as a banner or legal note only if it holds no heading; adverts, comments, notices, forms, sidebars and sharing go.  A button or label in the middle of
a paragraph is part of it.  What drawings, media, lists of choices and templates hold is no text; of a
drawing or medium that is self-closed or has no end tag nothing is inside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.tables import cut, partitions, table

#: Elements whose content is no markup; without an end tag it runs to the page's end.
_RAW = r"|<(script|style|noscript|iframe|textarea|title)(?=[\s/>])(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
_MARKUP = (
    r"|<(/?)([a-zA-Z][^\s/<>\"']*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?][^>]*>"
    r"|</?[a-zA-Z!?][^<>]*\Z"
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)" + _RAW + _MARKUP, re.S | re.I)
#: Inside a drawing no element is raw; the empty group keeps the numbers of the others.
_DRAWN = re.compile(r"<!--.*?(?:-->|\Z)|(?!)()" + _MARKUP, re.S | re.I)
#: Elements by their meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav "
    "ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form button menu dialog head fieldset label".split())
#: Elements that show something else than what they hold; of those in EMPTY without an end tag nothing is inside.
EMBEDDED = frozenset("svg object canvas audio video select template".split())
EMPTY = EMBEDDED - {"select", "template"}
#: Start tags that end a drawing, and elements of a drawing that hold HTML.
BREAKS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HOLDS = frozenset("foreignobject desc title".split())
#: Start tags that end an open paragraph, or an open one of their own if they are items; and what an end doesn't reach beyond.
ITEMS = frozenset("li dt dd tr td th option".split())
ENDING = ITEMS.union("p div ul ol section article main table h1 h2 h3 h4 h5 h6".split())
FENCE = ("ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "aside", "blockquote")
HEAD = frozenset("base link meta noscript script style template title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of classes and ids.  A class counts if all its words do: one at least of NAMES, the others of PARTS or numbers;
#: so "ad", "cookie-notice" and "sidebar_left" do, "has-sidebar", "no-comments" and "page-with-nav" don't.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promotions banner cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe signup login sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead header comment comments disqus replies respond related recommended share sharing social "
    "widget toolbar pagination pager search disclaimer alert toast cta copyright sitemap skip legal".split()
)
PARTS = frozenset(
    "site page main post article entry story global top bottom left right upper lower primary secondary inner outer area bar block body box button buttons container content dialog form group holder icon "
    "icons inline item items label link links list media message meta nested author reply section slot small large mobile desktop sticky fixed text thread title unit widgets wrap wrapper zone x px the of and to us by".split()
)
#: Inside a marked article the classes of these only count if they are of ADVERTS: "entry-header" is a heading's, "legal" a paragraph's.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figcaption em strong b i a code fieldset li dl dt dd table tr td th caption figure".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos newsletter comment comments".split())
#: There a container named by HEADINGS stays, one named by LINKED goes if its text is all in links, and one named by LEGAL if it holds no heading.
HEADINGS = frozenset(("header", "masthead"))
LINKED = frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager sitemap skip".split())
LEGAL = frozenset("banner disclaimer legal copyright cta".split())
TITLES = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Classes and ids that mark the article where no element does.
CONTENT = re.compile(r"(?:^|\s)(?:(?:article|post|entry|story|main|page)[_-]?(?:body|content|text)|content|main|article)(?=$|\s)", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_READ = re.compile(r"class|id|role|hidden", re.I)
#: _GONE, _FORM and _NEVER are dropped.  A marked article opens again inside _FORM, and inside _GONE as _SPARE: the text of
#: pages without another.  An element inside _FORM that only its class marks is _ONLY: the text of pages without any other.
#: _LINKS and _NOTE are containers inside an article of which their end decides.
_OUTER, _MAIN, _GONE, _FORM, _NEVER, _SPARE, _ONLY, _LINKS, _NOTE = range(9)
_DROP = frozenset((_GONE, _FORM, _NEVER))
_OPEN = frozenset((_LINKS, _NOTE))


def _names(value: str) -> list[str]:
    """The classes of ``value`` that name boilerplate."""
    out = []
    for name in value.lower().replace("side-bar", "sidebar").split():
        words = [x for x in re.split(r"[_-]+|\d+", name) if x]
        if any(x in NAMES for x in words) and all(x in NAMES or x in PARTS for x in words):
            out.append(name)
    return out


def _inside(tag: str, names: list[str]) -> int:
    """What becomes of an element inside an article that has these classes: _MAIN if it stays, else _LINKS, _NOTE or _GONE."""
    if tag in PROSE:
        return _MAIN if ADVERTS.isdisjoint(names) else _GONE
    words = {w for name in names for w in re.split(r"[_-]+|\d+", name) if w in NAMES} - HEADINGS
    if not words:
        return _MAIN
    return _GONE if tag not in BLOCK else _LINKS if words <= LINKED else _NOTE if words <= LEGAL else _GONE


def _zone(tag: str, attributes: str, around: int) -> int:
    if around == _NEVER or tag in EMBEDDED or tag in ("aside", "dialog"):
        return _NEVER
    inside = around in (_MAIN, _SPARE, _ONLY, _LINKS, _NOTE)
    gone = (tag in DROPPED and not (inside and tag == "fieldset")) or (tag == "header" and not inside)
    article = tag in ("article", "main")
    content, undecided = False, _MAIN
    if attributes and _READ.search(attributes):
        for name, *values in _ATTRIBUTE.findall(attributes):
            value, name = "".join(values), name.lower()
            if name == "hidden":
                return _NEVER
            if name == "aria-hidden":
                gone = gone or value.strip().lower() == "true"
            elif name == "role":
                value = value.strip().lower()
                if value in ("complementary", "dialog", "alertdialog"):
                    return _NEVER
                gone = gone or value in ROLES
                article = article or value in ("main", "article")
            elif name in ("class", "id"):
                if tag in ("div", "section") and CONTENT.search(value):
                    content = True
                elif tag not in ("html", "body", "main") and (found := _names(value)) and (tag != "article" or any("comment" in x for x in found)):
                    verdict = _inside(tag, found) if inside else _GONE
                    gone = gone or verdict == _GONE
                    undecided = max(undecided, verdict)
    if inside and not gone and undecided in _OPEN and around not in _OPEN:
        return undecided
    if around in _OPEN and not gone:
        return around
    if gone:
        return _FORM if tag in ("form", "fieldset") and around != _GONE else _GONE
    if around == _GONE:
        return _MAIN if tag == "main" else _SPARE if article else _GONE
    if around == _SPARE:
        return _MAIN if tag == "main" else _SPARE
    if around in (_FORM, _ONLY):
        return _MAIN if article else _ONLY if content else around
    return _MAIN if article or content else around


def lines(page: str) -> list[tuple[str, int]]:
    """Texts of the blocks that aren't structurally boilerplate, each with 1 inside a marked article or else 0."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, zone, whether in a drawing
    depths: dict[str, list[int]] = {}  # places in the stack of each open tag, so that no search walks the stack
    blocks: list[int] = []  # places of open blocks
    zone, began, drawn, parts, at = _OUTER, _OUTER, False, [], 0
    ends: dict[str, int] = {}
    held: list[list] = []  # of each open container that its end decides: lines before it, the zone around it, whether it is to stay

    def flush(last: bool = False) -> None:
        """End a line, in the zone where it began; what is dropped inside a line doesn't end it."""
        if parts and (last or zone not in _DROP):
            if text := " ".join("".join(parts).split()):
                out.append((text, began))
            parts.clear()

    def add(text: str) -> None:
        nonlocal began
        if zone not in _DROP:
            began = began if parts else zone
            parts.append(text)
            if zone == _LINKS and not held[-1][2] and not depths.get("a") and any(x.isalnum() for x in text):
                held[-1][2] = True

    def decide() -> None:
        """The innermost container that was left open for it stays as a part of what is around it, or goes."""
        before, around, stays = held.pop()
        out[before:] = [(t, around if z in _OPEN else z) for t, z in out[before:] if stays or z not in _OPEN]

    def open_(tag: str, attributes: str) -> None:
        nonlocal zone, drawn
        around = zone
        inline = tag in ("button", "label") and parts and zone in (_MAIN, _SPARE, _ONLY) and any(depths.get(x) for x in PROSE)
        zone, drawn = _zone("span" if inline else tag, attributes, zone), tag == "svg" or (drawn and tag not in HOLDS)
        if zone in _OPEN and around not in _OPEN:
            held.append([len(out), around, False])
        if zone == _NOTE and tag in TITLES:
            held[-1][2] = True
        depths.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append((tag, zone, drawn))

    def close(depth: int) -> None:
        nonlocal zone, drawn
        while len(stack) > depth:
            tag, was, _ = stack.pop()
            depths[tag].pop()
            if was in _OPEN and not (stack and stack[-1][1] in _OPEN):
                decide()
            if tag in BLOCK:
                blocks.pop()
        _, zone, drawn = stack[-1] if stack else ("", _OUTER, False)

    def deepest(tags) -> int:
        return max((depths[x][-1] for x in tags if depths.get(x)), default=-1)

    def ended(tag: str) -> bool:
        """Whether an end tag follows."""
        if tag not in ends:
            ends[tag] = max((x.start() for x in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
        return ends[tag] >= at

    while m := (_DRAWN if drawn else _TOKEN).search(page, at):
        if m.start() > at and zone not in _DROP:
            add(unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            depth = deepest((tag,))
            if tag in BLOCK:
                flush()
            if depth >= 0 and (tag in BLOCK or tag == "head" or tag in EMBEDDED or not blocks or blocks[-1] <= depth):
                close(depth)
                if tag in BLOCK:
                    flush()
            continue
        if stack and stack[-1][0] == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if drawn and tag in BREAKS:
            close(depths["svg"][-1])
        if tag == "br":
            add(" ")
        if tag in BLOCK:
            flush()
            if tag in ENDING:
                same, fence = (tag, FENCE[:4]) if tag in ITEMS else ("p", FENCE)
                depth = deepest((same,))
                if depth >= 0 and depth >= deepest(fence) and depth > deepest(EMBEDDED):
                    close(depth)
            if tag in ("article", "main"):  # an unclosed menu, header or footer doesn't hold the article
                first = min((depths[x][0] for x in ("nav", "header", "footer", "head") if depths.get(x)), default=None)
                if first is not None:
                    close(first)
            flush()
        if tag not in VOID and not m[4].endswith("/") and (tag not in EMPTY or ended(tag)):
            open_(tag, m[4])
    if at < len(page):
        add(unescape(page[at:]))
    flush(last=True)
    while held:
        decide()
    zones = {z for _, z in out}
    if _SPARE in zones:
        out = [(t, _MAIN if z == _SPARE else z) for t, z in out if z != _SPARE or _MAIN not in zones]
    if _ONLY in zones:
        out = [(t, _MAIN) for t, z in out if z == _ONLY] if zones == {_ONLY} else [x for x in out if x[1] != _ONLY]
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case and path, without query and fragment."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url or "").split("#")[0].split("?")[0]
    host, _, path = rest.partition("/")
    return host.rpartition("@")[2].lower(), "/" + path.rstrip("/")


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of one longest common subsequence of ``a`` and ``b``."""
    number: dict[str, int] = {}
    x = np.array([number.setdefault(t, len(number)) for t in a], np.int64)
    y = np.array([number.setdefault(t, len(number)) for t in b], np.int64)
    px, py = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    found: set[int] = set()

    def last_row(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        row = np.zeros(len(v) + 1, np.int64)
        for t in u:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (v == t)))
        return row

    todo = [(0, len(px), 0, len(py))]
    x, y = x[px], y[py]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and x[a0] == y[b0]:
            found.add(int(px[a0]))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and x[a1 - 1] == y[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.add(int(px[a1]))
        if a0 >= a1 or b0 >= b1:
            continue
        if a1 - a0 == 1:
            if (y[b0:b1] == x[a0]).any():
                found.add(int(px[a0]))
            continue
        mid = (a0 + a1) // 2
        best = int((last_row(x[a0:mid], y[b0:b1]) + last_row(x[mid:a1][::-1], y[b0:b1][::-1])[::-1]).argmax())
        todo += [(a0, mid, b0, b0 + best), (mid, a1, b0 + best, b1)]
    return found


_KEYS = pa.schema([("host", pa.string()), ("path", pa.string()), ("sig", pa.int64()), ("marks", pa.list_(pa.int64()))])
_KEYS_SQL = "host string, path string, sig long, marks array<long>"
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("sig", pa.int64()), ("lines", pa.list_(pa.string())), ("inside", pa.list_(pa.bool_()))])
_PARSED_SQL = "page_id long, url string, host string, sig long, lines array<string>, inside array<boolean>"
_SHARED = pa.schema([("host", pa.string()), ("sig", pa.int64()), ("shared", pa.list_(pa.int32()))])
_SHARED_SQL = "host string, sig long, shared array<int>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _group(url: str | None, inside: list[bool]) -> str:
    """Pages are paired within a group: those of a host that mark an article, and those that don't (no host holds a #)."""
    return split_url(url)[0] + "#" * any(inside)


def _sig(text: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(text)) - (1 << 63)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group, path and hashes of the lines of each page that has any."""
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            rows = []
            for url, page in zip(*(c.to_pylist() for c in batch.slice(a, 500).columns), strict=True):
                if found := lines(page or ""):
                    text = [t for t, _ in found]
                    rows.append((_group(url, [z == _MAIN for _, z in found]), split_url(url)[1], _sig(text), [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in text]))
            if rows:
                yield _batch(rows, _KEYS)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's group and lines, and which of them its marked article holds (null: it marks none)."""
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            rows = []
            for page_id, url, page in zip(*(c.to_pylist() for c in batch.slice(a, 500).columns), strict=True):
                found = lines(page or "")
                text, inside = [t for t, _ in found], [z == _MAIN for _, z in found]
                rows.append((page_id, url, _group(url, inside), _sig(text), text, inside if any(inside) else None))
            yield _batch(rows, _PARSED)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of the lines that a page and its pair have in common."""
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            rows = [(host, sig, sorted(common(own, other))) for host, sig, own, other in zip(*(c.to_pylist() for c in batch.slice(a, 500).columns), strict=True)]
            if rows:
                yield _batch(rows, _SHARED)


def pairs(keys: DataFrame) -> DataFrame:
    """(host, sig, other): for each host and set of lines the set of lines of its nearest page by path.  ``keys``: (host, path, sig)."""
    at = keys.groupBy("host", "sig").agg(F.min("path").alias("path"))
    at = cut(at.repartitionByRange(partitions(keys.sparkSession), "host", "path", "sig").withColumn("pid", F.spark_partition_id()))
    here = F.struct("host", "path", "sig")
    edges = at.groupBy("pid").agg(F.min(here).alias("low"), F.max(here).alias("high"))  # a row for each range
    whole = Window.partitionBy(F.lit(0)).orderBy("pid")
    edges = edges.select("pid", F.lag("high").over(whole).alias("before"), F.lead("low").over(whole).alias("after"))
    own = Window.partitionBy("pid").orderBy("host", "path", "sig")
    near = at.select("pid", "host", "path", "sig", F.lag(here).over(own).alias("prev"), F.lead(here).over(own).alias("next"))
    near = near.join(F.broadcast(edges), "pid").withColumn("prev", F.coalesce("prev", "before")).withColumn("next", F.coalesce("next", "after"))

    def alike(name: str):
        same = F.zip_with(F.split("path", "/"), F.split(F.col(name)["path"], "/"), lambda x, y: x.eqNullSafe(y))
        length = F.when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(F.size(same))
        return F.when(F.col(name)["host"] == F.col("host"), length).otherwise(-1)

    near = near.withColumn("p", F.coalesce(alike("prev"), F.lit(-1))).withColumn("n", F.coalesce(alike("next"), F.lit(-1)))
    other = F.when((F.col("p") < 0) & (F.col("n") < 0), None).when(F.col("p") >= F.col("n"), F.col("prev")["sig"]).otherwise(F.col("next")["sig"])
    return near.select("host", "sig", other.alias("other"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_shared of each row of ``pages`` (page_id, url, html); n_shared: lines in common with the paired page."""
    keys = cut(pages.select("url", "html").mapInArrow(_keys, _KEYS_SQL))
    own = keys.groupBy("host", "sig").agg(F.first("marks").alias("marks"))
    others = own.select("host", F.col("sig").alias("other"), F.col("marks").alias("others"))
    paired = own.join(pairs(keys.select("host", "path", "sig")).where("other is not null"), ["host", "sig"]).join(others, ["host", "other"])
    shared = cut(paired.select("host", "sig", "marks", "others").mapInArrow(_shared, _SHARED_SQL))
    rows = pages.select("page_id", "url", "html").mapInArrow(_parsed, _PARSED_SQL).join(shared, ["host", "sig"], "left")
    rows = rows.withColumn("shared", F.coalesce("shared", F.array().cast("array<int>")))
    # differencing deletes what is shared; the check by structure brings back what the marked article holds, and drops what is around it
    deleted = F.when(F.size("shared") < F.size("lines"), F.col("shared")).otherwise(F.array().cast("array<int>"))
    kept = F.filter("lines", lambda t, i: F.coalesce(F.get("inside", i), ~F.array_contains("deleted", i)))
    rows = rows.withColumn("deleted", deleted).withColumn("text", F.array_join(kept, "\n\n"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.size("lines").cast("long").alias("n_lines"), F.size("shared").cast("long").alias("n_shared"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``main_text`` of all pages; nulls, repeats and scale as the module says."""
    return main_text(table(spark, sf_dir, "pages"))
