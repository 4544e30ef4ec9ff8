"""Text formatting that no built-in function expresses: code fragments, docstrings, formulas and pages.

The functions are plain Python over one text; ``fragments`` and ``docstrings`` apply them in Arrow batches.
Docstrings are the dialect of code hosts (tables, strike-through, bare URLs) with formulas and without raw HTML.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable, Iterator
from html import escape as _escape
from pathlib import Path

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.order import cut
from fathom.sources.sinks import local, write_files

SPAN = "array<struct<start:int,stop:int,kind:int,name:string,front:int,back:int>>"


def escape(text: str) -> str:
    return _escape(text, quote=False).replace('"', "&quot;")


def _units(text: str) -> bytes:
    return text.encode("utf-16-le", "surrogatepass")


def _text(units: bytes) -> str:
    return units.decode("utf-16-le", "surrogatepass")


def spaced(text: str, spans: list[dict]) -> str:
    """White space before and behind spans, as wide as they say, becomes plain spaces; no offset moves."""
    data = bytearray(_units(text))
    end = 0
    runs = [(s["start"] - s["front"], s["start"]) for s in spans if s["front"]] + [(s["stop"], s["stop"] + s["back"]) for s in spans if s["back"]]
    for a, b in sorted(runs):
        if a < end or 2 * b > len(data):
            raise ValueError(f"white space [{a}, {b}) overlaps another or leaves the text")
        data[2 * a : 2 * b] = b" \0" * (b - a)
        end = b
    return _text(bytes(data))


def fragment(text: str, spans: list[dict], links: dict[str, str], root: str) -> tuple[str, bool]:
    """HTML of a code fragment, and whether it has a link.  Spans are in pre-order, in UTF-16 units, and nest.

    Kind 0 is a function, 2 a sort, any other a constant that ``links`` may know.  A span with a link inside has none of its own.
    """
    data = _units(spaced(text, spans))
    out: list[str] = []
    open_: list[list] = []  # span, place in out, a link inside
    at = 0
    linked = False

    def upto(stop: int) -> None:
        nonlocal at
        if stop > at:
            out.append(escape(_text(data[2 * at : 2 * stop])))
            at = stop

    def close() -> None:
        nonlocal linked
        span, place, inner = open_.pop()
        upto(span["stop"])
        href = links.get(span["name"] or "") if span["kind"] not in (0, 2) else f"{root}foundational_types.html" if span["kind"] == 2 else None
        if href is None:
            out[place:place] = ['<span class="fn">']
            out.append("</span>")
        elif not inner:
            out[place:place] = [f'<a href="{escape(href)}">']
            out.append("</a>")
            inner = True
        if open_:
            open_[-1][2] |= inner
        linked |= inner

    for span in spans:
        while open_ and span["start"] >= open_[-1][0]["stop"]:
            close()
        upto(span["start"])
        open_.append([span, len(out), False])
    while open_:
        close()
    upto(len(data) // 2)
    return "".join(out), linked


#: Formula commands by what they print.
SYMBOLS = dict(
    zip(
        "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega infty partial nabla forall exists emptyset ell".split(),
        "αβγδϵζηθικλμνξπρστυϕχψωΓΔΘΛΞΠΣΦΨΩ∞∂∇∀∃∅ℓ",
        strict=True,
    )
)
OPERATORS = dict(
    zip(
        "cdot times le leq ge geq ne neq to rightarrow mapsto in notin subset subseteq cup cap sum prod int pm circ oplus otimes wedge vee equiv approx sim cong mid ldots cdots Rightarrow iff".split(),
        "⋅×≤≤≥≥≠≠→→↦∈∉⊂⊆∪∩∑∏∫±∘⊕⊗∧∨≡≈∼≅∣…⋯⇒⇔",
        strict=True,
    )
)
LETTERS = {"mathbb": "double-struck", "mathcal": "script", "mathfrak": "fraktur", "mathbf": "bold", "mathrm": "normal", "text": "normal", "operatorname": "normal"}
_TEX = re.compile(r"\\([A-Za-z]+|.)|([0-9]+(?:\.[0-9]+)?)|(\s+)|(.)", re.S)


def mathml(latex: str, display: bool = False) -> str | None:
    """MathML of a formula, or None if it has anything unknown."""
    tokens = [m.groups() for m in _TEX.finditer(latex) if not m[3]]
    at = 0

    def group() -> str:
        """One argument: a braced row, or one token."""
        nonlocal at
        if at < len(tokens) and tokens[at][3] == "{":
            at += 1
            body = row("}")
            at += 1
            return f"<mrow>{body}</mrow>"
        return atom()

    def atom() -> str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError("it ends too soon")
        command, number, _, char = tokens[at]
        at += 1
        if number:
            return f"<mn>{number}</mn>"
        if command:
            if command in SYMBOLS:
                return f"<mi>{SYMBOLS[command]}</mi>"
            if command in OPERATORS:
                return f"<mo>{OPERATORS[command]}</mo>"
            if command == "frac":
                return f"<mfrac>{group()}{group()}</mfrac>"
            if command == "sqrt":
                return f"<msqrt>{group()}</msqrt>"
            if command in LETTERS:
                return f'<mstyle mathvariant="{LETTERS[command]}">{group()}</mstyle>'
            if command in ("left", "right"):
                return atom()
            if command in "{}|,;:! ":
                return f"<mo>{escape(command)}</mo>" if command in "{}|" else "<mspace/>"
            raise ValueError(f"unknown command {command}")
        if char == "{":
            at -= 1
            return group()
        if char in "}^_&#%$~":
            raise ValueError(f"unexpected {char}")
        return f"<mi>{escape(char)}</mi>" if char.isalpha() else f"<mo>{escape(char)}</mo>"

    def row(end: str | None) -> str:
        nonlocal at
        out = []
        while at < len(tokens) and not (end and tokens[at][3] == end):
            base, low, high = atom(), None, None
            while at < len(tokens) and tokens[at][3] in ("^", "_"):
                which = tokens[at][3]
                at += 1
                if (high if which == "^" else low) is not None:
                    raise ValueError("two scripts")
                low, high = (low, group()) if which == "^" else (group(), high)
            tag = {(0, 0): "", (1, 0): "msub", (0, 1): "msup", (1, 1): "msubsup"}[low is not None, high is not None]
            out.append(f"<{tag}>{base}{low or ''}{high or ''}</{tag}>" if tag else base)
        if end and at >= len(tokens):
            raise ValueError("a brace is open")
        return "".join(out)

    try:
        body = row(None)
    except (ValueError, RecursionError):
        return None
    return f'<math display="block">{body}</math>' if display else f"<math>{body}</math>"


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^\s`]*)")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
_ITEM = re.compile(r"^( {0,3})([-+*]|[0-9]{1,9}[.)])(\s+|$)(.*)$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$")
_TABLE = re.compile(r"^\s*\|?(?:\s*:?-+:?\s*\|)*\s*:?-+:?\s*\|?\s*$")
_SEPARATOR = regex.compile(r"[\p{P}\p{Z}\p{C}]+")
_WORDS = regex.compile(r"([\p{Z}\p{C}])")
_INLINE = re.compile(
    r"(?P<slash>\\[!-/:-@\[-`{-~])|(?P<ticks>`+)(?P<code>.+?)(?<!`)(?P=ticks)(?!`)|\$\$(?P<block>[^$]+)\$\$|\$(?P<math>[^$\s](?:[^$]*[^$\s])?)\$"
    r"|(?P<img>!)?\[(?P<label>(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\((?P<to>[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+\"[^\"]*\")?\)"
    r"|<(?P<auto>https?://[^\s<>]+)>|(?P<url>https?://[^\s<>()]*[^\s<>().,;:!?'\"*_~])|\*\*(?P<strong>(?=\S).+?(?<=\S))\*\*|~~(?P<gone>(?=\S).+?(?<=\S))~~"
    r"|\*(?P<em>(?=[^\s*]).*?(?<=[^\s*]))\*|(?<![\w])_(?P<em2>(?=\S).+?(?<=\S))_(?![\w])|(?P<br>(?: {2,}|\\)\n)",
    re.S,
)


class Markdown:
    """One docstring's renderer; ``link`` gives the address of a name or nothing."""

    def __init__(self, link: Callable[[str], str | None] = lambda name: None, root: str = "./"):
        self.link, self.root, self.failures = link, root, 0

    def render(self, text: str) -> str:
        return self._blocks(text.expandtabs(4).splitlines(), False)

    def _blocks(self, lines: list[str], tight: bool) -> str:
        out: list[str] = []
        held: list[str] = []

        def paragraph() -> None:
            if held:
                body = self._inline("\n".join(x.strip() if i + 1 == len(held) else x.lstrip() for i, x in enumerate(held)))
                out.append(body if tight else f"<p>{body}</p>")
                held.clear()

        i = 0
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                paragraph()
                i += 1
            elif m := _FENCE.match(line):
                paragraph()
                i += 1
                start = i
                while i < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1])}", lines[i]):
                    i += 1
                out.append(self._code("".join(x + "\n" for x in lines[start:i]), m[2]))
                i += 1
            elif m := _HEADING.match(line):
                paragraph()
                n, body = len(m[1]), self._inline(m[2] or "")
                name = escape(heading_id(re.sub(r"<[^>]*>", "", body)))
                out.append(f'<h{n} id="{name}" class="markdown-heading">{body} <a class="hover-link" href="#{name}">#</a></h{n}>')
                i += 1
            elif _RULE.match(line):
                paragraph()
                out.append("<hr>\n")
                i += 1
            elif line.lstrip().startswith(">"):
                paragraph()
                start = i
                while i < len(lines) and lines[i].lstrip().startswith(">"):
                    i += 1
                out.append(f"<blockquote>{self._blocks([re.sub(r'^ *> ?', '', x) for x in lines[start:i]], False)}</blockquote>")
            elif (m := _ITEM.match(line)) and (not held or m[4]) and not (held and m[2][:-1].isdigit() and m[2][:-1] != "1"):
                paragraph()
                i = self._list(lines, i, out)
            elif "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and _TABLE.match(lines[i + 1]) and not held:
                i = self._table(lines, i, out)
            elif line.startswith("    ") and not held:
                start = i
                while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                    i += 1
                out.append(self._code("\n".join(x[4:] for x in lines[start:i]).rstrip("\n") + "\n", ""))
            else:
                held.append(line)
                i += 1
        paragraph()
        return "".join(out)

    def _list(self, lines: list[str], i: int, out: list[str]) -> int:
        first = _ITEM.match(lines[i])
        kind = first[2][-1]
        items: list[list[str]] = []
        loose = blank = False
        width = 0
        while i < len(lines):
            m = _ITEM.match(lines[i])
            deeper = bool(items) and len(lines[i]) - len(lines[i].lstrip()) >= width
            if m and m[2][-1] == kind and not deeper and not _RULE.match(lines[i]):
                loose |= blank
                width = len(m[1]) + len(m[2]) + min(4, max(1, len(m[3])))
                items.append([m[4]])
            elif not lines[i].strip():
                items[-1].append("")
            elif deeper:
                loose |= blank and len(lines[i]) - len(lines[i].lstrip()) == width
                items[-1].append(lines[i][width:])
            elif blank or m or _HEADING.match(lines[i]) or _FENCE.match(lines[i]) or _RULE.match(lines[i]):
                break
            else:
                items[-1].append(lines[i].lstrip())
            blank = not lines[i].strip()
            i += 1
        tag = "ul" if kind in "-+*" else "ol"
        start = first[2][:-1]
        out.append(f'<ol start="{int(start)}">' if tag == "ol" and int(start) != 1 else f"<{tag}>")
        out += [f"<li>{self._item(x, not loose)}</li>" for x in items]
        out.append(f"</{tag}>")
        return i

    def _item(self, lines: list[str], tight: bool) -> str:
        if m := re.match(r"^\[([ xX])\]\s+(.*)$", lines[0]):
            box = '<input type="checkbox" disabled="disabled"' + (' checked="checked">' if m[1] != " " else ">")
            return box + self._blocks([m[2], *lines[1:]], tight)
        return self._blocks(lines, tight)

    def _table(self, lines: list[str], i: int, out: list[str]) -> int:
        cells = lambda x: [self._inline(c.strip().replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", x.strip().removeprefix("|").removesuffix("|"))]
        head = cells(lines[i])
        i += 2
        rows = []
        while i < len(lines) and lines[i].strip() and "|" in lines[i]:
            row = cells(lines[i])[: len(head)]
            rows.append(row + [""] * (len(head) - len(row)))
            i += 1
        body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
        out.append("<table><thead><tr>" + "".join(f"<th>{c}</th>" for c in head) + f"</tr></thead><tbody>{body}</tbody></table>")
        return i

    def _code(self, text: str, language: str) -> str:
        kind = f' class="language-{escape(language)}"' if language else ""
        return f"<pre><code{kind}>{self._named(text) if language in ('', 'lean') else escape(text)}</code></pre>"

    def _named(self, text: str) -> str:
        """Words that name something become links: the word, else what follows its last dot."""
        out = []
        for piece in _WORDS.split(text):
            head, tail = "", piece
            href = self.link(piece) if piece else None
            if href is None and "." in piece:
                head, _, tail = piece.rpartition(".")
                head += "."
                href = self.link(tail) if tail else None
            out.append(escape(piece) if href is None else f'{escape(head) if tail != piece else ""}<a href="{escape(href)}">{escape(tail)}</a>')
        return "".join(out)

    def _math(self, latex: str, display: bool) -> str:
        found = mathml(latex, display)
        if found is None:
            self.failures += 1
            mark = "$$" if display else "$"
            return mark + escape(latex) + mark
        return found

    def _target(self, to: str) -> str:
        if to.startswith("##"):
            return self.link(to[2:]) or f"{self.root}find/?pattern={to[2:]}#doc"
        return to if to.startswith(("#", "http")) else self.root + to

    def _inline(self, text: str, in_link: bool = False) -> str:
        out, at = [], 0
        for m in _INLINE.finditer(text):
            out.append(escape(text[at : m.start()]))
            at = m.end()
            g = m.groupdict()
            if g["slash"]:
                out.append(escape(g["slash"][1:]))
            elif g["code"] is not None:
                code = g["code"].replace("\n", " ")
                code = code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " else code
                out.append(f"<code>{escape(code) if in_link else self._named(code)}</code>")
            elif g["block"] or g["math"]:
                out.append(self._math(g["block"] or g["math"], bool(g["block"])))
            elif g["label"] is not None:
                href = escape(self._target(g["to"]))
                out.append(f'<img src="{href}" alt="{escape(g["label"])}">' if g["img"] else f'<a href="{href}">{self._inline(g["label"], True)}</a>')
            elif g["auto"] or g["url"]:
                url = escape(g["auto"] or g["url"])
                out.append(url if in_link else f'<a href="{url}">{url}</a>')
            elif g["br"]:
                out.append("<br>\n")
            else:
                tag = "strong" if g["strong"] else "del" if g["gone"] else "em"
                out.append(f"<{tag}>{self._inline(g['strong'] or g['gone'] or g['em'] or g['em2'], in_link)}</{tag}>")
        return "".join(out) + escape(text[at:])


def heading_id(text: str) -> str:
    return "-".join(x for x in _SEPARATOR.split(text) if x)


def fragments(text: Column, spans: Column, links: Column, root: Column) -> Column:
    """(html, linked) of code fragments; ``links`` maps the constants of a fragment to addresses, from a join before."""

    @F.pandas_udf("html string, linked boolean")
    def run(t: pd.Series, s: pd.Series, x: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = []
        for body, found, known, base in zip(t, s, x, r, strict=True):
            tuples = [] if found is None else [dict(z) | {"front": z["front"] or 0, "back": z["back"] or 0} for z in found]
            rows.append((None, None) if body is None else fragment(body, tuples, dict(known or {}), base))
        return pd.DataFrame(rows, columns=["html", "linked"])

    return run(text, spans.cast(SPAN), links, root)


def docstrings(text: Column, links: Column, root: Column) -> Column:
    """(html, failures) of docstrings; ``links`` maps their names to addresses, failures counts formulas left as source."""

    @F.pandas_udf("html string, failures int")
    def run(t: pd.Series, x: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = []
        for body, known, base in zip(t, x, r, strict=True):
            names = dict(known or {})
            m = Markdown(names.get, base)
            rows.append((None, 0) if body is None else (m.render(body), m.failures))
        return pd.DataFrame(rows, columns=["html", "failures"])

    return run(text, links, root)


def page_items(docs: DataFrame, declarations: DataFrame, suppressed: DataFrame) -> DataFrame:
    """(module, line, col, seq, kind, html) in page order: module docstrings, and declarations that are no member of another.

    ``docs``: (module, ord, line, col, html); ``declarations``: (module, name, index, line, col, html); ``suppressed``: (name).
    """
    n = docs.groupBy("module").agg(F.count("*").alias("_n"))
    own = declarations.join(suppressed.select("name").distinct(), "name", "left_anti").join(n, "module", "left")
    first = docs.select("module", "line", "col", F.col("ord").cast("long").alias("seq"), F.lit("doc").alias("kind"), "html")
    rest = own.select("module", "line", "col", (F.coalesce("_n", F.lit(0)) + F.col("index")).alias("seq"), F.lit("declaration").alias("kind"), "html")
    return first.unionByName(rest)


def pages(items: DataFrame, title: Callable[[Column], Column] = lambda m: m) -> DataFrame:
    """(module, html): a page of each module, its items in order."""
    body = F.array_sort(F.collect_list(F.struct("line", "col", "seq", "html")))
    rows = items.groupBy("module").agg(body.alias("items"))
    text = F.concat(F.lit("<!DOCTYPE html><html><head><title>"), title(F.col("module")), F.lit("</title></head><body><main>"), F.array_join(F.transform("items", lambda i: i["html"]), ""), F.lit("</main></body></html>"))
    return rows.select("module", text.alias("html"))


def write_pages(rows: DataFrame, root: str) -> int:
    """A file for each page (path, html) below ``root``, a shared folder; each task writes its own, and a path that leaves it is refused."""
    return write_files(rows.select("path", F.col("html").alias("body")), root).count()


def prune_pages(root: str, paths: DataFrame) -> int:
    """Delete pages (path) below ``root`` and folders left empty; the list comes from ``snapshot.orphans``, and tasks delete their own rows.

    A path that leaves the folder is refused; one that is gone already isn't counted.
    """
    root = str(local(root))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = Path(root).resolve(), 0
        for batch in batches:
            for p in batch.column(0).to_pylist():
                target = (base / p).resolve()
                if base not in target.parents:
                    raise ValueError(f"{p} is outside {root}")
                if target.is_file():
                    target.unlink()
                    n += 1
                with contextlib.suppress(OSError):  # a folder that still holds something stays
                    for folder in target.parents:
                        if folder == base:
                            break
                        folder.rmdir()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return cut(paths.select("path").mapInArrow(run, "n long")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
