"""Expressions over dotted names, module paths and text in UTF-16 units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIVATE = "_private."

#: Characters that may begin a name component, and those that may follow, as regex classes.
LETTER_LIKE = "\\x{3b1}-\\x{3ba}\\x{3bc}-\\x{3c9}\\x{391}-\\x{39f}\\x{3a1}\\x{3a2}\\x{3a4}-\\x{3a9}\\x{3ca}-\\x{3fb}\\x{1f00}-\\x{1ffe}\\x{2100}-\\x{214f}\\x{1d49c}-\\x{1d59f}\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}\\x{100}-\\x{17f}"
SUBSCRIPT = "\\x{2080}-\\x{2089}\\x{2090}-\\x{209c}\\x{1d62}-\\x{1d6a}\\x{2c7c}"
FIRST = f"[A-Za-z_{LETTER_LIKE}]"
REST = f"[A-Za-z0-9_'!?{LETTER_LIKE}{SUBSCRIPT}]"
QUOTED = "\\x{ab}[^\\x{ab}\\x{bb}]+\\x{bb}"


def utf16_key(c: Column) -> Column:
    """Sort key whose byte order is the order of UTF-16 code units."""
    return F.encode(c, "UTF-16BE")


def utf16_length(c: Column) -> Column:
    return F.floor(F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def utf16_slice(c: Column, start: Column, stop: Column) -> Column:
    """Units [start, stop) of a text; null if a bound lies inside a surrogate pair or outside the text."""
    data = F.encode(c, "UTF-16BE")
    n = F.octet_length(data)
    low = lambda at: F.hex(F.substring(data, at * 2 + 1, F.lit(1))).between("DC", "DF")
    fine = (start >= 0) & (start <= stop) & (stop * 2 <= n) & ~F.coalesce(low(start), F.lit(False)) & ~F.coalesce(low(stop), F.lit(False))
    return F.when(fine, F.decode(F.substring(data, start * 2 + 1, (stop - start) * 2), "UTF-16BE"))


def components(name: Column) -> Column:
    """Components of a dotted name; a dot inside guillemets doesn't separate, and guillemets go.

    Empty components stay.  Nested guillemets aren't names that a tool prints; the innermost pair counts.
    """
    marked = F.regexp_replace(name, "(\\x{ab}[^\\x{bb}]*\\x{bb})|\\.", "$1\u0001")
    # after a quoted part the mark is one too many: the dot behind it has its own
    marked = F.regexp_replace(marked, "\\x{bb}\u0001", "»")
    return F.transform(F.split(marked, "\u0001"), lambda p: F.regexp_replace(p, "^\\x{ab}(.*)\\x{bb}$", "$1"))


def escape_component(part: Column) -> Column:
    plain = part.rlike(f"^{FIRST}{REST}*$") | part.contains("»")
    return F.when(plain, part).otherwise(F.concat(F.lit("«"), part, F.lit("»")))


def escape_module(parts: Column) -> Column:
    return F.array_join(F.transform(parts, escape_component), ".")


def is_name(text: Column) -> Column:
    """Whether a text is a dotted name as source code would spell it."""
    part = f"(?:{FIRST}{REST}*|{QUOTED})"
    return text.rlike(f"^{part}(?:\\.{part})*$")


def depth_first_key(name: Column) -> Column:
    """Names of fewer components come first; among equals the first component that differs decides."""
    parts = components(name)
    return F.struct(F.size(parts).alias("depth"), parts.alias("parts"))


def module_root(module: Column) -> Column:
    return components(module)[0]


def module_path(module: Column) -> Column:
    return F.array_join(components(module), "/")


def page_path(module: Column) -> Column:
    return F.concat(module_path(module), F.lit(".html"))


def page_root(module: Column) -> Column:
    """Relative way from a page to the site's root."""
    return F.concat(F.lit("./"), F.repeat(F.lit("../"), F.size(components(module)) - 1))


def module_link(root: Column, module: Column) -> Column:
    return F.concat(root, page_path(module))


def source_url(base: Column, module: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), module_path(module), F.lit(".lean"))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def quoted(text: Column) -> Column:
    """A text as a quoted literal: quotes, backslashes, tabs, line feeds and other controls are escaped."""
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    rest = text
    for code in (*range(9), 11, 12, *range(13, 32), 127):
        rest = F.replace(rest, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1F\x7F]"), rest).otherwise(text), F.lit('"'))


def break_within(name: Column) -> Column:
    """Each component of a name in a span of its own."""
    return F.array_join(F.transform(F.split(name, r"\."), lambda p: F.concat(F.lit('<span class="name">'), escape_html(p), F.lit("</span>"))), ".")


_PRIVATE = r"^_private\.([^\n\r\x{2028}\x{2029}]*?)\.[0-9]+\.([\s\S]*)$"


def private_user_name(name: Column) -> Column:
    """The user's part of a private name; another name as it is."""
    rest = F.regexp_extract(name, _PRIVATE, 2)
    return F.when(name.rlike(_PRIVATE) & ~rest.rlike(r"[\n\r\x{2028}\x{2029}]"), rest).otherwise(name)


def private_module(name: Column) -> Column:
    return F.when(name.rlike(_PRIVATE), F.regexp_extract(name, _PRIVATE, 1))


#: Leaves of names that a compiler makes.
MADE_LEAVES = (
    "rec recOn brecOn binductionOn below ibelow casesOn ndrec ndrecOn noConfusion noConfusionType inj injEq sizeOf_spec toCtorIdx"
).split()


def looks_generated(name: Column) -> Column:
    """Whether the shape of a name tells that it is internal."""
    parts = F.split(name, r"\.")
    leaf = F.element_at(parts, -1)
    return F.exists(parts, lambda p: p.startswith("_")) | leaf.isin(MADE_LEAVES) | leaf.rlike(r"^(match|eq|proof|def|sunfold|fun)_[0-9]+$")


def prefixes(name: Column) -> Column:
    """The name and its ancestors, longest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def github_path(remote: Column) -> Column:
    """owner/repository of an ssh or https remote, else null."""
    pattern = r"^(?:https?://(?:[^/@]*@)?github\.com/|git@github\.com:|ssh://git@github\.com/)([^/]+/[^/]+?)(?:\.git)?/?$"
    return F.when(remote.rlike(pattern), F.regexp_extract(remote, pattern, 1))


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def trim_widths(text: Column) -> Column:
    """(leading, total, trailing) white space of a text in UTF-16 units."""
    lead, trail = F.regexp_extract(text, r"^(\s*)", 1), F.regexp_extract(text, r"(\s*)$", 1)
    blank = text.rlike(r"^\s*$")
    return F.struct(utf16_length(lead).alias("leading"), utf16_length(text).alias("total"), F.when(blank, 0).otherwise(utf16_length(trail)).alias("trailing"))


def sort_prefix(text: Column) -> Column:
    return F.substring_index(text, " ", 1)


def fold(text: Column) -> Column:
    """Case folding of search."""
    return F.lower(text)


def ascii_fold(text: Column) -> Column:
    """Folding of the letters A to Z only, as a reader without tables does it."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folds_apart(text: Column) -> Column:
    """The folded text where folding A to Z only isn't enough, else null: the exceptions that an index lists."""
    return F.when(fold(text) != ascii_fold(text), fold(text))


def heading_id(text: Column) -> Column:
    """Plain text of a heading as an anchor: runs of punctuation, separators and controls become one hyphen."""
    return F.array_join(F.filter(F.split(text, r"[\p{P}\p{Z}\p{C}]+"), lambda p: p != ""), "-")


#: The white space of link targets.
_SPACE = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def link_tokens(doc: Column) -> Column:
    """Names that a docstring may link: parts of code spans and link targets, each with its last component.

    Widening is safe here: a token too many costs work, a missing one a stale page.
    """
    spans = F.flatten(F.transform(F.regexp_extract_all(doc, F.lit("`([^`\\n]+)`"), 1), lambda s: F.split(s, r"[\p{Z}\p{C}]")))
    targets = F.regexp_extract_all(doc, F.lit(rf"\]\(([^){_SPACE}]+)\)"), 1)
    parts = F.filter(F.concat(spans, targets), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.when(p.contains("."), F.array(p, F.substring_index(p, ".", -1))).otherwise(F.array(p))))


def absolute_link(target: Column, root: Column, known: Column) -> Column:
    """Link of a docstring: ##name is a declaration's link, # and http stay, others are relative to the root."""
    return (
        F.when(target.startswith("##"), F.coalesce(known, F.concat(F.lit("#"), F.substring(target, 3, 1 << 20))))
        .when(target.startswith("#") | target.startswith("http"), target)
        .otherwise(F.concat(root, target))
    )


def kind_words(kind: Column, modifiers: Column) -> Column:
    """Words a reader sees for a declaration's kind."""
    has = lambda m: F.array_contains(modifiers, m)
    leaf = F.when(kind == "instance", "instance").when(has("abbrev"), "abbrev").otherwise("def")
    return (
        F.when(kind.isin("definition", "instance"), F.concat_ws(" ", F.when(has("unsafe"), "unsafe"), F.when(has("noncomputable"), "noncomputable"), leaf))
        .when((kind == "opaque") & has("partial"), "partial def")
        .when(kind.isin("axiom", "opaque", "inductive") & has("unsafe"), F.concat(F.lit("unsafe "), kind))
        .when(kind == "class_inductive", "class inductive")
        .otherwise(kind)
    )


def kind_class(kind: Column) -> Column:
    """Short class of a declaration's kind."""
    return F.when(kind == "definition", "def").when(kind == "class_inductive", "class").when(kind == "constructor", "ctor").otherwise(kind)


def attribute_text(attribute: Column) -> Column:
    """[name] or [name, value] as one text."""
    return F.concat_ws(" ", attribute)


def known_or(schema_version: Column, value: Column, since: int, none: str = "clean") -> Column:
    """Three-valued facts: a missing value is unknown before the schema that has it, and the negative after."""
    return F.when(value.isNotNull(), value).when(schema_version >= since, F.lit(none)).otherwise(F.lit("unknown"))
