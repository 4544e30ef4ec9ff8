"""Link resolution: prioritised lookups as joins whose answers are coalesced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import names as N


def linkable_parent(wanted: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """(name, parent): the longest known prefix of each name, itself first.

    A prefix whose last component is a number or begins with an underscore doesn't count, nor does one without a dot.
    """
    rows = wanted.select(name).distinct().withColumn("_p", F.explode(N.prefixes(F.col(name))))
    leaf = F.substring_index("_p", ".", -1)
    rows = rows.where(F.col("_p").contains(".") & ~leaf.rlike("^[0-9]+$") & ~leaf.startswith("_"))
    hits = rows.join(known.select(F.col(name).alias("_p")).distinct(), "_p", "left_semi")
    return hits.groupBy(name).agg(F.max_by("_p", F.length("_p")).alias("parent"))


def constant_module(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Where each constant (name, ref_module) links: (name, module, anchor).

    A public name goes to the module its own reference names, else to the one that is known for it; else the longest
    linkable parent of its user name; else a private name goes to its module, without an anchor.  ``known``: (name, module), one row a name.
    """
    private = F.col("name").startswith(N.PRIVATE)
    rows = refs.select("name", "ref_module").distinct()
    rows = rows.join(known.select("name", F.col("module").alias("_known")), "name", "left")
    rows = rows.withColumn("_user", F.when(private, N.private_user_name(F.col("name"))).otherwise(F.col("name")))
    parents = linkable_parent(rows.select(F.col("_user").alias("name")), known)
    parents = parents.join(known.select(F.col("name").alias("parent"), F.col("module").alias("_parent_module")), "parent").withColumnRenamed("name", "_user")
    rows = rows.join(parents, "_user", "left")
    own = F.when(~private, F.coalesce("ref_module", "_known"))
    module = F.coalesce(own, "_parent_module", F.when(private, N.private_module(F.col("name"))))
    anchor = F.when(own.isNotNull(), F.col("name")).otherwise(F.col("parent"))
    return rows.select("name", module.alias("module"), anchor.alias("anchor"))


def external_link(links: DataFrame, docs: DataFrame, sources: DataFrame, pages: DataFrame, ranges: DataFrame, root: str = "./") -> DataFrame:
    """``links`` (module, anchor) with url: a dependency's docs site, else its source with line anchors, else nothing for
    a dependency without either, else the local page if there is one.

    ``docs``: (module, docs_url); ``sources``: (root, base), one row a dependency, base null if it has no URL; ``pages``: (module);
    ``ranges``: (name, line_from, line_to).
    """
    rows = links.withColumn("_root", N.module_root(F.col("module")))
    rows = rows.join(docs.select("module", "docs_url"), "module", "left")
    rows = rows.join(sources.select(F.col("root").alias("_root"), F.col("base").alias("_base"), F.lit(True).alias("_dep")), "_root", "left")
    rows = rows.join(pages.select("module").distinct().withColumn("_page", F.lit(True)), "module", "left")
    rows = rows.join(ranges.select(F.col("name").alias("anchor"), "line_from", "line_to"), "anchor", "left")
    mark = F.when(F.col("anchor").isNotNull(), F.concat(F.lit("#"), F.col("anchor"))).otherwise(F.lit(""))
    lines = F.when(F.col("line_from").isNotNull(), F.concat(F.lit("#L"), F.col("line_from"), F.lit("-L"), F.col("line_to"))).otherwise(F.lit(""))
    url = (
        F.when(F.col("docs_url").isNotNull(), F.concat("docs_url", mark))
        .when(F.col("_base").isNotNull(), F.concat(N.source_url(F.col("_base"), F.col("module")), lines))
        .when(F.col("_dep"), F.lit(None))
        .when(F.col("_page"), F.concat(N.module_link(F.lit(root), F.col("module")), mark))
    )
    return rows.select("module", "anchor", url.alias("url"))


def suffix_match(wanted: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, match): the first declaration (name, ord) that agrees from the end over the shorter of the two.

    Names agree if one is a suffix of the other by components, so both sides meet on suffixes: equality, not all pairs.
    """

    def suffixes(c: Column) -> Column:
        parts = F.split(c, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))

    want, have = wanted.select("name").distinct(), declared.select(F.col("name").alias("match"), "ord")
    longer = want.join(have.withColumn("name", F.explode(suffixes(F.col("match")))), "name")
    shorter = want.withColumn("match", F.explode(suffixes(F.col("name")))).join(have, "match")
    both = longer.select("name", "match", "ord").unionByName(shorter.select("name", "match", "ord"))
    return both.groupBy("name").agg(F.min_by("match", F.struct("ord", "match")).alias("match"))


def source_module(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, module): the module of a source path, exactly, else the only one that ends in it; two are none."""
    rows = paths.select("path").distinct().withColumn("_c", N.escape_module(F.split("path", "/")))
    known = modules.select("module").distinct()
    exact = rows.join(known.select(F.col("module").alias("_c"), F.col("module").alias("_exact")), "_c", "left")
    tails = known.withColumn("_parts", F.expr("regexp_extract_all(module, '((?:«[^»]*»|[^.«])+)', 1)"))
    tails = tails.withColumn("_c", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size("_parts"), F.lit(2))), lambda i: F.array_join(F.slice("_parts", i, F.size("_parts")), "."))))
    ends = tails.groupBy("_c").agg(F.count("*").alias("_n"), F.first("module").alias("_end")).where("_n = 1")
    return exact.join(ends.select("_c", "_end"), "_c", "left").select("path", F.coalesce("_exact", "_end").alias("module"))


def unescaped(modules: DataFrame) -> DataFrame:
    """(spelling, module) for modules whose name without guillemets belongs to no other."""
    rows = modules.select("module").distinct().withColumn("spelling", F.array_join(N.components(F.col("module")), "."))
    return rows.groupBy("spelling").agg(F.count("*").alias("n"), F.first("module").alias("module")).where("n = 1").drop("n")


def compare_maps(a: DataFrame, b: DataFrame, name: str, module: str) -> DataFrame:
    """(name, state, known): same, moved, only a or only b; known tells if the module of a one-sided name is on the other side."""
    x, y = a.select(name, F.col(module).alias("_a")), b.select(name, F.col(module).alias("_b"))
    state = F.when(F.col("_b").isNull(), "only a").when(F.col("_a").isNull(), "only b").when(F.col("_a") == F.col("_b"), "same").otherwise("moved")
    rows = x.join(y, name, "full").withColumn("state", state)
    known_a = a.select(F.col(module).alias("_b")).distinct().withColumn("_in_a", F.lit(True))
    known_b = b.select(F.col(module).alias("_a")).distinct().withColumn("_in_b", F.lit(True))
    rows = rows.join(known_b, "_a", "left").join(known_a, "_b", "left")
    known = F.when(F.col("state") == "only a", F.coalesce("_in_b", F.lit(False))).when(F.col("state") == "only b", F.coalesce("_in_a", F.lit(False)))
    return rows.select(name, "state", known.alias("known"))


def slice_map(entries: DataFrame, own: DataFrame, mode: str, module: str = "module") -> DataFrame:
    """Entries of own modules (`own`), of others (`others`), or all of them (`all`)."""
    if mode == "all":
        return entries
    return entries.join(own.select(module).distinct(), module, {"own": "left_semi", "others": "left_anti"}[mode])


def emitted_urls(emitted: DataFrame, expected: DataFrame, ranges: DataFrame) -> DataFrame:
    """(url, verdict): exact, explained by a known (module, first, last) range, or mismatch."""
    rows = emitted.select("url", "module", "first", "last").join(expected.select("url").distinct().withColumn("_e", F.lit(True)), "url", "left")
    rows = rows.join(ranges.select("module", "first", "last").distinct().withColumn("_r", F.lit(True)), ["module", "first", "last"], "left")
    return rows.select("url", F.when(F.col("_e"), "exact").when(F.col("_r"), "explained").otherwise("mismatch").alias("verdict"))


def miss_cause(name: Column, module_declared: Column) -> Column:
    """Why a referenced name is in no index: the first rule that fits."""
    return F.when(name.startswith(N.PRIVATE), "private name").when(N.looks_generated(name), "name shape").when(~module_declared, "module absent").otherwise("unclassified")


def href_difference(actual: dict[str, Column], generated: dict[str, Column]) -> Column:
    """Names of the parts in which two links differ, joined by ' + '."""
    return F.concat_ws(" + ", *[F.when(~actual[k].eqNullSafe(generated[k]), k) for k in actual])


def target_kind(href: Column) -> Column:
    """External, fragment or internal; whether an internal one is dead takes a join with the pages."""
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:|^//"), "external").when(href.startswith("#"), "fragment").otherwise("internal")


def verified_docs(expected: DataFrame, table: DataFrame) -> DataFrame:
    """(name, module, doc_link, state) of expected dependency names (name, module) against a site's table (name, docLink):
    `found` if the site documents the name on the module's page, `elsewhere` if on another, `missing` if not at all."""
    rows = expected.select("name", "module").join(table.select("name", F.col("docLink").alias("doc_link")), "name", "left")
    page = F.regexp_replace(F.regexp_replace("doc_link", "#.*$", ""), r"^(\./)+", "")
    state = F.when(F.col("doc_link").isNull(), "missing").when(page == N.page_path(F.col("module")), "found").otherwise("elsewhere")
    return rows.withColumn("state", state)


def docstring_links(wanted: DataFrame, known: DataFrame, modules: DataFrame, declared: DataFrame) -> DataFrame:
    """(page, name, module, anchor) of names in docstrings (page, name) that link somewhere, by the first rule that fits: a known name that
    isn't private, a module, or the first declaration of the same page that agrees with it from the end.  A text that is no name as source
    code would spell it only links to the one module that is spelled like it without guillemets.

    ``known``: (name, module), one row a name; ``modules``: (module); ``declared``: (page, name, ord).  A page's declarations and names meet on
    suffixes by equality, as in ``suffix_match``.
    """
    rows = wanted.select("page", "name").distinct().withColumn("_literal", N.is_name(F.col("name")))
    public = known.where(~F.col("name").startswith(N.PRIVATE))
    rows = rows.join(public.select("name", F.col("module").alias("_known"), F.lit(True).alias("_literal")), ["name", "_literal"], "left")
    rows = rows.join(unescaped(modules).select(F.col("spelling").alias("name"), F.col("module").alias("_spelled"), F.lit(False).alias("_literal")), ["name", "_literal"], "left")
    rows = rows.join(modules.select(F.col("module").alias("name")).distinct().withColumn("_is", F.lit(True)), "name", "left")

    def suffixes(c: str) -> Column:
        parts = F.split(c, r"\.")
        return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))

    open_ = rows.where("_literal and _known is null and _is is null").select("page", "name")
    have = declared.select("page", F.col("name").alias("match"), "ord")
    longer = open_.join(have.withColumn("name", suffixes("match")), ["page", "name"])
    shorter = open_.withColumn("match", suffixes("name")).join(have, ["page", "match"])
    both = longer.select("page", "name", "match", "ord").unionByName(shorter.select("page", "name", "match", "ord"))
    near = both.groupBy("page", "name").agg(F.min_by("match", F.struct("ord", "match")).alias("_match"))
    rows = rows.join(near, ["page", "name"], "left")
    module = F.coalesce("_known", "_spelled", F.when(F.col("_is") & F.col("_literal"), F.col("name")), F.when(F.col("_match").isNotNull(), F.col("page")))
    anchor = F.when(F.col("_known").isNotNull(), F.col("name")).when(F.col("_is").isNull() & F.col("_spelled").isNull(), F.col("_match"))
    return rows.select("page", "name", module.alias("module"), anchor.alias("anchor")).where("module is not null")
