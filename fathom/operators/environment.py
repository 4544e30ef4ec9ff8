"""Facts of a compiled environment, one row a constant, as declarations: what is shown, of which kind, with which attributes.

The flags themselves come from a compiler as columns; the rules over them are here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators import graph
from fathom.operators.index import first_owner

#: Names that stand for a sort among the types of an instance, and the priority that isn't printed.
PROP, TYPE, SORT = "_builtin_prop", "_builtin_typeu", "_builtin_sortu"
PRIORITY = 1000


def _is(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def hidden() -> Column:
    """Whether a constant isn't shown: one without a place in the source, or that only the compiler made; a projection always is.

    Flags: projection, has_range, internal, aux_recursor, no_confusion, internal_detail, recursor, matcher.
    """
    made = _is("internal") | _is("aux_recursor") | _is("no_confusion") | _is("internal_detail") | _is("recursor") | _is("matcher")
    return ~_is("projection") & (~_is("has_range") | made)


def kind() -> Column:
    """Kind of a constant by its sort (constant) and the flags instance, projection, structure and class; null for recursors."""
    sort = F.col("constant")
    instance = _is("instance") & ~_is("projection")
    of_type = F.when(_is("structure") & _is("class"), "class").when(_is("structure"), "structure").when(_is("class"), "class_inductive").otherwise("inductive")
    return (
        F.when(sort.isin("theorem", "definition"), F.when(instance, "instance").otherwise(sort))
        .when(sort == "inductive", of_type)
        .when(sort == "quotient", "opaque")
        .when(sort.isin("axiom", "opaque", "constructor"), sort)
    )


def modifiers(kind_: Column) -> Column:
    """Modifiers in the order they are printed; flags: unsafe, partial, noncomputable, abbrev."""
    sort = F.col("constant")
    unsafe = F.when(_is("unsafe"), "unsafe")
    words = F.array(unsafe, F.when(_is("noncomputable"), "noncomputable"), F.when((kind_ == "definition") & _is("abbrev"), "abbrev"))
    found = (
        F.when(sort == "axiom", F.array(unsafe))
        .when(sort == "opaque", F.array(F.when(_is("partial"), "partial").otherwise(unsafe)))
        .when(sort == "definition", words)
        .when((sort == "inductive") & (kind_ == "inductive"), F.array(unsafe))
    )
    return F.array_compact(F.coalesce(found, F.array().cast("array<string>")))


def sorry(depends: Column, mentions: Column) -> Column:
    """`direct` if the constant itself has the hole, `transitive` if only what it depends on, which is also said of an unknown constant; else null."""
    return F.when(depends, F.when(F.coalesce(mentions, F.lit(False)), "direct").otherwise("transitive"))


def attributes() -> Column:
    """All attributes [name] or [name, value] in their order: simp, csimp and reducibility, then tags, inlining, valued ones, and an instance's own.

    Columns: simp, csimp, reducibility, tags (array<string>), inline, parametric (array<array<string>>), priority, default_priority.
    """
    none = F.array().cast("array<array<string>>")
    one = lambda keep, *words: F.when(keep, F.array(F.array(*words))).otherwise(none)
    lit = F.lit
    reducible = F.col("reducibility").isNotNull() & (F.col("reducibility") != "semireducible")
    return F.concat(
        one(_is("simp"), lit("simp")),
        one(_is("csimp"), lit("csimp")),
        one(reducible, F.col("reducibility")),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.array(t)),
        one(F.col("inline").isNotNull(), F.col("inline")),
        F.coalesce("parametric", none),
        one(F.col("priority") != PRIORITY, lit("instance"), F.col("priority").cast("string")),
        one(F.col("default_priority").isNotNull(), lit("defaultInstance"), F.col("default_priority").cast("string")),
    )


def instance_types(arguments: Column) -> Column:
    """Head constants of an instance's explicit arguments (explicit, sort, head); sort is `zero`, `succ` or another level, else null.  Others are left out."""
    name = lambda a: F.when(a["sort"] == "zero", PROP).when(a["sort"] == "succ", TYPE).when(a["sort"].isNotNull(), SORT).otherwise(a["head"])
    return F.array_compact(F.transform(F.filter(arguments, lambda a: a["explicit"]), name))


def generated_origin(declared: DataFrame, structures: DataFrame, theorems: DataFrame) -> DataFrame:
    """(name, origin) of declarations (name, same_range) that were made from another: `S.ext` from a structure S, and `S.ext_iff` from `S.ext`.

    Both only where the name has no place of its own in the source and `S.ext` is one of the extensionality ``theorems`` (name).
    """
    rows = declared.where("same_range").select("name", F.regexp_extract("name", r"^(.+)\.ext$", 1).alias("_of"), F.regexp_extract("name", r"^(.+)\.ext_iff$", 1).alias("_iff"))
    ext = theorems.select("name").distinct()
    own = rows.where("_of <> ''").join(ext, "name", "left_semi").join(structures.select(F.col("name").alias("_of")).distinct(), "_of", "left_semi")
    iff = rows.where("_iff <> ''").select("name", F.concat("_iff", F.lit(".ext")).alias("origin")).join(ext.withColumnRenamed("name", "origin"), "origin", "left_semi")
    iff = iff.join(declared.select(F.col("name").alias("origin")).distinct(), "origin", "left_semi")
    return own.select("name", F.col("_of").alias("origin")).unionByName(iff.select("name", "origin"))


def scan(constants: DataFrame) -> DataFrame:
    """Declarations of an environment: constants (name, module, module_ord, constant and flags) that are shown, each under the first module that
    has it, with kind and modifiers."""
    rows = first_owner(constants, "name", "module_ord").where(~hidden())
    rows = rows.withColumn("kind", kind()).where("kind is not null")
    return rows.withColumn("modifiers", modifiers(F.col("kind")))


def sorry_facts(direct: DataFrame, refs: DataFrame) -> DataFrame:
    """(node, kind): constants with a hole of their own (``direct``: node), and those that depend on one over ``refs`` (src, dst)."""
    return graph.transitive(direct, refs)
