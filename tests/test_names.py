import pytest
from pyspark.sql import functions as F

from fathom.functions import names as N


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_utf16(spark):
    rows = spark.createDataFrame([("\U0001d49c",), ("Ａ",), ("a",)], "n string")
    assert [r.n for r in rows.orderBy(N.utf16_key(F.col("n"))).collect()] == ["a", "\U0001d49c", "Ａ"]
    assert one(spark, N.utf16_length(F.col("t")), t="a\U0001d49cb") == 4
    cut = lambda a, b: one(spark, N.utf16_slice(F.col("t"), F.col("a"), F.col("b")), t="a\U0001d49cb", a=a, b=b)
    assert (cut(1, 3), cut(0, 4), cut(3, 4), cut(2, 2)) == ("\U0001d49c", "a\U0001d49cb", "b", None)
    assert cut(1, 2) is None and cut(0, 9) is None


@pytest.mark.parametrize(
    ("name", "parts"),
    [("A.B", ["A", "B"]), ("A", ["A"]), ("A..B", ["A", "", "B"]), ("«A.x».B", ["A.x", "B"]), ("A.«b-c»", ["A", "b-c"]), ("\U0001d49c.ﬀ", ["\U0001d49c", "ﬀ"])],
)
def test_components(spark, name, parts):
    assert one(spark, N.components(F.col("n")), n=name) == parts


def test_escapes_and_grammar(spark):
    esc = lambda p: one(spark, N.escape_component(F.col("p")), p=p)
    assert [esc(p) for p in ("a1", "α'", "λ", "b-c", "1a", "")] == ["a1", "α'", "«λ»", "«b-c»", "«1a»", "«»"]
    ok = lambda n: one(spark, N.is_name(F.col("n")), n=n)
    assert [ok(n) for n in ("A.b", "x₁", "A.«b c»", "A.", ".A", "a b", "1")] == [True, True, True, False, False, False, False]


def test_orders(spark):
    rows = spark.createDataFrame([("Zzz",), ("Foo.Bar",), ("Foo",)], "n string")
    assert [r.n for r in rows.orderBy(N.depth_first_key(F.col("n"))).collect()] == ["Foo", "Zzz", "Foo.Bar"]


def test_paths_and_private_names(spark):
    assert one(spark, N.page_path(F.col("m")), m="A.«x.y».C") == "A/x.y/C.html"
    assert one(spark, N.page_root(F.col("m")), m="A.B.C") == "./../../"
    user = lambda n: one(spark, N.private_user_name(F.col("n")), n=n)
    module = lambda n: one(spark, N.private_module(F.col("n")), n=n)
    assert (user("_private.A.B.0.f.g"), module("_private.A.B.0.f.g")) == ("f.g", "A.B")
    assert (user("A.f"), module("A.f")) == ("A.f", None)
    assert one(spark, N.github_path(F.col("r")), r="git@github.com:a/b.git") == "a/b"
    assert one(spark, N.github_path(F.col("r")), r="https://example.org/a/b") is None


def test_tokens(spark):
    tokens = lambda d: one(spark, N.link_tokens(F.col("d")), d=d)
    assert tokens("See `A.b` and `x y.`") == ["A.b", "b", "x", "y.", ""]
    assert tokens("open ` only\n`A`") == ["A"]
    assert tokens("a [t](Foo.bar) [u](x y) [v]( z)") == ["Foo.bar", "bar"]
    assert tokens("`A B`") == ["A", "B"]


def test_kinds(spark):
    words = lambda k, m: one(spark, N.kind_words(F.col("k"), F.split("m", ",")), k=k, m=m)
    assert words("definition", "unsafe,noncomputable") == "unsafe noncomputable def"
    assert words("definition", "abbrev") == "abbrev" and words("instance", "abbrev") == "instance"
    assert words("opaque", "partial") == "partial def" and words("class_inductive", "") == "class inductive" and words("def", "") == "def"
    assert one(spark, N.kind_class(F.col("k")), k="constructor") == "ctor"
    known = lambda v, s: one(spark, N.known_or(F.col("s"), F.col("v"), 6), v=v, s=s)
    assert (known(None, 5), known(None, 6), known("direct", 5)) == ("unknown", "clean", "direct")
