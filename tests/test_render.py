import pytest
from pyspark.sql import functions as F

from fathom.operators import render as r


def span(start, stop, kind, name=None, front=0, back=0):
    return {"start": start, "stop": stop, "kind": kind, "name": name, "front": front, "back": back}


def test_fragments():
    links = {"Nat": "Nat.html#Nat"}
    assert r.fragment("f Nat", [span(0, 5, 0), span(2, 5, 1, "Nat")], links, "./") == ('<span class="fn">f <a href="Nat.html#Nat">Nat</a></span>', True)
    assert r.fragment("a<b", [], {}, "./") == ("a&lt;b", False)
    assert r.fragment("Type", [span(0, 4, 2)], {}, "../")[0] == '<a href="../foundational_types.html">Type</a>'
    assert r.fragment("xy", [span(0, 1, 0), span(1, 2, 1, "no")], {}, "")[0] == '<span class="fn">x</span><span class="fn">y</span>'
    assert r.fragment("Nat Nat", [span(0, 7, 1, "Nat"), span(0, 3, 1, "Nat")], links, "")[0] == '<a href="Nat.html#Nat">Nat</a> Nat'
    assert r.fragment("\U0001d49c\nNat", [span(3, 6, 1, "Nat", 1, 0)], links, "")[0] == '\U0001d49c <a href="Nat.html#Nat">Nat</a>'
    with pytest.raises(ValueError):
        r.spaced("abc", [span(0, 3, 0, None, 0, 4)])


def test_formulas():
    assert r.mathml("x^2") == "<math><msup><mi>x</mi><mn>2</mn></msup></math>"
    assert r.mathml(r"\frac{a}{b_1}", True) == '<math display="block"><mfrac><mrow><mi>a</mi></mrow><mrow><msub><mi>b</mi><mn>1</mn></msub></mrow></mfrac></math>'
    assert r.mathml(r"\colim_k F") is None and r.mathml("{x") is None and r.mathml("x^^2") is None


def test_markdown():
    link = {"Nat.succ": "N.html#succ", "succ": "S.html"}.get
    m = lambda t: r.Markdown(link).render(t)
    assert m("a *b* **c** ~~d~~ `x<y`\n\nnext") == "<p>a <em>b</em> <strong>c</strong> <del>d</del> <code>x&lt;y</code></p><p>next</p>"
    assert m("`Nat.succ` `Foo.succ`") == '<p><code><a href="N.html#succ">Nat.succ</a></code> <code>Foo.<a href="S.html">succ</a></code></p>'
    assert m("# A b!") == '<h1 id="A-b" class="markdown-heading">A b! <a class="hover-link" href="#A-b">#</a></h1>'
    assert m("- a\n- b\n  - c\n\nend") == "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul><p>end</p>"
    assert m("3. a\n\n4. b") == '<ol start="3"><li><p>a</p></li><li><p>b</p></li></ol>'
    assert m("```py\na<b\n```\n---") == '<pre><code class="language-py">a&lt;b\n</code></pre><hr>\n'
    assert m("> q\n> r") == "<blockquote><p>q\nr</p></blockquote>"
    assert m("| a | b |\n|---|---|\n| 1 |\n") == "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td></td></tr></tbody></table>"
    assert m("[t](##Nat.succ) [u](x.html) [v](#w) <b>") == '<p><a href="N.html#succ">t</a> <a href="./x.html">u</a> <a href="#w">v</a> &lt;b&gt;</p>'
    assert m("see https://a.org/b.") == '<p>see <a href="https://a.org/b">https://a.org/b</a>.</p>'
    assert m(r"$x$ \* 5 $\bad$") == r"<p><math><mi>x</mi></math> * 5 $\bad$</p>"


def test_columns_and_pages(spark, tmp_path):
    rows = spark.createDataFrame([("M", 1, 0, 0, "see `a` $\\bad$")], "module string, line int, col int, ord int, text string")
    docs = rows.withColumn("d", r.docstrings(F.col("text"), F.create_map(F.lit("a"), F.lit("A.html")), F.lit("./"))).select("module", "line", "col", "ord", "d.html", "d.failures")
    assert docs.first().failures == 1 and '<a href="A.html">a</a>' in docs.first().html
    code = spark.createDataFrame([("M", "M.f", 0, 0, 5, [(0, 3, 1, "Nat", None, None)], "Nat"), ("M", "M.g", 1, 9, 0, [], "x"), ("M", "M.g.mk", 2, 9, 1, [], "y")], f"module string, name string, index int, line int, col int, spans {r.SPAN}, text string")
    decls = code.withColumn("h", r.fragments(F.col("text"), F.col("spans"), F.create_map(F.lit("Nat"), F.lit("N.html")), F.lit("./"))).select("module", "name", "index", "line", "col", "h.html")
    items = r.page_items(docs, decls, spark.createDataFrame([("M.g.mk",)], "name string"))
    page = r.pages(items).first()
    assert page.html.index("N.html") < page.html.index("A.html") < page.html.index("x</main>") and "y</main>" not in page.html
    assert r.write_pages(r.pages(items).select(F.lit("a/M.html").alias("path"), "html"), str(tmp_path)) == 1
    assert r.prune_pages(str(tmp_path), spark.createDataFrame([("a/M.html",), ("none.html",)], "path string")) == 1 and not (tmp_path / "a").exists()
    with pytest.raises(Exception, match="outside"):
        r.prune_pages(str(tmp_path), spark.createDataFrame([("../x",)], "path string"))
