import random
import time

import pytest

from fathom.llm import html as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><header><p>Site</p></header>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use</div><div id="main-ad" class="ad">Buy</div>
<article class="post"><h1>Title &amp; more</h1><p><b>One   two<br>three.<p>Four&nbsp;five &lt;x&gt;</p><ul><li>A<li>B</ul><form><input value="q"><p>Sign</p></form><aside>Side</aside>
<section class="comments"><article class="comment"><p>First!</p></article></section><p>Last</article><footer>&copy; x</footer></body></html>"""


def text(page):
    found = h.lines(page)
    return [t for t, z in found if z == 1]


def test_structure():
    assert text(PAGE) == ["Title & more", "One two three.", "Four five <x>", "A", "B", "Last"]
    assert text("<main><p>a<p>b <i>c</i>d</main>e") == ["a", "b cd"]
    assert text("<body><nav><p>menu<article><p>kept</article>") == ["kept"]
    assert text("<article><p>cut of") == ["cut of"] and text("<article><p>whole</p><a hre") == ["whole"]
    assert text('<div id="content"><p>a</p><div class="related">no</div></div><div class="x"><p>out</p></div>') == ["a"]
    assert h.lines("") == [] and h.lines("a < b & c") == [("a < b & c", 0)]
    assert h.lines("<p>" * 3000 + "deep") == [("deep", 0)] and len(h.lines("<div>" * 3000 + "x")) == 1


def test_long_and_broken_attributes():
    assert text('<article><p title="' + "x" * 100000 + '">ok</p></article>') == ["ok"]
    assert h.lines("<p " + "a='1' " * 20000)[:1] in ([], [("<p " + ("a='1' " * 20000).strip(), 0)])


@pytest.mark.parametrize("seed", range(8))
def test_common_is_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a = [rng.choice("abcde") for _ in range(rng.randrange(1, 40))]
    b = [rng.choice("abcde") for _ in range(rng.randrange(1, 40))]
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    found = sorted(h.common(a, b))
    assert len(found) == table[-1][-1]
    rest = iter(b)
    assert all(a[i] in rest for i in found)


def test_differencing(spark):
    page = lambda *own: "<body><p>Top line</p>" + "".join(f"<p>{x}</p>" for x in own) + "<p>Bottom line</p></body>"
    rows = [(1, "http://h.com/a/1", page("one", "uno")), (2, "http://h.com/a/2?q", page("two")), (3, "http://h.com/b/9", page("nine")), (4, "http://alone.com/", page("solo")), (5, "http://h.com/a/1x", page("one", "uno")), (6, None, None), (7, "http://h.com/z", ""), (8, "http://h.com/a/3", PAGE), (9, None, page("nowhere")), (1, "http://h.com/a/1", page("one", "uno"))]
    df = spark.createDataFrame([(i, u, p, "x") for i, u, p in rows], "page_id long, url string, html string, lines string").repartition(3)
    got = [(r.page_id, r.text, r.n_chars) for r in h.main_text(df).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    by = {i: t for i, t, _ in got}
    assert by[1] == by[5] == "one\n\nuno" and by[2] == "two" and by[3] == "nine" and by[6] == by[7] == ""
    assert by[4] == "Top line\n\nsolo\n\nBottom line" and by[8].startswith("Title & more\n\nOne two three.")
    assert sum(i == 1 for i, *_ in got) == 2


def test_a_part_of_its_pair_stays_and_empty(spark):
    rows = [(1, "http://h/a", "<p>x</p><p>y</p>"), (2, "http://h/b", "<p>x</p><p>y</p><p>z</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in h.main_text(df).collect()} == {1: "x\n\ny", 2: "z"}
    assert h.main_text(df.limit(0)).count() == 0


def test_embedded_elements_do_not_swallow_the_page():
    assert text('<article><p>one <svg class="i"/> two</p><p>three</p></article>') == ["one two", "three"]
    for name in ("video-js", "svg-icon", "object-x", "select-box", "title-x"):
        assert text(f"<article><p>one</p><{name}><p>two</p></{name}><p>three</p></article>") == ["one", "two", "three"]
    for name in ("svg", "object", "canvas", "audio", "video"):
        assert text(f"<article><p>one <{name} width=1>no <b>no</b></{name}> two</p><p>three</p></article>")[-1] == "three"
        assert text(f"<article><p>one</p><{name} width=1><p>two</p></article>") == ["one", "two"]
    for name in ("object", "canvas", "audio", "video", "template"):
        assert text(f"<article><p>one <{name}>no <p>no</p></{name}> two</p></article>") == ["one two"]
    assert text("<article><p>one<select><option>no<option>no</select> two</p></article>") == ["one two"]
    assert text("<article><div><p>one</p><select><option>no</div><p>two</p></article>") == ["one", "two"]
    assert text("<article><p>one <svg><title/><style/><text>no</text><foreignObject><p>no</p></foreignObject></svg> two</article>") == ["one two"]
    assert text("<article><svg><g><p>one</p></svg><p>two</p></article>") == ["one", "two"]
    assert text("<article><p>one<script>'<p>no</p>'</script > two<style>no</article>") == ["one two"]


def test_a_wrapper_does_not_drop_a_marked_article():
    for wrapper in ('div class="layout has-sidebar"', "div class='no-comments'", "div class=page-with-nav", "form", "form id=aspnetForm", 'div class="menu"', 'div aria-hidden="true"'):
        end = wrapper.split()[0]
        for tag in ("article", "main"):
            assert text(f"<{wrapper}><p>before</p><div><{tag}><p>a</p><p>b</p></{tag}></div><p>after</p></{end}>") == ["a", "b"]
    assert text('<form><div id="content"><p>a</p></div><p>b</p></form>') == ["a"]
    assert h.lines('<p>a</p><form><div class="content"><p>no</p></div></form>') == [("a", 0)]
    assert text('<main><p>a</p></main><div class="related"><article><p>other</p></article></div>') == ["a"]
    assert text('<article><p>a</p><div class="comments"><article><p>no</p></article></div><p>b</p></article>') == ["a", "b"]
    assert h.lines("<p>a</p><aside><article><p>no</p></article></aside><div hidden><main>no</main></div>") == [("a", 0)]


def test_attributes_and_classes_are_whole():
    for attribute in ('title="the hidden gems"', "data-x=' class=ad '", 'alt="role=navigation"', 'class="has-sidebar"', 'class="comments-off"', 'class="adopt"'):
        assert text(f"<article><p>a</p><div {attribute}><p>b</p></div></article>") == ["a", "b"]
    for attribute in ("hidden", 'class="x ad"', "class=cookie-notice", 'id="ad-300x250"', 'class="side-bar_left"', "ROLE=Navigation", 'title="x"class="share-buttons"', 'aria-hidden="true"'):
        assert text(f"<article><p>a</p><div {attribute}><p>b</p></div></article>") == ["a"]


def test_headings_and_paragraphs_of_an_article_keep_their_classes():
    page = '<article><h2 class="entry-header">Head</h2><p class="legal">a</p><section class="related-work"><p>b</p></section><div class="share-price">c</div><fieldset>d</fieldset><p class="ad">no</p><div class="legal">no</div><li class="comment">no</li></article>'
    assert text(page) == ["Head", "a", "b", "c", "d"]
    assert h.lines('<p>a</p><p class="legal">no</p><fieldset>no</fieldset>') == [("a", 0)]


@pytest.mark.parametrize("head", ['header class="entry-header"', 'div class="post-header"', 'div class="article-header"', 'section class="section-header"', 'div class="header"', 'div id="header-1"', 'section class="disclaimer"', 'div class="banner"', 'div class="header-legal"'])
def test_a_container_that_holds_a_heading_of_the_article_stays(head):
    end = head.split()[0]
    assert text(f"<article><{head}><h1>Title</h1><p>sub</p></{end}><p>a</p></article>") == ["Title", "sub", "a"]
    assert text(f"<article><{head}><div><div><h2>Title</h2></div></div></{end}><p>a") == ["Title", "a"]
    assert text(f"<article><{head}><h1>Title</h1>") == ["Title"]


def test_containers_inside_an_article():
    assert text('<article><h1><span class="header">Title</span></h1><p>a</p></article>') == ["Title", "a"]
    assert text('<article><ul class="menu-items"><li>Soup <a href="x">more</a><li>Fish</ul><p>a</p></article>') == ["Soup more", "Fish", "a"]
    assert text('<article><ul class="menu-items"><li><a href="x">One</a> | <li><a href="y">Two</a></ul><p>a</p></article>') == ["a"]
    assert text('<article><div class="breadcrumbs"><a>Home</a> &rsaquo; <a>News</a></div><p>a</p></article>') == ["a"]
    assert text('<article><ul><li class="related">b</ul><dl class="legal"><dt>c<dd>d</dl></article>') == ["b", "c", "d"]
    assert text('<article><div class="legal">no</div><div class="related"><h3>Related</h3><a>no</a></div><div class="ad"><h2>Buy</h2></div><p>a</p></article>') == ["a"]
    assert text('<article><div class="legal"><div class="ad"><p>no</p></div><h2>Terms</h2><nav><p>no</p></nav><p>b</p></div><p>a</p></article>') == ["Terms", "b", "a"]
    assert text('<article><p>Press <button>OK</button> now, <label>dear</label> reader</p><button>Share</button><form><p>no <button>no</button></p></form></article>') == ["Press OK now, dear reader"]
    assert h.lines('<p>a</p><div class="post-header"><h1>no</h1></div>') == [("a", 0)]


@pytest.mark.parametrize("part", [("<div>", "</b>"), ("<b><div>", "</b>"), ("<span>", "<p>"), ("<i>", "<li>x"), ("<nav>", "<article></article>"), ("<p>", "</div>"), ("<svg><g>", "<p>")])
def test_a_page_of_a_megabyte_takes_seconds(part):
    n = 500_000 // len("".join(part)) * 2
    start = time.perf_counter()
    h.lines(part[0] * (n // 2) + part[1] * (n // 2) + "end")
    assert time.perf_counter() - start < 20


def nearest(pages):
    """Pairs by comparing every two sets of lines of a host: in order of path, the neighbour that shares more path steps, the one before if equal."""
    first = {}
    for _, url, page in pages:
        host, path = h.split_url(url)
        own = tuple(t for t, _ in h.lines(page))
        first[host, own] = min(path, first.get((host, own), path))
    out = {}
    for host, own in first:
        signed = lambda x: h.xxhash.xxh3_64_intdigest("\n".join(x)) - (1 << 63)
        all_ = sorted((p, signed(x), x) for (g, x), p in first.items() if g == host)
        at = [x for *_, x in all_].index(own)

        def steps(x, a=all_[at][0].split("/")):
            n = 0
            for i, j in zip(a, x[0].split("/")):
                if i != j:
                    break
                n += 1
            return n

        near = [(steps(all_[i]), -k, all_[i][2]) for k, i in enumerate((at - 1, at + 1)) if 0 <= i < len(all_)]
        out[host, own] = max(near)[2] if near else None
    return out


def test_pairs_and_texts_equal_brute_force(spark):
    rng = random.Random(8)
    pages = []
    for i in range(160):
        own = [f"own {rng.randrange(60)}" for _ in range(rng.randrange(0, 4))]
        pages.append((i, f"http://h{rng.randrange(6)}.org/{rng.choice('ab')}/{rng.choice('cd')}/{rng.randrange(40)}", "<p>top</p>" + "".join(f"<p>{x}</p>" for x in own) + rng.choice(["<p>foot</p>", "<p>other foot</p>"])))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in h.main_text(df).collect()}
    pair = nearest(pages)
    for i, url, page in pages:
        own = tuple(t for t, _ in h.lines(page))
        other = pair[h.split_url(url)[0], own]
        shared = h.common(list(own), list(other)) if other else set()
        want = [t for n, t in enumerate(own) if n not in shared] if len(shared) < len(own) else list(own)
        assert got[i] == "\n\n".join(want)


def test_texts_of_a_whole_table(spark):
    """Every page of a table has the lines of its marked article, found by a plain search for its tags."""
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r.text for r in h.op10_main_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    plain = 0
    for r in pages:
        if (m := re.search(r"<article[^>]*>(.*)</article>", r.html or "", re.S)) and not re.search(r"<(?!/?(?:p|h\d|b|br)\b)", m[1]):
            blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h\d)\b[^>]*>", m[1])]
            assert got[r.page_id] == "\n\n".join(x for x in blocks if x)
            plain += 1
    assert plain > 0.9 * len(pages)


def test_marked_pages_are_differenced_too(spark):
    """Shared lines are found on every page; the article brings its own back, as a page's text and in its counts."""
    page = lambda own: f"<p>top</p><article><p>{own}</p><p>license</p></article><p>foot</p>"
    rows = [(1, "http://h.org/a/1", page("x")), (2, "http://h.org/a/2", page("y")), (3, "http://h.org/b", "<p>top</p><p>z</p>"), (6, "http://h.org/c", "<p>top</p><p>x</p>"), (4, "http://other.org/", page("x")), (5, None, None)]
    got = {r.page_id: (r.text, r.n_lines, r.n_shared) for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("x\n\nlicense", 4, 3), 2: ("y\n\nlicense", 4, 3), 3: ("z", 2, 1), 6: ("x", 2, 1), 4: ("x\n\nlicense", 4, 0), 5: ("", 0, 0)}
