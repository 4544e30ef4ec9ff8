from datetime import date

from fathom.llm import urlfilter as u

ENTRIES = [("bad", "evil.com", "2024-01-10", "add"), ("bad", "evil.com", "2024-02-10", "remove"), ("bad", "EVIL.com", "2024-03-10", "add"), ("bad", "evil.com", "2024-04-01", "add"), ("other", "a.org/x", "2024-01-01", "add"), ("allow", "ok.evil.com", "2024-01-01", "add"), ("bad", "evil.com", "2024-05-01", "add"), ("bad", "evil.com", "2024-05-01", "remove"), (None, None, "2024-01-01", "add"), ("bad", "z.com", None, "add"), ("bad", "z.com", "2024-01-01", "what")]
CAPTURES = [("http://evil.com/", "2024-01-09"), ("http://evil.com/", "2024-01-10"), ("https://u:p@Sub.Evil.COM:80/a?b#c", "2024-02-09"), ("http://evil.com", "2024-02-10"), ("http://evil.com/", "2024-04-20"), ("http://evil.com/", "2024-05-01"), ("http://notevil.com/", "2024-01-20"), ("http://ok.evil.com/q", "2024-01-20"), ("http://a.org/x", "2024-06-01"), ("http://a.org/x/y", "2024-06-01"), ("http://a.org/xy", "2024-06-01"), ("http://a.org", "2024-06-01"), (None, "2024-01-20"), ("", "2024-01-20"), ("http://evil.com/", None), ("http://z.com", "2024-06-01"), ("http://evil.com/", "2024-01-10")]
BLOCKED = {1, 2, 4, 8, 9, 16}


def frames(spark):
    day = lambda s: date.fromisoformat(s) if s else None
    entries = spark.createDataFrame([(a, b, day(c), d) for a, b, c, d in ENTRIES], "list string, pattern string, since date, action string")
    captures = spark.createDataFrame([(i, url, day(t), "x") for i, (url, t) in enumerate(CAPTURES)], "id int, url string, fetched date, key string")
    return captures, entries


def test_as_of_join(spark, monkeypatch):
    captures, entries = frames(spark)
    for limit in (u.BROADCAST, 0):  # broadcast rules, then salted ones
        monkeypatch.setattr(u, "BROADCAST", limit)
        rows = u.evaluate(captures, entries).collect()
        assert len(rows) == len(CAPTURES) and {r.id for r in rows if r.blocked} == BLOCKED
    row = next(r for r in rows if r.id == 4)
    assert (row.host, row.lists, row.since) == ("evil.com", "bad", date(2024, 3, 10))


def test_empty(spark):
    captures, entries = frames(spark)
    assert u.evaluate(captures.limit(0), entries).count() == 0
    assert not any(r.blocked for r in u.evaluate(captures, entries.limit(0)).collect())


def test_long_urls_and_names_of_results(spark):
    """A path of very many steps costs only as many keys as the rules are deep; the caller's columns stay."""
    _, entries = frames(spark)
    deep = "http://" + "s." * 50 + "evil.com/" + "//".join("ab" for _ in range(20000))
    rows = [(1, deep, date(2024, 1, 20), "h", True, "l", "s", "k"), (2, "http://www.a.org//x//" + "y/" * 9000, date(2024, 6, 1), "h", False, "l", "s", "k")]
    captures = spark.createDataFrame(rows, "id int, url string, fetched date, host string, Blocked boolean, lists string, since string, _host string")
    out = u.evaluate(captures, entries)
    assert out.columns == [*captures.columns, "host_", "blocked_", "lists_", "since_"]
    got = sorted(out.collect())
    assert [(r.host, r.blocked_, r.lists_) for r in got] == [("h", True, "bad"), ("h", True, "other")] and got[1].Blocked is False
    longest = max(len(x) for x in (r.k for r in captures.select(u.keys(u.host(captures.url), u.path(captures.url), 2, 1).alias("k")).collect()))
    assert longest <= 4
