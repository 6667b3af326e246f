from evenkeel.llm import url_filters as u

SCHEMA = "page_id long, url string, html string, row string, ek_url string, component string, verdict string"


def judged(spark, rows, rules=u.RULES, redirects=None):
    pages = spark.createDataFrame([(i, url, html, "x", "y", "z", "w") for i, url, html in rows], SCHEMA)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
            for r in u.url_verdicts(pages, rules, redirects=redirects).select("row.page_id", "host", "path", "rule", "verdict").collect()}


def test_rules_hosts_and_paths(spark):
    got = judged(spark, [(1, "http://A.Example.NET/en/x?q#f", None), (2, "https://a.net/", ""), (3, "https://a.net", ""), (4, None, None),
                         (5, "no scheme", ""), (6, "x://notexample.com/de/", ""), (7, "x://b.example.com/de/", ""), (8, "http://é.org/fr/?a", "")])
    assert got == {1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("a.net", "/", "net/", "block"),
                   3: ("a.net", "", None, "block"),          # the address without the slash is an alias of the blocked one
                   4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("notexample.com", "/de/", None, "allow"),
                   7: ("b.example.com", "/de/", "example.com/de/", "block"), 8: ("é.org", "/fr/", "org/fr/", "allow")}


def test_decisions_reach_aliases_and_allow_goes_first(spark):
    html = '<html><LINK href="http://bad.net/p" rel="canonical"></html>'
    refresh = '<meta http-equiv="refresh" content="0; URL=/q">'
    rows = [(1, "http://x.com/a", html), (2, "https://x.com/a#top", ""), (3, "http://y.com/b?utm_source=z", refresh), (4, "https://y.com/q", ""),
            (5, "http://x.com/other", "")]
    moved = spark.createDataFrame([("https://y.com/q", "http://w.org/fr/1"), ("http://v.com/", "http://y.com/q"), (None, "x")], "src string, dst string")
    got = judged(spark, rows, redirects=moved)
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    both = spark.createDataFrame([("http://x.com/a", "http://w.org/fr/1")], "src string, dst string")
    assert judged(spark, rows, redirects=both)[2][3] == "allow"


def test_empty_repeated_and_long(spark):
    assert judged(spark, []) == {}
    long = "http://a.net/" + "x" * 200_000
    got = judged(spark, [(1, long, "<link " * 20_000), (2, long, ""), (3, long, "")], rules=[])
    assert {v[3] for v in got.values()} == {"allow"} and len(got) == 3
