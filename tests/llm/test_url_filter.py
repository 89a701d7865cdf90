import pytest

from tamarack.llm import url_filter

PAGES = "page_id long, url string"
UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute(pages, rules):
    out = []
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(c.lower() if c in UP else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((i, host, path, best and best[3], best[4] if best else "allow"))
    return sorted(map(repr, out))


CASES = [
    (1, "http://Example.COM/en/x?y#z"), (2, "https://www.example.com/en/"), (3, "https://a.b.www.example.com/en/q"), (4, "http://x.net/es/1"), (5, "http://net/fr/"), (6, "http://x.net/de/"),
    (7, "http://com"), (8, "http://x.com?/en/"), (9, "no scheme example.com/en/"), (10, None), (11, ""), (12, "http:///path"), (13, "http://notexample.com/en/"), (14, "x://a://b.net/es/"),
    (15, "http://example.com/En/"), (16, "http://example.com:80/en/"), (17, "http://é.com/ü\n/x"), (1, "http://Example.COM/en/x?y#z"), (None, "http://x.net/es/"), (18, "http://" + "a." * 3000 + "net/es/" + "y" * 5000),
]


def got(spark, pages, rules):
    return sorted(repr(tuple(r)) for r in url_filter.judge(spark.createDataFrame(pages, PAGES), rules).collect())


def test_rules_of_the_query(spark):
    assert got(spark, CASES, url_filter.rules_table(spark)) == brute(CASES, url_filter.RULES)


def test_ties_repeats_nulls_and_many_rules(spark):
    rules = [("allow", "ab.com", "/"), ("block", "com", "/abc/"[:4]), ("allow", "ab.com", "/"), ("block", "x.org", "/"), ("allow", "x.org", "/")] + [("block", f"h{k}.org", f"/{k}/") for k in range(400)]
    pages = [(k, f"http://h{k}.org/{k}/x") for k in range(500)] + [(900, "http://ab.com/abc/"), (901, "http://x.org/"), (902, "http://q.h3.org/3/")]
    table = url_filter.rules_table(spark, rules).unionByName(spark.createDataFrame([(None, "y.org", "/"), ("block", None, "/")], "action string, host string, path string"))
    assert got(spark, pages, table) == brute(pages, rules)


@pytest.mark.parametrize("pages", [[], CASES[:3]])
def test_empty_tables(spark, pages):
    none = url_filter.rules_table(spark).filter("false")
    assert got(spark, pages, none) == brute(pages, [])
    assert got(spark, [], url_filter.rules_table(spark)) == []


def test_clashing_columns(spark):
    names = "page_id long, url string, _rid long, pos int, key string, block long, bits long, h string, p string, code long, html string"
    pages = [(i, u, 1, 2, "k", 3, 4, "h", "p", 5, None) for i, u in CASES]
    made = url_filter.judge(spark.createDataFrame(pages, names), url_filter.rules_table(spark))
    assert sorted(repr(tuple(r)) for r in made.collect()) == brute(CASES, url_filter.RULES)


def test_no_python_on_the_executors(spark):
    df = url_filter.judge(spark.createDataFrame([(1, "http://x.net/")], PAGES).select("page_id", "url"), url_filter.rules_table(spark))
    assert "Python" not in df._jdf.queryExecution().optimizedPlan().toString()
