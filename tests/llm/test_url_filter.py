from oncekeep.llm import url_filter
from oncekeep.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "HTTP://Sub.EXAMPLE.net/en/x", "https://example.net/en/", "https://example.net/en", "https://example.net",
    "https://example.net?q", "https://a.b.example.net/fr/#x", "https://notexample.com/de/x", "https://example.com/de/", "https://a.org/fr/", "https://a.org/fr?x",
    "x://y.net/://org/fr/", "http://net/", "http://net./a", "http://ÄB.net/p", "http://" + "a." * 500 + "net/" + "p/" * 500, "https://user@example.com/de/1",
]


def plain(url, rules=URL_RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    fit = [(len(h + p), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def judged(spark, urls, rules=URL_RULES):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    return {r.page_id: r[1:] for r in url_filter.judge_urls(pages, table).select("page_id", "host", "path", "rule", "verdict").collect()}


def test_equal_to_plain_matching(spark):
    urls = URLS + URLS[:7]
    got = judged(spark, urls)
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == plain(u), u


def test_rules_without_trailing_slash_and_ties(spark):
    rules = [("a.com", "/ab", "block"), ("a.com", "/abc", "allow"), ("x.a.com", "", "block"), ("x.a.com", "", "allow"), (None, "/", "block")]
    urls = ["http://a.com/abd", "http://a.com/abcd", "http://x.a.com/q", "http://x.a.com/abcx", "http://b.com/"]
    got = judged(spark, urls, rules)
    for i, u in enumerate(urls):
        assert got[i] == plain(u, [r for r in rules if r[0]]), u


def test_no_rules_and_no_pages(spark):
    assert judged(spark, ["http://a.net/"], [])[0] == ("a.net", "/", None, "allow")
    assert judged(spark, []) == {}
