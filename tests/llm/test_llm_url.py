import re

from tracewarden.llm import queries, url_filter


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not m else ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2])


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)


URLS = [
    "http://org", "http://org/", "https://a.ORG/x", "https://borg/x", "https://example.org/es/1", "https://x.example.org/es/", "https://example.org/esx", "https://example.org/en/1", "https://example.org/en/12?x#y",
    "https://example.org/en/2", "http://a.com/fr/", "http://com/de/x", "http://a.com/de", "mailto:x", None, "", "://", "x://h?p/a", "x://h#/a", "http://ÄB.com/fr/é", "http://h/a://b/c", "http://h\n.com/fr/\n", "http://casino-win.example.net/en/1", "https://" + "long." * 5000 + "com/fr/" + "y" * 9000,
]


def test_against_brute_force(spark):
    rows = [(i, u, "x", 1.0) for i, u in enumerate([*URLS, URLS[0]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, score double")
    model = url_filter.train(queries.labelled_urls(spark))
    got = {r["page_id"]: r for r in url_filter.judge(pages, queries.URL_RULES, model).collect()}
    assert len(got) == len(rows)
    for i, u, *_ in rows:
        host, path = split(u)
        rule = rule_of(host, path, queries.URL_RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule.text), u
        want = ("allow" if rule.allow else "block") if rule else ("block" if got[i]["score"] >= 0.5 else "allow")
        assert got[i]["verdict"] == want
    assert got[URLS.index("http://casino-win.example.net/en/1")]["verdict"] == "block"


def test_classifier_on_pages(spark):
    rows = queries.QUERIES["op1_url_filter"](spark, "/root/testdata/sf0.01").where("rule is null").collect()
    bad = re.compile("casino|pills|spam|bets|ads-|adult")
    assert sum((r["verdict"] == "block") == bool(bad.search(r["host"])) for r in rows) / len(rows) > 0.97


def test_empty_tables(spark):
    none = spark.createDataFrame([], "url string, block boolean")
    model = url_filter.train(none)
    pages = spark.createDataFrame([(1, "http://a.net/x"), (None, None)], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.judge(pages, [], model).collect()} == {"allow"}
    assert url_filter.judge(pages.where("false"), queries.URL_RULES, model).count() == 0


def test_urls_that_are_bad_by_their_path(spark):
    bad = ["https://news.example.net/casino/free-spins", "https://theguardian.net/world/2024/porn-xxx", "https://bbc.co.uk/news/poker-bets-jackpot", "https://garden.org/cheap-viagra-pills.html"]
    good = ["https://news.example.net/world/history", "https://theguardian.net/world/2024/gardens-of-the-north", "https://bbc.co.uk/news/winter-weather-report", "https://garden.org/tomatoes-in-summer.html", "https://example.net/" + "long-story-of-people/" * 4000]
    pages = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    model = url_filter.train(queries.labelled_urls(spark))
    got = {r["page_id"]: r["score"] for r in url_filter.judge(pages, [], model).collect()}
    assert [got[i] >= 0.5 for i in range(len(got))] == [True] * len(bad) + [False] * len(good), got
