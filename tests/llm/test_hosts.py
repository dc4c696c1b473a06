import pytest
from pyspark.sql import functions as F

from dayfold.llm import hosts as H

URLS = [
    (1, "http://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"),
    (2, "https://example.net/fr/", "example.net", "/fr/", "net/", "block"),
    (3, "https://x.example.com/de/1#t", "x.example.com", "/de/1", "example.com/de/", "block"),
    (4, "https://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    (5, "https://notnet", "notnet", "", None, "allow"),
    (6, "https://a.net", "a.net", "", None, None),
    (7, None, "", "", None, "allow"),
    (8, "no-scheme.net/en/", "", "", None, "allow"),
    (9, "http://net/", "net", "/", "net/", "block"),
    (10, "http://b.org?q=/fr/", "b.org", "", None, "allow"),
    (11, "http://host.org/a\nb?x", "host.org", "/a\nb", None, "allow"),
    (12, "", "", "", None, "allow"),
    (13, "x://y://z.net/q", "y:", "//z.net/q", None, "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "e") for i, u, *_ in URLS], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in H.judged_pages(pages).collect()}
    for i, _, host, path, rule, verdict in URLS:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), i
        assert verdict is None or got[i].verdict == verdict, i


def test_distrust_follows_links_backwards(spark):
    link = '<a class="x" HREF="//bad.net/q">b</a>'
    rows = [(i, "http://bad.net/x", None) for i in range(5)] + [(10, "http://friend.org/", link), (11, "http://friend.org/2", link)]
    rows += [(20 + i, f"http://clean{i}.org/", f'<a href = "https://good.org/fr/1">') for i in range(6)] + [(40, "http://good.org/fr/1", "<p>"), (41, "http://good.org/", "")]
    pages = spark.createDataFrame(rows + [(50, "http://alone.org/", None), (50, "http://alone.org/", None)], "page_id long, url string, html string")
    got = H.judged_pages(pages).collect()
    assert len(got) == len(rows) + 2
    verdicts = {r.page_id: r.verdict for r in got}
    assert verdicts[10] == verdicts[11] == "block" and verdicts[41] == verdicts[50] == "allow" and {verdicts[20 + i] for i in range(6)} == {"allow"}


def test_page_rank_matches_a_plain_loop(spark):
    rows = [(1, "http://a.org/", '<a href="//b.org/">'), (2, "http://b.org/", '<a href="//c.org/"><a href="//a.org/">'), (3, "http://c.org/fr/", None), (4, "http://c.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    host, path = H.url_parts(F.col("url"))
    parsed = pages.select(host.alias("host"), "html", H.matching(host, path)[1].alias("verdict"))
    got = {r.host: r.excess for r in H.host_trust(parsed, rounds=6).collect()}
    edges = {("a", "b"), ("b", "c"), ("b", "a")}
    out = {h: sum(s == h for s, _ in edges) for h in "abc"}
    seed = {"good": {"c": 1.0}, "plain": {"a": 0.25, "b": 0.25, "c": 0.5}}
    rank = {k: dict(v) for k, v in seed.items()}
    for _ in range(6):
        rank = {k: {h: 0.15 * seed[k].get(h, 0) + 0.85 * sum(v.get(s, 0) / out[s] for s, d in edges if d == h) for h in "abc"} for k, v in rank.items()}
    for h in "abc":
        assert got[f"{h}.org"] == pytest.approx(-rank["good"][h] / rank["plain"][h])


def test_empty(spark):
    assert H.judged_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_suspicion_decides_by_the_judged_pages(spark):
    """Sibling hosts of two domains, judged in a few pages: the others follow their domain, however many pages are blocked in all."""
    rows = [(k, f"http://s{k}.example.com/{p}", None) for k in range(20) for p in ("de/1", "en/1", "en/2", "fr/3")]
    rows += [(100 + k, f"http://s{k}.example.org/{p}", None) for k in range(20) for p in ("fr/1", "en/1", "en/2")]
    rows += [(200, "http://alone.info/", None)]
    pages = spark.createDataFrame([(10 * i + n, u, h) for n, (i, u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = [(r.host, r.verdict) for r in H.judged_pages(pages).collect() if r.rule is None]
    assert {v for h, v in got if h.endswith(".com")} == {"block"} and {v for h, v in got if not h.endswith(".com")} == {"allow"}


def test_bound_separates_best(spark):
    rows = [("a", 0.1, 9, 1), ("b", 0.3, 8, 2), ("c", 0.7, 2, 8), ("d", 0.9, 0, 9), ("e", None, 50, 50)]
    trust = spark.createDataFrame(rows, "host string, reached double, n_good long, n_bad long")
    assert 0.3 < H.bound(trust) < 0.7
    assert H.bound(trust.where("n_good = 0")) == H.EVEN
