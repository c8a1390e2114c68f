import itertools

import pytest
from pyspark.sql import functions as F

from staygrid.functions import urls
from staygrid.operators import dedup
from staygrid.operators.ordered import one_per_key
from staygrid.plans import crawl


@pytest.mark.parametrize("fn, raw, want", [
    (urls.canonical_key, "https://www.example.com/", "example.com"),
    (urls.index_form, "http://www.x.com:80/a/index.html#top", "https://x.com/a"),
    (urls.index_form, "https://x.com/#/route", "https://x.com/#/route"),
    (urls.index_form, "https://x.com/index.php", "https://x.com/"),
    (urls.map_form, "x.com/a/?q=1", "http://x.com/a/"),
    (urls.map_form, "ftp://x.com", None),
    (urls.href, "HTTP://X.com:80/ä b/../c?d=é", "http://x.com/c?d=%C3%A9"),
    (urls.href, "https://x.com:8443", "https://x.com:8443/"),
    (urls.canonical_host, "www.x.com/a", "x.com"),
    (urls.hotel_id, "https://t.example/hotel/vn/sea-view.vi.html?aid=1", "sea-view"),
])
def test_forms(val, fn, raw, want):
    assert val(fn, u=raw) == want


def test_prefixes(val):
    assert val(urls.path_prefixes, u="https://x.com/a/b?q=1") == [
        "https://x.com/", "https://x.com/a", "https://x.com/a/b", "https://x.com/a/b?q=1"]


def test_domain_splits(val):
    assert val(urls.domain_splits, h="a.b.x.co.uk") == ["x.co.uk", "b.x.co.uk", "a.b.x.co.uk"]
    assert val(urls.domain_splits, h="www.x.com") == ["x.com"]
    assert val(urls.domain_splits, h="x.com") == ["x.com"]


@pytest.mark.parametrize("ref, want", [
    ("page.php", "https://example.org/foo/page.php"), ("/a", "https://example.org/a"), ("../z", "https://example.org/z"),
    ("./q", "https://example.org/foo/q"), ("?x=1", "https://example.org/foo/bar?x=1"), ("#f", "https://example.org/foo/bar?q#f"),
    ("//y.org/b", "https://y.org/b"), ("https://z.org/c/../d", "https://z.org/d"), ("a//b", "https://example.org/foo/a//b"),
    ("", "https://example.org/foo/bar?q"), ("../../../x/.", "https://example.org/x/"), ("tel:1", "tel:1"),
])
def test_resolve(val, ref, want):
    assert val(urls.resolve, b="https://example.org/foo/bar?q#h", r=ref) == want


def test_equivalence_class(val):
    members = [f"{s}://{w}x.com/a{e}" for s, w, e in itertools.product(
        ["http", "https"], ["", "www."], ["", "/", "/index.html", "/index.php"])]
    keys = {val(urls.equivalence_key, u=m) for m in members}
    assert keys == {"http://www.x.com/a/index.html"}
    key = keys.pop()
    assert val(urls.equivalence_key, u=key) == key


def test_unique_urls(spark):
    rows = [("http://a.com/p", 0), ("https://www.a.com/p", 1), ("https://a.com/p", 2), ("http://b.com/", 3)]
    got = dedup.unique_urls(spark.createDataFrame(rows, "url string, ord int"), "url", "ord")
    assert {r.url for r in got.collect()} == {"https://a.com/p", "http://b.com/"}


LINKS = [
    ("mailto:a@b.co", "NON_WEB_PROTOCOL"), ("/docs/a/b/c", "DEPTH_LIMIT"), ("/docs/a.png", "FILE_TYPE"),
    ("/docs/a#part", "SECTION_LINK"), ("/blog", "BACKWARD_CRAWLING"), ("/docs/private", "EXCLUDE_PATTERN"),
    ("https://github.com/x", "SOCIAL_MEDIA"), ("https://other.org/x", "EXTERNAL_LINK"), ("/docs/ok", None),
]


def test_link_rules(spark):
    df = spark.createDataFrame([(link,) for link, _ in LINKS], "link string")
    site = F.lit("https://x.com/docs")
    rules = crawl.LinkRules(max_depth=3, excludes=["private"])
    out = df.select("link", crawl.denial_reason(urls.resolve(site, F.col("link")), site, site, rules).alias("why"))
    assert {r.link: r.why for r in out.collect()} == dict(LINKS)


def test_subdomains_and_external(val):
    site = F.lit("https://x.com/")
    sub = crawl.LinkRules(allow_subdomains=True, includes=["^/in"])
    assert val(lambda u: crawl.denial_reason(u, site, site, sub), u="https://blog.x.com/in/a") is None
    assert val(lambda u: crawl.denial_reason(u, site, site, sub), u="https://blog.x.com/out") == "INCLUDE_PATTERN"
    ext = crawl.LinkRules(allow_external=True)
    assert val(lambda u: crawl.denial_reason(u, site, site, ext), u="https://y.org/a") is None
    assert val(lambda u: crawl.denial_reason(u, site, site, ext), u="https://y.org/") == "EXTERNAL_LINK"


def test_robots(spark):
    txt = "User-agent: *\nDisallow: /private/\nAllow: /private/open$\nDisallow: /*.pdf\n\nUser-agent: Bad\nDisallow: /"
    files = spark.createDataFrame([("x.com", txt)], "host string, robots_txt string")
    links = spark.createDataFrame([(u,) for u in [
        "https://x.com/private", "https://x.com/private/a", "https://x.com/private/open", "https://x.com/a.pdf", "https://x.com/ok",
        "https://free.org/private/a"]], "link string")
    rules = crawl.robots_rules(files)
    ok = lambda agents: {r.link: r.robots_allowed for r in crawl.with_robots(links, rules, agents).collect()}
    good = ok(["any"])
    assert good == {
        "https://x.com/private": False, "https://x.com/private/a": False, "https://x.com/private/open": False,
        "https://x.com/a.pdf": False, "https://x.com/ok": True, "https://free.org/private/a": True}
    assert ok(["bad"])["https://x.com/ok"] is False
    assert ok(["bad", "any"])["https://x.com/ok"] is True


def test_blocklist(spark):
    urls_ = ["https://www.face.com/a", "https://face.net/a", "https://a.b.org/x", "https://ok.com/", "https://face.com/press-kit", "https://ab.io/"]
    df = spark.createDataFrame([(u,) for u in urls_], "url string")
    blocked = spark.createDataFrame([("face.com",), ("b.org",), ("ab.com",)], "blocked string")
    out = {r.url: r.block_reason for r in crawl.with_block_reason(df, blocked, ["PRESS-kit"]).collect()}
    assert out == {"https://www.face.com/a": "domain", "https://face.net/a": "other_tld", "https://a.b.org/x": "domain",
                   "https://ok.com/": None, "https://face.com/press-kit": None, "https://ab.io/": None}
    lifted = crawl.with_block_reason(df, blocked, [], ["face.com"]).filter("url like '%face%'").collect()
    assert {r.block_reason for r in lifted} == {None}


def test_sitemaps(spark):
    urlset = '<?xml version="1.0"?><urlset xmlns="http://s"><url><loc> https://x.com/a </loc></url><url><loc>https://x.com/b.PNG</loc></url><url><loc>https://x.com/more.xml.gz</loc></url></urlset>'
    index = "<sitemapindex><sitemap><loc>https://x.com/s1.xml</loc></sitemap></sitemapindex>"
    files = spark.createDataFrame([("https://x.com/s1.xml", urlset), ("https://x.com/s.xml", index), ("bad", "<html></html>")], "url string, xml string")
    rows = {(r.url, r.loc): r.action for r in crawl.sitemap_actions(crawl.sitemap_locations(files, "xml")).collect()}
    assert rows == {
        ("https://x.com/s1.xml", "https://x.com/a"): "process", ("https://x.com/s1.xml", "https://x.com/b.PNG"): "drop",
        ("https://x.com/s1.xml", "https://x.com/more.xml.gz"): "recurse", ("https://x.com/s.xml", "https://x.com/s1.xml"): "recurse",
        ("bad", None): "error"}
    roots = spark.createDataFrame([("https://x.com/s.xml",)], "url string")
    assert [r.url for r in crawl.expand_sitemaps(files, roots).collect()] == ["https://x.com/a"]


def test_frontier(spark):
    pages = [("https://x.com/", "https://x.com/a"), ("https://x.com/", "https://x.com/private"), ("https://x.com/a", "https://www.x.com/a/"),
             ("https://x.com/a", "https://x.com/b"), ("http://x.com/b/index.html", "https://x.com/c"), ("https://x.com/c", "https://x.com/d")]
    links = spark.createDataFrame(pages, "page_url string, link string")
    seeds = spark.createDataFrame([("k", "https://x.com/", "https://x.com/")], "crawl_id string, url string, start_url string")
    rules = crawl.LinkRules(excludes=["private"])
    visited, denied = crawl.crawl_frontier(links, seeds, rules, max_levels=3)
    assert {(r.url, r.level) for r in visited.collect()} == {
        ("https://x.com/", 0), ("https://x.com/a", 1), ("https://x.com/b", 2), ("https://x.com/c", 3)}
    assert {(r.url, r.reason) for r in denied.collect()} == {("https://x.com/private", "EXCLUDE_PATTERN")}
    limited, _ = crawl.crawl_frontier(links, seeds, rules, max_levels=5, limit=2)
    assert limited.count() == 2


def test_site_map_prefers_titles_and_keeps_order(spark):
    cols = "url string, title string, description string, ord int"
    index = spark.createDataFrame([("https://x.com/a", None, None, 0), ("https://x.com/b", "B", None, 1)], cols)
    results = spark.createDataFrame([("https://x.com/a?utm=1", "A", "d", 0), ("https://y.com/", "Y", None, 1)], cols)
    empty = spark.createDataFrame([], cols)
    got = crawl.site_map(index, empty, results, F.lit("https://x.com/"), 10).collect()
    assert [(r.url, r.title) for r in got] == [("https://x.com/a", "A"), ("https://x.com/b", "B")]
    ranked = crawl.site_map(index, empty, results, F.lit("https://x.com/"), 10, search="b").collect()
    assert ranked[0].url == "https://x.com/b"


def test_public_suffix_table(spark):
    from staygrid.operators import domains
    rules = spark.createDataFrame([(r,) for r in ("com", "co.uk", "*.ck", "!www.ck", "a.b.c", "UK ", None, "")], "suffix string")
    hosts = ["x.com", "a.x.com", "com", "co.uk", "x.co.uk", "y.x.co.uk", "uk", "x.uk", "foo.ck", "x.foo.ck", "www.ck", "y.www.ck", "q.a.b.c", "a.b.c", "b.c", "z.zz", "one"]
    df = spark.createDataFrame([(h,) for h in [*hosts, None, "x.com"]], "h string")
    got = {r.host: r.domain for r in domains.registered_domains(df, "h", rules).collect()}
    assert got == {
        "x.com": "x.com", "a.x.com": "x.com", "com": None, "co.uk": None, "x.co.uk": "x.co.uk", "y.x.co.uk": "x.co.uk", "uk": None, "x.uk": "x.uk",
        "foo.ck": None, "x.foo.ck": "x.foo.ck", "www.ck": "www.ck", "y.www.ck": "www.ck", "q.a.b.c": "q.a.b.c", "a.b.c": None, "b.c": "b.c", "z.zz": "z.zz", "one": None}
    assert domains.with_registered_domain(df, "h", rules).count() == len(hosts) + 2
    links = spark.createDataFrame([("https://a.evil.a.b.c/x",), ("https://ok.com/",)], "url string")
    blocked = spark.createDataFrame([("evil.a.b.c",)], "blocked string")
    assert {r.url: r.block_reason for r in crawl.with_block_reason(links, blocked, [], suffixes=rules).collect()} == {
        "https://a.evil.a.b.c/x": "domain", "https://ok.com/": None}


def test_visited_pages_stay_in_their_buckets(spark):
    """A level shuffles its candidates once and never the pages seen so far; hosts and levels as in the crawl."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        visited = crawl.VisitedPages(spark, 4)
        seen = spark.createDataFrame([("c", f"u{i}", f"k{i}") for i in range(50)], "crawl_id string, url string, page_key string")
        for level in range(3):
            assert visited.append(visited.bucketed(seen.withColumn("page_key", F.concat("page_key", F.lit(f"-{level}")))), level).count() == 50
        new = visited.bucketed(spark.createDataFrame([("c", "x", "k1-2"), ("c", "y", "new"), ("d", "z", "k1-2")], "crawl_id string, url string, page_key string"))
        unseen = one_per_key(visited.unseen(new), list(visited.KEYS), F.col("url"))
        plan = unseen._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert {tuple(r) for r in unseen.select("crawl_id", "url").collect()} == {("c", "y"), ("d", "z")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_frontier_by_suffix_table(spark):
    """The suffix table decides what a subdomain is: a.co.zz and b.co.zz are two sites if co.zz is a suffix."""
    links = spark.createDataFrame([("https://a.co.zz/", "https://b.co.zz/p"), ("https://a.co.zz/", "https://s.a.co.zz/p")], "page_url string, link string")
    seeds = spark.createDataFrame([("c", "https://a.co.zz/", "https://a.co.zz/")], "crawl_id string, url string, start_url string")
    rules = crawl.LinkRules(allow_subdomains=True)
    for rows, want in ((["co.zz"], {"https://s.a.co.zz/p"}), (["zz"], {"https://s.a.co.zz/p", "https://b.co.zz/p"})):
        suffixes = spark.createDataFrame([(r,) for r in rows], "suffix string")
        visited, denied = crawl.crawl_frontier(links, seeds, rules, 2, suffixes=suffixes)
        assert {r.url for r in visited.collect()} == want | {"https://a.co.zz/"}
        assert denied.count() == 2 - len(want)
