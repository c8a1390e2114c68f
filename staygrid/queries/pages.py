"""URL expressions and jobs over the raw pages."""

from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..operators import dedup, domains
from ..plans import crawl, pages
from .registry import query

# SQL twins of the URL expressions, for URLs as they occur in the pages table.
ORIGIN = "regexp_extract({u}, '^https?://[^/?#]+')"
HOST = "regexp_extract({u}, '^https?://([^/?#]+)', 1)"
BARE = "regexp_replace(regexp_extract({u}, '^https?://([^/?#]+)', 1), '^www\\.', '')"
PATH = "CASE WHEN regexp_extract({u}, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^https?://[^/?#]+([^?#]*)', 1) END"
QUERY = "regexp_extract({u}, '^[^?#]*(\\?[^#]*)', 1)"
FRAG = "regexp_extract({u}, '(#.*)$', 1)"
DEPTH = "len(regexp_extract_all(regexp_replace(" + PATH + ", '/index\\.(php|html)$', ''), '[^/]+'))"
VISIBLE = "regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g')"


def sql(template: str, u: str = "url") -> str:
    return "(" + template.replace("{u}", u) + ")"


def decoded(x: str) -> str:
    """Entities as they occur in the pages, the closing ';' being optional."""
    for entity, mark in (("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&#x27;?", "''"), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{entity}', '{mark}', 'g')"
    return x


TITLE = decoded(f"regexp_extract({VISIBLE}, '(?s)<title>(.*?)</title>', 1)")
HEADING = decoded(f"regexp_extract({VISIBLE}, '(?s)<h1>(.*?)</h1>', 1)")
ARTICLE = decoded("regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(p|h1|br)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')")
INDEX_FORM = (f"('https://' || {sql(BARE)} || CASE WHEN rtrim_path = '' THEN '/' ELSE rtrim_path END || {sql(QUERY)})")
WITH_RTRIM = f"""(SELECT *, regexp_replace(regexp_replace({sql(PATH)}, '/index\\.(html|php|htm|shtml|xml)$', '/'), '/$', '') AS rtrim_path FROM pages)"""
EQUIV = (f"('http://' || CASE WHEN starts_with({sql(HOST)}, 'www.') THEN {sql(HOST)} ELSE 'www.' || {sql(HOST)} END || "
         f"CASE WHEN {sql(PATH)} LIKE '%/' THEN {sql(PATH)} || 'index.html' WHEN {sql(PATH)} LIKE '%/index.html' THEN {sql(PATH)} "
         f"WHEN {sql(PATH)} LIKE '%/index.php' THEN regexp_replace({sql(PATH)}, 'php$', 'html') ELSE {sql(PATH)} || '/index.html' END || {sql(QUERY)} || {sql(FRAG)})")


@query("U1_canonical_key", f"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''), '/$', '') AS canonical,
 {sql(BARE)} AS canonical_host FROM pages""")
def u1(t):
    u = F.col("url")
    return t.pages.select("page_id", urls.canonical_key(u).alias("canonical"), urls.canonical_host(u).alias("canonical_host"))


@query("U2_index_form", f"SELECT page_id, {INDEX_FORM} AS index_url, sha256({INDEX_FORM}) AS url_hash FROM {WITH_RTRIM}")
def u2(t):
    form = urls.index_form(F.col("url"))
    return t.pages.select("page_id", form.alias("index_url"), urls.url_hash(form).alias("url_hash"))


@query("U3_map_form", "SELECT page_id, trim(string_split(regexp_replace(url, '/$', ''), '?')[1]) AS map_url FROM pages")
def u3(t):
    return t.pages.select("page_id", urls.map_form(F.col("url")).alias("map_url"))


PREFIX_SQL = f"""(SELECT page_id, unnest(list_distinct([
 'https://' || {sql(BARE)} || '/', 'https://' || {sql(BARE)} || '/' || string_split({sql(PATH)}, '/')[2],
 'https://' || {sql(BARE)} || rtrim_path, {INDEX_FORM}])) AS prefix FROM {WITH_RTRIM})"""


@query("U4_path_prefixes", f"SELECT page_id, prefix FROM {PREFIX_SQL}")
def u4(t):
    return t.pages.select("page_id", F.explode(urls.path_prefixes(F.col("url"))).alias("prefix"))


@query("U5_domain_splits", f"""
SELECT page_id, unnest(CASE WHEN h LIKE 'www.%' AND len(p) = 3 THEN [d] WHEN len(p) = 2 THEN [d]
 WHEN len(p) = 3 THEN [d, h] ELSE [d, array_to_string(p[2:], '.'), h] END) AS domain FROM (
 SELECT page_id, {sql(HOST)} AS h, string_split({sql(HOST)}, '.') AS p, array_to_string(string_split({sql(HOST)}, '.')[-2:], '.') AS d FROM pages)""")
def u5(t):
    return t.pages.select("page_id", F.explode(urls.domain_splits(urls.host(F.col("url")))).alias("domain"))


@query("U6_suffix_table", f"""
WITH h AS (SELECT DISTINCT {sql(HOST)} AS host, string_split({sql(HOST)}, '.') AS p FROM pages),
s AS (SELECT DISTINCT array_to_string(p[-2:], '.') AS rule FROM (SELECT string_split({sql(HOST)}, '.') AS p FROM pages WHERE page_id % 2 = 0)
 UNION SELECT array_to_string(p[-3:], '.') FROM (SELECT string_split({sql(HOST)}, '.') AS p FROM pages WHERE page_id % 7 = 0)),
m AS (SELECT host, max(len(string_split(rule, '.'))) AS size FROM h JOIN s ON host = rule OR ends_with(host, '.' || rule) GROUP BY host)
SELECT host, array_to_string(p[-coalesce(size, 1):], '.') AS suffix, CASE WHEN len(p) > coalesce(size, 1) THEN array_to_string(p[-(coalesce(size, 1) + 1):], '.') END AS domain
FROM h LEFT JOIN m USING (host)""")
def u6_table(t):
    hosts = t.pages.select("page_id", urls.host(F.col("url")).alias("host"))
    tail = lambda k: F.array_join(F.slice(F.split("host", r"\."), F.greatest(F.size(F.split("host", r"\.")) - (k - 1), F.lit(1)), F.lit(k)), ".").alias("suffix")
    # Two- and three-label suffixes, taken from the pages themselves.
    table = hosts.filter(F.pmod("page_id", F.lit(2)) == 0).select(tail(2)).unionByName(hosts.filter(F.pmod("page_id", F.lit(7)) == 0).select(tail(3)))
    return domains.registered_domains(hosts, "host", table)


def _suffix_table(t):
    """Two- and three-label suffixes, taken from the hosts of the pages themselves."""
    labels = F.split(urls.host(F.col("url")), r"\.")
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (k - 1), F.lit(1)), F.lit(k)), ".").alias("suffix")
    return t.pages.filter(F.pmod("page_id", F.lit(2)) == 0).select(tail(2)).unionByName(t.pages.filter(F.pmod("page_id", F.lit(7)) == 0).select(tail(3)))


def _domain_sql(hosts):
    """CTEs giving the registered domain d (NULL for a bare suffix) of each host in ``hosts`` by that table."""
    return f"""h AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM ({hosts})),
s AS (SELECT DISTINCT array_to_string(string_split({sql(HOST)}, '.')[-2:], '.') AS rule FROM pages WHERE page_id % 2 = 0
 UNION SELECT array_to_string(string_split({sql(HOST)}, '.')[-3:], '.') FROM pages WHERE page_id % 7 = 0),
m AS (SELECT host, max(len(string_split(rule, '.'))) AS size FROM h JOIN s ON host = rule OR ends_with(host, '.' || rule) GROUP BY host),
r AS (SELECT host, p, len(p) - coalesce(size, 1) AS subs, CASE WHEN len(p) > coalesce(size, 1) THEN array_to_string(p[-(coalesce(size, 1) + 1):], '.') END AS d
 FROM h LEFT JOIN m USING (host))"""


# Hosts get up to three labels in front, by the page's id.
DEEP_HOST_SQL = f"SELECT page_id, ['', 'www.', 'a.b.', 'x.y.z.'][page_id % 4 + 1] || {sql(HOST)} AS host FROM pages"


def _deep_host():
    front = F.element_at(F.array(*map(F.lit, ("", "www.", "a.b.", "x.y.z."))), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    return F.concat(front, urls.host(F.col("url"))).alias("host")


@query("U5_suffix_table", f"""
WITH g AS ({DEEP_HOST_SQL}), {_domain_sql("SELECT host FROM g")}
SELECT page_id, unnest(CASE WHEN d IS NULL THEN [] WHEN subs = 2 AND p[1] = 'www' THEN [d]
 ELSE list_transform(range(1, subs + 1), lambda k: array_to_string(p[k:], '.')) END) AS domain FROM g JOIN r USING (host)""")
def u5_table(t):
    hosts = t.pages.select("page_id", _deep_host())
    return domains.with_domain_splits(hosts, "host", _suffix_table(t)).select("page_id", F.explode("domains").alias("domain"))


@query("U6_base_domain", f"""
SELECT page_id, {sql(BARE)} = array_to_string(string_split({sql(HOST)}, '.')[-2:], '.') AND {sql(PATH)} = '/' AS is_base,
 array_to_string(string_split({sql(HOST)}, '.')[-2:], '.') AS base_domain FROM pages""")
def u6(t):
    return t.pages.select("page_id", urls.is_base_domain(F.col("url")).alias("is_base"),
                          urls.registered_domain(urls.host(F.col("url"))).alias("base_domain"))


@query("U7_hotel_id_and_search_url", """
SELECT p_partkey, replace(p_name, ' ', '-') || '-' || p_partkey AS hotel_id,
 'https://travel.example/search?ss=' || replace(url_encode(p_name), '%20', '+') || '&checkin=2026-07-06&n=' || p_size AS search_url FROM part""")
def u7(t):
    page = F.concat(F.lit("https://travel.example/hotel/vn/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), "p_partkey", F.lit(".vi.html?aid=1"))
    search = urls.search_url(F.lit("https://travel.example/search"), {
        "ss": F.col("p_name"), "checkin": F.lit("2026-07-06"), "n": F.col("p_size").cast("string")})
    return t.part.select("p_partkey", urls.hotel_id(page).alias("hotel_id"), search.alias("search_url"))


@query("F8_url_predicates", f"""
SELECT page_id, {sql(DEPTH)} AS depth, regexp_extract({sql(PATH)}, '(\\.[^.]*)$', 1) = '.js' AS is_file,
 contains(url, '#') AND NOT contains(string_split(url, '#')[2], '/') AS is_section, false AS non_web, false AS social,
 {sql(PATH)} = '/' AS is_root FROM pages""")
def f8(t):
    u = F.col("url")
    return t.pages.select(
        "page_id", urls.depth(urls.path(u)).alias("depth"), urls.is_file(urls.path(u)).alias("is_file"),
        urls.is_section_link(u).alias("is_section"), urls.has_non_web_scheme(u).alias("non_web"),
        urls.is_social(u).alias("social"), urls.is_root_page(u).alias("is_root"))


@query("F9_adjusted_depth", f"SELECT page_id, 3 + {sql(DEPTH)} AS max_depth FROM pages")
def f9(t):
    return t.pages.select("page_id", urls.adjusted_max_depth(F.col("url"), 3).alias("max_depth"))


SITE = "https://blog.tionsh.example.net"


@query("F12_same_domain", f"""
SELECT page_id, {sql(BARE)} LIKE '%.example.net' OR {sql(BARE)} = 'example.net' AS same_domain,
 {sql(BARE)} = 'blog.tionsh.example.net' AS same_subdomain FROM pages""")
def f12(t):
    u, site = F.col("url"), F.lit(SITE)
    return t.pages.select("page_id", urls.same_domain(u, site).alias("same_domain"), urls.same_subdomain(u, site).alias("same_subdomain"))


@query("F13_path_prefix", f"SELECT page_id FROM pages WHERE starts_with({sql(PATH)}, '/en/')")
def f13(t):
    return t.pages.filter(urls.path(F.col("url")).startswith("/en/")).select("page_id")


# --------------------------------------------------------------- extraction

HREFS_SQL = f"""(SELECT DISTINCT page_id, url, {sql(ORIGIN)} || replace(replace(url_encode(h), '%2F', '/'), '%2C', ',') AS link
 FROM (SELECT page_id, url, unnest(regexp_extract_all({VISIBLE}, '<a href="([^"]*)"', 1)) AS h FROM pages))"""


@query("P1_page_links", f"SELECT page_id, link FROM {HREFS_SQL}")
def p1(t):
    return pages.page_links(t.pages, ["page_id"]).select("page_id", "link")


@query("P2_page_metadata", f"""
SELECT page_id, {TITLE} AS title,
 regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, 'Page ' || page_id AS og_title,
 'first ' || page_id || ', second' AS description, '["a","b"]' AS keywords FROM pages""")
def p2(t):
    extra = F.concat(
        F.lit('</title><meta property="og:title" content="Page '), "page_id", F.lit('"><meta name=description content="first '),
        "page_id", F.lit("\"><meta content='second' name='description'><meta name=keywords content=a><meta name=keywords content=b>"))
    rich = t.pages.select("page_id", F.replace("html", F.lit("</title>"), extra).alias("html"))
    m = F.col("metadata")
    return pages.page_metadata(rich, ["page_id"]).select(
        "page_id", m["title"].alias("title"), m["language"].alias("language"), m["ogTitle"].alias("og_title"),
        m["description"].alias("description"), m["keywords"].alias("keywords"))


@query("P3_clean_html", f"""
SELECT page_id, CAST(len(regexp_extract_all({VISIBLE}, '<p>', 0)) AS INTEGER) AS paragraphs, CAST(len(regexp_extract_all({VISIBLE}, '<br>', 0)) AS INTEGER) AS breaks,
 0 AS hidden_or_outside FROM pages""")
def p3(t):
    out = pages.clean_pages(t.pages, "page_id", ["html"], exclude=["h1"])
    n = lambda p: F.regexp_count("html", F.lit(p))
    return out.select("page_id", n("<p>").alias("paragraphs"), n("<br>").alias("breaks"),
                      n(r"<(head|meta|title|style|script|nav|footer|h1)\b|class=.ad.|<!--").alias("hidden_or_outside"))


@query("P4_page_markdown", f"""
SELECT page_id, sha256(trim(regexp_replace(regexp_replace({ARTICLE}, '[*#\\\\]', '', 'g'), '\\s+', ' ', 'g'))) AS words_hash FROM pages""")
def p4(t):
    out = pages.clean_pages(t.pages, "page_id", ["markdown"])
    words = F.trim(F.regexp_replace(F.regexp_replace("markdown", r"[*#\\]", ""), r"\s+", " "))
    return out.select("page_id", F.sha2(words, 256).alias("words_hash"))


@query("P4_page_headings", f"""
SELECT page_id, '# ' || trim(regexp_replace({HEADING}, '\\s+', ' ', 'g')) AS heading FROM pages""")
def p4h(t):
    out = pages.clean_pages(t.pages, "page_id", ["markdown"])
    return out.select("page_id", F.regexp_extract("markdown", r"(?m)^(# .*)$", 1).alias("heading"))


@query("P5_page_images", f"""
SELECT DISTINCT page_id, image FROM (SELECT page_id, unnest([
 o || '/i/' || page_id || '.png', o || '/lazy.png', o || '/a%20b.png', 'https://cdn.example.com/c.png', o || '/bg.png',
 'data:image/png;base64,AA', o || '/og.jpg', o || '/favicon.ico']) AS image FROM (SELECT page_id, {sql(ORIGIN)} AS o FROM pages))""")
def p5(t):
    block = F.concat(
        F.lit('<article><meta property="og:image" content="/og.jpg"><link rel="shortcut icon" href=/favicon.ico><img src="/i/'), "page_id",
        F.lit(""".png" data-src='/lazy.png' srcset="/i/"""), "page_id",
        F.lit(""".png 1x, https://cdn.example.com/c.png 2x"><img src="/a b.png"><img src="data:image/png;base64,AA">"""
              """<img src="javascript:x()"><div style="background: url('/bg.png')"></div>"""))
    rich = t.pages.select("page_id", "url", F.replace("html", F.lit("<article>"), block).alias("html"))
    return pages.page_images(rich, ["page_id"])


@query("P7_sub_scores", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE (doc_id % 100) / 10.0 END AS staff_score,
 CAST(doc_id % 10 AS DOUBLE) AS free_wifi_score FROM documents""")
def p7(t):
    # Review labels are added to each text; the whole text is searched.
    staff = F.when(F.pmod("doc_id", F.lit(3)) != 0, F.concat(
        F.lit(" nhân viên phục vụ "), F.replace(F.format_string("%.1f", F.pmod("doc_id", F.lit(100)) / 10), F.lit("."), F.lit(",")))).otherwise("")
    body = F.concat("text", staff, F.lit(" WiFi miễn phí "), F.pmod("doc_id", F.lit(10)))
    docs = t.documents.select("doc_id", body.alias("body"))
    score = lambda n: text.sub_score(F.col("body"), text.SUB_SCORE_LABELS[n]).alias(n)
    return docs.select("doc_id", score("staff_score"), score("free_wifi_score"))


@query("P6_rule_extraction", f"""
SELECT page_id, {TITLE} AS name,
 regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all({VISIBLE}, '<p>', 0)) AS n_paragraphs,
 'none' AS score FROM pages""")
def p6(t):
    from ..plans.extraction import FieldRule, extract_fields
    rules = [
        FieldRule("name", r"(?is)<title[^>]*>(.*?)</title>", decode=True),
        FieldRule("lang", r"""(?is)<html[^>]*\slang="([^"]*)\""""),
        FieldRule("n_paragraphs", r"(?i)<p>", cast="int", count=True),
        FieldRule("score", r"Điểm\s*(\d+)", default="none"),
    ]
    return extract_fields(t.pages, ["page_id"], rules)


@query("F19_attribute_values", f"""
SELECT page_id, count(*) AS n, max(h) AS last_href FROM (SELECT page_id, unnest(regexp_extract_all({VISIBLE}, '<a href="([^"]*)"', 1)) AS h FROM pages) GROUP BY 1""")
def f19(t):
    rows = pages.page_attributes(t.pages, ["page_id"], "a", "href")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("last_href"))


# -------------------------------------------------------------- link rules

RULES = crawl.LinkRules(max_depth=2, excludes=["7"], includes=["^/en", "^/t"], allow_backward=False)


def _links_and_pages(t):
    found = pages.page_links(t.pages, ["page_id"]).select("link")
    return found.unionByName(t.pages.select(F.col("url").alias("link"))).distinct()


ALL_LINKS_SQL = f"(SELECT link FROM {HREFS_SQL} UNION SELECT url FROM pages)"
L_PATH, L_DEPTH, L_BARE = sql(PATH, "link"), sql(DEPTH, "link"), sql(BARE, "link")
IS_SECTION = "(contains(link, '#') AND NOT contains(string_split(link, '#')[2], '/'))"


@query("F6_link_denials", f"""
SELECT link, CASE WHEN {L_DEPTH} > 2 THEN 'DEPTH_LIMIT'
 WHEN regexp_extract({L_PATH}, '(\\.[^.]*)$', 1) = '.js' THEN 'FILE_TYPE'
 WHEN {L_BARE} = 'blog.tionsh.example.net' THEN CASE WHEN {IS_SECTION} THEN 'SECTION_LINK'
  WHEN NOT starts_with({L_PATH}, '/e') THEN 'BACKWARD_CRAWLING' WHEN contains({L_PATH}, '7') THEN 'EXCLUDE_PATTERN'
  WHEN NOT regexp_matches({L_PATH}, '^/en') AND NOT regexp_matches({L_PATH}, '^/t') THEN 'INCLUDE_PATTERN' END
 WHEN contains(link, '7') THEN 'EXCLUDE_PATTERN' ELSE 'EXTERNAL_LINK' END AS denial_reason FROM {ALL_LINKS_SQL}""")
def f6(t):
    reason = crawl.denial_reason(F.col("link"), F.lit(SITE), F.lit(SITE + "/e"), RULES)
    return _links_and_pages(t).select("link", reason.alias("denial_reason"))


@query("F7_url_denials", f"""
SELECT link, CASE WHEN {L_BARE} = 'blog.tionsh.example.net' THEN CASE WHEN {IS_SECTION} THEN 'SECTION_LINK'
  WHEN contains({L_PATH}, '7') THEN 'EXCLUDE_PATTERN' END
 WHEN contains(link, '7') THEN 'EXCLUDE_PATTERN'
 WHEN array_to_string(string_split({L_BARE}, '.')[-2:], '.') = 'example.net' THEN NULL ELSE 'EXTERNAL_LINK' END AS denial_reason FROM {ALL_LINKS_SQL}""")
def f7(t):
    rules = crawl.LinkRules(excludes=["7"], allow_subdomains=True)
    reason = crawl.denial_reason(F.col("link"), F.lit(SITE), F.lit(SITE), rules, listing=False)
    return _links_and_pages(t).select("link", reason.alias("denial_reason"))


DEEP_LINKS_SQL = f"""SELECT page_id, host AS link_host, lead(host) OVER (ORDER BY page_id) AS base_host FROM ({DEEP_HOST_SQL}) QUALIFY base_host IS NOT NULL"""


@query("F7_suffix_table", f"""
WITH g AS ({DEEP_LINKS_SQL}), {_domain_sql("SELECT link_host AS host FROM g UNION ALL SELECT base_host FROM g")}
SELECT page_id, CASE WHEN regexp_replace(link_host, '^(www\\.)+', '') = regexp_replace(base_host, '^(www\\.)+', '') THEN NULL
 WHEN a.d = b.d THEN NULL ELSE 'EXTERNAL_LINK' END AS denial_reason
FROM g JOIN r a ON a.host = link_host JOIN r b ON b.host = base_host""")
def f7_table(t):
    # Every page's host, with more labels in front, as a link from the next page's host.
    hosts = t.pages.select("page_id", _deep_host())
    following = t.pages.select((F.col("page_id") - 1).alias("page_id"), _deep_host()).withColumnRenamed("host", "base_host")
    site = lambda c: F.concat(F.lit("https://"), F.col(c), F.lit("/p"))
    links = hosts.join(following, "page_id").select("page_id", site("host").alias("link"), site("base_host").alias("base"))
    judged = crawl.with_same_domain(links, F.col("link"), F.col("base"), _suffix_table(t))
    rules = crawl.LinkRules(allow_subdomains=True)
    return judged.select("page_id", crawl.denial_reason(F.col("link"), F.col("base"), F.col("base"), rules, listing=False, same_domain=F.col("same_domain")).alias("denial_reason"))


@query("F10_robots_filter", f"""
SELECT page_id, CASE WHEN regexp_matches(p || q, '^/.*\\.html$') THEN false WHEN starts_with(p, '/en/1') THEN true WHEN starts_with(p || '/', '/en/') AND contains(h, '.com') THEN false
 WHEN starts_with(p, '/fr/') THEN false ELSE true END AS robots_allowed
FROM (SELECT page_id, {sql(PATH)} AS p, {sql(QUERY)} AS q, {sql(HOST)} AS h FROM pages)""")
def f10(t):
    # One robots file per stored host; .com hosts also close /en/ except /en/1...
    hosts = t.pages.select(urls.host(F.col("url")).alias("host")).distinct()
    closed = F.when(F.col("host").endswith(".com"), F.lit("Disallow: /en/\n")).otherwise("")
    files = hosts.withColumn("robots_txt", F.concat(
        F.lit("# house rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: stay\nDisallow: /fr/\nDisallow: /*.html$\nAllow: /en/1\n"),
        closed, F.lit("Disallow:\n")))
    links = t.pages.select("page_id", F.col("url").alias("link"))
    # /en/1*.html: the longer rule "/*.html$" (8) beats "/en/1" (5) for .html pages.
    out = crawl.with_robots(links, crawl.robots_rules(files), ["stay"])
    return out.select("page_id", "robots_allowed")


@query("F11_blocklist", f"""
WITH d AS (SELECT page_id, url, array_to_string(string_split({sql(HOST)}, '.')[-3:], '.') AS domain FROM pages),
b AS (SELECT DISTINCT domain AS blocked FROM d WHERE page_id % 10 = 0 AND domain <> 'tionsh.example.net')
SELECT page_id, CASE WHEN len(string_split(domain, '.')) < 3 OR regexp_matches(url, '(?i)de') OR regexp_matches(url, '(?i)PAGE=2') THEN NULL
 WHEN domain IN (SELECT blocked FROM b) THEN 'domain'
 WHEN length(string_split(domain, '.')[1]) > 2 AND string_split(domain, '.')[1] IN (SELECT string_split(blocked, '.')[1] FROM b) THEN 'other_tld' END AS block_reason FROM d""")
def f11(t):
    suffixes = ["example.com", "example.net", "example.org"]
    domain = urls.registered_domain(urls.host(F.col("url")), suffixes)
    listed = t.pages.filter(F.pmod("page_id", F.lit(10)) == 0).select(domain.alias("blocked")).filter(F.col("blocked").isNotNull())
    out = crawl.with_block_reason(t.pages.select("page_id", "url"), listed, ["/DE/i", "regex:PAGE=2"], ["tionsh.example.net"], suffixes=suffixes)
    return out.select("page_id", "block_reason")


@query("C22_site_category", f"""
SELECT page_id, CASE WHEN {sql(PATH)} LIKE '%.pdf' THEN 'pdf' WHEN {sql(HOST)} LIKE '%.tionsh.example.net' OR {sql(HOST)} = 'tionsh.example.net' THEN 'research'
 WHEN {sql(HOST)} LIKE '%.example.org' THEN 'org' END AS category FROM pages""")
def c22(t):
    sites = {"__pdf__": "pdf", "tionsh.example.net": "research", "example.org": "org"}
    return t.pages.select("page_id", urls.site_category(F.col("url"), sites).alias("category"))


# ------------------------------------------------------------- url de-dup

@query("D3_largest_copy", f"""
SELECT title AS page_key, arg_min(url, (-length(html), url)) AS kept, max(length(html)) AS kept_size, count(*) - 1 AS dropped FROM (
 SELECT url, html, regexp_extract({VISIBLE}, '(?s)<title>(.*?)</title>', 1) AS title FROM pages) GROUP BY 1""")
def d3(t):
    def key(visible):
        canonical = html.first_attr(visible, "link", "href", lambda a: F.coalesce(html.attr(a, "rel") == "canonical", F.lit(False)))
        return F.coalesce(F.substring_index(canonical, "?", 1), html.title(visible))

    return dedup.largest_copy(t.pages, urls.let(html.visible(F.col("html")), key), F.length("html"), "url")


@query("D4_url_union", f"SELECT link FROM {ALL_LINKS_SQL}")
def d4(t):
    found = pages.page_links(t.pages, ["page_id"])
    return dedup.url_union([found, t.pages.select(F.col("url").alias("link"))], "link")


VARIANTS_SQL = """(SELECT page_id * 3 AS ord, url FROM pages UNION ALL SELECT page_id * 3 + 1, regexp_replace(url, '^https?://(www\\.)?', 'http://www.') FROM pages
 UNION ALL SELECT page_id * 3 + 2, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://', 'https://') ELSE url || '/' END FROM pages)"""


def _variants(t):
    """Every page URL in several spellings."""
    p = t.pages
    return (p.select((F.col("page_id") * 3).alias("ord"), "url")
            .unionByName(p.select((F.col("page_id") * 3 + 1).alias("ord"), F.regexp_replace("url", r"^https?://(www\.)?", "http://www.").alias("url")))
            .unionByName(p.select((F.col("page_id") * 3 + 2).alias("ord"), F.when(
                F.pmod("page_id", F.lit(2)) == 0, F.regexp_replace("url", "^https?://", "https://")).otherwise(F.concat("url", F.lit("/"))).alias("url"))))


@query("D5_unique_urls", f"""
SELECT arg_min(url, (NOT starts_with(url, 'https:'), starts_with({sql(HOST)}, 'www.'), ord)) AS url FROM {VARIANTS_SQL}
GROUP BY {sql(BARE)} || {sql(PATH)} || {sql(QUERY)} || {sql(FRAG)}""")
def d5(t):
    return dedup.unique_urls(_variants(t), "url", "ord")


@query("D6_titled_first", """
SELECT url, arg_min(title, (title IS NULL, ord)) AS title, arg_min(ord, (title IS NULL, ord)) AS ord FROM (
 SELECT page_id AS ord, string_split(string_split(url, '?')[1], '#')[1] AS url, CASE WHEN page_id % 3 = 0 THEN 'T' || page_id END AS title FROM pages
 UNION ALL SELECT page_id + 100000, string_split(string_split(url, '?')[1], '#')[1], CASE WHEN page_id % 2 = 0 THEN 'U' || page_id END FROM pages) GROUP BY 1""")
def d6(t):
    short = F.regexp_replace("url", "[?#].*$", "").alias("url")
    k = F.col("page_id")
    docs = t.pages.select(k.alias("ord"), short, F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("T"), k)).alias("title")).unionByName(
        t.pages.select((k + 100000).alias("ord"), short, F.when(F.pmod(k, F.lit(2)) == 0, F.concat(F.lit("U"), k)).alias("title")))
    return dedup.titled_first(docs, "url", "title", "ord").select("url", "title", "ord")


@query("D7_equivalent_urls", f"""
SELECT {EQUIV} AS canonical, arg_min(url, ord) AS first_url, count(*) AS members FROM {VARIANTS_SQL} GROUP BY 1""")
def d7(t):
    return dedup.equivalent_urls(_variants(t), "url", "ord")


@query("D8_unvisited", f"""
SELECT arg_min(url, (ord, url)) AS url FROM {VARIANTS_SQL} WHERE regexp_replace(url, '[?#].*$', '') NOT IN (
 SELECT regexp_replace(url, '[?#].*$', '') FROM pages WHERE page_id % 2 = 1) GROUP BY regexp_replace(url, '[?#].*$', '')""")
def d8(t):
    visited = t.pages.filter(F.pmod("page_id", F.lit(2)) == 1).select("url")
    return dedup.unvisited(_variants(t), visited, "url", drop_query=True, order="ord").select("url")


# -------------------------------------------------------------- page index

@query("J13_pages_below_prefix", f"""
SELECT prefix, count(*) AS n_pages, max(page_id) AS newest FROM {PREFIX_SQL} WHERE page_id >= 20
 AND prefix IN (SELECT 'https://' || {sql(BARE)} || '/' || string_split({sql(PATH)}, '/')[2] FROM pages) GROUP BY 1""")
def j13(t):
    # Section prefixes asked for: https://host/<lang>.
    asked = t.pages.select(urls.url_hash(F.element_at(urls.path_prefixes(F.col("url")), 2)).alias("prefix_hash")).distinct()
    stored = t.pages.filter(F.col("page_id") >= 20).select("page_id", F.explode(urls.path_prefixes(F.col("url"))).alias("prefix"))
    stored = stored.withColumn("prefix_hash", urls.url_hash(F.col("prefix")))
    hit = stored.join(asked, "prefix_hash", "left_semi")
    return hit.groupBy("prefix").agg(F.count(F.lit(1)).alias("n_pages"), F.max("page_id").alias("newest"))


@query("J16_links_to_known_pages", f"""
SELECT {sql(HOST)} AS host, count(*) AS n_links, count(*) FILTER (WHERE link IN (SELECT url FROM pages)) AS n_known
FROM {HREFS_SQL} GROUP BY 1""")
def j16(t):
    # Counted per (host, link) before the join: a link on every page is one row.
    edges = pages.page_links(t.pages, ["page_id"]).groupBy(urls.host(F.col("url")).alias("host"), "link").agg(F.count(F.lit(1)).alias("n"))
    known = t.pages.select(F.col("url").alias("link"), F.lit(True).alias("known")).distinct()
    return edges.join(known, "link", "left").groupBy("host").agg(
        F.sum("n").alias("n_links"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("n_known"))


@query("G1_crawl_frontier", f"""
WITH seeds AS (SELECT {sql(HOST)} AS crawl_id, {EQUIV} AS k, min(url) AS url FROM pages GROUP BY 1, 2),
l AS (SELECT DISTINCT {sql(HOST, 'url')} AS crawl_id, link FROM {HREFS_SQL}),
ok AS (SELECT crawl_id, link AS url FROM l WHERE NOT ({sql(DEPTH, 'link')} > 3) AND NOT starts_with({sql(PATH, 'link')}, '/the')),
found AS (SELECT crawl_id, {EQUIV} AS k, min(url) AS url FROM ok GROUP BY 1, 2)
SELECT crawl_id, url, 0 AS level FROM seeds UNION ALL
SELECT crawl_id, url, 1 AS level FROM found WHERE (crawl_id, k) NOT IN (SELECT crawl_id, k FROM seeds)""")
def g1(t):
    links = pages.page_links(t.pages, ["page_id"]).select(F.col("url").alias("page_url"), "link")
    u = F.col("url")
    seeds = t.pages.select(urls.host(u).alias("crawl_id"), "url",
                           F.concat(urls.scheme(u), F.lit("://"), urls.host(u), F.lit("/")).alias("start_url"))
    rules = crawl.LinkRules(max_depth=3, excludes=["^/the"])
    visited, _ = crawl.crawl_frontier(links, seeds, rules, max_levels=3)
    return visited


def _levels_sql(levels: int, limit: int | None) -> str:
    """The frontier from one seed per host, level by level."""
    parts = [f"""l AS (SELECT DISTINCT {EQUIV} AS f, link FROM {HREFS_SQL}),
n0 AS (SELECT {sql(HOST)} AS crawl_id, min(url) AS url FROM pages GROUP BY 1),
v0 AS (SELECT crawl_id, {EQUIV} AS k, url, 0 AS level FROM n0)"""]
    for i in range(1, levels + 1):
        cut = "" if limit is None else f" QUALIFY row_number() OVER (PARTITION BY crawl_id ORDER BY url) <= {limit} - (SELECT count(*) FROM v{i - 1} v WHERE v.crawl_id = w{i}.crawl_id)"
        parts.append(f"""e{i} AS (SELECT DISTINCT crawl_id, link AS url FROM v{i - 1} JOIN l ON f = k WHERE level = {i - 1}),
f{i} AS (SELECT crawl_id, {EQUIV} AS k, min(url) AS url FROM e{i} WHERE NOT ({sql(DEPTH, 'url')} > 3) AND NOT starts_with({sql(PATH, 'url')}, '/the') GROUP BY 1, 2),
w{i} AS (SELECT * FROM f{i} WHERE (crawl_id, k) NOT IN (SELECT (crawl_id, k) FROM v{i - 1})),
v{i} AS (SELECT * FROM v{i - 1} UNION ALL SELECT * FROM (SELECT crawl_id, k, url, {i} AS level FROM w{i}{cut}))""")
    return "WITH " + ",\n".join(parts) + f"\nSELECT crawl_id, url, level FROM v{levels}"


def _frontier(t, levels: int, limit: int | None):
    links = pages.page_links(t.pages, ["page_id"]).select(F.col("url").alias("page_url"), "link")
    u = F.col("url")
    seeds = t.pages.groupBy(urls.host(u).alias("crawl_id")).agg(F.min("url").alias("url")).select(
        "crawl_id", "url", F.concat(urls.scheme(u), F.lit("://"), urls.host(u), F.lit("/")).alias("start_url"))
    return crawl.crawl_frontier(links, seeds, crawl.LinkRules(max_depth=3, excludes=["^/the"]), max_levels=levels, limit=limit)[0]


@query("G1_three_levels", _levels_sql(3, None))
def g1_levels(t):
    return _frontier(t, 3, None)


# Every page starts a crawl; page i links to pages 3i+1, 3i+2 and 3i+3.  A crawl does not follow sections of its own host.
FOUR_LEVELS_SQL = ",\n".join([f"""WITH p AS (SELECT page_id, url, {EQUIV} AS k, {sql(BARE)} AS host, contains(url, '#') AND NOT (length(split_part(url, '#', 2)) > 1
  AND contains(split_part(url, '#', 2), '/')) AS section FROM pages),
l AS (SELECT DISTINCT a.k AS f, b.k, b.url, b.host, b.section FROM p a JOIN p b ON (b.page_id - 1) // 3 = a.page_id AND b.page_id > 0),
v0 AS (SELECT page_id AS crawl_id, k, url, 0 AS level FROM p)"""] + [f"""
v{i} AS (SELECT * FROM v{i - 1} UNION ALL SELECT crawl_id, k, min(url), {i} FROM (SELECT crawl_id, l.k, l.url FROM v{i - 1} v JOIN l ON f = v.k JOIN p ON p.page_id = crawl_id WHERE level = {i - 1} AND NOT (l.section AND l.host = p.host))
 WHERE (crawl_id, k) NOT IN (SELECT (crawl_id, k) FROM v{i - 1}) GROUP BY 1, 2)""" for i in range(1, 5)]) + "\nSELECT crawl_id, url, level FROM v4"


@query("G1_four_levels", FOUR_LEVELS_SQL)
def g1_four(t):
    u = F.col("url")
    child = t.pages.filter(F.col("page_id") > 0).select(F.floor((F.col("page_id") - 1) / 3).alias("page_id"), u.alias("link"))
    links = t.pages.select("page_id", u.alias("page_url")).join(child, "page_id").select("page_url", "link")
    seeds = t.pages.select(F.col("page_id").alias("crawl_id"), "url", F.concat(urls.scheme(u), F.lit("://"), urls.host(u), F.lit("/")).alias("start_url"))
    rules = crawl.LinkRules(allow_external=True, allow_backward=True)
    return crawl.crawl_frontier(links, seeds, rules, max_levels=4)[0]


@query("G1_limit", _levels_sql(3, 5))
def g1_limit(t):
    return _frontier(t, 3, 5)


@query("D8_limit", f"""
WITH c AS (SELECT {sql(BARE)} AS host, url, ord, regexp_replace(url, '[?#].*$', '') AS k FROM {VARIANTS_SQL}),
v AS (SELECT DISTINCT {sql(BARE)} AS host, regexp_replace(url, '[?#].*$', '') AS k FROM pages WHERE page_id % 9 = 1),
n AS (SELECT host, k, arg_min(url, (ord, url)) AS url, min(ord) AS ord FROM c WHERE (host, k) NOT IN (SELECT (host, k) FROM v) GROUP BY 1, 2)
SELECT host, url FROM n QUALIFY row_number() OVER (PARTITION BY host ORDER BY ord, url) <= 20 - (SELECT count(*) FROM v WHERE v.host = n.host)""")
def d8_limit(t):
    host = urls.bare_host(F.col("url")).alias("host")
    visited = t.pages.filter(F.pmod("page_id", F.lit(9)) == 1).select(host, "url")
    return dedup.unvisited(_variants(t).withColumn("host", host), visited, "url", drop_query=True, limit=20, order="ord", crawl="host").select("host", "url")


def _sitemap_files(t):
    """Stored sitemaps: part files of at most 1000 URLs per host, one index file per host."""
    u = F.col("url")
    host = urls.host(u)
    part = F.concat(F.lit("https://"), host, F.lit("/sitemap-"), F.floor(F.col("page_id") / 1000), F.lit(".xml"))
    rows = t.pages.select(host.alias("host"), part.alias("part"), F.replace(u, F.lit("&"), F.lit("&amp;")).alias("loc"))
    loc = F.concat(F.lit("<url><loc>"), "loc", F.lit("</loc></url>"))
    parts = rows.groupBy("host", "part").agg(F.concat(
        F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
        F.array_join(F.sort_array(F.collect_list(loc)), ""),
        F.lit("<url><loc>https://x.example/logo.png</loc></url></urlset>")).alias("xml"))
    index = parts.groupBy("host").agg(F.concat(
        F.lit("<sitemapindex>"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<sitemap><loc> "), "part", F.lit(" </loc></sitemap>")))), ""),
        F.lit("</sitemapindex>")).alias("xml"))
    roots = index.select(F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("url"), "xml")
    return roots.unionByName(parts.select(F.col("part").alias("url"), "xml")), roots


@query("S13_sitemap_locations", f"""
SELECT kind, count(*) AS n, count(DISTINCT loc) AS n_locs FROM (
 SELECT 'url' AS kind, replace(url, '&', '&amp;') AS loc FROM pages
 UNION ALL SELECT 'url', 'https://x.example/logo.png' FROM (SELECT DISTINCT {sql(HOST)}, page_id // 1000 FROM pages)
 UNION ALL SELECT 'sitemap', 'https://' || h || '/sitemap-' || b || '.xml' FROM (SELECT DISTINCT {sql(HOST)} AS h, page_id // 1000 AS b FROM pages)) GROUP BY 1""")
def s13(t):
    files, _ = _sitemap_files(t)
    return crawl.sitemap_locations(files).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("loc").alias("n_locs"))


@query("G2_sitemap_expansion", "SELECT DISTINCT replace(url, '&', '&amp;') AS url FROM pages")
def g2(t):
    files, roots = _sitemap_files(t)
    # Six index files stand between the root and the file that lists the parts; the last names the first again.
    home, k = F.regexp_replace("url", "/sitemap.xml$", ""), F.col("k")
    down = roots.select(home.alias("home"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    entry = lambda to: F.concat(F.lit("<sitemapindex><sitemap><loc>"), to, F.lit("</loc></sitemap></sitemapindex>"))
    nested = down.select(
        F.concat("home", F.lit("/down-"), k, F.lit(".xml")).alias("url"),
        entry(F.when(k < 6, F.concat("home", F.lit("/down-"), k + 1, F.lit(".xml</loc></sitemap><sitemap><loc>"), "home", F.lit("/down-0.xml"))).otherwise(
            F.concat("home", F.lit("/sitemap.xml")))).alias("xml"))
    return crawl.expand_sitemaps(files.unionByName(nested), roots.select(F.regexp_replace("url", "/sitemap.xml$", "/down-0.xml").alias("url")))


@query("G3_site_map", f"""
WITH src AS (
 SELECT url, CASE WHEN page_id % 2 = 0 THEN 'T' || page_id END AS title, NULL AS description, 0 AS s, page_id AS o FROM pages
 UNION ALL SELECT regexp_replace(url, '^http:', 'https:') || '/', NULL, NULL, 1, page_id FROM pages
 UNION ALL SELECT url, 'R' || page_id, 'D' || page_id, 2, page_id FROM pages WHERE page_id % 5 = 0),
m AS (SELECT trim(string_split(regexp_replace(url, '/$', ''), '?')[1]) AS url, title, description, s, o FROM src)
SELECT url, arg_min({{'t': title}}, (title IS NULL, s, o)).t AS title, arg_min({{'d': description}}, (title IS NULL, s, o)).d AS description
FROM m WHERE {sql(BARE)} LIKE '%.example.net' AND starts_with({sql(PATH)}, '/en') GROUP BY url""")
def g3(t):
    k = F.col("page_id")
    none = F.lit(None).cast("string")
    index = t.pages.select("url", F.when(F.pmod(k, F.lit(2)) == 0, F.concat(F.lit("T"), k)).alias("title"), none.alias("description"), k.alias("ord"))
    listed = t.pages.select(F.concat(F.regexp_replace("url", "^http:", "https:"), F.lit("/")).alias("url"), none.alias("title"), none.alias("description"), k.alias("ord"))
    results = t.pages.filter(F.pmod(k, F.lit(5)) == 0).select("url", F.concat(F.lit("R"), k).alias("title"), F.concat(F.lit("D"), k).alias("description"), k.alias("ord"))
    return crawl.site_map(index, listed, results, F.lit(SITE + "/en"))
