"""Link rules, robots, blocklists, the crawl frontier and site maps."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls, vectors
from ..operators.domains import same_registered_domain, with_registered_domain
from ..operators.ordered import newest_per_key, one_per_key
from ..session import cut_lineage, work_path


@dataclass(frozen=True)
class LinkRules:
    max_depth: int = 10
    excludes: list[str] = field(default_factory=list)
    includes: list[str] = field(default_factory=list)
    regex_on_full_url: bool = False
    allow_backward: bool = False
    allow_external: bool = False
    allow_subdomains: bool = False


def _any_match(target: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.regexp_like(target, F.lit(p))
    return hit


def denial_reason(
    url: Column, base: Column, start: Column, rules: LinkRules, robots_blocked: Column | None = None, listing: bool = True,
    same_domain: Column | None = None,
) -> Column:
    """Why a resolved link is not followed; NULL when it is.

    ``listing=False`` is the reduced rule set for a single URL: no depth, file
    type, backward or include rule.  ``same_domain`` says whether link and base
    are of one registered domain, as ``with_same_domain`` finds it by a suffix
    table; without it the built-in two-label suffixes decide.
    """
    path = urls.path(url)
    internal = urls.bare_host(url) == urls.bare_host(base)
    start_internal = urls.bare_host(start) == urls.bare_host(base)
    target = url if rules.regex_on_full_url and listing else path
    blocked = robots_blocked if robots_blocked is not None else F.lit(False)
    out = F.when(url.isNull(), "URL_PARSE_ERROR").when(urls.has_non_web_scheme(url), "NON_WEB_PROTOCOL")
    if listing:
        out = out.when(urls.depth(path) > rules.max_depth, "DEPTH_LIMIT").when(urls.is_file(path), "FILE_TYPE")
    out = out.when(internal & urls.is_section_link(url), "SECTION_LINK")
    if listing and not rules.allow_backward:
        out = out.when(internal & ~path.startswith(urls.path(start)), "BACKWARD_CRAWLING")
    if rules.excludes:
        out = out.when(internal & _any_match(target, rules.excludes), "EXCLUDE_PATTERN")
    if rules.includes and listing:
        out = out.when(internal & ~_any_match(target, rules.includes), "INCLUDE_PATTERN")
    out = out.when(internal & blocked, "ROBOTS_TXT").when(internal, F.lit(None))
    out = out.when(urls.is_social(url), "SOCIAL_MEDIA")
    if rules.excludes:
        out = out.when(_any_match(url, rules.excludes), "EXCLUDE_PATTERN")
    if rules.allow_external:
        out = out.when(start_internal & ~urls.is_root_page(url), F.lit(None))
    if rules.allow_subdomains:
        if same_domain is None:
            same_domain = urls.registered_domain(urls.host(url)) == urls.registered_domain(urls.host(base))
        sub = F.coalesce(same_domain, F.lit(False))
        if rules.includes and listing:
            out = out.when(sub & ~_any_match(target, rules.includes), "INCLUDE_PATTERN")
        out = out.when(sub, F.lit(None))
    return out.otherwise("EXTERNAL_LINK")


def with_same_domain(links: DataFrame, url: Column, base: Column, suffixes: DataFrame, out: str = "same_domain") -> DataFrame:
    """Adds whether link and base belong to one registered domain by a table of public suffixes."""
    hosts = links.withColumn("_link_host", urls.host(url)).withColumn("_base_host", urls.host(base))
    return same_registered_domain(hosts, "_link_host", "_base_host", suffixes, out).drop("_link_host", "_base_host")


# -------------------------------------------------------------------- robots

def robots_rules(robots: DataFrame, host: str = "host", body: str = "robots_txt") -> DataFrame:
    """(host, agent, rules) from robots files; one row per host and agent.

    A window orders the lines of one file, so its size is that of one file.
    """
    lines = robots.select(host, F.posexplode(F.split(body, r"\r?\n")).alias("pos", "line"))
    clean = F.trim(F.regexp_replace("line", r"#.*$", ""))
    parsed = lines.select(
        host, "pos", F.lower(F.trim(F.regexp_extract(clean, r"^([^:]+):", 1))).alias("name"),
        F.trim(F.regexp_extract(clean, r"^[^:]+:(.*)$", 1)).alias("value"),
    ).filter(F.col("name").isin("user-agent", "allow", "disallow"))
    w = W.partitionBy(host).orderBy("pos")
    is_agent = F.col("name") == "user-agent"
    starts = is_agent & (F.coalesce(F.lag("name").over(w), F.lit("")) != "user-agent")
    grouped = parsed.withColumn("_start", starts.cast("int")).withColumn(
        "_g", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rule = F.struct(
        F.length("value").alias("weight"), (F.col("name") == "allow").alias("allow"), _rule_regex(F.col("value")).alias("regex"),
        F.regexp_extract("value", r"^(?:[^*$]|\$(?!$))*", 0).alias("head"))
    per_group = grouped.groupBy(host, "_g").agg(
        F.collect_list(F.when(is_agent, F.lower("value"))).alias("agents"),
        F.collect_list(F.when(~is_agent & (F.col("value") != ""), rule)).alias("rules"))
    per_agent = per_group.select(host, F.explode("agents").alias("agent"), "rules")
    return per_agent.groupBy(host, "agent").agg(F.flatten(F.collect_list("rules")).alias("rules"))


def _rule_regex(value: Column) -> Column:
    quoted = F.regexp_replace(value, r"([\\.+?()\[\]{}|^])", r"\\$1")
    inner = F.regexp_replace(F.regexp_replace(quoted, r"\$(?!$)", r"\\\$"), r"\*", ".*")
    return F.concat(F.lit("^"), inner)


def with_robots(links: DataFrame, rules: DataFrame, agents: list[str], url: str = "link", out: str = "robots_allowed") -> DataFrame:
    """Adds whether any of ``agents`` may fetch the link: the longest matching rule decides, allow wins a tie, no match allows.

    An agent that a host's file does not name goes by its rules for ``*``.  A link without a trailing slash is also
    tested with one.  Rules are found by the literal text they begin with: a target has one key for each length that the
    beginnings of its host's rules have, equal keys are joined, and only rules with wildcards are then tried as patterns.
    So a target costs as many look-ups as there are lengths, however many rules its host has; each URL is judged once.
    """
    named = rules.groupBy(F.col("host").alias("_rh")).agg(F.collect_set("agent").alias("_named"))
    index = rules.select(F.col("host").alias("_rh"), F.col("agent").alias("_agent"), F.explode("rules").alias("_r")).select("_rh", "_agent", "_r.*")
    lengths = index.groupBy("_rh", "_agent").agg(F.collect_set(F.length("head")).alias("_lengths"))
    asked = F.array_distinct(F.array(*[F.when(F.array_contains("_named", a.lower()), F.lit(a.lower())).otherwise(F.lit("*")) for a in agents]))
    target = F.concat(urls.path(F.col("_url")), urls.query(F.col("_url")))
    forms = F.array_distinct(F.array(target, F.when(F.col("_url").endswith("/"), target).otherwise(F.concat(target, F.lit("/")))))
    judged = links.select(F.col(url).alias("_url")).distinct().withColumn("_rh", urls.host(F.col("_url"))).join(named, "_rh")
    judged = judged.select("_url", "_rh", F.size(asked).alias("_asked"), F.explode(asked).alias("_agent"), forms.alias("_forms"))
    tried = judged.join(lengths, ["_rh", "_agent"]).select("_url", "_rh", "_agent", "_asked", "_lengths", F.explode("_forms").alias("_form"))
    heads = F.transform(F.filter("_lengths", lambda n: n <= F.length("_form")), lambda n: F.substring(F.col("_form"), F.lit(1), n))
    met = tried.select("_url", "_rh", "_agent", "_asked", "_form", F.explode(heads).alias("head")).join(index, ["_rh", "_agent", "head"])
    hits = met.filter((F.length("head") == F.col("weight")) | F.regexp_like("_form", F.col("regex")))
    best = hits.groupBy("_url", "_agent", "_asked", "_form").agg(F.max(F.struct("weight", "allow")).alias("_best"))
    closed = best.filter(~F.col("_best.allow")).groupBy("_url", "_asked").agg(F.count_distinct("_agent").alias("_closed"))
    shut = closed.filter(F.col("_closed") == F.col("_asked")).select(F.col("_url").alias(url), F.lit(True).alias("_shut"))
    return links.join(shut, url, "left").withColumn(out, F.col("_shut").isNull()).drop("_shut").select(*links.columns, out)


# ----------------------------------------------------------------- blocklist

def keyword_allowed(url: Column, keywords: list[str]) -> Column:
    """Substring, ``regex:...`` or ``/.../flags`` keywords that lift a block."""
    import re

    hit = F.lit(False)
    for k in (k.strip() for k in keywords):
        slashed = re.fullmatch(r"/(.+)/([dgimsuvy]*)", k)
        if not k:
            continue
        if k.startswith("regex:"):
            hit = hit | F.regexp_like(url, F.lit("(?i)" + k[len("regex:"):]))
        elif slashed:
            flags = "".join(f for f in slashed[2] if f in "ims")
            hit = hit | F.regexp_like(url, F.lit((f"(?{flags})" if flags else "") + slashed[1]))
        else:
            hit = hit | F.lower(url).contains(k.lower())
    return hit


def with_block_reason(
    links: DataFrame, blocklist: DataFrame, allow_keywords: list[str], unblocked: list[str] | None = None,
    url: str = "url", suffixes: list[str] | DataFrame = urls.TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """Adds ``block_reason``: domain, suffix, other_tld or NULL.

    ``blocklist`` has one column ``blocked``.  Domains are matched once each
    and joined back; all three tests are equi-joins on the distinct domains.
    ``suffixes`` is a list of two-label suffixes, or a table with any (column
    ``suffix``).
    """
    listed = blocklist.select("blocked").distinct()
    if unblocked:
        listed = listed.filter(~F.col("blocked").isin(unblocked))
    bases = listed.groupBy(F.split("blocked", r"\.")[0].alias("_base")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("blocked").alias("_only"))
    host = urls.host(F.lower(F.trim(F.col(url))))
    if isinstance(suffixes, DataFrame):
        tagged = with_registered_domain(links.withColumn("_site", host), "_site", suffixes, "_domain").drop("_site")
    else:
        tagged = links.withColumn("_domain", urls.registered_domain(host, suffixes))
    domains = tagged.select("_domain").filter(F.col("_domain").isNotNull()).distinct()
    labels = F.split("_domain", r"\.")
    parents = domains.select("_domain", F.explode(F.transform(
        F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("blocked"))
    by_suffix = parents.join(listed, "blocked").select(F.col("_domain"), F.lit(True).alias("_suffix")).distinct()
    exact = listed.select(F.col("blocked").alias("_domain"), F.lit(True).alias("_exact"))
    base = F.split("_domain", r"\.")[0]
    verdicts = (
        domains.join(exact, "_domain", "left").join(by_suffix, "_domain", "left")
        .join(bases, base == F.col("_base"), "left")
        .select("_domain", F.when(F.col("_exact"), "domain").when(F.col("_suffix"), "suffix").when(
            (F.length(base) > 2) & ((F.col("_n") > 1) | (F.col("_only") != F.col("_domain"))), "other_tld").alias("_why"))
    )
    joined = tagged.join(verdicts, "_domain", "left")
    lifted = keyword_allowed(F.col(url), allow_keywords)
    return joined.withColumn("block_reason", F.when(~lifted, F.col("_why"))).drop("_domain", "_why")


# ------------------------------------------------------------------ frontier

class VisitedPages:
    """The pages that crawls have seen: a table in buckets of (crawl_id, page_key), one partition per level.

    Each level is appended in the bucket layout, so looking candidates up shuffles them alone, never the pages seen so far,
    and a level is written once: it is read back as its partition.  Rows a page is known by are one per (crawl, page), so a
    large crawl or a popular page spreads over all buckets.
    """

    KEYS = ("crawl_id", "page_key")

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"visited_{uuid.uuid4().hex}"
        self.path = work_path(spark, "visited")
        self.counts: DataFrame | None = None

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def bucketed(self, rows: DataFrame) -> DataFrame:
        """``rows`` shuffled into the table's buckets."""
        return rows.repartition(self.buckets, *self.KEYS)

    def unseen(self, candidates: DataFrame) -> DataFrame:
        """The candidates, already in buckets, that no earlier level holds."""
        return candidates.join(self.rows().select(*self.KEYS), list(self.KEYS), "left_anti")

    def append(self, rows: DataFrame, level: int) -> DataFrame:
        """Store a level's new pages; returns them as stored."""
        writer = rows.withColumn("level", F.lit(level)).write.mode("append").format("parquet").option("path", self.path)
        writer.partitionBy("level").bucketBy(self.buckets, *self.KEYS).saveAsTable(self.name)
        return self.rows().filter(F.col("level") == level)

    def count(self, level_rows: DataFrame) -> DataFrame:
        """Pages per crawl so far, carried on from level to level: only the new level is counted."""
        new = level_rows.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("_seen"))
        both = new if self.counts is None else self.counts.unionByName(new).groupBy("crawl_id").agg(F.sum("_seen").alias("_seen"))
        self.counts = cut_lineage(both)
        return self.counts


def crawl_frontier(
    links: DataFrame, seeds: DataFrame, rules: LinkRules, max_levels: int, limit: int | None = None,
    robots: DataFrame | None = None, agents: list[str] | None = None, suffixes: DataFrame | None = None, buckets: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Level-by-level expansion over stored pages.

    ``links`` (page_url, link) are the extracted edges; ``seeds`` has crawl_id,
    url and start_url.  Pages count as one under ``urls.equivalence_key``.
    Returns (visited: crawl_id, url, level) and (denied: crawl_id, url, reason).
    Every level is written to the shared folder, which keeps the plan short and
    lets a lost executor recompute one level only; the pages seen so far are a
    bucketed table that no level shuffles again.  The edges are not in buckets,
    since one page may hold a large share of them and a bucket cannot be split.
    ``limit`` is the most pages of one crawl; it cuts a level in the order of
    the URLs.  ``suffixes`` is a table of public suffixes for the subdomain rule.
    """
    edges = cut_lineage(links.select(
        urls.equivalence_key(F.col("page_url")).alias("_from"), F.col("link").alias("url")))
    key = urls.equivalence_key(F.col("url"))
    url, start = F.col("url"), F.col("start_url")
    visited = VisitedPages(seeds.sparkSession, buckets)
    first = seeds.select("crawl_id", "url", "start_url", key.alias("page_key"))
    level_rows = visited.append(one_per_key(visited.bucketed(first), list(visited.KEYS), url), 0)
    denied = None
    for level in range(1, max_levels + 1):
        here = level_rows.select("crawl_id", "start_url", F.col("page_key").alias("_from"))
        out = here.join(edges, "_from").drop("_from").dropDuplicates(["crawl_id", "url"])
        blocked = same = None
        if robots is not None:
            out = with_robots(out, robots, agents or ["*"], url="url")
            blocked = ~F.col("robots_allowed")
        if suffixes is not None and rules.allow_subdomains:
            out = with_same_domain(out, url, start, suffixes, "_same_domain")
            same = F.col("_same_domain")
        reason = denial_reason(url, start, start, rules, blocked, same_domain=same)
        out = cut_lineage(out.select("crawl_id", "url", "start_url", key.alias("page_key"), reason.alias("reason")))
        refused = out.filter(F.col("reason").isNotNull()).select("crawl_id", "url", "reason")
        denied = refused if denied is None else denied.unionByName(refused)
        found = visited.bucketed(out.filter(F.col("reason").isNull()).drop("reason"))
        new = one_per_key(visited.unseen(found), list(visited.KEYS), url)
        if limit is not None:
            counts = visited.count(level_rows).withColumn("_crawl", F.struct("crawl_id")).drop("crawl_id")
            ranked = newest_per_key(new, ["crawl_id"], [url], limit, "_rank").withColumn("_crawl", F.struct("crawl_id"))
            new = visited.bucketed(ranked.join(counts, "_crawl", "left").filter(
                F.col("_rank") <= limit - F.coalesce("_seen", F.lit(0))).drop("_rank", "_crawl", "_seen"))
        level_rows = visited.append(new, level)
        if level_rows.isEmpty():
            break
    if denied is None:
        denied = first.limit(0).select("crawl_id", "url", F.lit("").alias("reason"))
    return visited.rows().select("crawl_id", "url", "level"), denied.dropDuplicates(["crawl_id", "url"])


# ------------------------------------------------------------------ site map

def sitemap_locations(files: DataFrame, body: str = "xml") -> DataFrame:
    """(…, kind, loc) rows of sitemap files; other roots give kind 'error'."""
    keep = [c for c in files.columns if c != body]
    xml = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>", ""), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    root = F.regexp_extract(xml, r"^\s*<(?:\w+:)?(\w+)", 1)
    entries = F.when(root == "sitemapindex", F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?sitemap\b[^>]*>(.*?)</(?:\w+:)?sitemap>"), F.lit(1))).when(
        root == "urlset", F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?url\b[^>]*>(.*?)</(?:\w+:)?url>"), F.lit(1)))
    locs = F.filter(
        F.transform(entries, lambda e: F.trim(F.regexp_extract(e, r"(?s)<(?:\w+:)?loc\b[^>]*>(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?</", 1))),
        lambda s: s != "")
    kind = F.when(root == "sitemapindex", "sitemap").when(root == "urlset", "url").otherwise("error")
    return files.select(*keep, kind.alias("kind"), F.explode_outer(locs).alias("loc")).filter(
        (F.col("kind") == "error") | F.col("loc").isNotNull())


def sitemap_actions(locations: DataFrame) -> DataFrame:
    """What to do with each location: recurse, process, or drop (file types, broken URLs)."""
    loc = F.col("loc")
    nested = F.regexp_like(F.lower(loc), F.lit(r"\.xml(\.gz)?$"))
    action = (
        F.when(F.col("kind") == "error", "error").when((F.col("kind") == "sitemap") | nested, "recurse")
        .when(~urls.is_web_url(loc) | urls.is_file(F.lower(urls.path(loc))), "drop").otherwise("process"))
    return locations.withColumn("action", action)


def expand_sitemaps(stored: DataFrame, roots: DataFrame) -> DataFrame:
    """Pages reachable from root sitemaps through stored sitemap files (url, xml), however deeply nested.

    Every file is parsed once; the levels only join small (file, loc) rows.  A
    file is read once, so files that name each other end too.
    """
    parsed = cut_lineage(sitemap_actions(sitemap_locations(stored)).select("url", "loc", "action"))
    todo = cut_lineage(roots.select("url").distinct())
    done, pages = todo, None
    while True:
        found = parsed.join(todo, "url")
        part = found.filter(F.col("action") == "process").select(F.col("loc").alias("url"))
        pages = part if pages is None else pages.unionByName(part)
        nested = found.filter(F.col("action") == "recurse").select(F.col("loc").alias("url")).distinct()
        todo = cut_lineage(nested.join(done, "url", "left_anti"))
        if todo.isEmpty():
            break
        done = done.unionByName(todo)
    return pages.distinct()


def site_map(
    index: DataFrame, sitemap: DataFrame, results: DataFrame, site: Column, limit: int | None = None, search: str | None = None,
    include_subdomains: bool = True, filter_by_path: bool = True, drop_query: bool = True, cutoff: int | None = None,
) -> DataFrame:
    """List of a site's URLs: union, cut, rank, normalise, filter, dedup, cut.

    Each input has url, title, description and ord.  Search results lead when
    there is a search text and trail otherwise.  ``limit`` cuts the list (and its
    input as well), ``cutoff`` the input alone; without them nothing is cut.
    """
    rank = {"results": 0, "index": 1, "sitemap": 2} if search else {"index": 0, "sitemap": 1, "results": 2}
    union = None
    for name, df in (("index", index), ("sitemap", sitemap), ("results", results)):
        part = df.select("url", "title", "description", F.lit(rank[name]).alias("_src"), F.col("ord").alias("_ord"))
        union = part if union is None else union.unionByName(part)
    most = min((n for n in (cutoff, limit) if n is not None), default=None)
    rows = union if most is None else union.orderBy("_src", "_ord", "url").limit(most)
    score = vectors.query_score(F.col("url"), search) if search else F.lit(0.0)
    rows = rows.withColumn("_score", F.round(score, 9)).withColumn("url", urls.map_form(F.col("url"), drop_query))
    u = F.col("url")
    keep = u.isNotNull() & urls.same_domain(u, site)
    if not include_subdomains:
        keep = keep & urls.same_subdomain(u, site)
    if filter_by_path:
        keep = keep & ((urls.path(site) == "/") | urls.path(u).startswith(urls.path(site)))
    place = F.struct((-F.col("_score")).alias("s"), "_src", "_ord")
    kept = rows.filter(keep).groupBy("url").agg(
        F.min(place).alias("_place"),
        F.min_by(F.struct("title", "description"), F.struct(F.col("title").isNull().alias("no_title"), place.alias("p"))).alias("_doc"))
    placed = kept.orderBy("_place", "url")
    return (placed if limit is None else placed.limit(limit)).select("url", "_doc.title", "_doc.description")
