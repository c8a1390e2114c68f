"""URL expressions: ``Column -> Column``, all JVM-side regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path endings that are files, not pages.
FILE_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".css", ".js", ".ico", ".svg", ".tiff", ".zip", ".exe", ".dmg",
    ".mp4", ".mp3", ".wav", ".pptx", ".xlsx", ".avi", ".flv", ".woff", ".ttf", ".woff2", ".webp",
    ".inc",
]

# Schemes that never lead to a web page.
NON_WEB_SCHEMES = ["mailto:", "tel:", "telnet:", "ftp:", "ftps:", "ssh:", "file:"]

# Hosts whose links are never followed.
SOCIAL_HOSTS = [
    "facebook.com", "twitter.com", "linkedin.com", "instagram.com", "pinterest.com",
    "github.com", "calendly.com", "discord.gg", "discord.com",
]

# Two-label public suffixes; callers with other hosts pass their own list.
TWO_LABEL_SUFFIXES = [
    "ac.uk", "co.uk", "gov.uk", "org.uk", "co.jp", "ne.jp", "or.jp", "com.au", "net.au", "org.au",
    "co.nz", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw", "co.in", "co.kr",
    "co.za", "com.vn", "net.vn", "org.vn", "gov.vn", "edu.vn",
]

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Nested expressions repeat their argument; without the binding the tree of a
    URL resolution would grow exponentially.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def authority(u: Column) -> Column:
    return F.regexp_extract(u, _SCHEME + r"//([^/?#]*)", 1)


def host(u: Column) -> Column:
    """Lower-case host without credentials and port; '' when there is none."""
    return F.lower(F.regexp_replace(authority(u), r"^.*@|:\d*$", ""))


def port(u: Column) -> Column:
    return F.regexp_extract(authority(u), r":(\d+)$", 1)


def path(u: Column) -> Column:
    """Path, at least '/'."""
    return F.regexp_replace(F.regexp_extract(u, _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1), "^$", "/")


def query(u: Column) -> Column:
    """Query with its '?', or ''."""
    return F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)


def fragment(u: Column) -> Column:
    """Fragment with its '#', or ''."""
    return F.regexp_extract(u, r"^[^#]*(#.*)$", 1)


def is_web_url(u: Column) -> Column:
    return F.regexp_like(u, F.lit(r"^(?i)https?://[^/?#\s]+"))


def drop_www(h: Column) -> Column:
    return F.regexp_replace(h, r"^www\.", "")


# Encoded form of marks that a URL carries literally.
LITERAL_MARKS = {
    "%2F": "/", "%3A": ":", "%3F": "?", "%23": "#", "%26": "&", "%3D": "=", "%2B": "+", "%2C": ",", "%3B": ";",
    "%40": "@", "%21": "!", "%24": "$", "%27": "'", "%28": "(", "%29": ")", "%7E": "~", "%5B": "[", "%5D": "]",
    "%7C": "|", "%25": "%",
}


def percent_encode(c: Column) -> Column:
    """Encode what a URL may not carry literally; leave reserved marks alone."""

    def encoded(v: Column) -> Column:
        out = F.replace(F.url_encode(v), F.lit("+"), F.lit("%20"))
        for code, mark in LITERAL_MARKS.items():
            out = F.replace(out, F.lit(code), F.lit(mark))
        return F.when(F.regexp_like(v, F.lit(r"""[^!-~]|["<>`{}\\^]""")), out).otherwise(v)

    return let(c, encoded)


def _collapse_dots(c: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""

    def walked(p: Column) -> Column:
        kept = F.aggregate(
            F.split(p, "/"),
            F.expr("cast(array() as array<string>)"),
            lambda acc, seg: F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg))),
        )
        tail = F.when(F.regexp_like(p, F.lit(r"/\.{1,2}$")), "/").otherwise("")
        return F.when(F.regexp_like(p, F.lit(r"/\.{1,2}(/|$)")), F.concat(F.array_join(kept, "/"), tail)).otherwise(p)

    return let(c, walked)


def href(url: Column) -> Column:
    """Standard serialisation of an absolute web URL."""

    def serialised(u: Column) -> Column:
        port_part = F.regexp_replace(
            F.concat(scheme(u), F.lit(":"), port(u)), r"^(?:http:80|https:443|\w+:)$|^\w+(?=:)", "")
        return F.concat(
            scheme(u), F.lit("://"), host(u), port_part,
            percent_encode(F.concat(_collapse_dots(path(u)), query(u), fragment(u))),
        )

    return let(url, serialised)


def resolve(base: Column, reference: Column) -> Column:
    """Join a reference to an absolute web base URL; NULL when it has no target."""

    def joined(ref: Column) -> Column:
        origin = F.concat(scheme(base), F.lit("://"), authority(base))
        no_fragment = F.regexp_replace(base, r"#.*$", "")
        no_query = F.regexp_replace(base, r"[?#].*$", "")
        folder = F.regexp_replace(path(base), r"[^/]*$", "")
        return (
            F.when(F.regexp_like(ref, F.lit(r"^(?i)https?://")), ref)
            .when(F.regexp_like(ref, F.lit(_SCHEME)) & ~F.regexp_like(ref, F.lit(r"^(?i)https?:")), ref)
            .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
            .when(ref == "", no_fragment)
            .when(ref.startswith("#"), F.concat(no_fragment, ref))
            .when(ref.startswith("?"), F.concat(no_query, ref))
            .when(ref.startswith("/"), F.concat(origin, ref))
            .otherwise(F.concat(origin, folder, ref))
        )

    return let(let(reference, joined), lambda u: F.when(is_web_url(u), href(u)).when(
        F.regexp_like(u, F.lit(_SCHEME)) & ~F.regexp_like(u, F.lit(r"^(?i)https?:")), u))


def depth(p: Column) -> Column:
    """Path segments, not counting index pages."""
    return F.size(F.filter(F.split(p, "/"), lambda s: ~s.isin("", "index.php", "index.html")))


def adjusted_max_depth(start_url: Column, max_depth: int) -> Column:
    return F.lit(max_depth) + depth(path(start_url))


def is_file(p: Column) -> Column:
    return F.regexp_extract(p, r"(\.[^.]*)$", 1).isin(FILE_EXTENSIONS)


def bare_host(u: Column) -> Column:
    return F.regexp_replace(host(u), r"^(www\.)+", "")


def is_section_link(u: Column) -> Column:
    """A fragment that is not a client-side route."""
    mark = F.regexp_extract(u, r"^[^#]*#([^#]*)", 1)
    return u.contains("#") & ~((F.length(mark) > 1) & mark.contains("/"))


def has_non_web_scheme(u: Column) -> Column:
    return F.regexp_like(u, F.lit("^(" + "|".join(NON_WEB_SCHEMES) + ")"))


def is_social(u: Column) -> Column:
    return F.regexp_like(u, F.lit("|".join(h.replace(".", r"\.") for h in SOCIAL_HOSTS)))


def is_root_page(u: Column) -> Column:
    return depth_any(path(u)) == 0


def depth_any(p: Column) -> Column:
    return F.size(F.filter(F.split(p, "/"), lambda s: s != ""))


def registered_domain(h: Column, suffixes: list[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The public suffix plus one label; NULL for a bare suffix."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(two.isin(suffixes), F.when(n >= 3, three)).when(n >= 2, two)


def subdomain_labels(h: Column, domain: Column) -> Column:
    rest = F.left(h, F.length(h) - F.length(domain))
    return F.filter(F.split(rest, r"\."), lambda s: s != "")


def domain_splits(h: Column, suffixes: list[str] = TWO_LABEL_SUFFIXES) -> Column:
    """Every suffix of a host from its registered domain up to the host itself."""
    return splits_from(h, registered_domain(h, suffixes))


def splits_from(h: Column, domain: Column) -> Column:
    """``domain_splits`` where the registered domain is known."""
    subs = subdomain_labels(h, domain)
    n = F.size(subs)
    only_www = (n == 1) & (F.try_element_at(subs, F.lit(1)) == "www")
    longer = F.transform(
        F.sequence(F.lit(0), n),
        lambda k: F.array_join(F.concat(F.slice(subs, n - k + 1, F.greatest(k, F.lit(0))), F.array(domain)), "."),
    )
    return (
        F.when(domain.isNull(), F.expr("cast(array() as array<string>)"))
        .when(only_www, F.array(domain))
        .otherwise(longer)
    )


def is_base_domain(u: Column) -> Column:
    clean = drop_www(host(u))
    return F.coalesce((clean == registered_domain(host(u))) & (path(u) == "/"), F.lit(False))


def _last_labels(u: Column) -> Column:
    labels = F.split(drop_www(host(u)), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")


def _first_labels(u: Column) -> Column:
    labels = F.split(drop_www(host(u)), r"\.")
    return F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0))), ".")


def same_domain(u: Column, other: Column) -> Column:
    """Compare the last two labels only, so ``co.uk`` hosts collapse."""
    return _last_labels(u) == _last_labels(other)


def same_subdomain(u: Column, other: Column) -> Column:
    return same_domain(u, other) & (_first_labels(u) == _first_labels(other))


def canonical_key(u: Column) -> Column:
    """URL text without web scheme, www and one trailing slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "^https?://", ""), r"^www\.", ""), "/$", "")


def canonical_host(u: Column) -> Column:
    parsed = drop_www(host(u))
    textual = F.element_at(F.split(canonical_key(u), "/"), 1)
    return F.when(parsed != "", parsed).otherwise(textual)


def route_fragment(u: Column) -> Column:
    f = fragment(u)
    return F.when((F.length(f) > 2) & (f.startswith("#/") | f.startswith("#!/")), f).otherwise("")


def index_form(u: Column) -> Column:
    """Key of a page in the page index."""
    p = F.regexp_replace(path(u), r"/index\.(html|php|htm|shtml|xml)$", "/")
    p = F.regexp_replace(p, "/$", "")
    keep_port = F.when(port(u).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port(u)))
    return F.concat(
        F.lit("https://"), drop_www(host(u)), keep_port,
        F.when(p == "", "/").otherwise(p), query(u), route_fragment(u),
    )


def url_hash(u: Column) -> Column:
    return F.sha2(u, 256)


def path_prefixes(u: Column) -> Column:
    """Index forms of every path prefix, root first, the full URL last."""
    origin = F.concat(scheme(u), F.lit("://"), authority(u))
    parts = F.split(path(u), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.concat(origin, F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    return F.array_distinct(F.transform(F.concat(prefixes, F.array(u)), index_form))


def map_form(u: Column, drop_query: bool = True) -> Column:
    """URL as listed in a site map; NULL when it is not a web URL."""
    named = F.when(F.regexp_like(u, F.lit("(?i)^[^.:]+://")), u).otherwise(F.concat(F.lit("http://"), u))
    short = F.regexp_replace(named, "/$", "")
    if drop_query:
        out = F.trim(F.element_at(F.split(short, r"\?"), 1))
    else:
        out = short
    return F.when(is_web_url(short), out)


def crawl_form(u: Column, drop_query: bool = False) -> Column:
    """Visited-set form: no fragment unless it is a route."""
    q = F.lit("") if drop_query else query(u)
    return F.concat(F.regexp_replace(href(u), r"[?#].*$", ""), q, route_fragment(u))


def equivalence_key(u: Column) -> Column:
    """One URL for the class {www or not} x {http, https} x {bare, '/', index page}."""
    h, p = host(u), path(u)
    named = F.when(h.startswith("www."), h).otherwise(F.concat(F.lit("www."), h))
    page = (
        F.when(p.endswith("/"), F.concat(p, F.lit("index.html")))
        .when(p.endswith("/index.html"), p)
        .when(p.endswith("/index.php"), F.regexp_replace(p, r"php$", "html"))
        .otherwise(F.concat(p, F.lit("/index.html")))
    )
    s = F.when(scheme(u).isin("http", "https"), "http").otherwise(scheme(u))
    keep_port = F.when(port(u).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port(u)))
    return F.concat(s, F.lit("://"), named, keep_port, page, query(u), fragment(u))


def dedup_key(u: Column) -> Column:
    """Host and path ignoring scheme and www."""
    return F.concat(drop_www(host(u)), path(u), query(u), fragment(u))


def hotel_id(u: Column, marker: str = "/hotel/vn/", ending: str = ".vi.html") -> Column:
    """Slug after ``marker``, without the page ending and the query."""
    tail = F.replace(F.substring_index(u, marker, -1), F.lit(ending), F.lit(""))
    return F.substring_index(tail, "?", 1)


def search_url(base: Column, params: dict[str, Column]) -> Column:
    """``base?name=value&...`` with encoded values."""
    pairs = [F.concat(F.lit(name + "="), F.url_encode(value)) for name, value in params.items()]
    return F.concat(base, F.lit("?"), F.concat_ws("&", *pairs))


def tracking_form(u: Column) -> Column:
    """URL as hashed into a monitor signature: no fragment, no trailing slashes."""
    p = F.regexp_replace(path(u), "/+$", "")
    return F.when(is_web_url(u), F.concat(
        scheme(u), F.lit("://"), host(u), F.when(p == "", "/").otherwise(p), query(u)
    )).otherwise(F.trim(u))


def site_category(u: Column, sites: dict[str, str]) -> Column:
    """'pdf', then 'github', then the first listed site that owns the host."""
    h, p = host(u), F.lower(path(u))
    out = F.when((h == "github.com") | h.endswith(".github.com"), "github")
    if "__pdf__" in sites:
        out = F.when(p.endswith(".pdf"), "pdf").when((h == "github.com") | h.endswith(".github.com"), "github")
    for site, label in sites.items():
        if site != "__pdf__":
            out = out.when((h == site.lower()) | h.endswith("." + site.lower()), label)
    return out
