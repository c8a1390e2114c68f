"""Page extraction as expressions over an ``html`` column.

Tags are found by regular expressions inside the JVM, so a page never leaves
the executor's Tungsten rows; only entity decoding runs as an Arrow function,
and only on the short strings that were extracted.
"""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import urls

# Metadata output name -> meta property / meta name it is read from.
META_PROPERTIES = {
    "ogTitle": "og:title", "ogDescription": "og:description", "ogUrl": "og:url", "ogImage": "og:image",
    "ogAudio": "og:audio", "ogDeterminer": "og:determiner", "ogLocale": "og:locale",
    "ogSiteName": "og:site_name", "ogVideo": "og:video",
    "publishedTime": "article:published_time", "modifiedTime": "article:modified_time",
}
META_NAMES = {
    "articleSection": "article:section", "articleTag": "article:tag",
    "dcTermsKeywords": "dcterms.keywords", "dcDescription": "dc.description", "dcSubject": "dc.subject",
    "dcTermsSubject": "dcterms.subject", "dcTermsAudience": "dcterms.audience", "dcType": "dc.type",
    "dcTermsType": "dcterms.type", "dcDate": "dc.date", "dcDateCreated": "dc.date.created",
    "dcTermsCreated": "dcterms.created",
}

# Meta keys that name a page image.
IMAGE_META = [
    ("property", "og:image"), ("property", "og:image:url"), ("property", "og:image:secure_url"),
    ("name", "twitter:image"), ("name", "twitter:image:src"), ("itemprop", "image"),
]

# A quoted value may hold '>'.  Possessive loops: no backtracking over a page.
_ATTRS = r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)"""


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(_html.unescape, na_action="ignore")


def visible(html: Column) -> Column:
    """Page without comments, scripts and styles, whose text may look like tags."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*+>.*?</\1\s*>", "")


def tags(html: Column, name: str) -> Column:
    """Attribute texts of every ``<name ...>`` start tag, in page order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<" + name + r"(?=[\s/>])" + _ATTRS + ">"), F.lit(1))


def attr(attrs: Column, name: str) -> Column:
    """Raw attribute value; NULL when absent, '' when empty."""
    pattern = r"""(?is)(?:^|[\s"'/])""" + name.replace(".", r"\.") + r"""\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
    raw = F.regexp_extract(attrs, pattern, 1)
    return F.when(raw != "", F.regexp_replace(raw, r"""^["']|["']$""", ""))


def first_attr(html: Column, tag: str, name: str, where=None) -> Column:
    hits = tags(html, tag)
    if where is not None:
        hits = F.filter(hits, where)
    values = F.filter(F.transform(hits, lambda a: attr(a, name)), lambda v: v.isNotNull())
    return F.try_element_at(values, F.lit(1))


def base_url(html: Column, page_url: Column) -> Column:
    """The page URL, moved by ``<base href>`` when there is a usable one."""
    return F.coalesce(urls.resolve(page_url, first_attr(html, "base", "href")), page_url)


def head(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<head\b[^>]*+>(.*?)(?:</head\s*>|<body\b)", 1)
    return F.when(found != "", found).otherwise(html)


def title(html: Column) -> Column:
    raw = F.regexp_extract(head(html), r"(?is)(<title\b[^>]*+>.*?)</title\s*>", 1)
    return F.when(raw != "", F.regexp_replace(raw, r"(?is)^<title\b[^>]*+>", ""))


def repaired_href(raw: Column) -> Column:
    """``http:/x`` and ``https:/x`` get their missing slash."""
    return F.regexp_replace(F.trim(raw), r"^(https?):/(?!/)", "$1://")


def background_urls(attrs: Column) -> Column:
    style = attr(attrs, "style")
    found = F.regexp_extract_all(style, F.lit(r"""url\(['"]?([^'")]+)['"]?\)"""), F.lit(1))
    return F.when(F.coalesce(style.contains("background"), F.lit(False)), found)


def srcset_urls(srcset: Column) -> Column:
    return F.transform(F.split(srcset, ","), lambda p: F.regexp_extract(p, r"^\s*(\S+)", 1))


def image_candidates(html: Column) -> Column:
    """Raw values of every place a page names an image."""
    none = F.expr("cast(array() as array<string>)")

    def values(tag: str, name: str, where=None) -> Column:
        hits = tags(html, tag) if where is None else F.filter(tags(html, tag), where)
        return F.transform(hits, lambda a: attr(a, name))

    def sets(tag: str) -> Column:
        return F.flatten(F.transform(values(tag, "srcset"), lambda s: F.coalesce(srcset_urls(s), none)))

    def is_image_meta(a: Column) -> Column:
        hit = F.lit(False)
        for key, value in IMAGE_META:
            hit = hit | F.coalesce(attr(a, key) == value, F.lit(False))
        return hit

    def is_icon(a: Column) -> Column:
        return F.coalesce(F.regexp_like(attr(a, "rel"), F.lit("icon|image_src")), F.lit(False))

    picture_sources = F.flatten(F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)(<picture\b.*?</picture\s*>)"), F.lit(1)),
        lambda block: F.flatten(F.transform(
            F.transform(tags(block, "source"), lambda a: attr(a, "srcset")),
            lambda s: F.coalesce(srcset_urls(s), none),
        )),
    ))
    styled = F.flatten(F.transform(tags(html, r"[a-z][a-z0-9\-]*"), lambda a: F.coalesce(background_urls(a), none)))
    everything = F.concat(
        values("img", "src"), values("img", "data-src"), sets("img"), picture_sources,
        values("meta", "content", is_image_meta), values("link", "href", is_icon),
        values("video", "poster"), styled,
    )
    return F.array_distinct(F.filter(everything, lambda v: v.isNotNull() & (v != "")))


def image_url(page_url: Column, base: Column, raw: Column) -> Column:
    """Absolute image URL; inline data stays as it is; scripts are dropped."""
    inline = raw.startswith("data:") | raw.startswith("blob:")
    absolute = F.regexp_like(raw, F.lit("^https?://"))
    resolved = F.when(raw.startswith("//"), urls.resolve(page_url, raw)).otherwise(urls.resolve(base, F.trim(raw)))
    out = F.when(inline | absolute, raw).otherwise(resolved)
    return F.when(~F.lower(out).startswith("javascript:"), out)


def meta_entries(html: Column) -> Column:
    """array<struct<name, property, itemprop, content>> of a page's meta tags."""
    names = ("name", "property", "itemprop", "content")
    return F.transform(tags(html, "meta"), lambda a: F.struct(*[attr(a, n).alias(n) for n in names]))


def icon_entries(html: Column) -> Column:
    """array<struct<rel, href>> of the head's icon links."""
    links = F.transform(tags(head(html), "link"), lambda a: F.struct(attr(a, "rel").alias("rel"), attr(a, "href").alias("href")))
    return F.filter(links, lambda e: F.coalesce(e["rel"].contains("icon"), F.lit(False)))


def metadata(metas: Column, head_count: Column, icons: Column, page_title: Column, language: Column) -> Column:
    """map<string, string> of page metadata (values still entity-encoded).

    ``metas`` are ``meta_entries`` of the whole page, the first ``head_count``
    of them in its head.  A repeated ``description`` is joined by ', '; other
    repeated keys keep all values as a JSON array.
    """
    head_metas = F.slice(metas, F.lit(1), head_count)

    def first(source: Column, key: str, value: str) -> Column:
        hits = F.filter(source, lambda m: F.coalesce(m[key] == value, F.lit(False)) & m["content"].isNotNull())
        return F.try_element_at(hits, F.lit(1))["content"]

    pairs = F.filter(
        F.transform(metas, lambda m: F.struct(F.coalesce(m["name"], m["property"], m["itemprop"]).alias("k"), m["content"].alias("v"))),
        lambda p: p["k"].isNotNull() & p["v"].isNotNull(),
    )

    def grouped(ps: Column) -> Column:
        def value_of(k: Column) -> Column:
            vs = F.transform(F.filter(ps, lambda p: p["k"] == k), lambda p: p["v"])
            return (
                F.when(k == "description", F.array_join(vs, ", ")).when(F.size(vs) == 1, F.element_at(vs, 1)).otherwise(F.to_json(vs)))

        keys = F.array_distinct(F.transform(ps, lambda p: p["k"]))
        return F.map_from_arrays(keys, F.transform(keys, value_of))

    best_title = F.coalesce(
        page_title, F.nullif(first(head_metas, "property", "og:title"), F.lit("")),
        F.nullif(first(metas, "name", "twitter:title"), F.lit("")), first(metas, "name", "title"))
    favicon = F.coalesce(
        F.try_element_at(F.filter(icons, lambda e: e["rel"] == "icon"), F.lit(1))["href"], F.try_element_at(icons, F.lit(1))["href"])
    alternates = F.transform(
        F.filter(head_metas, lambda m: F.coalesce(m["property"] == "og:locale:alternate", F.lit(False))), lambda m: m["content"])
    fixed = [
        ("title", best_title), ("favicon", favicon), ("language", language),
        ("ogLocaleAlternate", F.when(F.size(alternates) > 0, F.to_json(alternates))),
    ]
    fixed += [(out, first(head_metas, "property", src)) for out, src in META_PROPERTIES.items()]
    fixed += [(out, first(metas, "name", src)) for out, src in META_NAMES.items()]
    known = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(k) for k, _ in fixed]), F.array(*[v for _, v in fixed])), lambda k, v: v.isNotNull())
    names = F.array(*[F.lit(k) for k, _ in fixed])

    def merged(k: Column) -> Column:
        # A page's own key of the same name only counts where the fixed one is missing.
        rest = urls.let(pairs, grouped)
        return F.map_concat(k, F.map_filter(rest, lambda n, v: ~(F.array_contains(names, n) & F.map_contains_key(k, n)) & (n != "title")))

    return urls.let(known, merged)


def attribute_values(html: Column, tag: str, attribute: str, css_class: str | None = None, element_id: str | None = None) -> Column:
    """Values of an attribute (or its ``data-`` twin) on the selected elements."""

    def selected(a: Column) -> Column:
        ok = F.lit(True)
        if css_class is not None:
            ok = ok & F.coalesce(F.array_contains(F.split(attr(a, "class"), r"\s+"), css_class), F.lit(False))
        if element_id is not None:
            ok = ok & F.coalesce(attr(a, "id") == element_id, F.lit(False))
        return ok

    hits = F.filter(tags(html, tag), selected)
    value = lambda a: attr(a, attribute)
    if not attribute.startswith("data-"):
        value = lambda a: F.coalesce(attr(a, attribute), attr(a, "data-" + attribute))
    return F.filter(F.transform(hits, value), lambda v: v.isNotNull())
