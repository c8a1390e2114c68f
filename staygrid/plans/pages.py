"""Jobs over a table of raw pages: links, metadata, images, clean HTML, Markdown.

Link, image, metadata and attribute extraction are JVM expressions; cleaning
and Markdown need the tag tree and run as one Arrow-batched map.  No job here
shuffles a large input: every page is handled where it was read (``spread``
only evens out inputs with fewer splits than cores).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, markup, urls
from ..session import spread


_SEP = "\x1f"


def _decoded(raw: Column) -> Column:
    """Entities decoded in a whole array by one Arrow value per page."""
    joined = html.unescape(F.array_join(raw, _SEP))
    return F.when(F.size(raw) > 0, F.split(joined, _SEP)).otherwise(F.expr("cast(array() as array<string>)"))


def page_links(pages: DataFrame, keys: list[str], url: str = "url", body: str = "html") -> DataFrame:
    """Distinct links of each page as rows (keys, url, link)."""
    seen = spread(pages, *keys).select(*keys, F.col(url).alias("url"), html.visible(F.col(body)).alias("_v"))
    raw = F.transform(html.tags(F.col("_v"), "a"), lambda a: html.attr(a, "href"))
    rows = seen.select(
        *keys, "url", html.base_url(F.col("_v"), F.col("url")).alias("_base"),
        _decoded(F.filter(raw, lambda h: h.isNotNull())).alias("_raw"))

    def target(ref: Column) -> Column:
        return F.when(ref.startswith("mailto:"), ref).otherwise(urls.resolve(F.col("_base"), ref))

    hrefs = F.filter(F.transform("_raw", html.repaired_href), lambda h: (h != "") & ~h.startswith("#"))
    links = F.filter(F.transform(hrefs, target), lambda x: x.isNotNull())
    return rows.select(*keys, "url", F.explode(F.array_distinct(links)).alias("link"))


def page_images(pages: DataFrame, keys: list[str], url: str = "url", body: str = "html") -> DataFrame:
    """Distinct image URLs of each page as rows (keys, image)."""
    seen = spread(pages, *keys).select(*keys, F.col(url).alias("url"), html.visible(F.col(body)).alias("_v"))
    rows = seen.select(
        *keys, "url", html.base_url(F.col("_v"), F.col("url")).alias("_base"),
        _decoded(html.image_candidates(F.col("_v"))).alias("_raw"))
    images = F.filter(
        F.transform("_raw", lambda r: html.image_url(F.col("url"), F.col("_base"), r)), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(F.array_distinct(images)).alias("image"))


def page_metadata(pages: DataFrame, keys: list[str], body: str = "html") -> DataFrame:
    """map of metadata per page, entities decoded."""
    seen = spread(pages, *keys).select(*keys, html.visible(F.col(body)).alias("_v"))
    v = F.col("_v")
    # Tags are matched once per page here; the map below only looks values up.
    parsed = seen.select(
        *keys, html.meta_entries(v).alias("_metas"), html.icon_entries(v).alias("_icons"), html.title(v).alias("_title"),
        html.first_attr(v, "html", "lang").alias("_lang"), F.size(html.tags(html.head(v), "meta")).alias("_n"))
    meta = parsed.select(*keys, html.metadata(
        F.col("_metas"), F.col("_n"), F.col("_icons"), F.col("_title"), F.col("_lang")).alias("_m"))
    rows = meta.select(*keys, F.map_keys("_m").alias("_k"), _decoded(F.map_values("_m")).alias("_x"))
    return rows.select(*keys, F.map_from_arrays("_k", "_x").alias("metadata"))


def page_attributes(
    pages: DataFrame, keys: list[str], tag: str, attribute: str, css_class: str | None = None,
    element_id: str | None = None, body: str = "html",
) -> DataFrame:
    """Attribute values of the selected elements as rows (keys, position, value)."""
    seen = spread(pages, *keys).select(*keys, html.visible(F.col(body)).alias("_v"))
    values = html.attribute_values(F.col("_v"), tag, attribute, css_class, element_id)
    return seen.select(*keys, F.posexplode(_decoded(values)).alias("position", "value"))


def clean_pages(
    pages: DataFrame, key: str, formats: list[str], include: list[str] | None = None,
    exclude: list[str] | None = None, only_main: bool = True, url: str = "url", body: str = "html",
) -> DataFrame:
    """Clean HTML and/or Markdown per page.

    Column pruning cannot look inside the map, so the wanted ``formats``
    (``html``, ``markdown``) decide what is computed.  A page whose main
    content comes out empty is rendered again as a whole.
    """
    include, exclude = include or [], exclude or []
    key_type = dict(pages.dtypes)[key]
    schema = f"{key} {key_type}" + "".join(f", {f} string" for f in formats)

    def render(page_html, page_url):
        root = markup.cleaned(page_html, page_url, include, exclude, only_main)
        row = {}
        if "html" in formats:
            row["html"] = markup.to_html(root)
        if "markdown" in formats:
            text = markup.to_markdown(root)
            if not text and only_main:
                text = markup.to_markdown(markup.cleaned(page_html, page_url, include, exclude, False))
            row["markdown"] = text
        return row

    def run(batches):
        for pdf in batches:
            rows = [{key: k, **render(h or "", u or "")} for k, u, h in zip(pdf[key], pdf["_u"], pdf["_h"])]
            yield pd.DataFrame(rows, columns=[key, *formats])

    return spread(pages, key).select(key, F.col(url).alias("_u"), F.col(body).alias("_h")).mapInPandas(run, schema)
