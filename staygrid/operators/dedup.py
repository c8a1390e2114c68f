"""Set operations and de-duplication by key expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..session import spread
from .ordered import newest_per_key, one_per_key


def largest_copy(pages: DataFrame, key: Column, size: Column, path: str) -> DataFrame:
    """Groups of pages under one key: the largest copy, how many others, their ids.

    A partial aggregate keeps only (size, path) per row, so a hot key costs no
    more than any other.  Pages without a key go after the aggregate, so that
    the key is worked out once per page and not in a filter as well.
    """
    rows = spread(pages, path).select(key.alias("page_key"), size.alias("_size"), F.col(path))
    return rows.groupBy("page_key").agg(
        F.min_by(path, F.struct((-F.col("_size")).alias("s"), F.col(path))).alias("kept"),
        F.max("_size").alias("kept_size"), (F.count(F.lit(1)) - 1).alias("dropped"),
        F.bool_or(F.col("page_key").isNotNull()).alias("_has")).filter("_has").drop("_has")


def url_union(parts: list[DataFrame], column: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(column) for p in parts]).distinct()


def unique_urls(df: DataFrame, url: str, order: str) -> DataFrame:
    """One URL per host and path: https first, then without www, then the earliest."""
    u = F.col(url)
    rows = df.select(url, order, urls.dedup_key(u).alias("_key"))
    prefer = F.struct((urls.scheme(u) != "https").alias("a"), urls.host(u).startswith("www.").alias("b"), F.col(order).alias("c"))
    return rows.groupBy("_key").agg(F.min_by(url, prefer).alias(url)).select(url)


def titled_first(docs: DataFrame, url: str, title: str, order: str) -> DataFrame:
    """One document per URL: the earliest, unless only a later one has a title."""
    return one_per_key(docs, [url], F.struct(F.col(title).isNull().alias("a"), F.col(order).alias("b")))


def equivalent_urls(df: DataFrame, url: str, order: str) -> DataFrame:
    """One row per URL equivalence class with its first member and size."""
    rows = df.select(urls.equivalence_key(F.col(url)).alias("canonical"), url, order)
    return rows.groupBy("canonical").agg(F.min_by(url, order).alias("first_url"), F.count(F.lit(1)).alias("members"))


def unvisited(
    candidates: DataFrame, visited: DataFrame, url: str, drop_query: bool = False, similar: bool = False, limit: int | None = None,
    order: str | None = None, crawl: str | None = None,
) -> DataFrame:
    """URLs not yet visited, by normalised form (or equivalence class).

    ``limit`` counts visited ones too.  With ``crawl``, a column of both inputs,
    every crawl has its own visited set and limit.
    """
    def form(c: Column) -> Column:
        plain = urls.crawl_form(c, drop_query)
        return urls.equivalence_key(plain) if similar else plain

    own = F.col(crawl) if crawl else F.lit(0)
    fresh = candidates.withColumn("_key", form(F.col(url))).withColumn("_crawl", F.struct(own.alias("c")))
    seen = visited.select(F.struct(own.alias("c")).alias("_crawl"), form(F.col(url)).alias("_key")).distinct()
    pick = F.struct(F.col(order), F.col(url)) if order else F.col(url)
    out = one_per_key(fresh.join(seen, ["_crawl", "_key"], "left_anti"), ["_crawl", "_key"], pick)
    if limit is not None:
        counts = seen.groupBy("_crawl").agg(F.count(F.lit(1)).alias("_seen"))
        ranked = newest_per_key(out, ["_crawl"], [*([F.col(order)] if order else []), F.col(url)], limit, "_rank")
        out = ranked.join(counts, "_crawl", "left").filter(F.col("_rank") <= limit - F.coalesce("_seen", F.lit(0))).drop("_rank", "_seen")
    return out.drop("_key", "_crawl")


def concatenated(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union by name with the source's name and position, so that order survives."""
    out = [df.withColumn("source_name", F.lit(n)).withColumn("source_ord", F.lit(i)) for i, (n, df) in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def one_shape(shapes: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Union of differently shaped inputs, each projected to the same columns."""
    return reduce(DataFrame.unionByName, [df.select(*[c.alias(n) for n, c in cols.items()]) for df, cols in shapes])


def result_urls(responses: DataFrame, key: str, lists: dict[str, str]) -> DataFrame:
    """Rows (key, url, type, index) from list columns of structs with a url."""
    parts = []
    for column, kind in lists.items():
        rows = responses.select(key, F.posexplode(column).alias("index", "_item"))
        part = rows.select(key, F.col("_item.url").alias("url"), F.lit(kind).alias("type"), "index")
        parts.append(part.filter(F.col("url").isNotNull() & (F.col("url") != "")))
    return reduce(DataFrame.unionByName, parts)


def interest_rows(monitors: DataFrame) -> DataFrame:
    """One row per monitor target.

    ``monitors``: monitor_id, status, event_type, interval_ms, targets
    array<struct<id, type, urls array<string>, url, limit>>.
    """
    from ..functions.text import bucket_label

    rows = monitors.select("monitor_id", "status", "event_type", "interval_ms", F.explode("targets").alias("t"))
    seconds = F.greatest(F.lit(1), F.round(F.col("interval_ms") / 1000).cast("int"))
    scrape = F.col("t.type") == "scrape"
    single = F.when(scrape & (F.size("t.urls") == 1), F.element_at("t.urls", 1))
    target_url = F.when(F.col("t.type") == "crawl", F.col("t.url")).otherwise(single)
    signature = F.when(scrape, F.array_join(F.sort_array(F.transform("t.urls", urls.tracking_form)), "\n")).otherwise(
        F.concat_ws("\n", urls.tracking_form(F.col("t.url")), F.col("t.limit").cast("string")))
    return rows.select(
        "monitor_id", F.col("t.id").alias("target_id"), F.col("t.type").alias("target_type"),
        target_url.alias("target_url"), urls.host(target_url).alias("target_host"),
        F.sha2(F.concat(F.col("t.type"), F.lit("\n"), signature), 256).alias("target_signature"),
        F.when(scrape, F.size("t.urls")).otherwise(0).alias("scrape_url_count"),
        seconds.alias("interval_seconds"), (F.lit(86400) / seconds).alias("runs_per_day"),
        bucket_label(seconds).alias("frequency_bucket"),
        F.when((F.col("event_type") != "deactivated") & (F.col("status") == "active"), 1).otherwise(0).alias("is_active"),
        F.when(scrape, F.size("t.urls")).otherwise(F.coalesce(F.when(F.col("t.limit") > 0, F.col("t.limit")), F.lit(10000))).alias("estimated_credits_per_run"))
