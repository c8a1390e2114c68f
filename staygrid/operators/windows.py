"""Per-key histories that are aggregates rather than framed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import newest_per_key


def newest_good_or_newest(entries: DataFrame, keys: list[str], order: list[str], status: str, tolerated: int = 3, look_back: int = 5) -> DataFrame:
    """Newest 2xx entry, unless ``tolerated`` or more newer entries failed; then the newest."""
    recent = newest_per_key(entries, keys, [F.desc(c) for c in order], look_back, "_rn")
    row = F.struct(*[F.col(c) for c in entries.columns])
    good = F.col(status).between(200, 299)
    per = recent.groupBy(*keys).agg(
        F.min_by(row, "_rn").alias("newest"),
        F.min_by(row, F.when(good, F.col("_rn"))).alias("good"),
        F.min(F.when(good, F.col("_rn"))).alias("at"),
    )
    pick = F.when(F.col("at") <= tolerated, F.col("good")).otherwise(F.col("newest"))
    return per.select(pick.alias("_row")).select("_row.*")


def price_drops(history: DataFrame, keys: list[str], order: list[str], price: str, at_least: float = 0.05) -> DataFrame:
    """Keys whose latest price is that much below their earliest."""
    when = F.struct(*order)
    ends = history.groupBy(*keys).agg(F.min_by(price, when).alias("first_price"), F.max_by(price, when).alias("last_price"))
    drop = (F.col("first_price") - F.col("last_price")) / F.col("first_price")
    return ends.filter(F.col("first_price") > 0).withColumn("drop_share", drop).filter(F.col("drop_share") >= at_least)


def page_history(events: DataFrame, keys: list[str], at: str, tie: str, status: str) -> DataFrame:
    """First and last sighting, last change and current state per page."""
    when: Column = F.col(at)
    latest = F.max_by(status, F.struct(at, tie))
    return events.groupBy(*keys).agg(
        F.min(when).alias("first_seen"),
        F.max(F.when(F.col(status) != "removed", when)).alias("last_seen"),
        F.max(F.when(F.col(status).isin("new", "changed"), when)).alias("last_changed"),
        latest.alias("last_status"),
        (latest == "removed").alias("is_removed"),
    )


def crawl_budgets(domains: DataFrame, pages: DataFrame, key: str, total_budget: int, min_urls: int, max_urls: int) -> DataFrame:
    """Pages to fetch and budget share per page.

    Priorities are scaled by their global range and total, read as scalar
    subqueries: no single-partition window and no cross join.
    """
    ends = domains.agg(F.min("priority").alias("lo"), F.max("priority").alias("hi"),
                       F.greatest(F.sum(F.round("priority", 6).cast("decimal(18,6)")).cast("double"), F.lit(1.0)).alias("total"))
    lo, hi, total = (ends.select(c).scalar() for c in ("lo", "hi", "total"))
    scaled = F.when(hi == lo, F.lit(0.0)).otherwise((F.col("priority") - lo) / (hi - lo))
    per_domain = domains.select(
        key, F.round(F.lit(min_urls) + scaled * (max_urls - min_urls)).cast("long").alias("urls_to_fetch"),
        (F.col("priority") / total * total_budget).alias("domain_budget"))
    events = pages.groupBy(key).agg(F.greatest(F.sum("event_count"), F.lit(1)).alias("_events"))
    joined = pages.join(events, key).join(per_domain, key)
    return joined.withColumn(
        "page_budget", F.round(F.col("event_count") / F.col("_events") * F.col("domain_budget")).cast("long")
    ).drop("_events")
