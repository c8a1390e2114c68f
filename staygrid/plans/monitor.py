"""A monitoring run: two snapshots in; events, summary and page state out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import usage
from ..operators.changes import change_status
from ..operators.rollups import status_summary

STATUSES = ["same", "changed", "new", "removed", "error"]


def check_events(known: DataFrame, captured: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """One event per page: status of captured pages, ``removed`` for known pages not seen.

    Both sides have the keys and ``markdown``; ``captured`` also ``status_code``.
    One full outer join gives both; pages are compared on the joined row.
    """
    old = known.select(*keys, F.col("markdown").alias("_before"), F.lit(True).alias("_known"))
    new = captured.select(*keys, F.col("markdown").alias("_now"), "status_code", F.lit(True).alias("_seen"))
    both = old.join(new, keys, "full_outer")
    status = F.when(F.col("_seen").isNull(), "removed").otherwise(
        change_status(F.when(F.col("_known"), F.coalesce("_before", F.lit(""))), F.coalesce("_now", F.lit("")), F.col("status_code"), strict))
    return both.select(*keys, status.alias("status"), "status_code")


def with_judgment(events: DataFrame, judgments: DataFrame, keys: list[str]) -> DataFrame:
    """``is_meaningful`` applies to changed pages only."""
    verdict = judgments.select(*keys, F.col("is_meaningful").alias("_m"))
    return events.join(verdict, keys, "left").withColumn("is_meaningful", F.when(F.col("status") == "changed", F.col("_m"))).drop("_m")


def summary(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status and credits per check."""
    none = F.lit(None)
    credits = usage.monitored_page_credits(
        F.col("status"), none.cast("int"), none.cast("int"), none.cast("string"), F.lit(False), F.lit(False),
        F.lit(1), F.lit(False), none.cast("string"))
    counts = status_summary(events, keys, "status", STATUSES)
    return counts.join(events.groupBy(*keys).agg(F.sum(credits).alias("credits")), keys)


def next_state(state: DataFrame, events: DataFrame, keys: list[str], check_id: str) -> DataFrame:
    """Page state after a check.

    A removed page keeps the check it was last seen in; new and changed pages
    move their last change.
    """
    has = set(state.columns)
    old = state.select(*keys, *[
        (F.col(c) if c in has else F.lit(None).cast("string")).alias(f"_{c}") for c in ("first_seen", "last_seen", "last_changed")])
    joined = old.join(events.select(*keys, "status"), keys, "full_outer")
    here, status = F.lit(check_id), F.col("status")
    return joined.select(
        *keys,
        F.coalesce("_first_seen", F.when(status.isNotNull(), here)).alias("first_seen"),
        F.when(status.isNull() | (status == "removed"), F.col("_last_seen")).otherwise(here).alias("last_seen"),
        F.when(status.isin("new", "changed"), here).otherwise(F.col("_last_changed")).alias("last_changed"),
        status.alias("last_status"), F.coalesce(status == "removed", F.lit(False)).alias("is_removed"))
