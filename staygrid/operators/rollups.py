"""Grouped aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def hotel_offers(bookings: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Price range, stay dates and the room list text per hotel.

    ``bookings`` has room_name, current_price, checkin, checkout (texts).
    """
    price = F.col("current_price")
    positive = F.when(price > 0, price)
    label = F.when(
        price.isNotNull() & (price != 0),
        F.concat(F.col("room_name"), F.lit(" ("), F.format_number(F.floor(price), 0), F.lit(" VND)")),
    ).otherwise(F.col("room_name"))
    entry = F.struct(*order, label.alias("label"))
    return bookings.groupBy(key).agg(
        F.coalesce(F.min(positive), F.lit(0.0)).alias("lowest_price"),
        F.coalesce(F.max(positive), F.lit(0.0)).alias("highest_price"),
        F.array_join(F.sort_array(F.collect_set("checkin")), ", ").alias("checkin_dates"),
        F.array_join(F.sort_array(F.collect_set("checkout")), ", ").alias("checkout_dates"),
        F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["label"]), "; ").alias("rooms"),
    )


def status_summary(pages: DataFrame, key: list[str], status: str, statuses: list[str]) -> DataFrame:
    """Total and one conditional count per status."""
    return pages.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(status) == s).alias(s) for s in statuses],
    )


def group_stats(jobs: DataFrame, group: str, status: str, backlog: DataFrame, backlog_status: str = "backlog") -> DataFrame:
    """Counts per (group, status), and the separate backlog counted as one more status."""
    live = jobs.groupBy(group, F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    waiting = backlog.groupBy(group).agg(F.count(F.lit(1)).alias("n")).select(
        group, F.lit(backlog_status).alias("status"), "n")
    return live.unionByName(waiting)


def crawl_progress(stats: DataFrame, group: str) -> DataFrame:
    """Completed and total jobs per group from ``group_stats`` output."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0))
    out = stats.groupBy(group).agg(
        n("completed").alias("completed"), n("active").alias("active"),
        n("queued").alias("queued"), n("backlog").alias("backlog"),
    )
    return out.withColumn("total", F.col("completed") + F.col("active") + F.col("queued") + F.col("backlog"))


def duration_seconds(start: Column, end: Column) -> Column:
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.greatest(F.lit(0).cast("long"), seconds)


def monthly(periods: DataFrame, when: str, credits: Column, by: list[str] | None = None) -> DataFrame:
    """Credits per month; the newest month is still open and has no end."""
    month = F.to_date(F.date_trunc("month", F.col(when)))
    valid = periods.filter(F.col(when).isNotNull())
    totals = valid.groupBy(month.alias("start_date"), *(by or [])).agg(F.sum(credits).alias("credits_used"))
    newest = valid.agg(F.max(month).alias("m")).scalar()
    return totals.withColumn(
        "end_date", F.when(F.col("start_date") < newest, F.add_months("start_date", 1))
    )


def collapsed_by_name(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Several ids with one display name become one row."""
    return rows.groupBy(*keys).agg(F.sum(value).alias(value))


def first_values(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Per key and column, the first non-empty value in order."""
    def truthy(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        blank = F.col(c).isNull() | (F.col(c) == "" if kind == "string" else F.lit(False))
        if kind in ("int", "bigint", "double", "float"):
            blank = blank | (F.col(c) == 0)
        return F.when(~blank, F.col(order))

    return df.groupBy(key).agg(*[F.min_by(F.col(c), truthy(c)).alias(c) for c in columns])


def costs_by_type(calls: DataFrame, key: list[str], kind: str, cost: str, main: str) -> DataFrame:
    """Counts and costs of one call type against all others; NaN and NULL cost 0."""
    amount = F.coalesce(F.nanvl(F.col(cost), F.lit(0.0)), F.lit(0.0)).cast("decimal(18,2)")
    is_main = F.coalesce(F.col(kind) == main, F.lit(False))
    zero = F.lit(0).cast("decimal(18,2)")
    return calls.groupBy(*key).agg(
        F.count_if(is_main).alias("main_calls"),
        F.sum(F.when(is_main, amount).otherwise(zero)).cast("double").alias("main_cost"),
        F.count_if(~is_main).alias("other_calls"),
        F.sum(F.when(~is_main, amount).otherwise(zero)).cast("double").alias("other_cost"),
        F.sum(amount).cast("double").alias("total_cost"),
    )
