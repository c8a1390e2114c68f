"""Row filters and column selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import newest_per_key


def price_on_date(df: DataFrame, price: str, day: str, max_price: float, on: str) -> DataFrame:
    """Price ceiling and exact day, both inclusive; both reach the scan.

    A timestamp column is compared as a range rather than cast, so that
    min/max statistics and pushed filters still apply.
    """
    if dict(df.dtypes)[day] == "date":
        same_day = F.col(day) == F.to_date(F.lit(on))
    else:
        start = F.lit(on).cast(dict(df.dtypes)[day])
        same_day = (F.col(day) >= start) & (F.col(day) < start + F.expr("INTERVAL 1 DAY"))
    return df.filter((F.col(price) <= max_price) & same_day)


def contains_text(column: Column, search: str) -> Column:
    """Case-insensitive contains; ``%`` and ``_`` in the search stay wildcards."""
    return column.ilike(f"%{search}%")


def incomplete(left: DataFrame, right: DataFrame, on: list[str], detail: str) -> DataFrame:
    """Rows of ``left`` whose detail is missing or empty on the right side."""
    joined = left.join(right.select(*on, detail), on, "left")
    return joined.filter(F.col(detail).isNull() | (F.col(detail) == "")).select(*left.columns)


def with_formats(df: DataFrame, always: list[str], produced_by: dict[str, list[str]], requested: list[str]) -> DataFrame:
    """Only the columns that the requested output formats stand for."""
    keep = list(always)
    for name in requested:
        keep += [c for c in produced_by[name] if c not in keep]
    return df.select(*keep)


def index_candidates(
    entries: DataFrame, key: list[str], now: Column, max_age: str, min_age: str | None = None,
    needs_screenshot: bool = False, wait_ms: int | None = None, order_tail: list[str] | None = None, n: int = 5,
) -> DataFrame:
    """Usable index entries per page, newest first, at most ``n``."""
    created = F.col("created_at")
    ok = created >= now - F.expr(f"INTERVAL {max_age}")
    if min_age is not None:
        ok = ok & (created <= now - F.expr(f"INTERVAL {min_age}"))
    if needs_screenshot:
        ok = ok & F.col("has_screenshot")
    if wait_ms is not None:
        ok = ok & (F.coalesce("wait_time_ms", F.lit(0)) >= wait_ms)
    return newest_per_key(entries.filter(ok), key, [created.desc(), *(order_tail or [])], n, "position")


def search_eligible(status: Column, markdown: Column, has_auth: Column) -> Column:
    """2xx, at least 200 characters, fetched without credentials."""
    return (status >= 200) & (status < 300) & (F.length(F.coalesce(markdown, F.lit(""))) >= 200) & ~has_auth


def stable_sample(df: DataFrame, key: str, rate: float, grain: int = 10_000) -> DataFrame:
    """The same rows for the same rate in every run."""
    word = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long")
    return df.filter(F.pmod(word, F.lit(grain)) < round(rate * grain))


def has_content(markdown: Column) -> Column:
    return F.regexp_like(F.coalesce(markdown, F.lit("")), F.lit(r"(?U)\S"))


def is_stale(now: Column, started: Column, updated: Column, created: Column, after: str = "1 HOUR") -> Column:
    return F.coalesce(started, updated, created) <= now - F.expr(f"INTERVAL {after}")


def retained(df: DataFrame, now: Column, status: str = "status", created: str = "created_at", group: str = "group_id") -> DataFrame:
    """What is left after dropping ungrouped finished (1 h) and failed (6 h) jobs."""
    old = lambda age: F.col(created) < now - F.expr(f"INTERVAL {age}")
    expired = F.col(group).isNull() & (
        ((F.col(status) == "completed") & old("1 HOUR")) | ((F.col(status) == "failed") & old("6 HOURS"))
    )
    return df.filter(~F.coalesce(expired, F.lit(False)))
