"""Credits: grouping, pricing rules, refunds, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS_PER_CREDIT = 15

# Surcharge per requested output format.
FORMAT_SURCHARGE = {"question": 4, "highlights": 4, "audio": 4, "video": 4}
OPTION_SURCHARGE = 4
X_POST_SURCHARGE = 29

# Refund rules by job kind: (ratings, flat credits, percent, cap).
REFUND_RULES = {
    "search": (["good", "partial", "bad"], 1, None, None),
    "map": (["partial", "bad"], 1, None, None),
    "parse": (["partial", "bad"], None, 0.25, 10),
    "scrape_pdf": (["partial", "bad"], None, 0.25, 10),
    "scrape_addon": (["partial", "bad"], None, 0.25, 5),
    "scrape": (["partial", "bad"], 1, None, None),
}

# Requests per minute by mode, and the default for others.
RATE_LIMITS = {
    "crawl": 15, "scrape": 100, "search": 100, "map": 100, "extract": 100, "preview": 25,
    "extractStatus": 25000, "crawlStatus": 25000, "extractAgentPreview": 10, "scrapeAgentPreview": 10,
    "browser": 2, "browserExecute": 10, "account": 1000, "supportAsk": 3, "supportDocsSearch": 3, "research": 100,
}
DEFAULT_RATE_LIMIT = 500
RAISED_MODES = {"scrape": 100, "search": 100}


def billing_groups(ops: DataFrame) -> DataFrame:
    """Usage per (team, subscription, endpoint, extract flag, key); previews are free.

    NULL keys form their own group.  ``untracked_credits`` is the part not yet
    reported while the request ran.
    """
    free = (F.col("team_id") == "preview") | F.col("team_id").startswith("preview_")
    return ops.filter(~free).groupBy(
        "team_id", "subscription_id", "endpoint", "is_extract", "api_key_id"
    ).agg(
        F.sum("credits").alias("total_credits"),
        F.coalesce(F.sum(F.when(~F.col("tracked"), F.col("credits"))), F.lit(0)).alias("untracked_credits"),
        F.count(F.lit(1)).alias("operations"),
    )


def tokens(credits: Column) -> Column:
    return credits * TOKENS_PER_CREDIT


def search_credits(results: Column, zero_retention: Column) -> Column:
    return (F.ceil(results / 10) * F.when(zero_retention, 10).otherwise(2)).cast("long")


def page_credits(
    formats: Column, *, lockdown: Column, json_change_tracking: Column, generated_script: Column, pages: Column,
    parses_pdf: Column, redact: Column, proxy: Column, zero_retention: Column, x_post: Column,
    unblocked: Column, retention_cost: int = 1, page_cost: int = 1, unblocked_cost: int = 4,
) -> Column:
    """Credits of one fetched page from its options and outcome.

    JSON output sets the price, generated extractors override it, everything
    else adds to it.
    """
    has = lambda f: F.array_contains(formats, f)
    base = (
        F.when(has("deterministicJson"), F.when(generated_script, 10).otherwise(3))
        .when(has("json") | json_change_tracking, 5)
        .when(lockdown, 1 + OPTION_SURCHARGE)
        .otherwise(1)
    )
    add = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    extra_pages = F.when(parses_pdf & (pages > 1), pages - 1).otherwise(0)
    total = base + add(has("question") | has("query"), FORMAT_SURCHARGE["question"])
    for name in ("highlights", "audio", "video"):
        total = total + add(has(name), FORMAT_SURCHARGE[name])
    return (
        total + add(x_post, X_POST_SURCHARGE) + add(zero_retention & ~lockdown, retention_cost)
        + extra_pages * page_cost + add(redact, OPTION_SURCHARGE) + F.when(redact, extra_pages * OPTION_SURCHARGE).otherwise(0)
        + add(proxy == "stealth", OPTION_SURCHARGE) + add(unblocked, unblocked_cost)
    )


def projected_credits(formats: Column, *, json_change_tracking: Column, zero_retention: Column, redact: Column, proxy: Column, lockdown: Column, retention_cost: int = 1) -> Column:
    """What a page is expected to cost before it is fetched: dearest script price, any premium proxy."""
    return page_credits(
        formats, lockdown=lockdown, json_change_tracking=json_change_tracking, generated_script=F.lit(True),
        pages=F.lit(0), parses_pdf=F.lit(False), redact=redact,
        proxy=F.when(proxy.isin("stealth", "enhanced", "auto"), "stealth"),
        zero_retention=zero_retention, x_post=F.lit(False), unblocked=F.lit(False), retention_cost=retention_cost,
    )


def target_base_credits(formats: Column, lockdown: Column) -> Column:
    """Price of one monitored page by its target's options (proxy not included)."""
    has = lambda f: F.array_contains(formats, f)
    base = (
        F.when(has("deterministicJson"), 7).when(has("json"), 5)
        .when(lockdown, 1 + OPTION_SURCHARGE).otherwise(1)
    )
    for names in (("question", "query"), ("highlights",), ("audio",), ("video",)):
        hit = has(names[0])
        for n in names[1:]:
            hit = hit | has(n)
        base = base + F.when(hit, OPTION_SURCHARGE).otherwise(0)
    return base


def monitored_page_credits(
    status: Column, recorded: Column, pages: Column, used_proxy: Column, x_post: Column, judged: Column,
    target_base: Column, target_parses_pdf: Column, target_proxy: Column,
) -> Column:
    """Recorded price wins; otherwise status, page count and proxy decide; judging adds one."""
    premium = lambda c: F.coalesce(c.isin("stealth", "enhanced"), F.lit(False))
    estimate = (
        F.coalesce(target_base, F.lit(1))
        + F.when(F.coalesce(target_parses_pdf, F.lit(False)) & (pages > 1), pages - 1).otherwise(0)
        + F.when(premium(used_proxy) | (used_proxy.isNull() & premium(target_proxy)), OPTION_SURCHARGE).otherwise(0)
        + F.when(F.coalesce(x_post, F.lit(False)), X_POST_SURCHARGE).otherwise(0)
    )
    by_status = F.when(status == "removed", 0).when(status == "error", 1).otherwise(estimate)
    return F.coalesce(recorded, by_status) + F.when(judged, 1).otherwise(0)


def refund(kind: Column, rating: Column, billed: Column) -> Column:
    """Credits to give back for feedback; 0 where nothing was billed or the rating does not count."""
    paid = F.greatest(F.lit(0), F.coalesce(billed, F.lit(0)))
    out = F.when(paid <= 0, F.lit(0))
    for name, (ratings, flat, percent, cap) in REFUND_RULES.items():
        amount = F.least(F.lit(flat), paid) if flat is not None else F.least(F.ceil(paid * percent), F.lit(cap), paid)
        out = out.when((kind == name) & rating.isin(ratings), amount)
    return out.otherwise(0).cast("long")


def quota(teams: DataFrame, asked: Column) -> DataFrame:
    """Remaining credits, projected use and pass/fail per team."""
    over = F.col("graceful") & F.col("auto_recharge")
    total = F.coalesce("total_credits", F.lit(100_000_000))
    extra = F.when(over, F.col("price_credits")).otherwise(0)
    used = F.col("credits_used")
    return teams.select(
        "team_id",
        over.alias("allow_overages"),
        (F.col("remaining_credits") + extra).alias("remaining_credits"),
        (used + asked).alias("credits_will_be_used"),
        (total + extra).alias("total_price_credits"),
        (used / total).alias("usage_share"),
        (used + asked <= total + extra).alias("success"),
    )


def signed_balance(granted: Column, usage: Column, remaining: Column, unlimited: Column) -> Column:
    return F.when(unlimited, F.coalesce(remaining, F.lit(0))).otherwise(
        F.coalesce(granted, F.lit(0)) - F.coalesce(usage, F.lit(0)))


def period_start(reset: Column, interval: Column) -> Column:
    """Reset date minus its interval, the day clamped to the target month."""
    return F.when(interval == "month", F.add_months(reset, -1)).when(interval == "year", F.add_months(reset, -12))


def rate_limit(mode: Column) -> Column:
    out = None
    for name, limit in RATE_LIMITS.items():
        limit = max(limit, RAISED_MODES.get(name, 0))
        out = F.when(mode == name, limit) if out is None else out.when(mode == name, limit)
    return out.otherwise(DEFAULT_RATE_LIMIT)
