"""Structured Streaming jobs, run to the end of the stored events."""

from pyspark.sql import functions as F

from .. import schemas
from ..operators import usage
from ..session import work_path
from ..streaming import events as stream
from ..streaming.pages import page_events
from ..streaming.stale import STORE, stale_jobs
from . import derived
from .derived import USAGE_SQL
from .registry import query


class _StreamTables:
    """Streaming twin of ``Tables`` for the events."""

    def __init__(self, t):
        self.events = stream.table_stream(t.spark, t.folder, "events.parquet", schemas.EVENTS)


def _finish(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query("R1_usage_stream", f"""
SELECT team_id, subscription_id, endpoint, is_extract, api_key_id, CAST(sum(credits) AS BIGINT) AS total_credits,
 CAST(coalesce(sum(credits) FILTER (WHERE NOT tracked), 0) AS BIGINT) AS untracked_credits, count(*) AS operations
FROM {USAGE_SQL} WHERE NOT starts_with(team_id, 'preview_') GROUP BY ALL""")
def r1(t):
    ops = derived.usage_ops(_StreamTables(t))
    path = work_path(t.spark, "usage")
    _finish(stream.bill_usage(ops, path, work_path(t.spark, "usage-cp"), interval=None))
    return stream.billed_totals(t.spark, path)


@query("R2_first_seen_stream", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def r2(t):
    # The key holds the day, so all repeats of a key lie within 24 hours.
    rows = _StreamTables(t).events.withColumn("day", F.to_date("ts")).withColumn("at", F.col("ts").cast("timestamp"))
    first = stream.first_seen(rows, ["user_id", "event_type", "day"], "at").select("user_id", "event_type", "day")
    path = work_path(t.spark, "first-seen")
    _finish(stream.append_rows(first, path, work_path(t.spark, "first-seen-cp")))
    return t.spark.read.parquet(path)


@query("R3_page_event_stream", """
WITH p AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_id % 13 = 0 AS gone,
 lag(CAST(json_extract_string(props, '$.k') AS VARCHAR)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS pk FROM events)
SELECT event_id, CASE WHEN gone THEN 'removed' WHEN pk IS NULL THEN 'new'
 WHEN list_sort(string_split(k, '')) = list_sort(string_split(pk, '')) THEN 'same' ELSE 'changed' END AS status FROM p""")
def r3(t):
    rows = _StreamTables(t).events.withColumn("status_code", F.when(F.pmod("event_id", F.lit(13)) == 0, 404).otherwise(200))
    out = page_events(rows, ["user_id", "event_type"], "ts", "props", "status_code", "event_id")
    path = work_path(t.spark, "page-events")
    _finish(stream.append_rows(out, path, work_path(t.spark, "page-events-cp")))
    return t.spark.read.parquet(path).select("event_id", "status")


@query("R4_request_rates", """
SELECT date_trunc('minute', ts) AS minute, mode, count(*) AS requests, CASE mode WHEN 'browser' THEN 2 WHEN 'scrape' THEN 100 ELSE 500 END AS rate_limit,
 count(*) > CASE mode WHEN 'browser' THEN 2 WHEN 'scrape' THEN 100 ELSE 500 END AS over FROM (
 SELECT ts, CASE event_type WHEN 'click' THEN 'browser' WHEN 'view' THEN 'scrape' ELSE 'other' END AS mode FROM events) GROUP BY 1, 2""")
def r4(t):
    mode = F.when(F.col("event_type") == "click", "browser").when(F.col("event_type") == "view", "scrape").otherwise("other")
    rows = _StreamTables(t).events.select(F.col("ts").cast("timestamp").alias("at"), mode.alias("mode"))
    path = work_path(t.spark, "rates")
    rates = stream.request_rates(rows, "mode", "at")
    _finish(stream.per_batch(rates, path, work_path(t.spark, "rates-cp"), lambda b: b, mode="update"))
    final = stream.latest_per_window(t.spark, path, ["minute", "mode"])
    return stream.over_limit(final, usage.rate_limit(F.col("mode"))).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("R5_append_stream", "SELECT event_id, user_id, value FROM events")
def r5(t):
    path = work_path(t.spark, "rows")
    _finish(stream.append_rows(_StreamTables(t).events, path, work_path(t.spark, "rows-cp")))
    return t.spark.read.parquet(path).select("event_id", "user_id", "value")


@query("R6_stale_stream", """
WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, bool_or(event_type = 'purchase') AS ended FROM events GROUP BY 1, 2),
n AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) AS next_ms, max(ms) OVER () AS last_ms FROM e)
SELECT user_id, make_timestamp(ms * 1000) AS last_seen, make_timestamp((ms + 3600000) * 1000) AS stale_at FROM n
WHERE NOT ended AND coalesce(next_ms > ms + 3600000, true) AND ms + 3600000 < last_ms - 600000""")
def r6_stream(t):
    # Three files, which are one micro-batch each; rows near a border come up to eight minutes late, in the next one.
    folder = work_path(t.spark, "signs")
    first, last = t.events.agg(F.min("ts"), F.max("ts")).first()
    arrives = F.col("ts") + F.make_dt_interval(mins=F.pmod("event_id", F.lit(9)).cast("int"))
    place = F.least(F.floor((F.unix_micros(arrives.cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp")))
                            / (F.unix_micros(F.lit(last).cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp")) + 1) * 3), F.lit(2))
    for k in range(3):
        t.events.filter(place == k).coalesce(1).write.mode("append").parquet(folder)
    rows = stream.table_stream(t.spark, folder, "*.parquet", schemas.EVENTS, files_per_batch=1)
    out = stale_jobs(rows, ["user_id"], "ts", F.col("event_type") == "purchase")
    path = work_path(t.spark, "stale")
    before = t.spark.conf.get(STORE[0])
    t.spark.conf.set(*STORE)
    try:
        _finish(stream.append_rows(out, path, work_path(t.spark, "stale-cp")))
    finally:
        t.spark.conf.set(STORE[0], before)
    return t.spark.read.parquet(path).select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_seen", "stale_at")])
