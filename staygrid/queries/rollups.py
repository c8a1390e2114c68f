"""Aggregations and usage accounting."""

from pyspark.sql import functions as F

from ..operators import filters, joins, rollups, usage
from . import derived
from .derived import USAGE_SQL
from .registry import query
from .relational import STATUS_NAMES, check_pages

ALL_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
              "labels conversations").split()


def _dec(c):
    return F.col(c).cast("decimal(18,2)")


@query("A1_table_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in ALL_TABLES))
def a1(t):
    return rollups.table_counts({n: getattr(t, n) for n in ALL_TABLES})


@query("A2_documents_and_sources", "SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_sources FROM documents")
def a2(t):
    return t.documents.agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("source").alias("n_sources"))


@query("A3_source_list", "SELECT DISTINCT source FROM documents ORDER BY source")
def a3(t):
    return t.documents.select("source").distinct().orderBy("source")


@query("A4_hotel_offers", """
SELECT l_orderkey AS hotel_id, coalesce(min(CASE WHEN price > 0 THEN price END), 0) AS lowest_price,
 coalesce(max(CASE WHEN price > 0 THEN price END), 0) AS highest_price,
 string_agg(DISTINCT ci, ', ' ORDER BY ci) AS checkin_dates, string_agg(DISTINCT co, ', ' ORDER BY co) AS checkout_dates,
 string_agg(CASE WHEN price <> 0 THEN p_name || ' (' || format('{:,}', CAST(floor(price) AS BIGINT)) || ' VND)' ELSE p_name END, '; '
   ORDER BY l_linenumber, l_partkey, l_suppkey, price) AS rooms
FROM (SELECT *, CASE WHEN l_discount = 0.05 THEN 0 ELSE l_extendedprice END AS price, strftime(l_shipdate, '%Y-%m-%d') AS ci,
  strftime(l_shipdate + INTERVAL 1 DAY, '%Y-%m-%d') AS co FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def a4(t):
    bookings = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("hotel_id"), "l_linenumber", "l_partkey", "l_suppkey", F.col("p_name").alias("room_name"),
        F.when(F.col("l_discount") == 0.05, 0.0).otherwise(F.col("l_extendedprice")).alias("current_price"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("checkin"),
        F.date_format(F.date_add(F.to_date("l_shipdate"), 1), "yyyy-MM-dd").alias("checkout"))
    return rollups.hotel_offers(bookings, "hotel_id", ["l_linenumber", "l_partkey", "l_suppkey", "current_price"])


@query("A5_warehouse_summary", """
SELECT (SELECT count(*) FROM supplier) AS hotels, (SELECT count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem) AS room_types,
 (SELECT count(*) FROM lineitem) AS bookings,
 (SELECT round(coalesce(CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(s_acctbal), 0), 4) FROM supplier) AS mean_score""")
def a5(t):
    facts = t.lineitem.agg(F.countDistinct("l_suppkey", "l_partkey").alias("room_types"), F.count(F.lit(1)).alias("bookings"))
    h = t.supplier.agg(
        F.count(F.lit(1)).alias("hotels"),
        F.round(F.coalesce(F.sum(_dec("s_acctbal")).cast("double") / F.count("s_acctbal"), F.lit(0.0)), 4).alias("mean_score"))
    return h.select("hotels", facts.select("room_types").scalar().alias("room_types"),
                    facts.select("bookings").scalar().alias("bookings"), "mean_score")


@query("A6_status_summary", "SELECT user_id, count(*) AS total, " + ", ".join(
    f"count(*) FILTER (WHERE k % 5 = {i}) AS {s}" for i, s in enumerate(STATUS_NAMES))
    + " FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1")
def a6(t):
    return rollups.status_summary(check_pages(t), ["user_id"], "status", STATUS_NAMES)


JOB_STATUS_SQL = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'active' WHEN 'click' THEN 'queued' ELSE 'failed' END"


def _jobs(t):
    e = F.col("event_type")
    status = F.when(e == "purchase", "completed").when(e == "view", "active").when(e == "click", "queued").otherwise("failed")
    return t.events.withColumn("status", status)


def _group_stats(t):
    waiting = t.events.filter(F.get_json_object("props", "$.k").cast("int") > 50)
    return rollups.group_stats(_jobs(t), "user_id", "status", waiting)


STATS_SQL = f"""(SELECT user_id, {JOB_STATUS_SQL} AS status, count(*) AS n FROM events GROUP BY 1, 2
UNION ALL SELECT user_id, 'backlog' AS status, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 GROUP BY 1)"""


@query("A7_group_stats", f"SELECT * FROM {STATS_SQL}")
def a7(t):
    return _group_stats(t)


@query("A8_crawl_progress", f"""
SELECT user_id, completed, active, queued, backlog, completed + active + queued + backlog AS total, seconds FROM (
 SELECT user_id, CAST(coalesce(sum(n) FILTER (WHERE status = 'completed'), 0) AS BIGINT) AS completed,
  CAST(coalesce(sum(n) FILTER (WHERE status = 'active'), 0) AS BIGINT) AS active,
  CAST(coalesce(sum(n) FILTER (WHERE status = 'queued'), 0) AS BIGINT) AS queued,
  CAST(coalesce(sum(n) FILTER (WHERE status = 'backlog'), 0) AS BIGINT) AS backlog FROM {STATS_SQL} GROUP BY 1)
JOIN (SELECT user_id, greatest(0, CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT)) AS seconds FROM events GROUP BY 1) USING (user_id)""")
def a8(t):
    span = t.events.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = span.select("user_id", rollups.duration_seconds(F.col("a"), F.col("b")).alias("seconds"))
    return rollups.crawl_progress(_group_stats(t), "user_id").join(seconds, "user_id")


@query("A9_billing_groups", f"""
SELECT team_id, subscription_id, endpoint, is_extract, api_key_id, CAST(sum(credits) AS BIGINT) AS total_credits,
 CAST(coalesce(sum(credits) FILTER (WHERE NOT tracked), 0) AS BIGINT) AS untracked_credits, count(*) AS operations
FROM {USAGE_SQL} WHERE team_id <> 'preview' AND NOT starts_with(team_id, 'preview_') GROUP BY ALL""")
def a9(t):
    return usage.billing_groups(derived.usage_ops(t))


@query("A10_monthly_usage", """
SELECT month AS start_date, CASE WHEN month < (SELECT max(date_trunc('month', o_orderdate)) FROM orders) THEN CAST(month + INTERVAL 1 MONTH AS DATE) END AS end_date,
 credits_used FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS credits_used
 FROM orders GROUP BY 1) ORDER BY 1""")
def a10(t):
    out = rollups.monthly(t.orders, "o_orderdate", _dec("o_totalprice"))
    return out.withColumn("credits_used", F.col("credits_used").cast("double")).orderBy("start_date")


@query("A11_monthly_usage_by_key", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS start_date,
 CASE WHEN date_trunc('month', o_orderdate) < (SELECT max(date_trunc('month', o_orderdate)) FROM orders)
  THEN CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) END AS end_date,
 coalesce(CASE WHEN n_nationkey % 4 <> 0 THEN n_name END, 'Unknown') AS api_key, count(*) AS credits_used
FROM orders LEFT JOIN nation ON o_custkey % 30 = n_nationkey GROUP BY ALL ORDER BY 1, 3""")
def a11(t):
    rows = t.orders.withColumn("api_key_id", F.pmod("o_custkey", F.lit(30)))
    by_id = rollups.monthly(rows, "o_orderdate", F.lit(1), ["api_key_id"])
    names = t.nation.select("n_nationkey", F.when(F.pmod("n_nationkey", F.lit(4)) != 0, F.col("n_name")).alias("n_name"))
    named = joins.with_names(by_id, "api_key_id", names, "n_nationkey", "n_name", "api_key", "Unknown")
    return rollups.collapsed_by_name(named, ["start_date", "end_date", "api_key"], "credits_used").orderBy("start_date", "api_key")


@query("A12_token_periods", """
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, CAST(sum(floor(value)) AS BIGINT) * 15 AS tokens_used FROM events GROUP BY 1""")
def a12(t):
    day = F.to_date("ts").alias("day")
    return t.events.groupBy(day).agg(usage.tokens(F.sum(F.floor("value"))).alias("tokens_used"))


@query("A13_check_credits", """
SELECT user_id, CAST(sum(coalesce(CASE WHEN k % 4 = 0 THEN k END, CASE WHEN k % 5 = 2 THEN 0 WHEN k % 5 = 3 THEN 1 ELSE
  base + CASE WHEN pdf AND k % 6 > 1 THEN k % 6 - 1 ELSE 0 END
  + CASE WHEN (k % 11 = 0) OR (k % 3 <> 0 AND k % 11 <> 0 AND user_id % 5 = 0) THEN 4 ELSE 0 END
  + CASE WHEN k % 13 = 0 THEN 29 ELSE 0 END END) + CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS credits
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE user_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 5 WHEN 2 THEN 5 ELSE 1 END AS base,
 user_id % 2 = 0 AS pdf FROM events) GROUP BY 1""")
def a13(t):
    user = F.col("user_id")
    formats = F.when(F.pmod(user, F.lit(4)) == 0, F.array(F.lit("deterministicJson"))).when(
        F.pmod(user, F.lit(4)) == 1, F.array(F.lit("json"))).otherwise(F.array(F.lit("markdown")))
    targets = t.events.select("user_id").distinct().select(
        "user_id", usage.target_base_credits(formats, F.pmod(user, F.lit(4)) == 2).alias("base"),
        (F.pmod(user, F.lit(2)) == 0).alias("pdf"),
        F.when(F.pmod(user, F.lit(5)) == 0, "stealth").otherwise("basic").alias("target_proxy"))
    k = F.col("k")
    credits = usage.monitored_page_credits(
        F.col("status"), F.when(F.pmod(k, F.lit(4)) == 0, k), F.pmod(k, F.lit(6)),
        F.when(F.pmod(k, F.lit(11)) == 0, "stealth").when(F.pmod(k, F.lit(3)) == 0, "basic"),
        F.pmod(k, F.lit(13)) == 0, F.col("event_type") == "signup",
        F.col("base"), F.col("pdf"), F.col("target_proxy"))
    return check_pages(t).join(targets, "user_id", "left").groupBy("user_id").agg(F.sum(credits).alias("credits"))


def _page_options(t):
    k = F.get_json_object("props", "$.k").cast("int")
    m = lambda n: F.pmod(F.col("k"), F.lit(n))
    e = F.col("event_type")
    formats = (F.when(e == "click", F.array(F.lit("json"), F.lit("question")))
               .when(e == "view", F.array(F.lit("markdown"), F.lit("highlights"), F.lit("audio")))
               .when(e == "signup", F.array(F.lit("deterministicJson")))
               .when(e == "error", F.array(F.lit("markdown"))).otherwise(F.array(F.lit("query"), F.lit("video"))))
    return t.events.withColumn("k", k).select(
        "event_id", "user_id", formats.alias("formats"), (m(7) == 0).alias("lockdown"), (m(9) == 0).alias("ct_json"),
        (m(2) == 0).alias("generated"), m(6).alias("pages"), (m(4) != 0).alias("pdf"), (m(5) == 0).alias("redact"),
        F.when(m(3) == 0, "stealth").when(m(3) == 1, "auto").otherwise("basic").alias("proxy"),
        (m(8) == 0).alias("zero_retention"), (m(17) == 0).alias("x_post"), (m(19) == 0).alias("unblocked"))


BASE_CREDIT_SQL = """CASE WHEN event_type = 'signup' THEN {script} WHEN event_type = 'click' OR k % 9 = 0 THEN 5 WHEN k % 7 = 0 THEN 5 ELSE 1 END
 + CASE WHEN event_type IN ('click', 'purchase') THEN 4 ELSE 0 END + CASE WHEN event_type = 'view' THEN 8 ELSE 0 END
 + CASE WHEN event_type = 'purchase' THEN 4 ELSE 0 END + CASE WHEN k % 8 = 0 AND k % 7 <> 0 THEN 1 ELSE 0 END"""
EVENTS_K_SQL = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


@query("A14_page_credits", f"""
SELECT event_id, CAST(base + x + CASE WHEN k % 5 = 0 THEN 4 + x * 4 ELSE 0 END + CASE WHEN k % 17 = 0 THEN 29 ELSE 0 END
 + CASE WHEN k % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN k % 19 = 0 THEN 4 ELSE 0 END AS BIGINT) AS credits,
 CAST(projected + CASE WHEN k % 5 = 0 THEN 4 ELSE 0 END + CASE WHEN k % 3 <> 2 THEN 4 ELSE 0 END AS BIGINT) AS projected FROM (
 SELECT *, CASE WHEN k % 4 <> 0 AND k % 6 > 1 THEN k % 6 - 1 ELSE 0 END AS x,
  {BASE_CREDIT_SQL.format(script="CASE WHEN k % 2 = 0 THEN 10 ELSE 3 END")} AS base, {BASE_CREDIT_SQL.format(script="10")} AS projected FROM {EVENTS_K_SQL})""")
def a14(t):
    c = F.col
    spent = usage.page_credits(
        c("formats"), lockdown=c("lockdown"), json_change_tracking=c("ct_json"), generated_script=c("generated"),
        pages=c("pages"), parses_pdf=c("pdf"), redact=c("redact"), proxy=c("proxy"),
        zero_retention=c("zero_retention"), x_post=c("x_post"), unblocked=c("unblocked"))
    expected = usage.projected_credits(
        c("formats"), json_change_tracking=c("ct_json"), zero_retention=c("zero_retention"), redact=c("redact"),
        proxy=c("proxy"), lockdown=c("lockdown"))
    return _page_options(t).select("event_id", spent.cast("long").alias("credits"), expected.cast("long").alias("projected"))


@query("A15_search_credits", """
SELECT user_id, event_type, CAST(ceil(count(*) / 10.0) AS BIGINT) * CASE WHEN user_id % 5 = 0 THEN 10 ELSE 2 END AS credits
FROM events GROUP BY user_id, event_type""")
def a15(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", "event_type", usage.search_credits(F.col("n"), F.pmod("user_id", F.lit(5)) == 0).alias("credits"))


@query("A18_url_budgets", """
SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS budget, count(*) AS event_count FROM lineitem GROUP BY 1""")
def a18(t):
    return t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("budget"), F.count(F.lit(1)).alias("event_count"))


@query("A19_first_values", """
SELECT user_id, arg_min(event_type, event_id) FILTER (WHERE event_type <> '') AS event_type,
 arg_min(amount, event_id) FILTER (WHERE amount IS NOT NULL AND amount <> 0) AS amount,
 arg_min(note, event_id) FILTER (WHERE note IS NOT NULL AND note <> '') AS note FROM (
 SELECT user_id, event_id, event_type, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 0 ELSE value END AS amount,
  CASE WHEN k % 2 = 0 THEN '' ELSE props END AS note FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)) GROUP BY 1""")
def a19(t):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t.events.select(
        "user_id", "event_id", "event_type",
        F.when(F.pmod(k, F.lit(3)) == 1, 0.0).when(F.pmod(k, F.lit(3)) == 2, F.col("value")).alias("amount"),
        F.when(F.pmod(k, F.lit(2)) == 0, "").otherwise(F.col("props")).alias("note"))
    return rollups.first_values(rows, "user_id", "event_id", ["event_type", "amount", "note"])


@query("A20_refunds_today", """
SELECT user_id, CAST(sum(CAST(coalesce(CASE WHEN event_type <> 'view' THEN value END, 0) AS DECIMAL(18,2))) AS DOUBLE) AS refunded
FROM events WHERE ts >= date_trunc('day', TIMESTAMP '2024-01-30 18:30:00') GROUP BY 1""")
def a20(t):
    now = F.lit("2024-01-30 18:30:00").cast("timestamp_ntz")
    today = t.events.filter(F.col("ts") >= F.date_trunc("day", now).cast("timestamp_ntz"))
    amount = F.coalesce(F.when(F.col("event_type") != "view", F.col("value")), F.lit(0.0)).cast("decimal(18,2)")
    return today.groupBy("user_id").agg(F.sum(amount).cast("double").alias("refunded"))


@query("A21_refund_policy", """
SELECT event_id, CAST(CASE WHEN billed <= 0 THEN 0
 WHEN kind = 'search' THEN least(1, billed)
 WHEN rating = 'good' THEN 0
 WHEN kind IN ('map', 'scrape') THEN least(1, billed)
 WHEN kind IN ('parse', 'scrape_pdf') THEN least(CAST(ceil(billed * 0.25) AS BIGINT), 10, billed)
 ELSE least(CAST(ceil(billed * 0.25) AS BIGINT), 5, billed) END AS BIGINT) AS refund FROM (
 SELECT event_id, CAST(floor(value) AS BIGINT) AS billed, ['good', 'partial', 'bad'][CAST(user_id % 3 AS INTEGER) + 1] AS rating,
  CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'map' WHEN 'signup' THEN 'parse' WHEN 'error' THEN 'scrape_pdf'
   ELSE CASE WHEN user_id % 2 = 0 THEN 'scrape_addon' ELSE 'scrape' END END AS kind FROM events)""")
def a21(t):
    e = F.col("event_type")
    kind = (F.when(e == "click", "search").when(e == "view", "map").when(e == "signup", "parse").when(e == "error", "scrape_pdf")
            .when(F.pmod("user_id", F.lit(2)) == 0, "scrape_addon").otherwise("scrape"))
    rating = F.element_at(F.array(F.lit("good"), F.lit("partial"), F.lit("bad")), (F.pmod("user_id", F.lit(3)) + 1).cast("int"))
    return t.events.select("event_id", usage.refund(kind, rating, F.floor("value")).alias("refund"))


@query("A22_costs_by_type", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS main_calls,
 CAST(coalesce(sum(cost) FILTER (WHERE event_type = 'purchase'), 0) AS DOUBLE) AS main_cost,
 count(*) FILTER (WHERE event_type <> 'purchase') AS other_calls,
 CAST(coalesce(sum(cost) FILTER (WHERE event_type <> 'purchase'), 0) AS DOUBLE) AS other_cost, CAST(sum(cost) AS DOUBLE) AS total_cost
FROM (SELECT *, CAST(CASE WHEN user_id % 9 = 0 THEN 0 ELSE value END AS DECIMAL(18,2)) AS cost FROM events) GROUP BY 1""")
def a22(t):
    calls = t.events.withColumn("value", F.when(F.pmod("user_id", F.lit(9)) == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return rollups.costs_by_type(calls, ["user_id"], "event_type", "value", "purchase")


@query("A23_documents_and_credits", """
SELECT l_orderkey, count(*) AS documents, CAST(sum(coalesce(CASE WHEN l_discount > 0 THEN l_quantity END, 0)) AS BIGINT) AS credits
FROM lineitem GROUP BY 1""")
def a23(t):
    credit = F.when(F.col("l_discount") > 0, F.col("l_quantity"))
    return t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce(credit, F.lit(0))).cast("long").alias("credits"))


@query("A24_quota_check", """
SELECT team_id, over AS allow_overages, remaining + CASE WHEN over THEN 500 ELSE 0 END AS remaining_credits, used + 100 AS credits_will_be_used,
 coalesce(total, 100000000) + CASE WHEN over THEN 500 ELSE 0 END AS total_price_credits, round(used / coalesce(total, 100000000), 6) AS usage_share,
 used + 100 <= coalesce(total, 100000000) + CASE WHEN over THEN 500 ELSE 0 END AS success FROM (
 SELECT c_custkey AS team_id, (c_custkey % 2 = 0) AND (c_custkey % 3 = 0) AS over, CAST(floor(c_acctbal) AS BIGINT) AS remaining,
  n AS used, CASE WHEN c_custkey % 5 <> 0 THEN 110 + c_custkey % 10 END AS total
 FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey)""")
def a24(t):
    used = t.orders.groupBy(F.col("o_custkey").alias("team_id")).agg(F.count(F.lit(1)).alias("credits_used"))
    key = F.col("c_custkey")
    teams = t.customer.select(
        key.alias("team_id"), (F.pmod(key, F.lit(2)) == 0).alias("graceful"), (F.pmod(key, F.lit(3)) == 0).alias("auto_recharge"),
        F.floor("c_acctbal").alias("remaining_credits"), F.lit(500).alias("price_credits"),
        F.when(F.pmod(key, F.lit(5)) != 0, 110 + F.pmod(key, F.lit(10))).alias("total_credits")).join(used, "team_id")
    return usage.quota(teams, F.lit(100)).withColumn("usage_share", F.round("usage_share", 6))


@query("A25_balance_and_period", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN round(coalesce(o_totalprice, 0), 2) ELSE round(100000 - o_totalprice, 2) END AS balance,
 CASE WHEN o_orderpriority LIKE '1%' THEN CAST(o_orderdate - INTERVAL 1 MONTH AS DATE) WHEN o_orderpriority LIKE '2%' THEN CAST(o_orderdate - INTERVAL 1 YEAR AS DATE) END AS period_start
FROM orders""")
def a25(t):
    interval = F.when(F.col("o_orderpriority").startswith("1"), "month").when(F.col("o_orderpriority").startswith("2"), "year").otherwise("one_off")
    balance = usage.signed_balance(F.lit(100000.0), F.col("o_totalprice"), F.col("o_totalprice"), F.col("o_orderstatus") == "P")
    return t.orders.select("o_orderkey", F.round(balance, 2).alias("balance"),
                           usage.period_start(F.to_date("o_orderdate"), interval).alias("period_start"))


@query("A26_queue_status_counts", f"""
SELECT {JOB_STATUS_SQL} AS status, count(*) AS n FROM events WHERE {JOB_STATUS_SQL} IN ('queued', 'active') GROUP BY 1""")
def a26(t):
    return _jobs(t).filter(F.col("status").isin("queued", "active")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("R6_jobs_without_finish", """
SELECT s.event_id FROM events s LEFT JOIN (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase') f
 ON f.user_id = s.user_id AND f.day = CAST(s.ts AS DATE)
WHERE s.event_type = 'signup' AND f.user_id IS NULL AND s.ts <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR""")
def r6(t):
    day = F.to_date("ts").alias("day")
    finished = t.events.filter(F.col("event_type") == "purchase").select("user_id", day).distinct()
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    started = t.events.filter(F.col("event_type") == "signup").withColumn("day", F.to_date("ts"))
    open_jobs = started.join(finished, ["user_id", "day"], "left_anti")
    return open_jobs.filter(filters.is_stale(now, F.col("ts"), F.col("ts"), F.col("ts"))).select("event_id")


@query("R7_activity_last_day", """
SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR
 AND ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY ALL""")
def r7(t):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    recent = t.events.filter((F.col("ts") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= now))
    return recent.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


TABLE_COLUMNS = {
    "region": "r_regionkey, r_name", "nation": "n_nationkey, n_name, n_regionkey",
    "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment", "supplier": "s_suppkey, s_name, s_nationkey, s_acctbal",
    "part": "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice",
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate",
    "events": "event_id, ts, user_id, event_type, value, props", "documents": "doc_id, text, lang, source, n_chars",
    "embeddings": "vec_id, embedding, label", "pages": "page_id, url, html", "benchmark": "item_id, text",
    "labels": "doc_id, quality, toxic", "conversations": "conv_id, turn, role, text",
}


@query("Q1_table_profile", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows, '{cols}' AS columns FROM {n}" for n, cols in TABLE_COLUMNS.items()))
def q1(t):
    from ..operators.quality import table_profile
    return table_profile({n: getattr(t, n) for n in ALL_TABLES}).select("table_name", "n_rows", "columns")


@query("Q3_key_checks", """
SELECT 'orders' AS table_name, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys,
 (SELECT count(*) FROM orders WHERE o_custkey IS NULL) AS null_keys
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)),
 (SELECT count(*) FROM lineitem WHERE l_partkey IS NULL)""")
def q3(t):
    from ..operators.quality import duplicate_keys, null_report

    def line(name, df, key, required):
        dup = duplicate_keys(df, key).agg(F.count(F.lit(1)).alias("duplicate_keys"))
        nulls = null_report(df, [required]).select("n_null").scalar()
        return dup.select(F.lit(name).alias("table_name"), "duplicate_keys", nulls.alias("null_keys"))

    return line("orders", t.orders, ["o_orderkey"], "o_custkey").unionByName(
        line("lineitem", t.lineitem, ["l_orderkey", "l_linenumber"], "l_partkey"))


@query("Q4_failed_rows", """
SELECT event_id, CASE WHEN k % 2 = 0 THEN 'CODE_' || (k % 7) ELSE 'UNKNOWN_ERROR' END AS error_code,
 CASE WHEN k % 2 = 0 THEN 'failed ' || user_id ELSE 'plain ' || user_id END AS message
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
WHERE event_type = 'error' AND NOT (k % 2 = 0 AND k % 7 = 3)""")
def q4(t):
    from ..operators.quality import failed_rows
    k = F.get_json_object("props", "$.k").cast("int")
    as_json = F.to_json(F.struct(F.concat(F.lit("CODE_"), F.pmod(k, F.lit(7))).alias("code"),
                                 F.concat(F.lit("failed "), "user_id").alias("message")))
    jobs = t.events.select(
        "event_id", F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.when(F.pmod(k, F.lit(2)) == 0, as_json).otherwise(F.concat(F.lit("plain "), "user_id")).alias("error"))
    return failed_rows(jobs, ["CODE_3"])
