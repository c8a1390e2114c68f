"""Filters, joins, windows and top-k over the star schema and the events."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import filters, joins, ordered, topk
from ..plans.tools import HOTEL_TOOLS
from ..session import cut_lineage
from . import derived
from .derived import (FACILITIES_SQL, HOTELS_SQL, LOCATIONS_SQL, NEARBY_SQL, REVIEWS_SQL, ROOM_PRICES_SQL,
                      ROOM_TYPES_SQL)
from .registry import query

NOW = "2024-01-31 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


# ---------------------------------------------------------------- tools (UD1)

PRICE_TOOL_SQL = f"""
SELECT h.hotel_name, r.room_type_name, p.current_price, p.checkin_date, p.checkout_date
FROM {ROOM_PRICES_SQL} p JOIN {HOTELS_SQL} h ON p.hotel_id = h.hotel_id
JOIN {ROOM_TYPES_SQL} r ON p.room_type_id = r.room_type_id
WHERE p.current_price <= 60000 AND p.checkin_date = DATE '1998-10-03'
ORDER BY p.current_price, h.hotel_name, p.booking_id LIMIT 50"""


@query("J1_hotels_by_price", PRICE_TOOL_SQL)
def j1(t):
    w = derived.warehouse(t)
    tables = {k: w[k] for k in ("hotels", "room_types", "room_prices")}
    return HOTEL_TOOLS.run(t.spark, "find-hotels-by-price", tables, max_price=60000, checkin_date="1998-10-03")


NEAR_SQL = f"""
SELECT h.hotel_name, n.place_name, n.distance_in_meters, l.full_address
FROM {NEARBY_SQL} n JOIN {HOTELS_SQL} h ON n.hotel_id = h.hotel_id JOIN {LOCATIONS_SQL} l ON n.hotel_id = l.hotel_id
WHERE n.place_name ILIKE '%RING%' AND n.distance_in_meters <= 500"""


@query("J7_hotels_near_attraction", NEAR_SQL + " ORDER BY n.distance_in_meters, h.hotel_name, n.place_name LIMIT 50")
def j7(t):
    w = derived.warehouse(t)
    tables = {k: w[k] for k in ("hotels", "hotel_nearby_places", "hotel_locations")}
    return HOTEL_TOOLS.run(t.spark, "find-hotels-near-attraction", tables, attraction_name="RING", max_distance_meters=500)


@query("UD1_hotel_details", f"""
SELECT hotel_id, hotel_name, description, stars_rating, review_count, popular_facilities, property_type,
  checkin_time_start, checkin_time_end, checkout_time_start, checkout_time_end
FROM {HOTELS_SQL} WHERE hotel_name ILIKE '%' || 'supplier#00000000' || '%' ORDER BY hotel_id LIMIT 5""")
def ud1_details(t):
    return HOTEL_TOOLS.run(t.spark, "get-hotel-details", {"hotels": derived.hotels(t)}, hotel_name_query="supplier#00000000")


@query("UD1_hotel_facilities", f"""
SELECT h.hotel_name, f.facility_name FROM {FACILITIES_SQL} f JOIN {HOTELS_SQL} h ON f.hotel_id = h.hotel_id
WHERE h.hotel_name ILIKE '%er#0000%'""")
def ud1_facilities(t):
    tables = {"hotels": derived.hotels(t), "hotel_facilities": derived.facilities(t)}
    return HOTEL_TOOLS.run(t.spark, "get-hotel-facilities", tables, hotel_name_query="er#0000")


@query("UD1_hotel_reviews", f"""
SELECT h.hotel_name, r.staff_score, r.facilities_score, r.cleanliness_score, r.comfort_score, r.value_for_money_score,
  r.location_score, r.free_wifi_score, r.average_score
FROM {REVIEWS_SQL} r JOIN {HOTELS_SQL} h ON r.hotel_id = h.hotel_id
WHERE h.hotel_name ILIKE '%supplier%' ORDER BY h.hotel_id LIMIT 5""")
def ud1_reviews(t):
    tables = {"hotels": derived.hotels(t), "hotel_reviews": derived.reviews(t)}
    return HOTEL_TOOLS.run(t.spark, "get-hotel-reviews", tables, hotel_name_query="supplier")


@query("J8_near_and_cheap", f"""
SELECT hotel_id, hotel_name FROM {HOTELS_SQL} WHERE hotel_id IN (
  SELECT hotel_id FROM {NEARBY_SQL} n WHERE place_name ILIKE '%ring%' AND distance_in_meters <= 200
) AND hotel_id IN (
  SELECT hotel_id FROM {ROOM_PRICES_SQL} p WHERE current_price <= 3000)""")
def j8(t):
    near = derived.nearby_places(t).filter(
        filters.contains_text(F.col("place_name"), "ring") & (F.col("distance_in_meters") <= 200))
    cheap = derived.room_prices(t).filter(F.col("current_price") <= 3000)
    both = derived.hotels(t).join(near, "hotel_id", "left_semi").join(cheap, "hotel_id", "left_semi")
    return both.select("hotel_id", "hotel_name")


# ------------------------------------------------------------------- filters

@query("F1_price_ceiling_on_date", """
SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_day FROM orders
WHERE o_totalprice <= 250000 AND o_orderdate = TIMESTAMP '1998-10-03 00:00:00'""")
def f1(t):
    hit = filters.price_on_date(t.orders, "o_totalprice", "o_orderdate", 250000, "1998-10-03")
    return hit.select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("o_day"))


@query("F2_contains_case_insensitive", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%' || 'RED_w%' || '%'")
def f2(t):
    return t.part.filter(filters.contains_text(F.col("p_name"), "RED_w%")).select("p_partkey", "p_name")


@query("F3_incomplete_records", """
SELECT c_custkey, c_name FROM customer LEFT JOIN (
  SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END) AS detail
  FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey WHERE detail IS NULL OR detail = ''""")
def f3(t):
    detail = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("")).alias("detail"))
    return filters.incomplete(t.customer.select("c_custkey", "c_name"), detail, ["c_custkey"], "detail")


@query("F4_display_columns", """
SELECT s_name AS "Hotel", s_suppkey AS "Id", s_acctbal AS "Balance" FROM supplier""")
def f4(t):
    return t.supplier.select(F.col("s_name").alias("Hotel"), F.col("s_suppkey").alias("Id"), F.col("s_acctbal").alias("Balance"))


@query("F5_requested_formats", "SELECT doc_id, source, lang, n_chars FROM documents")
def f5(t):
    produced = {"markdown": ["text"], "metadata": ["lang"], "stats": ["n_chars"]}
    return filters.with_formats(t.documents, ["doc_id", "source"], produced, ["metadata", "stats"])


def _index_entries(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        F.col("user_id"), F.col("event_id"), F.col("ts").alias("created_at"),
        (F.pmod(k, F.lit(2)) == 0).alias("has_screenshot"),
        F.when(F.pmod(k, F.lit(3)) != 0, k * 10).alias("wait_time_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
    )


ENTRIES_SQL = """(SELECT user_id, event_id, ts AS created_at, k % 2 = 0 AS has_screenshot,
 CASE WHEN k % 3 <> 0 THEN k * 10 END AS wait_time_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


@query("F14_index_candidates", f"""
SELECT user_id, event_id, position FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id) AS position FROM {ENTRIES_SQL}
 WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY AND created_at <= TIMESTAMP '{NOW}' - INTERVAL 2 DAY
   AND has_screenshot AND coalesce(wait_time_ms, 0) >= 100) WHERE position <= 5""")
def f14(t):
    hits = filters.index_candidates(
        _index_entries(t), ["user_id"], _now(), "20 DAYS", "2 DAYS", needs_screenshot=True, wait_ms=100,
        order_tail=["event_id"])
    return hits.select("user_id", "event_id", "position")


@query("F15_search_index_sample", """
SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND length(text) >= 200 AND source <> 'src3'
 AND CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 2500""")
def f15(t):
    docs = t.documents.withColumn("status", F.when(F.pmod("doc_id", F.lit(7)) == 0, 404).otherwise(200))
    ok = docs.filter(filters.search_eligible(F.col("status"), F.col("text"), F.col("source") == "src3"))
    return filters.stable_sample(ok, "doc_id", 0.25).select("doc_id")


@query("F16_documents_with_content", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\S')")
def f16(t):
    return t.documents.filter(filters.has_content(F.col("text"))).select("doc_id")


@query("F17_stale_checks", f"""
SELECT event_id FROM events WHERE coalesce(CASE WHEN event_type = 'view' THEN ts + INTERVAL 2 HOUR END,
 CASE WHEN event_type = 'click' THEN ts + INTERVAL 1 HOUR END, ts) <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR""")
def f17(t):
    ts = F.col("ts")
    started = F.when(F.col("event_type") == "view", ts + F.expr("INTERVAL 2 HOURS"))
    updated = F.when(F.col("event_type") == "click", ts + F.expr("INTERVAL 1 HOUR"))
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return t.events.filter(filters.is_stale(now, started, updated, ts)).select("event_id")


@query("F18_retained_jobs", f"""
SELECT event_id FROM (SELECT event_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
 ELSE 'queued' END AS status, CASE WHEN user_id % 2 = 0 THEN user_id END AS group_id FROM events)
WHERE NOT (group_id IS NULL AND ((status = 'completed' AND ts < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR)
  OR (status = 'failed' AND ts < TIMESTAMP '{NOW}' - INTERVAL 6 HOUR)))""")
def f18(t):
    jobs = t.events.select(
        "event_id", F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
        .otherwise("queued").alias("status"),
        F.when(F.pmod("user_id", F.lit(2)) == 0, F.col("user_id")).alias("group_id"))
    return filters.retained(jobs, _now()).select("event_id")


# --------------------------------------------------------------------- joins

@query("J2_flat_star", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
 o_orderstatus, o_totalprice, o_orderpriority, p_name, p_brand, p_type, p_size, p_retailprice, s_name, s_nationkey,
 s_acctbal, c_name, c_mktsegment, c_acctbal
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN customer ON o_custkey = c_custkey""")
def j2(t):
    # Customers go to the orders first: those are fewer and narrower than the joined lines, which then are not shuffled once more.
    orders = joins.star(t.orders, [(t.customer, "o_custkey", "c_custkey")])
    wide = joins.star(t.lineitem, [
        (t.supplier, "l_suppkey", "s_suppkey"), (t.part, "l_partkey", "p_partkey"), (orders, "l_orderkey", "o_orderkey")])
    return wide.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus", "o_orderstatus", "o_totalprice", "o_orderpriority", "p_name", "p_brand", "p_type", "p_size",
        "p_retailprice", "s_name", "s_nationkey", "s_acctbal", "c_name", "c_mktsegment", "c_acctbal")


@query("J3_dimension_join", f"""
SELECT h.hotel_id, hotel_name, stars_rating, full_address, city, country, average_score
FROM {HOTELS_SQL} h LEFT JOIN {LOCATIONS_SQL} l ON h.hotel_id = l.hotel_id
LEFT JOIN {REVIEWS_SQL} r ON h.hotel_id = r.hotel_id""")
def j3(t):
    return (derived.hotels(t).join(derived.locations(t), "hotel_id", "left")
            .join(derived.reviews(t), "hotel_id", "left")
            .select("hotel_id", "hotel_name", "stars_rating", "full_address", "city", "country", "average_score"))


@query("J4_per_hotel_lookups", """
SELECT o_orderkey, coalesce(n_lines, 0) AS n_lines, first_day, last_day, coalesce(days, '') AS days FROM orders LEFT JOIN (
 SELECT l_orderkey, count(*) AS n_lines, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day,
  string_agg(DISTINCT strftime(l_shipdate, '%Y-%m-%d'), ', ' ORDER BY strftime(l_shipdate, '%Y-%m-%d')) AS days
 FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def j4(t):
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    per = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.to_date(F.min("l_shipdate")).alias("first_day"),
        F.to_date(F.max("l_shipdate")).alias("last_day"),
        F.array_join(F.sort_array(F.collect_set(day)), ", ").alias("days"))
    return (t.orders.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "first_day", "last_day",
                    F.coalesce("days", F.lit("")).alias("days")))


@query("J5_names_with_default", """
SELECT event_id, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_name END, 'Unknown') AS key_name
FROM events LEFT JOIN customer ON user_id = c_custkey""")
def j5(t):
    names = t.customer.select("c_custkey", F.when(F.pmod("c_custkey", F.lit(4)) != 0, F.col("c_name")).alias("c_name"))
    return joins.with_names(t.events, "user_id", names, "c_custkey", "c_name", "key_name", "Unknown").select("event_id", "key_name")


@query("J6_names_with_id_fallback", """
SELECT l_orderkey, l_linenumber, coalesce(p_name, CAST(l_partkey AS VARCHAR), 'Phòng không xác định') AS room_name
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON l_partkey = p_partkey""")
def j6(t):
    named = t.part.filter(F.col("p_size") <= 40)
    fallback = F.coalesce(F.col("l_partkey").cast("string"), F.lit("Phòng không xác định"))
    out = joins.with_names(t.lineitem, "l_partkey", named, "p_partkey", "p_name", "room_name", fallback)
    return out.select("l_orderkey", "l_linenumber", "room_name")


@query("J9_enrich_by_url", """
SELECT p.page_id, p.url, coalesce(d.html_size, 0) AS html_size, coalesce(d.title, p.url) AS title
FROM pages p LEFT JOIN (SELECT url, length(html) AS html_size, 'Page ' || page_id AS title FROM pages WHERE length(html) > 3000) d
ON p.url = d.url""")
def j9(t):
    items = t.pages.select("page_id", "url", F.lit(0).alias("html_size"), F.col("url").alias("title"))
    docs = t.pages.filter(F.length("html") > 3000).select(
        "url", F.length("html").alias("html_size"), F.concat(F.lit("Page "), "page_id").alias("title"))
    return joins.enriched(items, docs, "url", ["html_size", "title"])


@query("J10_removed_pages", """
SELECT DISTINCT user_id, event_type FROM events e WHERE ts < TIMESTAMP '2024-01-25 00:00:00'
 AND NOT EXISTS (SELECT 1 FROM events r WHERE r.ts >= TIMESTAMP '2024-01-25 00:00:00' AND r.user_id = e.user_id AND r.event_type = e.event_type)""")
def j10(t):
    split = F.lit("2024-01-25").cast("timestamp_ntz")
    known = t.events.filter(F.col("ts") < split).select("user_id", "event_type").distinct()
    return joins.not_seen(known, t.events.filter(F.col("ts") >= split), ["user_id", "event_type"])


@query("J11_removed_targets", """
SELECT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' EXCEPT
SELECT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'""")
def j11(t):
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    before = t.lineitem.filter(F.col("l_shipdate") < cut).select("l_suppkey", "l_partkey").distinct()
    return joins.not_seen(before, t.lineitem.filter(F.col("l_shipdate") >= cut), ["l_suppkey", "l_partkey"])


@query("J12_previous_scrape", """
SELECT event_id, lag(event_id) OVER w AS prev_event_id, lag(ts) OVER w AS prev_ts FROM events
WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def j12(t):
    out = ordered.previous_in_order(
        t.events, ["user_id", "event_type"], ["ts", "event_id"], ordered.Even(ordered.micros("ts"), 30 * ordered.DAY, tie=F.col("event_id")), ["event_id", "ts"])
    return out.select("event_id", "prev_event_id", "prev_ts")


@query("J14_job_view", """
SELECT coalesce(o.o_orderkey, l.k, b.k) AS job_id, coalesce(l.status, o.o_orderstatus, b.status) AS status,
 coalesce(o.o_totalprice, b.total) AS total, coalesce(b.result, l.result) AS result
FROM orders o FULL OUTER JOIN (SELECT l_orderkey AS k, max(l_linestatus) AS status, min(l_returnflag) AS result
  FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) l ON o.o_orderkey = l.k
FULL OUTER JOIN (SELECT l_orderkey + 5 AS k, max(l_linestatus) AS status, max(l_extendedprice) AS total, max(l_returnflag) AS result
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON coalesce(o.o_orderkey, l.k) = b.k""")
def j14(t):
    li = t.lineitem
    live = li.filter(F.col("l_returnflag") == "N").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.max("l_linestatus").alias("status"), F.min("l_returnflag").alias("result"))
    blob = li.filter(F.col("l_returnflag") == "R").groupBy((F.col("l_orderkey") + 5).alias("job_id")).agg(
        F.max("l_linestatus").alias("status"), F.max("l_extendedprice").alias("total"), F.max("l_returnflag").alias("result"))
    stored = t.orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    return joins.merged_view(live, stored, blob, "job_id", {
        "status": ["live", "stored", "blob"], "total": ["stored", "blob"], "result": ["blob", "live"]})


@query("J15_foreign_key_violations", """
SELECT 'lineitem.l_orderkey' AS fk, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'lineitem.l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'lineitem.l_suppkey', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'events.user_id', count(*) FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'orders.o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def j15(t):
    from ..operators.quality import foreign_key_report
    return foreign_key_report([
        ("lineitem.l_orderkey", t.lineitem, "l_orderkey", t.orders, "o_orderkey"),
        ("lineitem.l_partkey", t.lineitem, "l_partkey", t.part, "p_partkey"),
        ("lineitem.l_suppkey", t.lineitem, "l_suppkey", t.supplier, "s_suppkey"),
        ("events.user_id", t.events, "user_id", t.supplier, "s_suppkey"),
        ("orders.o_custkey", t.orders, "o_custkey", t.customer, "c_custkey"),
    ])


@query("J17_recipient_sync", """
WITH requested AS (SELECT DISTINCT o_orderpriority AS monitor_id, lower(trim(c_name)) || '@x.example' AS email
  FROM orders JOIN customer ON o_custkey = c_custkey),
existing AS (SELECT DISTINCT o_orderpriority AS monitor_id, lower(c_name) || '@x.example' AS email
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F')
SELECT r.monitor_id, r.email, CASE WHEN m.email IS NOT NULL THEN 'confirmed' ELSE 'pending' END AS status
FROM requested r LEFT JOIN (SELECT DISTINCT lower(c_name) || '@x.example' AS email FROM customer WHERE c_mktsegment = 'BUILDING') m
 ON r.email = m.email WHERE (r.monitor_id, r.email) NOT IN (SELECT monitor_id, email FROM existing)""")
def j17(t):
    mail = lambda c: F.concat(c, F.lit("@X.example"))
    pairs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    requested = pairs.select(F.col("o_orderpriority").alias("monitor_id"), F.concat(F.lit(" "), mail(F.col("c_name"))).alias("email"))
    existing = pairs.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderpriority").alias("monitor_id"), F.lower(mail(F.col("c_name"))).alias("email"))
    members = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select(mail(F.col("c_name")).alias("email"))
    return joins.missing_recipients(requested, existing, members)


@query("J18_subscribed_members", """
SELECT DISTINCT o.o_orderpriority AS team_id, c.c_name AS email FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT c_custkey, c_acctbal < 0 AS off, c_mktsegment AS tag FROM customer WHERE c_custkey % 3 = 0) p ON p.c_custkey = c.c_custkey
WHERE NOT coalesce(off, false) AND (tag IS NULL OR tag = 'MACHINERY')""")
def j18(t):
    members = t.orders.select(F.col("o_orderpriority").alias("team_id"), F.col("o_custkey").alias("user_id"))
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    prefs = t.customer.filter(F.pmod("c_custkey", F.lit(3)) == 0).select(
        F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") < 0).alias("unsubscribed_all"),
        F.array("c_mktsegment").alias("email_preferences"))
    return joins.subscribed_emails(members, users, prefs, "MACHINERY")


@query("J19_enterprise_flag", """
SELECT o_custkey AS team_id, bool_or(p_type = 'PROMO') AS is_enterprise FROM orders JOIN lineitem ON o_orderkey = l_orderkey
JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1998-01-01' GROUP BY 1""")
def j19(t):
    active = t.orders.filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp_ntz")))
    rows = active.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("o_custkey").alias("team_id")).agg(F.bool_or(F.col("p_type") == "PROMO").alias("is_enterprise"))


# ------------------------------------------------------------------- windows

@query("W1_rank_within_hotel_and_type", """
SELECT l_suppkey, l_returnflag, l_quantity, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
 CAST(row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS distance_rank
FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_quantity, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem)""")
def w1(t):
    # Ranking reads its input more than once; the distinct rows are stored first.
    rows = cut_lineage(t.lineitem.select(
        "l_suppkey", "l_returnflag", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").dropDuplicates())
    return ordered.row_number_in_order(
        rows, ["l_suppkey", "l_returnflag"], ["l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
        ordered.Even(F.col("l_quantity"), 100, tie=F.col("l_orderkey")), "distance_rank")


@query("W2_newest_per_key", """
SELECT user_id, event_id, ts, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position FROM events)
WHERE position <= 3""")
def w2(t):
    return ordered.newest_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3, "position").select(
        "user_id", "event_id", "ts", "position")


@query("W3_newest_success_unless_errors", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
five AS (SELECT * FROM r WHERE rn <= 5),
g AS (SELECT user_id, min(rn) FILTER (WHERE event_type NOT IN ('error', 'click')) AS ok FROM five GROUP BY 1)
SELECT f.user_id, f.event_id, CASE WHEN f.event_type IN ('error', 'click') THEN 500 ELSE 200 END AS status
FROM five f JOIN g ON f.user_id = g.user_id AND f.rn = CASE WHEN ok IS NULL OR ok > 3 THEN 1 ELSE ok END""")
def w3(t):
    from ..operators.windows import newest_good_or_newest
    entries = t.events.withColumn("status", F.when(F.col("event_type").isin("error", "click"), 500).otherwise(200))
    return newest_good_or_newest(entries, ["user_id"], ["ts", "event_id"], "status").select("user_id", "event_id", "status")


@query("W4_price_drop", """
SELECT user_id, first_price, last_price, round((first_price - last_price) / first_price, 6) AS drop_share FROM (
 SELECT user_id, arg_min(value, (ts, event_id)) AS first_price, arg_max(value, (ts, event_id)) AS last_price FROM events GROUP BY 1)
WHERE first_price > 0 AND (first_price - last_price) / first_price >= 0.05""")
def w4(t):
    from ..operators.windows import price_drops
    out = price_drops(t.events, ["user_id"], ["ts", "event_id"], "value")
    return out.withColumn("drop_share", F.round("drop_share", 6))


@query("W6_page_history", """
SELECT user_id, event_type, min(ts) AS first_seen, max(ts) FILTER (WHERE status <> 'removed') AS last_seen,
 max(ts) FILTER (WHERE status IN ('new', 'changed')) AS last_changed, arg_max(status, (ts, event_id)) AS last_status,
 arg_max(status, (ts, event_id)) = 'removed' AS is_removed FROM (
 SELECT *, CASE k % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' WHEN 2 THEN 'removed' WHEN 3 THEN 'error' ELSE 'same' END AS status
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)) GROUP BY 1, 2""")
def w6(t):
    from ..operators.windows import page_history
    return page_history(check_pages(t), ["user_id", "event_type"], "ts", "event_id", "status")


STATUS_NAMES = ["new", "changed", "removed", "error", "same"]


def check_pages(t):
    """Events as rows of monitoring checks."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS_NAMES]), F.pmod(k, F.lit(5)) + 1)
    return t.events.withColumn("k", k).withColumn("status", status)


@query("W7_precrawl_priorities", """
WITH d AS (SELECT user_id, sqrt(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)) AS priority FROM events GROUP BY 1),
g AS (SELECT min(priority) AS lo, max(priority) AS hi, greatest(sum(round(priority, 6)::DECIMAL(18,6))::DOUBLE, 1) AS total FROM d),
p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT user_id, sum(n) AS total_n FROM p GROUP BY 1)
SELECT p.user_id, p.event_type, p.n AS event_count, CAST(round(10 + (priority - lo) / (hi - lo) * 90) AS BIGINT) AS urls_to_fetch,
 CAST(round(p.n / s.total_n * (priority / total) * 20000) AS BIGINT) AS page_budget
FROM p JOIN s USING (user_id) JOIN d USING (user_id), g""")
def w7(t):
    from ..operators.windows import crawl_budgets
    domains = t.events.groupBy("user_id").agg(F.sqrt(F.sum(F.col("value").cast("decimal(18,2)")).cast("double")).alias("priority"))
    pages = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("event_count"))
    return crawl_budgets(domains, pages, "user_id", total_budget=20000, min_urls=10, max_urls=100).select(
        "user_id", "event_type", "event_count", "urls_to_fetch", "page_budget")


@query("W8_item_positions", """
SELECT p_partkey, pos AS position, item FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS item,
 generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part) WHERE item <> 'red'""")
def w8(t):
    items = t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("p", "item"))
    return items.filter(F.col("item") != "red").select("p_partkey", (F.col("p") + 1).alias("position"), "item")


@query("W10_latest_log_per_job", """
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value
FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def w10(t):
    logs = t.events.filter(F.col("event_type") == "purchase")
    return ordered.one_per_key(logs, ["user_id"], F.struct("ts", "event_id"), "max").select("user_id", "event_id", "value")


# --------------------------------------------------------------------- top-k

@query("T1_cheapest_fifty", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")
def t1(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(50)


@query("T2_vector_topk", """
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity
FROM embeddings WHERE embedding IS NOT NULL ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 5""")
def t2(t):
    question = t.embeddings.filter(F.col("vec_id") == 0).first().embedding
    return topk.nearest(t.embeddings, question, 5).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("T2_vector_topk_batch", """
WITH c AS (SELECT label, list(m ORDER BY pos) AS center FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
SELECT label AS query_id, vec_id, round(sim, 6) AS similarity, position FROM (
 SELECT c.label, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], center) AS sim,
  row_number() OVER (PARTITION BY c.label ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], center) DESC, v.vec_id) AS position
 FROM embeddings v, c) WHERE position <= 5""")
def t2b(t):
    # Asked vectors: the centre of every label, over all vectors.
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    centers = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("center"))
    asked = centers.select(F.col("label").alias("query_id"), F.col("center").alias("query"))
    out = topk.nearest_batch(t.embeddings, asked, 5)
    return out.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "position")


@query("T2_vector_topk_all", """
SELECT query_id, vec_id, round(sim, 6) AS similarity, position FROM (
 SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS sim,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS position
 FROM embeddings q, embeddings v WHERE q.embedding IS NOT NULL AND v.embedding IS NOT NULL) WHERE position <= 5""")
def t2_all(t):
    # Every vector asks; small slices, so that several of each meet.
    asked = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    out = topk.nearest_batch(t.embeddings, asked, 5, query_rows=512, vector_rows=1024)
    return out.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "position")


@query("T3_keyset_page", """
SELECT event_id, ts, event_type, true AS has_more FROM events WHERE ts >= TIMESTAMP '2024-01-29 12:00:00'
 AND (ts < TIMESTAMP '2024-01-30 06:00:00' OR (ts = TIMESTAMP '2024-01-30 06:00:00' AND event_id < 500))
ORDER BY ts DESC, event_id DESC LIMIT 20""")
def t3(t):
    since = F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")
    return topk.keyset_page(t.events, "ts", "event_id", since, 20, ("2024-01-30 06:00:00", 500)).select(
        "event_id", "ts", "event_type", "has_more")


@query("T4_byte_capped_listing", """
SELECT source, doc_id, bytes_so_far FROM (SELECT source, doc_id,
  CAST(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS bytes_so_far,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
WHERE bytes_so_far <= 30000 OR rn = 1""")
def t4(t):
    docs = t.documents.select("source", "doc_id", F.length("text").cast("long").alias("n"))
    bucket = ordered.Even(F.col("doc_id"), 1_000_000)
    return topk.capped_listing(docs, ["source"], "doc_id", bucket, F.col("n"), 30000).select("source", "doc_id", "bytes_so_far")


@query("T5_limit_per_source", """
SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10""")
def t5(t):
    return ordered.newest_per_key(t.documents.select("source", "doc_id"), ["source"], ["doc_id"], 10)


@query("T6_recent_fifty", """
SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50""")
def t6(t):
    rows = t.events.select("event_type", "event_id", "ts")
    return ordered.newest_per_key(rows, ["event_type"], [F.desc("ts"), F.desc("event_id")], 50).select("event_type", "event_id")


@query("T7_nulls_last", """
SELECT CASE WHEN o_orderstatus <> 'P' THEN date_trunc('month', o_orderdate)::DATE END AS month, count(*) AS n
FROM orders GROUP BY 1 ORDER BY 1 NULLS LAST""")
def t7(t):
    month = F.when(F.col("o_orderstatus") != "P", F.to_date(F.date_trunc("month", "o_orderdate")))
    return t.orders.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_last("month"))


@query("T8_top_urls_per_domain", """
SELECT event_type, user_id, event_count, rank FROM (
 SELECT event_type, user_id, count(*) AS event_count, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rank
 FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1, 2) WHERE rank <= 5""")
def t8(t):
    recent = t.events.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return topk.top_by_count(recent, "event_type", "user_id", 5)
