"""Warehouse-shaped tables derived from the star-schema test tables.

Suppliers play hotels, parts play rooms, places and facilities, order lines
play price rows.  Each function has a SQL twin used by the reference queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def hotels(t) -> DataFrame:
    s = t.supplier
    return s.select(
        F.concat(F.lit("s"), "s_suppkey").alias("hotel_id"),
        F.col("s_name").alias("hotel_name"),
        F.concat(F.lit("Nation "), "s_nationkey").alias("description"),
        F.pmod("s_suppkey", F.lit(6)).cast("int").alias("stars_rating"),
        F.pmod(F.col("s_suppkey") * 7, F.lit(500)).cast("int").alias("review_count"),
        F.lit("WiFi, Pool").alias("popular_facilities"),
        text.property_type(F.col("s_name")).alias("property_type"),
        F.lit("14:00").alias("checkin_time_start"),
        F.lit("00:00").alias("checkin_time_end"),
        F.lit("00:00").alias("checkout_time_start"),
        F.lit("12:00").alias("checkout_time_end"),
    )


HOTELS_SQL = """(SELECT 's' || s_suppkey AS hotel_id, s_name AS hotel_name, 'Nation ' || s_nationkey AS description,
  CAST(s_suppkey % 6 AS INTEGER) AS stars_rating, CAST((s_suppkey * 7) % 500 AS INTEGER) AS review_count,
  'WiFi, Pool' AS popular_facilities, 'Khách sạn' AS property_type, '14:00' AS checkin_time_start,
  '00:00' AS checkin_time_end, '00:00' AS checkout_time_start, '12:00' AS checkout_time_end FROM supplier)"""


def locations(t) -> DataFrame:
    return (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            F.concat(F.lit("s"), "s_suppkey").alias("hotel_id"),
            F.concat_ws(", ", "n_name", "r_name").alias("full_address"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("country"),
        )
    )


LOCATIONS_SQL = """(SELECT 's' || s_suppkey AS hotel_id, concat_ws(', ', n_name, r_name) AS full_address,
  n_name AS city, r_name AS country FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)"""


def room_types(t) -> DataFrame:
    return (
        t.lineitem.select("l_suppkey", "l_partkey").distinct()
        .join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat(F.lit("s"), "l_suppkey", F.lit("_"), "l_partkey").alias("room_type_id"),
            F.concat(F.lit("s"), "l_suppkey").alias("hotel_id"),
            F.col("p_name").alias("room_type_name"),
            F.lit("Không xác định").alias("bed_types"),
            F.lit(2).alias("max_guests"),
        )
    )


ROOM_TYPES_SQL = """(SELECT DISTINCT 's' || l_suppkey || '_' || l_partkey AS room_type_id, 's' || l_suppkey AS hotel_id,
  p_name AS room_type_name, 'Không xác định' AS bed_types, 2 AS max_guests
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def room_prices(t) -> DataFrame:
    return t.lineitem.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("booking_id"),
        F.concat(F.lit("s"), "l_suppkey").alias("hotel_id"),
        F.concat(F.lit("s"), "l_suppkey", F.lit("_"), "l_partkey").alias("room_type_id"),
        F.col("l_extendedprice").alias("current_price"),
        F.to_date("l_shipdate").alias("checkin_date"),
        F.date_add(F.to_date("l_shipdate"), 1).alias("checkout_date"),
    )


ROOM_PRICES_SQL = """(SELECT concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS booking_id,
  's' || l_suppkey AS hotel_id, 's' || l_suppkey || '_' || l_partkey AS room_type_id,
  l_extendedprice AS current_price, CAST(l_shipdate AS DATE) AS checkin_date,
  CAST(l_shipdate AS DATE) + 1 AS checkout_date FROM lineitem)"""


def nearby_places(t) -> DataFrame:
    return (
        t.lineitem.select("l_suppkey", "l_partkey").distinct()
        .join(t.part.select("p_partkey", "p_name", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat(F.lit("s"), "l_suppkey").alias("hotel_id"),
            F.concat("p_name", F.lit(" "), "p_partkey").alias("place_name"),
            F.col("p_type").alias("place_type"),
            (F.col("p_size") * 50).alias("distance_in_meters"),
        )
    )


NEARBY_SQL = """(SELECT DISTINCT 's' || l_suppkey AS hotel_id, p_name || ' ' || p_partkey AS place_name, p_type AS place_type,
  p_size * 50 AS distance_in_meters FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def facilities(t) -> DataFrame:
    return (
        t.lineitem.select("l_suppkey", "l_partkey").distinct()
        .join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.concat(F.lit("s"), "l_suppkey").alias("hotel_id"), text.capitalize(F.col("p_type")).alias("facility_name"))
        .distinct()
    )


FACILITIES_SQL = """(SELECT DISTINCT 's' || l_suppkey AS hotel_id,
  upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS facility_name
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def reviews(t) -> DataFrame:
    n = lambda k: F.round(F.pmod(F.col("s_suppkey") * k, F.lit(50)) / 10 + 5, 1)
    return t.supplier.select(
        F.concat(F.lit("s"), "s_suppkey").alias("hotel_id"),
        n(3).alias("staff_score"), n(7).alias("facilities_score"), n(11).alias("cleanliness_score"),
        n(13).alias("comfort_score"), n(17).alias("value_for_money_score"), n(19).alias("location_score"),
        n(23).alias("free_wifi_score"), n(29).alias("average_score"),
    )


def _score(k: int, name: str) -> str:
    return f"round((s_suppkey * {k} % 50) / 10.0 + 5, 1)::DOUBLE AS {name}"


REVIEWS_SQL = "(SELECT 's' || s_suppkey AS hotel_id, " + ", ".join([
    _score(3, "staff_score"), _score(7, "facilities_score"), _score(11, "cleanliness_score"),
    _score(13, "comfort_score"), _score(17, "value_for_money_score"), _score(19, "location_score"),
    _score(23, "free_wifi_score"), _score(29, "average_score"),
]) + " FROM supplier)"


def warehouse(t) -> dict[str, DataFrame]:
    return {
        "hotels": hotels(t), "hotel_locations": locations(t), "room_types": room_types(t),
        "room_prices": room_prices(t), "hotel_nearby_places": nearby_places(t),
        "hotel_facilities": facilities(t), "hotel_reviews": reviews(t),
    }


def usage_ops(t) -> DataFrame:
    """Events as billing operations."""
    user = F.col("user_id")
    return t.events.select(
        F.col("event_id"),
        F.when(F.pmod(user, F.lit(10)) == 0, F.concat(F.lit("preview_"), user)).otherwise(
            F.concat(F.lit("team"), user)).alias("team_id"),
        F.when(F.pmod(user, F.lit(3)) != 0, F.concat(F.lit("sub"), user)).alias("subscription_id"),
        F.col("event_type").alias("endpoint"),
        (F.col("event_type") == "purchase").alias("is_extract"),
        F.when(F.pmod(user, F.lit(7)) != 0, F.pmod(user, F.lit(5))).alias("api_key_id"),
        F.floor("value").alias("credits"),
        (F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(2)) == 0).alias("tracked"),
        F.col("ts"),
    )


USAGE_SQL = """(SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'preview_' || user_id ELSE 'team' || user_id END AS team_id,
  CASE WHEN user_id % 3 <> 0 THEN 'sub' || user_id END AS subscription_id, event_type AS endpoint,
  event_type = 'purchase' AS is_extract, CASE WHEN user_id % 7 <> 0 THEN user_id % 5 END AS api_key_id,
  CAST(floor(value) AS BIGINT) AS credits, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS tracked, ts
  FROM events)"""


def flat_hotels(t) -> DataFrame:
    """Suppliers as flat crawled hotel records (34 columns).

    List fields hold distinct part types, sizes and names, whose number is
    bounded by the catalogue, not by the number of order lines.
    """
    key = F.col("s_suppkey")
    sold = t.lineitem.select("l_suppkey", "l_partkey", "l_extendedprice").join(
        t.part.select("p_partkey", "p_name", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    places = sold.select("l_suppkey", "p_type", "p_size").distinct().groupBy("l_suppkey").agg(
        F.sort_array(F.collect_list(F.struct("p_type", "p_size"))).alias("ps"))
    rooms = sold.groupBy("l_suppkey", "p_name").agg(F.floor(F.min("l_extendedprice")).alias("price")).groupBy("l_suppkey").agg(
        F.sort_array(F.collect_list(F.struct("p_name", "price"))).alias("rs"))
    base = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(
        places.withColumnRenamed("l_suppkey", "_p"), key == F.col("_p"), "left").join(
        rooms.withColumnRenamed("l_suppkey", "_r"), key == F.col("_r"), "left")
    m = lambda n: F.pmod(key, F.lit(n))
    none = lambda kind: F.lit(None).cast(kind)
    near = F.array_join(F.transform("ps", lambda p: F.concat(
        p["p_type"], F.lit(" "), p["p_size"], F.lit(" "), F.format_number(p["p_size"] / 10, 1), F.lit(" km"))), "; ")
    by_foot = F.array_join(F.transform("ps", lambda p: F.concat(F.lit("Chợ "), p["p_type"], F.lit(" "), p["p_size"] * 10, F.lit(" m"))), "; ")
    room_list = F.array_join(F.transform("rs", lambda r: F.concat(
        r["p_name"], F.lit(" ("), F.format_number(r["price"], 0), F.lit(" VND)"))), "; ")
    score = lambda n: F.when(m(5) != 0, F.pmod(key * n, F.lit(50)) / 10 + 5)
    return base.select(
        F.concat(F.lit("s"), key).alias("hotel_id"),
        F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("hotel_name"),
        F.concat(F.lit("https://travel.example/hotel/vn/s"), key, F.lit(".vi.html")).alias("canonical_url"),
        F.when(m(3) == 1, F.concat(m(5), F.lit(" trên 5 sao"))).alias("stars_rating"),
        F.when(m(3) == 0, m(6) + 0.5).alias("stars_rating_value"),
        F.when(m(4) != 0, key / 64 + 10).alias("latitude"), F.when(m(4) != 0, key / 64 + 100).alias("longitude"),
        score(3).alias("review_score"), F.when(m(7) != 0, m(400).cast("int")).alias("review_count"),
        F.lit("Tốt").alias("review_score_word"), none("double").alias("gia_thap_nhat"), none("double").alias("gia_cao_nhat"),
        F.when(m(6) != 0, F.concat(m(1000), F.lit(" Phố Một, Quận Hai, 550000 "), "n_name", F.lit(", Việt Nam, Đông Nam Á"))).alias("address"),
        F.when(m(8) != 0, F.concat(F.lit("Hồ bơi, WiFi miễn phí, hồ bơi, "), F.lower("n_name"))).alias("popular_facilities"),
        F.concat(F.lit('Mô tả "'), "n_name", F.lit('"\ndòng hai, hết')).alias("description"),
        F.when(m(2) == 0, "Nhận phòng\nTừ 15:00 - 22:00\nTrả phòng\nTừ 06:00 - 11:30").alias("hotel_policies"),
        F.when(m(3) != 2, "2026-08-01").alias("ngay_checkin"), F.when(m(3) != 2, "2026-08-02").alias("ngay_checkout"),
        none("string").alias("whats_nearby"), F.concat(near, F.lit("; lỗi 1.200,5 km; ; không rõ")).alias("top_attractions"),
        none("string").alias("natural_beauty"), none("string").alias("nearest_airports"),
        F.concat(by_foot, F.lit("; "), by_foot).alias("restaurants_cafes"), none("string").alias("beaches_in_area"), none("string").alias("public_transport"),
        *[score(n).alias(c) for n, c in ((3, "staff_score"), (7, "facilities_score"), (11, "cleanliness_score"), (13, "comfort_score"),
                                         (17, "value_for_money_score"), (19, "location_score"), (23, "free_wifi_score"))],
        none("string").alias("hotel_images"),
        F.concat(F.lit("Không giá; "), room_list, F.lit("; Phòng Đơn (1.200.000 VND)")).alias("danh_sach_phong_va_gia"))


SOLD_SQL = "(SELECT l_suppkey, l_extendedprice, p_name, p_type, p_size FROM lineitem JOIN part ON l_partkey = p_partkey)"
