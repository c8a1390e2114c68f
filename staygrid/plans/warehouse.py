"""Flat hotel records to seven clean tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.ordered import Even, row_number_in_order
from ..session import cut_lineage, spread

# Flat column -> place type, in source order.
PLACE_COLUMNS = [
    ("top_attractions", "attraction"), ("natural_beauty", "nature"), ("nearest_airports", "airport"),
    ("restaurants_cafes", "restaurant"), ("beaches_in_area", "beach"), ("public_transport", "transport"),
    ("whats_nearby", "nearby"),
]
SCORES = ["staff_score", "facilities_score", "cleanliness_score", "comfort_score", "value_for_money_score", "location_score", "free_wifi_score"]
DEFAULT_CHECKIN, DEFAULT_CHECKOUT = "2026-07-06", "2026-07-07"
# List columns hold hundreds of items each, so little input is much work.
LIST_BYTES = 64 * 1024
PRIMARY_KEYS = {
    "hotels": ["hotel_id"], "hotel_locations": ["hotel_id"], "hotel_facilities": ["hotel_id", "facility_name"],
    "hotel_nearby_places": None, "hotel_reviews": ["review_id"], "room_types": ["room_type_id"], "room_prices": ["booking_id"],
}


def _null_if_empty(c: Column) -> Column:
    """Empty texts are stored as NULL."""
    return F.nullif(c, F.lit(""))


def hotels(flat: DataFrame) -> DataFrame:
    times = text.policy_times(text.normalize_text(F.col("hotel_policies")))
    return flat.select(
        "hotel_id",
        _null_if_empty(text.normalize_text(F.col("hotel_name"))).alias("hotel_name"),
        _null_if_empty(text.normalize_text(F.col("description"))).alias("description"),
        text.star_rating(F.col("stars_rating_value"), text.normalize_text(F.col("stars_rating"))).alias("stars_rating"),
        F.coalesce("review_count", F.lit(0)).alias("review_count"),
        _null_if_empty(text.normalize_text(F.col("popular_facilities"))).alias("popular_facilities"),
        F.lit(text.DEFAULT_PROPERTY_TYPE).alias("property_type"),
        times.alias("_t"),
    ).select("*", "_t.*").drop("_t").dropDuplicates()


def locations(flat: DataFrame) -> DataFrame:
    raw = F.when(F.col("address").isNotNull() & (F.col("address") != ""), text.nfc("address"))
    parts = flat.select("hotel_id", "latitude", "longitude", text.address_fields(text.strip(raw)).alias("_a"))
    fields = ["street_address", "city", "country", "full_address"]
    return parts.select(
        "hotel_id", *[_null_if_empty(F.col(f"_a.{f}")).alias(f) for f in fields],
        # What these types cannot hold is no place on earth and becomes NULL; the record stays.
        F.col("latitude").try_cast("decimal(10,8)").alias("latitude"), F.col("longitude").try_cast("decimal(11,8)").alias("longitude"),
    ).dropDuplicates()


def facilities(flat: DataFrame) -> DataFrame:
    names = text.facility_names(text.normalize_text(F.col("popular_facilities")))
    return flat.select("hotel_id", F.explode(names).alias("facility_name")).dropDuplicates()


def nearby_places(flat: DataFrame) -> DataFrame:
    """Places with a rank by distance per hotel and type; ties keep source order."""
    present = [(i, c, kind) for i, (c, kind) in enumerate(PLACE_COLUMNS) if c in flat.columns]
    # One normalisation call for all columns of a record.
    joined = F.array_join(F.array(*[F.coalesce(F.col(c), F.lit("")) for _, c, _ in present]), "\x1f")
    lists = F.split(text.nfc(joined), "\x1f")
    rows = spread(flat, "hotel_id", bytes_per_task=LIST_BYTES).select("hotel_id", F.posexplode(lists).alias("_c", "_list"))
    items = rows.select("hotel_id", "_c", F.posexplode(F.split("_list", ";")).alias("_pos", "_item"))
    found = items.select("hotel_id", "_c", "_pos", text.nearby_item(text.strip(F.col("_item"))).alias("_p"))
    kind = F.element_at(F.array(*[F.lit(k) for _, _, k in present]), F.col("_c") + 1)
    places = found.filter(F.col("_p.distance_value").isNotNull()).select(
        "hotel_id", "_p.place_name", kind.alias("place_type"), "_p.distance_value", "_p.distance_unit", "_p.distance_in_meters",
        (F.col("_c") * 100_000 + F.col("_pos")).alias("_ord"))
    # Ranking reads its input twice; the parsed places are written once instead.
    unique = cut_lineage(places.groupBy([c for c in places.columns if c != "_ord"]).agg(F.min("_ord").alias("_ord")))
    ranked = row_number_in_order(
        unique, ["hotel_id", "place_type"], ["distance_in_meters", "_ord"], Even(F.col("distance_in_meters"), 1000), "distance_rank")
    return ranked.drop("_ord").withColumn("distance_value", F.col("distance_value").cast("decimal(6,2)"))


def reviews(flat: DataFrame) -> DataFrame:
    score = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).cast("decimal(3,1)")
    return flat.select(
        F.concat("hotel_id", F.lit("_rev")).alias("review_id"), "hotel_id", *[score(c).alias(c) for c in SCORES],
        score("review_score").alias("average_score")).dropDuplicates()


def _rooms(flat: DataFrame) -> DataFrame:
    rows = spread(flat, "hotel_id", bytes_per_task=LIST_BYTES).select(
        "hotel_id", F.coalesce("ngay_checkin", F.lit(DEFAULT_CHECKIN)).alias("checkin"),
        F.coalesce("ngay_checkout", F.lit(DEFAULT_CHECKOUT)).alias("checkout"),
        F.posexplode(F.split("danh_sach_phong_va_gia", ";")).alias("_pos", "_item"))
    parsed = rows.withColumn("_r", text.room_item(text.strip(F.col("_item")))).filter(F.col("_r.room_type_name").isNotNull())
    named = parsed.withColumn("room_type_name", F.col("_r.room_type_name"))
    # Skipped items still count, so the number is the position in the list.
    return named.withColumn("room_type_id", F.concat_ws(
        "_", "hotel_id", text.slug(text.nfc("room_type_name")), (F.col("_pos") + 1).cast("string")))


def room_types(flat: DataFrame) -> DataFrame:
    return _rooms(flat).select(
        "room_type_id", "hotel_id", "room_type_name", F.lit("Không xác định").alias("bed_types"), F.lit(2).alias("max_guests")).dropDuplicates()


def room_prices(flat: DataFrame, run_ts: str) -> DataFrame:
    price = F.col("_r.price").cast("decimal(15,2)")
    return _rooms(flat).select(
        F.concat_ws("_", "room_type_id", "checkin").alias("booking_id"), "hotel_id", "room_type_id",
        price.alias("original_price"), price.alias("current_price"), F.lit(0).cast("decimal(15,2)").alias("discount"),
        F.lit(1).alias("taxes_included"), F.lit(run_ts).cast("timestamp_ntz").alias("extracted_at"),
        F.to_date("checkin").alias("checkin_date"), F.to_date("checkout").alias("checkout_date")).dropDuplicates()


def clean_tables(flat: DataFrame, run_ts: str) -> dict[str, DataFrame]:
    """All seven tables, parents before children."""
    return {
        "hotels": hotels(flat), "hotel_locations": locations(flat), "hotel_facilities": facilities(flat),
        "hotel_nearby_places": nearby_places(flat), "hotel_reviews": reviews(flat),
        "room_types": room_types(flat), "room_prices": room_prices(flat, run_ts),
    }
