"""Explicit schemas; files are never read with inferred types."""

from __future__ import annotations

FLAT_HOTEL = """
hotel_id string, hotel_name string, canonical_url string, stars_rating string, stars_rating_value double,
latitude double, longitude double, review_score double, review_count int, review_score_word string,
gia_thap_nhat double, gia_cao_nhat double, address string, popular_facilities string, description string,
hotel_policies string, ngay_checkin string, ngay_checkout string, whats_nearby string, top_attractions string,
natural_beauty string, nearest_airports string, restaurants_cafes string, beaches_in_area string,
public_transport string, staff_score double, facilities_score double, cleanliness_score double,
comfort_score double, value_for_money_score double, location_score double, free_wifi_score double,
hotel_images string, danh_sach_phong_va_gia string
"""

RAW_HOTEL = """
hotel_id string, hotel_name string, subscores struct<staff_score:double, location_score:double>,
room_types array<struct<room_type_id:string, room_type_name:string>>,
bookings array<struct<room_type_id:string, current_price:double, checkin_date:string, checkout_date:string>>,
images array<string>
"""

RAG_DOCUMENT = "id string, source string, content string, embedding array<float>, metadata string, created_at timestamp_ntz"

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def columns(ddl: str) -> list[str]:
    """Column names of a flat schema text."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).names
