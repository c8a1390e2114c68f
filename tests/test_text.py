import pytest
from pyspark.sql import functions as F

from staygrid.functions import text


@pytest.mark.parametrize("raw, want", [
    ("VND 1.878.300", 1878300.0), ("1,878,300 đ", 1878300.0), ("US$ 86.58", 86.58), ("86,58", 86.58),
    ("1.234,50", 1234.5), ("", 0.0), ("1,234.567.8", 0.0), ("giá: 5", 5.0),
])
def test_price(val, raw, want):
    assert val(text.price_number, p=raw) == want


def test_stars(val):
    assert val(text.star_rating, a=None, b="4 trên 5 sao") == 4
    assert val(text.star_rating, a="3.9", b=None) == 3
    assert val(text.star_rating, a="x", b="không") == 0


def test_address(val):
    a = val(text.address_fields, a="12 Phố Một, Quận Hai, 550000 Đà Nẵng, Việt Nam")
    assert (a.street_address, a.city, a.country) == ("12 Phố Một, Quận Hai", "Đà Nẵng", "Việt Nam")
    assert tuple(val(text.address_fields, a="")) == ("", "", "", "")
    assert tuple(val(text.address_fields, a="Ngõ 1"))[:3] == ("Ngõ 1", "Đà Nẵng", "Việt Nam")


def test_policy(val):
    t = val(text.policy_times, p="Nhận phòng\nTừ 15:00 - 22:00\nTrả phòng\nTừ 06:00 - 11:30")
    assert tuple(t) == ("15:00", "22:00", "06:00", "11:30")
    assert tuple(val(text.policy_times, p="khác")) == ("14:00", "00:00", "00:00", "12:00")


def test_facilities(val):
    assert val(text.facility_names, f="Hồ bơi, WiFi miễn phí, hồ bơi") == ["Hồ bơi", "Wifi miễn phí"]


@pytest.mark.parametrize("raw, want", [
    ("Cầu X 1,2 km", ("Cầu X", 1.2, "km", 1200)), ("Chợ Y 850 m", ("Chợ Y", 850.0, "m", 850)),
])
def test_nearby(val, raw, want):
    assert tuple(val(text.nearby_item, i=raw)) == want


def test_nearby_bad_number(val):
    assert val(text.nearby_item, i="lỗi 1.200,5 km").distance_value is None


@pytest.mark.parametrize("raw, want", [
    ("Phòng Đôi (1,200,000 VND)", ("Phòng Đôi", 1200000.0)), ("Không giá", (None, None)),
    ("Phòng Đơn (1.200.000 VND)", ("Phòng Đơn", 0.0)),
])
def test_room(val, raw, want):
    assert tuple(val(text.room_item, i=raw)) == want


def test_slug(val):
    assert val(text.slug, s="Phòng Đôi  (VIP)!") == "phong_doi_vip"
    assert val(text.dash_slug, s="Phòng Đôi - VIP!") == "phong-doi-vip"
    assert val(text.dash_slug, s="!!") == "standard-room"


def test_normalize(val):
    assert val(text.normalize_text, s=" é \n") == "é"
    assert val(text.normalize_text, s=None) == ""


def test_location_sentences(val):
    got = val(lambda c: text.sentences_with(c, text.LOCATION_WORDS), d="Cách biển 2 km. Phòng đẹp! Gần chợ.")
    assert got == "Cách biển 2 km.; Gần chợ."


def test_sub_score(val):
    got = val(lambda c: text.sub_score(c, text.SUB_SCORE_LABELS["staff_score"]), d="Nhân viên phục vụ 8,7 Tiện nghi 9")
    assert got == 8.7


def test_same_capture(val):
    assert val(text.same_capture, a="a b", b="ba") is True
    assert val(text.same_capture, a="a b", b="a c") is False
    assert val(lambda a, b: text.same_capture(a, b, strict=True), a="a b", b="ba") is False
    assert val(lambda a: text.change_signature(a), a="x [iframe](u) y") == val(lambda a: text.change_signature(a), a="yx")


def test_junk(val):
    assert val(text.strip_junk, s="a​  \t b﻿\n c ") == "a b\n c"


def test_similarity(val):
    assert val(text.word_set_similarity, a="A b  c", b="c B d") == 0.5
    assert val(text.edit_similarity, a="é", b="e") == 0.5  # one edit, two bytes


def test_bucket_and_jitter(val):
    assert val(lambda s: text.bucket_label(s), s=21600) == "sub_daily"
    import hashlib
    want = int.from_bytes(hashlib.sha256(b"m1").digest()[:4], "big") % 300000
    assert val(lambda k: text.jitter_offset(k, F.lit(10_000_000), 300_000), k="m1") == want
    assert val(lambda k: text.jitter_offset(k, F.lit(1), 300_000), k="m1") == 0


def test_property_type(val):
    assert val(text.property_type, n="Sea Resort Villa") == "Resort"
    assert val(text.property_type, n="Nhà") == "Khách sạn"


def test_all_blanks_count_as_blanks(val):
    """The crawled pages put non-breaking blanks between numbers and words."""
    b = "\u00a0"
    assert val(text.star_rating, a=None, b=f"4{b}trên{b}5{b}sao") == 4
    near = val(text.nearby_item, i=f"Cầu Rồng{b}1,2{b}km{b}")
    assert (near.place_name, near.distance_in_meters) == ("Cầu Rồng", 1200)
    room = val(text.room_item, i=f"Phòng Đôi{b}({b}1,200,000{b}VND{b}){b}")
    assert (room.room_type_name, room.price) == ("Phòng Đôi", 1200000.0)
    assert val(text.price_number, p=f"86,58{b}") == 86.58
    assert val(text.policy_times, p=f"Nhận{b}phòng\nTừ{b}15:00{b}-{b}23:00").checkin_time_start == "15:00"
    assert val(text.address_fields, a=f"1 Phố Một{b},{b}Đà Nẵng, Việt{b}Nam thêm").full_address.startswith("1 Phố Một, Đà Nẵng")


def test_edit_similar_is_the_verdict_of_edit_similarity(spark):
    rows = [("abcdefghij" * 3, "abcdefghij" * 3), ("abcdefghij" * 3, "abcdefghiX" * 3), ("éa", "ea"), ("", ""), ("a", ""), ("a" * 20, "a" * 19)]
    df = spark.createDataFrame(rows, "a string, b string")
    for least in (0.5, 0.9, 0.95, 1.0):
        got = df.select((text.edit_similarity(F.col("a"), F.col("b")) >= least).alias("w"), text.edit_similar(F.col("a"), F.col("b"), least).alias("g")).collect()
        assert all(r.w == r.g for r in got), (least, got)
