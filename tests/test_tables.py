import datetime

import pytest
from pyspark.sql import functions as F

from staygrid import schemas
from staygrid.operators import filters, joins, quality, rollups, topk, usage
from staygrid.plans import monitor, tools, warehouse
from staygrid.session import work_path
from staygrid.sources import files, sinks


@pytest.fixture
def flat(spark):
    a = dict(hotel_id="hotel-a", hotel_name="A", stars_rating="4 trên 5 sao", address="12 Phố Một, Quận Hai, 550000 Đà Nẵng, Việt Nam",
             hotel_policies="Nhận phòng\nTừ 15:00 - 22:00\nTrả phòng\nTừ 06:00 - 11:30", popular_facilities="Hồ bơi, WiFi miễn phí, hồ bơi",
             top_attractions="Cầu X 1,2 km; Chợ Y 850 m; Đền Z 850 m; lỗi 1.200,5 km",
             danh_sach_phong_va_gia="Phòng Đôi (1,200,000 VND); Không giá; Phòng Đơn (1.200.000 VND)", staff_score=8.5, review_count=120)
    b = dict(hotel_id="hotel-b")
    names = schemas.columns(schemas.FLAT_HOTEL)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in (a, a, b)], schemas.FLAT_HOTEL)


def test_warehouse(flat):
    t = warehouse.clean_tables(flat, "2026-01-01 00:00:00")
    h = {r.hotel_id: r for r in t["hotels"].collect()}
    assert (h["hotel-a"].stars_rating, h["hotel-b"].stars_rating) == (4, 0)
    assert h["hotel-a"].checkin_time_end == "22:00" and h["hotel-b"].checkout_time_end == "12:00" and h["hotel-b"].review_count == 0
    loc = {r.hotel_id: r for r in t["hotel_locations"].collect()}
    assert loc["hotel-a"].city == "Đà Nẵng" and loc["hotel-b"].full_address is None
    assert {r.facility_name for r in t["hotel_facilities"].collect()} == {"Hồ bơi", "Wifi miễn phí"}
    near = {r.place_name: (r.distance_in_meters, r.distance_rank) for r in t["hotel_nearby_places"].collect()}
    assert near == {"Chợ Y": (850, 1), "Đền Z": (850, 2), "Cầu X": (1200, 3)}
    rooms = {r.room_type_id: float(r.current_price) for r in t["room_prices"].collect()}
    assert rooms == {"hotel-a_phong_doi_1": 1200000.0, "hotel-a_phong_don_3": 0.0}
    assert {r.booking_id for r in t["room_prices"].collect()} == {"hotel-a_phong_doi_1_2026-07-06", "hotel-a_phong_don_3_2026-07-06"}
    scores = {r.hotel_id: float(r.staff_score) for r in t["hotel_reviews"].collect()}
    assert scores == {"hotel-a": 8.5, "hotel-b": 0.0}
    counts = rollups.table_counts(t)
    quality.check_counts(counts, {"hotels": 2, "hotel_nearby_places": 3, "room_prices": 2})
    with pytest.raises(AssertionError):
        quality.check_counts(counts, {"hotels": 3})
    for name, key in warehouse.PRIMARY_KEYS.items():
        if key:
            assert quality.duplicate_keys(t[name], key).isEmpty(), name


def test_csv_with_bom(spark, flat):
    path = work_path(spark, "bom")
    sinks.write_csv(flat.select("hotel_id", "hotel_policies"), path, bom=True)
    lines = spark.read.text(path, wholetext=True).collect()
    assert any(r.value.startswith("﻿hotel_id") for r in lines)


def test_html_folder(spark, tmp_path):
    (tmp_path / "khách-1.html").write_text("<p>a\nb</p>", encoding="utf-8")
    (tmp_path / "skip.txt").write_text("x")
    rows = files.read_html_folder(spark, str(tmp_path)).collect()
    assert [(r.key, r.html) for r in rows] == [("khách-1", "<p>a\nb</p>")]


def test_text_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfok \xff end")
    row = files.read_text_documents(spark, str(tmp_path)).first()
    assert (row.source, row.content) == ("a.txt", "ok � end")


def test_nested_json_array(spark, tmp_path):
    (tmp_path / "h.json").write_text('[{"hotel_id":"a","bookings":[{"current_price":5.0}]},{"hotel_id":"b"}]')
    rows = files.read_nested_hotels(spark, str(tmp_path / "h.json")).orderBy("hotel_id").collect()
    assert rows[0].bookings[0].current_price == 5.0 and rows[1].bookings is None


def test_first_existing(spark, tmp_path):
    (tmp_path / "x").write_text("")
    assert files.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "x")]).endswith("/x")
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [str(tmp_path / "no")])


def test_append_and_upsert(spark):
    path = work_path(spark, "t")
    sinks.append_first_wins(spark, spark.createDataFrame([("k1", "a")], "k string, v string"), path, ["k"])
    new = spark.createDataFrame([("k1", "b"), ("k2", "c")], "k string, v string")
    for _ in range(2):
        sinks.append_first_wins(spark, new, path, ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("k1", "a"), ("k2", "c")}
    old = spark.createDataFrame([("k1", "s1", "a", 0)], "id string, source string, content string, created int")
    inc = spark.createDataFrame([("k1", "s2", "b", 1), ("k2", "s3", None, 1)], "id string, source string, content string, created int")
    got = {tuple(r) for r in sinks.upserted(old, inc, "id", ["content"]).collect()}
    assert got == {("k1", "s1", "b", 0), ("k2", "s3", None, 1)}
    assert {tuple(r) for r in sinks.upserted(sinks.upserted(old, inc, "id", ["content"]), inc, "id", ["content"]).collect()} == got


def test_replace_by_key(spark):
    old = spark.createDataFrame([("h1", 100), ("h2", 50)], "h string, p int")
    new = spark.createDataFrame([("h1", 120)], "h string, p int")
    assert {tuple(r) for r in sinks.replaced_by_key(old, new, "h").collect()} == {("h1", 120), ("h2", 50)}


def test_tools(spark):
    hotels = spark.createDataFrame([("a", "Sea"), ("b", "SEASIDE"), ("c", "Hill")], "hotel_id string, hotel_name string")
    prices = spark.createDataFrame([("1", "a", "r", 100.0), ("2", "b", "r", 100.5), ("3", "c", "r", 99.0)],
                                   "booking_id string, hotel_id string, room_type_id string, current_price double").withColumns({
        "checkin_date": F.to_date(F.lit("2026-07-06")), "checkout_date": F.to_date(F.lit("2026-07-07"))})
    rooms = spark.createDataFrame([("r", "Room")], "room_type_id string, room_type_name string")
    out = tools.HOTEL_TOOLS.run(spark, "find-hotels-by-price", {"hotels": hotels, "room_prices": prices, "room_types": rooms},
                                max_price=100, checkin_date="2026-07-06").collect()
    assert [r.hotel_name for r in out] == ["Hill", "Sea"]
    with pytest.raises(TypeError):
        tools.HOTEL_TOOLS.get("find-hotels-by-price").checked({"max_price": "100", "checkin_date": "x"})
    with pytest.raises(KeyError):
        tools.HOTEL_TOOLS.get("nope")
    assert {r.hotel_id for r in hotels.filter(filters.contains_text(F.col("hotel_name"), "sea")).collect()} == {"a", "b"}


def test_keyset_pages_neither_repeat_nor_lose(spark):
    at = datetime.datetime(2026, 1, 1)
    df = spark.createDataFrame([(i, at) for i in range(3)], "id int, ts timestamp_ntz")
    since = F.lit("2025-12-31").cast("timestamp_ntz")
    first = topk.keyset_page(df, "ts", "id", since, 2).collect()
    assert [r.id for r in first] == [2, 1] and first[0].has_more
    rest = topk.keyset_page(df, "ts", "id", since, 2, (str(at), 1)).collect()
    assert [r.id for r in rest] == [0] and not rest[0].has_more
    with pytest.raises(ValueError):
        topk.keyset_page(df, "ts", "id", since, 101)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None)], "vec_id int, embedding array<float>")
    got = topk.nearest(df, [1.0, 0.0], 2).collect()
    assert [(r.vec_id, round(r.similarity, 4)) for r in got] == [(1, 1.0), (3, 0.7071)]
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 0.0]), (7, None)], "query_id int, query array<double>")
    for query_rows, vector_rows in ((4096, 32768), (1, 1)):
        batch = topk.nearest_batch(df, asked, 2, query_rows=query_rows, vector_rows=vector_rows).orderBy("query_id", "position").collect()
        assert [(r.query_id, r.vec_id, round(r.similarity, 4)) for r in batch] == [(8, 1, 0.0), (8, 2, 0.0), (9, 1, 1.0), (9, 3, 0.7071)]
    assert topk.nearest_batch(df, asked.limit(0), 2).count() == 0 and topk.nearest_batch(df.limit(0), asked, 2).count() == 0


def test_months(spark):
    rows = [("2026-03-30", 20), ("2026-03-31", 333), ("2026-04-01", 1), (None, 9)]
    df = spark.createDataFrame(rows, "day string, credits int").withColumn("day", F.to_date("day"))
    got = rollups.monthly(df, "day", F.col("credits")).orderBy("start_date").collect()
    assert [(str(r.start_date), r.end_date and str(r.end_date), r.credits_used) for r in got] == [
        ("2026-03-01", "2026-04-01", 353), ("2026-04-01", None, 1)]


def test_billing_groups(spark):
    rows = [("t", None, "scrape", False, None, 2, True), ("t", None, "scrape", False, None, 3, False), ("t", "s", "scrape", False, None, 5, True),
            ("preview", None, "scrape", False, None, 7, True), ("preview_x", None, "scrape", False, None, 7, True)]
    df = spark.createDataFrame(rows, "team_id string, subscription_id string, endpoint string, is_extract boolean, api_key_id int, credits int, tracked boolean")
    got = {(r.subscription_id, r.total_credits, r.untracked_credits, r.operations) for r in usage.billing_groups(df).collect()}
    assert got == {(None, 5, 3, 2), ("s", 5, 0, 1)}


def test_recipients(spark):
    asked = spark.createDataFrame([("m", " A@x.co "), ("m", "a@x.co"), ("m", "b@x.co"), ("m", "c@x.co"), ("m", " ")], "monitor_id string, email string")
    known = spark.createDataFrame([("m", "b@x.co")], "monitor_id string, email string")
    team = spark.createDataFrame([("C@x.co",)], "email string")
    got = {(r.email, r.status) for r in joins.missing_recipients(asked, known, team).collect()}
    assert got == {("a@x.co", "pending"), ("c@x.co", "confirmed")}


def test_monitor_run(spark):
    known = spark.createDataFrame([("a", "a b"), ("b", "x"), ("c", "y"), ("d", "z")], "url string, markdown string")
    now = spark.createDataFrame([("a", "ba", 200), ("b", "x!", 200), ("c", "", 404), ("e", "n", 200)], "url string, markdown string, status_code int")
    events = monitor.check_events(known, now, ["url"])
    assert {r.url: r.status for r in events.collect()} == {"a": "same", "b": "changed", "c": "removed", "d": "removed", "e": "new"}
    verdicts = spark.createDataFrame([("a", True), ("b", True)], "url string, is_meaningful boolean")
    judged = {r.url: r.is_meaningful for r in monitor.with_judgment(events, verdicts, ["url"]).collect()}
    assert judged == {"a": None, "b": True, "c": None, "d": None, "e": None}


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string")
    assert [(r.k, r.n) for r in quality.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    assert {(r.column_name, r.n_null) for r in quality.null_report(df, ["k", "v"]).collect()} == {("k", 0), ("v", 1)}
    parent = spark.createDataFrame([(1,)], "id int")
    assert quality.foreign_key_report([("x", df, "k", parent, "id")]).first().violations == 1


def test_capped_listing_keeps_one(spark):
    df = spark.createDataFrame([("c", 1, 50), ("c", 2, 1), ("d", 1, 4), ("d", 2, 5), ("d", 3, 9)], "k string, i int, n int")
    got = {(r.k, r.i) for r in topk.capped_listing(df, ["k"], "i", F.floor(F.col("i") / 2), F.col("n"), 10).collect()}
    assert got == {("c", 1), ("d", 1), ("d", 2)}
    # Only the first row may be larger than the cap: nothing follows a row of size zero that fills it up.
    df = spark.createDataFrame([("c", 1, 0), ("c", 2, 50), ("c", 3, 1), ("d", None, 3), ("d", 1, 9)], "k string, i int, n int")
    got = {(r.k, r.i) for r in topk.capped_listing(df, ["k"], "i", F.col("i"), F.col("n"), 10).collect()}
    assert got == {("c", 1), ("d", None)}
