"""Hotel warehouse: flat records to tables, sources, sinks, retrieval, records, monitoring."""

from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import nearby_item, room_item
from ..operators import dedup, ordered, records, topk
from ..operators.rollups import table_counts
from ..plans import monitor, rag, warehouse
from ..session import cut_lineage, work_path
from ..sources import files, sinks
from . import derived
from .derived import SOLD_SQL
from .registry import query
from .rollups import ALL_TABLES

RUN_TS = "2026-07-06 00:00:00"


def _flat(t):
    """The flat records as a stored table, which is what the cleaning job reads."""
    return cut_lineage(derived.flat_hotels(t))


def _score_sql(k, name):
    return f"CAST(CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey * {k} % 50) / 10.0 + 5 ELSE 0 END AS DOUBLE) AS {name}"


@query("N1_hotels", """
SELECT 's' || s_suppkey AS hotel_id, s_name AS hotel_name, 'Mô tả "' || n_name || '"' || chr(10) || 'dòng hai, hết' AS description,
 CAST(CASE s_suppkey % 3 WHEN 0 THEN s_suppkey % 6 WHEN 1 THEN s_suppkey % 5 ELSE 0 END AS INTEGER) AS stars_rating,
 CAST(CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 400 ELSE 0 END AS INTEGER) AS review_count,
 CASE WHEN s_suppkey % 8 <> 0 THEN 'Hồ bơi, WiFi miễn phí, hồ bơi, ' || lower(n_name) END AS popular_facilities, 'Khách sạn' AS property_type,
 CASE WHEN s_suppkey % 2 = 0 THEN '15:00' ELSE '14:00' END AS checkin_time_start, CASE WHEN s_suppkey % 2 = 0 THEN '22:00' ELSE '00:00' END AS checkin_time_end,
 CASE WHEN s_suppkey % 2 = 0 THEN '06:00' ELSE '00:00' END AS checkout_time_start, CASE WHEN s_suppkey % 2 = 0 THEN '11:30' ELSE '12:00' END AS checkout_time_end
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def n1_hotels(t):
    return warehouse.hotels(_flat(t))


@query("N1_locations", """
SELECT 's' || s_suppkey AS hotel_id, CASE WHEN a THEN s_suppkey % 1000 || ' Phố Một, Quận Hai' END AS street_address, CASE WHEN a THEN n_name END AS city,
 CASE WHEN a THEN 'Việt Nam' END AS country, CASE WHEN a THEN s_suppkey % 1000 || ' Phố Một, Quận Hai, ' || n_name || ', Việt Nam' END AS full_address,
 CAST(CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey / 64 + 10 END AS DECIMAL(10,8)) AS latitude, CAST(CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey / 64 + 100 END AS DECIMAL(11,8)) AS longitude
FROM (SELECT *, s_suppkey % 6 <> 0 AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def n1_locations(t):
    return warehouse.locations(_flat(t))


@query("N1_facilities", """
SELECT 's' || s_suppkey AS hotel_id, unnest(['Hồ bơi', 'Wifi miễn phí', upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2))]) AS facility_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 8 <> 0""")
def n1_facilities(t):
    return warehouse.facilities(_flat(t))


@query("N1_nearby_places", f"""
WITH p AS (SELECT DISTINCT l_suppkey, p_type, p_size FROM {SOLD_SQL}),
n AS (SELECT DISTINCT l_suppkey, place_name, place_type, distance_value, distance_unit, distance_in_meters FROM (
 SELECT l_suppkey, p_type || ' ' || p_size AS place_name, 'attraction' AS place_type, CAST(p_size / 10.0 AS DECIMAL(6,2)) AS distance_value, 'km' AS distance_unit,
  CAST(trunc(CAST(p_size / 10.0 AS DOUBLE) * 1000) AS INTEGER) AS distance_in_meters FROM p
 UNION ALL SELECT l_suppkey, 'Chợ ' || p_type, 'restaurant', CAST(p_size * 10 AS DECIMAL(6,2)), 'm', p_size * 10 FROM p))
SELECT 's' || l_suppkey AS hotel_id, place_name, place_type, CAST(distance_value AS DOUBLE) AS distance_value, distance_unit, distance_in_meters,
 CAST(row_number() OVER (PARTITION BY l_suppkey, place_type ORDER BY distance_in_meters, place_name) AS INTEGER) AS distance_rank FROM n""")
def n1_nearby(t):
    out = warehouse.nearby_places(_flat(t))
    return out.withColumn("distance_value", F.col("distance_value").cast("double"))


@query("N1_reviews", "SELECT 's' || s_suppkey || '_rev' AS review_id, 's' || s_suppkey AS hotel_id, " + ", ".join([
    _score_sql(3, "staff_score"), _score_sql(7, "facilities_score"), _score_sql(11, "cleanliness_score"), _score_sql(13, "comfort_score"),
    _score_sql(17, "value_for_money_score"), _score_sql(19, "location_score"), _score_sql(23, "free_wifi_score"), _score_sql(3, "average_score")]) + " FROM supplier")
def n1_reviews(t):
    out = warehouse.reviews(_flat(t))
    return out.select("review_id", "hotel_id", *[F.col(c).cast("double").alias(c) for c in out.columns[2:]])


ROOMS_SQL = f"""(SELECT l_suppkey, p_name, price, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY p_name) + 1 AS INTEGER) AS pos FROM (
  SELECT l_suppkey, p_name, CAST(floor(min(l_extendedprice)) AS DOUBLE) AS price FROM {SOLD_SQL} GROUP BY 1, 2)
 UNION ALL SELECT l_suppkey, 'Phòng Đơn', 0.0, CAST(count(DISTINCT p_name) + 2 AS INTEGER) FROM {SOLD_SQL} GROUP BY 1)"""
ROOM_ID_SQL = "'s' || l_suppkey || '_' || CASE WHEN p_name = 'Phòng Đơn' THEN 'phong_don' ELSE replace(p_name, ' ', '_') END || '_' || pos"


@query("N1_room_types", f"""
SELECT {ROOM_ID_SQL} AS room_type_id, 's' || l_suppkey AS hotel_id, p_name AS room_type_name, 'Không xác định' AS bed_types, 2 AS max_guests FROM {ROOMS_SQL}""")
def n1_room_types(t):
    return warehouse.room_types(_flat(t))


@query("N1_room_prices", f"""
SELECT {ROOM_ID_SQL} || '_' || CASE WHEN l_suppkey % 3 <> 2 THEN '2026-08-01' ELSE '2026-07-06' END AS booking_id, 's' || l_suppkey AS hotel_id,
 {ROOM_ID_SQL} AS room_type_id, price AS original_price, price AS current_price, 0.0 AS discount, 1 AS taxes_included, TIMESTAMP '{RUN_TS}' AS extracted_at,
 CASE WHEN l_suppkey % 3 <> 2 THEN DATE '2026-08-01' ELSE DATE '2026-07-06' END AS checkin_date,
 CASE WHEN l_suppkey % 3 <> 2 THEN DATE '2026-08-02' ELSE DATE '2026-07-07' END AS checkout_date FROM {ROOMS_SQL}""")
def n1_room_prices(t):
    out = warehouse.room_prices(_flat(t), RUN_TS)
    return out.withColumns({c: F.col(c).cast("double") for c in ("original_price", "current_price", "discount")})


@query("C7_nearby_rows", """
SELECT p_partkey, p_name AS place_name, p_size / 10.0 AS distance_value, CASE WHEN p_size % 2 = 0 THEN 'km' ELSE 'm' END AS distance_unit,
 CAST(CASE WHEN p_size % 2 = 0 THEN trunc(CAST(p_size / 10.0 AS DOUBLE) * 1000) ELSE trunc(CAST(p_size / 10.0 AS DOUBLE)) END AS INTEGER) AS distance_in_meters FROM part""")
def c7(t):
    unit = F.when(F.pmod("p_size", F.lit(2)) == 0, " KM").otherwise("m")
    value = F.replace(F.format_string("%.1f", F.col("p_size") / 10), F.lit("."), F.lit(","))
    item = F.concat("p_name", F.lit("  "), value, unit, F.lit(" "))
    return t.part.select("p_partkey", nearby_item(item).alias("n")).select("p_partkey", "n.*")


@query("C8_room_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 <> 0 THEN 'Phòng ' || l_partkey END AS room_type_name,
 CASE l_linenumber % 3 WHEN 1 THEN CAST(floor(l_extendedprice) AS DOUBLE) WHEN 2 THEN 0.0 END AS price FROM lineitem""")
def c8(t):
    m = F.pmod("l_linenumber", F.lit(3))
    name = F.concat(F.lit("Phòng "), "l_partkey")
    item = F.when(m == 1, F.concat(name, F.lit(" ( "), F.format_number(F.floor("l_extendedprice"), 0), F.lit(" vnd ) "))).when(
        m == 2, F.concat(name, F.lit(" (1.200.000 VND)"))).otherwise(name)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", room_item(item).alias("r")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "r.*")


@query("Q2_expected_counts", """
SELECT 'hotels' AS table_name, count(*) AS n_rows, count(*) AS expected FROM supplier
UNION ALL SELECT 'room_types', count(*), count(*) FROM (SELECT DISTINCT l_suppkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey
 UNION ALL SELECT DISTINCT l_suppkey, 'Phòng Đơn' FROM lineitem)""")
def q2(t):
    flat = _flat(t)
    loaded = table_counts({"hotels": warehouse.hotels(flat), "room_types": warehouse.room_types(flat)})
    listed = flat.agg(F.sum(F.regexp_count("danh_sach_phong_va_gia", F.lit("VND"))).alias("n")).select(F.lit("room_types").alias("table_name"), F.col("n").alias("expected"))
    known = t.supplier.agg(F.count(F.lit(1)).alias("expected")).select(F.lit("hotels").alias("table_name"), "expected").unionByName(listed)
    return loaded.join(known, "table_name").select("table_name", "n_rows", "expected")


# -------------------------------------------------------------- sources, sinks

@query("S1_S5_flat_csv_round_trip", """
SELECT 's' || s_suppkey AS hotel_id, 'Mô tả "' || n_name || '"' || chr(10) || 'dòng hai, hết' AS description,
 CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey / 64 + 10 END AS latitude FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def s1(t):
    path = work_path(t.spark, "flat-csv")
    sinks.write_csv(derived.flat_hotels(t).select(*schemas.columns(schemas.FLAT_HOTEL)), path)
    return files.read_flat_hotels(t.spark, files.first_existing(t.spark, [path + "-missing", path])).select("hotel_id", "description", "latitude")


@query("S3_html_folder", "SELECT sha256(html) AS html_hash, length(html) AS n_chars FROM pages")
def s3(t):
    # One file per page, as a crawler leaves them.
    path = work_path(t.spark, "html")
    # Tasks put their files in place themselves; by default the driver would rename them all, one after the other.
    t.pages.select("page_id", "html").repartition(32, "page_id").select("html").write.option("maxRecordsPerFile", 1).option(
        "mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
    page = F.regexp_replace("html", r"\n\z", "")
    rows = files.read_html_folder(t.spark, path, ".txt")
    return rows.select(F.sha2(page, 256).alias("html_hash"), F.length(page).alias("n_chars"))


@query("S14_text_documents", "SELECT sha256(text) AS text_hash FROM benchmark")
def s14(t):
    path = work_path(t.spark, "texts")
    t.benchmark.select("text").write.option("maxRecordsPerFile", 1).text(path)
    rows = files.read_text_documents(t.spark, path)
    return rows.select(F.sha2(F.regexp_replace("content", r"\n\z", ""), 256).alias("text_hash"))


@query("S13_sitemap_files", "SELECT DISTINCT url AS loc FROM pages")
def s13x(t):
    # Sitemap files on disk, read with the XML source: 1000 entries per file.
    path = work_path(t.spark, "sitemaps")
    t.pages.select(F.col("url").alias("loc")).write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)
    return files.read_sitemap_urls(t.spark, path).distinct()


@query("S4_nested_json_round_trip", """
SELECT o_orderkey AS hotel_id, count(l_orderkey) AS n_bookings, round(coalesce(max(l_extendedprice), 0), 2) AS top_price
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def s4(t):
    path = work_path(t.spark, "nested")
    booking = F.struct(F.col("l_partkey").cast("string").alias("room_type_id"), F.col("l_extendedprice").alias("current_price"))
    per = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(booking).alias("bookings"))
    nested = t.orders.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").cast("string").alias("hotel_id"), "bookings")
    sinks.write_json(nested, path)
    back = t.spark.read.schema(schemas.RAW_HOTEL).json(path)
    return back.select(
        F.col("hotel_id").cast("long").alias("hotel_id"), F.coalesce(F.size("bookings"), F.lit(0)).cast("long").alias("n_bookings"),
        F.round(F.coalesce(F.array_max(F.transform("bookings", lambda b: b["current_price"])), F.lit(0.0)), 2).alias("top_price")
    ).withColumn("n_bookings", F.greatest("n_bookings", F.lit(0)))


@query("S6_export_all_tables", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in ALL_TABLES))
def s6(t):
    path = work_path(t.spark, "export")
    tables = {n: getattr(t, n) for n in ALL_TABLES}
    names = sinks.export_tables(t.spark, tables, path)

    def stored(n):
        return t.spark.read.options(**files.CSV_OPTIONS).schema(", ".join(f"`{c}` string" for c in tables[n].columns)).csv(f"{path}/{n}")

    return table_counts({n: stored(n) for n in names})


@query("S7_append_first_wins", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE round(o_totalprice + 1, 2) END AS o_totalprice FROM orders""")
def s7(t):
    path = work_path(t.spark, "append")
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    sinks.append_first_wins(t.spark, rows.filter(F.col("o_orderstatus") == "F"), path, ["o_orderkey"])
    changed = rows.withColumn("o_totalprice", F.round(F.col("o_totalprice") + 1, 2))
    for _ in range(2):  # a repeated load adds nothing
        sinks.append_first_wins(t.spark, changed, path, ["o_orderkey"])
    return t.spark.read.schema(rows.schema).parquet(path).select("o_orderkey", "o_totalprice")


@query("S8_warehouse_load", "SELECT 'dims' AS part, count(*) AS n FROM supplier UNION ALL SELECT 'facts', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def s8(t):
    path = work_path(t.spark, "load")
    tables = {"hotels": t.supplier, "facts": t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")}
    for _ in range(2):
        sinks.load_warehouse(tables, path, {"facts": ["l_orderkey", "l_linenumber"]})
    read = lambda n: t.spark.read.schema(tables[n].schema).parquet(f"{path}/{n}")
    return read("hotels").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dims").alias("part"), "n").unionByName(
        read("facts").agg(F.count(F.lit(1)).alias("n")).select(F.lit("facts").alias("part"), "n"))


@query("S9_upsert", """
SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'new-' || source END AS source,
 CASE WHEN doc_id % 2 = 0 THEN sha256('v2 ' || text) ELSE sha256(text) END AS content_hash FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def s9(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content"), F.lit(0).alias("created"))
    stored = docs.filter(F.pmod("id", F.lit(3)) == 0)
    incoming = docs.filter(F.pmod("id", F.lit(2)) == 0).select(
        "id", F.concat(F.lit("new-"), "source").alias("source"), F.concat(F.lit("v2 "), "content").alias("content"), F.lit(1).alias("created"))
    return sinks.upserted(stored, incoming, "id", ["content"]).select("id", "source", F.sha2("content", 256).alias("content_hash"))


@query("S10_replace_by_key", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price FROM lineitem WHERE l_suppkey % 4 <> 0
UNION ALL SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 2, 2) FROM lineitem WHERE l_suppkey % 4 = 0 AND l_returnflag = 'R'""")
def s10(t):
    stored = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"))
    batch = t.lineitem.filter((F.pmod("l_suppkey", F.lit(4)) == 0) & (F.col("l_returnflag") == "R")).select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 2, 2).alias("price"))
    keys = t.supplier.filter(F.pmod("s_suppkey", F.lit(4)) == 0).select(F.col("s_suppkey").alias("l_suppkey"))
    return sinks.replaced_by_key(stored, batch, "l_suppkey", keys)


@query("S10_partition_overwrite", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price FROM lineitem WHERE l_suppkey % 4 <> 0
UNION ALL SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 2, 2) FROM lineitem WHERE l_suppkey % 4 = 0 AND l_returnflag = 'R'""")
def s10_partitions(t):
    path = work_path(t.spark, "by-key")
    columns = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"]
    sinks.store_by_key(t.lineitem.select(*columns, F.col("l_extendedprice").alias("price")), path, "l_suppkey", 8)
    mine = F.pmod("l_suppkey", F.lit(4)) == 0
    batch = t.lineitem.filter(mine & (F.col("l_returnflag") == "R")).select(*columns, F.round(F.col("l_extendedprice") * 2, 2).alias("price"))
    for _ in range(2):  # the second time changes nothing
        sinks.replace_partitions(batch, path, "l_suppkey", 8, t.lineitem.filter(mine).select("l_suppkey"))
    return t.spark.read.parquet(path).drop("_bucket")


@query("Q2_observed_load", """
SELECT 'hotels' AS table_name, count(*) AS n_rows, 0 AS null_keys, 0 AS bad_keys FROM supplier
UNION ALL SELECT 'events', count(*), count(*) FILTER (WHERE k IS NULL), count(*) FILTER (WHERE k = '' OR k <> trim(k)) FROM (
 SELECT CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' || event_type ELSE event_type END AS k FROM events)""")
def q2_observed(t):
    m = F.pmod("event_id", F.lit(5))
    name = F.when(m == 1, "").when(m == 2, F.concat(F.lit(" "), "event_type")).when(m > 2, F.col("event_type"))
    tables = {"hotels": warehouse.hotels(_flat(t)), "events": t.events.select("event_id", name.alias("kind"))}
    return sinks.load_observed(tables, work_path(t.spark, "observed"), {"hotels": "hotel_id", "events": "kind"}, {"events": t.events.count()})


@query("S11_rebuild", "SELECT 's' || s_suppkey AS hotel_id, s_name AS hotel_name FROM supplier")
def s11(t):
    path = work_path(t.spark, "rebuild")
    for _ in range(2):
        sinks.rebuild({"hotels": warehouse.hotels(_flat(t))}, path)
    return t.spark.read.parquet(f"{path}/hotels").select("hotel_id", "hotel_name")


# ------------------------------------------------------------------- retrieval

@query("N2_ingest_chunks", """
SELECT substr(sha256(src || '::' || chunk_no), 1, 16) AS id, src AS source, chunk_no, sha256(c) AS content_hash FROM (
 SELECT 'doc' || doc_id AS src, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, c FROM (
  SELECT doc_id, i, regexp_replace(substr(text, CAST(i AS BIGINT) + 1, 1000), '^\\s+|\\s+$', '', 'g') AS c FROM (
   SELECT doc_id, text, unnest(range(0, length(text), 800)) AS i FROM documents)) WHERE c <> '')""")
def n2(t):
    docs = t.documents.select(F.concat(F.lit("doc"), "doc_id").alias("source"), "text")
    return rag.ingest_documents(docs, "source", "text").select("id", "source", "chunk_no", F.sha2("content", 256).alias("content_hash"))


@query("N3_retrieve", """
WITH top AS (SELECT CAST(vec_id AS VARCHAR) AS id, 'label' || label AS source, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS s
 FROM embeddings ORDER BY s DESC, id LIMIT 5)
SELECT string_agg('[' || source || ']' || chr(10) || 'text ' || id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY s DESC, id) AS context,
 string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS chunks_used FROM top""")
def n3(t):
    asked = list(t.embeddings.filter(F.col("vec_id") == 7).first().embedding)
    stored = t.embeddings.select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("label"), "label").alias("source"),
                                 F.concat(F.lit("text "), "vec_id").alias("content"), "embedding")
    return rag.retrieve(stored, asked, 5).withColumn("sources", F.array_join("sources", ","))


@query("W9_stable_rank_order", """
SELECT doc_id, CAST(length(text) % 7 AS DOUBLE) AS score FROM documents ORDER BY score DESC, doc_id""")
def w9(t):
    return topk.ranked(t.documents, F.pmod(F.length("text"), F.lit(7)).cast("double"), "doc_id").select("doc_id", "score")


@query("W5_previous_version", """
SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prev_doc_id, length(lag(text) OVER (PARTITION BY source ORDER BY doc_id)) AS prev_chars FROM documents""")
def w5(t):
    rows = t.documents.select("source", "doc_id", "text")
    out = ordered.previous_in_order(rows, ["source"], ["doc_id"], ordered.Even(F.col("doc_id"), 1_000_000, 100_000), ["doc_id", "text"])
    return out.select("doc_id", "prev_doc_id", F.length("prev_text").alias("prev_chars"))


# --------------------------------------------------------------------- records

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query("D1_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount, l_tax FROM lineitem")
def d1(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_discount", "l_tax").dropDuplicates()


@query("D2_facilities_per_hotel", """
SELECT DISTINCT p_partkey, upper(substr(w, 1, 1)) || lower(substr(w, 2)) AS facility_name FROM (
 SELECT p_partkey, unnest([p_type, lower(p_type), split_part(p_name, ' ', 1), upper(split_part(p_name, ' ', 1))]) AS w FROM part)""")
def d2(t):
    from ..functions.text import facility_names
    first = F.substring_index("p_name", " ", 1)
    listed = F.concat_ws(" , ", "p_type", F.lower("p_type"), F.lit(""), first, F.upper(first))
    return t.part.select("p_partkey", F.explode(facility_names(listed)).alias("facility_name"))


@query("D9_distinct_in_arrays", """
SELECT l_orderkey, CAST(count(DISTINCT (l_returnflag, l_linestatus)) AS INTEGER) AS n_distinct, CAST(count(*) AS INTEGER) AS n_all FROM lineitem GROUP BY 1""")
def d9(t):
    per = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_linestatus")).alias("items"))
    out = records.distinct_in_arrays(per.withColumn("n_all", F.size("items")), ["items"])
    return out.select("l_orderkey", F.size("items").alias("n_distinct"), "n_all")


def _contact_records(t):
    """Events as records with gaps: user, day as block; email, title, phone may be missing."""
    k = F.get_json_object("props", "$.k").cast("int")
    m = lambda n: F.pmod(k, F.lit(n))
    return t.events.select(
        "user_id", F.date_trunc("day", "ts").alias("day"), "event_id",
        F.when(m(3) == 0, "null").when(m(3) == 1, F.concat(F.lit("mail"), m(2))).alias("email"),
        F.when(m(5) < 3, F.concat(F.lit("title"), m(2))).alias("title"),
        F.when(m(2) == 0, m(4)).alias("phone"),
        F.array(F.col("event_type")).alias("areas"), F.concat(F.lit("https://x.example/"), "event_type").alias("url"))


MERGED_SQL = f"""
WITH RECURSIVE r AS (
 SELECT user_id, date_trunc('day', ts) AS day, event_id, CASE WHEN {K} % 3 = 1 THEN 'mail' || ({K} % 2) END AS email,
  CASE WHEN {K} % 5 < 3 THEN 'title' || ({K} % 2) END AS title, CASE WHEN {K} % 2 = 0 THEN {K} % 4 END AS phone,
  event_type AS area, 'https://x.example/' || event_type AS url, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id) AS i FROM events),
f AS (
 SELECT user_id, day, i, [{{'email': email, 'title': title, 'phone': phone, 'areas': [area], 'first_ord': event_id, 'sources': [url]}}] AS kept FROM r WHERE i = 1
 UNION ALL
 SELECT user_id, day, i, CASE WHEN coalesce(home, 0) = 0 THEN list_append(kept, {{'email': email, 'title': title, 'phone': phone, 'areas': [area], 'first_ord': event_id, 'sources': [url]}})
  ELSE list_transform(kept, lambda k, j: CASE WHEN j = home THEN {{'email': coalesce(email, k.email), 'title': coalesce(title, k.title), 'phone': coalesce(phone, k.phone),
   'areas': CASE WHEN list_contains(k.areas, area) THEN k.areas ELSE list_append(k.areas, area) END, 'first_ord': k.first_ord, 'sources': list_sort(list_distinct(list_append(k.sources, url)))}} ELSE k END) END
 FROM (SELECT f.user_id, f.day, r.i, f.kept, r.email, r.title, r.phone, r.area, r.event_id, r.url, list_position(list_transform(f.kept, lambda k:
   (k.email IS NULL OR r.email IS NULL OR k.email = r.email) AND (k.title IS NULL OR r.title IS NULL OR k.title = r.title) AND (k.phone IS NULL OR r.phone IS NULL OR k.phone = r.phone)), true) AS home
  FROM f JOIN r ON r.user_id = f.user_id AND r.day = f.day AND r.i = f.i + 1)),
u AS (SELECT user_id, day, unnest(kept) AS k FROM f QUALIFY i = max(i) OVER (PARTITION BY user_id, day))
SELECT user_id, CAST(day AS TIMESTAMP) AS day, k.email AS email, k.title AS title, k.phone AS phone, k.areas AS areas, k.first_ord AS first_ord, k.sources AS sources FROM u"""


@query("D10_crowded_block", MERGED_SQL)
def d10_crowded(t):
    # Every block counts as crowded.
    return records.merge_records(_contact_records(t), ["user_id", "day"], "event_id", ["email", "title", "phone"], ["areas"], "url", crowded=1)


@query("D10_merged_records", MERGED_SQL)
def d10(t):
    return records.merge_records(_contact_records(t), ["user_id", "day"], "event_id", ["email", "title", "phone"], ["areas"], "url")


@query("D11_record_sources", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources FROM events GROUP BY 1")
def d11(t):
    return records.provenance(t.events, ["user_id"], "event_type").withColumn("sources", F.array_join("sources", ","))


@query("D12_combined_items", f"SELECT DISTINCT user_id, {K} AS k FROM events WHERE {K} % 2 = 0")
def d12(t):
    k = F.get_json_object("props", "$.k").cast("int")
    bad = F.lit('{"k": "none"}')
    results = t.events.select("user_id", F.array(F.when(F.pmod(k, F.lit(2)) == 0, F.col("props")).otherwise(bad), bad).alias("items"))
    return records.combined_items(results, ["user_id"], "items", {"k": "int"})


@query("D13_mixed_results", """
SELECT coalesce(o.o_orderkey, l.l_orderkey) AS id, coalesce(o_orderstatus, st) AS status, coalesce(o_totalprice, total) AS total, n FROM
 (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS o_totalprice FROM orders) o
 FULL OUTER JOIN (SELECT l_orderkey, max(l_linestatus) AS st, max(l_extendedprice) AS total, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey""")
def d13(t):
    single = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
                             F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.col("o_totalprice")).alias("total"))
    multi = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.max("l_linestatus").alias("status"), F.max("l_extendedprice").alias("total"), F.collect_list(F.array("l_partkey")).alias("parts"))
    out = records.mixed(single, multi, "id", ["parts"])
    return out.select("id", "status", "total", F.when(F.col("parts").isNotNull(), F.size("parts")).alias("n"))


@query("D14_spread_children", "SELECT l_orderkey, l_partkey AS item FROM lineitem")
def d14(t):
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"), F.count(F.lit(1)).alias("n"))
    _, children = records.spread(nested, ["l_orderkey"], ["parts"])
    return children["parts"].select("l_orderkey", "item")


@query("D15_concatenated_sources", """
SELECT url, title, 0 AS source_ord FROM (SELECT url, NULL AS title FROM pages) UNION ALL SELECT url, 'P' || page_id, 1 FROM pages WHERE page_id % 3 = 0""")
def d15(t):
    found = t.pages.filter(F.pmod("page_id", F.lit(3)) == 0).select("url", F.concat(F.lit("P"), "page_id").alias("title"))
    return dedup.concatenated([("index", t.pages.select("url")), ("search", found)]).select("url", "title", "source_ord")


@query("D16_one_shape", """
SELECT url, 'page' AS title FROM pages UNION ALL SELECT 'doc:' || doc_id, source FROM documents UNION ALL SELECT 'bench:' || item_id, NULL FROM benchmark""")
def d16(t):
    return dedup.one_shape([
        (t.pages, {"url": F.col("url"), "title": F.lit("page")}),
        (t.documents, {"url": F.concat(F.lit("doc:"), "doc_id"), "title": F.col("source")}),
        (t.benchmark, {"url": F.concat(F.lit("bench:"), "item_id"), "title": F.lit(None).cast("string")})])


@query("D17_distinct_objects", """
SELECT l_orderkey, CAST(count(DISTINCT (l_returnflag, l_linestatus)) AS INTEGER) AS n_objects, CAST(count(*) AS INTEGER) AS n_scalars FROM lineitem GROUP BY 1""")
def d17(t):
    per = t.lineitem.groupBy("l_orderkey").agg(
        F.collect_list(F.struct("l_returnflag", "l_linestatus")).alias("objects"), F.collect_list("l_returnflag").alias("scalars"))
    out = records.distinct_objects(per)
    return out.select("l_orderkey", F.size("objects").alias("n_objects"), F.size("scalars").alias("n_scalars"))


@query("D18_result_urls", """
SELECT o_orderkey, url, type, index FROM (
 SELECT o_orderkey, 'w' || o_custkey AS url, 'web' AS type, 0 AS index FROM orders
 UNION ALL SELECT o_orderkey, o_orderstatus, 'news', 0 FROM orders
 UNION ALL SELECT o_orderkey, 'n' || o_orderkey, 'news', 2 FROM orders
 UNION ALL SELECT o_orderkey, 'i' || o_orderkey, 'image', 0 FROM orders WHERE o_orderkey % 2 = 0)""")
def d18(t):
    item = lambda c: F.struct(c.alias("url"))
    key = F.col("o_orderkey")
    responses = t.orders.select(
        "o_orderkey", F.array(item(F.concat(F.lit("w"), "o_custkey"))).alias("web"),
        F.array(item(F.col("o_orderstatus")), item(F.lit(None).cast("string")), item(F.concat(F.lit("n"), key))).alias("news"),
        F.array(item(F.when(F.pmod(key, F.lit(2)) == 0, F.concat(F.lit("i"), key)).otherwise(""))).alias("images"))
    return dedup.result_urls(responses, "o_orderkey", {"web": "web", "news": "news", "images": "image"})


@query("D19_interest_rows", """
SELECT c_custkey AS monitor_id, target_id, target_type, target_url, n AS scrape_url_count, CAST(60 * (c_custkey % 50 + 1) AS INTEGER) AS interval_seconds,
 round(86400.0 / (60 * (c_custkey % 50 + 1)), 4) AS runs_per_day,
 CASE WHEN 60 * (c_custkey % 50 + 1) <= 900 THEN '15m' WHEN 60 * (c_custkey % 50 + 1) <= 1800 THEN '30m' ELSE 'hourly' END AS frequency_bucket,
 CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS is_active, credits AS estimated_credits_per_run FROM customer, (VALUES
 ('a', 'scrape', 1, 1), ('b', 'scrape', 2, 2), ('c', 'crawl', 0, 10000), ('d', 'crawl', 0, 25)) v(target_id, target_type, n, credits),
 LATERAL (SELECT CASE target_id WHEN 'a' THEN 'https://x.example/' || c_custkey || '/' WHEN 'b' THEN NULL ELSE 'https://y.example/' || c_custkey END AS target_url)""")
def d19(t):
    key = F.col("c_custkey")
    one = F.concat(F.lit("https://x.example/"), key, F.lit("/"))
    other = F.concat(F.lit("https://y.example/"), key)
    none_list, none, no_limit = F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("int")

    def target(i, kind, many, url, limit):
        return F.struct(F.lit(i).alias("id"), F.lit(kind).alias("type"), many.alias("urls"), url.alias("url"), limit.alias("limit"))

    monitors = t.customer.select(
        key.alias("monitor_id"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("paused").alias("status"), F.lit("created").alias("event_type"),
        ((F.pmod(key, F.lit(50)) + 1) * 60000).alias("interval_ms"),
        F.array(target("a", "scrape", F.array(one), none, no_limit), target("b", "scrape", F.array(other, one), none, no_limit),
                target("c", "crawl", none_list, other, no_limit), target("d", "crawl", none_list, other, F.lit(25))).alias("targets"))
    out = dedup.interest_rows(monitors)
    return out.select("monitor_id", "target_id", "target_type", "target_url", "scrape_url_count", "interval_seconds",
                      F.round("runs_per_day", 4).alias("runs_per_day"), "frequency_bucket", "is_active", "estimated_credits_per_run")


# ------------------------------------------------------------------ monitoring

def _snapshots(t):
    """Last capture of every (user, event type) page in two check periods."""
    split = F.lit("2024-01-25").cast("timestamp_ntz")
    rows = t.events.select("user_id", F.col("event_type").alias("url"), "ts", "event_id", F.col("props").alias("markdown"),
                           F.when(F.pmod("event_id", F.lit(13)) == 0, 404).otherwise(200).alias("status_code"))
    last = lambda d: ordered.one_per_key(d, ["user_id", "url"], F.struct("ts", "event_id"), "max").drop("ts", "event_id")
    return last(rows.filter(F.col("ts") < split)), last(rows.filter(F.col("ts") >= split))


SNAP_SQL = f"""(WITH r AS (SELECT user_id, event_type AS url, ts, event_id, {K} AS k, event_id % 13 = 0 AS gone FROM events),
 a AS (SELECT user_id, url, arg_max(k, (ts, event_id)) AS k, arg_max(gone, (ts, event_id)) AS gone FROM r WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2),
 b AS (SELECT user_id, url, arg_max(k, (ts, event_id)) AS k, arg_max(gone, (ts, event_id)) AS gone FROM r WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY 1, 2)
 SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.url, b.url) AS url, CASE WHEN b.url IS NULL THEN 'removed' WHEN b.gone THEN 'removed' WHEN a.url IS NULL THEN 'new'
  WHEN list_sort(string_split(CAST(a.k AS VARCHAR), '')) = list_sort(string_split(CAST(b.k AS VARCHAR), '')) THEN 'same' ELSE 'changed' END AS status
 FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.url = b.url)"""


@query("V5_check_events", f"SELECT user_id, url, status FROM {SNAP_SQL}")
def v5(t):
    before, now = _snapshots(t)
    return monitor.check_events(before, now, ["user_id", "url"]).select("user_id", "url", "status")


@query("V5_check_summary", f"""
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'same') AS same, count(*) FILTER (WHERE status = 'changed') AS changed,
 count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'removed') AS removed, 0::BIGINT AS error,
 CAST(count(*) FILTER (WHERE status <> 'removed') AS BIGINT) AS credits FROM {SNAP_SQL} GROUP BY 1""")
def v5s(t):
    before, now = _snapshots(t)
    return monitor.summary(monitor.check_events(before, now, ["user_id", "url"]), ["user_id"])


@query("V5_page_state", f"""
SELECT user_id, url, CASE WHEN status = 'removed' THEN 'check1' ELSE 'check2' END AS last_seen, status AS last_status, status = 'removed' AS is_removed FROM {SNAP_SQL}""")
def v5p(t):
    before, now = _snapshots(t)
    events = monitor.check_events(before, now, ["user_id", "url"])
    seen = before.select("user_id", "url", F.lit("check1").alias("last_seen"))
    state = monitor.next_state(seen, events, ["user_id", "url"], "check2")
    return state.select("user_id", "url", "last_seen", "last_status", "is_removed")
