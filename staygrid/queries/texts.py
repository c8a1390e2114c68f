"""Scalar text rules, chunks, redaction, similarity and change tracking."""

from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import changes, similarity
from ..operators.ordered import DAY, Even, micros, previous_in_order
from ..plans import chunks, redaction
from ..session import cut_lineage, spread
from .registry import query

FROM_LETTERS = "".join(text.FOLDED_LETTERS.values())
TO_LETTERS = "".join(k * len(v) for k, v in text.FOLDED_LETTERS.items())
FOLDED = f"translate(lower({{c}}), '{FROM_LETTERS}', '{TO_LETTERS}')"
def _d():
    return F.col("doc_id")



def _docs(t):
    """Documents on all cores; every text is processed whole."""
    return spread(t.documents, "doc_id")


def _mod(n):
    return F.pmod(_d(), F.lit(n))


@query("C1_normalized_text", """
SELECT doc_id, sha256(nfc_normalize(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS text_hash FROM documents""")
def c1(t):
    decomposed = F.replace(F.concat(F.lit(" \n"), "text", F.lit("\t ")), F.lit("é"), F.lit("é"))
    return _docs(t).select("doc_id", F.sha2(text.normalize_text(decomposed), 256).alias("text_hash"))


@query("C2_slug", f"""
SELECT doc_id, sha256(trim(regexp_replace({FOLDED.format(c='text')}, '[^a-z0-9]+', '_', 'g'), '_')) AS slug_hash FROM documents""")
def c2(t):
    return _docs(t).select("doc_id", F.sha2(text.slug(F.col("text")), 256).alias("slug_hash"))


@query("C3_dash_slug", f"""
SELECT doc_id, sha256(coalesce(nullif(trim(regexp_replace(regexp_replace({FOLDED.format(c='text')}, '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '-'), ''), 'standard-room')) AS slug_hash FROM documents""")
def c3(t):
    return _docs(t).select("doc_id", F.sha2(text.dash_slug(F.col("text")), 256).alias("slug_hash"))


@query("C4_stars", """
SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN p_size % 6 WHEN p_size % 3 = 1 THEN p_partkey % 5 + 1 ELSE 0 END AS INTEGER) AS stars FROM part""")
def c4(t):
    size = F.col("p_size")
    m = F.pmod(size, F.lit(3))
    value = F.when(m == 0, (F.pmod(size, F.lit(6)) + 0.9).cast("string"))
    spelled = F.when(m == 1, F.concat(F.lit("Xếp hạng "), F.pmod("p_partkey", F.lit(5)) + 1, F.lit("  trên 5 sao")))
    return t.part.select("p_partkey", text.star_rating(value, spelled).alias("stars"))


@query("C5_address", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 1000 || ' Phố Một, Quận Hai' WHEN 1 THEN 'Đường ' || c_custkey % 1000 WHEN 2 THEN 'Tổ ' || c_custkey % 1000 ELSE '' END AS street_address,
 CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_mktsegment WHEN 2 THEN 'Đà Nẵng' ELSE '' END AS city,
 CASE c_custkey % 4 WHEN 0 THEN 'VIỆT NAM' WHEN 3 THEN '' ELSE 'Việt Nam' END AS country,
 CASE c_custkey % 4 WHEN 0 THEN c_custkey % 1000 || ' Phố Một, Quận Hai, ' || c_mktsegment || ', VIỆT NAM' WHEN 1 THEN 'Đường ' || c_custkey % 1000 || ', ' || c_mktsegment
  WHEN 2 THEN 'Tổ ' || c_custkey % 1000 ELSE '' END AS full_address FROM customer""")
def c5(t):
    key = F.col("c_custkey")
    m = F.pmod(key, F.lit(4))
    number = F.pmod(key, F.lit(1000))  # five digits would be a postal code
    raw = (F.when(m == 0, F.concat(number, F.lit(" Phố Một ,Quận Hai, 550000 "), "c_mktsegment", F.lit(", VIỆT NAM, gần biển")))
           .when(m == 1, F.concat(F.lit("Đường "), number, F.lit(" ,  "), "c_mktsegment", F.lit(", ")))
           .when(m == 2, F.concat(F.lit(" Tổ "), number)))
    return t.customer.select("c_custkey", text.address_fields(raw).alias("a")).select("c_custkey", "a.*")


@query("C6_policy_times", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '14:00' ELSE '15:0' || (o_orderkey % 10) END AS checkin_time_start,
 CASE WHEN o_orderkey % 3 = 1 THEN '22:00' ELSE '00:00' END AS checkin_time_end,
 CASE WHEN o_orderkey % 2 = 0 THEN '06:00' ELSE '00:00' END AS checkout_time_start,
 CASE WHEN o_orderkey % 2 = 0 THEN '11:30' ELSE '12:00' END AS checkout_time_end FROM orders""")
def c6(t):
    k = F.col("o_orderkey")
    arrive = F.when(F.pmod(k, F.lit(3)) == 0, "Nhận phòng linh hoạt").when(
        F.pmod(k, F.lit(3)) == 1, F.concat(F.lit("NHẬN  phòng\nTừ 15:0"), F.pmod(k, F.lit(10)), F.lit(" - 22:00"))).otherwise(
        F.concat(F.lit("Nhận phòng sớm\nTừ 15:0"), F.pmod(k, F.lit(10))))
    leave = F.when(F.pmod(k, F.lit(2)) == 0, "\nTrả phòng\nTừ 06:00 - 11:30").otherwise("\nkhông rõ")
    return t.orders.select("o_orderkey", text.policy_times(F.concat(arrive, leave)).alias("p")).select("o_orderkey", "p.*")


@query("C9_price_numbers", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE l_linenumber % 4 WHEN 0 THEN floor(l_extendedprice) WHEN 1 THEN floor(l_extendedprice)
 WHEN 2 THEN l_extendedprice ELSE l_extendedprice END AS DOUBLE) AS price FROM lineitem""")
def c9(t):
    price, m = F.col("l_extendedprice"), F.pmod("l_linenumber", F.lit(4))
    grouped = F.format_number(F.floor(price), 0)
    dotted = F.replace(grouped, F.lit(","), F.lit("."))
    exact = F.format_number(price, 2)
    european = F.translate(exact, ",.", ".,")
    raw = (F.when(m == 0, F.concat(F.lit("VND "), dotted)).when(m == 1, F.concat(grouped, F.lit(" đ")))
           .when(m == 2, F.concat(F.lit("US$ "), exact)).otherwise(european))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.price_number(raw).alias("price"))


@query("C10_C11_ids", """
SELECT doc_id, source || '_rev' AS review_id, source || '_' || lang || '_' || doc_id AS room_id,
 substr(sha256(source || '::' || doc_id), 1, 16) AS chunk_id FROM documents""")
def c10(t):
    return t.documents.select("doc_id", F.concat_ws("_", "source", F.lit("rev")).alias("review_id"), F.concat_ws("_", "source", "lang", _d()).alias("room_id"),
                              text.chunk_id(F.col("source"), _d()).alias("chunk_id"))


@query("C12_discount", """
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice * (1 + l_tax - l_discount) END, l_extendedprice) - l_extendedprice), 4) AS discount FROM lineitem""")
def c12(t):
    p = F.col("l_extendedprice")
    original = F.when(F.pmod("l_linenumber", F.lit(2)) == 0, p * (1 + F.col("l_tax") - F.col("l_discount")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(text.discount(original, p), 4).alias("discount"))


@query("C13_property_type", """
SELECT p_partkey, CASE WHEN p_name ILIKE '%ring%' THEN 'Resort' WHEN p_name ILIKE '%red%' THEN 'Căn hộ' WHEN p_name ILIKE '%blue%' THEN 'Biệt thự'
 WHEN p_name ILIKE '%small%' THEN 'Homestay' ELSE 'Khách sạn' END AS property_type FROM part""")
def c13(t):
    name = F.col("p_name")
    for plain, word in (("ring", "Resort"), ("red", "CĂN HỘ"), ("blue", "villa"), ("small", "HomeStay")):
        name = F.replace(name, F.lit(plain), F.lit(plain + " " + word))
    return t.part.select("p_partkey", text.property_type(name).alias("property_type"))


WORDS = ["tion", "über", " la ", "km"]


@query("C14_location_sentences", """
SELECT doc_id, coalesce(string_agg(trim(s), '; ' ORDER BY pos) FILTER (WHERE length(s) < 220 AND regexp_matches(lower(s), 'tion|über| la |km')), '') AS sentences FROM (
 SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS pos FROM (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)) GROUP BY 1""")
def c14(t):
    return _docs(t).select("doc_id", text.sentences_with(F.col("text"), WORDS).alias("sentences"))


@query("C15_comparison_form", """
SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS text_hash FROM documents""")
def c15(t):
    noisy = F.concat(F.lit("\ufeff  "), F.replace("text", F.lit(" "), F.lit("\u200b \n ")))
    return _docs(t).select("doc_id", F.sha2(text.comparison_form(noisy), 256).alias("text_hash"))


@query("C16_strip_junk", """
SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[ \\t]{2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS text_hash FROM documents""")
def c16(t):
    noisy = F.replace("text", F.lit(" "), F.lit(" \u200b\u0007"))
    return _docs(t).select("doc_id", F.sha2(text.strip_junk(F.concat(noisy, F.lit(" \ufeff"))), 256).alias("text_hash"))


@query("C18_C19_schedule", """
SELECT o_orderkey, CASE WHEN s <= 900 THEN '15m' WHEN s <= 1800 THEN '30m' WHEN s <= 3600 THEN 'hourly' WHEN s <= 21600 THEN 'sub_daily' WHEN s <= 86400 THEN 'daily'
 WHEN s <= 604800 THEN 'weekly' ELSE 'other' END AS bucket,
 CASE WHEN least(s * 500, 300000) <= 0 THEN 0 ELSE CAST('0x' || substr(sha256('m' || o_orderkey), 1, 8) AS BIGINT) % least(s * 500, 300000) END AS jitter
FROM (SELECT o_orderkey, (o_orderkey * 97) % 900000 AS s FROM orders)""")
def c18(t):
    s = F.pmod(F.col("o_orderkey") * 97, F.lit(900000))
    return t.orders.select("o_orderkey", text.bucket_label(s).alias("bucket"),
                           text.jitter_offset(F.concat(F.lit("m"), "o_orderkey"), s * 1000, 300_000).alias("jitter"))


@query("C20_inline_images", """
SELECT doc_id, sha256('![a](<Base64-Image-Removed>) ' || text || ' ![](<Base64-Image-Removed>)![k](x.png)') AS text_hash FROM documents""")
def c20(t):
    md = F.concat(F.lit("![a](data:image/png;base64,AAAA==) "), "text", F.lit(" ![](data:image/svg+xml;base64,QQ==)![k](x.png)"))
    return _docs(t).select("doc_id", F.sha2(text.without_inline_images(md), 256).alias("text_hash"))


@query("C21_json_path", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50""")
def c21(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.filter(k >= 50).select("event_id", k.alias("k"))


# --------------------------------------------------------------------- chunks

@query("X1_overlapping_chunks", """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, length(c) AS n_chars, sha256(c) AS content_hash FROM (
 SELECT doc_id, i, regexp_replace(substr(text, CAST(i AS BIGINT) + 1, 1000), '^\\s+|\\s+$', '', 'g') AS c FROM (
  SELECT doc_id, text, unnest(range(0, length(text), 800)) AS i FROM documents)) WHERE c <> ''""")
def x1(t):
    return chunks.overlapping(t.documents, ["doc_id"], "text").select(
        "doc_id", "chunk_no", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_hash"))


@query("X2_boundary_chunks", "SELECT doc_id, md5(text) AS joined_md5, true AS within_limit FROM documents")
def x2(t):
    rows = chunks.at_boundaries(t.documents, ["doc_id"], "text", 2000, 2200)
    back = rows.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "content"))), lambda c: c["content"]), "").alias("joined"),
        F.max(F.octet_length("content")).alias("bytes"), F.max(F.length("content")).alias("chars"))
    both = t.documents.join(back, "doc_id", "left")
    return both.select("doc_id", F.md5(F.coalesce("joined", F.lit(""))).alias("joined_md5"),
                       ((F.coalesce("bytes", F.lit(0)) <= 2200) & (F.coalesce("chars", F.lit(0)) <= 2000)).alias("within_limit"))


def _tail(piece, end):
    """SQL: characters up to the last place in ``piece`` where ``end`` ends; 0 if nowhere."""
    return f"nullif(length(regexp_extract({piece}, '(?s)^{end}')), 0)"


# One step per chunk: the window's upper half is searched for the last paragraph, line, sentence and blank in turn.
CUTS_SQL = f"""
WITH RECURSIVE cuts(doc_id, chunk_no, start, size, rest) AS (
 SELECT doc_id, -1, 0, 0, text FROM documents
 UNION ALL
 SELECT doc_id, chunk_no + 1, start + size, CASE WHEN strlen(substr(rest, 1, n)) <= 165 THEN n ELSE
   list_max(list_filter(range(1, n + 1), lambda k: strlen(substr(rest, 1, k)) <= 165)) END, rest
 FROM (
  SELECT doc_id, chunk_no, start, size, rest, CASE WHEN length(rest) <= 160 THEN length(rest) ELSE 80 + coalesce(
   {_tail('upper_half', '.+' + chr(10) * 2)}, {_tail('upper_half', '.+' + chr(10))}, {_tail('upper_half', '.*[.!?][' + chr(92) + 's' + chr(92) + 'v]')}, {_tail('upper_half', '.+ ')}, 80) END AS n
  FROM (SELECT doc_id, chunk_no, start, size, rest, substr(rest, 81, 80) AS upper_half FROM (
   SELECT doc_id, chunk_no, start, size, substr(rest, size + 1) AS rest FROM cuts) WHERE rest <> '')))
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(start AS INTEGER) AS start, sha256(substr(rest, 1, size)) AS content_hash FROM cuts WHERE chunk_no >= 0"""


@query("X2_cut_points", CUTS_SQL)
def x2_cuts(t):
    chunks.register_table_functions(t.spark)
    return t.spark.sql("""
        SELECT doc_id, chunk_no, start, sha2(content, 256) AS content_hash
        FROM {docs} AS d, LATERAL chunk_markdown(d.text, 160, 165)""", docs=_docs(t))


def _markdown(t):
    """Every document's words as Markdown: tens of them as heading, paragraph, table, code block and list in turn."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 10).cast("int")), lambda i: F.struct(
        F.pmod(i, F.lit(5)).alias("kind"), F.array_join(F.slice("w", i * 10 + 1, F.lit(10)), " ").alias("run")))

    def block(e):
        run, is_ = e["run"], lambda k: e["kind"] == k
        return (F.when(is_(0), F.concat(F.lit("## "), run))
                .when(is_(1), F.concat(F.lit("Say "), run, F.lit(". Then "), run, F.lit("!")))
                .when(is_(2), F.concat(F.lit("| left | "), run, F.lit(" |\n| --- | :-: |\n| "), run, F.lit(" | x |")))
                .when(is_(3), F.concat(F.lit("```py\n"), run, F.lit("\n\n  "), run, F.lit("\n```")))
                .otherwise(F.concat(F.lit("- "), run, F.lit("\n- "), run, F.lit("."))))

    return _docs(t).select("doc_id", words.alias("w")).filter(F.size("w") > 0).select(
        "doc_id", F.array_join(F.transform(runs, block), "\n\n").alias("md"))


# The spans of that Markdown, from the words; five runs give nine spans in six blocks.
SPANS_SQL = """
WITH runs AS (SELECT doc_id, i, array_to_string(list_slice(w, i * 10 + 1, i * 10 + 10), ' ') AS run FROM (
  SELECT doc_id, w, unnest(range(0, (len(w) + 9) // 10)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w FROM documents))),
 spans AS (SELECT doc_id, CAST(i // 5 * 9 + [0, 1, 3, 5, 7][i % 5 + 1] + k AS INTEGER) AS pos, CAST(i // 5 * 6 + i % 5 + CASE WHEN i % 5 = 4 THEN k ELSE 0 END AS INTEGER) AS block,
  ['heading', 'text', 'table', 'code', 'text'][i % 5 + 1] AS kind, CASE WHEN i % 5 = 3 THEN 'py' END AS lang, i % 5 = 2 AND k = 0 AS is_header,
  CASE i % 5 WHEN 1 THEN CASE k WHEN 0 THEN 'Say ' || run || '.' ELSE 'Then ' || run || '!' END WHEN 2 THEN CASE k WHEN 0 THEN 'left | ' || run ELSE run || ' | x' END
   WHEN 4 THEN CASE k WHEN 0 THEN run ELSE run || '.' END ELSE run END AS text
  FROM (SELECT *, unnest([0, 1]) AS k FROM runs) WHERE i % 5 > 0 OR k = 0)"""


@query("X3_markdown_spans", SPANS_SQL + """
SELECT doc_id, pos, block, kind, sha256(text) AS text_hash, lang, is_header FROM spans""")
def x3(t):
    chunks.register_table_functions(t.spark)
    return t.spark.sql("""
        SELECT doc_id, pos, block, kind, sha2(s.text, 256) AS text_hash, lang, is_header
        FROM {docs} AS d, LATERAL md_spans(d.md) AS s""", docs=_markdown(t))


@query("X4_assembled_answer", SPANS_SQL + """,
 marked AS (SELECT *, (pos * 7 + doc_id) % 4 = 0 AS chosen FROM spans),
 blocks AS (SELECT doc_id, block, kind, min(pos) FILTER (chosen OR is_header) AS place,
   string_agg(line, chr(10) ORDER BY pos) FILTER (chosen OR is_header) AS lines, string_agg(line, ' ' ORDER BY pos) FILTER (chosen) AS prose
  FROM (SELECT *, CASE WHEN is_header THEN '| ' || text || ' |' || chr(10) || '| --- | --- |' WHEN kind = 'table' THEN '| ' || text || ' |' ELSE text END AS line FROM marked)
  GROUP BY ALL HAVING bool_or(chosen))
SELECT doc_id, sha256(string_agg(CASE kind WHEN 'code' THEN '```py' || chr(10) || lines || chr(10) || '```' WHEN 'table' THEN lines ELSE prose END, chr(10) || chr(10) ORDER BY place)) AS answer_hash
FROM blocks GROUP BY doc_id""")
def x4(t):
    spans = cut_lineage(chunks.spans_of(_markdown(t), ["doc_id"], "md"))  # read twice
    chosen = spans.filter(F.pmod(F.col("pos") * 7 + _d(), F.lit(4)) == 0).select("doc_id", "pos")
    return chunks.assembled(spans, chosen, ["doc_id"]).select("doc_id", F.sha2("answer", 256).alias("answer_hash"))


@query("X8_site_bundle", """
SELECT source, '# ' || source || chr(10) || chr(10) || string_agg('- [' || doc_id || '](https://x.example/' || doc_id || '): ' || lang, chr(10) ORDER BY doc_id) AS bundle FROM (
 SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20) GROUP BY 1""")
def x8(t):
    from ..plans.rag import site_bundle
    entries = t.documents.select("source", _d().alias("ord"), _d().cast("string").alias("title"),
                                 F.concat(F.lit("https://x.example/"), _d()).alias("url"), F.col("lang").alias("description"))
    return site_bundle(entries, "source", 20)


# ------------------------------------------------------------------ redaction

def _pii_docs(t):
    """Documents with a known contact line around the whole text."""
    return t.documents.select("doc_id", F.concat(
        F.lit("mail a"), _d(), F.lit("@b.co now "), "text", F.lit(" card 4111 1111 1111 1111 end")).alias("body"))


PII_SQL = "(SELECT doc_id, 'mail a' || doc_id || '@b.co now ' || text || ' card 4111 1111 1111 1111 end' AS body FROM documents)"


def _sql_regex(kind):
    # DuckDB's regular expressions have no look-behind and no possessive loops.
    return redaction.PATTERNS[kind].replace("(?<![A-Za-z0-9._%+-])", "").replace("++", "+").replace("'", "''")


@query("X5_sensitive_spans", " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, '{redaction.KIND_ENTITY[kind]}' AS entity, CAST(len(regexp_extract_all(body, '{_sql_regex(kind)}')) AS BIGINT) AS n, array_to_string(regexp_extract_all(body, '{_sql_regex(kind)}'), '|') AS found FROM {PII_SQL} WHERE len(regexp_extract_all(body, '{_sql_regex(kind)}')) > 0"
    for kind in redaction.PATTERNS))
def x5(t):
    # What stands between the offsets, in order, is what the pattern matches.
    docs = _pii_docs(t).select("doc_id", "body")
    spans = redaction.span_rows(docs, ["doc_id"], "body").groupBy("doc_id", "kind", "entity").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("at"))
    body = F.col("body")
    cut = F.transform("at", lambda s: F.substr(body, s["start"] + 1, s["end"] - s["start"]))
    return spans.join(docs, "doc_id").select("doc_id", "kind", "entity", F.size("at").cast("long").alias("n"), F.array_join(cut, "|").alias("found"))


@query("A16_spans_per_entity", "SELECT doc_id, entity, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{redaction.KIND_ENTITY[kind]}' AS entity, len(regexp_extract_all(body, '{_sql_regex(kind)}')) AS n FROM {PII_SQL}"
    for kind in redaction.PATTERNS) + ") WHERE n > 0 GROUP BY 1, 2")
def a16(t):
    spans = redaction.span_rows(_pii_docs(t), ["doc_id"], "body").filter(F.col("entity").isNotNull())
    return spans.groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("n"))


@query("X6_redacted_email", f"""
SELECT doc_id, sha256(regexp_replace(body, '{_sql_regex("EMAIL_ADDRESS")}', '<EMAIL_ADDRESS>', 'g')) AS redacted_hash FROM {PII_SQL}""")
def x6(t):
    out = redaction.redact_documents(_pii_docs(t), ["doc_id"], "body", "tag", ["EMAIL"])
    return out.select("doc_id", F.sha2("redacted", 256).alias("redacted_hash"))


def _replaced(body):
    for kind in redaction.PATTERNS:
        body = f"regexp_replace({body}, '{_sql_regex(kind)}', '<{kind}>', 'g')"
    return body


@query("X6_redacted_all", f"""
SELECT doc_id, 'ok' AS status, sha256({_replaced('body')}) AS redacted_hash FROM {PII_SQL}""")
def x6_all(t):
    out = redaction.redact_documents(_pii_docs(t), ["doc_id"], "body", "tag")
    return out.select("doc_id", "status", F.sha2("redacted", 256).alias("redacted_hash"))


@query("X6_masked_all", f"""
SELECT doc_id, length(body) AS n_chars, CAST({' + '.join(f"len(regexp_extract_all(body, '{_sql_regex(k)}'))" for k in redaction.PATTERNS)} AS INTEGER) AS n_spans FROM {PII_SQL}""")
def x6_mask(t):
    # A mask is as long as what it covers.
    out = redaction.redact_documents(_pii_docs(t), ["doc_id"], "body", "mask")
    return out.select("doc_id", F.length("redacted").alias("n_chars"), "n_spans")


@query("X7_redaction_gate", """
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'skipped' WHEN octet_length(encode(text)) * 40 + 39 > 250000 THEN 'skipped' WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status,
 CASE WHEN doc_id % 9 = 0 THEN 'empty_input' WHEN octet_length(encode(text)) * 40 + 39 > 250000 THEN 'too_large' WHEN doc_id % 5 = 0 THEN 'timeout' END AS reason FROM documents""")
def x7(t):
    big = F.array_join(F.array_repeat(F.col("text"), 40), " ")
    docs = _docs(t).select("doc_id", F.when(_mod(9) == 0, " \n ").otherwise(big).alias("body"))
    gated = docs.select("doc_id", "body", redaction.gate(F.col("body")).alias("gate"))
    skipped = gated.filter(F.col("gate").isNotNull()).select("doc_id", F.lit("skipped").alias("status"), F.col("gate").alias("reason"))
    parts = chunks.at_boundaries(gated.filter(F.col("gate").isNull()), ["doc_id"], "body", dealt=True)
    # Every fifth document's second-last request times out.
    answered = parts.withColumn("ok", ~((_mod(5) == 0) & (F.col("chunk_no") == 0))).withColumn("reason", F.when(~F.col("ok"), "timeout"))
    return skipped.unionByName(redaction.document_status(answered, ["doc_id"]))


# ----------------------------------------------------------------- similarity

SCORE_SQL = """CASE WHEN n1 = 0 AND n2 = 0 THEN 0.0 ELSE (n1 / {len} * (1.0 / 6) + n2 / {len} * (1.0 / 6))
 / (sqrt(pow(n1 / {len}, 2) + pow(n2 / {len}, 2)) * sqrt(pow(1.0 / 6, 2) * 2)) END"""


@query("K1_query_rank", f"""
SELECT page_id, round({SCORE_SQL.format(len='length(url)')}, 6) AS score FROM (
 SELECT page_id, url, len(regexp_extract_all(lower(url), 'en')) AS n1, len(regexp_extract_all(lower(url), 'org')) AS n2 FROM pages)""")
def k1(t):
    score = F.round(vectors.query_score(F.col("url"), "EN-org"), 6)
    return t.pages.select("page_id", score.alias("score")).orderBy(F.desc("score"), "page_id")


@query("K1_document_rank", f"""
SELECT doc_id, round({SCORE_SQL.replace('1.0 / 6', '1.0 / 8').format(len='length(text)')}, 6) AS score FROM (
 SELECT doc_id, text, len(regexp_extract_all(lower(text), 'the')) AS n1, len(regexp_extract_all(lower(text), 'tion')) AS n2 FROM documents)""")
def k1d(t):
    return _docs(t).select("doc_id", F.round(vectors.query_score(F.col("text"), "the tion"), 6).alias("score"))


@query("K2_embedding_rank", """
SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN 0 ELSE round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) END AS score FROM embeddings""")
def k2(t):
    from ..operators.topk import ranked
    asked = t.embeddings.filter(F.col("vec_id") == 1).first().embedding
    failed = F.pmod("vec_id", F.lit(10)) == 3
    score = F.when(~failed, F.round(vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in asked])), 6))
    return ranked(t.embeddings, score, "vec_id").select("vec_id", "score")


@query("K3_relevance_threshold", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 0.45 ELSE 0.6 END AS threshold FROM events WHERE value / 100 >= CASE WHEN event_type = 'view' THEN 0.45 ELSE 0.6 END""")
def k3(t):
    # Relevance limits for one entity and for many.
    limit = F.when(F.col("event_type") == "view", F.lit(0.45)).otherwise(F.lit(0.6))
    return t.events.filter(F.col("value") / 100 >= limit).select("event_id", limit.alias("threshold"))


@query("M1_capture_similarity", """
WITH p AS (SELECT doc_id, text AS a, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents),
w AS (SELECT doc_id, a, b, list_distinct(regexp_extract_all(lower(a), '\\S+')) AS wa, list_distinct(regexp_extract_all(lower(b), '\\S+')) AS wb FROM p WHERE b IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN a = b THEN 1.0 WHEN a = '' OR b = '' THEN 0.0
  ELSE len(list_intersect(wa, wb)) / (len(wa) + len(wb) - len(list_intersect(wa, wb))) END AS sim FROM w)
SELECT doc_id, round(sim, 6) AS similarity, sim >= 0.95 AS is_match FROM s""")
def m1(t):
    docs = _docs(t).select("doc_id", "source", F.col("text").alias("now"))
    pairs = previous_in_order(docs, ["source"], ["doc_id"], Even(_d(), 1_000_000, 100_000), ["now"]).filter(F.col("prev_now").isNotNull())
    scored = pairs.withColumn("s", text.word_set_similarity(F.col("now"), F.col("prev_now")))
    return scored.select("doc_id", F.round("s", 6).alias("similarity"), (F.col("s") >= 0.95).alias("is_match"))


CLASSES_SQL = """w AS (SELECT doc_id, text, list_sort(list_distinct(regexp_extract_all(lower(text), '\\S+'))) AS ws FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, min(doc_id) OVER (PARTITION BY ws, CASE WHEN len(ws) = 0 THEN text END) AS class_id FROM w),
r AS (SELECT class_id, ws, len(ws) AS n FROM c WHERE doc_id = class_id AND len(ws) > 0),
p AS (SELECT a, b, k / (na + nb - k) AS s FROM (
  SELECT x.class_id AS a, y.class_id AS b, x.n AS na, y.n AS nb, len(list_intersect(x.ws, y.ws)) AS k
  FROM r x JOIN r y ON x.class_id < y.class_id AND least(x.n, y.n) >= {least} * greatest(x.n, y.n) - 1e-6))"""


@query("M1_similar_pairs", "WITH " + CLASSES_SQL.format(least=0.95) + " SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.95")
def m1_pairs(t):
    _, pairs = similarity.similar_texts(t.documents, "doc_id", "text", 0.95)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("M1_similar_members", "WITH " + CLASSES_SQL.format(least=0.7) + """,
l AS (SELECT k AS class_id, count(*) AS n_links FROM (SELECT a AS k FROM p WHERE s >= 0.7 UNION ALL SELECT b FROM p WHERE s >= 0.7) GROUP BY 1)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN l USING (class_id)""")
def m1_members(t):
    members, pairs = similarity.similar_texts(t.documents, "doc_id", "text", 0.7)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(links, "class_id", "left").select(F.col("id").alias("doc_id"), "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("M2_extraction_quality", """
WITH p AS (SELECT doc_id, text || ' 10 20.5 30' AS old, CASE doc_id % 3 WHEN 0 THEN text || ' 10 20.5 30' WHEN 1 THEN text || ' 10' ELSE substr(text, 1, CAST(length(text) // 3 AS BIGINT)) END || chr(10) || '| a |' || chr(10) || '| --- |' AS new FROM documents),
n AS (SELECT doc_id, CAST(length(new) AS DOUBLE) / length(old) AS r, list_distinct(regexp_extract_all(new, '\\d+(?:\\.\\d+)?')) AS a, list_distinct(regexp_extract_all(old, '\\d+(?:\\.\\d+)?')) AS b FROM p),
k AS (SELECT *, len(list_intersect(a, b)) / len(b) AS kept FROM n)
SELECT doc_id, round(r, 3) AS length_ratio, round(kept, 3) AS number_ratio, 1 AS new_tables,
 CASE WHEN r >= 0.8 AND kept >= 0.9 THEN 'good' WHEN r >= 0.5 AND kept >= 0.7 THEN 'acceptable' ELSE 'poor' END AS verdict FROM k""")
def m2(t):
    old = F.concat("text", F.lit(" 10 20.5 30"))
    third = F.substr("text", F.lit(1), F.floor(F.length("text") / 3).cast("int"))
    new = F.concat(F.when(_mod(3) == 0, old).when(_mod(3) == 1, F.concat("text", F.lit(" 10"))).otherwise(third), F.lit("\n| a |\n| --- |"))
    q = _docs(t).select("doc_id", old.alias("old"), new.alias("new")).select(
        "doc_id", changes.extraction_quality(F.col("new"), F.col("old")).alias("q"))
    return q.select("doc_id", "q.length_ratio", "q.number_ratio", "q.new_tables", "q.verdict")


@query("M3_edit_similarity", """
SELECT p_partkey, round(1 - levenshtein(p_name, p_brand || ' ' || p_type) / greatest(length(p_name), length(p_brand || ' ' || p_type)), 6) AS similarity FROM part""")
def m3(t):
    return t.part.select("p_partkey", F.round(text.edit_similarity(F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type")), 6).alias("similarity"))


@query("A17_site_verdict", """
WITH c AS (SELECT p_type, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name || ' ' || p_brand END AS gold,
  CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_size % 4 = 0 THEN p_name ELSE p_name || ' ' || p_brand END AS light FROM part),
s AS (SELECT p_type, gold IS NOT NULL AS full_ok, CASE WHEN gold IS NOT NULL AND light <> '' THEN 1 - levenshtein(gold, light) / greatest(length(gold), length(light)) END AS score FROM c),
g AS (SELECT p_type, count(*) AS urls, count(*) FILTER (WHERE NOT full_ok) AS full_failed, count(*) FILTER (WHERE full_ok AND score >= 0.95) AS light_ok FROM s GROUP BY 1)
SELECT *, CASE WHEN full_failed / urls > 0.5 OR urls = full_failed THEN 'uncertain' WHEN light_ok / (urls - full_failed) >= 0.65 THEN 'light_ok' ELSE 'full_required' END AS verdict FROM g""")
def a17(t):
    k = F.col("p_partkey")
    whole = F.concat_ws(" ", "p_name", "p_brand")
    captures = t.part.select("p_type", F.when(F.pmod(k, F.lit(11)) != 0, whole).alias("gold"),
                             F.when(F.pmod(k, F.lit(7)) == 0, "").when(F.pmod("p_size", F.lit(4)) == 0, F.col("p_name")).otherwise(whole).alias("light"))
    return changes.site_verdict(captures, ["p_type"], "gold", "light", enough=0.65)


# -------------------------------------------------------------------- changes

@query("V1_change_status", """
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'removed' ELSE CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'same'
 WHEN 2 THEN CASE WHEN regexp_replace(text, '\\s+', '', 'g') = '' THEN 'changed' ELSE 'changed' END ELSE 'same' END END AS status FROM documents""")
def v1(t):
    previous = F.when(_mod(4) == 1, F.reverse("text")).when(_mod(4) == 2, F.concat("text", F.lit("§"))).when(
        _mod(4) == 3, F.concat(F.lit(" "), "text", F.lit("\n[iframe](x)")))
    code = F.when(_mod(17) == 0, 404).otherwise(200)
    return _docs(t).select("doc_id", changes.change_status(previous, F.col("text"), code).alias("status"))


@query("V2_line_diff", """
SELECT doc_id, n + 2 AS n_lines, md5('del|1||§ old head' || chr(10) || string_agg('normal|' || (i + 1) || '|' || i || '|' || line, chr(10) ORDER BY i) || chr(10) || 'add||' || (n + 1) || '|§ new tail') AS diff_md5
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents) GROUP BY doc_id, n""")
def v2(t):
    pairs = t.documents.select("doc_id", F.concat(F.lit("§ old head\n"), "text").alias("a"), F.concat("text", F.lit("\n§ new tail")).alias("b"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws("|", "type", number("old_line"), number("new_line"), "content")
    rows = changes.line_diff(pairs, ["doc_id"], "a", "b").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines.line", "\n")).alias("diff_md5"))


EVENT_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query("V3_json_leaf_diff", f"""
WITH p AS (SELECT event_id, {EVENT_K} AS k, CAST(json_extract_string(lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id), '$.k') AS INTEGER) AS pk FROM events)
SELECT event_id, 'plans[0].price' AS path, CAST(pk AS VARCHAR) AS previous, CAST(k AS VARCHAR) AS current FROM p WHERE pk IS NOT NULL AND pk <> k
UNION ALL SELECT event_id, 'tags[2]', NULL, '"c"' FROM p WHERE pk IS NOT NULL AND pk % 2 = 1 AND k % 2 = 0
UNION ALL SELECT event_id, 'tags[2]', '"c"', NULL FROM p WHERE pk IS NOT NULL AND pk % 2 = 0 AND k % 2 = 1""")
def v3(t):
    k = F.get_json_object("props", "$.k")
    doc = F.concat(F.lit('{"plans":[{"price":'), k, F.lit(',"name":"x  y"}],"tags":["a","b"'),
                   F.when(F.pmod(k.cast("int"), F.lit(2)) == 0, ',"c"').otherwise(""), F.lit("]}"))
    rows = t.events.select("user_id", "event_id", "ts", doc.alias("doc"))
    pairs = previous_in_order(rows, ["user_id"], ["ts", "event_id"], Even(micros("ts"), 30 * DAY), ["doc"]).filter(F.col("prev_doc").isNotNull())
    return changes.json_diff(pairs, ["event_id"], "prev_doc", "doc")


@query("V4_top_level_diff", f"""
WITH p AS (SELECT event_id, {EVENT_K} AS k, event_type AS e, CAST(json_extract_string(lag(props) OVER w, '$.k') AS INTEGER) AS pk, lag(event_type) OVER w AS pe FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, 'k' AS field, CAST(pk AS VARCHAR) AS previous, CAST(k AS VARCHAR) AS current FROM p WHERE pk IS NOT NULL AND pk <> k
UNION ALL SELECT event_id, 'e', pe, e FROM p WHERE pk IS NOT NULL AND pe <> e""")
def v4(t):
    doc = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("e"), F.lit("c").alias("fixed")))
    rows = t.events.select("user_id", "event_id", "ts", doc.alias("doc"))
    pairs = previous_in_order(rows, ["user_id"], ["ts", "event_id"], Even(micros("ts"), 30 * DAY), ["doc"]).filter(F.col("prev_doc").isNotNull())
    return changes.top_level_diff(pairs, ["event_id"], "prev_doc", "doc")
