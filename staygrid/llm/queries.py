"""Registered queries of the operators of this folder, next to their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staygrid.llm import attribution, decontaminate, exact, language, lexical, licenses, negatives, pagetrees, repeats, sentencepieces, simhash, toxicity, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query("op6_exact_dedup", r"""
    WITH t AS (
        SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
        FROM documents),
    g AS (
        SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS rn, count(*) OVER (PARTITION BY norm) AS size,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep
        FROM t)
    SELECT doc_id, keep AS keep_id, size AS group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM g""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return exact.duplicates(documents(spark, folder))


@query("op3_benchmark_decontamination", r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    iw AS (
        SELECT DISTINCT item_id, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS content
        FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
    dw AS (
        SELECT doc_id, s, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS content
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
    hits AS (SELECT * FROM dw WHERE (size, content) IN (SELECT (size, content) FROM iw)),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
    m AS (
        SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits JOIN iw USING (size, content)) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


@query("op5_sentencepiece")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepieces.round_trip(documents(spark, folder))


@query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(documents(spark, folder))


@query("op1_token_attribution")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return attribution.page_tokens(documents(spark, folder))


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    chain = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    return toxicity.score(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"), chain)


@query("op8_license_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder))


@query("op9_token_shards")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return wavelet.token_files(documents(spark, folder))


@query("op7_repeated_spans", r"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (
        SELECT doc_id, i, md5_number(substr(h, 2 * i - 1, 200)) AS k
        FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 98)) AS i FROM d)),
    f AS (SELECT k, min((doc_id, i)) AS first FROM w GROUP BY k HAVING count(*) > 1),
    s AS (SELECT doc_id, i FROM w JOIN f USING (k) WHERE (doc_id, i) > first),
    g AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS begins FROM s),
    n AS (SELECT doc_id, i, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
    r AS (SELECT doc_id, run, min(i) AS a, max(i) + 99 AS b FROM n GROUP BY doc_id, run),
    p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
    m AS (
        SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans, max(b) AS last,
               string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS kept
        FROM p JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
    FROM d LEFT JOIN m USING (doc_id)""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, folder))


@query("op11_hard_negatives", r"""
    WITH e AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
        FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (
        SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
    SELECT * FROM n WHERE rank <= 5""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").filter(negatives.finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select("vec_id", label.alias("label"), negatives.quantised(F.col("embedding")).alias("vector"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


@query("op13_lexical_search", r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
    i AS (
        SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
    c AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
    tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
    s AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
        FROM i JOIN tf USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT * FROM r WHERE rank <= 10""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query("op12_html_extraction")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return pagetrees.extract(spark.read.parquet(f"{folder}/pages.parquet"))
