"""From raw documents to token ids, in five stages.

``STAGES`` lists (name, function).  A function takes (spark, docs, sf_dir) and returns what it keeps, with the columns
of ``docs``; the last one returns token ids.  ``run`` writes each stage's rows as Parquet below the shared folder and
reads them again, so a lost executor costs at most the stage at hand.

A document is a row, known by its doc_id and a digest of its text (``key``).  Rows without an id, and rows that repeat
an id with another text, are documents like others.  Rows that agree in both are copies, of which the stages that remove
copies keep one.  Null texts are empty texts; their language can't be told, so they go in the first stage.  An empty
table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staygrid.llm import decontaminate, exact, language, sentencepieces, simhash
from staygrid.llm.common import without
from staygrid.session import cut_lineage


def key() -> Column:
    """What tells documents apart; without an id they come last."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (the key) and text, for an operator."""
    return docs.select(key().alias("doc_id"), F.col("text").cast("string").alias("text"))


def leave_out(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``marks`` (doc_id)."""
    rows = docs.select(key().alias("doc_id"), F.struct("*").alias("doc"))
    return without(rows, cut_lineage(marks.select("doc_id").distinct())).select("doc.*")


def one_of_each(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """One row for each key that ``marks`` (doc_id: the key of a row, kept) keeps.

    Rows of one key differ in other columns at most; the first by these, as JSON, stays.
    """
    keys = cut_lineage(marks.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    rows = without(docs.select(key().alias("doc_id"), F.struct("*").alias("doc")), keys.filter(~F.col("kept")))
    repeated = keys.filter(F.col("kept") & (F.col("n") > 1)).select("doc_id")
    if repeated.isEmpty():
        return rows.select("doc.*")
    copies = rows.join(repeated.withColumnRenamed("doc_id", "_key"), F.col("doc_id").eqNullSafe(F.col("_key")), "left_semi")
    first = copies.groupBy("doc_id").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return without(rows, repeated).unionByName(first).select("doc.*")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (operator 10): ``und`` goes."""
    marks = language.identify(keyed(docs), labelled=docs)
    return leave_out(docs, marks.filter(F.col("lang_pred") == language.UNKNOWN))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 6)."""
    return one_of_each(docs, exact.duplicates(keyed(docs)).select("doc_id", "kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (operator 4), one without an id if none has one."""
    marks = simhash.near_duplicates(keyed(docs))
    return one_of_each(docs, marks.select("doc_id", (F.col("component_id") == F.col("doc_id")).alias("kept")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark (operator 3)."""
    marks = decontaminate.contamination(keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leave_out(docs, marks.filter("contaminated"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they spell its text again (operator 5)."""
    return sentencepieces.round_trip(docs)


STAGES = [
    ("language_id", identified),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("sentencepiece", encoded),
]

#: Cross-parsing, SimHash and Viterbi are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
