"""Reading files with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "encoding": "UTF-8"}


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """The first path of the list that exists, on any Hadoop file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for c in candidates:
        path = jvm.org.apache.hadoop.fs.Path(c)
        if path.getFileSystem(conf).exists(path):
            return c
    raise FileNotFoundError(", ".join(candidates))


def read_flat_hotels(spark: SparkSession, path, schema: str = schemas.FLAT_HOTEL) -> DataFrame:
    """Flat CSV; quoted values may span lines, so a file is one split: keep files small."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def file_stem(path: Column, suffix: str) -> Column:
    return F.regexp_replace(F.url_decode(F.substring_index(path, "/", -1)), suffix.replace(".", r"\.") + "$", "")


def read_html_folder(spark: SparkSession, folder: str, ending: str = ".html") -> DataFrame:
    """One row per page file: key (file name), html."""
    pages = spark.read.option("pathGlobFilter", "*" + ending).text(folder, wholetext=True)
    return pages.select(file_stem(F.col("_metadata.file_name"), ending).alias("key"), F.col("value").alias("html"))


def read_text_documents(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Bytes decoded as UTF-8, broken sequences replaced: source, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    # Broken byte sequences become U+FFFD.
    decoded = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "")
    return files.select(file_stem(F.col("path"), "").alias("source"), decoded.alias("content"))


def read_nested_hotels(spark: SparkSession, path, schema: str = schemas.RAW_HOTEL) -> DataFrame:
    """JSON lines or one JSON array per file."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_sitemap_urls(spark: SparkSession, path, row_tag: str = "url") -> DataFrame:
    """``<url>`` (or ``<sitemap>``) entries of sitemap files as rows (loc)."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema("loc string").load(path)
    return rows.select(F.trim("loc").alias("loc")).filter(F.col("loc").isNotNull() & (F.col("loc") != ""))
