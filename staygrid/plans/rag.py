"""Document chunks with vectors: ingest, retrieve, site bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import newest_per_key
from ..operators.topk import nearest
from .chunks import ingest


def ingest_documents(docs: DataFrame, source: str, body: str, chunk_vectors: DataFrame | None = None, created_at=None) -> DataFrame:
    """Rows for the chunk table; vectors come from the caller, keyed by chunk id."""
    rows = ingest(docs, source, body)
    if chunk_vectors is not None:
        rows = rows.join(chunk_vectors.select("id", "embedding"), "id", "left")
    return rows.withColumn("metadata", F.lit("{}")).withColumn("created_at", created_at if created_at is not None else F.current_timestamp())


def retrieve(chunks: DataFrame, question: list[float], k: int = 5, separator: str = "\n\n---\n\n") -> DataFrame:
    """Context text, sorted sources and number of chunks for one question."""
    top = nearest(chunks, question, k, "id", "embedding")
    part = F.struct((-F.col("similarity")).alias("s"), F.col("id"), F.concat(F.lit("["), "source", F.lit("]\n"), "content").alias("text"))
    return top.agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"]), separator).alias("context"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.count(F.lit(1)).alias("chunks_used"))


def site_bundle(entries: DataFrame, site: str, max_entries: int) -> DataFrame:
    """Header and ``- [title](url): description`` lines of the first entries of each site."""
    kept = newest_per_key(entries, [site], [F.col("ord"), F.col("url")], max_entries)
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit("): "), "description")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ord", "url", line.alias("line")))), lambda e: e["line"])
    return kept.groupBy(site).agg(lines.alias("_lines")).select(
        site, F.concat(F.lit("# "), F.col(site), F.lit("\n\n"), F.array_join("_lines", "\n")).alias("bundle"))
