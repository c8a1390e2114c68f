"""Structured Streaming jobs.

Event time is bounded by a watermark everywhere; rows later than that are
dropped.  Sinks are keyed by micro-batch id, so replaying a batch after a
failure rewrites the same folder instead of adding rows twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import usage
from ..operators.ordered import one_per_key


def table_stream(spark: SparkSession, folder: str, glob: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as a stream, at most ``files_per_batch`` new files per micro-batch."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("pathGlobFilter", glob).parquet(folder))


def _trigger(writer, interval: str | None):
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def append_rows(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Queued rows appended in batches."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return _trigger(writer, interval).start()


def per_batch(stream: DataFrame, path: str, checkpoint: str, make, mode: str = "append", interval: str | None = None) -> StreamingQuery:
    """Writes ``make(batch)`` to the batch's own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    return _trigger(writer, interval).start()


def bill_usage(ops: DataFrame, path: str, checkpoint: str, interval: str | None = "15 seconds") -> StreamingQuery:
    """Usage grouped per micro-batch; groups of one batch are committed together."""
    return per_batch(ops, path, checkpoint, usage.billing_groups, interval=interval)


def billed_totals(spark: SparkSession, path: str) -> DataFrame:
    """All committed batches added up."""
    keys = ["team_id", "subscription_id", "endpoint", "is_extract", "api_key_id"]
    sums = ["total_credits", "untracked_credits", "operations"]
    return spark.read.parquet(path).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def first_seen(stream: DataFrame, keys: list[str], ts: str, keep_for: str = "24 hours") -> DataFrame:
    """First row per key; a key is forgotten ``keep_for`` after its first row."""
    return stream.withWatermark(ts, keep_for).dropDuplicatesWithinWatermark(keys)


def request_rates(stream: DataFrame, mode: str, ts: str, keys: list[str] | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Requests per mode (and key) in one-minute windows."""
    counted = stream.withWatermark(ts, lateness).groupBy(F.window(ts, "1 minute"), mode, *(keys or [])).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(F.col("window.start").alias("minute"), mode, *(keys or []), "requests")


def latest_per_window(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Updated aggregates: the newest batch's value of each window counts."""
    rows = spark.read.parquet(path)
    return one_per_key(rows, keys, F.col("batch_id"), "max").drop("batch_id")


def over_limit(rates: DataFrame, limit: Column) -> DataFrame:
    return rates.withColumn("rate_limit", limit).withColumn("over", F.col("requests") > F.col("rate_limit"))


def recent_activity(stream: DataFrame, keys: list[str], ts: str, lateness: str = "1 hour") -> DataFrame:
    """Counts over the trailing 24 hours, moved on every hour."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, "24 hours", "1 hour"), *keys).agg(F.count(F.lit(1)).alias("n"))
