"""Data-quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import orphans


def foreign_key_report(checks: list[tuple]) -> DataFrame:
    """Violations per (name, child, fk, parent, pk)."""
    parts = []
    for name, child, fk, parent, pk in checks:
        n = orphans(child.select(fk), fk, parent.select(pk), pk).agg(F.count(F.lit(1)).alias("violations"))
        parts.append(n.select(F.lit(name).alias("fk"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def null_report(df: DataFrame, required: list[str]) -> DataFrame:
    """NULLs per required column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counts.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in required]), F.array(*[F.col(c) for c in required]))).alias("column_name", "n_null"))


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, column list and some row as a sample (as JSON) per table.

    The count reads no column and the sample one row.
    """
    counts = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(", ".join(df.columns)).alias("columns")) for name, df in tables.items()])
    samples = reduce(DataFrame.unionByName, [df.limit(1).select(
        F.lit(name).alias("table_name"), F.to_json(F.struct(*df.columns)).alias("sample_row")) for name, df in tables.items()])
    return counts.join(samples, "table_name", "left").select("table_name", "n_rows", "columns", "sample_row")


def check_counts(counts: DataFrame, expected: dict[str, int]) -> None:
    """Fail loudly when a load did not give the expected number of rows."""
    names = list(expected)
    got = {r.table_name: r.n_rows for r in counts.filter(F.col("table_name").isin(names)).limit(len(names) + 1).collect()}
    wrong = {n: (got.get(n), expected[n]) for n in names if got.get(n) != expected[n]}
    if wrong:
        raise AssertionError(f"row counts (got, expected): {wrong}")


def failed_rows(jobs: DataFrame, race_codes: list[str]) -> DataFrame:
    """Failed jobs with code and message out of their JSON error; redirect races dropped.

    An error that is not JSON is its own message.
    """
    parsed = F.from_json("error", "code string, message string")
    failed = jobs.filter(F.col("status") == "failed").withColumn("_e", parsed)
    code = F.coalesce(F.col("_e.code"), F.lit("UNKNOWN_ERROR"))
    return failed.withColumn("error_code", code).filter(~code.isin(race_codes)).select(
        *[c for c in jobs.columns if c not in ("status", "error")], "error_code",
        F.coalesce(F.col("_e.message"), F.col("error")).alias("message"))
