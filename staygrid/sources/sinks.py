"""Writing tables: export, first-write-wins append, upsert, replace by key.

None of the writers overwrites the files it reads: a table is replaced by
writing a new path, which the caller then publishes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import one_per_key
from ..session import cut_lineage

DIMENSIONS_OVERWRITE, FACTS_APPEND = "overwrite", "append"


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with header; ``bom`` marks the first header for spreadsheet programs.

    Text in Spark 4 is written in any supported charset, so the mark is simply
    part of the first column's name.  Nested columns become JSON texts.
    """
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    df = df.withColumns({c: F.to_json(F.col(c)) for c in nested})
    out = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if bom else df
    out.write.option("header", "true").option("escape", '"').option("nullValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def export_tables(spark: SparkSession, tables: dict[str, DataFrame] | None, folder: str, database: str | None = None) -> list[str]:
    """Every given table, or every table of a database, as CSV below ``folder``."""
    if tables is None:
        tables = {t.name: spark.table(t.name) for t in spark.catalog.listTables(database)}
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")
    return sorted(tables)


def new_rows(incoming: DataFrame, stored: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Incoming rows whose key is not stored yet; the earliest of repeated keys."""
    first = F.col(order) if order else F.struct(*[F.col(c) for c in incoming.columns])
    unique = one_per_key(incoming, key, first)
    return unique.join(stored.select(*key), key, "left_anti").select(*incoming.columns)


def append_first_wins(spark: SparkSession, incoming: DataFrame, path: str, key: list[str], order: str | None = None, partition_by: list[str] | None = None) -> None:
    """Append that never changes a stored key; running it twice adds nothing."""
    stored = _read_or_empty(spark, path, incoming)
    writer = new_rows(incoming, stored, key, order).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_jdbc(incoming: DataFrame, stored_keys: DataFrame, key: list[str], options: dict[str, str], order: str | None = None) -> None:
    """Same rule against a database; connection options come from the caller."""
    new_rows(incoming, stored_keys, key, order).write.format("jdbc").options(**{"batchsize": "1000", **options}).mode("append").save()


def load_warehouse(tables: dict[str, DataFrame], folder: str, facts: dict[str, list[str]], partition_by: dict[str, list[str]] | None = None) -> None:
    """Dimensions replaced, facts appended by key (so a repeated load is harmless)."""
    for name, df in tables.items():
        path = f"{folder}/{name}"
        if name in facts:
            append_first_wins(df.sparkSession, df, path, facts[name], partition_by=(partition_by or {}).get(name))
        else:
            replace_folder(df, path)


def replace_folder(df: DataFrame, path: str, check: Callable[[], None] | None = None) -> None:
    """Write beside ``path`` and then swap, so that a failed write (or ``check`` after it) leaves the old data in place."""
    spark = df.sparkSession
    fresh, old = f"{path}-new-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    if check is not None:
        check()
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)) or not fs.rename(at(fresh), at(path)):
        raise OSError(f"could not put {fresh} in the place of {path}")
    if had:
        fs.delete(at(old), True)


def _read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
        return spark.read.schema(like.schema).parquet(path)
    return like.limit(0)


def upserted(stored: DataFrame, incoming: DataFrame, key: str, replace: list[str], order: str | None = None) -> DataFrame:
    """Last write wins for ``replace`` columns; the others keep their first value.

    A replaced column takes the new row's value, NULL included.
    """
    last = F.col(order) if order else F.struct(*[F.col(c) for c in incoming.columns if c != key])
    unique = one_per_key(incoming, [key], last, "max")
    s, n = stored.alias("s"), unique.alias("n")
    joined = s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer")
    has_new, has_old = F.col(f"n.{key}").isNotNull(), F.col(f"s.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(f"s.{c}"), F.col(f"n.{c}"))
        if c in replace:
            return F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}"))
        return F.when(has_old, F.col(f"s.{c}")).otherwise(F.col(f"n.{c}"))

    return joined.select(*[value(c).alias(c) for c in stored.columns])


def replaced_by_key(stored: DataFrame, incoming: DataFrame, key: str, batch_keys: DataFrame | None = None) -> DataFrame:
    """All rows of the batch's keys replaced, in every table that has the key."""
    keys = (batch_keys if batch_keys is not None else incoming).select(key).distinct()
    return stored.join(keys, key, "left_anti").select(*stored.columns).unionByName(incoming.select(*stored.columns))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def store_by_key(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A table in ``buckets`` partitions by a hash of the key, for ``replace_partitions``."""
    df.withColumn("_bucket", _bucket(key, buckets)).repartition("_bucket", F.xxhash64(*df.columns) % 8).write.partitionBy("_bucket").parquet(path)


def replace_partitions(incoming: DataFrame, path: str, key: str, buckets: int = 64, batch_keys: DataFrame | None = None) -> None:
    """All stored rows of the batch's keys replaced, in the partitions these keys are in; other partitions keep their files.

    The new content is worked out from the affected partitions alone and written aside, then swapped in by a dynamic
    partition overwrite; a partition that loses its last row is removed.  A repeated batch changes nothing.  A null key
    is a key like others.
    """
    spark = incoming.sparkSession
    keys = cut_lineage((batch_keys if batch_keys is not None else incoming).select(key).distinct().withColumn("_bucket", _bucket(key, buckets)))
    # At most ``buckets`` numbers.
    affected = [r["_bucket"] for r in keys.select("_bucket").distinct().collect()]
    stored = spark.read.parquet(path).filter(F.col("_bucket").isin(affected))
    gone = keys.select(F.col(key).alias("_key"))
    kept = stored.join(gone, stored[key].eqNullSafe(gone["_key"]), "left_anti").drop("_bucket")
    content = cut_lineage(kept.unionByName(incoming.select(*kept.columns)).withColumn("_bucket", _bucket(key, buckets)))
    content.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    filled = {r["_bucket"] for r in content.select("_bucket").distinct().collect()}
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket in set(affected) - filled:
        fs.delete(at(f"{path}/_bucket={bucket}"), True)


def load_observed(tables: dict[str, DataFrame], folder: str, keys: dict[str, str], expected: dict[str, int] | None = None) -> DataFrame:
    """Writes every table and reports (table_name, n_rows, null_keys, bad_keys) as the write itself saw them.

    The figures are observed while the rows pass on their way to the files, so nothing is read a second time.  ``keys``
    names each table's key; a bad one is blank or has white space around it.  With ``expected`` a table with another
    number of rows is an error, raised before its folder is swapped in.
    """
    report = []
    for name, df in tables.items():
        key = F.col(keys[name]).cast("string")
        seen = Observation(f"load-{name}-{uuid.uuid4().hex}")
        watched = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(key.isNull()).alias("null_keys"),
                             F.count_if((key == "") | (key != F.trim(key))).alias("bad_keys"))

        def check(name: str = name, seen: Observation = seen) -> None:
            if expected and name in expected and seen.get["n_rows"] != expected[name]:
                raise AssertionError(f"{name}: {seen.get['n_rows']} rows, expected {expected[name]}")

        replace_folder(watched, f"{folder}/{name}", check)
        report.append((name, seen.get["n_rows"], seen.get["null_keys"], seen.get["bad_keys"]))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(report, "table_name string, n_rows long, null_keys long, bad_keys long")


def rebuild(tables: dict[str, DataFrame], folder: str) -> None:
    """Throw away the warehouse and write it again from its sources."""
    for name, df in tables.items():
        replace_folder(df, f"{folder}/{name}")


def with_new_columns(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Additive evolution: columns missing on one side become NULL."""
    return stored.unionByName(incoming, allowMissingColumns=True)
