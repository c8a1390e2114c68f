"""Top-k, pagination and capped listings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from .ordered import Even, newest_per_key, running_sums_in_order

#: Queries and vectors that one task compares.
QUERY_ROWS, VECTOR_ROWS = 4096, 32768


def nearest(vectors_df: DataFrame, query: list[float], k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Most similar rows to one vector; rows without a vector never match."""
    scored = vectors_df.filter(F.col(vec_col).isNotNull()).withColumn(
        "similarity", vectors.cosine(F.col(vec_col), F.array(*[F.lit(float(x)) for x in query])))
    return scored.orderBy(F.desc("similarity"), F.col(id_col)).limit(k)


def nearest_batch(
    vectors_df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    query_id: str = "query_id", query_vec: str = "query", query_rows: int = QUERY_ROWS, vector_rows: int = VECTOR_ROWS,
) -> DataFrame:
    """Top ``k`` rows by cosine similarity for every query of a table: (query_id, id, similarity, position).

    A block-wise join.  Both tables are dealt into slices of bounded size; every slice of queries meets every slice of
    vectors in one task, which scores them by one matrix product and keeps ``k`` rows per query, so only those are
    shuffled again.  Any number of queries works: the vectors travel once per slice of queries, the queries once per
    slice of vectors, and a task never holds more than one slice of each.  Rows and queries without a vector never
    match; a vector without length has similarity 0 to all, ties go to the smaller id.  Vectors have equal lengths.
    """
    rows = vectors_df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col), F.col(vec_col).cast("array<double>").alias("_v"))
    asked = queries.filter(F.col(query_vec).isNotNull()).select(F.col(query_id), F.col(query_vec).cast("array<double>").alias("_q"))
    n_asked, n_rows = asked.count(), rows.count()
    # Slices double while there are more pairs of them than the cores need, up to what a task may hold: they travel less.
    enough = 16 * vectors_df.sparkSession.sparkContext.defaultParallelism
    while -(-n_asked // query_rows) * -(-n_rows // vector_rows) > enough and (query_rows < QUERY_ROWS or vector_rows < VECTOR_ROWS):
        query_rows, vector_rows = max(query_rows, min(2 * query_rows, QUERY_ROWS)), max(vector_rows, min(2 * vector_rows, VECTOR_ROWS))
    over, across = (max(1, -(-n // size)) for n, size in ((n_asked, query_rows), (n_rows, vector_rows)))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def slice_of(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    left = asked.select(query_id, "_q", slice_of(query_id, over).alias("_a"), every(across).alias("_b"))
    right = rows.select(id_col, "_v", every(over).alias("_a"), slice_of(id_col, across).alias("_b"))

    def best(asked_part: pd.DataFrame, row_part: pd.DataFrame) -> pd.DataFrame:
        if asked_part.empty or row_part.empty:
            return pd.DataFrame({query_id: [], id_col: [], "similarity": []})
        matrix, vecs = np.stack(asked_part["_q"].to_numpy()), np.stack(row_part["_v"].to_numpy())
        asked_ids = asked_part[query_id].to_numpy()
        ids, lengths = row_part[id_col].to_numpy(), np.linalg.norm(vecs, axis=1)
        out = []
        for at in range(0, len(matrix), 256):  # scores of some queries at a time
            some = matrix[at:at + 256]
            size = np.outer(np.linalg.norm(some, axis=1), lengths)
            with np.errstate(divide="ignore", invalid="ignore"):
                sim = np.where(size == 0, 0.0, some @ vecs.T / size)
            least = np.partition(sim, -k, axis=1)[:, -k] if sim.shape[1] > k else np.full(len(sim), -np.inf)
            # All rows that may be among the first k, of all these queries at once.
            asks, near = np.nonzero(sim >= least[:, None])
            score = sim[asks, near]
            order = np.lexsort((ids[near], -score, asks))
            asks, near, score = asks[order], near[order], score[order]
            place = np.arange(len(asks)) - np.searchsorted(asks, asks)
            asks, near, score = asks[place < k], near[place < k], score[place < k]
            out.append((asked_ids[at + asks], ids[near], score))
        return pd.DataFrame({name: np.concatenate(part) for name, part in zip((query_id, id_col, "similarity"), zip(*out))})

    kinds = dict(queries.dtypes), dict(vectors_df.dtypes)
    schema = f"{query_id} {kinds[0][query_id]}, {id_col} {kinds[1][id_col]}, similarity double"
    partial = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(best, schema)
    return newest_per_key(partial, [query_id], [F.desc("similarity"), F.col(id_col)], k, "position")


def ranked(links: DataFrame, score: Column, order: str) -> DataFrame:
    """Best score first, earlier input first among equals; a missing score is 0."""
    return links.withColumn("score", F.coalesce(score, F.lit(0.0))).orderBy(F.desc("score"), F.col(order))


def keyset_page(
    df: DataFrame, ts: str, row_id: str, since: Column, size: int, cursor: tuple | None = None,
) -> DataFrame:
    """One page in (ts, id) descending order, with ``has_more``.

    Only ``size + 1`` rows leave the sort, so the closing count is tiny.
    """
    if not 1 <= size <= 100:
        raise ValueError("page size must be 1..100")
    rows = df.filter(F.col(ts) >= since)
    if cursor is not None:
        at, last = F.lit(cursor[0]).cast(dict(df.dtypes)[ts]), F.lit(cursor[1])
        rows = rows.filter((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(row_id) < last)))
    order = [F.col(ts).desc(), F.col(row_id).desc()]
    page = rows.orderBy(*order).limit(size + 1)
    numbered = page.select(
        "*", F.row_number().over(W.orderBy(*order)).alias("_rn"),
        F.count(F.lit(1)).over(W.partitionBy()).alias("_n"),
    )
    return numbered.filter(F.col("_rn") <= size).withColumn("has_more", F.col("_n") > size).drop("_rn", "_n")


def capped_listing(
    df: DataFrame, key: list[str], order: str, bucket: Column | Even, size: Column, cap: int,
) -> DataFrame:
    """Rows of each listing until their sizes reach ``cap``; always at least one."""
    size = F.coalesce(size, F.lit(0))
    total = running_sums_in_order(df, key, [order], bucket, {"bytes_so_far": size, "_rows": F.lit(1)})
    return total.filter((F.col("bytes_so_far") <= cap) | (F.col("_rows") == 1)).drop("_rows")


def top_by_count(df: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """Most frequent items per group."""
    counts = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("event_count"))
    return newest_per_key(counts, [group], [F.desc("event_count"), F.col(item)], n, "rank")
