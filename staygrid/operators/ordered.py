"""Order-dependent operators that stay balanced when one key is hot.

A plain ``lag``/``rank`` window sends all rows of a key to one task.  Here the
rows of a key are first cut into *buckets* of the order column, by a rule that
depends on the row alone (so it is the same in every task retry).  The window
runs per (key, bucket); what has to cross a bucket border - a count, a sum, a
last row - is aggregated map-side to one row per (key, bucket) and joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


@dataclass(frozen=True)
class Even:
    """Buckets of about ``rows`` rows along a numeric ``position`` of the order.

    A key's rows are cut at multiples of ``width``; a piece with more than
    ``rows`` rows is cut further at quantiles of its own positions, so a burst
    is parted by counts.  Rows of one and the same position stay together
    unless ``tie``, a numeric column that orders them, parts them the same way.
    Rows without a position come first, or last with ``nulls_last``, as they do
    in the order; the result never depends on ``rows``.
    """

    position: Column
    width: float
    rows: int = 1_000_000
    tie: Column | None = None
    nulls_last: bool = False


def _counted(d: DataFrame, piece: list[str], rows: int) -> DataFrame | None:
    """_piece, _n of the pieces with more than ``rows`` rows, if there are any.

    At most (all rows / ``rows``) pieces are, however many keys there are.  They are counted by a plain aggregate and
    stored, so joins with them know their real size; usually there are none.
    """
    of = F.struct(*piece)  # a struct: its NULL fields are equal to each other
    found = cut_lineage(d.groupBy(of.alias("_piece")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows))
    return None if found.isEmpty() else found


def _bounds(d: DataFrame, crowded: DataFrame, piece: list[str], value: str, rows: int) -> DataFrame:
    """_piece, _bounds: quantiles of ``value`` that cut crowded pieces to about ``rows`` rows."""
    quantiles = F.percentile_approx(value, F.array(*[F.lit(i / _QUANTILES) for i in range(1, _QUANTILES)]), 20 * _QUANTILES)
    found = d.withColumn("_piece", F.struct(*piece)).join(crowded, "_piece").groupBy("_piece").agg(F.first("_n").alias("_n"), quantiles.alias("_q"))
    parts = F.least(F.ceil(F.col("_n") / rows), F.lit(_QUANTILES)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(parts - 1, F.lit(1))), lambda i: F.element_at(
        "_q", F.greatest(F.floor(i * _QUANTILES / parts).cast("int"), F.lit(1))))
    return found.select("_piece", F.array_distinct(cuts).alias("_bounds"))


def _part(value: str) -> Column:
    return F.size(F.filter("_bounds", lambda q: q < F.col(value)))


def _cut(d: DataFrame, rows: int) -> DataFrame:
    """Crowded pieces _c in parts of about ``rows`` rows by _p."""
    crowded = _counted(d, ["_k", "_c"], rows)
    if crowded is None:
        return d.withColumn("_c", F.struct("_c", F.lit(0).alias("d")))
    joined = d.withColumn("_piece", F.struct("_k", "_c")).join(_bounds(d, crowded, ["_k", "_c"], "_p", rows), "_piece", "left")
    part = F.when(F.col("_bounds").isNull(), 0).otherwise(_part("_p"))
    return joined.withColumn("_c", F.struct("_c", part.alias("d"))).drop("_piece", "_bounds")


def _cut_ties(d: DataFrame, rows: int) -> DataFrame:
    """Positions _p of more than ``rows`` rows in parts by _t; the other rows of their pieces before, between and behind them."""
    pieces = _counted(d, ["_k", "_c"], rows)
    if pieces is None:
        return d
    inside = d.withColumn("_piece", F.struct("_k", "_c")).join(pieces, "_piece", "left_semi").drop("_piece")
    crowded = _counted(inside, ["_k", "_c", "_p"], rows)
    if crowded is None:
        return d
    bounds = _bounds(inside, crowded, ["_k", "_c", "_p"], "_t", rows)
    places = crowded.groupBy(F.struct("_piece._k", "_piece._c").alias("_whole")).agg(F.collect_list("_piece._p").alias("_at"))  # at most a piece / ``rows``
    joined = d.withColumn("_whole", F.struct("_k", "_c")).withColumn("_piece", F.struct("_k", "_c", "_p"))
    joined = joined.join(places, "_whole", "left").join(bounds, "_piece", "left")
    side = F.coalesce(F.size(F.filter("_at", lambda q: q < F.col("_p"))), F.lit(0))
    part = F.when(F.col("_bounds").isNull(), -1).otherwise(_part("_t"))
    return joined.withColumn("_c", F.struct("_c", side.alias("s"), part.alias("e"))).drop("_piece", "_whole", "_at", "_bounds")


#: Cuts that a crowded piece can get at once.
_QUANTILES = 256


def _bucketed(df: DataFrame, keys: list[str], bucket: Column | Even) -> DataFrame:
    """``df`` with its bucket in ``_b`` and its key in ``_k``.

    Both are structs: they are never NULL and NULL fields compare as equal, so
    grouping, windows and plain equi-joins on (_k, _b) share one partitioning
    and lose no row.
    """
    d = df.withColumn("_k", F.struct(*keys))
    if not isinstance(bucket, Even):
        return d.withColumn("_b", F.struct(bucket.alias("c")))
    at = d.withColumn("_p", bucket.position.cast("double") / bucket.width)
    # -1 and 1 stand around the rows that have a position.
    at = at.withColumn("_c", F.struct(F.when(F.col("_p").isNull(), F.lit(1 if bucket.nulls_last else -1)).otherwise(0).alias("null"), F.floor("_p").alias("c")))
    at = _cut(at, bucket.rows)
    if bucket.tie is not None:
        at = _cut_ties(at.withColumn("_t", bucket.tie.cast("double")), bucket.rows)
    return at.select(*d.columns, F.col("_c").alias("_b"))


def micros(ts: str) -> Column:
    """Position of a timestamp column."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


DAY = 86_400_000_000


def _columns(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def row_number_in_order(
    df: DataFrame, keys: list[str], order: list, bucket: Column | Even, out: str
) -> DataFrame:
    """``row_number() over (partition by keys order by order)``.

    ``bucket`` must not decrease along ``order``.
    """
    d = _bucketed(df, keys, bucket)
    counts = d.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_k", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = d.withColumn("_rn", F.row_number().over(W.partitionBy("_k", "_b").orderBy(*_columns(order))))
    joined = ranked.join(offsets, ["_k", "_b"])
    return joined.select(*df.columns, (F.col("_rn") + F.col("_before")).cast("int").alias(out))


def running_sums_in_order(
    df: DataFrame, keys: list[str], order: list, bucket: Column | Even, values: dict[str, Column]
) -> DataFrame:
    """``sum(value) over (partition by keys order by order rows unbounded preceding)`` for each named value."""
    d = _bucketed(df, keys, bucket)
    for name, value in values.items():
        d = d.withColumn(f"_v_{name}", value)
    totals = d.groupBy("_k", "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_k", "_b", *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in values])
    inside = W.partitionBy("_k", "_b").orderBy(*_columns(order)).rowsBetween(W.unboundedPreceding, 0)
    for name in values:
        d = d.withColumn(f"_s_{name}", F.sum(f"_v_{name}").over(inside))
    joined = d.join(offsets, ["_k", "_b"])

    def total(n: str) -> Column:
        # NULL only where no row so far has a value.
        own, earlier = F.col(f"_s_{n}"), F.col(f"_o_{n}")
        return F.when(own.isNull(), earlier).when(earlier.isNull(), own).otherwise(own + earlier)

    return joined.select(*df.columns, *[total(n).alias(n) for n in values])


def running_sum_in_order(
    df: DataFrame, keys: list[str], order: list, bucket: Column | Even, value: Column, out: str
) -> DataFrame:
    """``sum(value) over (partition by keys order by order rows unbounded preceding)``."""
    return running_sums_in_order(df, keys, order, bucket, {out: value})


def previous_in_order(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column | Even, values: list[str], prefix: str = "prev_"
) -> DataFrame:
    """``lag(value) over (partition by keys order by order)`` for several values."""
    d = _bucketed(df, keys, bucket)
    row = F.struct(F.lit(True).alias("found"), *[F.col(v) for v in values])
    local = d.withColumn("_lag", F.lag(row).over(W.partitionBy("_k", "_b").orderBy(*order)))
    last = d.groupBy("_k", "_b").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    carried = last.select("_k", "_b", F.lag("_last").over(W.partitionBy("_k").orderBy("_b")).alias("_carry"))
    # Only the first row of a bucket needs the carried row.
    joined = local.join(carried.filter(F.col("_carry").isNotNull()), ["_k", "_b"], "left")
    seen = F.coalesce(F.col("_lag"), F.col("_carry"))
    return joined.select(*df.columns, *[seen[v].alias(prefix + v) for v in values])


def newest_per_key(df: DataFrame, keys: list[str], order: list, n: int, position: str | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order``.

    Spark turns the filtered row_number into a limit that also runs before the
    shuffle, so a hot key ships at most ``n`` rows per input task.
    """
    w = W.partitionBy(*keys).orderBy(*_columns(order))
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", position) if position else out.drop("_rn")


def one_per_key(df: DataFrame, keys: list[str], prefer: Column, keep: str = "min") -> DataFrame:
    """The whole row with the smallest (or largest) ``prefer`` per key, as an aggregate."""
    pick = F.min_by if keep == "min" else F.max_by
    row = F.struct(*[F.col(c) for c in df.columns])
    grouped = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return grouped.agg(pick(row, prefer).alias("_row")).select("_row.*")

