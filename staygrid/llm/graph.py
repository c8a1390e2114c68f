"""Connected components of a link table, as rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.session import cut_lineage


def _signature(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame) -> DataFrame:
    """One round; ``edges`` run from the larger end u to the smaller end v.

    Neighbourhoods are never gathered: the smallest neighbour is an aggregate, and joined back to the edges.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return small.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of ``links`` (a, b) but the roots themselves.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest chain.
    Links of a node to itself and repeated links change nothing; an empty table gives an empty result.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _signature(edges)
    while True:
        edges = cut_lineage(_stars(edges))
        now = _signature(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
