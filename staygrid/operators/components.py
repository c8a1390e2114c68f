"""Connected components of things that share a hub."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(members: DataFrame) -> DataFrame:
    """(node, component) for ``members`` (node, hub), longs: nodes of one hub belong together; a component has any one name.

    Hubs stand for all the links between their members, so a hub of n nodes costs n rows and not n².  In each round a
    node takes the smallest name among its hubs, then nodes of one name become one node, and hubs left with a single one
    are done with.  So a round only sees what is still to be put together.  Names are hashed anew for each round (xxhash64
    of a long is one-to-one), so that no order of the nodes makes chains that shrink by one node a round.
    """
    live = cut_lineage(members.select(F.xxhash64("node").alias("name"), "hub", "node"))
    found = None
    while True:
        lowest = live.groupBy("hub").agg(F.min("name").alias("_low"))
        # The nodes of the first round are what was given; later ones stand for many.
        keys = ["name", "node"] if found is None else ["name"]
        step = cut_lineage(live.join(lowest, "hub").groupBy(*keys).agg(F.min("_low").alias("_low")))
        # Names of all rounds are hashed alike, those that are done with too.
        if found is None:
            found = step.select("node", F.xxhash64("_low").alias("component"))
        else:
            taken = step.select(F.col("name").alias("component"), "_low")
            found = found.join(taken, "component", "left").select("node", F.xxhash64(F.coalesce("_low", "component")).alias("component"))
        named = live.select("name", "hub").join(step.select("name", "_low"), "name").select(F.xxhash64("_low").alias("name"), "hub")
        parted = named.groupBy("hub").agg(F.min("name").alias("_a"), F.max("name").alias("_b")).filter(F.col("_a") < F.col("_b"))
        live = cut_lineage(named.join(parted, "hub", "left_semi").distinct())
        if live.isEmpty():
            return cut_lineage(found)
