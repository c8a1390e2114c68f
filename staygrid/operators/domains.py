"""Registered domains by a table of public suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import splits_from


def registered_domains(hosts: DataFrame, host: str, suffixes: DataFrame, suffix: str = "suffix") -> DataFrame:
    """host, suffix, domain of each distinct host: the longest matching suffix, and one label more.

    Suffixes have any number of labels; ``*.x`` stands for every label below x, and ``!y.x`` excepts one of these, as in
    the public suffix list.  A host without a match has its last label as suffix, one that is a suffix has no domain.
    Only the tails of the distinct hosts are joined, so both sides may be large.
    """
    rule = F.lower(F.trim(F.col(suffix)))
    rules = suffixes.select(
        F.regexp_replace(rule, r"^(!|\*\.)", "").alias("_tail"),
        F.when(rule.startswith("!"), -1).when(rule.startswith("*."), 1).otherwise(0).alias("_more")).filter(F.col("_tail") != "").distinct()
    known = hosts.select(F.col(host).alias("host")).filter(F.col("host").isNotNull()).distinct()
    labels = F.split("host", r"\.")
    n = F.size(labels)
    tails = known.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, n - i + 1, i), "."))).alias("_at", "_tail"))
    met = tails.join(rules, "_tail").filter(F.col("_at") + 1 + F.col("_more") <= n)
    # An exception goes before every other rule.
    best = met.groupBy("host").agg(F.max(F.struct((F.col("_more") < 0).alias("e"), (F.col("_at") + 1 + F.col("_more")).alias("size"))).alias("_best"))
    size = F.greatest(F.coalesce("_best.size", F.lit(1)), F.lit(1))
    sized = known.join(best, "host", "left").withColumn("_size", size)
    last = lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")
    return sized.select("host", last(F.least("_size", n)).alias("suffix"), F.when(n > F.col("_size"), last(F.col("_size") + 1)).alias("domain"))


def with_registered_domain(df: DataFrame, host: str, suffixes: DataFrame, out: str = "domain") -> DataFrame:
    """``df`` with the registered domain of its host column; worked out once per distinct host."""
    domains = registered_domains(df, host, suffixes).select(F.col("host").alias("_host"), F.col("domain").alias(out))
    return df.join(domains, F.col(host) == F.col("_host"), "left").drop("_host")


def with_domain_splits(df: DataFrame, host: str, suffixes: DataFrame, out: str = "domains") -> DataFrame:
    """Adds every suffix of the host from its registered domain up to the host itself; none for a bare suffix."""
    return with_registered_domain(df, host, suffixes, "_registered").withColumn(out, splits_from(F.col(host), F.col("_registered"))).drop("_registered")


def same_registered_domain(df: DataFrame, host: str, other: str, suffixes: DataFrame, out: str = "same_domain") -> DataFrame:
    """Adds whether two host columns belong to one registered domain; false where either has none.

    Domains are worked out once per distinct host of both columns together.
    """
    hosts = df.select(F.explode(F.array(host, other)).alias("host"))
    known = registered_domains(hosts, "host", suffixes).select("host", "domain")
    one = known.select(F.col("host").alias("_h1"), F.col("domain").alias("_d1"))
    two = known.select(F.col("host").alias("_h2"), F.col("domain").alias("_d2"))
    met = df.join(one, F.col(host) == F.col("_h1"), "left").join(two, F.col(other) == F.col("_h2"), "left")
    return met.withColumn(out, F.coalesce(F.col("_d1") == F.col("_d2"), F.lit(False))).drop("_h1", "_d1", "_h2", "_d2")
