"""Joins.  Physical strategy (broadcast, sort-merge, skew split) is left to AQE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def star(fact: DataFrame, dims: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Fact LEFT JOIN every dimension: (dimension, fact column, dimension key)."""
    out = fact
    for dim, fact_col, dim_key in dims:
        out = out.join(dim, out[fact_col] == dim[dim_key], "left")
    return out


def with_names(df: DataFrame, key: str, names: DataFrame, name_key: str, name: str, out: str, default) -> DataFrame:
    """Name lookup; ``default`` (text or column) where there is no name."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    lookup = names.select(F.col(name_key).alias("_nk"), F.col(name).alias("_name"))
    joined = df.join(lookup, df[key] == F.col("_nk"), "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce(F.col("_name"), fallback).alias(out))


def enriched(items: DataFrame, docs: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Left enrichment: fetched values overwrite, missing ones keep the old."""
    right = docs.select(F.col(on).alias("_on"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = items.join(right, items[on] == F.col("_on"), "left")
    return joined.select(*[
        F.coalesce(F.col(f"_new_{c}"), items[c]).alias(c) if c in columns else items[c] for c in items.columns
    ])


def not_seen(known: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """Known rows without a match in this run."""
    return known.join(seen.select(*on), on, "left_anti")


def merged_view(live: DataFrame, stored: DataFrame, blob: DataFrame, key: str, prefer: dict[str, list[str]]) -> DataFrame:
    """Full outer join of three views of a job; per column the first source with a value.

    ``prefer`` maps an output column to source names among live/stored/blob.
    """
    sides = {"live": live, "stored": stored, "blob": blob}
    wide = None
    for side, df in sides.items():
        part = df.select(key, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != key])
        wide = part if wide is None else wide.join(part, key, "full_outer")
    return wide.select(key, *[
        F.coalesce(*[F.col(f"{s}_{c}") for s in sources]).alias(c) for c, sources in prefer.items()
    ])


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose foreign key has no parent (NULL keys are not violations)."""
    return child.filter(F.col(fk).isNotNull()).join(parent, child[fk] == parent[pk], "left_anti")


def missing_recipients(requested: DataFrame, existing: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct cleaned addresses that are not known yet, with their start status.

    All three frames have an ``email`` column and a ``monitor_id`` where it matters.
    """
    clean = requested.select(
        "monitor_id", F.lower(F.trim("email")).alias("email")
    ).filter(F.col("email") != "").dropDuplicates(["monitor_id", "email"])
    fresh = clean.join(existing.select("monitor_id", "email"), ["monitor_id", "email"], "left_anti")
    known = members.select(F.lower("email").alias("email"), F.lit(True).alias("is_member")).dropDuplicates(["email"])
    return fresh.join(known, "email", "left").select(
        "monitor_id", "email",
        F.when(F.col("is_member"), "confirmed").otherwise("pending").alias("status"),
    )


def subscribed_emails(members: DataFrame, users: DataFrame, preferences: DataFrame, tag: str) -> DataFrame:
    """Team members' addresses, without opted-out users and lists lacking ``tag``."""
    joined = members.join(users, "user_id", "inner").join(preferences, "user_id", "left")
    wanted = ~F.coalesce("unsubscribed_all", F.lit(False)) & (
        F.col("email_preferences").isNull() | F.array_contains("email_preferences", tag)
    )
    return joined.filter(wanted).select("team_id", "email").distinct()
