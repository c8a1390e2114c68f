"""Rule-driven field extraction from pages.

The caller supplies the rules (field, pattern, type, default); nothing about a
particular site is built in.  Rules run as JVM expressions in one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..session import spread


@dataclass(frozen=True)
class FieldRule:
    field: str
    pattern: str
    cast: str = "string"
    default: object = None
    decode: bool = False
    count: bool = False
    all_values: bool = False


def extract_fields(pages: DataFrame, keys: list[str], rules: list[FieldRule], body: str = "html") -> DataFrame:
    """One row per page with one column per rule."""
    seen = spread(pages, *keys).select(*keys, html.visible(F.col(body)).alias("_v"))
    columns = []
    for r in rules:
        if r.count:
            value = F.regexp_count("_v", F.lit(r.pattern))
        elif r.all_values:
            value = F.regexp_extract_all("_v", F.lit(r.pattern), F.lit(1))
        else:
            value = F.nullif(F.regexp_extract("_v", r.pattern, 1), F.lit(""))
            value = html.unescape(value) if r.decode else value
        if not r.all_values:
            value = value.try_cast(r.cast)
        if r.default is not None:
            value = F.coalesce(value, F.lit(r.default))
        columns.append(value.alias(r.field))
    return seen.select(*keys, *columns)


def route(extracted: DataFrame, tables: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """Split extracted fields into star tables: table -> {column: field}.

    A list field makes one row per element, numbered by ``pos``.
    """
    types = dict(extracted.dtypes)
    out = {}
    for name, columns in tables.items():
        lists = [f for f in columns.values() if types[f].startswith("array")]
        if not lists:
            out[name] = extracted.select(*[F.col(f).alias(c) for c, f in columns.items()])
            continue
        zipped = extracted.withColumn("_z", F.arrays_zip(*lists)).select("*", F.posexplode("_z").alias("pos", "_i"))
        out[name] = zipped.select(
            "pos", *[(F.col(f"_i.{f}") if f in lists else F.col(f)).alias(c) for c, f in columns.items()])
    return out
