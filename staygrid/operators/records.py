"""Records extracted from many pages: merging, provenance, reshaping."""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .components import components

#: Records of one block that one task merges without looking for parts of the block.
CROWDED = 5000


def merge_records(
    df: DataFrame, block: list[str], order: str, fields: list[str], arrays: list[str] | None = None, source: str | None = None,
    crowded: int = CROWDED,
) -> DataFrame:
    """Fill gaps between records of one block that do not contradict each other.

    ``block`` columns identify the thing described and are never NULL, so two
    records of a block always agree on at least one value; rows with a NULL in
    them stay as they are.  Within a block records are taken in ``order``; each
    joins the first earlier record it does not contradict, filling its NULLs
    and adding to its arrays, or starts a new one.  The text "null" is NULL.

    Only records that can merge reach the grouped step: equal copies collapse
    first, and a complete record is only sent there when some gappy record of
    its block agrees with it - found by an equi-join on (block, which fields are
    present, their values), not by pairing rows.  A record without any value
    contradicts none, so it always joins the record that begins with the
    block's earliest row, and brings no other there.  So a hot block gathers
    its gappy records and what agrees with them, not its other complete ones;
    with more than ``crowded`` of these it falls into components of records
    that agree pairwise, which merge apart from each other.  A task takes
    one component, and looks records up by their values.

    Output: block, fields, arrays, first position, and the sorted sources.
    """
    arrays = arrays or []
    kinds = dict(df.dtypes)
    clean = [F.when(F.col(f) != "null", F.col(f)).alias(f) if kinds[f] == "string" else F.col(f) for f in fields]
    origin = F.col(source).cast("string") if source else F.lit(None).cast("string")
    rows = df.select(*block, F.col(order).alias("first_ord"), *clean, *arrays, origin.alias("_src"))
    # Equal copies: same values always land in the same record.
    facts = rows.groupBy(*block, *fields, *arrays).agg(
        F.min("first_ord").alias("first_ord"), F.sort_array(F.collect_set("_src")).alias("sources"))
    nulls = F.lit(False)
    for b in block:
        nulls = nulls | F.col(b).isNull()
    mask = F.concat(*[F.when(F.col(f).isNotNull(), "1").otherwise("0") for f in fields])
    full, empty = "1" * len(fields), "0" * len(fields)
    # Used several times below; stored once, already collapsed.
    tagged = cut_lineage(facts.withColumn("_mask", mask).withColumn("_lone", nulls).withColumn("_node", F.monotonically_increasing_id()))
    gappy = tagged.filter((F.col("_mask") != full) & ~F.col("_lone"))
    complete = tagged.filter((F.col("_mask") == full) & ~F.col("_lone"))

    def signature(m: Column) -> Column:
        return F.xxhash64(*block, m, *[F.when(F.substring(m, i + 1, 1) == "1", F.col(f)) for i, f in enumerate(fields)])

    # Keys are hashed: where two are hashed alike, one more record is merged with the others, which changes no result.
    some = gappy.filter(F.col("_mask") != empty)
    probes = some.select(signature(F.col("_mask")).alias("_sig")).distinct()
    keyed = complete.withColumn("_row", F.xxhash64(*block, *fields))
    # Only the kinds of gaps that a block has are tried on its complete records.
    tried = keyed.join(some.select(*block, F.col("_mask").alias("_m")).distinct(), block).select("_row", signature(F.col("_m")).alias("_sig"))
    agreeing = tried.join(probes, "_sig", "left_semi").select("_row")
    firsts = tagged.filter((F.col("_mask") != empty) & ~F.col("_lone")).join(
        gappy.filter(F.col("_mask") == empty).select(*block).distinct(), block, "left_semi").groupBy(*block).agg(F.min("first_ord").alias("_first"))
    earliest = keyed.join(firsts, block).filter(F.col("first_ord") == F.col("_first")).select("_row")
    touched = cut_lineage(agreeing.unionByName(earliest).distinct())
    apart = keyed.join(touched, "_row", "left_anti").drop("_row")
    joined = keyed.join(touched, "_row", "left_semi").drop("_row")
    out_cols = [*block, *fields, *arrays, "first_ord", "sources"]
    work = _parted(gappy.unionByName(joined), block, fields, empty, crowded)
    inner = ["first_ord", *[c for c in out_cols if c not in block and c != "first_ord"]]
    schema = T.StructType([work.schema[c] for c in inner])
    merge = F.arrow_udf(_merger(fields, arrays), T.ArrayType(schema))
    # One row per block, or part of a crowded one, of records that really can merge; a record alone stays as it is.
    blocks = work.groupBy(*block, "_part").agg(F.sort_array(F.collect_list(F.struct(*inner))).alias("_items"))
    several = F.size("_items") > 1
    merged = blocks.select(*block, F.explode(F.when(several, merge(F.when(several, F.col("_items")))).otherwise(F.col("_items"))).alias("_m")).select(*block, "_m.*").select(*out_cols)
    # Complete records with the same values differ in their arrays at most; these are put together in order.
    in_order = F.sort_array(F.collect_list(F.struct("first_ord", *arrays)))
    whole = apart.groupBy(*block, *fields).agg(
        in_order.alias("_all"), F.min("first_ord").alias("first_ord"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    for a in arrays:
        present = F.filter(F.col("_all").getField(a), lambda v: v.isNotNull())
        whole = whole.withColumn(a, F.when(F.size(present) > 0, F.array_distinct(F.flatten(present))))
    alone = tagged.filter(F.col("_lone")).select(*out_cols).unionByName(whole.select(*out_cols))
    return merged.unionByName(alone)


def _parted(work: DataFrame, block: list[str], fields: list[str], empty: str, crowded: int) -> DataFrame:
    """Adds ``_part``: blocks of more than ``crowded`` records fall into the components of records that agree pairwise.

    A record only ever joins one that holds values of records it agrees with, so merging stays inside a component.  Two
    records agree if the fields both have are equal: they share the hub of their kinds of gaps and those values, found
    by an equi-join.  Hubs are hashed; where two are hashed alike, two components are merged as one, with the same
    result.  A record without values goes where the block's earliest other one is.
    """
    counted = work.groupBy(*block, "_mask").agg(F.count(F.lit(1)).alias("_n"))
    hot = counted.groupBy(*block).agg(F.sum("_n").alias("_n")).filter(F.col("_n") > crowded).select(*block)
    kinds = cut_lineage(counted.join(hot, block, "left_semi").select(*block, "_mask"))
    if kinds.isEmpty():
        return work.drop("_mask", "_node").withColumn("_part", F.lit(0).cast("long"))
    filled, bare = F.col("_mask") != empty, F.col("_mask") == empty
    links = work.filter(filled).join(kinds.filter(filled).select(*block, F.col("_mask").alias("_other")), block)
    low, high = F.least("_mask", "_other"), F.greatest("_mask", "_other")
    common = [F.when((F.substring("_mask", i + 1, 1) == "1") & (F.substring("_other", i + 1, 1) == "1"), F.col(f)) for i, f in enumerate(fields)]
    links = cut_lineage(links.select(F.col("_node").alias("node"), F.xxhash64(*block, low, high, *common).alias("hub"),
                                     (F.col("_mask") == low).alias("_is_low"), (F.col("_mask") == high).alias("_is_high")))
    # A hub joins its members if both kinds are there.
    shared = links.groupBy("hub").agg(F.max("_is_low").alias("_low"), F.max("_is_high").alias("_high"), F.min("node").alias("_first"), F.max("node").alias("_last"))
    shared = shared.filter(F.col("_low") & F.col("_high") & (F.col("_first") < F.col("_last"))).select("hub")
    found = components(links.join(shared, "hub", "left_semi").select("node", "hub")).withColumnRenamed("node", "_node")
    part = F.coalesce("component", "_node")
    others = work.filter(filled).join(kinds.filter(bare).select(*block), block, "left_semi").join(found, "_node", "left")
    homes = others.groupBy(*block).agg(F.min_by(part, F.struct("first_ord", "_node")).alias("_home"))
    crowds = kinds.select(*block).distinct().join(homes, block, "left").withColumn("_hot", F.lit(True))
    marked = work.join(found, "_node", "left").join(crowds, block, "left")
    at = F.when(F.col("_hot").isNull(), F.lit(-1)).when(bare, F.coalesce("_home", F.lit(-1))).otherwise(part)
    return marked.withColumn("_part", at.cast("long")).drop("_mask", "_node", "component", "_home", "_hot")


def _merger(fields: list[str], arrays: list[str]):
    """First fit, with kept records found by their values: per kind of gaps, and the fields it has in common with the row."""
    bits = [1 << i for i in range(len(fields))]

    def merge_block(start: int, end: int, values: list[list], lists: list[list], sources: list) -> list[tuple]:
        kept: list[tuple] = []  # rows that gave the fields, values, arrays and sources of each record
        kinds: list[int] = []  # which fields each kept record has
        places: dict[int, dict[int, dict[tuple, list[int]]]] = {}  # kind -> common fields -> values -> numbers of records

        def key(record: list, common: int) -> tuple:
            return tuple([v for v, bit in zip(record, bits) if common & bit])

        def file(number: int) -> None:
            for common, by in places.setdefault(kinds[number], {}).items():
                heapq.heappush(by.setdefault(key(kept[number][1], common), []), number)

        def first(record: list, kind: int) -> int | None:
            best = None
            for other, tables in places.items():
                common = kind & other
                if common not in tables:
                    by = tables[common] = {}
                    for number, k in enumerate(kinds):
                        if k == other:
                            by.setdefault(key(kept[number][1], common), []).append(number)
                found = tables[common].get(key(record, common), [])
                while found and kinds[found[0]] != other:  # has got more fields since
                    heapq.heappop(found)
                if found and (best is None or found[0] < best):
                    best = found[0]
            return best

        for row in range(start, end):
            record = [v[row] for v in values]
            kind = sum([bit for v, bit in zip(record, bits) if v is not None])
            home = first(record, kind)
            if home is None:
                kept.append(([row] * (len(fields) + 1), record, [a[row] for a in lists], set(sources[row])))
                kinds.append(kind)
                file(len(kept) - 1)
                continue
            origins, known, gathered, seen = kept[home]
            new = kind & ~kinds[home]
            for i, bit in enumerate(bits):
                if new & bit:
                    known[i], origins[i + 1] = record[i], row
            for i, a in enumerate(lists):
                if a[row] is not None:
                    gathered[i] = distinct_items([*(gathered[i] or []), *a[row]])
            seen.update(sources[row])
            if new:
                kinds[home] |= kind
                file(home)
        return kept

    def run(blocks: pa.Array) -> pa.Array:
        items, ends = blocks.values, blocks.offsets.to_pylist()
        column = {f.name: items.field(i) for i, f in enumerate(items.type)}
        values, lists, sources = [column[f].to_pylist() for f in fields], [_lists(column[a]) for a in arrays], _lists(column["sources"])
        kept, offsets = [], [0]
        for ok, start, end in zip(blocks.is_valid().to_pylist(), ends, ends[1:]):
            if ok:
                kept += merge_block(start, end, values, lists, sources)
            offsets.append(len(kept))
        # What is one row's value is taken over in Arrow.
        out = {c: column[c].take(pa.array([k[0][i] for k in kept], pa.int64())) for i, c in enumerate(["first_ord", *fields])}
        out |= {a: pa.array([k[2][i] for k in kept], column[a].type) for i, a in enumerate(arrays)}
        out["sources"] = pa.array([sorted(k[3]) for k in kept], column["sources"].type)
        whole = pa.StructArray.from_arrays([out[f.name] for f in items.type], fields=list(items.type))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), whole)

    return run


def _lists(column: pa.Array) -> list[list | None]:
    """Like ``to_pylist``, with the items of all lists taken out at once."""
    items, ends = column.values.to_pylist(), column.offsets.to_pylist()
    return [items[start:end] if ok else None for ok, start, end in zip(column.is_valid().to_pylist(), ends, ends[1:])]


def distinct_items(items: list) -> list:
    if all([type(item) is str for item in items]):
        return list(dict.fromkeys(items))
    seen, out = set(), []
    for item in items:
        key = json.dumps(item, sort_keys=True, default=str)
        if key not in seen:
            seen.add(key)
            out.append(item)
    return out


def provenance(df: DataFrame, record: list[str], source: str) -> DataFrame:
    """Distinct sources of each record, sorted."""
    pairs = df.select(*record, source).distinct()
    return pairs.groupBy(*record).agg(F.sort_array(F.collect_set(source)).alias("sources"))


def distinct_in_arrays(df: DataFrame, arrays: list[str]) -> DataFrame:
    """Equal records inside each array kept once, first position wins."""
    return df.withColumns({a: F.array_distinct(a) for a in arrays})


def distinct_objects(df: DataFrame) -> DataFrame:
    """Like ``distinct_in_arrays`` for every array of structs; scalar arrays keep repeats."""
    objects = [f.name for f in df.schema.fields
               if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    return distinct_in_arrays(df, objects)


def combined_items(results: DataFrame, key: list[str], items: str, valid: dict[str, str], as_text: str | None = None) -> DataFrame:
    """Distinct valid items of all pages' results, one row per item.

    ``items`` is an array of JSON texts; an item is valid when one of its
    fields casts to the type in ``valid``.  Rows rather than one list, so that
    a key with very many items stays distributed.
    """
    rows = results.select(*key, F.explode(items).alias("_json"))
    parsed = rows.select(*key, *[F.get_json_object("_json", f"$.{f}").try_cast(kind).alias(f) for f, kind in valid.items()])
    any_value = F.lit(False)
    for f in valid:
        any_value = any_value | F.col(f).isNotNull()
    return parsed.filter(any_value).dropDuplicates()


def mixed(single: DataFrame, multi: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """Two results of one request: arrays come from the many-page result (nested
    lists flattened), other fields from the single-page result when it has them."""
    columns = [c for c in single.columns if c != key] + [c for c in multi.columns if c not in single.columns]
    a = single.select(key, *[F.col(c).alias(f"_s_{c}") for c in single.columns if c != key])
    b = multi.select(key, *[F.col(c).alias(f"_m_{c}") for c in multi.columns if c != key])
    both = a.join(b, key, "full_outer")
    nested = {c for c, k in multi.dtypes if k.startswith("array<array")}

    def value(c: str) -> Column:
        sides = [F.col(f"{p}{c}") for p, d in (("_s_", single), ("_m_", multi)) if c in d.columns]
        if c in arrays:
            sides = sides[::-1]
            if c in nested:
                sides[0] = F.flatten(sides[0])
        return F.coalesce(*sides)

    return both.select(key, *[value(c).alias(c) for c in columns])


def spread(df: DataFrame, key: list[str], repeated: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parent rows with the single-valued fields and one child table per repeated field."""
    parent = df.select(*[c for c in df.columns if c not in repeated])
    children = {c: df.select(*key, F.posexplode(c).alias("pos", "item")) for c in repeated}
    return parent, children
