"""Comparing captures: status, line diff, JSON diff, capture quality."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage, spread


def change_status(previous: Column, current: Column, status_code: Column, strict: bool = False) -> Column:
    """new / removed / same / changed for two captures of one page."""
    same = text.same_capture(previous, current, strict)
    return (
        F.when(F.coalesce(status_code == 404, F.lit(False)), "removed").when(previous.isNull(), "new")
        .when(same, "same").otherwise("changed"))


def line_changes(previous: str, current: str) -> list[dict]:
    """Line diff with line numbers; a small per-pair helper."""
    a, b = previous.split("\n"), current.split("\n")
    out = []
    for op, a0, a1, b0, b1 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out += [{"type": "normal", "old_line": a0 + i + 1, "new_line": b0 + i + 1, "content": a[a0 + i]} for i in range(a1 - a0)]
        else:
            out += [{"type": "del", "old_line": i + 1, "new_line": None, "content": a[i]} for i in range(a0, a1)]
            out += [{"type": "add", "old_line": None, "new_line": i + 1, "content": b[i]} for i in range(b0, b1)]
    return out


def line_diff(pairs: DataFrame, keys: list[str], previous: str, current: str) -> DataFrame:
    """Rows (keys, pos, type, old_line, new_line, content)."""

    @F.pandas_udf("array<struct<type:string,old_line:int,new_line:int,content:string>>")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([line_changes(x or "", y or "") for x, y in zip(a, b)])

    rows = spread(pairs, *keys).select(*keys, F.posexplode(diff(previous, current)).alias("pos", "_d"))
    return rows.select(*keys, "pos", "_d.type", "_d.old_line", "_d.new_line", "_d.content")


#: Characters without width.
ZERO_WIDTH = "[​‌‍﻿]"
#: Levels of nesting that one plan opens; deeper documents are written in between.
LEVELS_AT_ONCE = 8


def _document(c: str) -> str:
    """VARIANT of a JSON text column, as SQL; nothing is an empty object, a text that is not JSON is a string."""
    return f"coalesce(try_parse_json(if(coalesce({c}, '') = '', '{{}}', {c})), variant_get(parse_json(to_json(array({c}))), '$[0]'))"


def _nesting(c: Column) -> Column:
    """How deep the brackets of a JSON text go."""
    brackets = F.regexp_replace(F.regexp_replace(c, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["now"] + F.when(x.isin("[", "{"), 1).when(x.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step)["most"]


def _opened(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One level deeper: the members of both sides where both are objects or both are arrays, all else as it is."""
    kind = F.when(F.expr("schema_of_variant(a) LIKE 'OBJECT%' AND schema_of_variant(b) LIKE 'OBJECT%'"), 1).when(
        F.expr("schema_of_variant(a) LIKE 'ARRAY%' AND schema_of_variant(b) LIKE 'ARRAY%'"), 2)
    typed = rows.withColumn("_kind", kind).withColumns({
        "_oa": F.expr("if(_kind = 1, cast(a AS map<string, variant>), NULL)"), "_ob": F.expr("if(_kind = 1, cast(b AS map<string, variant>), NULL)"),
        "_la": F.expr("if(_kind = 2, cast(a AS array<variant>), NULL)"), "_lb": F.expr("if(_kind = 2, cast(b AS array<variant>), NULL)")})
    members = F.expr("""
        CASE _kind
        WHEN 1 THEN transform(array_union(map_keys(_oa), map_keys(_ob)),
            k -> named_struct('path', if(path = '', k, concat(path, '.', k)), 'a', try_element_at(_oa, k), 'b', try_element_at(_ob, k)))
        WHEN 2 THEN transform(slice(sequence(0, greatest(size(_la), size(_lb))), 1, greatest(size(_la), size(_lb))),
            i -> named_struct('path', concat(path, '[', i, ']'), 'a', get(_la, i), 'b', get(_lb, i)))
        ELSE array(named_struct('path', path, 'a', a, 'b', b)) END""")
    return typed.select(*keys, F.explode(members).alias("_m")).select(*keys, "_m.path", "_m.a", "_m.b")


def json_diff(pairs: DataFrame, keys: list[str], previous: str, current: str) -> DataFrame:
    """Rows (keys, path, previous, current) for every differing leaf, with its JSON text on both sides (NULL: not there).

    Both documents are VARIANTs that are opened side by side, level by level, inside the row, without a shuffle.
    Where the sides have different shapes the whole subtree is one entry.  White space, characters without width and the
    Unicode form of a string do not count, nor does the way a number is written.
    """
    # Stored, since the pairs are looked at twice; so are the differing leaves below, of which there are three kinds.
    changed = cut_lineage(spread(pairs, *keys).filter(~F.col(previous).eqNullSafe(F.col(current))).select(*keys, previous, current))
    levels = changed.agg(F.max(F.least(_nesting(F.col(previous)), _nesting(F.col(current))))).first()[0] or 0
    rows = changed.select(*keys, F.lit("").alias("path"), F.expr(_document(f"`{previous}`")).alias("a"), F.expr(_document(f"`{current}`")).alias("b"))
    for level in range(levels):
        rows = _opened(rows, keys)
        if (level + 1) % LEVELS_AT_ONCE == 0:
            # Equal members need no further look.
            rows = cut_lineage(rows.filter(~F.expr("coalesce(to_json(a), '') = coalesce(to_json(b), '')") | F.col("a").isNull() | F.col("b").isNull()))
    staged = rows.select(*keys, "path", F.expr("to_json(a)").alias("previous"), F.expr("to_json(b)").alias("current"),
                         F.expr("schema_of_variant(a)").alias("_ka"), F.expr("schema_of_variant(b)").alias("_kb"),
                         F.expr("try_variant_get(a, '$', 'string')").alias("_ta"), F.expr("try_variant_get(b, '$', 'string')").alias("_tb"))
    differing = cut_lineage(staged.filter(~F.col("previous").eqNullSafe(F.col("current"))))
    numeric = lambda k: F.col(k).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    same_number = numeric("_ka") & numeric("_kb") & ((F.col("_ka") == "DOUBLE") | (F.col("_kb") == "DOUBLE")) & (
        F.col("previous").try_cast("double") == F.col("current").try_cast("double"))
    texts = (F.col("_ka") == "STRING") & (F.col("_kb") == "STRING")
    squeezed = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, ZERO_WIDTH, ""), r"(?U)\s+", " "))
    out = [*keys, "path", "previous", "current"]
    known = F.coalesce(texts, F.lit(False))
    others = differing.filter(~known & ~F.coalesce(same_number, F.lit(False)))
    plain = differing.filter(known & (squeezed(F.col("_ta")) != squeezed(F.col("_tb"))))
    beyond = plain.filter(~F.col("_ta").rlike(r"^\p{ASCII}*$") | ~F.col("_tb").rlike(r"^\p{ASCII}*$"))
    # Letters with marks can be written in two ways; only texts that differ and have letters beyond ASCII are asked.
    spelled = beyond.filter(text.nfc(squeezed(F.col("_ta"))) != text.nfc(squeezed(F.col("_tb"))))
    ascii_only = plain.filter(F.col("_ta").rlike(r"^\p{ASCII}*$") & F.col("_tb").rlike(r"^\p{ASCII}*$"))
    return others.select(out).unionByName(ascii_only.select(out)).unionByName(spelled.select(out))


def top_level_diff(pairs: DataFrame, keys: list[str], previous: str, current: str) -> DataFrame:
    """Top-level fields whose JSON text differs, within the row: no shuffle."""
    kind = "map<string,string>"
    empty = F.expr("cast(map() as map<string,string>)")
    staged = pairs.select(*keys, F.coalesce(F.from_json(previous, kind), empty).alias("_a"), F.coalesce(F.from_json(current, kind), empty).alias("_b"))
    rows = staged.select(*keys, "_a", "_b", F.explode(F.array_union(F.map_keys("_a"), F.map_keys("_b"))).alias("field"))
    old, new = F.try_element_at("_a", F.col("field")), F.try_element_at("_b", F.col("field"))
    present = F.map_contains_key("_a", F.col("field")) != F.map_contains_key("_b", F.col("field"))
    return rows.filter(present | ~old.eqNullSafe(new)).select(*keys, "field", old.alias("previous"), new.alias("current"))


def number_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(text.NUMBER), F.lit(0)))


def extraction_quality(new: Column, old: Column) -> Column:
    """struct comparing two extractions: length ratio, kept numbers, tables, verdict."""
    n_new, n_old = F.length(new), F.length(old)
    ratio = F.when(n_old > 0, n_new / n_old).when(n_new > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    a, b = number_set(new), number_set(old)
    kept = F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(b)).when(F.size(a) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    tables = lambda c: F.regexp_count(c, F.lit(text.TABLE_RULE_LINE))
    return F.struct(
        F.round(ratio, 3).alias("length_ratio"), F.size(a).alias("new_numbers"), F.size(b).alias("old_numbers"),
        F.round(kept, 3).alias("number_ratio"), tables(new).alias("new_tables"), tables(old).alias("old_tables"),
        F.when((ratio >= 0.8) & (kept >= 0.9), "good").when((ratio >= 0.5) & (kept >= 0.7), "acceptable").otherwise("poor").alias("verdict"))


def site_verdict(captures: DataFrame, site: list[str], gold: str, light: str, similar: float = 0.95, enough: float = 0.8, too_many_failed: float = 0.5) -> DataFrame:
    """Whether light captures are as good as full ones, per site."""
    full_ok = F.coalesce(F.col(gold) != "", F.lit(False))
    close = F.when(full_ok & F.coalesce(F.col(light) != "", F.lit(False)), text.edit_similar(F.col(gold), F.col(light), similar))
    rows = captures.select(*site, full_ok.alias("_full"), F.coalesce(close, F.lit(False)).alias("_close"))
    per = rows.groupBy(*site).agg(
        F.count(F.lit(1)).alias("urls"), F.count_if(~F.col("_full")).alias("full_failed"),
        F.count_if(F.col("_full") & F.col("_close")).alias("light_ok"))
    comparable = F.col("urls") - F.col("full_failed")
    return per.withColumn("verdict", F.when(
        (F.col("full_failed") / F.col("urls") > too_many_failed) | (comparable == 0), "uncertain").when(
        F.col("light_ok") / comparable >= enough, "light_ok").otherwise("full_required"))
