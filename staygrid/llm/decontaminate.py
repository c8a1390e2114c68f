"""Benchmark decontamination by winnowing, in DataFrame expressions alone.

Of every run of ``window - gram + 1`` consecutive grams of ``gram`` words the smallest hash (the last of equals) is a
fingerprint.  A window of ``window`` words that two texts share has the same grams, hence the same fingerprint in
both: no shared window is missed.  Fingerprints of the corpus are joined to those of the benchmark; a hit is extended
to the windows around it, and these are compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staygrid.llm.common import ascii_lower, columns, let
from staygrid.session import cut_lineage

WINDOW, GRAM = 10, 6
#: What is not part of a word.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A fingerprint is 32 bits of hash over the position counted down, so that the least is the last of the smallest.
LOW = (1 << 31) - 1


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def _positions(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def fingerprints(found: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """Fingerprints of an array of words; none if it has fewer than ``window``."""
    grams = window - gram + 1

    def packed(hashes: Column) -> Column:
        return F.transform(_positions(F.size(hashes) - (gram - 1)), lambda i: F.shiftleft(
            F.xxhash64(*[hashes[i + j] for j in range(gram)]).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), 31) + (F.lit(LOW) - i))

    def least(packs: Column) -> Column:
        run = F.least if grams > 1 else F.coalesce
        return F.array_distinct(F.transform(_positions(F.size(packs) - (grams - 1)), lambda i: run(*[packs[i + j] for j in range(grams)])))

    # ``let`` keeps each array from being computed anew for every position.
    prints = let(F.transform(found, lambda w: F.xxhash64(w)), lambda h: let(packed(h), least))
    return F.when(F.size(found) >= window, prints).otherwise(F.array().cast("array<bigint>"))


def _print(packed: Column) -> Column:
    return F.shiftright(packed, 31)


def _position(packed: Column) -> Column:
    return (F.lit(LOW) - packed.bitwiseAND(F.lit(LOW).cast("long"))).cast("int")


def _with_words(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(F.array(words(F.col("text")))).alias("words"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, size, content (words joined by a blank): the distinct windows of each item."""
    rows = _with_words(columns(items, "item_id").withColumnRenamed("doc_id", "item_id"), "item_id")
    size = F.least(F.size("words"), F.lit(window))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - size)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("size", size).withColumn("start", F.explode(starts)).select(
        "item_id", "size", F.array_join(F.slice("words", F.col("start") + 1, F.col("size")), " ").alias("content")).distinct()


def _index(windows: DataFrame, window: int, gram: int) -> DataFrame:
    """print: the fingerprints of the full windows."""
    full = windows.filter(F.col("size") == window).select("content").distinct()
    return cut_lineage(full.select(F.explode(fingerprints(F.split("content", " "), window, gram)).alias("p")).select(_print(F.col("p")).alias("print")).distinct())


def _candidates(docs: DataFrame, index: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, row and either n_words (one row per document) or ``at``, where a gram is a fingerprint of the index.

    The words are cut once, and the fingerprints themselves are not kept.
    """
    found = _with_words(docs, "doc_id", "row")
    # The number of words travels as a negative number in front of the fingerprints.
    packed = F.concat(F.array(-1 - F.size("words").cast("long")), fingerprints(F.col("words"), window, gram))
    each = found.select("doc_id", "row", F.explode(packed).alias("p"))
    # It has no partner in the index; its key is as good as random, so that it does not gather anywhere.
    key = F.when(F.col("p") < 0, F.xxhash64("row").bitwiseOR(F.lit(-(1 << 63)))).otherwise(_print(F.col("p")))
    joined = each.withColumn("print", key).join(index.withColumn("known", F.lit(True)), "print", "left").filter((F.col("p") < 0) | F.col("known"))
    return cut_lineage(joined.select("doc_id", "row", F.when(F.col("p") < 0, -1 - F.col("p")).alias("n_words"), F.when(F.col("p") >= 0, _position(F.col("p"))).alias("at")))


def _long_hits(docs: DataFrame, candidates: DataFrame, windows: DataFrame, window: int, gram: int) -> DataFrame:
    """row, start, size, content of the full windows that occur, around their fingerprints."""
    full = windows.filter(F.col("size") == window).select("content").distinct()
    hits = cut_lineage(candidates.filter("at is not null").groupBy("row").agg(F.array_sort(F.collect_set("at")).alias("at")))
    back = window - gram

    def around(found: Column) -> Column:
        """The windows that hold a hit; neighbours share most of theirs."""
        last = F.size(found) - window
        starts = F.array_distinct(F.flatten(F.transform("at", lambda a: F.filter(F.sequence(a - back, a), lambda s: (s >= 0) & (s <= last)))))
        return F.transform(starts, lambda s: F.struct(
            s.alias("start"), F.lit(window).alias("size"), F.array_join(F.slice(found, s + 1, window), " ").alias("content")))

    rows = docs.join(hits.hint("shuffle_hash"), "row").select("row", F.explode(let(words(F.col("text")), around)).alias("x"))
    return rows.select("row", "x.*").join(full, "content", "left_semi")


def _short_hits(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The same for items of fewer words than a window: every run of that many words is looked up."""

    def runs_of(found: Column, n: int) -> Column:
        return F.transform(_positions(F.size(found) - (n - 1)), lambda s: F.struct(
            s.alias("start"), F.lit(n).alias("size"), F.array_join(F.slice(found, s + 1, n), " ").alias("content")))

    def runs(found: Column) -> Column:
        return F.concat(*[runs_of(found, n) for n in sizes])

    rows = docs.select("row", F.explode(let(words(F.col("text")), runs)).alias("x"))
    return rows.select("row", "x.*").join(windows.select("size", "content").distinct(), ["size", "content"], "left_semi")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, windows) of a corpus and a benchmark (item_id, text).

    ``documents``: doc_id, row, n_words.  ``hits``: row, start, size, content of every place where a window of an
    item occurs, in words from 0.  ``windows``: the distinct windows of each item.  ``row`` is a document's id with a
    digest of its text, so that null and repeated ids do not mix texts.
    """
    rows = columns(docs)
    rows = rows.withColumn("row", F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")))
    windows = cut_lineage(item_windows(items, window))
    candidates = _candidates(rows, _index(windows, window, gram), window, gram)
    hits = _long_hits(rows, candidates, windows, window, gram).select("row", "start", "size", "content")
    short = sorted(r.size for r in windows.filter(F.col("size") < window).select("size").distinct().collect())  # below ``window``, so few
    if short:
        hits = hits.unionByName(_short_hits(rows, windows, short).select("row", "start", "size", "content"))
    return candidates.filter("n_words is not null").select("doc_id", "row", "n_words"), cut_lineage(hits.distinct()), windows


def hit_spans(hits: DataFrame) -> DataFrame:
    """row, start, end: maximal runs of hit words, ``end`` exclusive."""
    by_place = W.partitionBy("row").orderBy("start", "size")
    ends = F.max(F.col("start") + F.col("size")).over(by_place.rowsBetween(W.unboundedPreceding, -1))
    begun = hits.select("row", "start", "size").distinct().withColumn("new", F.coalesce((F.col("start") > ends).cast("int"), F.lit(1)))
    run = F.sum("new").over(by_place.rowsBetween(W.unboundedPreceding, 0))
    return begun.withColumn("run", run).groupBy("row", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end")).drop("run")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of ``docs``.

    A word is hit if it lies inside an occurrence of any window of an item; an item of fewer words than a window is
    one window.  Texts that are null or have no words, and an empty benchmark, give no hits; the digest of no items is
    that of the empty string.  Items without an id count, with an empty id; an item_id on several rows is one item.
    """
    documents, hits, windows = occurrences(docs, items, window, gram)
    n_hit = hit_spans(hits).groupBy("row").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"))
    named = windows.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "size", "content")
    found = hits.select("row", "size", "content").distinct().join(named, ["size", "content"]).select("row", "item").distinct()
    per_row = found.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("sha"))
    marks = n_hit.join(per_row, "row")
    return documents.join(marks, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
