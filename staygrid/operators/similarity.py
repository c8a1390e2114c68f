"""Similar texts among all texts: a set-similarity join on word sets.

Two sets whose Jaccard similarity is at least t share one of their rarest words: of n words, the first
n - ceil(t n) + 1 in the order of rising frequency.  So texts meet by those words alone.  Rarity is counted in slots of
hashes: any order will do if it is the same in all sets.  The sizes of two sets, and where the word stands in them, bound the
overlap that is still possible, which drops most candidates before any set is compared; a pair comes with its first common word,
not with all of them.  A word that many texts of a size band have among their rarest is not a key by itself: there, texts must
share a second word as well (similar sets share two of their n - ceil(t n) + 2 rarest), so hot words split into rare word pairs.

Words travel as hashes, and places of words, candidates and sketches in packed blocks (``setpairs``).  Candidates are first
compared by sketches, two to four parity bits per word: where two sketches differ, at least as many words do, so only
sets that may be similar get their words.  Sets are cut into blocks, and a pair is looked at in the tile of its two blocks: a
set travels once for each block it may meet, not once for each pair.

Texts with equal word sets are one class.  Pairs are reported between classes, membership apart, so a thousand copies
are a thousand rows and not half a million pairs.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_set
from ..session import cut_lineage
from . import setpairs

#: Classes of one size band that may have a word among their rarest before it only counts together with another one.  Word pairs
#: cost up to a shuffled row for each two words, comparing sizes and places a few nanoseconds a pair.
HOT = 4096
#: Places of words, sketches and words that a task holds.
PLACES, SKETCHES, WORDS = 400_000, 262_144, 1_000_000


def text_classes(df: DataFrame, row_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, sets, names): (id, class_id) for every row with a text, (_key, words) for every such row, and (class_id, _key).

    ``class_id`` is the smallest id with the same word set, which is known by its ``_key``.  Texts without a word are in one
    class only if they are equal.  The sets are stored, since several steps read them; the words are not shuffled.
    """
    words = F.array_sort(word_set(F.col(text)))
    key = F.unhex(F.sha2(F.when(F.size("words") > 0, F.to_json("words")).otherwise(F.col(text)), 256))
    rows = df.filter(F.col(text).isNotNull() & F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), F.col(text), words.alias("words"))
    keyed = cut_lineage(rows.select("id", "words", key.alias("_key")))
    named = cut_lineage(keyed.groupBy("_key").agg(F.min("id").alias("class_id")))
    members = keyed.select("id", "_key").join(named, "_key").select("id", "class_id")
    # An id that comes with several texts has one set.
    return members, keyed.select("_key", "words"), named.groupBy("class_id").agg(F.min("_key").alias("_key"))


def _counted(rows: DataFrame, tally=setpairs.tallied()) -> dict[int, bytes]:
    """How many of the numbers, an array per row, fall into each slot: as levels, a byte for each of a fixed number of slots."""
    pieces = rows.mapInArrow(tally, "piece int, data binary").repartition(8, "piece").mapInArrow(setpairs.totals, "piece int, data binary")
    return {r.piece: bytes(r.data) for r in pieces.collect()}


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 256):
    """Packed blocks are large rows, of which an Arrow batch of 10,000 may be a whole task's input."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _tiled(rows: DataFrame, tiles: setpairs.Tiles) -> DataFrame:
    return rows.repartition(min(tiles.blocks * (tiles.blocks + 1) // 2, 8 * tiles.blocks), "tile").sortWithinPartitions("tile", "kind")


def _least_overlap(a: Column, b: Column, least: float) -> Column:
    """Common words that sets of ``a`` and ``b`` words need."""
    return F.ceil((a + b) * (least / (1 + least)) - 1e-9)


def _sketches(listed: DataFrame) -> DataFrame:
    """(class_id, n, sketch) for (class_id, n, word hash): ``setpairs.sketches`` in expressions.

    How many words fall on each bit, odd or even, as 64 bits a slot.

    The number of slots is a power of two, so that a longer sketch folds onto a shorter one.
    """
    slots = F.greatest(F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / 32))), F.lit(1)).cast("int")
    word = F.col("word")
    bits = listed.select("class_id", "n", F.pmod(F.shiftright(word, 6), slots).cast("int").alias("slot"), F.expr("shiftleft(1L, cast(word & 63L as int))").alias("bit"))
    filled = bits.groupBy("class_id", "n", "slot").agg(F.bit_xor("bit").alias("bits"))
    grouped = filled.groupBy("class_id", "n").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bits"))).alias("_at"))
    sketch = F.transform(F.sequence(F.lit(0), slots - 1), lambda i: F.coalesce(F.try_element_at("_at", i), F.lit(0).cast("long")))
    return grouped.select("class_id", "n", sketch.alias("sketch"))


def _flips(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ; no more than the words that only one of the sets has."""
    slots = F.least(F.size(a), F.size(b))

    def folded(s: Column, i: Column) -> Column:
        places = F.sequence(i, F.size(s) - 1, slots)
        return F.aggregate(places, F.lit(0).cast("long"), lambda acc, p: acc.bitwiseXOR(F.get(s, p)))

    each = F.transform(F.sequence(F.lit(0), slots - 1), lambda i: F.bit_count(folded(a, i).bitwiseXOR(folded(b, i))))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x)


def _hashes() -> Column:
    return F.transform("words", lambda w: F.hash(w)).alias("words")


def _by_hot_words(placed: DataFrame, least: float, hot: int) -> DataFrame:
    """(a, b) for places (no, n, at, word, later) of words that may be hot."""
    # Sizes of similar sets differ by less than one band; a set visits the band above its own.
    band = F.floor(F.log("n") / F.log(F.lit(1 / (least - 1e-6)))).cast("long")
    visits = placed.withColumn("own", band).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    common = cut_lineage(visits.groupBy("word", "band").agg(F.count(F.lit(1)).alias("_in")).filter(F.col("_in") > hot).select("word", "band"))
    alone = visits.join(common, ["word", "band"], "left_anti").drop("later").withColumn("second", F.lit(0))
    busy = visits.join(common, ["word", "band"], "left_semi")
    # Sets so small that one common word makes them similar have no second one.
    second = F.when(F.col("n") * least <= 1 + 1e-9, F.concat(F.array(F.lit(0)), "later")).otherwise(F.col("later"))
    keyed = alone.unionByName(busy.withColumn("second", F.explode(second)).drop("later"))
    home = keyed.filter(F.col("own") == F.col("band")).select("word", "second", "band", F.col("no").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    guests = keyed.select("word", "second", "band", "own", F.col("no").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"))
    met = guests.join(home, ["word", "second", "band"]).filter((F.col("a") != F.col("b")) & ((F.col("own") < F.col("band")) | (F.col("a") < F.col("b"))))
    possible = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    near = met.filter((possible >= _least_overlap(F.col("na"), F.col("nb"), least)) & (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_classes(sets: DataFrame, names: DataFrame, least: float = 0.95, hot: int = HOT) -> DataFrame:
    """(a, b, similarity) for all pairs a < b of classes with a similarity of at least ``least``.

    ``sets`` (_key, words) is stored and may have a set more than once; ``names`` (class_id, _key) has the sets to compare.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    with _small_batches(sets.sparkSession):
        return _similar_classes(sets.filter(F.size("words") > 0), names, least, hot)


def _similar_classes(sets: DataFrame, names: DataFrame, least: float, hot: int) -> DataFrame:
    context = sets.sparkSession.sparkContext
    rarity = context.broadcast(_counted(sets.select(_hashes())))
    ordered = sets.select("_key", _hashes()).mapInArrow(setpairs.in_order(rarity, least), "_key binary, near int, n int, first array<int>, sketch array<long>")
    stored = cut_lineage(ordered.repartition("near").dropDuplicates(["near", "_key"]).drop("near").withColumn("no", F.monotonically_increasing_id()))
    # Numbered almost without gaps, similar sets mostly close together.
    task, row = F.shiftright("no", 33), F.col("no").bitwiseAND((1 << 33) - 1)
    size = stored.agg(F.max(task).alias("tasks"), F.max(row).alias("rows"), F.sum(F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).alias("places")).first()
    each, places = (size.rows or 0) + 1, int(size.places or 0)
    top = ((size.tasks or 0) + 1) * each
    classes = stored.withColumn("no", task * each + row)
    cores = context.defaultParallelism
    tiles = setpairs.Tiles(top, max(-(-top // SKETCHES), min(8, 1 + top // 10_000)))
    block = "tile int, kind int, data binary"

    crowd = context.broadcast(_counted(classes.select("n", "first"), setpairs.tallied(setpairs.prefixes(least))))
    parts = max(1, places // PLACES, min(2 * cores, places // 20_000))
    placed = classes.select("no", "n", "first").mapInArrow(setpairs.placed(crowd, hot, least, parts), "part int, data binary")
    met = placed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(setpairs.met(least, tiles), block)
    if setpairs.table(crowd.value).max() >= setpairs.level(hot + 1):
        busy = classes.select("no", "n", "first").mapInArrow(setpairs.crowded(crowd, hot, least), "no long, n int, at int, word int, later array<int>")
        met = met.unionByName(_by_hot_words(busy, least, hot).mapInArrow(setpairs.listed(tiles), block))
    sketched = classes.select("no", "n", "sketch").mapInArrow(setpairs.sketched(tiles), block)
    close = cut_lineage(_tiled(sketched.unionByName(met), tiles).mapInArrow(setpairs.close(least, tiles), "tile int, data binary"))

    words = close.mapInArrow(setpairs.in_pairs(tiles, tiles), "tile int, no long").select("no").distinct().join(classes.select("no", "n"), "no").agg(F.sum("n")).first()[0] or 0
    halves = setpairs.Tiles(top, -(-words // WORDS) or 1)
    again = close.mapInArrow(setpairs.dealt_again(tiles, halves), block)
    wanted = close.mapInArrow(setpairs.in_pairs(tiles, halves), "tile int, no long").groupBy("no").agg(F.collect_set("tile").alias("tiles"))
    wanted = cut_lineage(wanted.join(classes.select("no", "_key"), "no").join(names, "_key"))
    # Most sets have no pair; these are left out before words are shuffled.
    slots = setpairs.table(_counted(wanted.select(F.array(F.hash("_key"))))) > 0
    slots = sets.sparkSession.createDataFrame([(slots.tobytes(),)], "slots binary").scalar()
    found = F.substring(slots, F.hash("_key").bitwiseAND((1 << setpairs.SLOT_BITS) - 1) + 1, F.lit(1)) == F.lit(b"\1")
    known = sets.filter(found).dropDuplicates(["_key"]).join(wanted, "_key")
    kind = names.schema["class_id"].dataType
    known = known.select(F.explode("tiles").alias("tile"), F.lit(0).alias("kind"), "no", "class_id", "words", F.lit(None).cast("binary").alias("data"))
    again = again.select("tile", "kind", F.lit(None).cast("long").alias("no"), F.lit(None).cast(kind).alias("class_id"), F.lit(None).cast("array<string>").alias("words"), "data")
    scored = _tiled(known.unionByName(again), halves).mapInArrow(setpairs.scored(least, halves), f"a {kind.simpleString()}, b {kind.simpleString()}, similarity double")
    # Stored, while batches are small.
    return cut_lineage(scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"))


def similar_texts(df: DataFrame, row_id: str, text: str, least: float = 0.95, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, class_id, class_size) for every text, and (a, b, similarity) between class ids.

    The similarity is that of ``functions.text.word_set_similarity``; members of one class have 1.  Rows without an id or
    a text are left out.  ``hot`` changes the work, not the result.
    """
    classes, sets, names = text_classes(df, row_id, text)
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    members = classes.join(sizes, "class_id").select("id", "class_id", "class_size")
    return members, similar_classes(sets, names, least, hot)
