"""Near duplicates by SimHash: fingerprints in a vantage-point tree over Hamming distance.

Two fingerprints within r bits agree on at least one of r + 1 blocks of bits (the zero-distance shell of that
block), so the tree has one root per block, and its first branch is the block's value.  A cell that holds more
fingerprints than a task should compare branches again: its members agree on the block, so they must also agree on
one of r + 1 blocks of the other bits.  A fingerprint thus goes r + 1 ways per level, however many there are, and a
level parts ordinary cells by a thousand and more.  A cell that this does not part is a dense one; it gets a vantage
point, and the distances to it cut the cell into shells.  By the triangle inequality a pair within r bits lies in the
same shell or within r of the border between two, so a fingerprint that close to the border below is also sent to the
shell below.  Inside a task the tree goes on with median cuts.  The search is exact; only a spanning forest of the
links found in a cell leaves its task.

A tree on the whole 64 bits alone prunes badly: distances from any vantage point crowd around 32, so each halving
would send about two thirds of the fingerprints both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staygrid.llm.common import columns, slices
from staygrid.llm.graph import components
from staygrid.session import cut_lineage

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Fingerprints that one cell may hold before it is cut by a vantage point.
CELL = 4096
#: Cells of at most so many are compared outright.
LEAF = 128
#: Most ways (one for each choice of blocks) that cells branch into by blocks, and the share of a cell that its largest branch may keep.
WAYS, PARTED = 1024, 0.5


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """XXH64 of every shingle of words, ASCII letters in lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist())]


def fingerprint(hashes: list[int]) -> int:
    """A bit is 1 if more than half of the hashes have it; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        h = np.array(hashes[at:at + (1 << 15)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int((counts * 2 > len(hashes)) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))) if hashes else 0


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [fingerprint(shingle_hashes(x, size)) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    rows = columns(docs)
    return rows.mapInArrow(_fingerprints(shingle), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def parts_of(mask: int, count: int) -> list[int]:
    """The set bits of ``mask`` in ``count`` runs of neighbours, as masks."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * i // count:len(bits) * (i + 1) // count]) for i in range(count)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def cells(fps: DataFrame, max_bits: int, limit: int = CELL) -> DataFrame:
    """cell, fp: every pair within ``max_bits`` shares a cell; cells of one fingerprint are left out.

    Up to the limit of ``WAYS`` cells branch by blocks, ``max_bits`` + 1 ways each time.  The rest, and cells that do not
    part that way, are cut by vantage points.
    """
    count = min(max_bits + 1, 63)
    done: list[DataFrame] = []
    dense: list[DataFrame] = []
    # The bits that members of a cell agree on, for each way there: block by block.
    ways = [0]
    rows = fps.select(F.lit(0).alias("way"), F.lit(None).cast("long").alias("before"), "fp")
    while count > 1 and len(ways) * count <= max(WAYS, count):
        added = [[known | part for part in parts_of(~known & (1 << 64) - 1, count)] for known in ways]
        masks = F.element_at(F.array(*[F.array(*[F.lit(_signed(m)).cast("long") for m in of]) for of in added]), F.col("way") + 1)
        ways = [m for of in added for m in of]
        branches = F.transform(masks, lambda m, j: F.struct((F.col("way") * count + j).cast("int").alias("way"), F.col("fp").bitwiseAND(m).alias("bits")))
        rows = rows.select("before", "fp", F.explode(branches).alias("b")).select(F.xxhash64("b.way", "b.bits").alias("cell"), "b.way", "before", "fp")
        rows = cut_lineage(rows)
        sizes = cut_lineage(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("before").alias("was")).filter(F.col("n") > 1))
        done.append(rows.join(sizes.filter(F.col("n") <= limit).select("cell"), "cell", "left_semi").select("cell", "fp"))
        stuck = F.coalesce(F.col("n") > PARTED * F.col("was"), F.lit(False))
        crowded = sizes.filter(F.col("n") > limit)
        whole, left = crowded.agg(F.count_if(stuck), F.count_if(~stuck)).first()
        if whole:
            dense.append(rows.join(crowded.filter(stuck).select("cell"), "cell", "left_semi").select("cell", "fp"))
        rows = rows.join(crowded.filter(~stuck).select("cell", "n"), "cell").select("cell", "way", F.col("n").alias("before"), "fp")
        if not left:
            break
    else:
        dense.append(rows.select("cell" if count > 1 else F.lit(0).cast("long").alias("cell"), "fp"))
    if dense:
        done.append(_shells(_union(dense), max_bits, limit))
    return _union(done)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _shells(rows: DataFrame, max_bits: int, limit: int) -> DataFrame:
    """cell, fp: crowded cells cut by vantage points, as long as that parts them; what is left is dealt out in parts."""
    done: list[DataFrame] = []
    rows, before = cut_lineage(rows), None
    while True:
        sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("vantage"))
        done.append(rows.join(sizes.filter(F.col("n").between(2, limit)).select("cell"), "cell", "left_semi"))
        crowded = cut_lineage(sizes.filter(F.col("n") > limit))
        left, largest = crowded.agg(F.count(F.lit(1)), F.max("n")).first()
        if not left:
            break
        rows = rows.join(crowded, "cell")
        if before and largest > 0.8 * before:
            # A dense ball, which distances do not part: deal it out in parts and let every two parts meet.
            parts = F.ceil(F.col("n") / limit).cast("long")
            rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
            done.append(rows.select(F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), "fp"))
            break
        before = largest
        width = 2 * (max_bits + 1)
        far = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
        shell = F.floor(far / width)
        # Within max_bits of the border below: also a guest of the shell below.
        homes = F.when((far % width < max_bits) & (shell > 0), F.array(shell, shell - 1)).otherwise(F.array(shell))
        rows = cut_lineage(rows.withColumn("shell", F.explode(homes)).select(F.xxhash64("cell", "vantage", "shell").alias("cell"), "fp"))
    return _union(done)


class Forest:
    """Links between members of one cell that join what was not joined yet."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.label, self.links = fps, np.arange(len(fps)), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            new = self.label[a] != self.label[b]
            a, b = a[new], b[new]
            if not len(a):
                return
            x, y = self.label[a[0]], self.label[b[0]]
            self.label[self.label == y] = x
            self.links.append((int(self.fps[a[0]]), int(self.fps[b[0]])))


def search(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of all pairs within ``max_bits`` bits: vantage points, median cuts, triangle bounds."""
    forest = Forest(fps)

    def far(x: np.ndarray, v: int) -> np.ndarray:
        return np.bitwise_count(fps[x] ^ fps[v]).astype(np.int16)

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), LEAF):
            part = a[at:at + LEAF]
            i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[b][None, :]) <= max_bits)
            forest.add(part[i], b[j])

    todo: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(fps)), None)]
    while todo:
        a, b = todo.pop()
        if not len(a) or b is not None and not len(b):
            continue
        if b is None:
            d = far(a, a[0]) if len(a) > LEAF else None
            mu = int(np.median(d)) if d is not None else 0
            if d is None or not (d > mu).any():
                meet(a, a)
                continue
            todo += [(a[d <= mu], None), (a[d > mu], None), (a[(d <= mu) & (d > mu - max_bits)], a[(d > mu) & (d <= mu + max_bits)])]
        else:
            if len(a) * len(b) <= LEAF * LEAF:
                meet(a, b)
                continue
            da, db = far(a, a[0]), far(b, a[0])
            mu = int(np.median(da))
            near, rest = (a[da <= mu], b[db <= mu + max_bits]), (a[da > mu], b[db > mu - max_bits])
            if len(near[0]) * len(near[1]) + len(rest[0]) * len(rest[1]) > 0.8 * len(a) * len(b):
                meet(a, b)
            else:
                todo += [near, rest]
    return forest.links


def _links(max_bits: int):
    """Rows come sorted by cell; one cell at a time is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def closed(out):
            fps = np.unique(np.concatenate(held)).view(np.uint64) if held else np.empty(0, np.uint64)
            if len(fps) > 1:
                out += search(fps, max_bits)

        for batch in batches:
            found: list[tuple[int, int]] = []
            keys, fps = batch.column("cell").to_numpy(), batch.column("fp").to_numpy()
            cuts = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] != cell:
                    closed(found)
                    cell, held = keys[a], []
                held.append(fps[a:b])
            yield _pairs(found)
        last: list[tuple[int, int]] = []
        closed(last)
        yield _pairs(last)
    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def links(fps: DataFrame, max_bits: int = MAX_BITS, limit: int = CELL) -> DataFrame:
    """a, b: links that join all distinct fingerprints (column fp) within ``max_bits`` bits, but not every pair."""
    found = cells(fps, max_bits, limit).repartition("cell").sortWithinPartitions("cell")
    return found.mapInArrow(_links(max_bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, limit: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable): one row per row of ``docs``.

    Copies collapse to one fingerprint before the search.  A text that is null or has no words has fingerprint zero
    and is linked like any other; a null doc_id is no component's name unless all its members' are null.  An empty
    table gives an empty result.
    """
    rows = cut_lineage(fingerprints(docs, shingle))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct, max_bits, limit))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = cut_lineage(named)
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = named.join(names, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
