"""Repeated byte spans: suffix order of many short texts, built column by column.

Every window of ``size`` bytes picks an anchor, the first of its ``gram``-byte runs with the smallest hash; equal
windows pick equal anchors.  Windows next to each other with the same anchor form a read, a text of at most
``2 * size - gram`` bytes.  Reads meet by their anchor's hash:

* equal reads: every window of all but the first is a repeat;
* different reads with the same anchor (the ends of repeated passages): these go into a collection whose Burrows-Wheeler
  transform and common-prefix lengths are built by inserting one symbol of every read per round, from the last
  column to the first.  Suffixes next to each other that share ``size`` bytes are occurrences of one window; all but the
  first are repeats.

Collections are bounded, so a round's arrays are read and written front to back in memory instead of files; Spark's
external sort brings the reads of an anchor together.  An anchor with more different reads than a collection may
hold is dealt out anew by the bytes that some of its windows share, until single windows are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.llm.common import columns, slices
from staygrid.session import cut_lineage

SIZE, GRAM = 100, 36
#: Different reads of a collection, and of one anchor in it.
READS, LIMIT = 20_000, 60_000
#: Bytes that are hashed at a time.
STRETCH = 1 << 20
BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFF)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.ones(STRETCH + 4096, np.uint64)
        have = 1
        while have < len(p):
            more = min(have, len(p) - have)
            p[have:have + more] = p[:more] * np.uint64(pow(base, have, 1 << 64))
            have += more
        out.append(p)
    return out[0], out[1]


def rolling(a: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of every run of ``size`` bytes; ``a`` has at most STRETCH + 4096 bytes."""
    up, down = _powers()
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(a * up[:len(a)], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[:len(a) - size + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def reads(a: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor's place, anchor's hash) of the reads of a text."""
    out: list[tuple[np.ndarray, ...]] = []
    span = size - gram + 1
    for base in range(0, max(0, len(a) - size + 1), STRETCH):
        part = a[base:base + STRETCH + size - 1]
        h = rolling(part, gram)
        # Hash over place: the least of a window is its first smallest.
        packed = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        blocks = -(-len(h) // span)
        grid = np.full(blocks * span, np.iinfo(np.uint64).max)
        grid[:len(h)] = packed
        grid = grid.reshape(blocks, span)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(h) - span + 1
        at = (np.minimum(back[:windows], ahead[span - 1:span - 1 + windows]) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], windows) - 1
        out.append((first + base, last + base, at[first] + base, h[at[first]]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    first, last, at, h = (np.concatenate(x) for x in zip(*out))
    # A read that goes on beyond a stretch.
    new = np.concatenate(([True], at[1:] != at[:-1]))
    ends = np.append(np.flatnonzero(new)[1:], len(at)) - 1
    return first[new], last[ends], at[new], h[new]


def _packed(first: np.ndarray, last: np.ndarray, lead: np.ndarray, known: np.ndarray) -> np.ndarray:
    """First window, windows (up to 4096), bytes to the anchor, and whether it is a known repeat, in one number."""
    return ((first.astype(np.int64) << 12 | (last - first)) << 12 | lead) << 1 | known


def _places(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    first = packed >> 25
    return first, first + (packed >> 13 & 4095), packed >> 1 & 4095, (packed & 1).astype(bool)


def _found(size: int, gram: int):
    """g, r, key, place: the reads of texts; of equal reads of a batch all but the first are known repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for part in slices(batches, 2048):
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                data = (text or "").encode()
                first, last, at, h = reads(np.frombuffer(data, np.uint8), size, gram)
                own = np.fromiter((digest(data[f:e + size], a - f) for f, e, a in zip(first.tolist(), last.tolist(), at.tolist())), np.uint64, len(at))
                for c, v in zip(cols, (h.view(np.int64), own.view(np.int64), np.full(len(at), key, np.int64), first, last, at - first)):
                    c.append(v)
            g, r, key, first, last, lead = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
            order = np.lexsort((first, key, r, g))
            known = np.zeros(len(g), bool)
            known[order[1:]] = (g[order[1:]] == g[order[:-1]]) & (r[order[1:]] == r[order[:-1]])
            # Known repeats need no partner: they travel anywhere.
            g = np.where(known, (key * 1_000_003 + first) ^ r, g)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(r), pa.array(key), pa.array(_packed(first, last, lead, known))], names=["g", "r", "key", "place"])
    return run


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by g, r, key, place.  Repeats of a whole read, and the reads that share an anchor with different ones."""
    held = None  # first read of the anchor at hand: (g, r of the last row, its columns, different reads so far)
    names = ["g", "key", "first", "last", "lead"]
    for batch in batches:
        cols = {n: batch.column(n).to_numpy() for n in ("g", "r", "key")}
        cols["first"], cols["last"], cols["lead"], known = _places(batch.column("place").to_numpy())
        plain = {n: c[~known] for n, c in cols.items()}
        repeats = [{n: c[known] for n, c in cols.items()}]
        edges = []
        g, r = plain["g"], plain["r"]
        if len(g):
            new_g, new_r = np.ones(len(g), bool), np.ones(len(g), bool)
            new_g[1:] = g[1:] != g[:-1]
            new_r[1:] = new_g[1:] | (r[1:] != r[:-1])
            goes_on = held is not None and held[0] == g[0]
            if goes_on:
                new_g[0], new_r[0] = False, held[1] != r[0]
            group = np.cumsum(new_g) - (0 if goes_on else 1)
            different = np.bincount(group, weights=new_r, minlength=group[-1] + 1).astype(int)
            if goes_on:
                if held[3] == 1 and different[0]:
                    edges.append(held[2])
                different[0] += held[3]
            edge = new_r & (different[group] > 1)
            edges.append({n: c[edge] for n, c in plain.items()})
            repeats.append({n: c[~new_r] for n, c in plain.items()})
            begun = np.flatnonzero(new_g)
            if len(begun):
                first = {n: c[begun[-1]:begun[-1] + 1] for n, c in plain.items()}
            else:
                first = held[2]
            held = (g[-1], r[-1], first, int(different[-1]))
        for rows, kind in ((repeats, False), (edges, True)):
            if rows:
                out = [np.concatenate([x[n] for x in rows]) for n in names]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out, kinds)), pa.array(np.full(len(out[0]), kind))], names=[*names, "edge"])


def _cut(size: int):
    """The bytes of reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            g, key, at, lead, data = [], [], [], [], []
            for k, text, edges in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), part.column("edges").to_pylist()):
                raw = text.encode()
                for e in edges:
                    g.append(e["g"])
                    key.append(k)
                    at.append(e["first"])
                    lead.append(e["lead"])
                    data.append(raw[e["first"]:e["last"] + size])
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(key, pa.int64()), pa.array(at, pa.int32()), pa.array(lead, pa.int32()), pa.array(data, pa.binary())],
                                             names=["g", "key", "at", "lead", "data"])
    return run


def build(texts: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes) of a collection.

    The transform has the symbol before each suffix in the order of the suffixes, symbols one higher than their
    bytes, 0 where a text begins; common prefixes with the suffix before are counted up to ``cap``.  The empty
    suffixes stand first, in the order of the texts.
    """
    count = len(texts)
    lengths = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    ends = np.cumsum(lengths)

    def symbol(of: np.ndarray, column: int) -> np.ndarray:
        """The symbol before the suffix of ``column`` bytes."""
        has = lengths[of] > column
        return np.where(has, flat[np.where(has, ends[of] - column - 1, 0)], 0).astype(np.int16)

    if not len(flat):
        return np.zeros(count, np.int16), np.zeros(count, np.int16)
    bwt, lcp = symbol(np.arange(count), 0), np.zeros(count, np.int16)
    place = np.arange(count)  # where each text's longest suffix so far stands
    for column in range(1, int(lengths.max()) + 1):
        active = np.flatnonzero(lengths >= column)
        rows = place[active]
        order = np.argsort(bwt, kind="stable")  # rows by their symbol: the order of the suffixes one symbol longer
        turn = np.empty(len(order), np.int64)
        turn[order] = np.arange(len(order))
        ended = int(np.searchsorted(bwt[order], 1)) if len(order) else 0
        rank = turn[rows]
        target = count + rank - ended
        by_target = np.argsort(target)
        target, rank, who = target[by_target], rank[by_target], active[by_target]

        def common(ranks: np.ndarray) -> np.ndarray:
            """Common prefix of the suffix that a ranked row makes with the one before it."""
            out = np.zeros(len(ranks), np.int16)
            here = order[ranks]
            before = order[np.maximum(ranks - 1, 0)]
            same = (ranks > ended) & (bwt[here] == bwt[before])
            a, b = before[same] + 1, here[same] + 1
            sizes = b - a
            if len(sizes):
                starts = np.cumsum(sizes) - sizes
                flat_at = np.arange(int(sizes.sum())) - np.repeat(starts - a, sizes)
                out[same] = np.minimum(np.minimum.reduceat(lcp[flat_at], starts) + 1, cap)
            return out

        own, after = common(rank), rank + 1
        after = after[after < len(order)]
        next_common = common(after)
        fresh = np.zeros(len(bwt) + len(target), bool)
        fresh[target] = True
        new_bwt, new_lcp = np.empty(len(fresh), np.int16), np.empty(len(fresh), np.int16)
        new_bwt[~fresh], new_lcp[~fresh] = bwt, lcp
        new_bwt[target] = symbol(who, column)
        # What comes after a new suffix has a new neighbour.
        new_lcp[count + after - ended] = next_common
        new_lcp[target] = own
        place = np.flatnonzero(~fresh)[place]  # texts that have ended stay, shifted
        place[who] = target
        bwt, lcp = new_bwt, new_lcp
    return bwt, lcp


def repeated(texts: list[bytes], rank: list[np.ndarray], size: int = SIZE) -> list[np.ndarray]:
    """Per text the windows of which an equal one ranks earlier; ``rank`` has a different number per place, or equal ones for one place."""
    if not texts:
        return []
    bwt, lcp = build(texts, size)
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(order), np.int64)
    ended = int((bwt == 0).sum())
    step[order] = np.arange(len(order)) + len(texts) - ended
    lengths = np.array([len(t) for t in texts])
    # Walk every text from its end: the row of each of its suffixes.
    row = np.arange(len(texts))
    text_of, start_of, rows = [], [], []
    for column in range(int(lengths.max()) + 1):
        active = np.flatnonzero(lengths >= column)
        if column:
            row[active] = step[row[active]]
        if column >= size:
            text_of.append(active)
            start_of.append(lengths[active] - column)
            rows.append(row[active].copy())
    if not rows:
        return [np.zeros(0, np.int64) for _ in texts]
    text_of, start_of, rows = (np.concatenate(x) for x in (text_of, start_of, rows))
    by_row = np.argsort(rows)
    text_of, start_of, rows = text_of[by_row], start_of[by_row], rows[by_row]
    run = np.cumsum(lcp < size)[rows]
    begins = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    base = np.cumsum([0, *(len(r) for r in rank)])
    ranks = np.concatenate(rank)[base[text_of] + start_of]
    least = np.repeat(np.minimum.reduceat(ranks, begins), np.diff(np.append(begins, len(run))))
    late = ranks > least
    text_of, start_of = text_of[late], start_of[late]
    by_text = np.lexsort((start_of, text_of))
    text_of, start_of = text_of[by_text], start_of[by_text]
    cuts = np.searchsorted(text_of, np.arange(len(texts) + 1))
    return [start_of[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of neighbouring numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()))


def collection(found: list[tuple[int, int, bytes]], size: int) -> list[tuple[int, int, int]]:
    """(key, first, last): windows of (key, place, bytes) that occur at an earlier key or place among them."""
    if len(found) < 2:
        return []
    # Windows whose hash occurs once have no equal; what is left of a read is cut to runs of the others.
    lengths = np.array([len(d) for _, _, d in found])
    flat = np.frombuffer(b"".join(d for _, _, d in found), np.uint8)
    ends = np.cumsum(lengths)
    hashes, where = [], []
    at = 0
    while at < len(found):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRETCH, side="right")))
        low = int(ends[at - 1]) if at else 0
        h = rolling(flat[low:ends[stop - 1]], size)
        spots = np.concatenate([np.arange(int(ends[i] - lengths[i]), int(ends[i]) - size + 1) for i in range(at, stop)])
        hashes.append(h[spots - low])
        where.append(spots)
        at = stop
    hashes, where = np.concatenate(hashes), np.concatenate(where)
    _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
    alive = np.zeros(len(flat) + 1, bool)
    alive[where[count[back] > 1]] = True
    out: list[tuple[int, int, int]] = []
    firsts: dict[bytes, int] = {}
    pieces: list[tuple[int, int, bytes]] = []
    for (key, place, data), end, n in sorted(zip(found, ends.tolist(), lengths.tolist()), key=lambda x: x[0][:2]):
        base = end - n
        for a, b in _ranges(np.flatnonzero(alive[base:end - size + 1])):
            part = data[a:b + size]
            if part in firsts:
                out.append((key, place + a, place + b))  # the same piece came before
            else:
                firsts[part] = len(pieces)
                pieces.append((key, place + a, part))
    # Pieces are in the order of key and place: number the places alike.
    keys = np.concatenate([np.full(len(d), k, np.int64) for k, _, d in pieces]) if pieces else np.zeros(0, np.int64)
    places = np.concatenate([np.arange(p, p + len(d)) for _, p, d in pieces]) if pieces else np.zeros(0, np.int64)
    order = np.lexsort((places, keys))
    new = np.ones(len(order), np.int64)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (places[order][1:] != places[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    cuts = np.cumsum([0, *(len(d) for _, _, d in pieces)]).tolist()
    for (key, place, _), starts in zip(pieces, repeated([d for _, _, d in pieces], [rank[a:b] for a, b in zip(cuts, cuts[1:])], size)):
        out += [(key, place + a, place + b) for a, b in _ranges(starts)]
    return out


def _collected(size: int, gram: int, width: int, per: int, limit: int):
    """Rows come by g, key, at.  Repeats (first, last), or where an anchor has too many reads, its reads in parts."""
    span = size - gram + 1

    def parts(key: int, at: int, lead: int, data: bytes) -> Iterator[tuple]:
        """Pieces of a read whose windows lie ``low`` to ``high`` bytes before the anchor, and the bytes these share."""
        for low in range(0, span, width):
            high = min(low + width, span) - 1
            a, b = max(lead - high, 0), min(lead - low, len(data) - size)
            if a <= b:
                shared = data[max(lead - low, 0):lead - high + size]
                yield xxhash.xxh3_64_intdigest(shared, low) - (1 << 63), key, at + a, lead - a, data[a:b + size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int, bytes]] = []
        group: dict[bytes, tuple[int, int, int]] = {}
        current, crowded = None, False
        marks: list[tuple[int, int, int]] = []
        split: list[tuple] = []

        def close() -> None:
            nonlocal group
            if not crowded and len(group) > 1:
                done.extend((key, at, data) for data, (key, at, _) in group.items())
            group = {}

        def flush() -> None:
            marks.extend(collection(done, size))
            done.clear()

        def rows() -> pa.RecordBatch:
            cols = [[None] * len(marks) + [s[0] for s in split], [m[0] for m in marks] + [s[1] for s in split], [m[1] for m in marks] + [s[2] for s in split],
                    [m[2] for m in marks] + [s[3] for s in split], [None] * len(marks) + [s[4] for s in split]]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            marks.clear()
            split.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["g", "key", "at", "last", "data"])

        for batch in batches:
            for g, key, at, lead, data in zip(*(batch.column(n).to_pylist() for n in ("g", "key", "at", "lead", "data"))):
                if g != current:
                    close()
                    current, crowded = g, False
                    if len(done) >= per:
                        flush()
                if data in group:
                    marks.append((key, at, at + len(data) - size))
                elif crowded:
                    split.extend(parts(key, at, lead, data))
                else:
                    group[data] = (key, at, lead)
                    if len(group) > limit and width:
                        crowded = True
                        for d, (k, p, n) in group.items():
                            split.extend(parts(k, p, n, d))
            yield rows()
        close()
        flush()
        yield rows()
    return run


def _removed(size: int):
    """What is left of a text without the windows of its ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist()):
                data = (text or "").encode()
                if ranges:
                    depth = np.zeros(len(data) + 1, np.int64)
                    np.add.at(depth, [r["first"] for r in ranges], 1)
                    np.add.at(depth, [r["last"] + size for r in ranges], -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    rows.append((len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
                else:
                    rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, key, text: ``key`` is a different whole number per row, in the order of doc_id.

    The id itself where it is one; else rows are numbered in the order of id (null last) and text.
    """
    rows = columns(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        total, ids = rows.select("doc_id").groupBy("doc_id").count().agg(F.sum("count"), F.count("doc_id")).first()
        if (total or 0) == ids:
            return rows.select("doc_id", F.col("doc_id").cast("long").alias("key"), "text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_last(), F.col("text").asc()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_last(), F.col("text").asc())
    return cut_lineage(ordered.withColumn("key", F.monotonically_increasing_id()).select("doc_id", "key", "text"))


def ranges(work: DataFrame, size: int = SIZE, gram: int = GRAM, per: int = READS, limit: int = LIMIT) -> DataFrame:
    """key, first, last: runs of windows of ``work`` (key, text) that occur at an earlier key or place."""
    rows = work.mapInArrow(_found(size, gram), "g long, r long, key long, place long")
    met = rows.repartition("g").sortWithinPartitions("g", "r", "key", "place")
    marks = cut_lineage(met.mapInArrow(_sorted_out, "g long, key long, first int, last int, lead int, edge boolean"))
    out = marks.filter(~F.col("edge")).select("key", "first", "last")
    edges = marks.filter("edge").groupBy("key").agg(F.collect_list(F.struct("g", "first", "last", "lead")).alias("edges"))
    cut = work.select("key", "text").join(edges.hint("shuffle_hash"), "key").mapInArrow(_cut(size), "g long, key long, at int, lead int, data binary")
    for width in (8, 1, 0):
        met = cut.repartition("g").sortWithinPartitions("g", "key", "at")
        found = cut_lineage(met.mapInArrow(_collected(size, gram, width, per, limit), "g long, key long, at int, last int, data binary"))
        out = out.unionByName(found.filter("g is null").select("key", F.col("at").alias("first"), "last"))
        cut = found.filter("g is not null").select("g", "key", "at", F.col("last").alias("lead"), "data")
        if cut.isEmpty():
            break
    return out


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, per: int = READS, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of ``docs``.

    A byte goes if a window of ``size`` bytes over it also starts earlier, in a document with a smaller id or earlier in
    the same one.  Rows without an id come last, and rows that repeat an id come in the order of their text.  Null texts
    are empty; texts shorter than a window keep all.  An empty table gives an empty result.
    """
    if not 0 < gram <= size <= 4096:
        raise ValueError("windows of at most 4096 bytes, with anchors inside")
    rows = numbered(docs)
    own = ranges(rows, size, gram, per, limit).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(own.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "ranges").mapInArrow(
        _removed(size), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
