"""Ranked lexical search by range maxima over posting lists.

Documents are dealt out to shards.  In a shard every query term has a posting list in the order of doc_id, and all lists
together a sparse table that answers "which posting of this stretch has the largest impact" from two look-ups.  A query
starts with the interval of all documents of the shard.  Its bound is the sum of its terms' range maxima; the interval
with the largest bound is split at the document with the largest single impact, which is scored, and both sides go back
on the heap with bounds of their own.  What holds few postings is scored as a whole.  The search ends when no bound
reaches the worst kept score, so the ranking is exact.

A first round over one in ``FIRST`` shards gives every query a score that its last kept document has at least; in the
second round that bar is known from the start, and most shards are done with their first interval.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staygrid.llm.common import slices
from staygrid.session import cut_lineage

#: Postings and documents that a shard holds, about; queries that are searched side by side.
POSTINGS, DOCS, QUERIES = 1 << 20, 1 << 15, 1024
#: An interval with so few postings is scored whole.
LEAF = 4096
#: One in so many shards is searched first.
FIRST = 16
#: Documents leave out terms whose place in a table of so many bits no query term has; it is as large for any number of queries.
SLOTS = 1 << 20
#: Bytes of terms as they are, A-Z in lower case, any other byte as a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode().translate(TABLE).split()


def _listed(key: str, slots: bytes | None):
    """key, n, terms, tfs of each text; without slots all distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, ends, terms, tfs = [], [0], [], []
            for text in part.column("text").to_pylist():
                words = terms_of(text)
                sizes.append(len(words))
                for term, tf in Counter(words).items():
                    if slots is None or slots[crc32(term) % SLOTS]:
                        terms.append(term)
                        tfs.append(tf)
                ends.append(len(terms))
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, pa.binary())),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tfs, pa.int64()))],
                names=[key, "n", "terms", "tfs"])
    return run


def _lists(rows: DataFrame, key: str, slots: bytes | None = None) -> DataFrame:
    """Stored: key, n, terms, tfs, and a number for each row."""
    chosen = rows.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    listed = chosen.mapInArrow(_listed(key, slots), f"{key} long, n long, terms array<binary>, tfs array<long>")
    return cut_lineage(listed.withColumn("no", F.monotonically_increasing_id()))


def span(first: int, end: int) -> Column:
    """first, first + 1, ... below ``end``."""
    return F.sequence(F.lit(first).cast("long"), F.lit(end - 1).cast("long"))


class Shard:
    """Posting lists of the terms of some queries in some documents, with their range maxima."""

    def __init__(self, terms: list[bytes], weights: np.ndarray):
        self.terms, self.weights = pa.array(terms, pa.binary()), weights
        self.ids: list[np.ndarray] = []
        self.unknown: list[np.ndarray] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, part: pa.RecordBatch) -> None:
        """Documents: id (may be null), m, terms, nums."""
        terms, ids = part.column("terms"), part.column("id")
        which = pc.index_in(terms.flatten(), value_set=self.terms)
        known = pc.is_valid(which).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))[known]
        tf = part.column("nums").flatten().to_numpy(zero_copy_only=False)[known]
        m = part.column("m").to_numpy(zero_copy_only=False)[doc]
        which = which.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids.append(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False))
        self.unknown.append(pc.is_null(ids).to_numpy(zero_copy_only=False))
        self.postings.append((which, doc + self.size, self.weights[which] * (1_000_000_000 * tf // (1000 * tf + 8 * m))))
        self.size += part.num_rows

    def close(self) -> None:
        """Sorts the lists and builds the sparse table: level k has the best of 2**k postings from each place on."""
        ids, unknown = np.concatenate(self.ids or [np.zeros(0, np.int64)]), np.concatenate(self.unknown or [np.zeros(0, bool)])
        order = np.lexsort((ids, unknown))
        self.ids, self.unknown = ids[order], unknown[order]
        place = np.empty(self.size, np.int64)
        place[order] = np.arange(self.size)
        which, doc, impact = (np.concatenate([p[i] for p in self.postings] or [np.zeros(0, np.int64)]) for i in range(3))
        self.postings = []
        keys = which * max(1, self.size) + place[doc]
        order = np.argsort(keys)
        self.keys, self.impact = keys[order], impact[order]
        self.doc = (self.keys % max(1, self.size)).astype(np.int64)
        count = np.bincount(which, minlength=len(self.terms))
        self.ends = np.cumsum(count)
        self.starts = self.ends - count
        top = int(count.max()).bit_length() if len(count) else 0
        levels, best = [], np.arange(len(self.keys), dtype=np.int32)
        for k in range(top):
            levels.append(best)
            other = best[np.minimum(np.arange(len(best)) + (1 << k), len(best) - 1)]
            best = np.where(self.impact[best] >= self.impact[other], best, other)
        self.table = np.stack(levels) if levels else np.zeros((0, 0), np.int32)
        self.log = np.array([max(0, n.bit_length() - 1) for n in range(int(count.max()) + 1 if len(count) else 1)])

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int]:
        """Sum of the largest impacts of all stretches, and the document with the largest of them."""
        held = hi > lo
        lo, hi = lo[held], hi[held]
        if not len(lo):
            return 0, -1
        k = self.log[hi - lo]
        a, b = self.table[k, lo], self.table[k, hi - (1 << k)]
        best = np.where(self.impact[a] >= self.impact[b], a, b)
        found = self.impact[best]
        return int(found.sum()), int(self.doc[best[found.argmax()]])

    def search(self, terms: np.ndarray, keep: int, bar: int) -> list[tuple[int, int]]:
        """(score, place) of the best ``keep`` documents, as far as their score is ``bar`` or more, and over 0."""
        lo, hi = self.starts[terms], self.ends[terms]
        kept: list[tuple[int, int]] = []  # a heap of (score, -place)
        bar = max(bar, 1)

        def offer(score: int, place: int) -> None:
            if score >= bar:
                if len(kept) < keep:
                    heapq.heappush(kept, (score, -place))
                elif (score, -place) > kept[0]:
                    heapq.heapreplace(kept, (score, -place))

        bound, at = self.maxima(lo, hi)
        todo = [(-bound, 0, self.size, at, lo, hi)]
        while todo:
            bound, first, last, at, lo, hi = heapq.heappop(todo)
            least = max(bar, kept[0][0]) if len(kept) == keep else bar
            if -bound < least:
                break
            if len(kept) == keep and -bound == least == kept[0][0] and first > -kept[0][1]:
                continue  # ties at best, of documents that come later
            count = hi - lo
            if int(count.sum()) <= LEAF:
                where = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
                scores = np.bincount(self.doc[where] - first, weights=self.impact[where]).astype(np.int64)  # exact: sums are below 2**53
                good = np.flatnonzero(scores >= least)
                if len(good) > keep:
                    good = good[np.lexsort((good, -scores[good]))[:keep]]
                for x in good.tolist():
                    offer(int(scores[x]), first + x)
                continue
            mid = np.clip(np.searchsorted(self.keys, terms * self.size + at), lo, hi)
            has = mid < hi
            has[has] = self.doc[mid[has]] == at
            offer(int(self.impact[mid[has]].sum()), at)
            for f, t, a, b in ((first, at, lo, mid), (at + 1, last, mid + has, hi)):
                bound, best = self.maxima(a, b)
                if best >= 0 and bound >= least:
                    heapq.heappush(todo, (-bound, f, t, best, a, b))
        return [(score, -place) for score, place in kept]


def _searched(keep: int):
    """Rows come by (shard, block), the queries of a shard before its documents; one shard at a time is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, shard = None, [], None

        def opened() -> Shard:
            weights: dict[bytes, int] = {}
            for _, terms, w, _ in queries:
                weights.update(zip(terms, w))
            return Shard(list(weights), np.array(list(weights.values()), np.int64))

        def closed() -> pa.RecordBatch:
            found: list[tuple[int, int | None, int]] = []
            if shard is not None:
                shard.close()
                number = {t: i for i, t in enumerate(shard.terms.to_pylist())}
                for no, terms, _, bar in queries:
                    for score, place in shard.search(np.array(sorted(number[t] for t in terms), np.int64), keep, bar):
                        found.append((no, None if shard.unknown[place] else int(shard.ids[place]), score))
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query", "doc_id", "score"])

        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "kind"))))
            at = 0
            while at < len(key):
                to = at + 1
                while to < len(key) and key[to] == key[at]:
                    to += 1
                part = batch.slice(at, to - at)
                if key[at][:2] != now:
                    yield closed()
                    now, queries, shard = key[at][:2], [], None
                if key[at][2] == 0:
                    queries += [(no, t, w, bar or 0) for no, t, w, bar in zip(*(part.column(c).to_pylist() for c in ("no", "terms", "nums", "m"))) if t]
                elif queries:
                    shard = shard or opened()
                    shard.add(part)
                at = to
        yield closed()
    return run


def search(docs: DataFrame, items: DataFrame, keep: int = 10, postings: int = POSTINGS, documents: int = DOCS, queries: int = QUERIES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``keep`` best rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Scores are those of the contract: integer impacts of saturating term frequencies, weighted by rarity; equal scores
    come by ascending doc_id, a null doc_id last.  Every row is a document or a query of its own, repeated ones too.
    Null texts have no terms; a query without terms, or whose terms no document has, gives no rows, and neither do empty
    tables.  Ids are integers; other columns are not read.

    ``postings`` and ``documents`` bound a shard (but for its last document), ``queries`` what is searched at a time; they change no result.
    """
    asked = _lists(items, "item_id")
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    slots = bytearray(SLOTS)
    # At most SLOTS numbers, for any number of queries.
    for (at,) in wanted.select((F.crc32("term") % SLOTS).alias("at")).distinct().collect():
        slots[at] = 1
    listed = _lists(docs, "doc_id", bytes(slots))
    total, words, entries = listed.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.sum(F.size("terms").cast("long"))).first()
    asking = asked.count()
    if not total or not asking:
        return asked.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    df = listed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarity = F.floor(1000 * F.log((2 * F.lit(total) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weighed = wanted.join(df, "term").select("term", rarity.alias("w"))
    weights = asked.select("no", F.explode("terms").alias("term")).join(weighed, "term").groupBy("no").agg(F.collect_list(F.struct("term", "w")).alias("own"))
    blocks, shards = -(-asking // queries), max(1, -(-entries // postings), -(-total // documents))
    asked_rows = cut_lineage(asked.select("no", "item_id").join(weights, "no").select(
        "no", "item_id", F.col("own.term").alias("terms"), F.col("own.w").alias("nums"), F.pmod("no", F.lit(blocks)).alias("block")))
    m = F.expr(f"10 + (90 * n * {total}L) div {words}L")
    rows = listed.filter(F.size("terms") > 0).select(
        F.pmod(F.xxhash64("no"), F.lit(shards)).alias("shard"), F.explode(span(0, blocks)).alias("block"),
        F.lit(1).alias("kind"), F.lit(0).cast("long").alias("no"), F.col("doc_id").alias("id"), m.alias("m"), "terms", F.col("tfs").alias("nums"))
    first = -(-shards // FIRST)

    def part(begin: int, end: int, bars: DataFrame) -> DataFrame:
        ask = bars.select(F.explode(span(begin, end)).alias("shard"), "block", F.lit(0).alias("kind"), "no",
                          F.lit(None).cast("long").alias("id"), F.col("bar").alias("m"), "terms", "nums")
        dealt = ask.unionByName(rows.filter(F.col("shard").between(begin, end - 1))).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
        return dealt.mapInArrow(_searched(keep), "query long, doc_id long, score long")

    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = cut_lineage(part(0, first, asked_rows.withColumn("bar", F.lit(0).cast("long"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep))
    if shards > first:
        bars = found.filter(F.col("rank") == keep).select(F.col("query").alias("no"), F.col("score").alias("bar"))
        found = found.select("query", "doc_id", "score").unionByName(part(first, shards, asked_rows.join(bars, "no", "left")))
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    return found.join(asked.select(F.col("no").alias("query"), "item_id"), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
