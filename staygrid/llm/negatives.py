"""Hard negatives from an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; the pair of codewords is a row's cell.  A half-space
bound of a query is its product with the codeword plus its length times the codeword's radius, so the sum of two bounds
is above every score in their cell.  Cells are dealt to shards of bounded size.  Inside a shard a heap walks through the
cells by falling bound (the multi-sequence algorithm), and a search ends once no bound left reaches what it still needs:
its window of results is then certified, and the answer is exact.  Between shards the same bounds, of whole shards, say
which ones a query need not visit.

Positives are found first (a few shards give a bar, the others only see queries whose bound reaches it); their scores
are the windows in which negatives are searched.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staygrid.session import cut_lineage

#: Rows the codebooks are learned from (a bounded sample; the index holds every row), and rounds of k-means.
SAMPLE, ROUNDS = 4096, 12
#: Codewords of a half: at least, and at most.
LEAST_WORDS, MOST_WORDS = 16, 64
#: Rows of a shard, about; queries searched side by side; shards that set the first bar; rows scored at once.
SHARD, BLOCK, FIRST, CHUNK = 8192, 1 << 16, 2, 512


def finite(vector: Column) -> Column:
    """Whether the vector and all its components are there, none infinite or not a number."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(vector: Column, by: int = 256) -> Column:
    """floor(by * x) of every component, in doubles."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(by)) * x.cast("double")))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """One row per vector; shorter ones go on with zeros."""
    sizes = np.asarray(vectors.value_lengths())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles, which hold them exactly below 2**53, else in integers."""
    if len(rows) and np.abs(rows).max() * max(1.0, float(np.abs(q).sum())) >= 2.0 ** 53:
        return np.array([sum(int(a) * int(b) for a, b in zip(r, q)) for r in rows], np.int64)
    return (rows @ q).astype(np.int64)


def codebook(points: np.ndarray, words: int, seed: int) -> np.ndarray:
    """k-means; first codewords are far apart."""
    points = np.unique(points, axis=0)
    if not len(points):
        return np.zeros((1, points.shape[1]))
    rng = np.random.default_rng(seed)
    chosen = [points[0]]
    gap = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < min(words, len(points)) and gap.sum() > 0:
        chosen.append(points[rng.choice(len(points), p=gap / gap.sum())])
        gap = np.minimum(gap, ((points - chosen[-1]) ** 2).sum(axis=1))
    centers = np.array(chosen)
    for _ in range(ROUNDS):
        own = nearest(points, centers)[0]
        for k in range(len(centers)):
            if (own == k).any():
                centers[k] = points[own == k].mean(axis=0)
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest center of each point, and how far it is."""
    own = (-2 * points @ centers.T + (centers ** 2).sum(axis=1)).argmin(axis=1)
    return own, np.sqrt(((points - centers[own]) ** 2).sum(axis=1))


class Books:
    """The two codebooks."""

    def __init__(self, sample: np.ndarray, words: int):
        self.width, self.half = sample.shape[1], sample.shape[1] // 2
        self.a, self.b = codebook(sample[:, :self.half], words, 1), codebook(sample[:, self.half:], words, 2)

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, and how far each half is from its codeword."""
        (i, r), (j, s) = nearest(rows[:, :self.half], self.a), nearest(rows[:, self.half:], self.b)
        return i * len(self.b) + j, r, s

    def bounds(self, q: np.ndarray, r: np.ndarray, s: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per half: product of ``q`` with the codewords ``i`` (``j``), and how far a score can be off within their radii."""
        left, right = q[:self.half], q[self.half:]
        return self.a[i] @ left, np.linalg.norm(left) * r, self.b[j] @ right, np.linalg.norm(right) * s


def above(bound):
    """The whole number that no score below the bound, worked out in doubles, is above."""
    return np.floor(bound + 1e-6 * (1 + np.abs(bound)))


def _celled(books: Books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, r, s = books.cells(matrix(batch.column("q"), books.width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(r, pa.float64()), pa.array(s, pa.float64())],
                                             names=[*batch.schema.names, "cell", "r", "s"])
    return run


class Directory:
    """Cells with their radii, dealt to shards; bounded by the number of codewords, not by the rows."""

    def __init__(self, books: Books, cells: list, limit: int):
        self.books = books
        self.cell = np.array([c.cell for c in cells], np.int64)
        self.r, self.s = np.array([c.r for c in cells], float), np.array([c.s for c in cells], float)
        self.first, self.parts, shard, held = [], [], 0, 0
        for c in cells:  # neighbouring cells share a shard, a large cell is dealt to several
            parts = -(-c.n // limit)
            if parts > 1 or held + c.n > limit:
                shard, held = shard + (held > 0), 0
            self.first.append(shard)
            self.parts.append(parts)
            shard, held = (shard + parts, 0) if parts > 1 else (shard, held + c.n)

    def shards(self, q: np.ndarray, floor: float, ceiling: float) -> list[int]:
        """Shards with scores from ``floor`` to ``ceiling``, if any, the largest bound first."""
        i, j = np.divmod(self.cell, len(self.books.b))
        left, more, right, rest = self.books.bounds(q, self.r, self.s, i, j)
        top, low = above(left + right + more + rest), -above(more + rest - left - right)
        best: dict[int, float] = {}
        for k in np.flatnonzero((top >= floor) & (low <= ceiling)).tolist():
            for shard in range(self.first[k], self.first[k] + self.parts[k]):
                best[shard] = max(best.get(shard, -np.inf), top[k])
        return sorted(best, key=lambda x: (-best[x], x))


def _visits(directory: Directory, take: Callable[[list[int], list[int]], list[int]]):
    """no, id, label, q, wants, shard for every shard that a query visits; ``wants`` are its scores from lowest to highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shards = [], []
            for k, (q, wants) in enumerate(zip(matrix(batch.column("q"), directory.books.width), batch.column("wants").to_pylist())):
                found = take(directory.shards(q, *span(wants)), wants)
                at += [k] * len(found)
                shards += found
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shards, pa.int64())], names=[*part.schema.names, "shard"])
    return run


def span(wants: list[int]) -> tuple[float, float]:
    return (wants[0], wants[-1]) if wants else (-np.inf, np.inf)


class Cells:
    """The rows of one shard, by cell."""

    def __init__(self, books: Books, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, labels, cell = (table[c].to_numpy() for c in ("id", "label", "cell"))
        rows = matrix(table["q"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int64())), books.width)
        order = np.lexsort((*rows.T[::-1], labels, ids, cell))
        ids, labels, cell, rows = ids[order], labels[order], cell[order], rows[order]
        new = np.ones(len(ids), bool)  # a repeated row counts once
        new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)
        self.books, self.ids, self.labels, self.rows, cell = books, ids[new], labels[new], rows[new], cell[new]
        i, j = np.divmod(cell, len(books.b))
        _, r, s = books.cells(self.rows)
        self.i, i = np.unique(i, return_inverse=True)
        self.j, j = np.unique(j, return_inverse=True)
        self.r, self.s = np.zeros(len(self.i)), np.zeros(len(self.j))
        np.maximum.at(self.r, i, r)
        np.maximum.at(self.s, j, s)
        self.size = np.zeros((len(self.i), len(self.j)), np.int64)
        np.add.at(self.size, (i, j), 1)
        self.end = np.cumsum(self.size).reshape(self.size.shape)  # rows are sorted by (i, j)

    def walk(self, q: np.ndarray, ceiling: float) -> Iterator[tuple[float, int, int]]:
        """(bound, first row, last row) of the cells by falling bound; cells whose scores all are above ``ceiling`` are passed over."""
        left, more, right, rest = self.books.bounds(q, self.r, self.s, self.i, self.j)
        a, b = np.argsort(-(left + more)), np.argsort(-(right + rest))
        x, y = (left + more)[a].tolist(), (right + rest)[b].tolist()
        low, deep = (left - more)[a].tolist(), (right - rest)[b].tolist()
        size, end = self.size[np.ix_(a, b)].tolist(), self.end[np.ix_(a, b)].tolist()
        heap = [(-x[0] - y[0], 0, 0)] if x else []
        while heap:
            bound, i, j = heapq.heappop(heap)
            # Each pair is reached along one way only: down the first list from pairs that begin the second.
            if j + 1 < len(y):
                heapq.heappush(heap, (-x[i] - y[j + 1], i, j + 1))
            if not j and i + 1 < len(x):
                heapq.heappush(heap, (-x[i + 1] - y[0], i + 1, 0))
            yield -bound, end[i][j] - size[i][j], end[i][j] if -above(-low[i] - deep[j]) <= ceiling else end[i][j] - size[i][j]

    def search(self, q: np.ndarray, own: Callable[[np.ndarray, np.ndarray], np.ndarray], windows: list[tuple[float, float]], keep: int) -> list[np.ndarray]:
        """Per window (lowest and highest score) its first ``keep`` rows: (id, score) by falling score, then rising id."""
        best = [np.zeros((0, 2), np.int64) for _ in windows]
        need = [low for low, _ in windows]
        cells, over = self.walk(q, max((high for _, high in windows), default=-np.inf)), False
        while not over and windows:
            chunk, size, over = [], 0, True
            for bound, first, last in cells:
                if above(bound) < min(need):
                    break
                if last > first:
                    chunk.append(np.arange(first, last))
                    size += last - first
                if size >= CHUNK:
                    over = False
                    break
            if not chunk:
                break
            at = np.concatenate(chunk)
            at = at[own(self.ids[at], self.labels[at])]
            score, ids = products(self.rows[at], q), self.ids[at]
            for k, (_, high) in enumerate(windows):
                good = (score >= need[k]) & (score <= high)
                if good.any():
                    both = np.concatenate((best[k], np.column_stack((ids[good], score[good]))))
                    best[k] = both[np.lexsort((both[:, 0], -both[:, 1]))[:keep]]
                    if len(best[k]) == keep:
                        need[k] = max(need[k], int(best[k][-1, 1]))
        return best


def _searched(books: Books, keep: int, negative: bool, low: int, high: int):
    """Rows come by (shard, block), a shard's rows before its queries; one shard at a time is in memory, and a batch of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, cells = None, [], None
        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "kind"))))
            at, out = 0, []
            while at < len(key):
                to = at + 1
                while to < len(key) and key[to] == key[at]:
                    to += 1
                part = batch.slice(at, to - at)
                if key[at][:2] != now:
                    now, parts, cells = key[at][:2], [], None
                if key[at][2] == 0:
                    parts.append(part.select(["id", "label", "q", "cell"]))
                elif parts:
                    cells = cells or Cells(books, parts)
                    for no, id_, label, wants, q in zip(*(part.column(c).to_pylist() for c in ("no", "id", "label", "wants")), matrix(part.column("q"), books.width)):
                        if negative:
                            windows = [(-(-low * p // high), p) for p in wants[1:]]
                            for p, found in zip(wants[1:], cells.search(q, lambda i, n: n != label, windows, keep)):
                                out += [(no, p, x, y) for x, y in found.tolist()]
                        else:
                            found, = cells.search(q, lambda i, n: (n == label) & (i != id_), [span(wants)], keep)
                            out += [(no, 0, x, y) for x, y in found.tolist()]
                at = to
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["no", "wanted", "id", "score"])
    return run


class Index:
    """The stored rows (id, label, q), each with its cell and shard."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, shard: int = SHARD):
        """``rows`` has id, label (longs) and q (array of longs); it is read more than once, so it should be stored."""
        count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
        # About ``sample`` distinct vectors by a hash, so that no task sends more than its share of them.
        chance = F.shiftrightunsigned(F.xxhash64("q"), 1) < int(min(1.0, sample / max(1, count)) * (2.0 ** 63 - 1024))
        some = rows.filter(chance).select("q").distinct().limit(2 * sample).collect()
        words = int(min(MOST_WORDS, max(LEAST_WORDS, (4 * count / shard) ** 0.5)))
        books = self.books = Books(matrix(pa.array([r.q for r in some], pa.list_(pa.int64())), max(2, width or 0)), words)
        celled = cut_lineage(rows.select("id", "label", "q").mapInArrow(_celled(books), "id long, label long, q array<long>, cell long, r double, s double"))
        cells = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r"), F.max("s").alias("s")).orderBy("cell").collect()
        d = self.directory = Directory(books, cells, shard)
        place = dict(zip(d.cell.tolist(), zip(d.first, d.parts)))
        every = range(len(books.a) * len(books.b))
        first, parts = (F.element_at(F.array(*(F.lit(place.get(c, (0, 1))[k]) for c in every)), F.col("cell").cast("int") + 1).cast("long") for k in range(2))
        self.rows = celled.select("id", "label", "q", "cell", (first + F.pmod(F.xxhash64("id", "label"), parts)).alias("shard"))

    def search(self, queries: DataFrame, take: Callable[[list[int], list[int]], list[int]], keep: int, blocks: int, negative: bool = False, low: int = 0, high: int = 1) -> DataFrame:
        """no, wanted, id, score for ``queries`` (no, id, label, q, wants): the first ``keep`` of each shard that ``take`` lets a query visit."""
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
        visits = queries.mapInArrow(_visits(self.directory, take), f"{fields}, shard long").withColumn("cell", F.lit(None).cast("long"))
        rows = self.rows.withColumns({"no": F.lit(None).cast("long"), "wants": F.lit(None).cast("array<long>"), "block": F.explode(upto(blocks))})
        both = rows.withColumn("kind", F.lit(0)).unionByName(visits.withColumns({"block": F.pmod("no", F.lit(blocks)), "kind": F.lit(1)}))
        dealt = both.repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
        return dealt.mapInArrow(_searched(self.books, keep, negative, low, high), "no long, wanted long, id long, score long")


def upto(count: int) -> Column:
    """0, 1, ... below ``count``."""
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))


def best(found: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` of each query and score wanted, with their rank."""
    order = W.partitionBy("no", "wanted").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         sample: int = SAMPLE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and vector (whole numbers).  Anchors are the rows where ``anchor`` holds.  Positives are an
    anchor's first rows of its label by inner product (ties: smaller vec_id), without rows of its own vec_id.  Negatives of a
    positive are the first rows of other labels whose score lies between ``low`` of ``high`` parts of the positive's and all of it;
    a positive with a score below 0 has none.

    Rows whose vec_id, label, vector or any component is null take no part.  Repeated rows count once.  Missing components
    of shorter vectors count as 0.  Inner products must fit into 64 bits.  An empty table, one without anchors or with one
    label gives no rows.  The result is exact and does not depend on ``sample``, ``shard`` and ``block``.
    """
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
    rows = cut_lineage(usable.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("q"),
                                     F.coalesce(anchor, F.lit(False)).alias("asks")))
    index = Index(rows, sample, shard)
    nothing = F.array().cast("array<long>")
    asked = cut_lineage(rows.filter("asks").select("id", "label", "q").distinct().withColumn("no", F.monotonically_increasing_id()).withColumn("wants", nothing))
    blocks = max(1, -(-asked.count() // block))
    first = cut_lineage(best(index.search(asked, lambda shards, _: shards[:FIRST], positives, blocks), positives))
    bars = first.filter(F.col("rank") == positives).select("no", F.array("score", F.lit((1 << 63) - 1)).alias("bar"))
    # The bounds put the shards of the first round in front again, with or without a bar.
    barred = asked.join(bars, "no", "left").select("no", "id", "label", "q", F.coalesce("bar", "wants").alias("wants"))

    rest = index.search(barred, lambda shards, _: shards[FIRST:], positives, blocks)
    found = first.select("no", "wanted", "id", "score").unionByName(rest)
    chosen = cut_lineage(best(found, positives).select("no", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    lowest = F.ceil(F.col("least") * low / high).cast("long")
    wants = chosen.filter(F.col("positive_score") >= 0).groupBy("no").agg(F.min("positive_score").alias("least"), F.sort_array(F.collect_set("positive_score")).alias("scores"))
    windows = asked.drop("wants").join(wants.select("no", F.concat(F.array(lowest), "scores").alias("wants")), "no").select("no", "id", "label", "q", "wants")
    far = best(index.search(windows, lambda shards, _: shards, negatives, blocks, True, low, high), negatives)
    named = chosen.join(asked.select("no", F.col("id").alias("anchor_id")), "no")
    return named.join(far.select("no", F.col("wanted").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["no", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
