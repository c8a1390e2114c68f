"""Token ids in shards of wavelet matrices.

Documents are encoded in ascending doc_id order and cut, between documents, into segments.  A segment keeps its
ids as the bit planes of a wavelet matrix over the ids that occur in it, with counts of ones per block, beside the
list of its documents.  From the planes one can read a token, count a token before a place and find its
occurrences without unpacking the segment; unpacking all of it is one pass per plane.

A shard is one Parquet file of segments, written and read by Spark, so any store that Spark reaches will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staygrid.llm import chunks
from staygrid.llm.chunks import Chunks, Clash, spread
from staygrid.llm.common import slices
from staygrid.session import work_path

END = 2
MAGIC = b"WMT1"
#: A segment is closed after so many tokens, at the end of the documents that were encoded together.
SEGMENT = 1 << 21
#: Bits between two counts of ones.
BLOCK = 512
#: Distinct chunks that a worker remembers; it starts anew beyond.
REMEMBERED = 1_000_000
SPACES = b" \t\n\x0b\x0c\r"


def tokenizer_path(path: str | None) -> str:
    """Where the vocabulary is on this machine; by default the public one, which every node has installed."""
    if path is None:
        import public_tokenizers
        return public_tokenizers.path("word_bpe_49k.json")
    return path


class Words(Chunks):
    """Encodes texts chunk by chunk with the tokenizers library, each distinct chunk once.

    The vocabulary's pre-tokens never span white space, nor the border of an ASCII letter or digit with a comma or full
    stop, and it ignores case; so a text's ids are those of the chunks between such borders, in lower case.  Where a hash
    does not tell chunks apart, the texts go to the library whole.  ``folds`` off leaves the case as it is, for
    vocabularies that tell it apart.
    """

    def __init__(self, path: str, end: int = END, folds: bool = True):
        import tokenizers

        self.lib = tokenizers.Tokenizer.from_file(path)
        vocabulary = self.lib.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kind = np.zeros(256, np.int8)  # 0 white space, 1 any other, 2 letter or digit, 3 comma or full stop
        self.kind[:] = [0 if bytes([c]).isspace() else 2 if bytes([c]).isalnum() else 3 if c in b".," else 1 for c in range(256)]
        self.plain = np.arange(256, dtype=np.uint8)
        self.lower = np.array([ord(chr(c).lower()) if folds and c < 128 else c for c in range(256)], np.uint8)
        super().__init__(end, REMEMBERED)

    def cut(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.frombuffer(raw, np.uint8)
        kind = self.kind[a]
        low = (self.plain if b"<|" in raw else self.lower)[a]  # names of special tokens are told by case
        border = np.ones(len(a) + 1, bool)
        border[1:-1] = (kind[1:] != kind[:-1]) & ((kind[1:] * kind[:-1] == 0) | (kind[1:] * kind[:-1] == 6))
        cuts = np.flatnonzero(border)
        starts, ends = cuts[:-1], cuts[1:]
        solid = kind[starts] != 0 if len(a) else np.zeros(0, bool)
        return starts[solid], ends[solid], low

    def ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.zeros(len(chunks), np.int64)
        letters = [i for i, c in enumerate(chunks) if c.isalpha()]
        others = [i for i, c in enumerate(chunks) if not c.isalpha()]
        found: list[np.ndarray] = []
        order: list[int] = []
        for at in range(0, len(letters), 1024):
            part = letters[at:at + 1024]
            # Chunks of letters are one pre-token each, so their last ids tell them apart.
            ids = np.array(self.lib.encode(" ".join([chunks[i] for i in part]), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                others += part
                continue
            sizes[part] = np.diff(ends, prepend=0)
            found.append(ids)
            order += part
        for at in range(0, len(others), 4096):
            part = others[at:at + 4096]
            each = [e.ids for e in self.lib.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False)]
            sizes[part] = [len(x) for x in each]
            found.append(np.array([i for x in each for i in x], np.uint32))
            order += part
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        # Back in the order of the chunks.
        starts = np.zeros(len(chunks), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return ids[spread(starts, sizes)], sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text's followed by the end id; and how many each has, with that."""
        data = [t.encode() for t in texts]
        out: list[np.ndarray] = []
        counts = np.ones(len(texts), np.int64)
        at = 0
        while at < len(data):
            if len(data[at]) + 1 >= chunks.STRETCH:
                for ids in self._long(data[at]):
                    out.append(ids)
                    counts[at] += len(ids)
                out.append(np.array([self.end], np.uint32))
                at += 1
                continue
            stop, size = at, 0
            while stop < len(data) and size + len(data[stop]) + 1 < chunks.STRETCH:
                size += len(data[stop]) + 1
                stop += 1
            bounds = np.cumsum([len(d) + 1 for d in data[at:stop]])
            try:
                starts, places, sizes = self.stretch(b"\n".join(data[at:stop]) + b"\n")
            except Clash:
                whole = [np.array([*self.lib.encode(t, add_special_tokens=False).ids, self.end], np.uint32) for t in texts[at:stop]]
                out += whole
                counts[at:stop] = [len(x) for x in whole]
                at = stop
                continue
            upto = np.searchsorted(starts, bounds)
            places, sizes = np.insert(places, upto, 0), np.insert(sizes, upto, 1)
            out.append(self.pool[spread(places, sizes)])
            total = np.concatenate(([0], np.cumsum(sizes)))
            counts[at:stop] = np.diff(total[np.concatenate(([0], upto + np.arange(1, len(upto) + 1)))])
            at = stop
        return np.concatenate(out) if out else np.zeros(0, np.uint32), counts

    def _long(self, data: bytes) -> Iterator[np.ndarray]:
        """A text of more than a stretch, cut at white space; a chunk longer than that goes to the library as it is."""
        at = 0
        while at < len(data):
            stop = min(at + chunks.STRETCH - 1, len(data))
            if stop < len(data):
                cut = max(data.rfind(bytes([c]), at, stop) for c in SPACES)
                if cut <= at:
                    nexts = [n for c in SPACES if (n := data.find(bytes([c]), stop)) >= 0]
                    stop = min(nexts, default=len(data))
                    yield np.array(self.lib.encode(data[at:stop].decode(), add_special_tokens=False).ids, np.uint32)
                    at = stop
                    continue
                stop = cut
            try:
                _, places, sizes = self.stretch(data[at:stop])
                yield self.pool[spread(places, sizes)]
            except Clash:
                yield np.array(self.lib.encode(data[at:stop].decode(), add_special_tokens=False).ids, np.uint32)
            at = stop


@lru_cache(maxsize=2)
def words(path: str, end: int) -> Words:
    return Words(path, end)


class WaveletMatrix:
    """Bit planes of a sequence of numbers, from the highest bit of their rank among the distinct ones."""

    def __init__(self, alphabet: np.ndarray, size: int, zeros: list[int], planes: list[np.ndarray]):
        self.alphabet, self.size, self.zeros, self.planes = alphabet, size, zeros, planes
        self._counts: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) + 1 if len(ids) else 0
        if top <= 1 << 22:
            seen = np.zeros(top, bool)
            seen[ids] = True
            alphabet = np.nonzero(seen)[0].astype(np.uint32)
            codes = np.zeros(top, np.uint32)
            codes[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
            x = codes[ids]
        else:
            alphabet, x = np.unique(ids, return_inverse=True)
        x = x.astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        zeros, planes = [], []
        for bit in range(cls.depth(len(alphabet)) - 1, -1, -1):
            ones = (x & x.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            low = x[~ones]
            zeros.append(len(low))
            x = np.concatenate((low, x[ones]))
        return cls(alphabet.astype(np.uint32), len(ids), zeros, planes)

    @staticmethod
    def depth(distinct: int) -> int:
        return max(0, int(distinct - 1).bit_length())

    def unpack(self) -> np.ndarray:
        """The whole sequence, plane by plane from the last."""
        x = np.zeros(self.size, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.size, bitorder="little").view(bool)
            out = np.empty_like(x)
            z = self.zeros[level]
            out[~ones] = x[:z]
            out[ones] = x[z:] | x.dtype.type(1 << (len(self.planes) - 1 - level))
            x = out
        return self.alphabet[x] if len(self.alphabet) else np.zeros(self.size, np.uint32)

    def counts(self) -> list[np.ndarray]:
        """Ones before each block, per plane."""
        if self._counts is None:
            self._counts = []
            for plane in self.planes:
                padded = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
                padded[:len(plane)] = plane
                per = np.bitwise_count(padded.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
                self._counts.append(np.concatenate(([0], np.cumsum(per))))
        return self._counts

    def _ones(self, level: int, at: int) -> int:
        """Ones before a place of a plane."""
        block = at // BLOCK
        plane = self.planes[level]
        start, stop = block * (BLOCK // 8), at // 8
        n = int(self.counts()[level][block]) + int(np.bitwise_count(plane[start:stop]).sum(dtype=np.int64))
        return n + (int(plane[stop]) & ((1 << (at % 8)) - 1)).bit_count() if at % 8 else n

    def _place(self, level: int, bit: int, nth: int) -> int:
        """Where the ``nth`` (from 0) bit of that value is in a plane."""
        ones = self.counts()[level]
        upto = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(upto, nth, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * (BLOCK // 8):(block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.nonzero(bits == bit)[0][nth - int(upto[block])])

    def access(self, at: int) -> int:
        """The number at a place."""
        code = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][at // 8]) >> (at % 8) & 1
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _code(self, number: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, number))
        return at if at < len(self.alphabet) and self.alphabet[at] == number else None

    def _range(self, code: int, before: int) -> tuple[int, int]:
        """Where, below the last plane, the places before ``before`` with that code lie."""
        low, high = 0, before
        for level in range(len(self.planes)):
            a, b = self._ones(level, low), self._ones(level, high)
            if code >> (len(self.planes) - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, number: int, before: int) -> int:
        """How often a number occurs before a place."""
        code = self._code(number)
        if code is None:
            return 0
        low, high = self._range(code, before)
        return high - low

    def select(self, number: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) occurrence; it must exist."""
        code = self._code(number)
        at = self._range(code, 0)[0] + nth
        for level in range(len(self.planes) - 1, -1, -1):
            bit = code >> (len(self.planes) - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] if bit else at)
        return at

    def to_bytes(self) -> bytes:
        head = struct.pack("<4sQII", MAGIC, self.size, len(self.alphabet), len(self.planes))
        body = np.array(self.zeros, "<u8").tobytes() + self.alphabet.astype("<u4").tobytes() + b"".join(p.tobytes() for p in self.planes)
        return head + zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, size, distinct, depth = struct.unpack_from("<4sQII", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        body = zstandard.ZstdDecompressor().decompress(data[20:])
        zeros = np.frombuffer(body, "<u8", depth).tolist()
        alphabet = np.frombuffer(body, "<u4", distinct, 8 * depth)
        at, width = 8 * depth + 4 * distinct, -(-size // 8)
        return cls(alphabet, size, zeros, [np.frombuffer(body, np.uint8, width, at + i * width) for i in range(depth)])


def _segments(path: str | None, end: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words(tokenizer_path(path), end)
        shard, no = TaskContext.get().partitionId(), 0
        ids, sizes, held, total = [], [], [], 0

        def closed() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([no], pa.int32()), pa.array([total], pa.int64()),
                 pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([matrix.to_bytes()], pa.binary())],
                names=["shard", "segment", "n_tokens", "doc_ids", "sizes", "data"])

        for part in slices(batches):
            kind = part.schema.field("doc_id").type
            found, counts = coder.encode([t or "" for t in part.column("text").to_pylist()])
            held.append(found)
            ids += part.column("doc_id").to_pylist()
            sizes += counts.tolist()
            total += len(found)
            if total >= limit:
                yield closed()
                ids, sizes, held, total, no = [], [], [], 0, no + 1
        if ids:
            yield closed()
    return run


def write_shards(docs: DataFrame, target: str, path: str | None = None, end: int = END, segment: int = SEGMENT) -> None:
    """Encodes ``docs`` (doc_id, text) and writes one Parquet file per shard below ``target``.

    Shards hold ranges of doc_id (null ids first) in ascending order, and rows in the order of doc_id within; each document
    ends with the id ``end``, null and empty texts consist of it.  Columns: shard, segment, n_tokens, doc_ids, sizes,
    data (the wavelet matrix).  An empty table gives no segments.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(path, end, segment), f"shard int, segment int, n_tokens long, doc_ids array<{kind}>, sizes array<long>, data binary"
                       ).write.option("compression", "uncompressed").parquet(target)


def read_shards(spark: SparkSession, target: str) -> DataFrame:
    """The segments, with ``start``: tokens before the segment in the whole collection."""
    segments = spark.read.parquet(target)
    # One row per shard, then per segment: the numbers of files and of megabytes, not of documents.
    shards = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    begun = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = segments.select("shard", "segment", (F.sum("n_tokens").over(W.partitionBy("shard").orderBy("segment")) - F.col("n_tokens")).alias("within"))
    starts = within.join(begun, "shard").select("shard", "segment", (F.col("within") + F.col("shard_start")).alias("start"))
    return segments.join(starts, ["shard", "segment"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1):
        row = part.to_pylist()[0]
        ids = WaveletMatrix.from_bytes(row["data"]).unpack().astype("<u4")
        sizes = np.array(row["sizes"], np.int64)
        ends = np.cumsum(sizes)
        crc = [zlib.crc32(ids[b - n:b].tobytes()) for n, b in zip(sizes.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_ids").flatten(), pa.array(ends - sizes + row["start"]), pa.array(sizes), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, unpacked from the shards."""
    segments = read_shards(spark, target)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    return segments.select("start", "doc_ids", "sizes", "data").mapInArrow(_unpacked, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def _token(number: int, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            row = part.to_pylist()[0]
            matrix = WaveletMatrix.from_bytes(row["data"])
            n = matrix.rank(number, matrix.size)
            if what == "count":
                yield pa.RecordBatch.from_arrays([pa.array([row["start"]], pa.int64()), pa.array([n], pa.int64())], names=["start", "n"])
            else:
                places = [row["start"] + matrix.select(number, i) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64())], names=["place"])
    return run


def count_token(spark: SparkSession, target: str, number: int) -> DataFrame:
    """start, n: occurrences of a token per segment, by rank on the planes."""
    return read_shards(spark, target).select("start", "data").mapInArrow(_token(number, "count"), "start long, n long")


def find_token(spark: SparkSession, target: str, number: int) -> DataFrame:
    """place: every occurrence of a token in the whole collection, by select on the planes."""
    return read_shards(spark, target).select("start", "data").mapInArrow(_token(number, "find"), "place long")


def _accessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1):
        row = part.to_pylist()[0]
        matrix = WaveletMatrix.from_bytes(row["data"])
        found = [matrix.access(p - row["start"]) for p in row["places"]]
        yield pa.RecordBatch.from_arrays([pa.array(row["places"], pa.int64()), pa.array(found, pa.int64())], names=["place", "id"])


def read_tokens(spark: SparkSession, target: str, places: list[int]) -> DataFrame:
    """place, id: the tokens at some places of the whole collection; places beyond its end give no row."""
    segments = read_shards(spark, target)
    wanted = F.array(*[F.lit(p).cast("long") for p in sorted(set(places))]) if places else F.array().cast("array<bigint>")
    own = F.filter(wanted, lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_tokens")))
    return segments.select("start", "data", own.alias("places")).filter(F.size("places") > 0).mapInArrow(_accessed, "place long, id long")


def token_files(docs: DataFrame, path: str | None = None, end: int = END, segment: int = SEGMENT) -> DataFrame:
    """Writes ``docs`` to shards in the shared folder and reads every document back from them."""
    target = work_path(docs.sparkSession, "tokens")
    write_shards(docs, target, path, end, segment)
    return read_documents(docs.sparkSession, target)
