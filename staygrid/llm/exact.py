"""Exact duplicates by composable polynomial fingerprints.

A text's bytes without white space are read as digits of a number in three prime moduli.  The number of a
concatenation follows from the numbers of its parts, ``H(ab) = H(a) * B**len(b) + H(b)``, so chunks are hashed on
their own (for huge documents in different tasks) and their hashes are combined.  Rows whose length and
fingerprint agree are compared chunk by chunk before they count as equal.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.llm.common import columns, slices
from staygrid.session import cut_lineage

#: Primes below 2**31; a byte times a power, summed over a chunk of 4096, stays below 2**53 and so exact in a double.
MODULI = (2147483647, 2147483629, 2147483587)
BASES = (1000003, 998244353, 1299709)
CHUNK = 4096
#: Documents above so many bytes are hashed by several tasks.
HUGE = 32 << 20
#: Bytes of a piece that is compared, or hashed by its own task.
PIECE = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"


def powers(moduli: tuple[int, ...]) -> np.ndarray:
    """Powers of the bases for a chunk, highest first."""
    out = np.empty((CHUNK, len(moduli)))
    for j, (p, b) in enumerate(zip(moduli, BASES)):
        x = 1
        for i in range(CHUNK - 1, -1, -1):
            out[i, j] = x
            x = x * b % p
    return out


def polynomial(data: bytes, moduli: tuple[int, ...], table: np.ndarray) -> tuple[list[int], list[int]]:
    """Hash and length shift ``B**len`` of some bytes, per modulus."""
    hashes, shifts = [0] * len(moduli), [1] * len(moduli)
    step = [pow(b, CHUNK, p) for b, p in zip(BASES, moduli)]
    a = np.frombuffer(data, np.uint8)
    whole = len(a) // CHUNK
    for at in range(0, whole, 256):
        rows = a[at * CHUNK:min(at + 256, whole) * CHUNK].reshape(-1, CHUNK).astype(np.float64) @ table
        for row in rows.astype(np.int64).tolist():
            for j, p in enumerate(moduli):
                hashes[j] = (hashes[j] * step[j] + row[j]) % p
    rest = a[whole * CHUNK:]
    if len(rest):
        tail = (rest.astype(np.float64) @ table[CHUNK - len(rest):]).astype(np.int64).tolist()
        for j, (p, b) in enumerate(zip(moduli, BASES)):
            hashes[j] = (hashes[j] * pow(b, len(rest), p) + tail[j]) % p
    for j, (p, b) in enumerate(zip(moduli, BASES)):
        shifts[j] = pow(b, len(a), p)
    return hashes, shifts


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, SPACE)


def packed(size: int, hashes: list[int]) -> bytes:
    return struct.pack(f">Q{len(hashes)}I", size, *hashes)


def _whole(moduli: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = powers(moduli)
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            chars, prints, shas = [], [], []
            for text in texts:
                data = normalised(text)
                chars.append(len(text or ""))
                prints.append(packed(len(data), polynomial(data, moduli, table)[0]))
                shas.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(chars, pa.int64()), pa.array(prints, pa.binary()), pa.array(shas, pa.string())],
                names=["doc_id", "n_chars", "print", "text_sha256"])
    return run


def _pieces(size: int):
    """Pieces of the normalised bytes; the last piece carries the digest of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            text = part.column("text")[0].as_py() or ""
            data = normalised(text)
            digest = hashlib.sha256(data).hexdigest()
            for no, at in enumerate(range(0, max(1, len(data)), size)):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array([no], pa.int64()), pa.array([len(text)], pa.int64()),
                     pa.array([len(data)], pa.int64()), pa.array([digest]), pa.array([data[at:at + size]], pa.binary())],
                    names=["doc_id", "row", "no", "n_chars", "n_bytes", "text_sha256", "piece"])
    return run


def _hashed(moduli: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = powers(moduli)
        for part in slices(batches, 16):
            both = [polynomial(x, moduli, table) for x in part.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "row", "no", "n_chars", "n_bytes", "text_sha256")),
                 pa.array([h for h, _ in both], pa.list_(pa.int64())), pa.array([s for _, s in both], pa.list_(pa.int64()))],
                names=["doc_id", "row", "no", "n_chars", "n_bytes", "text_sha256", "hashes", "shifts"])
    return run


def fingerprints(docs: DataFrame, moduli: tuple[int, ...] = MODULI, huge: int = HUGE, piece: int = PIECE) -> DataFrame:
    """doc_id, n_chars (code points), print (length and hashes), text_sha256; a row per row of ``docs``."""
    rows = columns(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    small = rows.filter(size <= huge).mapInArrow(_whole(moduli), f"doc_id {kind}, n_chars long, print binary, text_sha256 string")
    pieces = rows.filter(size > huge).withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _pieces(piece), f"doc_id {kind}, row long, no long, n_chars long, n_bytes long, text_sha256 string, piece binary")
    parts = pieces.repartition("row", "no").mapInArrow(
        _hashed(moduli), f"doc_id {kind}, row long, no long, n_chars long, n_bytes long, text_sha256 string, "
        "hashes array<long>, shifts array<long>")
    # A document's pieces: as many numbers as it has megabytes.
    ordered = F.array_sort(F.collect_list(F.struct("no", "hashes", "shifts")))
    large = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.first("n_bytes").alias("n_bytes"),
                                     F.first("text_sha256").alias("text_sha256"), ordered.alias("parts"))

    def joined(j: int, p: int):
        return F.aggregate("parts", F.lit(0).cast("long"), lambda h, x: (h * x["shifts"][j] + x["hashes"][j]) % F.lit(p).cast("long"))

    whole = [joined(j, p) for j, p in enumerate(moduli)]
    hexed = F.concat(F.lpad(F.hex("n_bytes"), 16, "0"), *(F.lpad(F.hex(h), 8, "0") for h in whole))
    return small.unionByName(large.select("doc_id", "n_chars", F.unhex(hexed).alias("print"), "text_sha256"))


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            prints, nos, chunks = [], [], []
            for mark, text in zip(part.column("print").to_pylist(), part.column("text").to_pylist()):
                data = normalised(text)
                for no, at in enumerate(range(0, len(data), size)):
                    prints.append(mark)
                    nos.append(no)
                    chunks.append(data[at:at + size])
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(nos, pa.int64()), pa.array(chunks, pa.binary())],
                                             names=["print", "no", "chunk"])
    return run


def collisions(docs: DataFrame, prints: DataFrame, chunk: int = PIECE) -> DataFrame:
    """Fingerprints that rows of different text share, found by comparing chunk after chunk.

    Equal chunks of a group meet in a map-side aggregate, so a group of any size sends one copy per task.
    """
    shared = prints.groupBy("print").count().filter("count > 1").select("print")
    ids = prints.join(shared, "print", "left_semi").select(F.col("doc_id").alias("_id"), "print").distinct()
    rows = columns(docs)
    members = rows.join(ids.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(ids["_id"])).select("print", "text")
    each = members.mapInArrow(_chunks(chunk), "print binary, no long, chunk binary").groupBy("print", "no", "chunk").agg(F.lit(1).alias("one"))
    return each.groupBy("print", "no").count().filter("count > 1").select("print").distinct()


def duplicates(docs: DataFrame, moduli: tuple[int, ...] = MODULI, huge: int = HUGE, piece: int = PIECE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Of rows whose texts are equal without white space, the one with the most code points in the original text
    stays, then the smallest doc_id (a null doc_id last); of rows that repeat a doc_id as well, one.  A null text is
    an empty one.  An empty table gives an empty result.
    """
    prints = cut_lineage(fingerprints(docs, moduli, huge, piece).withColumn("row", F.monotonically_increasing_id()))
    clash = cut_lineage(collisions(docs, prints, piece)).withColumn("clash", F.lit(True))
    # Only where different texts share a fingerprint does the digest part them; mostly none do, and the join is left out.
    marked = prints.withColumn("clash", F.lit(False)) if clash.isEmpty() else prints.join(clash, "print", "left")
    keyed = marked.withColumn("variant", F.when(F.col("clash"), F.col("text_sha256")).otherwise(F.lit("")))
    first = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("null"), "doc_id", "row"))
    # Written, so that the join below has a plain shuffle on both sides, of which Spark splits what is hot.
    groups = cut_lineage(keyed.groupBy("print", "variant").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")).filter("group_size > 1"))
    return keyed.join(groups, ["print", "variant"], "left").select(
        "doc_id", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"), "text_sha256")
