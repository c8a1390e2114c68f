"""Token counts of the sections of a document, by character spans.

A document is encoded once, as a whole.  Every token's span comes from the bytes it stands for, and is joined to the
interval of each section it touches.  A token that crosses a border goes, by rule, to

``majority``  the section with most of its bytes, of equals the first (the default);
``start``     the section where it begins;
``share``     every section it touches, by its share of the token's bytes (counts are then fractions).

Tokens outside all sections count for none; tokens partly outside are treated as if the rest were a section of its own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.llm.common import columns, slices

RULES = ("majority", "start", "share")
OUT = "section int, kind string, start int, end int, n_tokens double, n_crossing long"


def ranks_path(path: str | None) -> str:
    """Where the rank file is on this machine; by default the public one, which every node has installed."""
    if path is None:
        import public_tokenizers
        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    return path


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """(encoder, bytes per id) of a file of byte-pair ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        sizes[rank] = len(piece)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def lines(data: bytes, chars: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Byte intervals of the lines of a text, each with the line break that ends it."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    return np.concatenate(([0], ends[:-1])), ends


def pages(data: bytes, chars: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte intervals of ``width`` characters each, the last one shorter."""
    borders = np.arange(0, len(data), width) if chars is None else np.flatnonzero(np.diff(chars))[::width]
    return borders, np.append(borders[1:], len(data))


def allocate(cuts: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens per section, of tokens that end at ``cuts``; sections are disjoint and sorted."""
    begins = np.concatenate(([0], cuts[:-1]))
    # Borders of sections and of the gaps between them, and whose section each interval is (-1: a gap).
    borders = np.column_stack((starts, ends)).ravel()
    first = np.searchsorted(borders, begins, side="right")
    last = np.searchsorted(borders, cuts - 1, side="right")
    # Empty intervals (a section that begins where the last one ends leaves an empty gap) are never looked up.
    inside = (first == last) & (first % 2 == 1)
    counts = np.bincount(first[inside] // 2, minlength=len(starts)).astype(np.float64)
    crossing = np.zeros(len(starts), np.int64)
    for t in np.flatnonzero(first != last).tolist():
        a, b = int(begins[t]), int(cuts[t])
        edges = [a, *borders[first[t]:last[t]].tolist(), b]
        parts = [(int(first[t]) + i, y - x) for i, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
        held = [(i // 2, n) for i, n in parts if i % 2]
        for s, _ in held:
            crossing[s] += len(parts) > 1
        if rule == "share":
            for s, n in held:
                counts[s] += n / (b - a)
        else:
            i = parts[0][0] if rule == "start" else max(parts, key=lambda p: (p[1], -p[0]))[0]
            if i % 2:
                counts[i // 2] += 1
    return counts, crossing


def _char_offsets(data: bytes) -> np.ndarray | None:
    """Characters before each byte; None where bytes are characters."""
    if data.isascii():
        return None
    return np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))


def _counted(path: str | None, rule: str, kind: str, cut=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = tokenizer(ranks_path(path))
        for part in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            source = []
            layers = part.column("sections").to_pylist() if cut is None else [None] * part.num_rows
            for row, (text, own) in enumerate(zip(part.column("text").to_pylist(), layers)):
                data = (text or "").encode()
                chars = _char_offsets(data)
                cuts = np.cumsum(sizes[coder.encode_to_numpy(text or "", disallowed_special=())])
                if cut is not None:
                    if not data:
                        continue
                    starts, ends = cut(data, chars)
                    numbers, kinds = range(len(starts)), [kind] * len(starts)
                else:
                    size = len(data) if chars is None else int(chars[-1])
                    place = np.arange(size + 1) if chars is None else np.append(np.flatnonzero(np.diff(chars)), len(data))
                    spans = sorted((min(max(s["start"], 0), size), min(max(s["end"], 0), size), s["section"], s["kind"]) for s in own
                                   if s["start"] is not None and s["end"] is not None)
                    spans = [s for s in spans if s[0] < s[1]]
                    if any(a[1] > b[0] for a, b in zip(spans, spans[1:])):
                        raise ValueError("sections of one layer overlap")
                    starts, ends = (place[np.array([s[i] for s in spans], np.int64)] for i in (0, 1))
                    numbers, kinds = [s[2] for s in spans], [s[3] for s in spans]
                counts, crossing = allocate(cuts, starts, ends, rule) if len(starts) else (np.zeros(0), np.zeros(0, np.int64))
                source += [row] * len(starts)
                out[0] += numbers
                out[1] += kinds
                out[2] += (starts if chars is None else chars[starts]).tolist()
                out[3] += (ends if chars is None else chars[ends]).tolist()
                out[4] += counts.tolist()
                out[5] += crossing.tolist()
            kinds_ = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(source, pa.int64())), *(pa.array(v, k) for v, k in zip(out, kinds_))],
                names=["doc_id", "section", "kind", "start", "end", "n_tokens", "n_crossing"])
    return run


def _own_sections(docs: DataFrame, rule: str, path: str | None, kind: str, cut) -> DataFrame:
    if rule not in RULES:
        raise ValueError(rule)
    rows = columns(docs)
    return rows.mapInArrow(_counted(path, rule, kind, cut), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {OUT}")


def line_tokens(docs: DataFrame, rule: str = "majority", path: str | None = None) -> DataFrame:
    """doc_id, section, kind, start, end, n_tokens, n_crossing: a row per line of each text.

    Lines are numbered from 0, keep their line break, and give their place in characters.  ``n_crossing`` counts
    the tokens that touch the line and something else.  Texts that are null or empty have no lines.
    """
    return _own_sections(docs, rule, path, "line", lines)


def page_tokens(docs: DataFrame, width: int = 1000, rule: str = "majority", path: str | None = None) -> DataFrame:
    """The same for sections of ``width`` characters, whose borders mostly cut through words."""
    return _own_sections(docs, rule, path, "page", lambda data, chars: pages(data, chars, width))


def section_tokens(docs: DataFrame, sections: DataFrame, rule: str = "majority", path: str | None = None) -> DataFrame:
    """The same for given sections (doc_id, section, kind, start, end in characters, end exclusive).

    Sections of a document must not overlap (fields of one layer); places beyond the text are cut off, empty sections and
    those without a place give no row.  The sections of one document meet in its row.
    """
    if rule not in RULES:
        raise ValueError(rule)
    rows = columns(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    own = sections.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct(
        F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("section").cast("int").alias("section"),
        F.col("kind").cast("string").alias("kind"))).alias("sections"))
    joined = rows.join(own, rows["doc_id"].eqNullSafe(own["_id"])).drop("_id")
    return joined.mapInArrow(_counted(path, rule, ""), f"doc_id {kind}, {OUT}")
