"""Language identification by cross-parsing.

For each language a suffix automaton of a bounded sample of labelled text answers "how far does the text go on as
somewhere in the sample".  A text is cut greedily into longest such phrases; the language that needs the fewest,
normalised by the sample's size and the text's length (bits per letter), wins.  A letter that the sample lacks costs
the bits of a phrase in the largest sample, so a small sample is not cheap for texts it says nothing about.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staygrid.llm.common import slices
from staygrid.session import cut_lineage

#: Letters of labelled text that a language is learned from, and rows they are taken from at most.
SAMPLE, SAMPLE_ROWS = 32768, 64
#: Letters whose transitions are in a full table; those of rarer ones are in a sorted list.
LETTERS = 94
#: Long texts are parsed in pieces of so many symbols; a phrase ends with its piece.
PIECE = 1024
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 modulo 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def folded(text: str) -> str:
    """Letters in lower case, runs of anything else as one blank, combining marks left out."""
    out = "".join(c if c.isalpha() else "" if unicodedata.category(c)[0] == "M" else " " for c in text.lower())
    return " ".join(out.split())


def learn(docs: DataFrame, sample: int = SAMPLE, rows: int = SAMPLE_ROWS) -> dict[str, str]:
    """language -> folded sample text, from documents that are not held out.

    Bounded: per language at most ``rows`` rows, in the order of a hash of their id, and of these the first ``sample``
    letters; of a row at most its first ``4 * sample`` characters come to the driver.  A row that repeats language, id
    and text counts once.  Rows without id, language or a letter are not learned from, and take no place.

    No task ranks a whole language: with n ids, only rows whose hash lies in the first 8 ``rows`` / n of all hashes do.
    """
    # Code points that Java does not know may be letters to Python.
    docs = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"[\p{L}\p{Cn}]"))
    place = F.xxhash64("doc_id")
    # Stored, so that its size is known before the join is planned: a few rows are not worth moving the texts for.
    sizes = cut_lineage(docs.groupBy(F.col("lang").alias("_lang")).agg(F.approx_count_distinct("doc_id").alias("_ids")))
    first = docs.join(sizes, docs["lang"] == sizes["_lang"]).filter((place / 2.0 ** 64 + 0.5) * F.col("_ids") <= 8 * rows)
    keyed = first.select("lang", "doc_id", place.alias("place"), F.xxhash64("text").alias("digest"), F.substring("text", 1, 4 * sample).alias("text"))
    order = W.partitionBy("lang").orderBy("place", "doc_id", "digest")
    texts = keyed.dropDuplicates(["lang", "doc_id", "digest"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows).collect()
    out: dict[str, str] = {}
    for r in sorted(texts, key=lambda r: (r.lang, r["rank"])):
        have = out.get(r.lang, "")
        if len(have) < sample:
            out[r.lang] = (have + " " + folded(r.text)).strip()[:sample]
    return {k: v for k, v in out.items() if v.strip()}


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class Parser:
    """Counts phrases of many texts at once, all languages side by side.

    A table entry is ``next row << 2 | phrases that end``: a symbol that a phrase can't go on with ends it and starts
    the next one; a symbol the sample lacks is a phrase of its own.  Every letter of any sample has its own symbol; the
    one symbol ``width - 1`` stands for letters that are in no sample.  Symbols from ``width`` on, of the letters beyond
    the LETTERS most common ones, go by ``rare`` (sorted ``row << 32 | symbol``, with an entry each).
    """

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        count = Counter("".join(samples.values()))
        count.pop(" ", None)
        letters = sorted(count, key=lambda c: (-count[c], c))
        self.width = min(len(letters), LETTERS) + 2
        symbol = {c: i + 1 + (i >= LETTERS) for i, c in enumerate(letters)} | {" ": 0}
        total = len(letters) + 2
        kind = np.min_scalar_type(total)
        self.skip = int(np.iinfo(kind).max)
        self.symbols = np.zeros(0x110000, kind)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                self.symbols[c] = symbol.get(x, self.width - 1)
            elif unicodedata.category(x)[0] == "M":
                self.symbols[c] = self.skip
        tables, self.roots, base, keys, entries = [], [], 0, [], []
        #: Where a rare symbol leads that a phrase can't go on with.
        self.restart = np.zeros((len(self.names), total - self.width), np.int64)
        for k, name in enumerate(self.names):
            moves = automaton([symbol[c] for c in samples[name]])
            at = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
            by = np.fromiter((c for m in moves for c in m), np.int64, len(at))
            to = (np.fromiter((to for m in moves for to in m.values()), np.int64, len(at)) + base) * self.width << 2
            full = by < self.width
            start = np.full(total, base * self.width << 2 | 2, np.int64)
            start[by[at == 0]] = to[at == 0] | 1
            table = np.tile(start[:self.width], (len(moves), 1))
            table[0] -= 1
            table[at[full], by[full]] = to[full]
            tables.append(table)
            self.restart[k] = start[self.width:]
            keys.append(((at[~full] + base) * self.width << 32) + by[~full])
            entries.append(to[~full])
            self.roots.append(base * self.width)
            base += len(moves)
        flat = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int64)
        self.table = flat.astype(np.int32) if not len(flat) or flat.max() < 1 << 31 else flat
        rare = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(rare)
        self.rare, self.entries = rare[order], np.concatenate(entries)[order] if keys else rare
        self.bits = np.log2([max(2, len(samples[n])) for n in self.names])
        self.lacks = np.ones((len(self.names), total), bool)
        for k, name in enumerate(self.names):
            self.lacks[k, [symbol[c] for c in set(samples[name])]] = False

    def fold(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, where each text's begin (and the last's end), and letters per text."""
        low = [t.lower() for t in texts]
        ends = np.cumsum([len(t) for t in low])
        s = self.symbols[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")]
        letter = (s != 0) & (s != self.skip)
        place = np.concatenate(([0], ends))
        letters = np.diff(np.concatenate(([0], np.cumsum(letter)))[place])
        marks = s != self.skip
        kept = np.concatenate(([0], np.cumsum(marks)))[place]
        s = s[marks]
        # One blank of a run stays.
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        keep[kept[:-1][kept[:-1] < len(s)]] = True
        return s[keep], np.concatenate(([0], np.cumsum(keep)))[kept], letters

    def look_up(self, state: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Entries per language and piece, for the state and the symbol of each."""
        far = np.flatnonzero(s >= self.width)
        if not len(far):
            return self.table[state + s]
        near = s.copy()
        near[far] = 0
        found = self.table[state + near]
        at, by = state[:, far].astype(np.int64), s[far].astype(np.int64)
        wanted = (at << 32) + by
        place = np.minimum(np.searchsorted(self.rare, wanted), len(self.rare) - 1)
        # At the start no phrase ends.
        again = self.restart[:, by - self.width] - (at == np.array(self.roots)[:, None])
        found[:, far] = np.where(self.rare[place] == wanted, self.entries[place], again)
        return found

    def phrases(self, s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases per language and text."""
        sizes = np.diff(bounds)
        parts = -(-sizes // PIECE)
        text = np.repeat(np.arange(len(sizes)), parts)
        no = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = bounds[:-1][text] + no * PIECE
        length = np.minimum(sizes[text] - no * PIECE, PIECE)
        order = np.argsort(-length, kind="stable")
        start, length, text = start[order], length[order], text[order]
        state = np.repeat(np.array(self.roots, self.table.dtype)[:, None], len(start), axis=1)
        count = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        for t, m in enumerate(active.tolist()):
            found = self.look_up(state[:, :m], s[start[:m] + t])
            count[:, :m] += found & 3
            state[:, :m] = found >> 2
        count += state != np.array(self.roots)[:, None]
        out = np.zeros((len(self.names), len(sizes)))
        for k in range(len(self.names)):
            out[k] = np.bincount(text, weights=count[k], minlength=len(sizes))
        return out

    def literals(self, s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Symbols that the sample lacks, per language and text."""
        out = np.zeros((len(self.names), len(bounds) - 1))
        for k, lacks in enumerate(self.lacks):
            out[k] = np.bincount(np.searchsorted(bounds, np.flatnonzero(lacks[s]), side="right") - 1, minlength=len(bounds) - 1)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        s, bounds, letters = self.fold([t or "" for t in texts])
        if not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        alone = self.literals(s, bounds)
        cost = ((self.phrases(s, bounds) - alone) * self.bits[:, None] + alone * self.bits.max()) / np.maximum(np.diff(bounds), 1)
        ranked = np.argsort(cost, axis=0, kind="stable")  # ties: the first name
        best = np.take_along_axis(cost, ranked[:1], 0)[0]
        second = np.take_along_axis(cost, ranked[1:2], 0)[0] if len(self.names) > 1 else np.full(len(texts), np.inf)
        score = np.where(np.isinf(second), 1.0, second / np.maximum(best + second, 1e-300))
        return ([self.names[r] if n else UNKNOWN for r, n in zip(ranked[0].tolist(), letters.tolist())],
                [float(x) if n else 0.0 for x, n in zip(score, letters.tolist())])


@lru_cache(maxsize=1)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(samples))


def _predicted(samples: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        for part in slices(batches, 512):
            names, scores = parser.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, sample: int = SAMPLE, rows: int = SAMPLE_ROWS, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs`` (doc_id, text, lang).

    ``lang_pred`` is a learned language, of ties the first by name, or ``und`` (score 0) where the text is null or has
    no letter, or no language could be learned.  ``score`` is the runner-up's share of the bits of the best two, 0.5
    for a tie; 1 if there is one language only.  A text of more than ``PIECE`` symbols is parsed in pieces of that many,
    and a phrase ends with its piece, in every language alike.  An empty table gives an empty result.  Languages are learned from
    ``labelled`` (doc_id, text, lang) if given; then ``docs`` needs no lang.
    """
    known = docs if labelled is None else labelled
    known = known.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    samples = tuple(sorted(learn(known, sample, rows).items()))
    rows_in = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows_in.schema["doc_id"].dataType.simpleString()
    return rows_in.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        _predicted(samples), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def remainder(doc_id: object) -> int:
    """The rule of ``held_out`` for one id."""
    return zlib.crc32(str(doc_id).encode()) % 4
