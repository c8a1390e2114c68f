"""License texts and notices in documents.

Templates are words; the winnowed hashes of their word grams form an inverted index (gram -> template, place).  A
document's winnowed grams that are in the index give candidates, each with the place where the template would
begin; a long template must be pointed to by several grams there.  A banded alignment around that diagonal then counts the
template's words that the document has, in order, and where.  Words that tell a license from its neighbours may neither be
missing nor be torn apart.  Of overlapping finds the one with the best score stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from staygrid.llm.common import columns, slices
from staygrid.llm.license_texts import TEMPLATES

GRAM, WINDOW = 3, 3
#: Words by which an alignment may leave the diagonal; share of a template's words that must be found.
BAND, COVERAGE = 6, 0.8
#: A template needs one winnowed gram in the band for each so many of its words (one at least).
WORDS_PER_HIT = 40
#: Templates are shipped to every task: so many characters at most in all.
TEMPLATE_CHARS = 4 << 20
WORD = re.compile(r"[^\W_]+")

def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Which grams are the smallest (the last of equals) of some run of WINDOW; all of fewer are one run."""
    chosen = np.zeros(len(grams), bool)
    if len(grams):
        w = min(WINDOW, len(grams))
        runs = np.lib.stride_tricks.sliding_window_view(grams, w)[:, ::-1]
        chosen[np.arange(len(runs)) + w - 1 - runs.argmin(axis=1)] = True
    return chosen


def marked(text: str) -> tuple[list[str], list[bool], list[bool]]:
    """Words of a template; which of them are required (in braces); which must follow the word before at once."""
    out: list[str] = []
    required: list[bool] = []
    follows: list[bool] = []
    for n, part in enumerate(re.split(r"[{}]", text)):
        cut = words(part)
        out += cut
        required += [n % 2 == 1] * len(cut)
        follows += [n % 2 == 1 and k > 0 for k in range(len(cut))]
    return out, required, follows


class Scanner:
    """Templates with their index."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [n for n, _ in templates]
        cut = [marked(t) for _, t in templates]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t, _, _ in cut for w in t}))}
        self.base = len(self.vocabulary) + 1
        self.templates = [np.array([self.vocabulary[w] for w in t], np.int64) for t, _, _ in cut]
        self.required = [r for _, r, _ in cut]
        self.follows = [f for _, _, f in cut]
        self.index: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for no, ids in enumerate(self.templates):
            grams = self.grams(ids)
            # Too short for a full run of grams, a document might not choose them: these are looked up everywhere.
            into, places = (self.index, np.flatnonzero(winnowed(grams))) if len(grams) >= WINDOW else (self.short, np.arange(len(grams)))
            for at in places.tolist():
                into.setdefault(int(grams[at]), []).append((no, at))
        self.keys = np.array(sorted(self.index), np.int64)
        self.short_keys = np.array(sorted(self.short), np.int64)

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Hash per gram; templates of fewer words than a gram have none.  Grams with a foreign word are the largest."""
        n = len(ids) - GRAM + 1
        if n < 1:
            return np.zeros(0, np.int64)
        known = np.ones(n, bool)
        out = np.zeros(n, np.uint64)
        for j in range(GRAM):
            part = ids[j:j + n]
            known &= part >= 0
            out = (out + part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.where(known, (out >> np.uint64(2)).astype(np.int64), np.iinfo(np.int64).max)

    def align(self, no: int, ids: np.ndarray, begin: int) -> tuple[int, int, int, int] | None:
        """(score, words found, first word, word after the last) of the best alignment near a diagonal; None if there is none.

        The score is the words found less template words missing less document words in between.
        """
        template, required, follows = self.templates[no].tolist(), self.required[no], self.follows[no]
        m, width = len(template), 2 * BAND + 1
        first = required.index(True) if any(required) else m - 1
        last = max((i for i in range(m) if required[i]), default=0)
        # What the band can reach; places outside the document hold no word.
        from_, to = max(0, begin - BAND), min(len(ids), begin + m + BAND)
        near = [-2] * (from_ - (begin - BAND)) + ids[from_:to].tolist()
        near += [-2] * (m + 2 * BAND - len(near))
        best = None
        row: list[tuple[int, int, int] | None] = [None] * width  # score, words found, first document word
        for i in range(m):
            new: list[tuple[int, int, int] | None] = [None] * width
            may_miss, may_stretch = not required[i], i + 1 == m or not follows[i + 1]
            for b in range(width):
                j, old, cell = begin + i + b - BAND, row[b], None
                if near[i + b] == template[i]:
                    if old:
                        cell = (old[0] + 1, old[1] + 1, old[2])
                    if i <= first and (cell is None or 1 - i > cell[0]):  # the first word found
                        cell = (1 - i, 1, j)
                    if cell and i >= last:
                        mark = (cell[0] - (m - 1 - i), -abs(b - BAND))  # of equals the one nearest to the diagonal
                        if best is None or mark > best[0]:
                            best = (mark, cell[1], cell[2], j + 1)
                elif old and may_miss:  # another word stands in its place
                    cell = (old[0] - 2, *old[1:])
                if may_miss and b + 1 < width and row[b + 1] and (cell is None or row[b + 1][0] - 1 > cell[0]):  # the template word is missing
                    cell = (row[b + 1][0] - 1, *row[b + 1][1:])
                if may_stretch and b and new[b - 1] and (cell is None or new[b - 1][0] - 1 > cell[0]):  # a document word in between
                    cell = (new[b - 1][0] - 1, *new[b - 1][1:])
                new[b] = cell
            row = new
        return best and (best[0][0], *best[1:])

    def scan(self, ids: np.ndarray, grams: np.ndarray, chosen: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(template, words found, first word, word after the last, score), best first where they overlap."""
        hits = set()
        for at in np.flatnonzero(chosen & np.isin(grams, self.keys)).tolist():
            hits |= {(no, at - place, place) for no, place in self.index[int(grams[at])]}
        for at in np.flatnonzero(np.isin(grams, self.short_keys)).tolist():
            hits |= {(no, at - place, place) for no, place in self.short[int(grams[at])]}
        diagonals: dict[int, list[int]] = {}
        for no, begin, _ in sorted(hits):
            diagonals.setdefault(no, []).append(begin)
        found = set()
        last: dict[int, int] = {}
        for no, begin in ((no, b) for no, begins in sorted(diagonals.items()) for b in begins):
            begins = diagonals[no]
            if bisect_right(begins, begin + BAND) - bisect_left(begins, begin - BAND) < len(self.templates[no]) // WORDS_PER_HIT:
                continue
            if no in last and begin - last[no] < min(BAND // 2 + 1, len(self.templates[no])):
                continue  # the same find: its band covers this diagonal
            last[no] = begin
            got = self.align(no, ids, begin)
            if got and got[1] >= COVERAGE * len(self.templates[no]):
                found.add((no, got[1], got[2], got[3], got[0]))
        kept: list[tuple[int, int, int, int, int]] = []
        for hit in sorted(found, key=lambda h: (-h[4], h[2], h[0])):
            if all(hit[3] <= k[2] or hit[2] >= k[3] for k in kept):
                kept.append(hit)
        return sorted(kept, key=lambda h: h[2])


@lru_cache(maxsize=1)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates)


def _scanned(templates: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = scanner(templates)
        get = tool.vocabulary.get
        for part in slices(batches):
            rows: list[tuple] = []
            for at, text in enumerate(part.column("text").to_pylist()):
                low = (text or "").lower()
                ids = np.array([get(w, -1) for w in WORD.findall(low)], np.int64)
                grams = tool.grams(ids)
                if not len(grams) or grams.min() == np.iinfo(np.int64).max:
                    continue
                hits = tool.scan(ids, grams, winnowed(grams))
                if hits:
                    spans = [m.span() for m in WORD.finditer(low)]
                    rows += [(at, tool.names[no], n / len(tool.templates[no]), n, len(tool.templates[no]), spans[a][0], spans[b - 1][1]) for no, n, a, b, _ in hits]
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(arrays[0]), *arrays[1:]],
                                             names=["doc_id", "license_id", "coverage", "n_matched", "n_words", "start", "end"])
    return run


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, license_id, coverage, n_matched, n_words, start, end: a row per license text, notice or name found.

    ``coverage`` is the share of the template's ``n_words`` words that the document has in order, at least COVERAGE; words in
    braces must all be there, in a row.  An alignment leaves its diagonal by at most BAND words, so a clause more or less makes
    another license.  The place is in characters of the text in lower case.  Of finds that overlap the best stays, of equals the
    first template.  Documents without a license, null and empty texts give no row; a repeated row gives its rows again.
    Templates of fewer than GRAM words are refused, as are more than TEMPLATE_CHARS characters of them.
    """
    templates = tuple(templates)
    if sum(len(t) for _, t in templates) > TEMPLATE_CHARS or any(len(words(t)) < GRAM for _, t in templates):
        raise ValueError("templates too large in all, or one too short")
    rows = columns(docs)
    return rows.mapInArrow(_scanned(templates), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, license_id string, coverage double, "
                           "n_matched long, n_words long, start long, end long")
