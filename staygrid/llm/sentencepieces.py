"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text becomes marked words (a run of word marks and the characters up to the next).  The distinct words of a batch
are sorted, which lays them out as the depth-first walk of their trie: of each word only the characters after the
prefix it shares with the word before are scored, the rest of the forward scores is still on the stack.

Scores are those of the model file, and the best sum wins; of equal sums the longest last piece.  A merge model
(BPE) read this way gives its best-scoring segmentation, which is not always the one its merges would give.
Characters without a piece become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.llm import chunks
from staygrid.llm.chunks import Chunks, Clash, spread
from staygrid.llm.common import slices

MARK = "▁"
#: What a character without a piece costs beyond the worst piece.
PENALTY = 10
#: Distinct words that a worker remembers; it starts anew beyond.
REMEMBERED = 300_000


def model_path(path: str | None) -> str:
    """Where the model file is on this machine; by default the public one, which every node has installed."""
    if path is None:
        import public_tokenizers
        return public_tokenizers.path("piece_bpe_32k.model")
    return path


class Model(Chunks):
    """Pieces of a SentencePiece model file, and the words encoded so far.

    Words are found and looked up for a whole batch of texts at once; only those not met before are walked.
    """

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.byte = [-1] * 256
        self.text: list[bytes] = [b""] * size
        self.score: list[float] = [0.0] * size
        self.root: dict = {}
        plain = []
        for i in range(size):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value] = i
                self.text[i] = bytes([value])
            elif not lib.is_control(i) and not lib.is_unknown(i) and not lib.is_unused(i):
                plain.append(piece)
                self.score[i] = lib.get_score(i)
                self.text[i] = piece.replace(MARK, " ").encode()
                node = self.root
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = i
        self.unknown = lib.unk_id()
        self.text[self.unknown] = " ⁇ ".encode()
        self.missing = min((self.score[i] for i in range(size)), default=0.0) - PENALTY
        # Words may be cut where no piece can cross.
        crossing = any(MARK in p.lstrip(MARK) for p in plain)
        breaks = "" if any("\n" in p for p in plain) else "\n"
        self.pattern = re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+" + (f"|{breaks}" if breaks else "")) if not crossing else re.compile("(?s).+")
        self.batched = bool(breaks) and not crossing  # a line break parts texts as well
        super().__init__(0, REMEMBERED)

    def unknown_ids(self, char: str) -> list[int]:
        ids = [self.byte[b] for b in char.encode()]
        return ids if min(ids) >= 0 else [self.unknown]

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Best pieces of sorted distinct words, depth first."""
        root, score, missing = self.root, self.score, self.missing
        best: list[float] = [0.0]      # forward score after so many characters
        back: list[tuple[int, int]] = [(0, -1)]  # where the last piece begins, and its id
        open_: list[list[tuple[int, dict]]] = [[]]  # pieces begun and not ended: start, place in the trie of pieces
        before = ""
        for word in words:
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], back[shared + 1:], open_[shared + 1:]
            for i in range(shared, len(word)):
                c = word[i]
                alive, top, last = [], None, (i, -1)
                for start, node in open_[i]:
                    node = node.get(c)
                    if node is not None:
                        alive.append((start, node))
                        piece = node.get("")
                        if piece is not None and (top is None or best[start] + score[piece] > top):
                            top, last = best[start] + score[piece], (start, piece)
                node = root.get(c)
                piece = None
                if node is not None:
                    alive.append((i, node))
                    piece = node.get("")
                own = best[i] + (missing if piece is None else score[piece])
                if top is None or own > top:
                    top, last = own, (i, -1 if piece is None else piece)
                best.append(top)
                back.append(last)
                open_.append(alive)
            before = word
            ids: list[int] = []
            at = len(word)
            while at:
                start, piece = back[at]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids.extend(reversed(self.unknown_ids(word[start])))
                at = start
            ids.reverse()
            yield word, ids

    def cut(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.frombuffer(raw, np.uint8)
        space, line = a == 32, a == 10
        border = np.ones(len(a) + 1, bool)
        border[1:-1] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        cuts = np.flatnonzero(border)
        return cuts[:-1], cuts[1:], a

    def ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = [c.replace(" ", MARK) for c in chunks]
        ids = dict(self.walk(sorted(set(marked))))
        return np.array([i for w in marked for i in ids[w]], np.uint32), np.array([len(ids[w]) for w in marked], np.int64)

    def _alone(self, text: str) -> bytes:
        """One text, its words in a row; where texts are encoded in batches, words are cut as there."""
        if not text:
            return b""
        if self.batched:
            raw = ("\n " + text).encode()
            starts, ends, _ = self.cut(raw)
            words = [raw[a:b].decode().replace(" ", MARK) for a, b in zip(starts[1:].tolist(), ends[1:].tolist())]
        else:
            words = self.pattern.findall(MARK + text.replace(" ", MARK))
        ids = dict(self.walk(sorted(set(words))))
        return np.array([i for w in words for i in ids[w]], "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if not self.batched:
            return [self._alone(t) for t in texts]
        # A line break of its own stands before each text, then the mark that every text begins with.
        data = [b"\n " + t.encode() if t else b"\n" for t in texts]
        out: list[bytes] = []
        while len(out) < len(data):
            at = stop = len(out)
            size = 0
            while stop < len(data) and size + len(data[stop]) < chunks.STRETCH:
                size += len(data[stop])
                stop += 1
            try:
                if stop == at:
                    raise Clash  # longer than a stretch
                starts, places, sizes = self.stretch(b"".join(data[at:stop]))
            except Clash:
                stop = max(stop, at + 1)
                out += [self._alone(t) for t in texts[at:stop]]
                continue
            breaks = np.searchsorted(starts, np.cumsum([0, *(len(d) for d in data[at:stop - 1])]))
            sizes = sizes.copy()
            sizes[breaks] = 0
            ids = self.pool[spread(places, sizes)].astype("<i4").tobytes()
            ends = np.concatenate(([0], np.cumsum(sizes))) * 4
            edges = ends[np.append(breaks, len(sizes))].tolist()
            out += [ids[a:b] for a, b in zip(edges, edges[1:])]
        return out

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def _encoded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path(path))
        for part in slices(batches):
            found = model.encode([t or "" for t in part.column("text").to_pylist()])
            ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, "ids"])
    return run


def _decoded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path(path))
        for part in slices(batches):
            ids = part.column("ids")
            flat, ends = ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())))
            texts = [model.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])
    return run


def _key_and_text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, ids (array of int): one row per row of ``docs``.

    No ids for a null or empty text.  An empty table gives an empty result.
    """
    rows = _key_and_text(docs)
    return rows.mapInArrow(_encoded(path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` (doc_id, text, ids) and the text that the ids spell, empty for none.

    Equal to the text but for word marks in it, which come back as blanks, and invalid byte sequences.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "ids").mapInArrow(_decoded(path), f"doc_id {kind}, text string, ids array<int>, decoded string")


def _tried(path: str | None):
    """Encoding and decoding in one pass: the worker that has the text compares it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path(path))
        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            found = model.encode(texts)
            decoded = [model.decode(np.frombuffer(x, "<i4")) for x in found]
            ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in found], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4"))),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()), pa.array([a == b for a, b in zip(texts, decoded)], pa.bool_())],
                names=["doc_id", "n_tokens", "ids", "decoded_sha256", "exact"])
    return run


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256, exact: every text encoded, its ids decoded, and the result compared with it.

    One row per row of ``docs``, repeated ones too.  Null and empty texts have no ids and are exact; texts with word marks
    (U+2581) in them are not.  An empty table gives an empty result; other columns are not read.
    """
    rows = _key_and_text(docs)
    return rows.mapInArrow(_tried(path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, decoded_sha256 string, exact boolean")
