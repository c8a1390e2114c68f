"""The steps of ``similarity`` that run on the executors: whole columns of numbers at a time, which travel packed.

A shuffle row for every place of a word in a set, or for every pair of sets, costs several times the numbers in it.  So
rows carry blocks of them: sorted, as differences, byte by byte and compressed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Slots in which words are counted; a slot holds several words where there are more of them.
SLOT_BITS = 22
PIECE_BITS = 16
#: Sets of a batch, and pairs, looked at together.
ROWS = 2048
STEP = 1 << 18
#: Numbers gathered together, and pairs kept before they are dealt.
WIDE = 1 << 20
#: Rounds in which the pairs of a tile come.
ROUNDS = 16

#: Words in no more sets than that bring sets together in storage.
FEW = 4096
FAR = np.iinfo(np.int32).max

Batches = Iterator[pa.RecordBatch]


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0, each in the narrowest type."""
    out = []
    for x in columns:
        x = np.ascontiguousarray(x, np.min_scalar_type(int(x.max())) if len(x) else np.uint8)
        data = zlib.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)
        out += [struct.pack("<BI", x.itemsize, len(data)), data]
    return b"".join(out)


def unpacked(data: bytes, kind: type = np.int64) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        width, size = struct.unpack_from("<BI", data, at)
        raw = np.frombuffer(zlib.decompress(data[at + 5:at + 5 + size]), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").reshape(-1).astype(kind))
        at += 5 + size
    return out


def _slices(batches: Batches, rows: int = ROWS) -> Batches:
    """Batches of so many rows, whatever the size of those that come."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(x.num_rows for x in waiting) >= rows:
            batch = pa.concat_batches(waiting)
            whole = batch.num_rows - batch.num_rows % rows
            for at in range(0, whole, rows):
                yield batch.slice(at, rows)
            waiting = [batch.slice(whole)] if whole < batch.num_rows else []
    if sum(x.num_rows for x in waiting):
        yield pa.concat_batches(waiting)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values)"""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1 .. length - 1 for each length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _blocks(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * (len(names) - 1) + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def prefix(n: np.ndarray, least: float) -> np.ndarray:
    """So many of the rarest of n words hold one that a similar set has, too."""
    return n - np.ceil(n * least - 1e-9).astype(np.int64) + 1


def least_overlap(n: np.ndarray, least: float) -> np.ndarray:
    """Common words that sets of n words together need."""
    return np.ceil(n * (least / (1 + least)) - 1e-9).astype(np.int64)


# ------------------------------------------------------------------- counts

def level(count) -> np.ndarray:
    return np.minimum(np.floor(8 * np.log2(np.asarray(count, np.float64) + 1)), 255).astype(np.uint8)


def tallied(numbers=lambda batch: _lists(batch.column(0))[1]):
    """(piece, data): how many of the numbers, those in the arrays of the first column, fall into each slot."""
    def run(batches: Batches) -> Batches:
        seen = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in _slices(batches):
            np.add.at(seen, numbers(batch) & ((1 << SLOT_BITS) - 1), np.uint32(1))
        for piece, part in enumerate(seen.reshape(-1, 1 << PIECE_BITS)):
            if part.any():
                yield _blocks(["piece", "data"], [(piece, packed(part))])
    return run


def totals(batches: Batches) -> Batches:
    """(piece, data): the levels of the summed counts."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, data in zip(batch.column("piece").to_pylist(), batch.column("data").to_pylist()):
            part, = unpacked(data)
            sums[piece] = sums[piece] + part if piece in sums else part
    for piece, part in sums.items():
        yield _blocks(["piece", "data"], [(piece, packed(level(part)))])


def table(pieces: dict[int, bytes]) -> np.ndarray:
    out = np.zeros((1 << SLOT_BITS - PIECE_BITS, 1 << PIECE_BITS), np.uint8)
    for piece, data in pieces.items():
        out[piece] = unpacked(data, np.uint8)[0]
    return out.reshape(-1)


# ------------------------------------------------------------- sets in order

def sketches(n: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many words, given as hashes, fall on each bit, odd or even, as 64 bits a slot: the slots of all sets in a row.

    The number of slots is a power of two, so that a longer sketch folds onto a shorter one.
    """
    slots = slots_of(n)
    starts = np.cumsum(slots) - slots
    out = np.zeros(slots.sum(), np.uint64)
    words = words.astype(np.int64)
    bits = np.uint64(1) << (words & 63).astype(np.uint64)
    np.bitwise_xor.at(out, np.repeat(starts, n) + ((words >> 6) & np.repeat(slots - 1, n)), bits)
    return out


def slots_of(n: np.ndarray) -> np.ndarray:
    return 1 << np.maximum(np.ceil(np.log2(n / 32)), 0).astype(np.int64)


def in_order(pieces, least: float):
    """(_key, near, n, first, sketch) for (_key, words): the rarest words of a set, one more than its prefix, and its sketch.

    Any order that is the same in all sets does; words of equal level go by their hash.  Similar sets mostly have the same
    ``near``, the smallest hash of a word that few sets have.
    """
    def run(batches: Batches) -> Batches:
        rarity = table(pieces.value)
        for batch in _slices(batches):
            # Copies that stand together go no further.
            batch = batch.take(pa.array(np.sort(np.unique(batch.column("_key").to_numpy(zero_copy_only=False), return_index=True)[1])))
            n, words = _lists(batch.column("words"))
            rare = rarity[words & ((1 << SLOT_BITS) - 1)]
            near = np.minimum.reduceat(np.where(rare < level(FEW), words, FAR), np.cumsum(n) - n)
            near = np.where(near == FAR, words[np.cumsum(n) - n], near)
            order = np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(40)
            order |= rare.astype(np.uint64) << np.uint64(32) | words.view(np.uint32)
            order.sort()
            take = np.minimum(prefix(n, least) + 1, n)
            first = order[_ramp(n) < np.repeat(take, n)].astype(np.uint32).view(np.int32)
            slots = slots_of(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(near, pa.int32()), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), first),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(slots)]), pa.int32()), sketches(n, words).view(np.int64))],
                names=["_key", "near", "n", "first", "sketch"])
    return run


def _places(batch: pa.RecordBatch, least: float) -> tuple[np.ndarray, ...]:
    """(lengths, n, row, at, token, token before) of the words in the prefixes."""
    lengths, values = _lists(batch.column("first"))
    n = batch.column("n").to_numpy().astype(np.int64)
    token = values.view(np.uint32).astype(np.int64)
    at, row = _ramp(lengths), np.repeat(np.arange(len(n)), lengths)
    before = np.where(at > 0, np.concatenate([[0], token[:-1]])[:len(token)], 0)
    keep = at < prefix(n, least)[row]
    return lengths, n, row[keep], at[keep], token[keep], before[keep]


def prefixes(least: float):
    return lambda batch: _places(batch, least)[4]


def placed(pieces, hot: int, least: float, parts: int):
    """(part, data): the places of words that are not hot, a block for each batch and range of words."""
    def run(batches: Batches) -> Batches:
        crowd = table(pieces.value)
        for batch in _slices(batches, 2 * ROWS):
            _, n, row, at, token, before = _places(batch, least)
            order = np.flatnonzero(crowd[token & ((1 << SLOT_BITS) - 1)] < level(hot + 1))
            order = order[np.argsort(token[order], kind="stable")]
            part = token[order] * parts >> 32
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            no = batch.column("no").to_numpy()
            for block in np.split(order, cuts[1:]) if len(cuts) else []:
                rows, own = np.unique(row[block], return_inverse=True)
                data = packed(_steps(token[block]), own, at[block], before[block], no[rows], n[rows])
                yield _blocks(["part", "data"], [(int(token[block[0]] * parts >> 32), data)])
    return run


def crowded(pieces, hot: int, least: float):
    """(no, n, at, word, later): the places of words that may be hot, with the words that follow."""
    def run(batches: Batches) -> Batches:
        crowd = table(pieces.value)
        for batch in _slices(batches):
            lengths, n, row, at, token, _ = _places(batch, least)
            own = np.flatnonzero(crowd[token & ((1 << SLOT_BITS) - 1)] >= level(hot + 1))
            for own in np.array_split(own, len(own) * int(lengths.max()) // WIDE + 1) if len(own) else []:
                row_, at_ = row[own], at[own]
                size = lengths[row_] - at_ - 1
                starts = (np.cumsum(lengths) - lengths)[row_] + at_ + 1
                later = batch.column("first").flatten().to_numpy(zero_copy_only=False)[np.repeat(starts, size) + _ramp(size)]
                ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("no").take(pa.array(row_)), pa.array(n[row_], pa.int32()), pa.array(at_, pa.int32()),
                     pa.array(token[own].astype(np.uint32).view(np.int32)), pa.ListArray.from_arrays(ends, later)],
                    names=["no", "n", "at", "word", "later"])
    return run


# -------------------------------------------------------------------- pairs

class Tiles:
    """Sets are numbered below ``top`` and cut into ``blocks`` of equal width; a pair is in the tile of its two blocks."""

    def __init__(self, top: int, blocks: int):
        self.blocks, self.width = blocks, max(1, -(-top // blocks))

    def around(self, block: int) -> list[int]:
        return sorted({min(block, x) * self.blocks + max(block, x) for x in range(self.blocks)})

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a // self.width * self.blocks + b // self.width

    def dealt(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(tile, round, data) for pairs a < b, each pair once."""
        tile = self.of(a, b)
        turn = a % self.width * ROUNDS // self.width
        code = a % self.width * self.width + b % self.width
        order = np.lexsort((code, tile))
        tile, turn, code = tile[order], turn[order], code[order]
        once = np.flatnonzero((np.diff(tile, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
        tile, turn, code = tile[once], turn[once], code[once]
        cuts = np.flatnonzero((np.diff(tile) != 0) | (np.diff(turn) != 0)) + 1
        for at, part in zip([0, *cuts.tolist()], np.split(code, cuts)):
            if len(part):
                yield int(tile[at]), 1 + int(turn[at]), packed(_steps(part))

    def pairs(self, tile: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        code = np.cumsum(unpacked(data)[0])
        return tile // self.blocks * self.width + code // self.width, tile % self.blocks * self.width + code % self.width


def meeting(n: np.ndarray, at: np.ndarray, token: np.ndarray, before: np.ndarray, no: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that share a word and may be similar, by their sizes and where the word stands in them.

    Where the words before are equal as well, it is not the first common word, and the pair comes with the first one.
    """
    order = np.argsort(token << 31 | n, kind="stable")
    n, at, token, before, no = n[order], at[order], token[order], before[order], no[order]
    # The larger sets that the smaller one can still reach.
    most = np.floor(np.minimum(n / least, (n - at) * ((1 + least) / least) - n) + 1e-6).astype(np.int64)
    ends = np.searchsorted(token << 31 | n, token << 31 | np.maximum(most, 0), "right")
    left = np.maximum(ends - np.arange(len(n)) - 1, 0)
    done = np.cumsum(left)
    start = 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + STEP, "right")))
        i = np.repeat(np.arange(start, end), left[start:end])
        j = i + 1 + _ramp(left[start:end])
        near = np.minimum(n[i] - at[i], n[j] - at[j]) >= least_overlap(n[i] + n[j], least)
        near &= n[i] >= n[j] * least - 1e-9
        near &= ((before[i] != before[j]) | (at[i] == 0) | (at[j] == 0)) & (no[i] != no[j])
        i, j = no[i[near]], no[j[near]]
        if len(i):
            yield np.minimum(i, j), np.maximum(i, j)
        start = end


def met(least: float, tiles: Tiles):
    """(tile, kind, data) for blocks (part, data), sorted by part."""
    def pairs(blocks: list[bytes]) -> Batches:
        columns = []
        for data in blocks:
            step, own, at, before, no, n = unpacked(data)
            columns.append((n[own], at, np.cumsum(step), before, no[own]))
        found, size = [], 0
        for a, b in meeting(*(np.concatenate(c) for c in zip(*columns)), least):
            found.append((a, b))
            size += len(a)
            if size > WIDE:
                yield _blocks(["tile", "kind", "data"], [*tiles.dealt(*map(np.concatenate, zip(*found)))])
                found, size = [], 0
        if found:
            yield _blocks(["tile", "kind", "data"], [*tiles.dealt(*map(np.concatenate, zip(*found)))])

    def run(batches: Batches) -> Batches:
        part, blocks = None, []
        for batch in batches:
            for p, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist()):
                if p != part and blocks:
                    yield from pairs(blocks)
                    blocks = []
                part = p
                blocks.append(data)
        if blocks:
            yield from pairs(blocks)
    return run


def listed(tiles: Tiles):
    """(tile, kind, data) for rows (a, b)."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                yield _blocks(["tile", "kind", "data"], [*tiles.dealt(batch.column("a").to_numpy(), batch.column("b").to_numpy())])
    return run


def dealt_again(old: Tiles, new: Tiles):
    """(tile, kind, data) for blocks (tile, data) of other tiles."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for tile, data in zip(batch.column("tile").to_pylist(), batch.column("data").to_pylist()):
                yield _blocks(["tile", "kind", "data"], [*new.dealt(*old.pairs(tile, data))])
    return run


def in_pairs(old: Tiles, new: Tiles):
    """(tile, no): for blocks (tile, data) of pairs, the sets that the new tiles need."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for tile, data in zip(batch.column("tile").to_pylist(), batch.column("data").to_pylist()):
                a, b = old.pairs(tile, data)
                both = np.unique(np.stack([np.tile(new.of(a, b), 2), np.concatenate([a, b])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0], pa.int32()), pa.array(both[1], pa.int64())], names=["tile", "no"])
    return run


# ----------------------------------------------------- sketches of two blocks

def sketched(tiles: Tiles):
    """(tile, kind, data) for (no, n, sketch): the sketches of a block, for each tile of it."""
    def run(batches: Batches) -> Batches:
        for batch in _slices(batches):
            slots, bits = _lists(batch.column("sketch"))
            no, n = batch.column("no").to_numpy(), batch.column("n").to_numpy()
            block = no // tiles.width
            for one in np.unique(block):
                own = block == one
                data = packed(no[own] - one * tiles.width, n[own], bits[np.repeat(own, slots)].view(np.uint64))
                yield _blocks(["tile", "kind", "data"], [(t, -1 - int(one), data) for t in tiles.around(int(one))])
    return run


def flips(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Bits in which sketches, one in a row, differ; the longer ones are folded."""
    if one.shape[1] < other.shape[1]:
        one, other = other, one
    folded = np.bitwise_xor.reduce(one.reshape(len(one), -1, other.shape[1]), axis=1)
    return np.bitwise_count(folded ^ other).sum(axis=1, dtype=np.int64)


class _Sketches:
    def __init__(self, tiles: Tiles, tile: int):
        self.tiles, self.tile, self.parts = tiles, tile, []

    def add(self, block: int, data: bytes) -> None:
        no, n, bits = unpacked(data, np.uint64)
        self.parts.append((no.astype(np.int64) + block * self.tiles.width, n.astype(np.int64), bits))

    def ready(self) -> None:
        no, self.n, self.bits = (np.concatenate(x) for x in zip(*self.parts))
        slots = slots_of(self.n)
        starts = np.cumsum(slots) - slots
        order = np.argsort(no)
        self.no, self.n, self.slots, self.starts = no[order], self.n[order], slots[order], starts[order]

    def similar(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Whether their sketches let the pairs be similar."""
        i, j = np.searchsorted(self.no, a), np.searchsorted(self.no, b)
        both = self.n[i] + self.n[j]
        apart = both - 2 * least_overlap(both, least)
        out = np.zeros(len(a), bool)
        shape = self.slots[i] << 32 | self.slots[j]
        for one in np.unique(shape):
            x, y = int(one >> 32), int(one & 0xFFFFFFFF)
            own = np.flatnonzero(shape == one)
            for part in np.array_split(own, len(own) * max(x, y) // WIDE + 1):
                left = self.bits[self.starts[i[part]][:, None] + np.arange(x)]
                right = self.bits[self.starts[j[part]][:, None] + np.arange(y)]
                out[part] = flips(left, right) <= apart[part]
        return out


def close(least: float, tiles: Tiles):
    """(tile, data): pairs that pass by their sketches, each once, from rows (tile, kind, data) sorted by tile and kind."""
    def run(batches: Batches) -> Batches:
        sets, now, waiting, kept = None, None, [], []

        def weigh() -> None:
            if waiting:
                a, b = (np.concatenate(x) for x in zip(*waiting))
                good = sets.similar(a, b, least)
                kept.append((a[good], b[good]))
                waiting.clear()

        def ended() -> Batches:
            weigh()
            if kept:
                rows = [(t, data) for t, _, data in tiles.dealt(*(np.concatenate(x) for x in zip(*kept)))]
                kept.clear()
                if rows:
                    yield _blocks(["tile", "data"], rows)

        for batch in batches:
            for tile, kind, data in zip(*(batch.column(c).to_pylist() for c in ("tile", "kind", "data"))):
                if (tile, kind) != now:
                    yield from ended()
                    now = tile, kind
                if sets is None or tile != sets.tile:
                    sets = _Sketches(tiles, tile)
                if kind < 0:
                    sets.add(-1 - kind, data)
                    continue
                if sets.parts:
                    sets.ready()
                    sets.parts = []
                waiting.append(tiles.pairs(tile, data))
                if sum(len(a) for a, _ in waiting) > STEP:
                    weigh()
        yield from ended()
    return run


# ------------------------------------------------------- words of two blocks

class _Words:
    def __init__(self, tile: int):
        self.tile, self.rows, self.no = tile, [], None

    def add(self, no: pa.Array, names: pa.Array, words: pa.ListArray) -> None:
        """Copies, so that a slice does not keep its batch."""
        self.rows.append((no.to_numpy().copy(), np.diff(words.offsets.to_numpy()), names.take(pa.array(np.arange(len(names)))), words.flatten().dictionary_encode()))

    def ready(self) -> None:
        no, n, names, words = zip(*self.rows)
        no, n, self.names = np.concatenate(no), np.concatenate(n), pa.concat_arrays(names)
        words = pa.chunked_array(words).unify_dictionaries()
        self.ids = np.concatenate([x.indices.to_numpy() for x in words.chunks])
        self.top = len(words.chunk(0).dictionary)
        self.order = np.argsort(no)
        self.no, self.n, self.starts = no[self.order], n[self.order], (np.cumsum(n) - n)[self.order]
        self.rows = []

    def common(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of a, place of b, common words), for pairs sorted by a; sets that are not there have no pairs."""
        there = np.isin(a, self.no) & np.isin(b, self.no)
        i, j = np.searchsorted(self.no, a[there]), np.searchsorted(self.no, b[there])
        out = np.zeros(len(i), np.int64)
        mark = np.zeros(self.top, bool)
        for own in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
            x = i[own[0]]
            mine = self.ids[self.starts[x]:self.starts[x] + self.n[x]]
            mark[mine] = True
            for part in np.array_split(own, int(self.n[j[own]].sum()) // WIDE + 1):
                if len(part):
                    size = self.n[j[part]]
                    hits = mark[self.ids[np.repeat(self.starts[j[part]], size) + _ramp(size)]]
                    out[part] = np.add.reduceat(hits, np.cumsum(size) - size, dtype=np.int64)
            mark[mine] = False
        return i, j, out


def scored(least: float, tiles: Tiles):
    """(a, b, similarity) by class, from rows (tile, kind, no, class_id, words, data) sorted by tile and kind."""
    def run(batches: Batches) -> Batches:
        sets = None
        for batch in _slices(batches):
            tile, kind = batch.column("tile").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(tile) != 0) | (np.diff(kind) != 0)) + 1
            for own in np.split(np.arange(batch.num_rows), edges):
                if not len(own):
                    continue
                if sets is None or sets.tile != tile[own[0]]:
                    sets = _Words(int(tile[own[0]]))
                rows = batch.slice(int(own[0]), len(own))
                if kind[own[0]] == 0:
                    sets.add(rows.column("no"), rows.column("class_id"), rows.column("words"))
                    continue
                if sets.rows:
                    sets.ready()
                if sets.no is None:
                    continue
                for data in rows.column("data").to_pylist():
                    a, b = tiles.pairs(sets.tile, data)
                    i, j, k = sets.common(a, b)
                    score = k / (sets.n[i] + sets.n[j] - k)
                    good = score >= least
                    names = [sets.names.take(pa.array(sets.order[x[good]])) for x in (i, j)]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(score[good])], names=["a", "b", "similarity"])
    return run
