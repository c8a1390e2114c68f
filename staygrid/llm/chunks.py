"""Texts as chunks that recur: each distinct one is worked out once, a whole batch is looked up at once."""

from __future__ import annotations

import numpy as np

#: Bytes of text that are cut and hashed at a time.
STRETCH = 1 << 20


class Clash(Exception):
    """Two chunks with one hash."""


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Chunks:
    """Ids of distinct chunks, found by two 64-bit hashes of their bytes.

    Subclasses say where a text is cut (``cut``) and what ids chunks have (``ids_of``).  ``end`` is an id that stands
    first in the pool, for the end of a document.  Beyond ``remembered`` chunks it starts anew.
    """

    #: Two odd bases of rolling hashes modulo 2**64.
    BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def __init__(self, end: int, remembered: int):
        self.powers = [self._powers(b) for b in self.BASES]
        self.inverse = [self._powers(pow(b, -1, 1 << 64)) for b in self.BASES]
        self.end, self.remembered = end, remembered
        self._forget()

    def cut(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the chunks, and the bytes they are made of."""
        raise NotImplementedError

    def ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks in a row, and how many each has."""
        raise NotImplementedError

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out, have = np.ones(STRETCH, np.uint64), 1
        while have < STRETCH:
            out[have:2 * have] = out[:have] * np.uint64(pow(base, have, 1 << 64))
            have *= 2
        return out

    def _forget(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.full(1 << 16, self.end, np.uint32), 1  # the first is the end of a document

    def _learn(self, keys: np.ndarray, checks: np.ndarray, chunks: list[str]) -> None:
        ids, sizes = self.ids_of(chunks)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used:self.used + len(ids)] = ids
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.checks, self.at, self.size = (np.insert(a, where, b) for a, b in (
            (self.keys, keys), (self.checks, checks), (self.at, at), (self.size, sizes)))

    def _slots(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Where chunks are known, -1 elsewhere."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), at, -1)

    def stretch(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of each chunk of less than STRETCH bytes of text, and where its ids are in the pool, and how many."""
        starts, ends, low = self.cut(raw)
        if not len(starts):
            return starts, starts, starts
        hashes = []
        for powers, inverse in zip(self.powers, self.inverse):
            sums = np.zeros(len(low) + 1, np.uint64)
            np.cumsum(low * powers[:len(low)], out=sums[1:])
            hashes.append((sums[ends] - sums[starts]) * inverse[starts])
        key = hashes[0] ^ (hashes[0] >> np.uint64(32)) ^ ((ends - starts).astype(np.uint64) << np.uint64(40))
        order = np.argsort(key)
        ranked, check = key[order], hashes[1]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(first) - 1
        one = order[first]
        if (check != check[one][group]).any():
            raise Clash
        slots = self._slots(key[one], check[one])
        new = one[slots < 0]
        if len(new):
            if len(self.keys) + len(new) > self.remembered:
                self._forget()
                new = one
            data = low.tobytes()
            self._learn(key[new], check[new], [data[i:j].decode("utf-8", "replace") for i, j in zip(starts[new].tolist(), ends[new].tolist())])
            slots = self._slots(key[one], check[one])
            if (slots < 0).any():
                raise Clash
        return starts, self.at[slots][group], self.size[slots][group]
