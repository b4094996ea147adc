"""A cuckoo filter over 16-byte keys, in numpy: insert, contains, delete."""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np

SLOTS = 4
MAX_KICKS = 400


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, in one table.

    A key may sit in two buckets; either index follows from the other and the
    fingerprint, so keys can be moved and deleted without being known.  Keys of
    one fingerprint that share a bucket share both, so taking back a key that
    was put in never costs another one its place: the filter does not deny a key
    it holds.  It affirms others with a chance below ``8 / 65535``.  A key for
    which no place is found is refused; the owner of the keys then builds a
    larger filter with ``of``.  Delete only keys that are in.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: Iterable[bytes]) -> CuckooFilter:
        """The smallest filter that takes all these keys with room for a quarter more."""
        keys = sorted(set(keys))
        held = cls.sized(len(keys) * 5 // 4)
        while not all(map(held.insert, keys)):
            held = cls(np.zeros((2 * len(held.table), SLOTS), np.uint16))
        return held

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mask = len(self.table) - 1
        mark = 1 + int.from_bytes(key[8:16], "little") % 65535
        first = int.from_bytes(key[:8], "little") & mask
        return mark, first, (first ^ (mark * 0x5BD1E995)) & mask

    def insert(self, key: bytes) -> bool:
        """Whether there was a place for the key; if not, the filter is as before."""
        table = self.table
        mark, first, second = self._places(key)
        for place in (first, second):
            free = np.flatnonzero(table[place] == 0)
            if len(free):
                table[place, free[0]] = mark
                return True
        path, place = [], second
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            path.append((place, slot, int(table[place, slot])))
            mark, table[place, slot] = int(table[place, slot]), mark
            place = (place ^ (mark * 0x5BD1E995)) & (len(table) - 1)
            free = np.flatnonzero(table[place] == 0)
            if len(free):
                table[place, free[0]] = mark
                return True
        for place, slot, mark in reversed(path):  # put back what was moved
            table[place, slot] = mark
        return False

    def __contains__(self, key: bytes) -> bool:
        mark, first, second = self._places(key)
        return mark in self.table[first] or mark in self.table[second]

    def delete(self, key: bytes) -> bool:
        mark, first, second = self._places(key)
        for place in (first, second):
            held = np.flatnonzero(self.table[place] == mark)
            if len(held):
                self.table[place, held[0]] = 0
                return True
        return False

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.save(out, self.table)
        return out.getvalue()

    @classmethod
    def load(cls, content: bytes) -> CuckooFilter:
        return cls(np.load(io.BytesIO(content)))
