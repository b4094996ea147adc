"""Self-join of a binary trie within a Hamming budget, inside one task, in numpy.

A node of the trie over sorted 64-bit keys is a range of positions; its children
are the two parts where the next bit is 0 and 1.  Pairs of nodes are walked down
together: a step adds one to a pair's differing bits where the children differ,
and drops the pair above the budget.  Small nodes are leaves and are compared key
by key.  The walk is depth first in chunks, so memory does not follow the number
of pairs.

What comes back is not the links but the groups they form: keys are united as
links are found, and pairs of nodes whose keys are all in one group already are
skipped, so a dense family of near copies does not cost the square of its size.
"""

from __future__ import annotations

import numpy as np

LEAF = 4
CHUNK = 1 << 16


class _Keys:
    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        bits = (self.keys[None, :] >> np.arange(63, -1, -1, dtype=np.uint64)[:, None]) & np.uint64(1)
        self.ones = np.zeros((64, len(keys) + 1), np.int32)
        np.cumsum(bits, axis=1, dtype=np.int32, out=self.ones[:, 1:])

    def cut(self, bit: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the keys of each range turn from 0 to 1 in this bit."""
        return high - (self.ones[bit][high] - self.ones[bit][low])


class _Groups:
    """Union of numbered keys; every key's label is the smallest key of its group."""

    def __init__(self, size: int):
        self.label = np.arange(size, dtype=np.int32)
        self._changes()

    def _changes(self) -> None:
        self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]).astype(np.int32)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        moved = False
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            moved, a, b = True, a[apart], b[apart]
            np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while True:
                further = label[label]
                if np.array_equal(further, label):
                    break
                label = further
            self.label = label
        if moved:
            self._changes()

    def one(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether all keys of each range are in one group."""
        return self.changes[high - 1] == self.changes[low]


def linked_groups(left: np.ndarray, right: np.ndarray | None, depth: int, differing: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of two subtrees (or of one, ``right`` None) that links within the budget join, with the key that stands for their group.

    ``depth`` bits of each side are its subtree's prefix; the prefixes differ in ``differing`` bits.
    """
    a = _Keys(left)
    b = a if right is None else _Keys(right)
    shift = 0 if right is None else len(a.keys)
    groups = _Groups(len(a.keys) + (0 if right is None else len(b.keys)))
    if not len(a.keys) or not len(b.keys):
        return a.keys[:0], a.keys[:0]
    one = lambda v: np.array([v], np.int32)
    stack = [(depth, one(0), one(len(a.keys)), one(0), one(len(b.keys)), one(differing))]
    while stack:
        bit, al, ah, bl, bh, diff = stack.pop()
        if len(groups.changes) > 1:
            done = groups.one(al, ah) & groups.one(bl + shift, bh + shift) & (groups.label[al] == groups.label[bl + shift])
            if done.any():
                keep = ~done | ((ah - al == 1) & (bh - bl == 1) & (al == bl) & (right is None))
                al, ah, bl, bh, diff = (x[keep] for x in (al, ah, bl, bh, diff))
        small = ((ah - al) <= LEAF) & ((bh - bl) <= LEAF) if bit < 64 else np.ones(len(al), bool)
        if small.any():
            sl, sh, tl, th = al[small], ah[small], bl[small], bh[small]
            xs, ys = [], []
            for i in range(int((sh - sl).max())):
                for j in range(int((th - tl).max())):
                    x, y = sl + i, tl + j
                    there = (x < sh) & (y < th)
                    if right is None:
                        there &= x < y
                    x, y = x[there], y[there]
                    near = np.bitwise_count(a.keys[x] ^ b.keys[y]) <= budget
                    xs.append(x[near])
                    ys.append(y[near] + shift)
            if xs:
                groups.unite(np.concatenate(xs), np.concatenate(ys))
            al, ah, bl, bh, diff = (x[~small] for x in (al, ah, bl, bh, diff))
        if not len(al):
            continue
        ac, bc = a.cut(bit, al, ah), b.cut(bit, bl, bh)
        same = (al == bl) & (ah == bh) if right is None else np.zeros(len(al), bool)
        parts = [
            (al, ac, bl, bc, diff, (ac > al) & (bc > bl)),
            (ac, ah, bc, bh, diff, (ah > ac) & (bh > bc)),
            (al, ac, bc, bh, diff + 1, (ac > al) & (bh > bc) & (diff < budget)),
            (ac, ah, bl, bc, diff + 1, (ah > ac) & (bc > bl) & (diff < budget) & ~same),
        ]
        new = [np.concatenate([p[k][p[5]] for p in parts]) for k in range(5)]
        for start in range(0, len(new[0]), CHUNK):
            stack.append((bit + 1, *(x[start : start + CHUNK] for x in new)))
    keys = a.keys if right is None else np.concatenate([a.keys, b.keys])
    moved = np.flatnonzero(groups.label != np.arange(len(keys)))
    return keys[moved], keys[groups.label[moved]]
