"""The trie join and the cuckoo filter against plain versions."""

import random

import numpy as np
import pytest

from tagloom.llm.cuckoo import CuckooFilter
from tagloom.llm.hamming_trie import linked_groups


def groups_of(keys, edges):
    label = {k: k for k in keys}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def near(left, right, budget):
    return [(a, b) for a in left for b in right if a != b and (a ^ b).bit_count() <= budget]


def keys_of(seed, base, copies):
    rng = random.Random(seed)
    keys = {rng.getrandbits(64) for _ in range(base)}
    hub = rng.getrandbits(64)
    while len(keys) < base + copies:
        key = hub
        for _ in range(rng.randint(0, 4)):
            key ^= 1 << rng.randrange(64)
        keys.add(key)
    return sorted(keys)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("budget", [0, 1, 3, 6])
def test_groups_in_one_subtree(seed, budget):
    keys = keys_of(seed, 60, 80)
    a, b = linked_groups(np.array(keys, np.uint64), None, 0, 0, budget)
    got = groups_of(keys, list(zip(a.tolist(), b.tolist(), strict=True)))
    assert got == groups_of(keys, near(keys, keys, budget))


@pytest.mark.parametrize("seed", range(6))
def test_links_between_two_subtrees(seed):
    keys = keys_of(seed, 40, 120)
    parts = {}
    for k in keys:
        parts.setdefault(k >> 62, []).append(k)
    for u, left in parts.items():
        for v, right in parts.items():
            if u < v:
                a, b = linked_groups(np.array(left, np.uint64), np.array(right, np.uint64), 2, (u ^ v).bit_count(), 3)
                both = left + right
                got = groups_of(both, list(zip(a.tolist(), b.tolist(), strict=True)))
                assert got == groups_of(both, near(left, right, 3))


def test_no_keys():
    none = np.zeros(0, np.uint64)
    assert [len(x) for x in linked_groups(none, None, 0, 0, 3)] == [0, 0]
    assert [len(x) for x in linked_groups(none, np.array([1], np.uint64), 4, 1, 3)] == [0, 0]


def test_cuckoo_filter_keeps_refuses_and_forgets():
    rng = random.Random(3)
    keys = [rng.randbytes(16) for _ in range(5000)]
    small = CuckooFilter.sized(100)
    taken = [key for key in keys if small.insert(key)]
    assert 100 <= len(taken) < 200  # a refused key leaves the others where they are
    assert all(key in small for key in taken)
    held = CuckooFilter.load(CuckooFilter.of([*keys, *keys]).dump())
    assert all(key in held for key in keys)
    others = [rng.randbytes(16) for _ in range(5000)]
    assert sum(key in held for key in others) < 25
    for key in keys[:2500]:
        assert held.delete(key)
    assert all(key in held for key in keys[2500:])
    assert sum(key in held for key in keys[:2500]) < 25
    for key in keys[2500:]:
        assert held.delete(key)
    assert not held.table.any()


def test_cuckoo_filter_never_denies_a_key_it_holds():
    """Many more keys than marks tell apart, put in and taken out at random."""
    rng = random.Random(5)
    held, inside, spare = CuckooFilter.sized(4000), set(), [rng.randbytes(7) + b"\0" + bytes([rng.randrange(9), *[0] * 7]) for _ in range(6000)]
    for _ in range(20):
        for key in rng.sample(spare, 1500):
            if key in inside:
                assert held.delete(key)
                inside.remove(key)
            elif held.insert(key):
                inside.add(key)
        assert len(inside) > 500 and all(key in held for key in inside)
