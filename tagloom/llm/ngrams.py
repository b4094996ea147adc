"""Hashed character n-grams of whole texts, in numpy."""

from __future__ import annotations

import numpy as np


def code_points(text: str) -> np.ndarray:
    """Code points of the text in lower case, between two spaces."""
    return np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket (below 2**bits) of every n-gram, repeats included."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    mixed = codes[:size] * np.uint32(0x9E3779B1) + np.uint32(n)
    for k in range(1, n):
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[k : k + size]
    mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE3D)
    return mixed >> np.uint32(32 - bits)
