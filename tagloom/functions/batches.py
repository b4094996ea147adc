"""Arrow batches taken a stretch at a time inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def stretches(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows whose texts add up to about ``most`` bytes: what is made of a batch never stands in memory at once."""
    start = total = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and total + size > most:
            yield start, i - start
            start, total = i, 0
        total += size
    if len(texts):
        yield start, len(texts) - start
