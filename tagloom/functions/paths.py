"""Column functions over file paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_path(path: Column, root: str) -> Column:
    """Path below the scan root; a path outside the root stays as it is."""
    prefix = root.rstrip("/") + "/" if root else ""
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def outside_directories(path: Column, blacklist: Sequence[str]) -> Column:
    """True where no directory of the path is blacklisted; no entries, no filter."""
    names = [d.strip() for d in blacklist if d.strip()]
    if not names:
        return F.lit(True)
    directories = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return ~F.arrays_overlap(directories, F.array(*[F.lit(n) for n in names]))
