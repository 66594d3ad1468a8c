"""Words and their hashes, once as DataFrame expressions and once on bytes inside tasks.

A word is a maximal run of characters outside [\\x20\\x09-\\x0D]; words are
compared with A-Z in lower case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The lower-cased words of a text; none for a null text."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def byte_words(raw: bytes) -> list[bytes]:
    """The same words of a UTF-8 text: bytes.lower and bytes.split know ASCII letters and [\\x20\\x09-\\x0D] only."""
    return raw.lower().split()


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list<int64> array without nulls, the values as uint64."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return values[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int, most_rows: int | None = None):
    """Ranges of at most ``most_rows`` rows that hold about ``most`` values each, one row at least; whole rows only."""
    start, rows = 0, len(bounds) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, side="right")) - 1)
        stop = min(stop, start + (most_rows or rows))
        yield start, stop
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 (wraps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
