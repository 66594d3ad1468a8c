"""DartMinHash (Christiani, 2020): sparse sketches for weighted Jaccard similarity.

Each element of a weighted set owns the strip [0, weight) x [0, infinity). A
Poisson process of rate one throws darts into the whole plane of an element;
where they fall is a hash of the element, so equal elements have equal darts.
Every dart carries a coordinate of the sketch, drawn from the same hash. A set
sees the darts inside its strips, and coordinate j of its sketch is the dart
of lowest height among those that carry j. Two sets agree in a coordinate with
a probability equal to their weighted Jaccard similarity.

Weights are counts, so a strip is a row of unit cells. Heights are needed up
to about k (ln k + 4) / (sum of weights) only: that many darts fill all k
coordinates almost surely; sets with an empty coordinate are done again with
a ceiling twice as high, so the result never depends on the ceiling.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.tokens import mix

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_cells(tokens: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells (hash, row) of the shingles of ``width`` words of each row.

    A row with fewer words has one shingle of all of them, a row without words
    none. The c-th repetition of a shingle is the c-th cell of its strip.
    """
    lengths = np.diff(bounds)
    with np.errstate(over="ignore"):
        base = mix(tokens + GOLDEN)
        count = len(tokens) - width + 1
        rolled = np.zeros(max(count, 0), dtype=np.uint64)
        for i in range(width):
            rolled = rolled * GOLDEN + base[i : i + len(rolled)]
        row_of = np.repeat(np.arange(len(lengths)), lengths)
        starts = np.arange(len(rolled))
        fits = starts + width <= bounds[1:][row_of[: len(rolled)]]
        hashes, rows = mix(rolled[fits]), row_of[: len(rolled)][fits]
        short = np.nonzero((lengths > 0) & (lengths < width))[0]
        if len(short):
            alone = []
            for r in short:
                h = np.array([lengths[r]], dtype=np.uint64)
                for t in base[bounds[r] : bounds[r + 1]]:
                    h = h * GOLDEN + t
                alone.append(mix(h)[0])
            hashes, rows = np.concatenate([hashes, np.array(alone, dtype=np.uint64)]), np.concatenate([rows, short])
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        same = np.zeros(len(hashes), dtype=bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
        at = np.arange(len(hashes))
        first = np.maximum.accumulate(np.where(same, 0, at))
        return mix(hashes + (at - first).astype(np.uint64) * GOLDEN), rows


def dart_sketches(cells: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """(n_rows, k) sketches; rows without cells are all zero."""
    weight = np.bincount(rows, minlength=n_rows)
    sketch = np.zeros(n_rows * k, dtype=np.uint64)
    ceiling = k * (np.log(k) + 4) / np.maximum(weight, 1)
    todo = np.ones(len(cells), dtype=bool)
    while todo.any():
        cell, row = cells[todo], rows[todo]
        height = np.zeros(len(cell))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        turn = 0
        with np.errstate(over="ignore"):
            while len(cell):
                turn += 1
                drawn = mix(cell + np.uint64(turn) * np.uint64(0xD1B54A32D192ED03))
                height = height - np.log1p(-((drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53))
                low = height <= ceiling[row]
                cell, row, height = cell[low], row[low], height[low]
                dart = mix(drawn[low] ^ GOLDEN)
                coordinate = ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
                found.append((height, row * k + coordinate, dart | np.uint64(1)))
        heights, slots, darts = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(-heights, kind="stable")  # the lowest dart of a slot is written last and stays
        sketch[slots[order]] = darts[order]
        unfilled = (sketch.reshape(n_rows, k) == 0).any(axis=1) & (weight > 0)
        ceiling = np.where(unfilled, ceiling * 2, ceiling)
        todo = unfilled[rows]
    return sketch.reshape(n_rows, k)


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) hashes of ``rows`` neighbouring coordinates each, different from band to band."""
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)) * GOLDEN
    with np.errstate(over="ignore"):
        for i in range(rows):
            out = mix(out + parts[:, :, i])
    return out
