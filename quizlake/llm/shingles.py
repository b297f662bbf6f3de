"""Word shingles of whole Arrow batches of texts, hashed without a loop over words.

Words are runs of bytes other than blank and the controls 9 to 13; A-Z count as a-z. A word's hash is
a polynomial over its bytes, taken from running sums over the whole batch; a shingle's hash combines
those of its words. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240517)
#: One odd-numbered random value per byte, capitals as their small letters.
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_GAP = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base; those of usual lengths are kept."""
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(max(n, 600_000), base, np.uint64)
        steps[0] = 1
        powers = np.multiply.accumulate(steps)
        if n > 600_000:
            return powers[:n]
        _POWERS[base] = powers
    return _POWERS[base][:n]


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's bytes: hash, first byte and end of every word, and the first word of every row.
    ``gap`` tells for every byte whether it parts words."""
    n = len(data)
    inner = ~gap[data]
    begins, finishes = inner.copy(), inner.copy()
    begins[1:] &= ~inner[:-1]
    finishes[:-1] &= ~inner[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = inner[cut]
    finishes[cut - 1] = inner[cut - 1]
    first, end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    hashes = np.zeros(len(first), np.uint64)
    if len(first):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data] * _powers(_BASE, n), out=sums[1:])
        hashes = mix((sums[end] - sums[first]) * _powers(_INVERSE, n)[first] + (end - first).astype(np.uint64))
    return hashes, first, end, np.searchsorted(first, bounds)


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, the word each begins at, and the first shingle of every row.

    A row of fewer words, but at least one, has its whole sequence as its one shingle.
    """
    counts = np.diff(rows)
    kept = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(kept)])
    at = np.arange(bounds[-1]) + np.repeat(rows[:-1] - bounds[:-1], kept)
    length = np.repeat(np.minimum(counts, k), kept)
    out = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    padded = np.append(hashes, np.zeros(k, np.uint64))
    for i in range(k):
        step = mix(out + padded[at + i])
        out = np.where(i < length, step, out) if i else step
    return out, at, bounds


def sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and the bounds of the rows among them."""
    data, bounds = text_parts(column)
    hashes, _, _, rows = words(data, bounds)
    shingles, _, firsts = shingle_hashes(hashes, rows, k)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(firsts))
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[new], owner[new]
    return shingles, np.searchsorted(owner, np.arange(len(bounds)))
