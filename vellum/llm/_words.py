"""Vectorised hashing of the words of Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z
lower-cased.  Hashes are unsigned 64-bit and depend on the word alone, so they
can be compared between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in runs of about so many bytes, which bounds the temporary arrays.
RUN_BYTES = 512 * 1024

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FEW = 4096
_NEAR = np.cumprod(np.full(_FEW, 0xD1342543DE82EF95, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, the ``n + 1`` offsets and the null flags of a string column."""
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, ends, np.asarray(column.is_null())


def _hash_run(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of ``raw``, and the first byte and the end of each; words end at ``cuts`` too."""
    solid = ~_BLANK[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = cuts[cuts < len(raw)]
    first[cuts] |= solid[cuts]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.flatnonzero(first[at])
    place = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
    weight = _NEAR[place & (_FEW - 1)]
    if place.max() >= _FEW:
        weight = weight * mix((place // _FEW).astype(np.uint64) * _STEP + _STEP)
    sums = np.add.reduceat(_BYTE[_LOWER[raw[at]]] * weight, heads)
    return mix(sums), at[heads], at[np.append(heads[1:], len(at)) - 1] + 1


def placed_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield ``(first row, end row, hashes, bounds, first, last)`` for runs of rows; row
    ``r`` of a run has ``hashes[bounds[r]:bounds[r + 1]]``, and the words' bytes go from
    ``first`` to before ``last``, counted from the run's first byte.  Null texts have no
    words.  A text longer than a run is hashed piece by piece, cut at blanks, and is a
    run alone."""
    raw, ends, _ = strings(column)
    n, row = len(ends) - 1, 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + RUN_BYTES, "right")) - 1)
        low, high = int(ends[row]), int(ends[stop])
        if high - low <= RUN_BYTES:
            hashes, first, last = _hash_run(raw[low:high], ends[row:stop] - low)
            bounds = np.searchsorted(first, ends[row : stop + 1] - low)
        else:
            parts, base = [], low
            while low < high:
                cut, reach = min(low + RUN_BYTES, high), RUN_BYTES
                while cut < high:
                    blanks = np.flatnonzero(_BLANK[raw[low:cut]])
                    if len(blanks):
                        cut = low + int(blanks[-1]) + 1
                        break
                    reach *= 2
                    cut = min(low + reach, high)
                some, first, last = _hash_run(raw[low:cut], np.zeros(1, np.int64))
                parts.append((some, first + low - base, last + low - base))
                low = cut
            hashes, first, last = (np.concatenate(p) for p in zip(*parts, strict=True))
            bounds = np.array([0, len(hashes)])
        yield row, stop, hashes, bounds, first, last
        row = stop


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The first four of :func:`placed_words`."""
    return (run[:4] for run in placed_words(column))


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``k``-word shingles: the whole
    sequence as one if there are fewer words, none without words or text."""
    for _, _, hashes, bounds in word_hashes(column):
        grams = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for i in range(k):
            grams = mix(grams + hashes[i : i + len(grams)] + np.uint64(int(_STEP) * (i + 1) % 2**64))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if high - low >= k:
                own = np.sort(grams[low : high - k + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            elif high > low:
                whole = np.array([high - low], np.uint64)
                for at in range(low, high):
                    whole = mix(whole + hashes[at : at + 1] + _STEP)
                yield whole
            else:
                yield np.zeros(0, np.uint64)
