"""Bit-sliced Hamming comparison of fingerprints that lie in buckets.

Fingerprints are stored vertically: plane j holds bit j of all rows, 64 rows to a word. A pass over distance d compares
row i with row i+d for all i at once: each plane is combined with itself, shifted by d rows, by XOR, and the result is
added to bitwise counters in carry-save form, so that a word operation updates 64 distances. Words none of whose rows
can still lie within the radius are abandoned and leave the working set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes(values: np.ndarray, bits: int = 64) -> np.ndarray:
    """bits x words: bit i%64 of word i//64 of plane j is bit j of values[i]; one more word of zeros at the end."""
    n = len(values)
    raw = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :bits]
    padded = np.zeros((bits, (n + 63) // 64 * 64 + 64), np.uint8)
    padded[:, :n] = raw.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def near_pairs(values: np.ndarray, left: np.ndarray, radius: int, step: int = 8, piece: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of values at most radius bits apart, in pieces.

    left: for each row, how many of the rows right after it it is compared with (its bucket ends there). A unit of work
    is a word of 64 rows and a distance; piece units are updated together.
    """
    n = len(values)
    if not n:
        return
    p = planes(values)
    digits, last = max(1, int(radius).bit_length()), p.shape[1] - 1
    lanes = np.zeros((n + 63) // 64 * 64, np.int64)
    lanes[:n] = left
    lanes = lanes.reshape(-1, 64)
    most = lanes.max(axis=1)
    ends = np.cumsum(most)
    for start in range(0, int(ends[-1]), piece):
        unit = np.arange(start, min(start + piece, int(ends[-1])))
        word = np.searchsorted(ends, unit, side="right")
        far = unit - (ends[word] - most[word]) + 1
        over = np.packbits(lanes[word] < far[:, None], axis=1, bitorder="little").view("<u8")[:, 0]  # outside the bucket
        skip, shift = word + (far >> 6), (far & 63).astype(np.uint64)
        counters = [np.zeros(len(unit), np.uint64) for _ in range(digits)]
        alive = np.arange(len(unit))
        for j in range(64):
            at = np.minimum(skip, last)
            # two shifts, as one by 64 is undefined
            other = (p[j, at] >> shift) | (p[j, np.minimum(at + 1, last)] << (np.uint64(63) - shift) << np.uint64(1))
            carry = p[j, word] ^ other
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            over = over | carry  # beyond the counters: over the radius
            if j % step == step - 1:
                over = over | _exceeds(counters, radius)
                keep = over != ONES
                if not keep.all():
                    alive, word, skip, shift, over = alive[keep], word[keep], skip[keep], shift[keep], over[keep]
                    counters = [c[keep] for c in counters]
                    if not len(alive):
                        break
        if len(alive):
            found, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = word[found] * 64 + lane
            yield i, i + far[alive[found]]


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over the radius already: a bitwise comparison from the highest digit on."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ONES)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above = above | (equal & counters[k])
            equal = equal & ~counters[k]
    return above
