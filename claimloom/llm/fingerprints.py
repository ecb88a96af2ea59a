"""SimHash fingerprints, and the pigeonring filter on the bits in which two of them differ."""

from __future__ import annotations

import numpy as np

#: The seed of the shingles' hashes.
SEED = 42
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def sketch(hashes: np.ndarray) -> bytes:
    """The bits, 8 bytes from the lowest on, that more than half of the 64-bit hashes have."""
    rows = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = [np.bincount(rows[:, i], minlength=256) @ _BITS for i in range(8)]
    return np.packbits(np.concatenate(counts) * 2 > len(rows), bitorder="little").tobytes()


def within_ring(apart: np.ndarray, radius: int, bits: int = 16) -> np.ndarray:
    """Whether rows of differing bits (uint64 words) have `radius` at most, by the ring of their
    segments: of the chains that start at a segment, each must stay within the share of radius
    that its length has. Rows without such a start are dropped as soon as that is known; the
    longest chain is the whole ring."""
    counts = np.bitwise_count(np.ascontiguousarray(apart).view(f"<u{bits // 8}").reshape(len(apart), apart.shape[1] * 64 // bits)).astype(np.int16)
    m, ok = counts.shape[1], np.zeros(len(apart), bool)
    at, sums = np.arange(len(apart)), np.zeros_like(counts)
    start = np.ones(counts.shape, bool)
    for length in range(1, m + 1):
        sums += np.roll(counts, 1 - length, axis=1)
        start &= sums <= length * radius // m
        left = start.any(1)
        at, counts, sums, start = at[left], counts[left], sums[left], start[left]
    ok[at] = True
    return ok
