"""Hashes of all words of a text at once, with array operations on its bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
BLOCK_BYTES = 1 << 22  # handled together


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(30))


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(BLOCK_BYTES + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and line number of every word of UTF-8 text.

    The bytes of a word are hashed as a polynomial, by differences of running sums. A
    text longer than a block is cut between words; a word longer than a block is
    hashed in parts, which count as words.
    """
    up, down = powers()
    hashes, lines, start, line = [], [], 0, 0
    while start < len(raw):
        end = len(raw)
        if end - start > BLOCK_BYTES:
            cut = max(raw.rfind(c, start, start + BLOCK_BYTES) for c in (b" ", b"\n", b"\t", b"\r"))
            end = cut + 1 if cut >= start else start + BLOCK_BYTES
        data = np.frombuffer(raw, np.uint8, end - start, start)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.add.accumulate(data * up[: len(data)], out=sums[1:])
        value = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
        hashes.append(mix(value))
        ends = np.flatnonzero(data == 10)
        lines.append(line + np.searchsorted(ends, first))
        line += len(ends)
        start = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(lines)
