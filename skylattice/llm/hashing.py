"""128-bit hashes of many pieces of a byte buffer at once."""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed at once.
BLOCK = 1 << 18

_rng = np.random.default_rng(20)
_VALUES = _rng.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _tables() -> list[tuple[np.ndarray, np.ndarray]]:
    if not _powers:
        for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            p = np.full(BLOCK + 1, base, np.uint64)
            inverse = np.full(BLOCK + 1, pow(base, -1, 1 << 64), np.uint64)
            p[0] = inverse[0] = 1
            _powers.append((np.multiply.accumulate(p), np.multiply.accumulate(inverse)))
    return _powers


def hash_block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit polynomial hashes of each piece data[start:end]; data has at most BLOCK bytes. The first is never 0."""
    out = []
    for values, (power, inverse) in zip(_VALUES, _tables(), strict=True):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * power[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(32)))
    return out[0] | np.uint64(1), out[1]


def hash_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hash_block() over a buffer of any size; pieces are in order and don't overlap."""
    h, g = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        if int(ends[j - 1]) - lo > BLOCK:  # one very long piece
            import hashlib

            digest = hashlib.blake2b(data[lo : int(ends[i])].tobytes(), digest_size=16).digest()
            h[i], g[i] = int.from_bytes(digest[:8], "little") | 1, int.from_bytes(digest[8:], "little")
        else:
            h[i:j], g[i:j] = hash_block(data[lo : int(ends[j - 1])], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return h, g


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, texts' first words): maximal runs of bytes with inside[byte], within each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = inside[data]
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[edge] = mask[edge]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = mask[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table
