"""Quantisation of float tiles with subtractive dithering, and the noise that sets its step."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: The dither table's length and generator, stored marks of no value and of exact zero, and methods by ZQUANTIZ.
N_RANDOM, FACTOR, MODULUS = 10000, 16807, 2147483647
NULL, ZERO = -2147483647, -2147483646
METHODS = {"NO_DITHER": 0, "SUBTRACTIVE_DITHER_1": 1, "SUBTRACTIVE_DITHER_2": 2}
#: Factors from median absolute differences of 2nd, 3rd and 5th order to a noise sigma.
SIGMA2, SIGMA3, SIGMA5 = 1.0483579, 0.6052697, 0.1772048


@dataclass(frozen=True)
class Quantize:
    """level: noise sigmas over the step (negative: the step itself); method: dither1, dither2 or none; seed of the dither, 1 at least."""

    level: float = 4.0
    method: str = "dither1"
    seed: int = 1

    @property
    def number(self) -> int:
        return {"none": 0, "no_dither": 0, "dither1": 1, "dither2": 2}[self.method.lower()]

    @property
    def zquantiz(self) -> str:
        return next(k for k, v in METHODS.items() if v == self.number)


@lru_cache(maxsize=1)
def table() -> np.ndarray:
    """The standard's 10000 random numbers as 32-bit floats."""
    out, x = np.empty(N_RANDOM, np.float32), 1
    for i in range(N_RANDOM):
        x = x * FACTOR % MODULUS
        out[i] = x / MODULUS
    return out


def offsets(tile_row: int, seed: int, count: int) -> np.ndarray:
    """Random numbers of a tile's pixels. tile_row counts from 1; each run through the table begins at a place of its own."""
    numbers, start = table(), (tile_row - 1 + max(seed, 1) - 1) % N_RANDOM
    out, got = [], 0
    while got < count:
        at = int(numbers[start] * np.float32(500))
        part = numbers[at : at + count - got]
        out.append(part)
        got += len(part)
        start = (start + 1) % N_RANDOM
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def restore(stored: np.ndarray, scale: float, zero: float, method: int, tile_row: int, seed: int, kind, blank: int | None = NULL) -> np.ndarray:
    """Floats of a quantised tile."""
    q = stored.astype(np.float64)
    if method:
        q = q - offsets(tile_row, seed, len(stored)).astype(np.float64) + 0.5
    out = (q * scale + zero).astype(kind)
    if method == 2:
        out[stored == ZERO] = 0
    if blank is not None:
        out[stored == blank] = np.nan
    return out


def upper_median(x: np.ndarray) -> float:
    return float(np.partition(x, len(x) // 2)[len(x) // 2])


def noise(rows: np.ndarray) -> tuple[float, float, float]:
    """Sigmas of 2nd, 3rd and 5th order of an image's rows, over values that are numbers; runs of equal values don't count."""
    found: list[list[float]] = [[], [], []]
    for row in rows:
        v = row[np.isfinite(row)].astype(np.float64)
        if len(v) < 9:
            continue
        d2, d3, d5 = np.abs(v[4:-4] - v[6:-2]), np.abs(2 * v[4:-4] - v[2:-6] - v[6:-2]), np.abs(6 * v[4:-4] - 4 * v[2:-6] - 4 * v[6:-2] + v[:-8] + v[8:])
        varied = d5 > 0
        for out, d in zip(found, (d2, d3, d5), strict=True):
            if varied.any():
                out.append(upper_median(d[varied]))
    middle = [float(np.median(x)) if x else 0.0 for x in found]
    return SIGMA2 * middle[0], SIGMA3 * middle[1], SIGMA5 * middle[2]


def quantise(tile: np.ndarray, settings: Quantize, tile_row: int) -> tuple[np.ndarray, float, float] | None:
    """(stored integers, scale, zero) of a 2-D tile, or None where it can't be quantised and is stored whole."""
    flat = tile.reshape(-1).astype(np.float64)
    good = np.isfinite(flat)
    if good.sum() <= 1:
        return None
    if settings.level < 0:
        step = -settings.level
    else:
        known = [x for x in noise(tile.reshape(-1, tile.shape[-1])) if x > 0]
        step = (min(known) if known else 0.0) / (settings.level or 4.0)
    low, high = flat[good].min(), flat[good].max()
    if step == 0 or (high - low) / step > 2.0 * 2147483647 - 10:
        return None
    if good.all() and settings.number != 2:
        zero = float(np.trunc(low / step + 0.5) * step) if (high - low) / step < 2147483647 - 10 else (low + high) / 2
    else:
        zero = low - step * (NULL + 10)
    return store(flat, step, zero, settings.number, settings.seed, tile_row), step, zero


def store(flat: np.ndarray, scale: float, zero: float, method: int, seed: int, tile_row: int) -> np.ndarray:
    """Integers of floats at a fixed scale; rounding is away from zero at halves."""
    good = np.isfinite(flat)
    x = (np.where(good, flat, zero) - zero) / scale
    if method:
        x = x + offsets(tile_row, seed, len(flat)).astype(np.float64) - 0.5
    q = np.where(x >= 0, np.floor(x + 0.5), np.ceil(x - 0.5))
    if (np.abs(q[good]) > 2147483647).any():
        raise ValueError("a value outside of the tile's scale")
    out = q.astype(np.int64)
    if method == 2:
        out[good & (flat == 0)] = ZERO
    out[~good] = NULL
    return out.astype(np.int32)
