"""PLIO: line lists of 16-bit big-endian words for masks of non-negative integers.

The list keeps a value pv and a place; an instruction's upper four bits are its kind, the lower twelve its number.
"""

from __future__ import annotations

import numpy as np

#: Kinds of instructions, the header's length and mark, the largest number and value.
ZEROS, SET_HIGH, UP, DOWN, RUN, ZEROS_THEN_ONE, UP_AND_ONE, DOWN_AND_ONE = range(8)
HEADER, MARK, MOST, LARGEST = 7, -100, 4095, (1 << 27) - 1


def encode(pixels: np.ndarray) -> bytes:
    values = np.asarray(pixels).astype(np.int64)
    if len(values) and (values.min() < 0 or values.max() > LARGEST):
        raise ValueError("PLIO holds integers from 0 to 2^27 - 1")
    words: list[int] = []
    put = lambda kind, n: words.append(kind << 12 | n)
    edges = np.flatnonzero(np.diff(values)) + 1
    firsts = np.concatenate([[0], edges]) if len(values) else np.zeros(0, int)
    lengths = np.diff(np.append(firsts, len(values)))
    pv = 1
    for value, n in zip(values[firsts].tolist(), lengths.tolist(), strict=True):
        if value and value != pv:
            if abs(value - pv) <= MOST:
                put(UP if value > pv else DOWN, abs(value - pv))
            else:
                put(SET_HIGH, value & MOST)
                words.append(value >> 12)
            pv = value
        while n:
            part = min(n, MOST)
            put(RUN if value else ZEROS, part)
            n -= part
    total = HEADER + len(words)
    head = [0, HEADER, MARK & 0xFFFF, total & 0x7FFF, total >> 15, 0, 0]
    return np.array(head + words, np.uint16).astype(">u2").tobytes()


def decode(data: bytes, count: int) -> np.ndarray:
    words = np.frombuffer(data, ">u2").astype(np.int64)
    if len(words) < 3:
        return np.zeros(count, np.int64)
    if words[2] >= 1 << 15:
        first, total = int(words[1]), int(words[3]) + (int(words[4]) << 15)
    else:
        first, total = 3, int(words[2])
    out = np.zeros(count, np.int64)
    pv, at, i = 1, 0, first
    while i < min(total, len(words)) and at < count:
        kind, n = int(words[i]) >> 12, int(words[i]) & MOST
        i += 1
        if kind == ZEROS:
            at += n
        elif kind == SET_HIGH:
            pv = int(words[i]) << 12 | n
            i += 1
        elif kind in (UP, DOWN):
            pv += n if kind == UP else -n
        elif kind == RUN:
            out[at : at + n] = pv
            at += n
        elif kind == ZEROS_THEN_ONE:
            at += n
            if n and at <= count:
                out[at - 1] = pv
        elif kind in (UP_AND_ONE, DOWN_AND_ONE):
            pv += n if kind == UP_AND_ONE else -n
            out[at] = pv
            at += 1
        else:
            raise ValueError(f"PLIO instruction {kind} isn't known")
    return out
