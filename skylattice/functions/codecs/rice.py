"""Rice coding of integers: differences in blocks, each split into a unary part and low bits.

The encoder places all codes of a tile at once by their lengths; the decoder goes through many tiles in step, one
pixel of each at a time, and through few tiles by a loop that only finds where codes begin.
"""

from __future__ import annotations

import numpy as np

#: Fixed values, by bytes of a pixel: bits of a block's split code, and the split that means differences stored whole.
SPLIT_BITS = {1: 3, 2: 4, 4: 5, 8: 6}
WHOLE = {1: 6, 2: 14, 4: 25, 8: 53}
#: Tiles from which on all are decoded in step; fewer are decoded one by one.
IN_STEP = 300


def _ones(lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, widths: np.ndarray) -> None:
    """Write values of given widths, most significant bit first, at bit places."""
    within = _ones(widths)
    owner = np.repeat(np.arange(len(widths)), widths)
    bits[at[owner] + within] = (values[owner] >> (widths[owner] - 1 - within).astype(np.uint64)) & np.uint64(1)


def encode(pixels: np.ndarray, blocksize: int = 32) -> bytes:
    """Signed (or, for one byte, unsigned) integers of 1, 2 or 4 bytes."""
    size = pixels.dtype.itemsize
    if size not in (1, 2, 4) or pixels.dtype.kind not in "iu":
        raise ValueError("Rice coding takes integers of 1, 2 or 4 bytes")
    width, whole, n = 8 * size, WHOLE[size], len(pixels)
    if not n:
        return b""
    signed = pixels.view(f"i{size}").astype(np.int64)
    # differences wrap to the pixel's width, then fold to non-negative numbers
    step = np.diff(signed, prepend=signed[:1])
    half = 1 << (width - 1)
    step = (step + half) % (1 << width) - half
    folded = np.where(step < 0, -2 * step - 1, 2 * step).astype(np.uint64)
    blocks = -(-n // blocksize)
    counts = np.full(blocks, blocksize)
    counts[-1] = n - blocksize * (blocks - 1)
    total = np.add.reduceat(folded, np.arange(blocks) * blocksize).astype(np.float64)
    level = np.maximum((total - counts // 2 - 1) / counts, 0).astype(np.int64) >> 1
    split = np.where(level > 0, np.floor(np.log2(np.maximum(level, 1))).astype(np.int64) + 1, 0)
    raw, flat = split >= whole, total == 0
    code = np.where(raw, whole + 1, np.where(flat, 0, split + 1)).astype(np.uint64)
    of = np.repeat(np.arange(blocks), counts)
    fs = split[of].astype(np.uint64)
    high = np.where(raw[of] | flat[of], 0, folded >> fs).astype(np.int64)
    low_width = np.where(flat[of], 0, np.where(raw[of], width, split[of]))
    length = np.where(flat[of], 0, np.where(raw[of], width, high + 1 + split[of]))
    head = SPLIT_BITS[size]
    in_block = np.add.reduceat(length, np.arange(blocks) * blocksize)
    start = width + np.concatenate([[0], np.cumsum(in_block + head)[:-1]])
    before = np.cumsum(length) - length
    place = before - before[np.arange(blocks) * blocksize][of] + (start + head)[of]
    end = int(start[-1] + head + in_block[-1])
    bits = np.zeros(-(-end // 8) * 8, np.uint8)
    first = int(signed[0]) % (1 << width)
    _put(bits, np.array([0]), np.array([first], np.uint64), np.array([width]))
    _put(bits, start, code, np.full(blocks, head))
    coded = ~(raw | flat)[of]
    bits[(place + high)[coded]] = 1
    mask = np.where(low_width < 64, (np.uint64(1) << low_width.astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
    some = low_width > 0
    _put(bits, (place + np.where(raw[of], 0, high + 1))[some], (folded & mask)[some], low_width[some])
    return np.packbits(bits).tobytes()


def decode_many(parts: list[bytes], counts: np.ndarray, kind: np.dtype, blocksize: int = 32) -> list[np.ndarray]:
    """Tiles of counts[i] pixels each."""
    kind = np.dtype(kind)
    size = kind.itemsize
    width, whole, head = 8 * size, WHOLE[size], SPLIT_BITS[size]
    out = [np.zeros(int(n), kind) for n in counts]
    live = np.flatnonzero(counts > 0)
    if not len(live):
        return out
    if len(live) < IN_STEP:
        for i in live:
            out[i][:] = _decode_long(parts[i], int(counts[i]), width, whole, head, blocksize).astype(f"u{size}").view(kind)
        return out
    lots = [live[i : i + 2048] for i in range(0, len(live), 2048)]
    for lot in lots:
        _decode_lot([parts[i] for i in lot], counts[lot].astype(np.int64), [out[i] for i in lot], width, whole, head, blocksize)
    return out


def _decode_long(part: bytes, n: int, width: int, whole: int, head: int, blocksize: int) -> np.ndarray:
    """One tile. Where codes begin follows from the code before, so a loop finds each code's set bit; all else is array operations."""
    raw = np.concatenate([np.frombuffer(part, np.uint8), np.zeros(16, np.uint8)])
    end = 8 * len(part)
    bits = np.unpackbits(raw[: len(part)])
    following = np.where(bits, np.arange(end, dtype=np.int64), end)
    following = np.minimum.accumulate(following[::-1])[::-1].tolist()  # the next set bit from each place
    words = np.zeros(len(raw) - 8, np.uint64)
    for k in range(8):
        words |= raw[k : len(words) + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    at, tops, splits, begins = width, [], [], []
    blocks = range(0, n, blocksize)
    try:
        for first in blocks:
            split = (int.from_bytes(part[at >> 3 : (at >> 3) + 2].ljust(2, b"\0"), "big") >> (16 - head - (at & 7)) & (1 << head) - 1) - 1  # a head is 6 bits at most
            at += head
            size = min(blocksize, n - first)
            splits.append(split)
            begins.append(at)
            if split < 0:
                continue
            if split >= whole:
                at += width * size
                continue
            skip = 1 + split
            for _ in range(size):
                top = following[at]
                tops.append(top)
                at = top + skip
    except IndexError:
        at = end + 1
    if at > end:
        raise ValueError("a Rice tile ends inside a code")

    def take(place, count):
        """``count`` bits (57 at most, or none) at each place."""
        count = np.asarray(count, np.uint64)
        got = words[place >> 3] << (place & 7).astype(np.uint64)
        return np.where(count > 0, got >> (np.uint64(64) - np.maximum(count, 1)), np.uint64(0))

    split = np.repeat(np.array(splits), blocksize)[:n]
    begin = np.repeat(np.array(begins), blocksize)[:n]
    inside = np.arange(n) % blocksize
    diff = np.zeros(n, np.uint64)
    coded = (split >= 0) & (split < whole)
    if coded.any():
        top, low = np.array(tops, np.int64), split[coded]
        start = np.concatenate([[0], top[:-1] + 1 + low[:-1]])
        start = np.where(inside[coded] == 0, begin[coded], start)
        diff[coded] = ((top - start).astype(np.uint64) << low.astype(np.uint64)) | take(np.minimum(top + 1, end), low)
    plain = split >= whole
    if plain.any():
        place = begin[plain] + inside[plain] * width
        half = np.full(len(place), min(width, 32))
        value = take(place, half)
        diff[plain] = value if width <= 32 else (value << np.uint64(32)) | take(place + 32, half)
    step = np.where(diff & np.uint64(1), ~(diff >> np.uint64(1)), diff >> np.uint64(1))
    zero = np.zeros(1, np.int64)
    first = take(zero, [min(width, 32)]) if width <= 32 else (take(zero, [32]) << np.uint64(32)) | take(zero + 32, [32])
    return (np.cumsum(step, dtype=np.uint64) + first[0]) & np.uint64((1 << width) - 1)


def _decode_lot(parts, counts, out, width, whole, head, blocksize) -> None:
    starts = np.cumsum([0] + [len(p) + 16 for p in parts])
    data = np.zeros(int(starts[-1]) + 16, np.uint8)
    for s, p in zip(starts, parts, strict=False):
        data[s : s + len(p)] = np.frombuffer(p, np.uint8)
    # 64 bits from any byte, big-endian: one gather then reads any code of up to 57 bits
    words = np.zeros(len(data), np.uint64)
    for k in range(8):
        words[: len(data) - 8] |= data[k : len(data) - 8 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    at = starts[:-1] * 8

    def peek(pos):
        return words[pos >> 3] << (pos & 7).astype(np.uint64)

    def take(pos, n):
        n = np.asarray(n, np.uint64)
        shift = np.uint64(64) - n
        some = n > 0
        return np.where(some, peek(pos) >> np.where(some, shift, np.uint64(0)), np.uint64(0)).astype(np.uint64)

    def zeros_before_one(pos):
        """Zeros from each place to the next set bit, however many."""
        total = np.zeros(len(pos), np.int64)
        pending = np.arange(len(pos))
        here = pos.copy()
        while len(pending):
            seen = peek(here[pending]) & ~np.uint64(0xFF)
            got = seen != 0
            lead = np.where(got, 63 - np.floor(np.log2(np.maximum(seen, 1).astype(np.float64))).astype(np.int64), 0)
            # rounding to a double may carry into the next power
            top = np.where(got & ((seen >> np.uint64(1) >> np.maximum(62 - lead, 0).astype(np.uint64)) == 0), lead + 1, lead)
            total[pending[got]] += top[got]
            rest = pending[~got]
            if len(rest) and (here[rest] >> 3 >= len(words) - 16).any():
                raise ValueError("a Rice tile ends inside a code")
            total[rest] += 56
            here[rest] += 56
            pending = rest
        return total

    if width == 64:
        last = (take(at, np.full(len(at), 32)) << np.uint64(32)) | take(at + 32, np.full(len(at), 32))
    else:
        last = take(at, np.full(len(at), width))
    at = at + width
    most = int(counts.max())
    modulus = np.uint64((1 << width) - 1)
    values = np.zeros((len(parts), most), np.uint64)
    split = np.zeros(len(parts), np.int64)
    active = np.arange(len(parts))
    for j in range(most):
        active = active[counts[active] > j]
        if j % blocksize == 0:
            split[active] = take(at[active], np.full(len(active), head)).astype(np.int64) - 1
            at[active] += head
        fs = split[active]
        diff = np.zeros(len(active), np.uint64)
        coded = (fs >= 0) & (fs < whole)
        k = active[coded]
        if len(k):
            high = zeros_before_one(at[k])
            low = fs[coded]
            diff[coded] = (high.astype(np.uint64) << low.astype(np.uint64)) | take(at[k] + high + 1, low)
            at[k] += high + 1 + low
        raw = fs >= whole
        k = active[raw]
        if len(k):
            if width == 64:
                diff[raw] = (take(at[k], np.full(len(k), 32)) << np.uint64(32)) | take(at[k] + 32, np.full(len(k), 32))
            else:
                diff[raw] = take(at[k], np.full(len(k), width))
            at[k] += width
        step = np.where(diff & np.uint64(1), ~(diff >> np.uint64(1)), diff >> np.uint64(1))
        last[active] = (last[active] + step) & modulus
        values[active, j] = last[active]
    for i, o in enumerate(out):
        o[:] = values[i, : len(o)].astype(f"u{width // 8}").view(o.dtype)
