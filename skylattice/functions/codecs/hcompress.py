"""HCOMPRESS_1: a two-dimensional Haar-like transform of integers, its coefficients' bit-planes coded by quadtrees.

A level of the transform turns each square of four pixels into a sum and three differences, and goes on with the sums. Sums
lie in the leading quarter, differences along the fast axis beside it, along the slow axis below it, and diagonal ones last.
Low bits that follow from others' parity are dropped (and put back by the inverse), so nothing is lost at scale 0 or 1.

The stream, big-endian: DD 99, rows (i32), columns (i32), scale (i32), the sum (i64), bit-planes of the three kinds of quarter
(u8 each); for each quarter and plane from the highest a code, then a nybble 0 and padding, then a sign bit for each coefficient that isn't 0.
A plane's code is nybble 0 and all squares as nybbles, or nybble F and its quadtree from the root, each level from the last square.
"""

from __future__ import annotations

import struct

import numpy as np

#: Magic bytes, and the prefix codes of a square's four bits with their lengths.
MAGIC = b"\xdd\x99"
CODE = (0x3E, 0x00, 0x01, 0x08, 0x02, 0x09, 0x1A, 0x1B, 0x03, 0x1C, 0x0A, 0x1D, 0x0B, 0x1E, 0x3F, 0x0C)
LENGTH = (6, 3, 3, 4, 3, 4, 5, 5, 3, 5, 4, 5, 4, 5, 6, 4)

_HEAD = struct.Struct(">2siiiq3B")
_LONG = 6  # bits of the longest code
#: Each code's bits left-aligned, and which of them count; and by the next six bits of a stream: value and length.
_BITS = np.array([[c >> (n - 1 - k) & 1 if k < n else 0 for k in range(_LONG)] for c, n in zip(CODE, LENGTH, strict=True)], np.uint8)
_USED = np.arange(_LONG) < np.array(LENGTH)[:, None]
_NEXT = {c << (_LONG - n) | rest: (v, n) for v, (c, n) in enumerate(zip(CODE, LENGTH, strict=True)) for rest in range(1 << (_LONG - n))}
_VALUE, _STEP = (bytes(_NEXT[w][k] for w in range(1 << _LONG)) for k in (0, 1))
_ZERO, _FULL = np.zeros(4, np.uint8), np.ones(4, np.uint8)


def levels_of(n: int, m: int) -> int:
    """Halvings that bring the longer side to one."""
    return (max(n, m) - 1).bit_length()


def sizes_of(n: int, m: int) -> list[tuple[int, int]]:
    """Shapes of the quadtree's levels of squares, from the finest to the root."""
    out = []
    for _ in range(max(1, levels_of(n, m))):
        n, m = -(-n // 2), -(-m // 2)
        out.append((n, m))
    return out


def to_multiple(x: np.ndarray, bit: int, half_down: int) -> np.ndarray:
    """x to a multiple of ``bit`` (a power of two): half of it is added first, or ``half_down`` below 0."""
    return (x + np.where(x >= 0, bit >> 1, half_down)) & -bit


# The transform


def forward(image: np.ndarray) -> np.ndarray:
    """Coefficients of an integer image."""
    a = image.astype(np.int64)
    n, m = a.shape
    shift, bit = 0, 2
    for _ in range(levels_of(n, m)):
        p, q = n // 2, m // 2  # whole squares
        v = a[:n, :m]
        up, right, down, both = v[0::2, 0::2], v[0::2, 1::2], v[1::2, 0::2], v[1::2, 1::2]
        total = np.empty(up.shape, np.int64)
        fast, slow = np.empty(right.shape, np.int64), np.empty(down.shape, np.int64)
        s = up[:p, :q], right[:p, :q], down[:p, :q], both
        total[:p, :q] = (s[3] + s[2] + s[1] + s[0]) >> shift
        slow[:p, :q] = (s[3] + s[2] - s[1] - s[0]) >> shift
        fast[:p, :q] = (s[3] - s[2] + s[1] - s[0]) >> shift
        diagonal = (s[3] - s[2] - s[1] + s[0]) >> shift
        if m % 2:  # a last column without a neighbour
            total[:p, q] = (down[:, q] + up[:p, q]) << (1 - shift)
            slow[:, q] = (down[:, q] - up[:p, q]) << (1 - shift)
        if n % 2:
            total[p, :q] = (right[p] + up[p, :q]) << (1 - shift)
            fast[p] = (right[p] - up[p, :q]) << (1 - shift)
        if n % 2 and m % 2:
            total[p, q] = up[p, q] << (2 - shift)
        top, left = total.shape
        a[:top, :left] = to_multiple(total, 2 * bit, bit - 1)
        a[:top, left:m] = _half_up(fast, bit)
        a[top:n, :left] = _half_up(slow, bit)
        a[top:n, left:m] = diagonal
        n, m, shift, bit = top, left, 1, 2 * bit
    return a


def _half_up(x: np.ndarray, bit: int) -> np.ndarray:
    """x to a multiple of ``bit``, half of it added at and above 0 alone."""
    return (x + np.where(x >= 0, bit >> 1, 0)) & -bit


def away(x: np.ndarray, amount) -> np.ndarray:
    """x moved away from 0 by ``amount`` (toward it where that is below 0); 0 counts as positive."""
    return np.where(x >= 0, x + amount, x - amount)


def inverse(coefficients: np.ndarray, smooth: int = 0) -> np.ndarray:
    """The image of coefficients. smooth: half the scale, by which differences may be moved to make slopes even."""
    a = coefficients.astype(np.int64)
    n, m = a.shape
    depth = levels_of(n, m)
    if not depth:
        return a
    bit0, bit1 = 1 << (depth - 1), 1 << depth
    a[0, 0] = to_multiple(a[0, 0], 2 * bit1, bit1 - 1)
    shapes = [(n, m), *sizes_of(n, m)]
    for k in range(depth - 1, -1, -1):
        rows, columns = shapes[k]
        top, left = shapes[k + 1]
        p, q = rows // 2, columns // 2
        total, fast = a[:top, :left].copy(), a[:top, left:columns].copy()
        slow, diagonal = a[top:rows, :left].copy(), a[top:rows, left:columns].copy()
        if smooth:
            smoothed(total, fast, slow, diagonal, rows, columns, smooth)
        # what rounding adds below 0: one less than half, but nothing where there is no half
        down1, down0 = ((bit1 >> 1) - 1, (bit0 >> 1) - 1) if k else ((bit1 >> 1) - 1, 0)
        slow, fast = to_multiple(slow, bit1, down1), to_multiple(fast, bit1, down1)
        diagonal = to_multiple(diagonal, bit0, down0)
        shift = 1 if k else 2
        out = np.empty((rows, columns), np.int64)
        low0 = diagonal & bit0
        x, y, c = away(slow[:p, :q], -low0), away(fast[:p, :q], -low0), diagonal
        low1 = (c ^ x ^ y) & bit1
        h = total[:p, :q]
        h = np.where(h >= 0, h + low0 - low1, h + np.where(low0 == 0, low1, low0 - low1))
        out[1::2, 1::2] = (h + x + y + c) >> shift
        out[1::2, 0 : 2 * q : 2] = (h + x - y - c) >> shift
        out[0 : 2 * p : 2, 1::2] = (h - x + y - c) >> shift
        out[0 : 2 * p : 2, 0 : 2 * q : 2] = (h - x - y + c) >> shift
        if columns % 2:
            x, h = slow[:, q], total[:p, q]
            h = away(h, -(x & bit1))
            out[1::2, -1], out[0 : 2 * p : 2, -1] = (h + x) >> shift, (h - x) >> shift
        if rows % 2:
            y, h = fast[p], total[p, :q]
            h = away(h, -(y & bit1))
            out[-1, 1::2], out[-1, 0 : 2 * q : 2] = (h + y) >> shift, (h - y) >> shift
        if rows % 2 and columns % 2:
            out[-1, -1] = total[p, q] >> shift
        a[:rows, :columns] = out
        bit0, bit1 = bit0 >> 1, bit0
    return a


def nearer(x: np.ndarray, wanted: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int, limit: int) -> None:
    """x moved toward ``wanted / 2**bits`` (held between least and most) by ``limit`` at most, where least and most differ."""
    gap = np.clip(wanted, least, most) - (x << bits)
    step = np.where(gap >= 0, gap >> bits, (gap + (1 << bits) - 1) >> bits)
    x += np.where(least < most, np.clip(step, -limit, limit), 0)


def smoothed(total, fast, slow, diagonal, rows: int, columns: int, limit: int) -> None:
    """Differences moved so that neighbouring sums lie on one slope, where these rise or fall together; edges stay."""
    u, w = slice(1, max(1, -(-(rows - 2) // 2))), slice(1, max(1, -(-(columns - 2) // 2)))

    def along(x, here, before, after):
        rise, fall = np.minimum(after - here, here - before), np.maximum(after - here, here - before)
        nearer(x, after - before, np.minimum(fall, 0) << 2, np.maximum(rise, 0) << 2, 3, limit)

    moved = lambda s, by: slice(s.start + by, s.stop + by)
    everywhere = slice(None)
    along(slow[u, : total.shape[1]], total[u, everywhere], total[moved(u, -1), everywhere], total[moved(u, 1), everywhere])
    along(fast[: total.shape[0], w], total[everywhere, w], total[everywhere, moved(w, -1)], total[everywhere, moved(w, 1)])
    if u.start >= u.stop or w.start >= w.stop:
        return
    here = total[u, w]
    corner = {(i, j): total[moved(u, i), moved(w, j)] for i in (-1, 1) for j in (-1, 1)}
    x2, y2 = slow[u, w] << 1, fast[u, w] << 1
    bound = lambda of: ((of(corner[1, 1] - here, 0) - x2 - y2, of(here - corner[1, -1], 0) + x2 - y2), (of(here - corner[-1, 1], 0) - x2 + y2, of(corner[-1, -1] - here, 0) + x2 + y2))
    (a, b), (c, d) = bound(np.maximum)
    most = np.minimum(np.minimum(a, b), np.minimum(c, d)) << 4
    (a, b), (c, d) = bound(np.minimum)
    least = np.maximum(np.maximum(a, b), np.maximum(c, d)) << 4
    nearer(diagonal[u, w], corner[1, 1] + corner[-1, -1] - corner[-1, 1] - corner[1, -1], least, most, 6, limit)


# Bit-planes


def squares(bits: np.ndarray) -> np.ndarray:
    """Four neighbouring bits as a number: the first of the first row counts 8, the last of the second 1."""
    n, m = bits.shape
    even = np.zeros((n + n % 2, m + m % 2), np.uint8)
    even[:n, :m] = bits
    return even[0::2, 0::2] << 3 | even[0::2, 1::2] << 2 | even[1::2, 0::2] << 1 | even[1::2, 1::2]


def spread(nybbles: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The bits of squares."""
    n, m = nybbles.shape
    out = np.empty((2 * n, 2 * m), np.uint8)
    out[0::2, 0::2], out[0::2, 1::2] = nybbles >> 3 & 1, nybbles >> 2 & 1
    out[1::2, 0::2], out[1::2, 1::2] = nybbles >> 1 & 1, nybbles & 1
    return out[: shape[0], : shape[1]]


def quarters(n: int, m: int) -> list[tuple[slice, slice, int]]:
    """(rows, columns, kind) of the coefficients' quarters in the stream's order."""
    top, left = -(-n // 2), -(-m // 2)
    return [(slice(0, top), slice(0, left), 0), (slice(0, top), slice(left, m), 1), (slice(top, n), slice(0, left), 1), (slice(top, n), slice(left, m), 2)]


def plane_code(plane: np.ndarray) -> list[np.ndarray]:
    """Bits of one plane: as a quadtree, or as they are where the tree would be as long."""
    finest = squares(plane)
    tree = [finest]
    while len(tree) < len(sizes_of(*plane.shape)):
        tree.append(squares(tree[-1] != 0))
    values = np.concatenate([t.reshape(-1)[::-1] for t in reversed(tree)])
    values = values[values > 0]
    used = _USED[values]
    if int(used.sum()) >> 3 >= (finest.size + 1) // 2:
        return [_ZERO, np.unpackbits(finest.reshape(-1, 1), axis=1)[:, 4:].reshape(-1)]
    return [_FULL, _BITS[values][used] if len(values) else _BITS[0]]


def encode(tile: np.ndarray, scale: int = 0) -> bytes:
    """The stream of a 2-D integer tile. Scales over 1 lose what lies below them."""
    a = forward(tile)
    if scale > 1:
        half = (scale + 1) // 2 - 1
        a = np.sign(a) * ((np.abs(a) + half) // scale)
    n, m = a.shape
    total, a[0, 0] = int(a[0, 0]), 0
    size, parts = np.abs(a), []
    planes = [0, 0, 0]
    for rows, columns, kind in quarters(n, m):
        planes[kind] = max(planes[kind], int(size[rows, columns].max(initial=0)).bit_length())
    for rows, columns, kind in quarters(n, m):
        for bit in range(planes[kind] - 1 if size[rows, columns].size else -1, -1, -1):
            parts += plane_code((size[rows, columns] >> bit & 1).astype(np.uint8))
    bits = np.concatenate([*parts, _ZERO])
    flat = a.reshape(-1)
    return _HEAD.pack(MAGIC, n, m, scale, total, *planes) + np.packbits(bits).tobytes() + np.packbits(flat[flat != 0] < 0).tobytes()


class Bits:
    """A stream read from its start."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        wide = np.concatenate([self.bits, np.zeros(_LONG, np.uint8)])
        window = np.zeros(len(self.bits) + 1, np.uint8)
        for k in range(_LONG):
            window |= wide[k : k + len(window)] << (_LONG - 1 - k)
        self.window, self.at = window.tobytes(), 0

    def nybbles(self, count: int) -> np.ndarray:
        got = self.bits[self.at : self.at + 4 * count]
        if len(got) < 4 * count:
            raise ValueError("HCOMPRESS_1: the stream ends inside a plane")
        self.at += 4 * count
        return got.reshape(-1, 4) @ np.array([8, 4, 2, 1], np.uint8)

    def codes(self, count: int) -> np.ndarray:
        """``count`` prefix codes one after another."""
        window, at, value, step = self.window, self.at, _VALUE, _STEP
        out = bytearray(count)
        try:
            for i in range(count):
                w = window[at]
                out[i] = value[w]
                at += step[w]
        except IndexError:
            raise ValueError("HCOMPRESS_1: the stream ends inside a code") from None
        self.at = at
        return np.frombuffer(bytes(out), np.uint8)

    def plane(self, shape: tuple[int, int]) -> np.ndarray:
        """The bits of one plane."""
        sizes, (mark,) = sizes_of(*shape), self.nybbles(1)
        if mark == 0:
            return spread(self.nybbles(sizes[0][0] * sizes[0][1]).reshape(sizes[0]), shape)
        if mark != 15:
            raise ValueError(f"HCOMPRESS_1: a plane begins with {mark}")
        level = self.codes(1).reshape(1, 1)
        for size in reversed(sizes[:-1]):
            flat = spread(level, size).reshape(-1).copy()
            some = np.flatnonzero(flat)[::-1]
            flat[some] = self.codes(len(some))
            level = flat.reshape(size)
        return spread(level, shape)


def decode(data: bytes, smooth: bool = False) -> np.ndarray:
    """The 2-D tile of a stream."""
    if len(data) < _HEAD.size:
        raise ValueError("HCOMPRESS_1: the stream ends inside its head")
    magic, n, m, scale, total, *planes = _HEAD.unpack_from(data)
    if magic != MAGIC or n < 1 or m < 1 or n * m > 1 << 34:
        raise ValueError("HCOMPRESS_1: not a stream of this codec")
    bits, a = Bits(data[_HEAD.size :]), np.zeros((n, m), np.int64)
    for rows, columns, kind in quarters(n, m):
        part = a[rows, columns]
        for bit in range(planes[kind] - 1, -1, -1):
            if part.size:
                part |= bits.plane(part.shape).astype(np.int64) << bit
    if bits.nybbles(1)[0]:
        raise ValueError("HCOMPRESS_1: no end where planes end")
    flat = a.reshape(-1)
    some = np.flatnonzero(flat)
    signs = bits.bits[-(-bits.at // 8) * 8 :][: len(some)]
    if len(signs) < len(some):
        raise ValueError("HCOMPRESS_1: the stream ends inside its signs")
    flat[some[signs == 1]] *= -1
    a[0, 0] = total
    if scale > 1:
        a *= scale
    return inverse(a, scale >> 1 if smooth else 0)
