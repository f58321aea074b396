"""Pixels of images as rows of axes and a value, in batches of whole lines of the slowest axis."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..sources import layout as L

BATCH_PIXELS = 500_000


def values(stored: np.ndarray, image: L.Image, scale: bool, mask: bool) -> pa.Array:
    """Stored pixels as values: blank pixels null where asked, then the integer trick or BSCALE and BZERO."""
    native = stored.astype(stored.dtype.newbyteorder("="))
    hidden = None
    if mask and image.blank is not None:
        if native.dtype.kind == "f":
            raise ValueError("BLANK marks integer pixels alone")
        hidden = native == image.blank
    if scale and image.trick:
        if image.stored == ">i8":
            from .rows import unsigned64

            out = unsigned64(native)
            if hidden is not None:
                import pyarrow.compute as pc

                out = pc.if_else(pa.array(~hidden), out, pa.scalar(None, out.type))
            return out
        wide = {"u1": np.int8, ">i2": np.int32, ">i4": np.int64}[image.stored]
        return pa.array((native.astype(np.int64) + int(image.zero)).astype(wide), mask=hidden)
    if scale and (image.scale != 1 or image.zero != 0):
        return pa.array(native.astype(np.float64) * image.scale + image.zero, mask=hidden)
    return pa.array(native.astype(np.int16) if native.dtype == np.uint8 else native, mask=hidden)


def pixel_batch(block: np.ndarray, origin: tuple[int, ...], image: L.Image, scale: bool, mask: bool) -> pa.RecordBatch:
    """A block of stored pixels; origin: place of its first one."""
    axes = np.unravel_index(np.arange(block.size), block.shape)
    places = [pa.array(a.astype(np.int64) + o) for a, o in zip(axes, origin, strict=True)]
    return pa.RecordBatch.from_arrays([*places, values(np.ascontiguousarray(block).reshape(-1), image, scale, mask)], names=[*(f"i{k}" for k in range(block.ndim)), "value"])


def batches(f, unit: L.Unit, lo: int, hi: int, base: int, scale: bool, mask: bool, box: tuple[tuple[int, int], ...] | None = None):
    """Pixels of lines lo .. hi - 1; box: (start, stop) on the other axes. base: lines of files before."""
    image = L.parse_image(unit)
    box = box or tuple((0, n) for n in image.shape[1:])
    starts = [a for a, _ in box]
    if any(a >= b for a, b in box):
        return
    if unit.kind == "zimage":
        from .tiles import lines

        for first, block in lines(f, unit, lo, hi, box):
            yield pixel_batch(block, (base + first, *starts), image, scale, mask)
        return
    line, size = int(np.prod(image.shape[1:], dtype=np.int64)), np.dtype(image.stored).itemsize
    step = max(1, BATCH_PIXELS // max(1, line))
    for a in range(lo, hi, step):
        n = min(hi, a + step) - a
        f.seek(image.data_offset + a * line * size)
        raw = f.read(n * line * size)
        if len(raw) != n * line * size:
            raise OSError("the file ends inside its pixels")
        block = np.frombuffer(raw, image.stored).reshape(n, *image.shape[1:])
        yield pixel_batch(block[(slice(None), *(slice(*x) for x in box))], (base + a, *starts), image, scale, mask)
