"""Images changed in their files: sections set, lines added, compressed ones repacked. Only lines or tiles that change are encoded.

Pixels are DataFrames of axes and a value. Executors encode the touched lines or tiles; the driver joins their bytes with the
file's own, which it copies some at a time. A compressed tile's new bytes go after the heap, and the old ones stay there until
a repack. A quantised tile keeps its scale. Stale sums (DATASUM, CHECKSUM) of a changed unit are taken out of its header.
"""

from __future__ import annotations

import re
from math import prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quantize as Q
from ..functions import tiles as TL
from ..functions.cards import Header
from ..functions.codecs import Codec
from ..sources import layout as L
from ..sources import storage
from . import catalog, images

SUMS = ("DATASUM", "CHECKSUM", "ZDATASUM", "ZHECKSUM")
DATA = ("COMPRESSED_DATA", "GZIP_COMPRESSED_DATA", "UNCOMPRESSED_DATA")


def pixel_kind(image: L.Image) -> str:
    """numpy's name of the values of an image's pixels, before a general scale."""
    if image.trick:
        return {"u1": "i1", ">i2": "u2", ">i4": "u4", ">i8": "u8"}[image.stored]
    return image.stored.lstrip(">")


def is_scaled(image: L.Image) -> bool:
    return not image.trick and (image.scale != 1 or image.zero != 0)


def to_stored(value, image: L.Image):
    """Physical values as stored ones, where a general scale is between them."""
    if not is_scaled(image):
        return value
    out = (value.cast("double") - F.lit(float(image.zero))) / F.lit(float(image.scale))
    return out if image.stored in (">f4", ">f8") else F.bround(out, 0)


def bounds(key, shape: tuple[int, ...]) -> list[tuple[int, int, int, bool]]:
    """(start, stop, step, kept in the section) of each axis: numbers drop an axis, slices keep it, an ellipsis fills up."""
    key = key if isinstance(key, tuple) else (key,)
    if sum(k is Ellipsis for k in key) > 1:
        raise IndexError("more than one ellipsis")
    if Ellipsis in key:
        at = key.index(Ellipsis)
        key = key[:at] + (slice(None),) * (len(shape) - len(key) + 1) + key[at + 1 :]
    if len(key) > len(shape):
        raise IndexError("more indices than axes")
    out = []
    for want, size in zip(key + (slice(None),) * (len(shape) - len(key)), shape, strict=True):
        if isinstance(want, int) and not isinstance(want, bool):
            if not -size <= want < size:
                raise IndexError(f"{want} outside of an axis of {size}")
            out.append((want % size, want % size + 1, 1, False))
        elif isinstance(want, slice) and (want.step is None or want.step > 0):
            out.append((*want.indices(size), True))
        else:
            raise TypeError("an axis takes a number or a slice forwards")
    return out


def overlaid(base: DataFrame, box: list[tuple[int, int, int, bool]], value, image: L.Image) -> DataFrame:
    """Stored pixels with a section set to one value, or to a DataFrame of just its pixels (axes of the section from 0)."""
    kind = base.schema["value"].dataType
    inside = F.lit(True)
    for k, (start, stop, step, _) in enumerate(box):
        inside &= (F.col(f"i{k}") >= start) & (F.col(f"i{k}") < stop) & (F.pmod(F.col(f"i{k}") - start, F.lit(step)) == 0)
    if not isinstance(value, DataFrame):
        new = to_stored(value if hasattr(value, "_jc") else F.lit(value), image).cast(kind)
        return base.withColumn("value", F.when(inside, new).otherwise(F.col("value")))
    kept = [k for k, b in enumerate(box) if b[3]]
    wanted = [len(range(*box[k][:3])) for k in kept]
    axes = [f"i{k}" for k in range(len(kept))]
    if set(value.columns) != {*axes, "value"}:
        raise ValueError(f"pixels of this section have the columns {axes} and value")
    within = F.lit(True)
    for a, n in zip(axes, wanted, strict=True):
        within &= F.col(a).between(0, n - 1)
    told = value.agg(F.count(F.lit(1)), F.count_distinct(*axes) if axes else F.lit(1), F.sum(F.when(within, 0).otherwise(1))).first()
    if told[0] != prod(wanted) or told[1] != told[0] or told[2]:
        raise ValueError(f"the section has {prod(wanted)} pixels of shape {tuple(wanted)}")
    at = {k: F.col(f"i{n}") * box[k][2] + box[k][0] for n, k in enumerate(kept)}
    # nulls of value are pixels without a value; a struct tells them from pixels outside of the section
    new = value.select(*(at.get(k, F.lit(box[k][0])).cast("long").alias(f"i{k}") for k in range(len(box))), F.struct(to_stored(F.col("value"), image).cast(kind).alias("value")).alias("__new"))
    out = base.join(new, [f"i{k}" for k in range(len(box))], "left")
    return out.select(*(f"i{k}" for k in range(len(box))), F.when(F.col("__new").isNotNull(), F.col("__new.value")).otherwise(F.col("value")).alias("value"))


def padding(n: int) -> bytes:
    return bytes(-n % 2880)


def changed(header: Header, **puts) -> Header:
    out = header.copy()
    out.drop(*SUMS)
    for k, v in puts.items():
        out.put(k, v)
    return out


class ImageFile:
    """One image of a local, shared or in-memory file. read(scale) gives its pixels; part() a new path for files on the way."""

    def __init__(self, path: str, index: int, read, part):
        self.path, self.part, units = path, part, catalog.units(path)
        self.unit, self.end = units[index], units[-1].data_offset + units[-1].padded
        self.image = L.parse_image(self.unit)
        self.pixels = read(not is_scaled(self.image))
        self.kind, self.shape = pixel_kind(self.image), self.unit.shape

    def _replace(self, header: Header, data) -> None:
        """The file with the unit's header and data (chunks, padded) in place of its own."""

        def chunks():
            yield from storage.ranges(self.path, 0, self.unit.header_offset)
            yield header.to_bytes()
            yield from data
            yield from storage.ranges(self.path, self.unit.data_offset + self.unit.padded, self.end)

        storage.write_bytes(self.path, chunks())

    def _lines(self, pixels: DataFrame, n: int) -> tuple[str, int]:
        """(file, place) of the stored bytes of n lines."""
        part = self.part()
        images.write_image(pixels, part, (n, *self.shape[1:]), self.kind, blank=self.image.blank)
        return part, catalog.units(part)[0].data_offset

    @property
    def line_bytes(self) -> int:
        return prod(self.shape[1:]) * np.dtype(self.image.stored).itemsize

    def set(self, key, value) -> None:
        box = bounds(key, self.shape)
        if any(start >= stop for start, stop, _, _ in box):
            return
        if self.unit.kind == "zimage":
            return self._set_tiles(box, value)
        lo, hi = box[0][0], box[0][1]
        base = self.pixels.filter((F.col("i0") >= lo) & (F.col("i0") < hi))
        part, at = self._lines(overlaid(base, box, value, self.image).withColumn("i0", F.col("i0") - lo), hi - lo)
        first, size, start = self.unit.data_offset, self.line_bytes, self.unit.data_offset + lo * self.line_bytes

        def data():
            yield from storage.ranges(self.path, first, start)
            yield from storage.ranges(part, at, at + (hi - lo) * size)
            yield from storage.ranges(self.path, first + hi * size, first + self.unit.padded)

        self._replace(changed(self.unit.header), data())
        storage.remove(part)

    def extend(self, more: DataFrame, lines: int | None = None, start: int | None = None) -> None:
        """Lines after the image's own, or from ``start`` on over some of them. more: axes from 0."""
        if set(more.columns) != {f"i{k}" for k in range(len(self.shape))} | {"value"}:
            raise ValueError("pixels have the image's axes and a value")
        tops = more.agg(*(F.max(f"i{k}") for k in range(len(self.shape)))).first()
        lines = lines if lines is not None else (tops[0] if tops[0] is not None else -1) + 1
        if tops[0] is not None and (tops[0] >= lines or any(t >= n for t, n in zip(tops[1:], self.shape[1:], strict=True))):
            raise ValueError("pixels outside of the image's lines")
        old = self.shape[0]
        start = old if start is None else start
        if not 0 <= start <= old:
            raise ValueError(f"lines follow one another: start is at most {old}")
        if not lines:
            return
        new, slow = max(old, start + lines), len(self.shape)
        more = more.withColumn("value", to_stored(F.col("value"), self.image).cast(self.pixels.schema["value"].dataType))
        if self.unit.kind == "zimage":
            if start != old:
                raise ValueError("lines of a compressed image are added at its end; set those that are there")
            return self._extend_tiles(more, new)
        part, at = self._lines(more, lines)
        first, size = self.unit.data_offset, self.line_bytes

        def data():
            yield from storage.ranges(self.path, first, first + start * size)
            yield from storage.ranges(part, at, at + lines * size)
            yield from storage.ranges(self.path, first + min(old, start + lines) * size, first + old * size)
            yield padding(new * size)

        self._replace(changed(self.unit.header, **{f"NAXIS{slow}": new}), data())
        storage.remove(part)

    # Compressed images

    def _table(self, tiled: TL.Tiled) -> np.ndarray:
        """The rows of the tiles' table, as bytes."""
        t = tiled.table
        if t.heap_offset != t.data_offset + t.rows * t.width:
            raise ValueError("a heap that doesn't follow its table isn't rewritten")
        return np.frombuffer(b"".join(storage.ranges(self.path, t.data_offset, t.heap_offset)), np.uint8).reshape(t.rows, t.width).copy()

    @staticmethod
    def _cells(table: np.ndarray, c: L.Column) -> np.ndarray:
        """A column's cells as numbers; descriptors as pairs of count and offset."""
        kind = {"P": ">i4", "Q": ">i8"}.get(c.letter) or L.STORED[c.letter]
        cells = np.ascontiguousarray(table[:, c.offset : c.offset + c.width]).view(kind)
        return cells.reshape(len(table), -1)

    @staticmethod
    def _put_cells(table: np.ndarray, c: L.Column, cells: np.ndarray) -> None:
        kind = {"P": ">i4", "Q": ">i8"}.get(c.letter) or L.STORED[c.letter]
        if c.letter == "P" and cells.size and int(cells.max()) >= 1 << 31:
            raise ValueError("the heap outgrows 32-bit descriptors")
        table[:, c.offset : c.offset + c.width] = np.ascontiguousarray(cells.astype(kind)).view(np.uint8).reshape(len(table), c.width)

    def _set_tiles(self, box, value) -> None:
        tiled = TL.parse_tiles(self.unit)
        lows = [start // t * t for (start, _, _, _), t in zip(box, tiled.tile, strict=True)]
        highs = [min(n, -(-stop // t) * t) for (_, stop, _, _), t, n in zip(box, tiled.tile, self.shape, strict=True)]
        base = self.pixels
        for k, (lo, hi) in enumerate(zip(lows, highs, strict=True)):  # whole tiles; bounds reach the reader
            base = base.filter((F.col(f"i{k}") >= lo) & (F.col(f"i{k}") < hi))
        self._put_tiles(tiled, overlaid(base, box, value, self.image), self.shape)

    def _extend_tiles(self, more: DataFrame, new: int) -> None:
        tiled, old = TL.parse_tiles(self.unit), self.shape[0]
        edge = old // tiled.tile[0] * tiled.tile[0]
        moved = more.select((F.col("i0") + old).alias("i0"), *(f"i{k}" for k in range(1, len(self.shape))), "value")
        pixels = self.pixels.filter(F.col("i0") >= edge).unionByName(moved) if edge < old else moved
        self._put_tiles(tiled, pixels, (new, *self.shape[1:]))

    def _put_tiles(self, tiled: TL.Tiled, pixels: DataFrame, shape: tuple[int, ...]) -> None:
        """Tiles of the pixels encoded, their bytes after the heap, and the table's rows of these tiles changed."""
        h, table, by_name = self.unit.header, self._table(tiled), tiled.table.by_name
        floats = tiled.pixel.kind == "f" and "ZSCALE" in by_name
        settings = Q.Quantize(4.0, {0: "none", 1: "dither1", 2: "dither2"}[tiled.method], tiled.seed) if floats else None
        fixed = {}
        if floats:
            have = self._cells(table, by_name["COMPRESSED_DATA"])[:, 0] > 0
            scale, zero = (self._cells(table, by_name[c])[:, 0] for c in ("ZSCALE", "ZZERO"))
            fixed = {int(k): (float(scale[k]), float(zero[k])) for k in np.flatnonzero(have)}
        c = tiled.codec
        codec = Codec(c.name, c.level, c.blocksize, c.scale, c.smooth, tiled.tile)
        encoded, _ = images.encode_tiles(pixels, shape, self.kind, codec, settings, None if floats else self.image.blank, fixed)
        rows = prod(-(-n // t) for n, t in zip(shape, tiled.tile, strict=True))
        table = np.concatenate([table, np.zeros((rows - len(table), table.shape[1]), np.uint8)])
        cells = {name: self._cells(table, by_name[name]).astype(np.int64) for name in DATA if name in by_name}
        numbers = {name: self._cells(table, by_name[name]).copy() for name in ("ZSCALE", "ZZERO") if name in by_name}
        t = tiled.table
        heap, part = h["PCOUNT"], self.part()
        size, done = heap, np.zeros(rows, bool)
        done[: t.rows] = True
        with storage.open_write(part) as out:
            for r in encoded.orderBy("tile").toLocalIterator():
                k, name = r["tile"], "COMPRESSED_DATA" if r["data"] is not None else "GZIP_COMPRESSED_DATA"
                if name not in cells:
                    raise ValueError(f"tile {k} can't be quantised, and the image has no column {name}")
                data, done[k] = bytes(r["data"] if r["data"] is not None else r["fallback"]), True
                for other in cells.values():
                    other[k] = 0
                cells[name][k] = len(data) // L.ELEMENT[by_name[name].inner], size
                for column, v in (("ZSCALE", r["scale"]), ("ZZERO", r["zero"])):
                    if column in numbers:
                        numbers[column][k] = v or 0.0
                out.write(data)
                size += len(data)
        if not done.all():
            raise ValueError(f"no pixels of tile {int(np.flatnonzero(~done)[0])}")
        puts = {"NAXIS2": rows, "PCOUNT": size, f"ZNAXIS{len(shape)}": shape[0]}
        for name, values in cells.items():
            self._put_cells(table, by_name[name], values)
            place = next(k for k in range(1, h["TFIELDS"] + 1) if str(h[f"TTYPE{k}"]).strip().upper() == name)
            puts[f"TFORM{place}"] = re.sub(r"\(\d+\)", f"({int(values[:, 0].max(initial=0))})", str(h[f"TFORM{place}"]))
        for name, values in numbers.items():
            self._put_cells(table, by_name[name], values)

        def data():
            yield table.tobytes()
            yield from storage.ranges(self.path, t.heap_offset, t.heap_offset + heap)
            if size > heap:
                yield from storage.ranges(part, 0, size - heap)
            yield padding(table.size + size)

        self._replace(changed(h, **puts), data())
        storage.remove(part)

    def repack(self) -> None:
        """Bytes that no tile refers to go out of the heap; a plain image has none."""
        if self.unit.kind != "zimage":
            return
        tiled = TL.parse_tiles(self.unit)
        table, t = self._table(tiled), tiled.table
        columns = [c for c in t.columns if c.inner]
        cells = [self._cells(table, c).astype(np.int64) for c in columns]
        sizes = np.stack([x[:, 0] * L.ELEMENT[c.inner] for x, c in zip(cells, columns, strict=True)], 1)  # by tile, then column
        old = np.stack([x[:, 1] for x in cells], 1)
        new = (np.cumsum(sizes) - sizes.reshape(-1)).reshape(sizes.shape)
        for k, (c, x) in enumerate(zip(columns, cells, strict=True)):
            x[:, 1] = np.where(sizes[:, k] > 0, new[:, k], 0)
            self._put_cells(table, c, x)
        total = int(sizes.sum())

        def data():
            yield table.tobytes()
            with storage.open_read(self.path) as f:
                for at, n in zip(old.reshape(-1).tolist(), sizes.reshape(-1).tolist(), strict=True):
                    if n:
                        f.seek(t.heap_offset + at)
                        yield f.read(n)
            yield padding(table.size + total)

        self._replace(changed(self.unit.header, PCOUNT=total), data())
