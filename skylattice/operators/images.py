"""Images out: pixel DataFrames to plain and tile-compressed images, tile by tile on executors."""

from __future__ import annotations

from itertools import chain
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tiles as TL
from ..functions.cards import Header
from ..functions.codecs import Codec
from ..functions.forms import primary
from ..functions.quantize import Quantize
from ..sources import storage
from .publish import Publication

#: Bytes of a file of an image's dataset.
SLAB_BYTES = 32 << 20
#: numpy's types by name, and the offsets that store the unsigned ones (and signed bytes).
KINDS = {"u1": ("u1", 0), "i1": ("u1", -128), "i2": ("i2", 0), "u2": ("i2", 1 << 15), "i4": ("i4", 0), "u4": ("i4", 1 << 31), "i8": ("i8", 0), "u8": ("i8", 1 << 63), "f4": ("f4", 0), "f8": ("f8", 0)}


def flat_place(shape: tuple[int, ...]):
    """A pixel's place in row-major order."""
    out = F.lit(0).cast("long")
    for k, n in enumerate(shape):
        out = out * n + F.col(f"i{k}")
    return out


def tile_number(shape: tuple[int, ...], tile: tuple[int, ...]):
    """The number of a pixel's tile, in row-major order of tiles."""
    out = F.lit(0).cast("long")
    for k, (n, t) in enumerate(zip(shape, tile, strict=True)):
        out = out * -(-n // t) + F.expr(f"i{k} div {t}")
    return out


def filled(value, kind: str, blank: int | None):
    """A pixel's value where it may be null: NaN of floats, the physical value of BLANK of integers, an error without one."""
    stored, zero = KINDS[kind]
    if stored in ("f4", "f8"):
        return F.coalesce(value, F.lit(float("nan")))
    if blank is None:
        return F.coalesce(value, F.raise_error(F.lit("null pixels of an integer image need a BLANK")).cast("int"))
    return F.coalesce(value, F.lit(blank + zero).cast("decimal(20,0)" if kind == "u8" else "long"))


def in_range(values: np.ndarray, stored: str) -> np.ndarray:
    """Values that a stored integer type holds; others are an error."""
    if len(values) and stored[0] != "f":
        info = np.iinfo(stored)
        if values.dtype.kind == "f" and not np.isfinite(values).all() or values.min() < info.min or values.max() > info.max:
            raise ValueError(f"a pixel outside of the stored type {stored}")
    return values


def encode_tiles(pixels: DataFrame, shape: tuple[int, ...], kind: str, codec: Codec, quantise: Quantize | None = None, blank: int | None = None, fixed: dict | None = None) -> tuple[DataFrame, tuple[int, ...]]:
    """((tile, data, fallback, scale, zero), tile shape): one group for each tile, encoded where it is gathered.

    fixed: (scale, zero) by tile, for tiles that are quantised as they were before.
    """
    stored, zero = KINDS[kind]
    pixels = pixels.withColumn("value", filled(F.col("value"), kind, blank))
    fixed = fixed or {}
    tile = codec.tile_shape or TL.default_tile(shape, codec)
    TL.check(codec, np.dtype(stored), bool(zero), quantise is not None, shape, tile)
    plan = TL.Tiled(None, None, shape, tile, codec, np.dtype(stored), 0, 1, None)

    def encode(key, table):
        k = key[0].as_py()
        box = plan.box(k)
        sizes = tuple(s.stop - s.start for s in box)
        at = np.ravel_multi_index(tuple(table.column(f"i{a}").to_numpy() - s.start for a, s in enumerate(box)), sizes)
        values = table.column("value").to_numpy()
        if zero:
            values = np.array([int(v) - zero for v in values], np.int64) if values.dtype == object else values.astype(np.int64) - zero
        block = np.zeros(prod(sizes), stored)
        block[at] = in_range(values, stored)
        got = TL.encode_tile(block.reshape(sizes), codec, quantise, k + 1, fixed.get(k))
        return pa.table({"tile": pa.array([k]), "data": pa.array([got.get("data")], pa.binary()), "fallback": pa.array([got.get("fallback")], pa.binary()), "scale": pa.array([got.get("scale")], pa.float64()), "zero": pa.array([got.get("zero")], pa.float64())})

    grouped = pixels.withColumn("__tile", tile_number(shape, tile)).groupBy("__tile")
    return grouped.applyInArrow(encode, "tile long, data binary, fallback binary, scale double, zero double"), tile


def write_slabs(pixels: DataFrame, path: str, shape: tuple[int, ...], kind: str, blank: int | None, step: int, unit) -> None:
    """A dataset of slabs of lines, ``step`` lines or a multiple each. unit: the chunks of a file from a block of stored pixels."""
    stored, zero = KINDS[kind]
    out, line = Publication(path), max(1, prod(shape[1:]))
    lines = max(1, SLAB_BYTES // (line * np.dtype(stored).itemsize * step)) * step
    # a last slab too short for a codec's tiles joins the one before
    slabs = max(1, -(-shape[0] // lines))
    if slabs > 1 and shape[0] - (slabs - 1) * lines < min(step, TL.HCOMPRESS_LEAST):
        slabs -= 1

    def write(key, table):
        k = key[0].as_py()
        first, last = k * lines, shape[0] if k == slabs - 1 else (k + 1) * lines
        values = table.column("value").to_numpy()
        if zero:
            values = np.array([int(v) - zero for v in values], np.int64) if values.dtype == object else values.astype(np.int64) - zero
        block = np.zeros((last - first) * line, stored)
        block[table.column("at").to_numpy() - first * line] = in_range(values, stored)
        storage.write_bytes(out.part(k), unit(block.reshape(last - first, *shape[1:])))
        return pa.table({"path": pa.array([out.part(k)])})

    rows = pixels.select(flat_place(shape).alias("at"), filled(F.col("value"), kind, blank).alias("value"), F.least(F.expr(f"i0 div {lines}"), F.lit(slabs - 1)).alias("slab"))
    out.publish(rows.groupBy("slab").applyInArrow(write, "path string"), slabs)


def write_compressed(pixels: DataFrame, path: str, shape: tuple[int, ...], kind: str, codec: Codec, quantise: Quantize | None = None, extname: str | None = None, blank: int | None = None, header: dict | None = None, dataset: bool = False) -> None:
    """A compressed image. Tiles are encoded on executors; the driver joins their bytes in order, as one file asks.

    dataset: a folder of images of some lines each, of whole tiles, written by tasks; it reads as one image.
    """
    if dataset:
        tile = codec.tile_shape or TL.default_tile(shape, codec)
        TL.check(codec, np.dtype(KINDS[kind][0]), bool(KINDS[kind][1]), quantise is not None, shape, tile)

        def unit(block: np.ndarray) -> list[bytes]:
            plan = TL.Tiled(None, None, block.shape, tile, codec, block.dtype, 0, 1, None)
            made = TL.Unit(block.shape, tile, block.dtype, codec, quantise)
            heap = [made.add(TL.encode_tile(np.ascontiguousarray(block[plan.box(k)]), codec, quantise, k + 1)) for k in range(prod(plan.grid))]
            return [primary(), *made.chunks(heap, KINDS[kind][1], extname, blank, header)]

        write_slabs(pixels, path, shape, kind, blank, tile[0], unit)
        return
    encoded, tile = encode_tiles(pixels, shape, kind, codec, quantise, blank)
    stored, zero = KINDS[kind]
    made, heap, expected = TL.Unit(shape, tile, np.dtype(stored), codec, quantise), f"{path}.{Publication(path).run}.heap", 0
    with storage.open_write(heap) as out:
        for r in encoded.orderBy("tile").toLocalIterator():
            if r["tile"] != expected:
                break
            out.write(made.add({k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items() if v is not None}))
            expected += 1
    try:
        if expected != prod(-(-n // t) for n, t in zip(shape, tile, strict=True)):
            raise ValueError(f"no pixels of tile {expected}")
        storage.write_bytes(path, chain([primary()], made.chunks(storage.ranges(heap, 0, made.heap), zero, extname, blank, header)))
    finally:
        storage.remove(heap)


def image_header(shape: tuple[int, ...], kind: str, extname: str | None = None, blank: int | None = None, header: dict | None = None, first: bool = True, scale: tuple[float, float] | None = None) -> Header:
    stored, zero = KINDS[kind]
    h = Header()
    puts: list[tuple] = [("SIMPLE", True)] if first else [("XTENSION", "IMAGE")]
    puts += [("BITPIX", TL.BITPIX[stored]), ("NAXIS", len(shape))] + [(f"NAXIS{k}", n) for k, n in enumerate(reversed(shape), 1)]
    puts += [("EXTEND", True)] if first else [("PCOUNT", 0), ("GCOUNT", 1)]
    if zero:
        puts += [("BSCALE", 1), ("BZERO", zero)]
    if scale:
        puts += [("BSCALE", scale[0]), ("BZERO", scale[1])]
    if blank is not None:
        puts.append(("BLANK", blank))
    if extname:
        puts.append(("EXTNAME", extname))
    for k, v in puts:
        h.put(k, v)
    h.update(header or {})
    return h


def write_image(pixels: DataFrame, path: str, shape: tuple[int, ...], kind: str, extname: str | None = None, blank: int | None = None, header: dict | None = None, scale: tuple[float, float] | None = None, first: bool = True, dataset: bool = False) -> None:
    """A plain image (first: as a primary unit): lines are gathered in order on executors and joined by the driver. With ``scale``, values are physical.

    dataset: a folder of images of some lines each, written by tasks; it reads as one image.
    """
    stored, zero = KINDS[kind]
    if dataset:
        if scale:
            pixels = pixels.withColumn("value", (F.col("value") - F.lit(float(scale[1]))) / F.lit(float(scale[0])))
            pixels = pixels if stored[0] == "f" else pixels.withColumn("value", F.bround("value", 0))

        def unit(block: np.ndarray) -> list[bytes]:
            data = block.astype(block.dtype.newbyteorder(">")).tobytes()
            return [image_header(block.shape, kind, extname, blank, header, True, scale).to_bytes(), data, bytes(-len(data) % 2880)]

        write_slabs(pixels, path, shape, kind, blank, 1, unit)
        return
    value = F.col("value")
    if scale:
        value = (value - F.lit(float(scale[1]))) / F.lit(float(scale[0]))
        value = F.bround(value, 0) if stored[0] != "f" else value
    value = filled(value, kind, blank)
    rows = pixels.select(flat_place(shape).alias("at"), value.alias("value"))
    line = max(1, prod(shape[1:]))
    size = np.dtype(stored).itemsize
    lines = max(1, (4 << 20) // (line * size))

    def gather(key, table):
        first_at = key[0].as_py() * lines * line
        n = min(prod(shape), first_at + lines * line) - first_at
        values = table.column("value").to_numpy()
        if zero:
            values = np.array([int(v) - zero for v in values], np.int64)
        block = np.zeros(n, np.dtype(stored).newbyteorder(">"))
        block[table.column("at").to_numpy() - first_at] = in_range(values, stored)
        return pa.table({"part": pa.array([key[0].as_py()]), "data": pa.array([block.tobytes()], pa.binary())})

    parts = rows.groupBy(F.expr(f"at div {lines * line}").alias("part")).applyInArrow(gather, "part long, data binary")

    def chunks():
        yield image_header(shape, kind, extname, blank, header, first, scale).to_bytes()
        total, each, at = prod(shape) * size, lines * line * size, 0
        for r in parts.orderBy("part").toLocalIterator():
            yield bytes(r["part"] * each - at)  # lines without a pixel are zero
            yield bytes(r["data"])
            at = r["part"] * each + len(r["data"])
        yield bytes(total - at)
        yield bytes(-total % 2880)

    if first:
        storage.write_bytes(path, chunks())
    else:
        storage.write_bytes(path, chain([primary()], chunks()))
