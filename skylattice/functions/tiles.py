"""Tile-compressed images: geometry, tiles' payloads, decoding by lines, and writing."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np

from ..sources import layout as L
from . import quantize as Q
from .cards import Header
from .codecs import Codec, decode_many, encode, gunzip

#: Pixels of tiles that are decoded together.
BATCH_PIXELS = 500_000

#: BITPIX of numpy types.
BITPIX = {"u1": 8, "i2": 16, "i4": 32, "i8": 64, "f4": -32, "f8": -64}


@dataclass
class Tiled:
    """A compressed image: its tiles' shape (slowest axis first) and where each tile's data lie."""

    unit: L.Unit
    table: L.Table
    shape: tuple[int, ...]
    tile: tuple[int, ...]
    codec: Codec
    pixel: np.dtype
    method: int
    seed: int
    blank: int | None

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(-(-n // t) for n, t in zip(self.shape, self.tile, strict=True))

    def box(self, k: int) -> tuple[slice, ...]:
        """Tile k's pixels; tiles at the edges are cut."""
        at = np.unravel_index(k, self.grid)
        return tuple(slice(int(a) * t, min(n, (int(a) + 1) * t)) for a, t, n in zip(at, self.tile, self.shape, strict=True))


def parse_tiles(unit: L.Unit) -> Tiled:
    h = unit.header
    shape = unit.shape
    n = len(shape)
    tile = tuple(h.get(f"ZTILE{k}", h.get("ZNAXIS1") if k == 1 else 1) for k in range(n, 0, -1))
    settings = {str(h[f"ZNAME{k}"]).upper(): h[f"ZVAL{k}"] for k in range(1, 20) if f"ZNAME{k}" in h}
    codec = Codec(str(h["ZCMPTYPE"]).strip(), blocksize=int(settings.get("BLOCKSIZE", 32)), scale=int(settings.get("SCALE", 0)), smooth=bool(settings.get("SMOOTH", 0)))
    bitpix = h["ZBITPIX"]
    kind = np.dtype(L.PIXELS[bitpix]).newbyteorder("=")
    name = str(h.get("ZQUANTIZ", "NONE")).strip().upper()
    blank = h.get("ZBLANK")
    plain = L.Unit(unit.index, h, unit.header_offset, unit.data_offset, unit.data_size)
    table = _descriptors(plain)
    out = Tiled(unit, table, shape, tile, codec, kind, Q.METHODS.get(name, 0), int(h.get("ZDITHER0", 1) or 1), blank if isinstance(blank, int) else None)
    if table.rows != prod(out.grid):
        raise ValueError(f"{table.rows} tiles instead of {prod(out.grid)}")
    return out


def _descriptors(unit: L.Unit) -> L.Table:
    """The table of tiles, read as a plain table."""
    h, columns, offset = unit.header, [], 0
    for k in range(1, h["TFIELDS"] + 1):
        repeat, letter, inner = L.parse_tform(str(h[f"TFORM{k}"]))
        width = repeat * L.ELEMENT[letter]
        columns.append(L.Column(str(h[f"TTYPE{k}"]).strip(), letter, repeat, offset, width, inner))
        offset += width
    heap = unit.data_offset + (h.get("THEAP", 0) or h["NAXIS1"] * h["NAXIS2"])
    return L.Table(h["NAXIS2"], h["NAXIS1"], columns, unit.data_offset, heap)


def payloads(f, tiled: Tiled, wanted: np.ndarray) -> list[dict]:
    """Of the wanted tiles (numbers, ascending): the first filled data column by precedence, and the tile's scale, zero and blank."""
    from ..sources.fits import heap_cells

    t, parts = tiled.table, []
    for run in np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1):
        f.seek(t.data_offset + int(run[0]) * t.width)
        parts.append(f.read(len(run) * t.width))
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(len(wanted), t.width)
    out: list[dict] = [{} for _ in range(len(wanted))]
    for name in ("COMPRESSED_DATA", "GZIP_COMPRESSED_DATA", "UNCOMPRESSED_DATA"):
        c = t.by_name.get(name)
        if c is None:
            continue
        counts, heap, starts = heap_cells(f, t, c, np.ascontiguousarray(raw[:, c.offset : c.offset + c.width]))
        size = counts * L.ELEMENT[c.inner]
        for i, (s, n) in enumerate(zip(starts.tolist(), size.tolist(), strict=True)):
            if n and "data" not in out[i]:
                out[i] |= {"data": heap[s : s + n].tobytes(), "from": name}
    for name, key in (("ZSCALE", "scale"), ("ZZERO", "zero"), ("ZBLANK", "blank")):
        c = t.by_name.get(name)
        if c is not None:
            kind = L.STORED[c.letter]
            for i, v in enumerate(np.ascontiguousarray(raw[:, c.offset : c.offset + c.width]).view(kind).reshape(-1).tolist()):
                out[i][key] = v
    return out


def decode_tiles(f, tiled: Tiled, wanted: np.ndarray) -> list[np.ndarray]:
    """Native pixels of the wanted tiles (numbers, ascending), each in its own shape."""
    found = payloads(f, tiled, wanted)
    boxes = [tiled.box(int(k)) for k in wanted]
    shapes = [tuple(s.stop - s.start for s in b) for b in boxes]
    counts = np.array([prod(s) for s in shapes])
    is_float = tiled.pixel.kind == "f"
    out: list[np.ndarray | None] = [None] * len(found)
    main = [i for i, p in enumerate(found) if p.get("from") == "COMPRESSED_DATA"]
    quantised = [i for i in main if is_float and "scale" in found[i] and tiled.unit.header.get("ZQUANTIZ", "NONE") != "NONE"]
    for group, kind in ((quantised, np.dtype(np.int32)), ([i for i in main if i not in set(quantised)], tiled.pixel)):
        if group:
            for i, values in zip(group, decode_many([found[i]["data"] for i in group], tiled.codec, kind, counts[group]), strict=True):
                if kind == tiled.pixel:
                    out[i] = values
                else:
                    blank = found[i].get("blank", tiled.blank)
                    out[i] = Q.restore(values, found[i]["scale"], found[i].get("zero", 0.0), tiled.method, int(wanted[i]) + 1, tiled.seed, tiled.pixel, Q.NULL if blank is None else int(blank))
    for i, p in enumerate(found):
        if out[i] is None:
            if "data" not in p:
                raise ValueError(f"tile {int(wanted[i])} has no data")
            raw = gunzip(p["data"]) if p["from"] == "GZIP_COMPRESSED_DATA" else p["data"]
            out[i] = np.frombuffer(raw, tiled.pixel.newbyteorder(">")).astype(tiled.pixel)
    return [v.reshape(s) for v, s in zip(out, shapes, strict=True)]


def lines(f, unit: L.Unit, lo: int, hi: int, box: tuple[tuple[int, int], ...] | None = None):
    """(first line, block) of lines lo .. hi - 1, cut to ``box`` on the other axes: only tiles that hold some of it are decoded."""
    tiled = parse_tiles(unit)
    box = box or tuple((0, n) for n in tiled.shape[1:])
    held = [np.arange(a // t, -(-b // t)) for (a, b), t in zip(box, tiled.tile[1:], strict=True)]  # tiles along each other axis
    across = np.zeros(1, np.int64)
    for own, n in zip(held, tiled.grid[1:], strict=True):
        across = (across[:, None] * n + own).reshape(-1)
    each = prod(tiled.grid[1:])
    origin = [int(own[0]) * t for own, t in zip(held, tiled.tile[1:], strict=True)]
    wide = [min(n, (int(own[-1]) + 1) * t) - o for own, t, n, o in zip(held, tiled.tile[1:], tiled.shape[1:], origin, strict=True)]
    step = tiled.tile[0]
    last = -(-hi // step)
    together = max(1, BATCH_PIXELS // max(1, step * prod(wide)))
    inside = tuple(slice(a - o, b - o) for (a, b), o in zip(box, origin, strict=True))
    for row in range(lo // step, last, together):
        end = min(last, row + together)
        top, bottom = row * step, min(tiled.shape[0], end * step)
        block = np.empty((bottom - top, *wide), tiled.pixel)
        wanted = (np.arange(row, end)[:, None] * each + across).reshape(-1)
        for k, values in zip(wanted.tolist(), decode_tiles(f, tiled, wanted), strict=True):
            at = tiled.box(k)
            block[(slice(at[0].start - top, at[0].stop - top), *(slice(x.start - o, x.stop - o) for x, o in zip(at[1:], origin, strict=True)))] = values
        a, b = max(lo, top), min(hi, bottom)
        yield a, block[(slice(a - top, b - top), *inside)]


#: Lines of a tile of HCOMPRESS_1, by preference, the last resort, and the fewest pixels that an axis of a tile has.
HCOMPRESS_LINES, HCOMPRESS_LAST, HCOMPRESS_LEAST = (16, 24, 20, 30, 28, 26, 22, 18, 14), 17, 4


def default_tile(shape: tuple[int, ...], codec: Codec | None = None) -> tuple[int, ...]:
    """A line; of HCOMPRESS_1 several whole lines, so that the last tile has enough of them too."""
    if codec is None or codec.name != "HCOMPRESS_1" or len(shape) < 2:
        return (*(1 for _ in shape[:-1]), shape[-1])
    n = shape[-2]
    lines = n if n <= max(HCOMPRESS_LINES) else next((t for t in HCOMPRESS_LINES if n % t == 0 or n % t >= HCOMPRESS_LEAST), HCOMPRESS_LAST)
    return (*(1 for _ in shape[:-2]), lines, shape[-1])


def check(codec: Codec, kind: np.dtype, trick: bool, quantised: bool, shape: tuple[int, ...] = (), tile: tuple[int, ...] = ()) -> None:
    """Which codecs store which pixels, in which tiles."""
    if codec.name == "HCOMPRESS_1":
        if kind.itemsize == 8 and kind.kind != "f":
            raise ValueError("HCOMPRESS_1 stores no 64-bit integers")
        if len(shape) != 2 or any(t < HCOMPRESS_LEAST or 0 < n % t < HCOMPRESS_LEAST for n, t in zip(shape, tile, strict=True)):
            raise ValueError(f"HCOMPRESS_1 stores images of two axes, in tiles of {HCOMPRESS_LEAST} pixels or more each way")
    if kind.kind == "f" and not quantised and codec.name not in ("GZIP_1", "GZIP_2"):
        raise ValueError(f"{codec.name} stores floats only when they are quantised")
    if codec.name == "PLIO_1" and (kind.kind == "f" and not quantised or kind.itemsize == 8 or trick):
        raise ValueError("PLIO_1 stores integers of up to 32 bits that aren't unsigned by an offset")
    if codec.name == "RICE_1" and kind.itemsize == 8 and kind.kind != "f":
        raise ValueError("RICE_1 stores no 64-bit integers")
    if quantised and kind.kind != "f":
        raise ValueError("integers aren't quantised")


def encode_tile(tile: np.ndarray, codec: Codec, quantised: Q.Quantize | None, row: int, fixed: tuple[float, float] | None = None) -> dict:
    """One tile's row: data (or fallback), scale and zero. row counts from 1; fixed: the scale and zero to use."""
    if tile.dtype.kind == "f" and quantised is not None:
        if fixed is not None and fixed[0]:
            stored = Q.store(tile.reshape(-1).astype(np.float64), *fixed, quantised.number, quantised.seed, row)
            return {"data": encode(stored, codec, tile.shape), "scale": fixed[0], "zero": fixed[1]}
        got = Q.quantise(tile, quantised, row)
        if got is None:
            return {"fallback": encode(tile, Codec("GZIP_1"))}
        return {"data": encode(got[0], codec, tile.shape), "scale": got[1], "zero": got[2]}
    return {"data": encode(tile, codec, tile.shape)}


class Unit:
    """A compressed image's unit, made tile by tile in order: bytes go to its heap one after another, and only descriptors are kept."""

    def __init__(self, shape: tuple[int, ...], tile: tuple[int, ...], kind: np.dtype, codec: Codec, quantised: Q.Quantize | None):
        self.shape, self.tile, self.kind, self.codec, self.quantised = shape, tile, kind, codec, quantised
        self.floats = quantised is not None
        self.main, self.heap, self.tiles, self.longest = bytearray(), 0, 0, {"data": 0, "fallback": 0}

    def add(self, encoded: dict) -> bytes:
        """The heap's bytes of the next tile, as encode_tile() gives it."""
        out = b""
        for key in ("data", "fallback") if self.floats else ("data",):
            data = encoded.get(key) or b""
            self.main += np.array([len(data), self.heap if data else 0], ">i8").tobytes()
            self.heap += len(data)
            self.longest[key] = max(self.longest[key], len(data))
            out += data
        if self.floats:
            self.main += np.array([encoded.get("scale") or 0.0, encoded.get("zero") or 0.0], ">f8").tobytes()
        self.tiles += 1
        return out

    def chunks(self, heap, zero: int = 0, extname: str | None = None, blank: int | None = None, header: dict | None = None):
        """The unit's bytes. heap: what add() gave, in order. Descriptors are of 32 bits where the heap allows."""
        letter, narrow = ("P", ">i4") if self.heap < 1 << 31 else ("Q", ">i8")
        pairs = 2 if self.floats else 1
        rows = np.frombuffer(bytes(self.main), np.uint8).reshape(self.tiles, -1)
        places = np.ascontiguousarray(rows[:, : 16 * pairs]).view(">i8").astype(narrow)
        main = np.concatenate([np.ascontiguousarray(places).view(np.uint8).reshape(self.tiles, -1), rows[:, 16 * pairs :]], axis=1)
        names = [("COMPRESSED_DATA", f"1{letter}B({self.longest['data']})")] + ([("GZIP_COMPRESSED_DATA", f"1{letter}B({self.longest['fallback']})"), ("ZSCALE", "1D"), ("ZZERO", "1D")] if self.floats else [])
        codec, h = self.codec, Header()
        puts = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", main.shape[1]), ("NAXIS2", self.tiles), ("PCOUNT", self.heap), ("GCOUNT", 1), ("TFIELDS", len(names))]
        for k, (name, form) in enumerate(names, 1):
            puts += [(f"TTYPE{k}", name), (f"TFORM{k}", form)]
        puts += [("ZIMAGE", True), ("ZCMPTYPE", codec.name), ("ZBITPIX", BITPIX[self.kind.str.lstrip("<>|=")]), ("ZNAXIS", len(self.shape))]
        puts += [(f"ZNAXIS{k}", n) for k, n in enumerate(reversed(self.shape), 1)] + [(f"ZTILE{k}", n) for k, n in enumerate(reversed(self.tile), 1)]
        if codec.name == "HCOMPRESS_1":
            puts += [("ZNAME1", "SCALE"), ("ZVAL1", codec.scale), ("ZNAME2", "SMOOTH"), ("ZVAL2", int(codec.smooth))]
        if codec.name == "RICE_1":
            puts += [("ZNAME1", "BLOCKSIZE"), ("ZVAL1", codec.blocksize), ("ZNAME2", "BYTEPIX"), ("ZVAL2", 4 if self.floats else self.kind.itemsize)]
        if self.floats:
            puts += [("ZQUANTIZ", self.quantised.zquantiz), ("ZDITHER0", max(1, self.quantised.seed)), ("ZBLANK", Q.NULL)]
        elif blank is not None:
            puts.append(("ZBLANK", blank))
        if zero:
            puts += [("BSCALE", 1), ("BZERO", zero)]
        if extname:
            puts.append(("EXTNAME", extname))
        for k, v in puts:
            h.put(k, v)
        h.update(header or {})
        yield h.to_bytes()
        yield main.tobytes()
        yield from heap
        yield bytes(-(main.size + self.heap) % 2880)
