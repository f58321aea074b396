"""Tile-compressed tables: each column of each run of rows is one blob."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..sources import layout as L
from . import rows as R
from .cards import Header
from .codecs import Codec, decode, decode_many, encode, gunzip

#: Codecs of letters where none is asked for, and those allowed.
DEFAULT = {"J": "RICE_1", "I": "GZIP_2", "K": "GZIP_2", "E": "GZIP_2", "D": "GZIP_2"}
ALLOWED = {"B": ("GZIP_1", "GZIP_2", "RICE_1"), "I": ("GZIP_1", "GZIP_2", "RICE_1"), "J": ("GZIP_1", "GZIP_2", "RICE_1"), "K": ("GZIP_1", "GZIP_2"), "E": ("GZIP_1", "GZIP_2"), "D": ("GZIP_1", "GZIP_2")}
#: Rows of tiles that are decoded together.
BATCH_ROWS = 100_000

NATIVE = {"B": "u1", "I": "i2", "J": "i4", "K": "i8", "E": "f4", "D": "f8"}


def codec_for(c: L.Column, asked: str | None) -> Codec:
    name = Codec(asked).name if asked else DEFAULT.get(c.letter, "GZIP_1")
    if name not in ALLOWED.get(c.letter, ("GZIP_1",)):
        raise ValueError(f"column {c.name}: {name} doesn't store {c.letter}")
    return Codec(name)


def default_tile(rows: int, width: int) -> int:
    return max(1, min(rows, 10_000_000 // max(1, width)))


def unpack_tiles(c: L.Column, packed: list[bytes], sizes: list[int]) -> np.ndarray:
    """The column's stored bytes of consecutive tiles: (rows, bytes of the cell)."""
    n = sum(sizes)
    if not c.width or not n:
        return np.zeros((n, c.width), np.uint8)
    codec = Codec(str(c.codec or "GZIP_1").strip())
    if c.letter not in NATIVE or codec.name == "GZIP_1":
        raw = np.concatenate([np.frombuffer(gunzip(b), np.uint8) for b in packed])
    else:
        native = np.concatenate(decode_many(packed, codec, np.dtype(NATIVE[c.letter]), np.array(sizes) * c.repeat))
        raw = native.astype(L.STORED[c.letter]).view(np.uint8)
    return raw.reshape(n, c.width)


def blobs(f, table: L.Table, tile: int, columns: list[L.Column]) -> dict[str, bytes]:
    f.seek(table.data_offset + tile * 16 * len(table.columns))
    pairs = np.frombuffer(f.read(16 * len(table.columns)), ">i8").reshape(-1, 2)
    out = {}
    for k, c in enumerate(table.columns):
        if c in columns:
            n, at = pairs[k].tolist()
            f.seek(table.heap_offset + at)
            out[c.name] = f.read(n)
    return out


def batches(f, unit: L.Unit, lo: int, hi: int, base: int, names, scale: bool, mask: bool):
    """Only tiles with rows lo .. hi - 1 and only chosen columns are fetched and decoded."""
    table = L.parse_table(unit)
    columns = table.chosen(names)
    last_tile = -(-hi // table.tile)
    together = max(1, BATCH_ROWS // table.tile)
    for t in range(lo // table.tile, last_tile, together):
        tiles = range(t, min(last_tile, t + together))
        ends = [min(table.rows, (k + 1) * table.tile) for k in tiles]
        sizes = [e - k * table.tile for k, e in zip(tiles, ends, strict=True)]
        first, a, b = t * table.tile, max(lo, t * table.tile), min(hi, ends[-1])
        got = [blobs(f, table, k, columns) for k in tiles]
        out = [pa.array(np.arange(base + a, base + b))]
        for c in columns:
            if c.inner:
                parts = [variable_column(f, table, c, g[c.name], n, scale, mask) for g, n in zip(got, sizes, strict=True)]
                out.append(pa.concat_arrays(parts).slice(a - first, b - a))
            else:
                raw = unpack_tiles(c, [g[c.name] for g in got], sizes)[a - first : b - first]
                out.append(R.fixed(np.ascontiguousarray(raw), c, scale, mask, False))
        yield pa.RecordBatch.from_arrays(out, names=["_row", *(c.name for c in columns)])


def descriptors(c: L.Column, blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements and own heap offsets, bytes and offsets of compressed cells) of a variable-length column's tile."""
    raw = gunzip(blob)
    own = 8 if c.letter == "P" else 16
    return np.frombuffer(raw[: n * own], ">i4" if own == 8 else ">i8").reshape(-1, 2).astype(np.int64), np.frombuffer(raw[n * own :], ">i8").reshape(-1, 2).astype(np.int64)


def own_cells(c: L.Column, blob: bytes, n: int) -> np.ndarray:
    """The rows' bytes of a variable-length column as they are uncompressed: its descriptors."""
    return np.ascontiguousarray(descriptors(c, blob, n)[0].astype(">i4" if c.letter == "P" else ">i8")).view(np.uint8).reshape(n, -1)


def heap_of(f, table: L.Table, c: L.Column, blob: bytes, n: int) -> tuple[list[int], list[bytes]]:
    """(own heap offsets, uncompressed bytes) of a variable-length column's cells."""
    mine, cells = descriptors(c, blob, n)
    codec = Codec(str(c.codec or "GZIP_1").strip())
    out = []
    for want, (size, at) in zip(mine[:, 0].tolist(), cells.tolist(), strict=True):
        data = b""
        if size:
            f.seek(table.heap_offset + at)
            data = f.read(size)
            if size != int(R.cell_bytes(c.inner, np.array([want]))[0]):
                data = gunzip(data) if c.inner not in NATIVE or codec.name == "GZIP_1" else decode(data, codec, np.dtype(NATIVE[c.inner]), want).astype(L.STORED[c.inner]).tobytes()
        out.append(data)
    return mine[:, 1].tolist(), out


def variable_column(f, table: L.Table, c: L.Column, blob: bytes, n: int, scale: bool, mask: bool = False) -> pa.Array:
    """A variable-length column's tile: two lists of descriptors (of the table's own heap, and of compressed cells), gzipped."""
    counts = descriptors(c, blob, n)[0][:, 0]
    heap = np.frombuffer(b"".join(heap_of(f, table, c, blob, n)[1]), np.uint8)
    size = R.cell_bytes(c.inner, counts)
    return R.variable(counts, heap, np.cumsum(size) - size, c, scale, mask, False)


def encode_tile(batch: pa.RecordBatch, columns: list[L.Column], codecs: dict[str, Codec]) -> list[tuple[bytes, list[bytes]]]:
    """Of each column: (blob of a fixed column, or b""; cells and counts of a variable-length one in turn)."""
    out = []
    for c in columns:
        codec = codecs[c.name]
        if c.inner:
            counts, data, size = R.encode_variable(batch.column(c.name), c)
            ends = np.cumsum(size)
            cells = []
            for n, a, b in zip(counts.tolist(), (ends - size).tolist(), ends.tolist(), strict=True):
                raw = data[a:b].tobytes()
                packed = encode(np.frombuffer(raw, L.STORED[c.inner]).astype(NATIVE[c.inner]), codec) if raw and c.inner in NATIVE and codec.name != "GZIP_1" else encode(np.frombuffer(raw, "u1"), Codec("GZIP_1"))
                cells.append((n, packed if raw and len(packed) < len(raw) else raw))
            out.append((b"", cells))
        else:
            raw = R.encode_fixed(batch.column(c.name), c)
            if c.letter in NATIVE and codec.name != "GZIP_1":
                blob = encode(np.ascontiguousarray(raw).reshape(-1).view(L.STORED[c.letter]).astype(NATIVE[c.letter]), codec)
            else:
                blob = encode(np.ascontiguousarray(raw).reshape(-1), Codec("GZIP_1"))
            out.append((blob, []))
    return out


class Unit:
    """A compressed table's unit, made tile by tile: bytes go to its heap one after another, and only descriptors are kept."""

    def __init__(self, columns: list[L.Column], codecs: dict[str, Codec], tile: int):
        self.columns, self.codecs, self.tile = columns, codecs, tile
        self.main, self.heap, self.own_heap, self.rows, self.tiles = bytearray(), 0, 0, 0, 0

    def add(self, rows: int, encoded: list[tuple[bytes, list]]):
        """The heap's bytes of the next tile, as encode_tile() gives it."""
        self.rows, self.tiles = self.rows + rows, self.tiles + 1
        for c, (blob, cells) in zip(self.columns, encoded, strict=True):
            if c.inner:
                mine, packed = [], []
                for n, data in cells:
                    mine.append((n, self.own_heap))
                    self.own_heap += int(R.cell_bytes(c.inner, np.array([n]))[0])
                    packed.append((len(data), self.heap if data else 0))
                    self.heap += len(data)
                    yield data
                blob = encode(np.frombuffer(np.array(mine, ">i4" if c.letter == "P" else ">i8").tobytes() + np.array(packed, ">i8").tobytes(), "u1"), Codec("GZIP_1"))
            self.main += np.array([len(blob), self.heap if blob else 0], ">i8").tobytes()
            self.heap += len(blob)
            yield blob

    def chunks(self, plain: Header, heap):
        """The unit's bytes. plain: the header it has uncompressed; heap: what add() gave, in order."""
        columns, h = self.columns, Header()
        for k, v in [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 16 * len(columns)), ("NAXIS2", self.tiles), ("PCOUNT", self.heap), ("GCOUNT", 1), ("TFIELDS", len(columns)), ("ZTABLE", True), ("ZTILELEN", self.tile), ("ZNAXIS1", sum(c.width for c in columns)), ("ZNAXIS2", self.rows), ("ZPCOUNT", self.own_heap)]:
            h.put(k, v)
        for k, c in enumerate(columns, 1):
            h.put(f"TTYPE{k}", c.name)
            h.put(f"TFORM{k}", "1QB")
            h.put(f"ZFORM{k}", c.format)
            h.put(f"ZCTYP{k}", self.codecs[c.name].name)
            for card in ("TDIM", "TSCAL", "TZERO", "TNULL", "TUNIT"):
                if f"{card}{k}" in plain:
                    h.put(f"{card}{k}", plain[f"{card}{k}"])
        if "EXTNAME" in plain:
            h.put("EXTNAME", plain["EXTNAME"])
        yield h.to_bytes()
        yield bytes(self.main)
        yield from heap
        yield bytes(-(len(self.main) + self.heap) % 2880)
