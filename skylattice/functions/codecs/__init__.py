"""Tile codecs by name. Each takes and gives native integers or floats of one tile."""

from __future__ import annotations

import gzip
import zlib
from dataclasses import dataclass

import numpy as np

from . import hcompress, plio, rice

#: Names that mean the same codec.
ALIASES = {"RICE_ONE": "RICE_1", "GZIP": "GZIP_1", "HCOMPRESS": "HCOMPRESS_1"}


@dataclass(frozen=True)
class Codec:
    """A codec with its settings: level of gzip, block size of Rice, scale and smoothing of HCOMPRESS; a tile's shape."""

    name: str
    level: int | None = None
    blocksize: int = 32
    scale: int = 0
    smooth: bool = False
    tile_shape: tuple[int, ...] | None = None

    def __post_init__(self):
        name = ALIASES.get(self.name.upper(), self.name.upper())
        name = {"RICE": "RICE_1", "PLIO": "PLIO_1", "GZIP1": "GZIP_1", "GZIP2": "GZIP_2"}.get(name, name)
        if name not in ("GZIP_1", "GZIP_2", "RICE_1", "PLIO_1", "HCOMPRESS_1", "NOCOMPRESS"):
            raise ValueError(f"codec {self.name!r} isn't known")
        if self.level is not None and not 0 <= self.level <= 9:
            raise ValueError("gzip levels are 0 to 9")
        if self.blocksize < 1:
            raise ValueError("Rice blocks hold pixels")
        object.__setattr__(self, "name", name)


def gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 47)


def encode(values: np.ndarray, codec: Codec, shape: tuple[int, ...] | None = None) -> bytes:
    """One tile of native numbers, row-major."""
    flat = np.ascontiguousarray(values).reshape(-1)
    name = codec.name
    if name in ("GZIP_1", "GZIP_2"):
        raw = flat.astype(flat.dtype.newbyteorder(">")).tobytes()
        if name == "GZIP_2":
            raw = np.frombuffer(raw, np.uint8).reshape(len(flat), -1).T.tobytes()
        return gzip.compress(raw, 6 if codec.level is None else codec.level, mtime=0)
    if name == "RICE_1":
        return rice.encode(flat, codec.blocksize)
    if name == "PLIO_1":
        return plio.encode(flat)
    if name == "HCOMPRESS_1":
        lines = shape if shape is not None else np.shape(values)
        if len(lines) < 2 or any(n != 1 for n in lines[:-2]):
            raise ValueError("HCOMPRESS_1 stores tiles of two axes")
        return hcompress.encode(flat.reshape(lines[-2:]), codec.scale)
    return flat.astype(flat.dtype.newbyteorder(">")).tobytes()


def decode(data: bytes, codec: Codec, kind: np.dtype, count: int) -> np.ndarray:
    """``count`` native numbers of a tile."""
    kind, name = np.dtype(kind), codec.name
    if name in ("GZIP_1", "GZIP_2", "NOCOMPRESS"):
        raw = np.frombuffer(data if name == "NOCOMPRESS" else gunzip(data), np.uint8)
        if name == "GZIP_2":
            raw = np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1)
        out = raw.view(kind.newbyteorder(">")).astype(kind)
    elif name == "RICE_1":
        out = rice.decode_many([data], np.array([count]), kind, codec.blocksize)[0]
    elif name == "PLIO_1":
        out = plio.decode(data, count).astype(kind)
    else:
        out = hcompress.decode(data, codec.smooth).reshape(-1)
        if kind.kind in "iu" and codec.scale > 1:  # what was lost may lead out of the type
            out = np.clip(out, np.iinfo(kind).min, np.iinfo(kind).max)
        out = out.astype(kind)
    if len(out) != count:
        raise ValueError(f"{name}: a tile holds {len(out)} pixels instead of {count}")
    return out


def decode_many(parts: list[bytes], codec: Codec, kind: np.dtype, counts: np.ndarray) -> list[np.ndarray]:
    """Several tiles; Rice goes through all of them in step."""
    if codec.name == "RICE_1" and len(parts) > 1:
        return rice.decode_many(parts, np.asarray(counts), np.dtype(kind), codec.blocksize)
    return [decode(p, codec, kind, int(n)) for p, n in zip(parts, counts, strict=True)]
