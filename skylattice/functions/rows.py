"""Rows of binary tables as Arrow columns, both ways, in array operations."""

from __future__ import annotations

from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..sources.layout import STORED, Column

#: Arrow types of stored and of unsigned elements.
ARROW = {"B": pa.int16(), "I": pa.int16(), "J": pa.int32(), "K": pa.int64(), "E": pa.float32(), "D": pa.float64(), "L": pa.bool_(), "X": pa.bool_()}
ARROW_TRICK = {"B": pa.int8(), "I": pa.int32(), "J": pa.int64(), "K": pa.decimal128(20, 0)}


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def unsigned64(stored: np.ndarray) -> pa.Array:
    """Stored int64 plus 2^63 as decimal(20, 0), from 128-bit little-endian integers."""
    wide = np.zeros((len(stored), 2), np.uint64)
    wide[:, 0] = stored.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(stored), [None, pa.py_buffer(wide.tobytes())])


def strings(raw: np.ndarray, width: int, where: str) -> pa.Array:
    """Cells of ``width`` bytes: cut at the first NUL, blanks at the end dropped, ASCII alone."""
    n = len(raw) // width if width else 0
    if not width:
        return pa.array([""] * 0, pa.string())
    cells = raw.reshape(n, width)
    bad = np.flatnonzero((cells >= 128).any(1))
    nul = np.where((cells == 0).any(1), (cells == 0).argmax(1), width)
    if len(bad):
        for row in bad:
            if (cells[row, : nul[row]] >= 128).any():
                at = int((cells[row] >= 128).argmax())
                raise ValueError(f"column {where}, row {int(row)}: byte {at} isn't ASCII")
    inside = np.arange(width) < nul[:, None]
    seen = inside & (cells != 32)
    length = np.where(seen.any(1), width - seen[:, ::-1].argmax(1), 0)
    flat = cells.reshape(-1)[ragged(length, np.arange(n) * width)]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes()))


def elements(raw: np.ndarray, c: Column, scale: bool, mask: bool) -> pa.Array:
    """Stored bytes of a column's elements (not of strings or bits) as values."""
    e = c.element
    if e == "L":
        return pa.array(raw == ord("T"))
    stored = raw.view(STORED[e])
    if e in "CM":
        part = np.float32 if e == "C" else np.float64
        return pa.StructArray.from_arrays([pa.array(stored.real.astype(part)), pa.array(stored.imag.astype(part))], names=["re", "im"])
    native = stored.astype(stored.dtype.newbyteorder("="))
    hidden = (native == c.null) if mask and c.null is not None and e in "BIJK" else None
    if scale and c.trick:
        if e == "K":
            out = unsigned64(native)
            return pc.if_else(pa.array(~hidden), out, pa.scalar(None, out.type)) if hidden is not None else out
        wide = {"B": np.int8, "I": np.int32, "J": np.int64}[e]
        return pa.array((native.astype(np.int64) + int(c.zero)).astype(wide), mask=hidden)
    if scale and c.scaled:
        return pa.array(native.astype(np.float64) * c.scale + c.zero, mask=hidden)
    return pa.array(native.astype(np.int16) if e == "B" else native, mask=hidden)


def nested(values: pa.Array, dims: tuple[int, ...]) -> pa.Array:
    for size in reversed(dims):
        n = len(values) // size if size else 0
        values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), values)
    return values


def fixed(raw: np.ndarray, c: Column, scale: bool, mask: bool, as_bytes: bool) -> pa.Array:
    """A fixed-width column. raw: (rows, bytes of the cell)."""
    n = len(raw)
    if c.letter == "A":
        width = c.char_width or 0
        if as_bytes:
            out = pa.array([x.tobytes() for x in raw.reshape(-1, width)] if width else [b""] * n, pa.binary())
        else:
            out = strings(raw.reshape(-1), width, c.name) if width else pa.array([""] * n)
        return nested(out, c.dims)
    if c.letter == "X":
        bits = np.unpackbits(raw, axis=1, count=c.repeat).reshape(-1).astype(bool) if c.repeat else np.zeros(0, bool)
        return empty_or(nested(pa.array(bits), c.dims), n, c, scale)
    return empty_or(nested(elements(raw.reshape(-1), c, scale, mask), c.dims), n, c, scale)


def empty_or(values: pa.Array, n: int, c: Column, scale: bool) -> pa.Array:
    """Cells without elements are empty lists."""
    if len(values) == n:
        return values
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.array([[]] * n, to_arrow_type(c.spark_type(scale)))


def cell_bytes(inner: str, n: np.ndarray) -> np.ndarray:
    """Bytes of variable-length cells of n elements."""
    from ..sources.layout import ELEMENT

    return -(-n // 8) if inner == "X" else n * ELEMENT[inner]


def variable(counts: np.ndarray, heap: np.ndarray, starts: np.ndarray, c: Column, scale: bool, mask: bool, as_bytes: bool) -> pa.Array:
    """A variable-length column. counts: elements by row; starts: where each cell begins in ``heap``."""
    if mask and c.null is not None:
        raise ValueError(f"column {c.name}: TNULL of a variable-length column isn't defined")
    size = cell_bytes(c.inner, counts)
    whole = len(starts) and bool((starts[1:] == starts[:-1] + size[:-1]).all())
    flat = heap[starts[0] : starts[0] + int(size.sum())] if whole else heap[ragged(size, starts)]
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    if c.inner == "A":
        if not as_bytes and (flat >= 128).any():
            raise ValueError(f"column {c.name}: text that isn't ASCII")
        kind = pa.binary() if as_bytes else pa.string()
        return pa.Array.from_buffers(kind, len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])
    if c.inner == "X":
        at = np.concatenate([[0], np.cumsum(size)])[:-1] * 8
        values = pa.array(np.unpackbits(flat).astype(bool)[ragged(counts, at)] if len(flat) else np.zeros(0, bool))
    else:
        values = elements(np.ascontiguousarray(flat), c, scale, False)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def flatten(values: pa.Array, depth: int) -> pa.Array:
    for _ in range(depth):
        values = values.flatten()
    return values


def one(values) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def stored_elements(values: pa.Array, c: Column) -> np.ndarray:
    """Values as stored big-endian bytes, one after another. Null floats are NaN; null integers the column's TNULL."""
    e = c.element
    if e == "L":
        got = values.to_numpy(zero_copy_only=False)
        out = np.where(np.equal(got, True), ord("T"), ord("F")).astype(np.uint8)
        if values.null_count:
            out[np.asarray(values.is_null())] = 0
        return out
    if e in "CM":
        kind = np.dtype(STORED[e])
        out = np.empty(len(values), kind)
        for name, part in (("re", out.real), ("im", out.imag)):
            part[:] = values.field(name).to_numpy(zero_copy_only=False)
        return out.view(np.uint8)
    if e in "ED":
        return values.to_numpy(zero_copy_only=False).astype(STORED[e]).view(np.uint8)
    if values.null_count:
        if c.null is None:
            raise ValueError(f"column {c.name}: nulls need a TNULL")
        fill = c.null + int(c.zero) if c.trick else c.null
        values = values.fill_null(pa.scalar(fill, values.type) if not pa.types.is_decimal(values.type) else pa.scalar(fill, pa.decimal128(20, 0)))
    if pa.types.is_decimal(values.type):
        raw = np.frombuffer(values.cast(pa.decimal128(20, 0)).buffers()[1], np.uint64)[2 * values.offset :][: 2 * len(values)].reshape(-1, 2)
        if (raw[:, 1] != 0).any():
            raise ValueError(f"column {c.name}: a value outside of unsigned 64 bits")
        return (raw[:, 0] ^ np.uint64(1 << 63)).view(np.int64).astype(">i8").view(np.uint8)
    if pa.types.is_timestamp(values.type):
        values = values.cast(pa.timestamp("us", values.type.tz)).cast(pa.int64())
    elif pa.types.is_date(values.type):
        values = values.cast(pa.int32())
    got = values.to_numpy(zero_copy_only=False)
    if c.trick:
        got = got.astype(np.int64) - int(c.zero)
    kind = np.dtype(STORED[e])
    info = np.iinfo(kind)
    if len(got) and got.dtype != kind.newbyteorder("=") and (int(got.min()) < info.min or int(got.max()) > info.max):
        raise ValueError(f"column {c.name}: a value outside of the stored type")
    return got.astype(kind).view(np.uint8)


def text_bytes(values: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths); text is ASCII."""
    raw = values.fill_null(b"" if pa.types.is_binary(values.type) else "").cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    if not pa.types.is_binary(values.type) and (data >= 128).any():
        raise ValueError(f"column {name}: text that isn't ASCII")
    return data, np.diff(offsets)


def encode_fixed(values: pa.Array, c: Column) -> np.ndarray:
    """(rows, bytes of the cell)."""
    values = one(values)
    n = len(values)
    if c.letter == "A":
        data, lengths = text_bytes(flatten(values, len(c.dims)), c.name)
        width = c.char_width or 0
        if len(lengths) and int(lengths.max(initial=0)) > width:
            raise ValueError(f"column {c.name}: text longer than {width} bytes")
        out = np.zeros(len(lengths) * width, np.uint8)
        out[ragged(lengths, np.arange(len(lengths)) * width)] = data
        return out.reshape(n, c.width)
    flat = flatten(values, len(c.dims))
    if len(flat) != n * prod(c.dims or (1,)):
        raise ValueError(f"column {c.name}: a cell without {c.dims} elements")
    if c.letter == "X":
        return np.packbits(np.equal(flat.to_numpy(zero_copy_only=False), True).reshape(n, c.repeat), axis=1)
    return stored_elements(flat, c).reshape(n, c.width)


def encode_variable(values: pa.Array, c: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, bytes of all cells, bytes by cell); a null cell is empty."""
    values = one(values)
    if c.inner == "A":
        data, lengths = text_bytes(values, c.name)
        return lengths, data, lengths
    counts = np.asarray(pc.fill_null(pc.list_value_length(values), 0)).astype(np.int64)
    flat = values.flatten()
    if c.inner == "X":
        bits = np.equal(flat.to_numpy(zero_copy_only=False), True)
        size = cell_bytes("X", counts)
        wide = np.zeros(int(size.sum()) * 8, bool)
        wide[ragged(counts, (np.cumsum(size) - size) * 8)] = bits
        return counts, np.packbits(wide), size
    return counts, stored_elements(flat, c), cell_bytes(c.inner, counts)
