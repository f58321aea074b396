"""From Spark's types to a table's forms and header, and whole files from encoded parts."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import types as T

from ..sources import storage
from ..sources.layout import ELEMENT, UNSIGNED, Column, parse_tform
from .cards import BLOCK, Entry, Header, lines_of
from .checksum import encode_checksum, stream_sum, word_sum

#: Letters of Spark's types.
LETTERS = {T.BooleanType: "L", T.ByteType: "B", T.ShortType: "I", T.IntegerType: "J", T.LongType: "K", T.FloatType: "E", T.DoubleType: "D", T.TimestampType: "K", T.TimestampNTZType: "K", T.DateType: "J", T.StringType: "A", T.BinaryType: "A", T.DecimalType: "K"}


def letter_of(kind: T.DataType) -> tuple[str, float]:
    """(letter, TZERO)."""
    if isinstance(kind, T.StructType):
        part = kind[0].dataType
        if len(kind) != 2 or not isinstance(part, (T.FloatType, T.DoubleType)):
            raise ValueError("a struct column holds re and im, of float or double")
        return ("C" if isinstance(part, T.FloatType) else "M"), 0
    if isinstance(kind, T.DecimalType):
        if (kind.precision, kind.scale) != (20, 0):
            raise ValueError("decimal columns are decimal(20, 0), for unsigned 64-bit integers")
        return "K", UNSIGNED["K"]
    for known, letter in LETTERS.items():
        if isinstance(kind, known):
            return letter, UNSIGNED["B"] if letter == "B" else 0
    raise ValueError(f"type {kind.simpleString()} has no form in a table")


def columns_for(schema: T.StructType, forms: dict | None = None, units: dict | None = None) -> list[Column]:
    """A column for each field but _row. forms: {name: TFORM, or {"form", "dim", "zero", "scale", "null"}}; text and arrays
    without a form are of variable length."""
    forms, units, out, offset = forms or {}, units or {}, [], 0
    for f in schema.fields:
        if f.name == "_row":
            continue
        asked = forms.get(f.name) or {}
        asked = {"form": asked} if isinstance(asked, str) else asked
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        letter, zero = letter_of(kind)
        is_list = isinstance(f.dataType, T.ArrayType)
        form = asked.get("form") or (f"1P{letter}" if is_list or letter == "A" else f"1{letter}")
        repeat, code, inner = parse_tform(form)
        element = inner or code
        dims = tuple(asked.get("dim", ())) or (() if repeat == 1 or code == "A" or inner else (repeat,))
        chars = None
        if code == "A":
            chars = asked.get("width", repeat) if not dims else asked["width"]
        elif is_list and not inner and not dims:
            dims = (repeat,)
        zero = asked.get("zero", zero if element == letter or element in UNSIGNED and zero == UNSIGNED[element] else 0)
        width = -(-repeat // 8) if code == "X" else repeat * ELEMENT[code]
        out.append(Column(f.name, code, repeat, offset, width, inner, dims, asked.get("scale", 1.0), zero, asked.get("null"), units.get(f.name) or (f.metadata or {}).get("unit"), None, form, chars))
        offset += width
    return out


def table_header(columns: list[Column], rows: int, heap: int, extname: str | None = None, more: dict | None = None) -> Header:
    h = Header()

    def put(key, value, comment=""):
        h.entries.append(Entry(key, value, comment, lines_of(key, value, comment)))

    put("XTENSION", "BINTABLE", "binary table")
    put("BITPIX", 8)
    put("NAXIS", 2)
    put("NAXIS1", sum(c.width for c in columns), "bytes of a row")
    put("NAXIS2", rows, "rows")
    put("PCOUNT", heap, "bytes of the heap")
    put("GCOUNT", 1)
    put("TFIELDS", len(columns), "columns")
    for k, c in enumerate(columns, 1):
        put(f"TTYPE{k}", c.name)
        put(f"TFORM{k}", c.format)
        if c.letter == "A" and c.dims:
            put(f"TDIM{k}", "(" + ",".join(str(x) for x in (c.char_width, *reversed(c.dims))) + ")")
        elif len(c.dims) > 1:
            put(f"TDIM{k}", "(" + ",".join(str(x) for x in reversed(c.dims)) + ")")
        if c.scale != 1 or c.zero:
            put(f"TSCAL{k}", int(c.scale) if c.scale == int(c.scale) else c.scale)
            put(f"TZERO{k}", int(c.zero) if c.zero == int(c.zero) else c.zero)
        if c.null is not None:
            put(f"TNULL{k}", c.null)
        if c.unit:
            put(f"TUNIT{k}", c.unit)
    if extname:
        put("EXTNAME", extname)
    h.update(more or {})
    return h


def primary() -> bytes:
    """An empty primary unit."""
    h = Header()
    for k, v in (("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)):
        h.put(k, v)
    return h.to_bytes()


def shifted(main: bytes, columns: list[Column], by: int) -> bytes:
    """Rows whose heap descriptors are moved by ``by`` bytes."""
    if not by or not any(c.inner for c in columns):
        return main
    raw = np.frombuffer(main, np.uint8).reshape(-1, sum(c.width for c in columns)).copy()
    for c in columns:
        if c.inner:
            kind = ">i4" if c.letter == "P" else ">i8"
            pairs = np.ascontiguousarray(raw[:, c.offset : c.offset + c.width]).view(kind).reshape(-1, 2)
            moved = pairs[:, 1].astype(np.int64) + by
            if c.letter == "P" and len(moved) and int(moved.max()) >= 1 << 31:
                raise ValueError(f"column {c.name}: the heap outgrows 32-bit descriptors; use the form 1Q")
            pairs[:, 1] = moved
            raw[:, c.offset : c.offset + c.width] = pairs.view(np.uint8).reshape(-1, c.width)
    return raw.tobytes()


def table_unit(parts, columns: list[Column], extname=None, header=None, checksum: bool = False):
    """Chunks of a table's unit from parts with rows, main, heap (paths) and heap_bytes."""
    rows, heap = sum(m.rows for m in parts), sum(m.heap_bytes for m in parts)
    h = table_header(columns, rows, heap, extname, header)

    def data():
        before, width = 0, sum(c.width for c in columns)
        for m in parts:
            for chunk in storage.ranges(m.main, 0, m.rows * width, max(1, (16 << 20) // max(1, width)) * width):  # whole rows
                yield shifted(chunk, columns, before)
            before += m.heap_bytes
        for m in parts:
            if m.heap:
                yield from storage.ranges(m.heap, 0, m.heap_bytes)
        size = rows * width + heap
        yield bytes(-size % BLOCK)

    if checksum:
        add_checksums(h, stream_sum(data()))
    yield h.to_bytes()
    yield from data()


def add_checksums(h: Header, data_sum: int) -> None:
    """DATASUM, and CHECKSUM so that the whole unit sums to all ones."""
    h.put("DATASUM", str(data_sum))
    h.put("CHECKSUM", "0" * 16)
    total = word_sum(h.to_bytes()) + data_sum
    h.put("CHECKSUM", encode_checksum((total - 1) % 0xFFFFFFFF + 1 if total else 0))


def table_file(parts, columns: list[Column], extname=None, header=None, checksum: bool = False):
    yield primary()
    yield from table_unit(parts, columns, extname, header, checksum)


def form_width(form: str) -> int:
    m = re.match(r"(\d*)A", form)
    return int(m[1] or 1) if m else 0
