"""Structure of FITS files: the walk over header-data units, and tables' and images' layouts with their Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property
from math import prod

import numpy as np
from pyspark.sql import types as T

from ..functions.cards import BLOCK, CARD, Header

#: Bytes of an element by TFORM letter, and its big-endian type in numpy.
ELEMENT = {"L": 1, "X": 1, "B": 1, "I": 2, "J": 4, "K": 8, "A": 1, "E": 4, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}
STORED = {"L": "u1", "X": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "A": "S1", "E": ">f4", "D": ">f8", "C": ">c8", "M": ">c16"}
#: The offset that stores an unsigned (or signed byte) type in a letter.
UNSIGNED = {"B": -128, "I": 1 << 15, "J": 1 << 31, "K": 1 << 63}
PIXELS = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


@dataclass
class Unit:
    """One header-data unit of a file."""

    index: int
    header: Header
    header_offset: int
    data_offset: int
    data_size: int

    @cached_property
    def table(self) -> Table:
        """The unit's columns, parsed once."""
        return parse_table(self)

    @property
    def padded(self) -> int:
        return self.data_size + -self.data_size % BLOCK

    @property
    def extname(self) -> str | None:
        name = self.header.get("EXTNAME")
        return name if isinstance(name, str) else None

    @property
    def extver(self) -> int:
        return self.header.get("EXTVER", 1)

    @property
    def kind(self) -> str:
        h = self.header
        x = str(h.get("XTENSION", "")).strip().upper()
        if "SIMPLE" in h or x == "IMAGE":
            return "image"
        if x == "BINTABLE":
            return "zimage" if h.get("ZIMAGE") is True else "ztable" if h.get("ZTABLE") is True else "table"
        return "ascii" if x == "TABLE" else "other"

    @property
    def shape(self) -> tuple[int, ...]:
        """Axes of the image, slowest first; of a table, its rows."""
        h, z = self.header, "Z" if self.kind in ("zimage", "ztable") else ""
        if self.kind in ("image", "zimage"):
            return tuple(h[f"{z}NAXIS{k}"] for k in range(h.get(f"{z}NAXIS", 0), 0, -1))
        return (h.get(f"{z}NAXIS2", 0),)

    @property
    def has_data(self) -> bool:
        return self.kind not in ("image", "zimage") and self.kind != "other" or prod(self.shape) > 0 and bool(self.shape)


def data_size(h: Header) -> int:
    axes = [h.get(f"NAXIS{k}", 0) for k in range(1, h.get("NAXIS", 0) + 1)]
    if not axes:
        return 0
    return abs(h["BITPIX"]) // 8 * h.get("GCOUNT", 1) * (h.get("PCOUNT", 0) + prod(axes))


def read_header(file, offset: int, lenient: bool = False) -> tuple[Header, int] | None:
    """(header, offset after it) at an offset; None at the end of the file."""
    file.seek(offset)
    lines: list[str] = []
    while True:
        raw = file.read(BLOCK)
        if len(raw) < BLOCK:
            if not lines and (not raw or not raw.strip(b"\0 ")):
                return None
            raise OSError("the file ends inside a header")
        offset += BLOCK
        bad = bytes(b for b in raw if not 32 <= b < 127)
        if bad:
            if not lenient:
                raise OSError("a header holds bytes that aren't printable ASCII")
            raw = bytes(b if 32 <= b < 127 else 0x5F for b in raw)
        text = raw.decode("ascii")
        for i in range(0, BLOCK, CARD):
            line = text[i : i + CARD]
            if line[:8] == "END     ":
                return Header.from_lines(lines), offset
            lines.append(line)


def walk(file, lenient: bool = False) -> list[Unit]:
    """All units of a file, from headers alone."""
    out: list[Unit] = []
    offset = 0
    file.seek(0, 2)
    end = file.tell()
    if end < BLOCK:
        raise OSError("not a FITS file: shorter than a block")
    while offset < end:
        got = read_header(file, offset, lenient)
        if got is None:
            break
        header, data = got
        if not out and header.get("SIMPLE") is None:
            raise OSError("not a FITS file: it doesn't begin with SIMPLE")
        size = data_size(header)
        out.append(Unit(len(out), header, offset, data, size))
        offset = data + size + -size % BLOCK
    return out


def find(units: list[Unit], key) -> Unit:
    """By number (negative from the end) or EXTNAME (first match, case and outer blanks ignored)."""
    if isinstance(key, bool):
        raise ValueError("an HDU is chosen by number or name")
    if isinstance(key, (int, np.integer)):
        if not -len(units) <= key < len(units):
            raise ValueError(f"no HDU {key}; there are {len(units)}")
        return units[int(key)]
    name = (key.decode() if isinstance(key, bytes) else str(key)).strip().upper()
    for u in units:
        if u.extname is not None and u.extname.strip().upper() == name:
            return u
    raise ValueError(f"no HDU named {key!r}")


@dataclass
class Column:
    """A binary table's column. dims: axes of a cell, slowest first; () for one value. inner: letter of a variable-length column."""

    name: str
    letter: str
    repeat: int
    offset: int
    width: int
    inner: str | None = None
    dims: tuple[int, ...] = ()
    scale: float = 1.0
    zero: float = 0
    null: int | None = None
    unit: str | None = None
    codec: str | None = None
    format: str = ""
    char_width: int | None = None

    @property
    def element(self) -> str:
        return self.inner or self.letter

    @property
    def trick(self) -> bool:
        return self.scale == 1 and self.element in UNSIGNED and self.zero == UNSIGNED[self.element]

    @property
    def scaled(self) -> bool:
        return not self.trick and (self.scale != 1 or self.zero != 0) and self.element in "BIJKED"

    def value_type(self, scale: bool = True, as_bytes: bool = False) -> T.DataType:
        e = self.element
        if e == "A":
            return T.BinaryType() if as_bytes else T.StringType()
        if e in "LX":
            return T.BooleanType()
        if e in "CM":
            part = T.FloatType() if e == "C" else T.DoubleType()
            return T.StructType([T.StructField("re", part), T.StructField("im", part)])
        if scale and self.trick:
            return {"B": T.ByteType(), "I": T.IntegerType(), "J": T.LongType(), "K": T.DecimalType(20, 0)}[e]
        if scale and self.scaled:
            return T.DoubleType()
        return {"B": T.ShortType(), "I": T.ShortType(), "J": T.IntegerType(), "K": T.LongType(), "E": T.FloatType(), "D": T.DoubleType()}[e]

    def spark_type(self, scale: bool = True, as_bytes: bool = False) -> T.DataType:
        kind = self.value_type(scale, as_bytes)
        if self.inner:
            return kind if self.inner == "A" else T.ArrayType(kind)
        for _ in self.dims:
            kind = T.ArrayType(kind)
        return kind

    def field(self, scale: bool = True, as_bytes: bool = False) -> T.StructField:
        about = {"tform": self.format} | ({"unit": self.unit} if self.unit else {}) | ({"tnull": self.null} if self.null is not None else {})
        return T.StructField(self.name, self.spark_type(scale, as_bytes), True, about)


@dataclass
class Table:
    """A binary table, plain or compressed. tile: rows of a tile where it is compressed."""

    rows: int
    width: int
    columns: list[Column]
    data_offset: int
    heap_offset: int
    tile: int | None = None
    tiles: int = 0
    by_name: dict = field(default_factory=dict)

    def __post_init__(self):
        for c in reversed(self.columns):
            self.by_name[c.name.strip().upper()] = c

    def column(self, name) -> Column:
        key = (name.decode() if isinstance(name, bytes) else name).strip().upper()
        if key not in self.by_name:
            raise ValueError(f"no column {name!r}")
        return self.by_name[key]

    def chosen(self, names) -> list[Column]:
        """Columns in the order asked for; none, unknown and repeated ones are errors."""
        if names is None:
            return self.columns
        names = list(names)
        if not names:
            raise ValueError("no columns chosen")
        out = [self.column(n) for n in names]
        if len({id(c) for c in out}) < len(out):
            raise ValueError("a column is chosen twice")
        return out

    def schema(self, columns=None, scale: bool = True, as_bytes: bool = False) -> T.StructType:
        return T.StructType([T.StructField("_row", T.LongType(), False), *(c.field(scale, as_bytes) for c in columns or self.columns)])


def parse_tform(form: str) -> tuple[int, str, str | None]:
    """(repeat, letter, inner letter of a variable-length column)."""
    m = re.fullmatch(r"(\d*)([LXBIJKAEDCMPQ])(.*)", form.strip())
    if not m:
        raise ValueError(f"TFORM {form!r} isn't known")
    repeat, letter, rest = int(m[1]) if m[1] else 1, m[2], m[3]
    if letter not in "PQ":
        return repeat, letter, None
    inner = re.match(r"([LXBIJKAEDCM])", rest)
    if not inner or repeat > 1:
        raise ValueError(f"TFORM {form!r} isn't known")
    return repeat, letter, inner[1]


def parse_tdim(text: str | None, repeat: int) -> tuple[int, ...]:
    if not text:
        return () if repeat == 1 else (repeat,)
    axes = tuple(int(x) for x in text.strip().strip("()").split(","))
    if prod(axes) != repeat:
        raise ValueError(f"TDIM {text} doesn't hold {repeat} elements")
    return axes[::-1]


def parse_table(unit: Unit) -> Table:
    h, z = unit.header, "Z" if unit.kind == "ztable" else ""
    columns, offset = [], 0
    for k in range(1, h.get("TFIELDS", 0) + 1):
        form = str(h[f"{z}FORM{k}" if z else f"TFORM{k}"])
        repeat, letter, inner = parse_tform(form)
        width = -(-repeat // 8) if letter == "X" else repeat * ELEMENT[letter]
        tdim, chars = h.get(f"TDIM{k}"), None
        if inner:
            if tdim:
                raise ValueError("TDIM of a variable-length column isn't known")
            dims: tuple[int, ...] = ()
        elif letter == "A":
            axes = parse_tdim(tdim, repeat) if tdim else (repeat,)
            dims, chars = axes[:-1], axes[-1] if axes else 1
        else:
            dims = parse_tdim(tdim, repeat)
        null = h.get(f"TNULL{k}")
        columns.append(Column(str(h.get(f"TTYPE{k}", "") or f"COL{k}").strip(), letter, repeat, offset, width, inner, dims, h.get(f"TSCAL{k}", 1.0) or 1.0, h.get(f"TZERO{k}", 0) or 0, null if isinstance(null, int) and not isinstance(null, bool) else None, h.get(f"TUNIT{k}"), h.get(f"ZCTYP{k}"), form, chars))
        offset += width
    width, rows = h[f"{z}NAXIS1"], h[f"{z}NAXIS2"]
    if offset != width:
        raise ValueError(f"columns take {offset} bytes of a row of {width}")
    heap = unit.data_offset + (h.get("THEAP", 0) or h["NAXIS1"] * h["NAXIS2"])
    if z:
        if h["NAXIS1"] != 16 * len(columns):
            raise ValueError("a compressed table's row holds one 16-byte descriptor for each column")
        return Table(rows, width, columns, unit.data_offset, heap, h["ZTILELEN"], h["NAXIS2"])
    return Table(rows, width, columns, unit.data_offset, heap)


@dataclass
class Image:
    """A plain image's pixels."""

    shape: tuple[int, ...]
    stored: str
    scale: float
    zero: float
    blank: int | None
    data_offset: int

    @property
    def trick(self) -> bool:
        bits = {"u1": -128, ">i2": 1 << 15, ">i4": 1 << 31, ">i8": 1 << 63}.get(self.stored)
        return self.scale == 1 and bits is not None and self.zero == bits

    def value_type(self, scale: bool = True) -> T.DataType:
        if scale and self.trick:
            return {"u1": T.ByteType(), ">i2": T.IntegerType(), ">i4": T.LongType(), ">i8": T.DecimalType(20, 0)}[self.stored]
        if scale and (self.scale != 1 or self.zero != 0):
            return T.DoubleType()
        return {"u1": T.ShortType(), ">i2": T.ShortType(), ">i4": T.IntegerType(), ">i8": T.LongType(), ">f4": T.FloatType(), ">f8": T.DoubleType()}[self.stored]


def parse_image(unit: Unit) -> Image:
    h, z = unit.header, "Z" if unit.kind == "zimage" else ""
    blank = h.get("ZBLANK", h.get("BLANK")) if z else h.get("BLANK")
    return Image(unit.shape, PIXELS[h[f"{z}BITPIX"]], h.get("BSCALE", 1.0) or 1.0, h.get("BZERO", 0) or 0, blank if isinstance(blank, int) else None, unit.data_offset)
