"""ASCII tables: fields of fixed columns of text, read as Arrow columns and written as lines."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

from ..sources import layout as L
from .cards import Header
from .rows import unsigned64

#: Decimals up to which F and E fields are 32-bit floats; forms of Spark's types.
SINGLE = 7
FORMS = {T.ShortType: "I20", T.IntegerType: "I20", T.LongType: "I20", T.FloatType: "E15.7", T.DoubleType: "D25.17", T.DecimalType: "I20"}


@dataclass
class Field:
    name: str
    kind: str
    width: int
    decimals: int
    start: int
    scale: float = 1.0
    zero: float = 0
    null: str | None = None
    unit: str | None = None

    @property
    def form(self) -> str:
        return f"{self.kind}{self.width}" + (f".{self.decimals}" if self.kind in "FED" else "")

    @property
    def unsigned(self) -> bool:
        return self.kind == "I" and self.scale == 1 and self.zero == 1 << 63

    def spark_type(self, scale: bool = True) -> T.DataType:
        if self.kind == "A":
            return T.StringType()
        if scale and self.unsigned:
            return T.DecimalType(20, 0)
        if scale and (self.scale != 1 or self.zero != 0):
            return T.DoubleType()
        if self.kind == "I":
            return T.LongType()
        return T.FloatType() if self.kind in "FE" and self.decimals <= SINGLE else T.DoubleType()


@dataclass
class Text:
    rows: int
    width: int
    fields: list[Field]
    data_offset: int

    def chosen(self, names) -> list[Field]:
        if names is None:
            return self.fields
        known = {f.name.strip().upper(): f for f in reversed(self.fields)}
        names = [n.strip().upper() for n in names]
        if not names or len(set(names)) < len(names) or any(n not in known for n in names):
            raise ValueError("no columns, an unknown column, or a column twice")
        return [known[n] for n in names]


def parse_form(form: str) -> tuple[str, int, int]:
    m = re.fullmatch(r"([AIFED])(\d+)(?:\.(\d+))?", form.strip())
    if not m or m[1] in "FED" and m[3] is None or m[1] in "AI" and m[3]:
        raise ValueError(f"TFORM {form!r} isn't known in an ASCII table")
    return m[1], int(m[2]), int(m[3] or 0)


def parse(unit: L.Unit) -> Text:
    h, fields = unit.header, []
    for k in range(1, h.get("TFIELDS", 0) + 1):
        kind, width, decimals = parse_form(str(h[f"TFORM{k}"]))
        null = h.get(f"TNULL{k}")
        fields.append(Field(str(h.get(f"TTYPE{k}", "") or f"COL{k}").strip(), kind, width, decimals, h[f"TBCOL{k}"] - 1, h.get(f"TSCAL{k}", 1.0), h.get(f"TZERO{k}", 0), None if null is None else str(null).strip(), h.get(f"TUNIT{k}")))
    spans = sorted((f.start, f.start + f.width) for f in fields)
    if any(b[0] < a[1] for a, b in zip(spans, spans[1:], strict=False)) or spans and (spans[-1][1] > h["NAXIS1"] or spans[0][0] < 0):
        raise ValueError("fields overlap or leave the row")
    return Text(h["NAXIS2"], h["NAXIS1"], fields, unit.data_offset)


def schema(text: Text, names, scale: bool) -> T.StructType:
    return T.StructType([T.StructField("_row", T.LongType(), False), *(T.StructField(f.name, f.spark_type(scale), True, {"tform": f.form} | ({"unit": f.unit} if f.unit else {})) for f in text.chosen(names))])


def column(cells: np.ndarray, f: Field, scale: bool, mask: bool) -> pa.Array:
    """A field of all rows. cells: (rows, bytes of the field)."""
    n, width = cells.shape
    if (cells >= 128).any():
        raise ValueError(f"field {f.name}: text that isn't ASCII")
    offsets = np.arange(n + 1, dtype=np.int32) * width
    texts = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(cells)))
    trimmed = pc.ascii_trim_whitespace(texts)
    null = pc.equal(trimmed, f.null) if f.null is not None else None
    hidden = null if mask and null is not None else None
    masked = lambda x: x if hidden is None else pc.if_else(hidden, pa.scalar(None, x.type), x)
    if f.kind == "A":
        return masked(pc.ascii_rtrim(texts, " "))
    empty = pc.equal(trimmed, "")
    plain = pc.if_else(empty if null is None else pc.or_(empty, null), "0", pc.replace_substring_regex(trimmed, r"^\+", ""))
    if f.kind == "I":
        values = plain.cast(pa.int64())
    else:
        values = pc.replace_substring_regex(plain, "[Dd]", "E").cast(pa.float64())
    if scale and f.unsigned:
        return masked(unsigned64(values.to_numpy(zero_copy_only=False)))
    if scale and (f.scale != 1 or f.zero != 0):
        return masked(pa.array(values.to_numpy(zero_copy_only=False).astype(np.float64) * f.scale + f.zero))
    return masked(values.cast(pa.float32()) if isinstance(f.spark_type(), T.FloatType) else values)


def batches(f, unit: L.Unit, lo: int, hi: int, base: int, names, scale: bool, mask: bool):
    text = parse(unit)
    fields = text.chosen(names)
    step = max(1, (1 << 20) // max(1, text.width))
    for a in range(lo, hi, step):
        b = min(hi, a + step)
        f.seek(text.data_offset + a * text.width)
        raw = np.frombuffer(f.read((b - a) * text.width), np.uint8).reshape(b - a, text.width)
        out = [pa.array(np.arange(base + a, base + b))]
        for c in fields:
            cells = np.ascontiguousarray(raw[:, c.start : c.start + c.width])
            out.append(column(cells, c, scale, mask))
        yield pa.RecordBatch.from_arrays(out, names=["_row", *(c.name for c in fields)])


def read_int(c: Column) -> Column:
    """A text field as an integer: blanks around dropped, an empty field is 0."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))


def read_float(c: Column) -> Column:
    """A text field as a double: D and E both begin an exponent, an empty field is 0."""
    return F.coalesce(F.nullif(F.translate(F.trim(c), "Dd", "EE"), F.lit("")).cast("double"), F.lit(0.0))


def write_int(c: Column, width: int) -> Column:
    return fits_in(F.lpad(c.cast("string"), F.greatest(F.lit(width), F.length(c.cast("string"))), F.lit(" ")), width)


def write_fixed(c: Column, width: int, decimals: int) -> Column:
    return fits_in(F.format_string(f"%{width}.{decimals}f", c.cast("double")), width)


def write_exponent(c: Column, width: int, decimals: int) -> Column:
    return fits_in(F.format_string(f"%{width}.{decimals}E", c.cast("double")), width)


def write_text(c: Column, width: int) -> Column:
    return F.rpad(c, width, " ")


def fits_in(text: Column, width: int) -> Column:
    return F.when(F.length(text) <= width, text).otherwise(F.raise_error(F.lit(f"a value is wider than its field of {width}")))


def fields_for(schema: T.StructType, forms: dict | None = None, widths: dict | None = None, units: dict | None = None) -> list[Field]:
    """A field for each column but _row, one blank between them."""
    out, at = [], 0
    for f in schema.fields:
        if f.name == "_row":
            continue
        form = (forms or {}).get(f.name)
        if form is None:
            if isinstance(f.dataType, T.StringType):
                form = f"A{(widths or {}).get(f.name, 20)}"
            else:
                form = next((v for k, v in FORMS.items() if isinstance(f.dataType, k)), None)
                if form is None:
                    raise ValueError(f"column {f.name}: {f.dataType.simpleString()} has no form in an ASCII table")
        kind, width, decimals = parse_form(form)
        zero = 1 << 63 if isinstance(f.dataType, T.DecimalType) else 0
        out.append(Field(f.name, kind, width, decimals, at, 1.0, zero, None, (units or {}).get(f.name)))
        at += width + 1
    return out


def line(fields: list[Field]) -> Column:
    """A row's line from its columns, as one expression."""
    parts: list[Column] = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        if f.zero:
            c = c - F.lit(str(int(f.zero))).cast("decimal(20,0)")
        parts.append({"A": lambda c=c, f=f: write_text(c, f.width), "I": lambda c=c, f=f: write_int(c, f.width), "F": lambda c=c, f=f: write_fixed(c, f.width, f.decimals), "E": lambda c=c, f=f: write_exponent(c, f.width, f.decimals), "D": lambda c=c, f=f: write_exponent(c, f.width, f.decimals)}[f.kind]())
    return F.concat_ws(" ", *(F.coalesce(p, F.lit(" " * f.width)) for p, f in zip(parts, fields, strict=True)))


def header(fields: list[Field], rows: int, extname: str | None = None, more: dict | None = None) -> Header:
    h = Header()
    width = max((f.start + f.width for f in fields), default=0)
    for k, v in [("XTENSION", "TABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", rows), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(fields))]:
        h.put(k, v)
    for k, f in enumerate(fields, 1):
        h.put(f"TTYPE{k}", f.name)
        h.put(f"TBCOL{k}", f.start + 1)
        h.put(f"TFORM{k}", f.form)
        if f.zero:
            h.put(f"TSCAL{k}", 1)
            h.put(f"TZERO{k}", int(f.zero))
        if f.null is not None:
            h.put(f"TNULL{k}", f.null)
        if f.unit:
            h.put(f"TUNIT{k}", f.unit)
    if extname:
        h.put("EXTNAME", extname)
    h.update(more or {})
    return h
