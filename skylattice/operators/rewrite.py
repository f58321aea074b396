"""What a table keeps when it is written again: forms, dimensions, scaling, nulls, units, codecs, and its own cards.

A column of the new rows keeps the old one's form if it still has its name and type. Physical values of scaled columns are
stored with the same scale again. Text grows where longer values ask for it. All other columns are measured anew.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cards import COMMENTARY, Header, is_protected
from ..functions.forms import form_width
from ..sources import layout as L

#: Spark types of stored integers and floats.
STORED = {"B": T.ShortType(), "I": T.ShortType(), "J": T.IntegerType(), "K": T.LongType(), "E": T.FloatType(), "D": T.DoubleType()}


def unscaled(value, c: L.Column, kind: T.DataType):
    """Physical values, in lists or alone, as stored ones: halves go to the even number."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: unscaled(x, c, kind.elementType))
    stored = (value - F.lit(float(c.zero))) / F.lit(float(c.scale))
    return (stored if c.element in "ED" else F.bround(stored, 0)).cast(STORED[c.element])


def kept_forms(df: DataFrame, old: list[L.Column]) -> tuple[DataFrame, dict, dict]:
    """(df with stored values in scaled columns, forms by name, units by name)."""
    known = {c.name.strip().upper(): c for c in old}
    forms, units, texts = {}, {}, {}
    for f in df.schema.fields:
        c = known.get(f.name.strip().upper())
        if c is None or f.dataType != c.spark_type():
            continue
        form = re.sub(r"\(.*\)", "", c.format.strip())
        if c.unit:
            units[f.name] = c.unit
        if c.letter == "A" and not c.dims:
            texts[f.name] = form_width(form)
            continue
        forms[f.name] = {"form": form, "dim": list(c.dims), "zero": c.zero, "scale": c.scale, "null": c.null} | ({"width": c.char_width} if c.letter == "A" else {})
        if c.scaled:
            df = df.withColumn(f.name, unscaled(F.col(f"`{f.name}`"), c, f.dataType))
    if texts:
        got = df.agg(*(F.max(F.octet_length(F.col(f"`{n}`"))).alias(n) for n in texts)).first().asDict()
        forms |= {n: f"{max(w, got[n] or 0)}A" for n, w in texts.items()}
    return df, forms, units


def carry(old: Header, new: Header) -> None:
    """The old header's own cards into the new one. Cards of a column go to the column of its name; TUNIT is written with the column."""
    names = lambda h: {str(h.get(f"TTYPE{k}", "")).strip().upper(): k for k in range(h.get("TFIELDS", 0), 0, -1)}
    was, now = {k: n for n, k in names(old).items()}, names(new)
    for e in old.entries:
        if e.key in COMMENTARY:
            new._commentary(e.key, e.value)
            continue
        column = re.fullmatch(r"(TDISP|TUNIT|TCOMM|TUCD|TLMIN|TLMAX|TDMIN|TDMAX)(\d+)", e.name)
        if column:
            k = now.get(was.get(int(column[2]), ""))
            if k and column[1] != "TUNIT":
                new.put(f"{column[1]}{k}", e.value, e.comment)
        elif not is_protected(e.key) and e.name not in ("BSCALE", "BZERO", "BLANK"):
            new.put(e.key, e.value, e.comment)
