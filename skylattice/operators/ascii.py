"""ASCII tables out: lines formatted as expressions on executors, joined in order by the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ascii_table as A
from ..functions.forms import primary
from ..sources import storage
from .tables import ordered


def write_ascii(df: DataFrame, path: str, order_by=None, forms: dict | None = None, extname: str | None = None, units: dict | None = None, header: dict | None = None) -> None:
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in (forms or {})]
    widths = {k: max(1, v or 1) for k, v in df.agg(*(F.max(F.octet_length(f"`{c}`")).alias(c) for c in text)).first().asDict().items()} if text else {}
    fields = A.fields_for(df.schema, forms, widths, units)
    order_by = order_by if order_by is not None else ("_row" if "_row" in df.columns else None)
    placed = ordered(df, order_by) if order_by is not None else df
    lines = placed.select(A.line(fields).alias("line"))
    rows = df.count()

    def chunks():
        yield primary()
        yield A.header(fields, rows, extname, header).to_bytes()
        size = 0
        for r in lines.toLocalIterator(prefetchPartitions=True):
            raw = r["line"].encode("ascii")
            size += len(raw)
            yield raw
        yield b" " * (-size % 2880)

    storage.write_bytes(path, chunks())
