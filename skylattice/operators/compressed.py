"""Compressed tables out: tiles of rows encoded where their rows are gathered."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ztable as Z
from ..functions.forms import columns_for, primary, table_header
from ..sources import storage
from .publish import Publication
from .tables import measured_forms, numbered

#: What an encoded tile is: of each column in turn its bytes, and of variable-length ones the elements and bytes of their cells.
ENCODED = "tile long, rows long, data array<binary>, counts array<array<long>>, sizes array<array<long>>"


def write_compressed_table(df: DataFrame, path: str, order_by=None, compress: str | dict | None = None, tile_rows: int | None = None, forms: dict | None = None, extname: str | None = None, units: dict | None = None, dataset: bool = False) -> None:
    """compress: one codec for all columns, or codecs by name; each letter has its own otherwise.

    The driver copies encoded tiles to one file, one after another. dataset: a folder with a file for each tile, written by tasks.
    """
    if "_row" not in df.columns:
        df = numbered(df, order_by)
    forms = measured_forms(df, forms)
    columns = columns_for(df.schema, forms, units)
    asked = compress if isinstance(compress, dict) else {c.name: compress for c in columns if compress and compress in Z.ALLOWED.get(c.letter, ("GZIP_1",))}
    codecs = {c.name: Z.codec_for(c, asked.get(c.name)) for c in columns}
    rows = df.count()
    tile = tile_rows or Z.default_tile(rows, sum(c.width for c in columns))
    tiles = df.groupBy(F.expr(f"_row div {tile}").alias("tile"))

    def encoded(table) -> list:
        table = table.sort_by("_row").combine_chunks()
        return Z.encode_tile(table.to_batches()[0], columns, codecs)

    if dataset:
        out = Publication(path)

        def write(key, table):
            unit = Z.Unit(columns, codecs, tile)
            name = out.part(key[0].as_py())
            body = list(unit.add(table.num_rows, encoded(table)))
            storage.write_bytes(name, chain([primary()], unit.chunks(table_header(columns, table.num_rows, 0, extname), body)))
            return pa.table({"path": pa.array([name])})

        out.publish(tiles.applyInArrow(write, "path string"))
        return

    def encode(key, table):
        got = encoded(table)
        flat = [blob if not c.inner else b"".join(x for _, x in cells) for c, (blob, cells) in zip(columns, got, strict=True)]
        counts, sizes = ([[pick(cell) for cell in cells] for _, cells in got] for pick in (lambda x: x[0], lambda x: len(x[1])))
        lists = pa.list_(pa.list_(pa.int64()))
        return pa.table({"tile": pa.array([key[0].as_py()]), "rows": pa.array([table.num_rows]), "data": pa.array([flat], pa.list_(pa.binary())), "counts": pa.array([counts], lists), "sizes": pa.array([sizes], lists)})

    unit, heap = Z.Unit(columns, codecs, tile), f"{path}.{Publication(path).run}.heap"
    with storage.open_write(heap) as file:
        for r in tiles.applyInArrow(encode, ENCODED).orderBy("tile").toLocalIterator():
            got = []
            for c, data, counts, sizes in zip(columns, r["data"], r["counts"], r["sizes"], strict=True):
                ends = np.cumsum(sizes).tolist()
                got.append((b"", [(n, bytes(data[b - k : b])) for n, k, b in zip(counts, sizes, ends, strict=True)]) if c.inner else (bytes(data), []))
            for chunk in unit.add(r["rows"], got):
                file.write(chunk)
    storage.write_bytes(path, chain([primary()], unit.chunks(table_header(columns, rows, 0, extname), storage.ranges(heap, 0, unit.heap))))
    storage.remove(heap)
