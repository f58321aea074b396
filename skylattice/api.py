"""Files as objects: units by number or name, lazy selections as DataFrames, updates, and writing back."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from itertools import chain
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tiles as TL
from .functions.cards import Header
from .functions.forms import primary
from .operators import catalog, image_files, mutate, rewrite, select
from .operators.tables import read as read_table
from .operators.tables import write_table
from .sources import layout as L
from .sources import storage


#: Zero bytes that are written at once.
ZEROS = 16 << 20


class Unit:
    """One unit of an open file."""

    def __init__(self, file: FITS, unit: L.Unit):
        self.file, self.place = file, unit.index

    #: The unit as the file has it now: an update through one handle is seen by all.
    _unit = property(lambda self: self.file._units[self.place])
    index = property(lambda self: self.place)
    kind = property(lambda self: self._unit.kind)
    extname = property(lambda self: self._unit.extname)
    extver = property(lambda self: self._unit.extver)
    has_data = property(lambda self: self._unit.has_data)
    header = property(lambda self: self._unit.header)
    shape = property(lambda self: self._unit.shape)

    # Decoded units kept by Spark: a cache of whole units, bounded by the bytes of their values.

    def _frame(self, **options) -> DataFrame:
        remote = {"remote": self.file.remote} if self.file.remote is not None else {}
        df = read_table(self.file.spark, self.file.path, self.index, lenient=self.file.lenient, **remote, **options)
        return self.file._kept_frame(self.index, tuple(sorted((k, str(v)) for k, v in options.items())), df, prod(self.shape) * max(1, len(df.columns)) * 8)

    tile_cache_size = property(lambda self: self.file._cache_bytes)
    tile_cache_used = property(lambda self: sum(n for (i, _), (_, n) in self.file._kept.items() if i == self.index))

    def set_tile_cache_size(self, size: int) -> None:
        """Units of up to ``size`` bytes together stay decoded on executors once read; 0 keeps none."""
        if size < 0:
            raise ValueError("a cache holds no less than nothing")
        self.file._cache_bytes = size
        self.file._forget(size)

    def clear_tile_cache(self) -> None:
        self.file._forget(0)

    def __len__(self) -> int:
        return self.shape[0] if self.shape else 0

    def __repr__(self) -> str:
        return f"<{self.kind} {self.index} {self.extname or ''} {self.shape}>"

    def edit(self, change) -> None:
        """Change the header by a function of it, in the file."""
        self.file._writable()
        catalog.edit_header(self.file.path, self.index, change)
        self.file._reload()

    def add_checksum(self) -> None:
        self.file._writable()
        catalog.with_checksums(self.file.path, self.index)
        self.file._reload()

    def verify_datasum(self) -> bool | None:
        return catalog.verify(self.file.path, self.index)[0]

    def verify_checksum(self) -> bool | None:
        return catalog.verify(self.file.path, self.index)[1]


class ImageUnit(Unit):
    image = property(lambda self: L.parse_image(self._unit))
    ndim = property(lambda self: len(self.shape))
    dtype = property(lambda self: self.image.value_type())
    bitpix = property(lambda self: self.header.get("ZBITPIX", self.header.get("BITPIX")))
    compression = property(lambda self: self.header.get("ZCMPTYPE"))

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def n_tiles(self) -> int:
        return self.header["NAXIS2"] if self.kind == "zimage" else 1

    def read(self, scale: bool = True, mask_blank: bool = False) -> DataFrame:
        if not self.shape:
            raise ValueError("the image has no axes")
        return self._frame(scale=scale, maskNull=mask_blank)

    def __getitem__(self, key) -> DataFrame:
        return select.section(self.read(), key, self.shape)

    unit = property(lambda self: self.header.get("BUNIT"))
    tile_shape = property(lambda self: TL.parse_tiles(self._unit).tile if self.kind == "zimage" else None)

    @property
    def quantize(self):
        """Method and seed of the dither of a quantised image, by ZQUANTIZ and ZDITHER0."""
        return (str(self.header["ZQUANTIZ"]).strip(), self.header.get("ZDITHER0")) if "ZQUANTIZ" in self.header else None

    def _changed(self, change) -> None:
        with self.file._changing():
            change(image_files.ImageFile(self.file.path, self.index, lambda scale: self.read(scale=scale), lambda: f"{self.file._part_base()}.part"))

    def __setitem__(self, key, value) -> None:
        """hdu[section] = a number, or a DataFrame of just the section's pixels (axes from 0, and value)."""
        self._changed(lambda f: f.set(key, value))

    def extend(self, more: DataFrame, lines: int | None = None, start: int | None = None) -> None:
        """More lines, after the image's own or from ``start`` on."""
        self._changed(lambda f: f.extend(more, lines, start))

    append = extend

    def repack(self) -> None:
        self._changed(lambda f: f.repack())

    @contextmanager
    def extending(self):
        """with hdu.extending() as more: more(lines); more(lines) ...: all are added together on leaving, none after an error."""
        lots: list[tuple[DataFrame, int]] = []

        def more(pixels: DataFrame, lines: int | None = None) -> None:
            n = lines if lines is not None else (pixels.agg(F.max("i0")).first()[0] or 0) + 1
            lots.append((pixels, n))

        with self.file._buffering():
            yield more
        whole, at = None, 0
        for pixels, n in lots:
            moved = pixels.withColumn("i0", F.col("i0") + at)
            whole, at = moved if whole is None else whole.unionByName(moved), at + n
        if whole is not None:
            self.extend(whole, at)


class TableUnit(Unit):
    @property
    def colnames(self) -> list[str]:
        return [f.name for f in self._schema().fields if f.name != "_row"]

    def _schema(self):
        from .sources.fits import schema_of

        return schema_of(self._unit, {})

    dtype = property(_schema)
    ncols = property(lambda self: len(self.colnames))
    nrows = property(lambda self: len(self))

    @property
    def units(self) -> dict:
        return {f.name: f.metadata.get("unit") for f in self._schema().fields if f.name != "_row"}

    @property
    def formats(self) -> list[str]:
        return [f.metadata.get("tform") for f in self._schema().fields if f.name != "_row"]

    @property
    def compression(self) -> dict:
        return {c.name: c.codec for c in L.parse_table(self._unit).columns}

    ztile_rows = property(lambda self: self.header.get("ZTILELEN"))
    n_tiles = property(lambda self: self.header["NAXIS2"] if self.kind == "ztable" else 1)

    def read(self, rows=None, columns=None, scale: bool = True, mask_null: bool = False, as_bytes: bool = False) -> DataFrame:
        """Rows (a slice, a number or a list) of columns, with _row; a list adds _pos, its order."""
        df = self._frame(columns=columns, scale=scale, maskNull=mask_null, asBytes=as_bytes)
        if rows is None:
            return df
        if isinstance(rows, slice):
            return select.slice_rows(df, rows, len(self))
        if isinstance(rows, int) and not isinstance(rows, bool):
            return select.one_row(df, rows, len(self))
        return select.listed_rows(df, list(rows), len(self))

    def read_column(self, name, rows=None, as_bytes: bool = False, **more) -> DataFrame:
        return self.read(rows, [name], as_bytes=as_bytes, **more)

    def __getitem__(self, key):
        if isinstance(key, (slice, int)) and not isinstance(key, bool):
            return self.read(rows=key)
        if isinstance(key, (str, bytes)):
            return Columns(self, [key])
        key = list(key)
        if key and all(isinstance(k, int) and not isinstance(k, bool) for k in key):
            return self.read(rows=key)
        if key and all(isinstance(k, (str, bytes)) for k in key):
            return Columns(self, key)
        raise ValueError("rows by numbers or columns by names")

    def __iter__(self):
        return select.iterate(self.read())

    def iter(self, chunksize: int | None = None, columns=None):
        return select.iterate(self.read(columns=columns), chunksize)

    # Updates: each makes a new table and puts it in the file.

    def replace(self, df: DataFrame) -> None:
        with self.file._changing():
            self.file._put_table(self.index, df)

    @contextmanager
    def appending(self, order=None):
        """with hdu.appending() as more: more(rows); more(rows) ...: all are appended together on leaving, none after an error."""
        lots: list[DataFrame] = []
        with self.file._buffering():
            yield lots.append
        if lots:
            from .operators.tables import numbered

            whole, at = None, 0
            for rows in lots:
                rows = rows if "_row" in rows.columns else numbered(rows, order)
                moved = rows.withColumn("_row", F.col("_row") + at)
                whole, at = moved if whole is None else whole.unionByName(moved), at + rows.count()
            self.append(whole)

    def append(self, more: DataFrame, order=None) -> None:
        self.replace(mutate.append(self.read(), more, len(self), order))

    extend = append

    def set_rows(self, changes: DataFrame, order: str | None = None) -> None:
        self.replace(mutate.set_rows(self.read(), changes, order))

    def __setitem__(self, key, value) -> None:
        """hdu[name] = column expression; hdu[[names]] = {name: expression}; hdu[row, slice or list of rows] = {name: value}, or a
        DataFrame with ``_pos``, the place in the selection, and columns to set there."""
        if isinstance(key, (str, bytes)):
            key, value = [key], {key.decode() if isinstance(key, bytes) else key: value}
        if isinstance(key, (list, tuple)) and key and all(isinstance(k, (str, bytes)) for k in key):
            names = Columns(self, list(key)).names
            if set(value) != set(names):
                raise ValueError(f"values of {names}")
            df = self.read()
            for n in names:
                df = mutate.set_column(df, select.select_columns(df, [n], ()).columns[0], value[n])
            return self.replace(df)
        n = len(self)
        if isinstance(key, int) and not isinstance(key, bool):
            rows: range | list[int] = [key]
        elif isinstance(key, slice):
            rows = range(*key.indices(n))
        elif isinstance(key, (list, tuple)) and key and all(isinstance(k, int) and not isinstance(k, bool) for k in key):
            rows = list(key)
        else:
            raise ValueError("rows by numbers or columns by names")
        if not len(rows):
            raise ValueError("no rows chosen")
        if any(not -n <= r < n for r in (rows if isinstance(rows, list) else (rows[0], rows[-1]))):
            raise IndexError("a row outside of the table")
        if isinstance(value, DataFrame):
            if isinstance(rows, range):
                at = (F.col("_pos") * rows.step + rows.start).cast("long")
            else:  # of a row that is listed twice the last value counts
                at = F.element_at(F.array(*(F.lit(r % n).cast("long") for r in rows)), (F.col("_pos") + 1).cast("int"))
            if value.filter((F.col("_pos") < 0) | (F.col("_pos") >= len(rows))).limit(1).count():
                raise ValueError(f"the selection has {len(rows)} rows")
            return self.replace(mutate.set_rows(self.read(), value.withColumn("_row", at), "_pos"))
        here = (F.col("_row").between(min(rows), max(rows)) & (F.pmod(F.col("_row") - rows.start, F.lit(abs(rows.step))) == 0)) if isinstance(rows, range) else F.col("_row").isin([r % n for r in rows])
        df = self.read()
        for name, v in value.items():
            df = mutate.set_where(df, select.select_columns(df, [name], ()).columns[0], here, v)
        self.replace(df)

    def insert_column(self, name: str, value, **place) -> None:
        self.replace(mutate.insert_column(self.read(), name, value, **place))

    def delete_column(self, key) -> None:
        self.replace(mutate.delete_column(self.read(), key))

    def repack(self) -> None:
        self.replace(self.read())


class Columns:
    """Chosen columns; nothing is read until rows are asked for."""

    def __init__(self, unit: TableUnit, names: list):
        L_names = [n.decode() if isinstance(n, bytes) else n for n in names]
        self.unit, self.names = unit, L_names
        known = {c.strip().upper() for c in unit.colnames}
        if any(n.strip().upper() not in known for n in L_names) or len({n.strip().upper() for n in L_names}) < len(L_names):
            raise ValueError("an unknown column, or a column twice")

    def read(self, rows=None, **more) -> DataFrame:
        return self.unit.read(rows, self.names, **more)

    def __getitem__(self, rows) -> DataFrame:
        return self.read(rows)


class FITS:
    """An open file. mode: r, r+ (updates rewrite the file), or w+ (a new one)."""

    def __init__(self, spark: SparkSession, path, mode: str = "r", *, lenient: bool = False, remote=None):
        if mode not in ("r", "r+", "w+"):
            raise ValueError("modes are r, r+ and w+")
        self.spark, self.path, self.mode, self.lenient, self.remote = spark, storage.coerce(path), mode, lenient, remote
        self.closed = self.tainted = self.buffers = False
        self._kept: dict = {}
        self._cache_bytes = 0
        if mode != "r" and storage.kind_of(self.path) in ("http", "ftp"):
            raise OSError("remote files are read-only")
        if mode == "w+":
            self._units: list[L.Unit] = []
            self._chunks: list[bytes] = []
        else:
            self._reload()

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: bytes, mode: str = "r", **more) -> FITS:
        if mode == "w+" or not data:
            raise ValueError("bytes of a file, to read or to update")
        path = f"mem://{uuid.uuid4().hex}"
        storage.write_bytes(path, [bytes(data)])
        return cls(spark, path, mode, **more)

    def to_bytes(self) -> bytes:
        with storage.open_read(self.path, self.remote) as f:
            return f.read()

    def _reload(self) -> None:
        self._units = catalog.units(self.path, self.lenient, self.remote)

    def _writable(self) -> None:
        if self.closed or self.mode == "r":
            raise OSError("the file isn't open for writing")
        if self.tainted:
            raise OSError("a write failed midway; open the file again")
        if self.buffers:
            raise OSError("rows or lines are being buffered; leave that context first")

    @contextmanager
    def _changing(self):
        """A write: decoded units are forgotten, and where it fails while the file may be half written, the handle is of no more use."""
        self._writable()
        before = self._stamp()
        try:
            yield
        except BaseException:
            self.tainted = self._stamp() != before
            raise
        self._forget(0)
        self._reload()

    def _stamp(self):
        if storage.kind_of(self.path) != "local" or not os.path.exists(self.path):
            return None
        info = os.stat(self.path)
        return info.st_mtime_ns, info.st_size, info.st_ino

    @contextmanager
    def _buffering(self):
        self._writable()
        self.buffers = True
        try:
            yield
        finally:
            self.buffers = False

    def _kept_frame(self, index: int, options: tuple, df: DataFrame, size: int) -> DataFrame:
        """df, kept decoded where the cache has room for it; the oldest give way."""
        if not 0 < size <= self._cache_bytes:
            return df
        key = (index, options)
        if key not in self._kept:
            self._forget(self._cache_bytes - size)
            self._kept[key] = (df.persist(), size)
        return self._kept[key][0]

    def _forget(self, room: int) -> None:
        """Decoded units leave until those left have ``room`` bytes at most."""
        while self._kept and sum(n for _, n in self._kept.values()) > room:
            self._kept.pop(next(iter(self._kept)))[0].unpersist()

    @property
    def hdus(self) -> list[Unit]:
        kinds = {"image": ImageUnit, "zimage": ImageUnit, "table": TableUnit, "ztable": TableUnit, "ascii": TableUnit}
        return [kinds.get(u.kind, Unit)(self, u) for u in self._units]

    def __len__(self) -> int:
        return len(self._units)

    def __iter__(self):
        return iter(self.hdus)

    def __getitem__(self, key) -> Unit:
        return self.hdus[L.find(self._units, key).index]

    def __contains__(self, key) -> bool:
        try:
            L.find(self._units, key)
        except ValueError:
            return False
        return True

    def __repr__(self) -> str:
        return "\n".join([f"<FITS {self.path} {self.mode}>", *map(repr, self.hdus)])

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def sync(self) -> None:
        """All writes are whole files that are renamed into place, so nothing waits."""

    def close(self) -> None:
        self._forget(0)
        self.closed = True

    def _put_table(self, index: int, df: DataFrame) -> None:
        """The file with one table's unit replaced; columns that stay keep their forms, and the unit its own cards."""
        self._writable()
        part = f"{self._part_base()}.new.fits"
        old = self._units[index]
        if old.kind == "ascii":
            from .functions import ascii_table as A
            from .operators.ascii import write_ascii

            own = {f.name: f for f in A.parse(old).fields}
            same = {f.name: own[f.name] for f in df.schema.fields if f.name in own and f.dataType == own[f.name].spark_type()}
            write_ascii(df, part, "_row", {n: f.form for n, f in same.items()}, old.extname, {n: f.unit for n, f in same.items() if f.unit})
        else:
            columns = L.parse_table(old).columns
            df, forms, named = rewrite.kept_forms(df, columns)
            if old.kind == "ztable":
                from .operators.compressed import write_compressed_table

                codecs = {c.name: str(c.codec).strip() for c in columns if c.codec and c.name in forms}
                write_compressed_table(df, part, compress=codecs, tile_rows=old.header["ZTILELEN"], forms=forms, extname=old.extname, units=named)
            else:
                write_table(df, part, "_row", forms=forms, units=named, extname=old.extname)
        self._splice(part, index, index + 1)
        self[index].edit(lambda h: rewrite.carry(old.header, h))

    def _part_base(self) -> str:
        """Where new units are written first: beside the file, or in the shared folder where it is in memory."""
        if storage.kind_of(self.path) != "memory":
            return f"{self.path}.{uuid.uuid4().hex}"
        from .plans.scratch import scratch

        return scratch(self.spark, "unit")

    def _splice(self, part: str, lo: int, hi: int, which: int = -1) -> None:
        """Units lo .. hi - 1 give way to a unit of another file, the last one; bytes are copied some at a time."""
        new = catalog.units(part)[which]
        if not self._units:
            storage.write_bytes(self.path, storage.ranges(part, 0, storage.size_of(part)))
        else:
            end = self._units[-1].data_offset + self._units[-1].padded
            start = self._units[lo].header_offset if lo < len(self._units) else end
            stop = self._units[hi].header_offset if hi < len(self._units) else end

            def chunks():
                yield from storage.ranges(self.path, 0, start)
                yield from storage.ranges(part, new.header_offset, new.data_offset + new.padded)
                yield from storage.ranges(self.path, stop, end)

            storage.write_bytes(self.path, chunks())
        storage.remove(part)
        self._reload()

    def write_table(self, df: DataFrame, order_by=None, compress=None, ascii: bool = False, extname: str | None = None, **more) -> Unit:
        self._writable()
        part = f"{self._part_base()}.new.fits"
        if ascii:
            from .operators.ascii import write_ascii

            write_ascii(df, part, order_by, extname=extname, **more)
        elif compress:
            from .operators.compressed import write_compressed_table

            write_compressed_table(df, part, order_by, None if compress is True else compress, extname=extname, **more)
        else:
            write_table(df, part, order_by, extname=extname, **more)
        self._splice(part, len(self._units), len(self._units))
        return self[-1]

    def _put_new(self, header: Header, size: int) -> Unit:
        """A new last unit whose data are ``size`` zero bytes."""
        part = f"{self._part_base()}.new.fits"
        first = [] if header.get("SIMPLE") is not None else [primary()]
        zeros = (bytes(min(ZEROS, size + -size % 2880 - at)) for at in range(0, size + -size % 2880, ZEROS))
        storage.write_bytes(part, chain(first, [header.to_bytes()], zeros))
        self._splice(part, len(self._units), len(self._units))
        return self[-1]

    def create_image(self, shape: tuple[int, ...], kind: str, compress=None, quantize=None, extname: str | None = None, blank: int | None = None, header: dict | None = None) -> Unit:
        """An image whose stored bytes are zeros; its slowest axis may have no lines yet. A compressed one holds pixels of 0."""
        from .operators.images import KINDS, image_header

        self._writable()
        if any(n <= 0 for n in shape[1:]) or shape and shape[0] < 0:
            raise ValueError("axes but the slowest hold pixels")
        if compress is not None:
            pixels, rest = self.spark.range(prod(shape)), F.col("id")
            for k in range(len(shape) - 1, -1, -1):
                pixels, rest = pixels.withColumn(f"i{k}", F.pmod(rest, F.lit(shape[k]))), F.floor(rest / shape[k])
            return self.write_image(pixels.select(*(f"i{k}" for k in range(len(shape))), F.lit(0).alias("value")), shape, kind, compress, quantize, extname, blank=blank, header=header)
        import numpy as np

        return self._put_new(image_header(shape, kind, extname, blank, header, not self._units), prod(shape) * np.dtype(KINDS[kind][0]).itemsize if shape else 0)

    def create_table(self, schema, rows: int = 0, forms: dict | None = None, units: dict | None = None, extname: str | None = None, header: dict | None = None) -> Unit:
        """A table of ``rows`` rows of zero bytes, with the columns of a Spark schema (or its DDL)."""
        from pyspark.sql.types import StructType

        from .functions.forms import columns_for, table_header

        self._writable()
        if rows < 0:
            raise ValueError("a table has no less than no rows")
        columns = columns_for(StructType.fromDDL(schema) if isinstance(schema, str) else schema, forms, units)
        return self._put_new(table_header(columns, rows, 0, extname, header), rows * sum(c.width for c in columns))

    def write_image(self, pixels: DataFrame, shape: tuple[int, ...], kind: str, compress=None, quantize=None, extname: str | None = None, **more) -> Unit:
        from .operators.images import write_compressed, write_image

        self._writable()
        part = f"{self._part_base()}.new.fits"
        if compress:
            write_compressed(pixels, part, shape, kind, compress, quantize, extname=extname, **more)
        else:
            write_image(pixels, part, shape, kind, extname=extname, first=not self._units, **more)
        self._splice(part, len(self._units), len(self._units))
        return self[-1]


def read(spark: SparkSession, path, ext=None) -> DataFrame:
    """The first unit with data, or the one asked for."""
    return read_table(spark, storage.coerce(path), ext)


def read_header(path, ext=0) -> Header:
    return L.find(catalog.units(storage.coerce(path)), ext).header


def write(df: DataFrame, path, mode: str = "w+", **more) -> None:
    """A table, or an image where df has axes and a value."""
    axes = [c for c in df.columns if c.startswith("i") and c[1:].isdigit()]
    with FITS(df.sparkSession, path, mode) as f:
        if axes and df.columns[-1] == "value" and len(df.columns) == len(axes) + 1:
            kinds = {"tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8"}
            top = df.agg(*(F.max(a).alias(a) for a in axes)).first()
            f.write_image(df, tuple(top[a] + 1 for a in axes), kinds[df.schema["value"].dataType.simpleString()], **more)
        else:
            f.write_table(df, **more)
