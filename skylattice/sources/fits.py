"""The Spark data source ``fits``: tables, compressed tables, ASCII tables and images as DataFrames, and a sink.

Reading: each input partition is a range of rows, tiles or image lines of one file; it seeks to its bytes and yields
Arrow batches. ``_row`` (or the axes ``i0``, ``i1`` ...) gives each row's place. Filters on ``_row`` and on axes are pushed
down: bounds and lists of rows or lines choose partitions and the runs read in them, bounds on other axes the tiles that are
decoded. The option ``columns`` decodes no others.

Options: hdu (number or EXTNAME), columns (JSON list or comma-separated), scale, maskNull, asBytes, lenient, rowsPerPartition,
remote. A path that is a folder reads the same HDU of all its files; rows are then numbered through.

Writing: tasks encode their rows to part files beside the target; the driver's commit writes the header and joins the
parts in partition order. With ``dataset=true`` each task finishes a file of its own, and the commit only renames them
into a folder, which is the form for large data: nothing then passes through one machine. Files of a later write follow
those that are there, or take their place in mode overwrite.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from bisect import bisect_left
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions import rows as R
from ..functions.cards import BLOCK
from . import layout as L
from . import storage

#: Bytes of rows that an input partition holds, plain and where tiles have to be decoded, and that a batch decodes at once.
PARTITION_BYTES, PACKED_BYTES, BATCH_BYTES = 32 << 20, 4 << 20, 4 << 20
#: Bytes between two rows of a list that are read over rather than sought past.
GAP_BYTES = 1 << 16
#: Rows from which on a batch goes out alone.
BATCH_ROWS = 1000


def flag(options, name: str, default: bool) -> bool:
    return str(options.get(name, options.get(name.lower(), default))).lower() in ("true", "1", "yes")


def column_list(options) -> list[str] | None:
    text = options.get("columns")
    if text is None:
        return None
    return json.loads(text) if text.lstrip().startswith("[") else [x for x in text.split(",") if x]


def hdu_key(text):
    return int(text) if str(text).lstrip("-").isdigit() else text


def default_unit(units: list[L.Unit]) -> L.Unit:
    """The first unit with data."""
    for u in units:
        if u.has_data:
            return u
    raise ValueError("no HDU holds data")


@dataclass
class Part(InputPartition):
    """Runs (lo, hi) of rows lo .. hi - 1 (or lines of an image) of one file; base: the number of its first row.

    box: bounds (start, stop) on the other axes of an image.
    """

    path: str
    runs: list
    base: int
    box: tuple | None


class FitsReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.options, self.schema = {k.lower(): v for k, v in dict(options).items()}, schema
        self.bounds: dict[str, list[float]] = {}
        self.only: list[int] | None = None

    def pushFilters(self, filters: list[Filter]):
        """Bounds on _row and on axes, and lists of rows or lines, narrow the plan; Spark applies all filters again."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at and len(at) == 1 and re.fullmatch(r"_row|i\d+", at[0]):
                bound = self.bounds.setdefault("i0" if at[0] == "_row" else at[0], [-np.inf, np.inf])
                low, high = -np.inf, np.inf
                if isinstance(f, (GreaterThanOrEqual, EqualTo)):
                    low = f.value
                if isinstance(f, (LessThanOrEqual, EqualTo)):
                    high = f.value
                if isinstance(f, GreaterThan):
                    low = f.value + 1
                if isinstance(f, LessThan):
                    high = f.value - 1
                if isinstance(f, In):
                    wanted = sorted({int(v) for v in f.value if v is not None})
                    low, high = min(wanted, default=np.inf), max(wanted, default=-np.inf)
                    if at[0] in ("_row", "i0"):
                        self.only = wanted if self.only is None else sorted(set(self.only) & set(wanted))
                bound[0], bound[1] = max(bound[0], low), min(bound[1], high)
            yield f

    def _runs(self, lo: int, hi: int, gap: int) -> list[tuple[int, int]]:
        """Runs of rows that filters leave of rows lo .. hi - 1 (counted through all files); gaps of up to ``gap`` rows are read over."""
        low, high = self.bounds.get("i0", (-np.inf, np.inf))
        a, b = max(lo, int(low) if low > lo else lo), min(hi, int(high) + 1 if high < hi else hi)
        if a >= b or low > high:
            return []
        if self.only is None:
            return [(a, b)]
        some = np.array(self.only[bisect_left(self.only, a) : bisect_left(self.only, b)], np.int64)
        return [(int(r[0]), int(r[-1]) + 1) for r in np.split(some, np.flatnonzero(np.diff(some) > gap) + 1) if len(r)]

    def partitions(self):
        out, base = [], 0

        def unit_at(path: str) -> L.Unit:
            with storage.open_read(path, self.options.get("remote")) as f:
                return unit_of(L.walk(f, flag(self.options, "lenient", False)), self.options)

        paths = storage.paths_of(self.options["path"])
        with ThreadPoolExecutor(min(32, len(paths))) as pool:  # headers of many files at a time; reading them waits for the store
            units = list(pool.map(unit_at, paths))
        for path, unit in zip(paths, units, strict=True):
            count, size, step = extent(unit)
            box = None
            if unit.kind in ("image", "zimage"):
                ends = [(n, *self.bounds.get(f"i{k}", (-np.inf, np.inf))) for k, n in enumerate(unit.shape[1:], 1)]
                box = tuple((int(max(0, low)) if low < n else n, int(min(n - 1, high)) + 1 if high >= 0 else 0) for n, low, high in ends)
            room = PACKED_BYTES if unit.kind in ("zimage", "ztable") else PARTITION_BYTES
            lots = int(self.options.get("rowsperpartition", 0)) or max(1, room // max(1, size))
            lots = max(step, lots // step * step)
            for lo in range(0, count, lots):
                runs = self._runs(base + lo, base + min(count, lo + lots), max(step, GAP_BYTES // max(1, size)))
                if runs:
                    out.append(Part(path, [(a - base, b - base) for a, b in runs], base, box))
            base += count
        return out or [Part("", [], 0, None)]

    def read(self, part: Part):
        if not part.path:
            return
        options = self.options
        with storage.open_read(part.path, options.get("remote")) as f:
            unit = unit_of(L.walk(f, flag(options, "lenient", False)), options)
            waiting: list[pa.RecordBatch] = []
            for lo, hi in part.runs:
                for batch in batches(f, unit, lo, hi, part.base, options, part.box):
                    waiting.append(batch)
                    if sum(b.num_rows for b in waiting[-2:]) >= BATCH_ROWS or len(waiting) >= 1000:  # short runs share a batch
                        yield from together(waiting)
                        waiting = []
            yield from together(waiting)


def together(waiting: list[pa.RecordBatch]):
    if len(waiting) > 1:
        waiting = pa.Table.from_batches(waiting).combine_chunks().to_batches()
    yield from waiting


def unit_of(units: list[L.Unit], options) -> L.Unit:
    key = options.get("hdu")
    return default_unit(units) if key is None else L.find(units, hdu_key(key))


def extent(unit: L.Unit) -> tuple[int, int, int]:
    """(rows or lines, bytes of each, rows that can't be parted)."""
    if unit.kind in ("image", "zimage"):
        shape = unit.shape
        if not shape:
            raise ValueError("the image has no axes")
        line = int(np.prod(shape[1:], dtype=np.int64))
        step = 1
        if unit.kind == "zimage":
            from ..functions.tiles import parse_tiles

            step = parse_tiles(unit).tile[0]
        return shape[0], line * 8, step
    if unit.kind == "ascii":
        return unit.header["NAXIS2"], unit.header["NAXIS1"], 1
    table = L.parse_table(unit)
    return table.rows, table.width, table.tile or 1


def schema_of(unit: L.Unit, options) -> T.StructType:
    scale, names = flag(options, "scale", True), column_list(options)
    if unit.kind in ("image", "zimage"):
        axes = [T.StructField(f"i{k}", T.LongType(), False) for k in range(len(unit.shape))]
        return T.StructType([*axes, T.StructField("value", L.parse_image(unit).value_type(scale))])
    if unit.kind == "ascii":
        from ..functions import ascii_table

        return ascii_table.schema(ascii_table.parse(unit), names, scale)
    if unit.kind in ("table", "ztable"):
        table = L.parse_table(unit)
        return table.schema(table.chosen(names), scale, flag(options, "asBytes", False))
    raise ValueError(f"HDU {unit.index} holds no table or image")


def batches(f, unit: L.Unit, lo: int, hi: int, base: int, options, box=None):
    """Arrow batches of rows lo .. hi - 1; box: bounds on an image's other axes."""
    if hi <= lo:
        return
    scale, mask, names = flag(options, "scale", True), flag(options, "maskNull", False), column_list(options)
    if unit.kind in ("image", "zimage"):
        from ..functions import images

        yield from images.batches(f, unit, lo, hi, base, scale, mask, box)
    elif unit.kind == "ascii":
        from ..functions import ascii_table

        yield from ascii_table.batches(f, unit, lo, hi, base, names, scale, mask)
    elif unit.kind == "ztable":
        from ..functions import ztable

        yield from ztable.batches(f, unit, lo, hi, base, names, scale, mask)
    else:
        yield from table_batches(f, unit.table, lo, hi, base, names, scale, mask, flag(options, "asBytes", False))


def heap_cells(f, table: L.Table, c: L.Column, descriptors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, heap bytes, starts in them) of a variable-length column, in reads of neighbouring cells."""
    kind = ">i4" if c.letter == "P" else ">i8"
    pairs = np.ascontiguousarray(descriptors).view(kind).reshape(-1, 2).astype(np.int64)
    counts, offsets = pairs[:, 0], pairs[:, 1]
    size = R.cell_bytes(c.inner, counts)
    order = np.argsort(offsets, kind="stable")
    starts, chunks, total = np.zeros(len(counts), np.int64), [], 0
    i = 0
    order = order[size[order] > 0]
    while i < len(order):
        first = offsets[order[i]]
        ends = np.maximum.accumulate(offsets[order[i:]] + size[order[i:]])
        gap = np.flatnonzero(offsets[order[i + 1 :]] > ends[:-1] + 65536)
        j = i + (int(gap[0]) + 1 if len(gap) else len(ends))
        f.seek(table.heap_offset + int(first))
        raw = f.read(int(ends[j - i - 1] - first))
        chunks.append(np.frombuffer(raw, np.uint8))
        starts[order[i:j]] = offsets[order[i:j]] - first + total
        total += len(raw)
        i = j
    return counts, np.concatenate(chunks) if chunks else np.zeros(0, np.uint8), starts


def table_batches(f, table: L.Table, lo: int, hi: int, base: int, names, scale: bool, mask: bool, as_bytes: bool):
    columns = table.chosen(names)
    step = max(1, BATCH_BYTES // max(1, table.width))
    for a in range(lo, hi, step):
        b = min(hi, a + step)
        f.seek(table.data_offset + a * table.width)
        raw = np.frombuffer(f.read((b - a) * table.width), np.uint8)
        if len(raw) != (b - a) * table.width:
            raise OSError("the file ends inside its rows")
        raw = raw.reshape(b - a, table.width)
        out = [pa.array(np.arange(base + a, base + b))]
        for c in columns:
            cell = np.ascontiguousarray(raw[:, c.offset : c.offset + c.width])
            if c.inner:
                counts, heap, starts = heap_cells(f, table, c, cell)
                out.append(R.variable(counts, heap, starts, c, scale, mask, as_bytes))
            else:
                out.append(R.fixed(cell, c, scale, mask, as_bytes))
        yield pa.RecordBatch.from_arrays(out, names=["_row", *(c.name for c in columns)])


class FitsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> T.StructType:
        first = storage.paths_of(self.options["path"])[0]
        with storage.open_read(first, self.options.get("remote")) as f:
            return schema_of(unit_of(L.walk(f, flag(self.options, "lenient", False)), self.options), self.options)

    def reader(self, schema: T.StructType) -> FitsReader:
        return FitsReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> FitsWriter:
        return FitsWriter(dict(self.options), schema, overwrite)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    rows: int
    main: str
    heap: str
    heap_bytes: int


class FitsWriter(DataSourceArrowWriter):
    """Rows to a binary table. Options: columns' forms as JSON by name (``forms``), extname, dataset, units, header."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        from ..functions.forms import columns_for

        self.path, self.options, self.overwrite = options["path"], options, overwrite
        self.columns = columns_for(schema, json.loads(options.get("forms", "{}")), json.loads(options.get("units", "{}")))
        self.run = uuid.uuid4().hex
        self.dataset, self.began = flag(options, "dataset", False), time.time_ns() // 1_000_000
        self.about = {"extname": options.get("extname"), "header": json.loads(options.get("header", "{}")), "checksum": flag(options, "checksum", False)}

    def write(self, iterator):
        from pyspark import TaskContext

        from ..functions.forms import table_file

        task = TaskContext.get()
        head = f"{self.path}.parts-{self.run}/{task.partitionId():08d}-{task.taskAttemptId()}"
        n = heap = 0
        with ExitStack() as files:
            main_file = heap_file = None
            for batch in iterator:
                if not batch.num_rows:
                    continue
                main, cells = encode_batch(batch, self.columns, heap)
                main_file = main_file or files.enter_context(storage.open_write(head + ".main"))
                main_file.write(main.tobytes())
                if cells:
                    heap_file = heap_file or files.enter_context(storage.open_write(head + ".heap"))
                    heap_file.write(cells)
                n, heap = n + batch.num_rows, heap + len(cells)
        done = Written(task.partitionId(), n, head + ".main" if n else "", head + ".heap" if heap else "", heap)
        if self.dataset and n:
            storage.write_bytes(head + ".fits", table_file([done], self.columns, **self.about))
            return Written(done.partition, n, head + ".fits", "", heap)
        return done

    def commit(self, messages):
        from ..functions.forms import table_file

        done = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        if self.dataset:
            old = storage.paths_of(self.path) if self.overwrite else []
            for m in done:
                storage.move(m.main, f"{self.path}/part-{self.began:014d}-{self.run[:8]}-{m.partition:08d}.fits")
            for path in old:
                if path != self.path:
                    storage.remove(path)
        else:
            storage.write_bytes(self.path, table_file(done, self.columns, **self.about))
        self._clean()

    def abort(self, messages):
        self._clean()

    def _clean(self):
        storage.remove_folder(f"{self.path}.parts-{self.run}")


def encode_batch(batch: pa.RecordBatch, columns: list[L.Column], heap: int) -> tuple[np.ndarray, bytes]:
    """(rows' bytes, heap bytes); descriptors count from the start of the part's heap, where ``heap`` bytes lie before."""
    width = sum(c.width for c in columns)
    out = np.zeros((batch.num_rows, width), np.uint8)
    cells = []
    for c in columns:
        values = batch.column(c.name)
        if c.inner:
            counts, data, size = R.encode_variable(values, c)
            pairs = np.stack([counts, heap + np.cumsum(size) - size], 1).astype(">i4" if c.letter == "P" else ">i8")
            if c.letter == "P" and heap + int(size.sum()) >= 1 << 31:
                raise ValueError(f"column {c.name}: the heap outgrows 32-bit descriptors; use the form 1Q")
            out[:, c.offset : c.offset + c.width] = np.ascontiguousarray(pairs).view(np.uint8).reshape(-1, c.width)
            cells.append(data.tobytes())
            heap += int(size.sum())
        else:
            out[:, c.offset : c.offset + c.width] = R.encode_fixed(values, c)
    return out, b"".join(cells)


def register(spark) -> None:
    """Make ``fits`` known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FitsDataSource)


def pad(n: int) -> int:
    return -n % BLOCK
