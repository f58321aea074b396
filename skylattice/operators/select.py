"""Selection by place: rows by slices, numbers and lists, columns by name, and image sections by axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of a list that are given to the reader one by one.
LISTED = 10_000


def slice_rows(df: DataFrame, key: slice, rows: int, place: str | None = None) -> DataFrame:
    """Rows of a Python slice (its step may be negative), as a filter on _row that reaches the reader. No row is an error.

    place: name of a column for the position in the result.
    """
    start, stop, step = key.indices(rows)
    n = len(range(start, stop, step))
    if not n:
        raise ValueError("the slice selects no rows")
    low, high = min(start, start + (n - 1) * step), max(start, start + (n - 1) * step)
    out = df.filter((F.col("_row") >= low) & (F.col("_row") <= high))
    if abs(step) > 1:
        out = out.filter(F.pmod(F.col("_row") - start, F.lit(abs(step))) == 0)
    return out.withColumn(place, F.expr(f"(_row - {start}) div {step}")) if place else out


def one_row(df: DataFrame, i: int, rows: int) -> DataFrame:
    """Row i; negative numbers count from the end."""
    if not -rows <= i < rows:
        raise IndexError(f"row {i} of {rows}")
    return df.filter(F.col("_row") == i % rows)


def listed_rows(df: DataFrame, wanted: list[int], rows: int, place: str = "_pos") -> DataFrame:
    """Rows of a list, each once, with their place in it; negative numbers count from the end.

    The list is the caller's own, so it is small. Up to ``LISTED`` rows reach the reader, which reads no others; of longer
    lists their bounds do.
    """
    if not wanted:
        raise ValueError("the list selects no rows")
    if any(not -rows <= i < rows for i in wanted):
        raise IndexError("a row outside of the table")
    first = list(dict.fromkeys(i % rows for i in wanted))
    spark = df.sparkSession
    asked = spark.createDataFrame([(p, r) for p, r in enumerate(first)], f"{place} long, _row long")
    near = F.col("_row").isin(first) if len(first) <= LISTED else F.col("_row").between(min(first), max(first))
    return df.filter(near).join(F.broadcast(asked) if len(first) <= 100_000 else asked, "_row")


def select_columns(df: DataFrame, names: list[str], keep: tuple[str, ...] = ("_row",)) -> DataFrame:
    """Columns by name without regard to case, in the order given; none, unknown or repeated ones are errors."""
    known = {c.strip().upper(): c for c in reversed(df.columns)}
    found = []
    for n in names:
        if n.strip().upper() not in known:
            raise ValueError(f"no column {n!r}")
        found.append(known[n.strip().upper()])
    if not found or len(set(found)) < len(found):
        raise ValueError("no columns, or a column twice")
    return df.select(*(k for k in keep if k in df.columns and k not in found), *found)


def section(df: DataFrame, key, shape: tuple[int, ...]) -> DataFrame:
    """Pixels of an image section: whole numbers drop an axis, slices (step over 0) keep it, an ellipsis fills up.

    Axes of the result count from 0 again. Bounds of the slowest axis reach the reader.
    """
    key = key if isinstance(key, tuple) else (key,)
    if sum(k is Ellipsis for k in key) > 1:
        raise IndexError("more than one ellipsis")
    if Ellipsis in key:
        at = key.index(Ellipsis)
        key = key[:at] + (slice(None),) * (len(shape) - len(key) + 1) + key[at + 1 :]
    if len(key) > len(shape):
        raise IndexError("more indices than axes")
    key += (slice(None),) * (len(shape) - len(key))
    axes, new = [], 0
    for k, (want, size) in enumerate(zip(key, shape, strict=True)):
        c = F.col(f"i{k}")
        if isinstance(want, bool) or not isinstance(want, (int, slice)):
            raise TypeError("an axis takes a number or a slice")
        if isinstance(want, int):
            if not -size <= want < size:
                raise IndexError(f"{want} outside of axis {k}")
            df = df.filter(c == want % size)
            continue
        if want.step is not None and want.step <= 0:
            raise ValueError("steps of image sections are over 0")
        start, stop, step = want.indices(size)
        df = df.filter((c >= start) & (c < stop))
        if step > 1:
            df = df.filter(F.pmod(c - start, F.lit(step)) == 0)
        axes.append(F.expr(f"(i{k} - {start}) div {step}").alias(f"i{new}"))
        new += 1
    return df.select(*axes, "value")


def chunked(df: DataFrame, size: int) -> DataFrame:
    """df with _chunk, the number of its run of ``size`` rows."""
    if size <= 0:
        raise ValueError("chunks hold rows")
    return df.withColumn("_chunk", F.expr(f"_row div {size}"))


def iterate(df: DataFrame, size: int | None = None):
    """Rows in order, or lists of ``size`` rows, fetched partition by partition."""
    rows = df.orderBy("_row").toLocalIterator(prefetchPartitions=True)
    if size is None:
        yield from rows
        return
    lot: list = []
    for r in rows:
        lot.append(r)
        if len(lot) == size:
            yield lot
            lot = []
    if lot:
        yield lot
