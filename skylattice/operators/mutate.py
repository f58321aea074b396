"""Updates as new DataFrames: keyed by _row or by pixel axes, appended, with columns put in or left out, and rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def set_rows(df: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Rows of ``changes`` (with _row and some columns) in place of df's values; a null there is a value too.

    order: column of changes by which the last of several changes of a row counts.
    """
    names = [c for c in changes.columns if c not in ("_row", order)]
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"no columns {unknown}")
    if order:
        last = F.row_number().over(Window.partitionBy("_row").orderBy(F.col(order).desc()))
        changes = changes.withColumn("__last", last).filter("__last = 1")
    new = changes.select("_row", F.struct(*names).alias("__new"))
    out = df.join(new, "_row", "left")
    return out.select(*(F.when(F.col("__new").isNotNull(), F.col(f"__new.`{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns))


def set_column(df: DataFrame, name: str, value) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    return df.withColumn(name, value if not isinstance(value, (int, float, str, bool)) else F.lit(value))


def set_where(df: DataFrame, name: str, condition, value) -> DataFrame:
    """One column at the rows of a condition, e.g. one cell at ``F.col('_row') == 5``."""
    value = value if hasattr(value, "_jc") else F.lit(value)
    return set_column(df, name, F.when(condition, value.cast(df.schema[name].dataType)).otherwise(F.col(f"`{name}`")))


def append(df: DataFrame, more: DataFrame, rows: int, order=None) -> DataFrame:
    """df with more's rows after its own ``rows``. Columns go by name; more's _row counts from 0, or follows ``order``."""
    if "_row" not in more.columns:
        from .tables import numbered

        more = numbered(more, order)
    missing = set(df.columns) ^ set(more.columns)
    if missing:
        raise ValueError(f"columns differ: {sorted(missing)}")
    more = more.withColumn("_row", F.col("_row") + rows)
    return df.unionByName(more.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in df.schema.fields)))


def insert_column(df: DataFrame, name: str, value, position: int | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """A new column at a place given one way at most; at the end otherwise."""
    if sum(x is not None for x in (position, after, before)) > 1:
        raise ValueError("one place only")
    columns = [c for c in df.columns if c != "_row"]
    if name.upper() in (c.upper() for c in columns):
        raise ValueError(f"column {name!r} is there already")
    at = len(columns)
    if position is not None:
        at = position if position >= 0 else len(columns) + position
    elif after is not None:
        at = columns.index(after) + 1
    elif before is not None:
        at = columns.index(before)
    value = value if hasattr(value, "_jc") else F.lit(value)
    columns.insert(at, name)
    return df.withColumn(name, value).select(*(c for c in ("_row",) if c in df.columns), *columns)


def delete_column(df: DataFrame, key: str | int) -> DataFrame:
    columns = [c for c in df.columns if c != "_row"]
    if isinstance(key, int):
        if not -len(columns) <= key < len(columns):
            raise IndexError(f"no column {key}")
        key = columns[key]
    found = [c for c in columns if c.upper() == key.strip().upper()]
    if not found:
        raise ValueError(f"no column {key!r}")
    return df.drop(found[0])


def set_pixels(df: DataFrame, condition, value) -> DataFrame:
    """Pixels of a condition on axes to one value."""
    value = value if hasattr(value, "_jc") else F.lit(value)
    return df.withColumn("value", F.when(condition, value.cast(df.schema["value"].dataType)).otherwise(F.col("value")))


def overwrite_pixels(df: DataFrame, block: DataFrame, start: tuple[int, ...]) -> DataFrame:
    """A block of pixels (axes from 0) laid over df at ``start``."""
    axes = [f"i{k}" for k in range(len(start))]
    new = block.select(*((F.col(a) + s).alias(a) for a, s in zip(axes, start, strict=True)), F.struct("value").alias("__new"))
    return df.join(new, axes, "left").select(*axes, F.when(F.col("__new").isNotNull(), F.col("__new.value")).otherwise(F.col("value")).alias("value"))


def extend_image(df: DataFrame, more: DataFrame, lines: int, start: int | None = None) -> DataFrame:
    """more's lines after df's, or from ``start`` on, over what is there."""
    start = lines if start is None else start
    moved = more.withColumn("i0", F.col("i0") + start)
    return df.filter(F.col("i0") < start).unionByName(moved)


def live_bytes(df: DataFrame, name: str, element: int) -> DataFrame:
    """Bytes that a variable-length column's cells take: what a rewritten file's heap holds."""
    return df.agg(F.sum(F.greatest(F.size(F.col(f"`{name}`")), F.lit(0)).cast("long") * element).alias("live_bytes"))


def repack(spark, source: str, target: str, hdu=None) -> None:
    """A copy of a file in which one unit is rewritten: a table's (or compressed image's) heap has no orphaned bytes.

    Forms, codecs, names and cards of the unit stay, and all other units as they are. hdu: the first unit with data, if not given.
    """
    from ..api import FITS
    from ..sources import storage
    from ..sources.fits import default_unit
    from .catalog import units

    storage.write_bytes(target, storage.ranges(source, 0, storage.size_of(source)))
    with FITS(spark, target, "r+") as f:
        f[default_unit(units(target)).index if hdu is None else hdu].repack()
