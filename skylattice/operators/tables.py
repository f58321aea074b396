"""Tables in and out: reading with a session, writing in an order, and forms from one aggregate over the data."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import storage
from ..sources.fits import register


def read(spark: SparkSession, path: str, hdu=None, columns: list[str] | None = None, **options) -> DataFrame:
    """A table or image as a DataFrame with _row or axes. ``columns`` decodes no others, in the order given."""
    register(spark)
    if storage.kind_of(path) == "memory":  # workers don't see the driver's memory
        from ..plans.scratch import scratch_dir

        path = storage.spool(path, scratch_dir(spark, "memory"))
    remote = storage.Remote.of(options.get("remote"))
    if storage.kind_of(path) in ("http", "ftp") and not (remote and remote.ranged):  # once, not in every partition
        from ..plans.scratch import scratch

        options.pop("remote", None)
        with storage.open_read(path, remote) as f:
            path = scratch(spark, "download.fits")
            storage.write_bytes(path, iter(lambda: f.read(16 << 20), b""))
    reader = spark.read.format("fits")
    if hdu is not None:
        reader = reader.option("hdu", str(hdu))
    if columns is not None:
        reader = reader.option("columns", json.dumps(list(columns)))
    for k, v in options.items():
        reader = reader.option(k, v.to_json() if isinstance(v, storage.Remote) else str(v))
    return reader.load(path)


def measured_forms(df: DataFrame, forms: dict | None = None) -> dict:
    """Forms of text and list columns as narrow as the data: one aggregate of lengths, with partial results on every task."""
    forms, asks = dict(forms or {}), []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in forms or f.name == "_row":
            continue
        if isinstance(f.dataType, T.StringType):
            asks.append(F.max(F.octet_length(c)).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            n = F.coalesce(F.size(c), F.lit(-1))
            asks += [F.min(n).alias(f"{f.name}\u0001min"), F.max(n).alias(f"{f.name}\u0001max")]
    if not asks:
        return forms
    got = df.agg(*asks).first().asDict()
    for f in df.schema.fields:
        if f.name in got:
            forms[f.name] = f"{max(1, got[f.name] or 0)}A"
        elif f"{f.name}\u0001min" in got and got[f"{f.name}\u0001min"] == got[f"{f.name}\u0001max"] and (got[f"{f.name}\u0001max"] or 0) > 0 and not isinstance(f.dataType.elementType, (T.ArrayType, T.StringType)):
            from ..functions.forms import letter_of

            forms[f.name] = f"{got[f'{f.name}\u0001max']}{letter_of(f.dataType.elementType)[0]}"
    return forms


def ordered(df: DataFrame, by, partitions: int | None = None) -> DataFrame:
    """Rows dealt by ranges of ``by`` and sorted in each: partitions then follow the order, without one global sort."""
    by = [by] if isinstance(by, str) or not isinstance(by, (list, tuple)) else list(by)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *by).sortWithinPartitions(*by)


def numbered(df: DataFrame, by, partitions: int | None = None) -> DataFrame:
    """df with _row, from 0 in the order of ``by`` (of df's partitions, without): numbers within ranges, plus the ranges' sizes before them.

    Bounds of ranges come from a sample that another run draws anew, so the rows are written once, with their places.
    """
    from ..plans.scratch import scratch

    path = scratch(df.sparkSession, "numbered")
    (df if by is None else ordered(df, by, partitions)).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    placed = df.sparkSession.read.parquet(path)
    lead = F.shiftright("__at", 33)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(lead.alias("p")).count().collect())  # a row for each range
    before, total = {}, 0
    for p, n in sizes:
        before[p] = total
        total += n
    starts = F.array(*(F.lit(before.get(p, 0)).cast("long") for p in range(max(before, default=0) + 1)))
    return placed.withColumn("_row", F.element_at(starts, (lead + 1).cast("int")) + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at")


def write_table(df: DataFrame, path: str, order_by=None, forms: dict | None = None, units: dict | None = None, extname: str | None = None, header: dict | None = None, dataset: bool = False, checksum: bool = False, measure: bool = True, mode: str = "append") -> None:
    """df as a binary table at ``path``; rows in the order of ``order_by``, or of _row where there is one.

    dataset: a folder with a file for each partition; mode append adds to those that are there, overwrite replaces them.
    """
    register(df.sparkSession)
    order_by = order_by if order_by is not None else ("_row" if "_row" in df.columns else None)
    forms = measured_forms(df, forms) if measure else forms or {}
    out = ordered(df, order_by) if order_by is not None else df
    writer = out.write.format("fits").mode(mode).option("forms", json.dumps(forms)).option("units", json.dumps(units or {})).option("header", json.dumps(header or {}))
    if extname:
        writer = writer.option("extname", extname)
    writer.option("dataset", str(dataset)).option("checksum", str(checksum)).save(path)
