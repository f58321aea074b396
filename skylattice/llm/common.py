"""Helpers that several operators share: the shared folder, tables and files in it, and bytes of texts."""

from __future__ import annotations

import atexit
import ctypes
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder, as in tests on one machine.
LOCAL_SHARED = "/tmp/checkpoints/skylattice"
#: Rows of a few numbers that one file takes, where a table's rows are known to be no more than a number.
FILE_ROWS = 250_000
#: Local files without checksums beside them. Hadoop sets the mode of each file it makes by a program, four times for a file with its
#: checksum, and until that program is loaded its memory is the JVM's and is counted twice.
RAW_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or our own where it is unset and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_SHARED)
        named = LOCAL_SHARED
    return named.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the session is gone: the folder stays for the cluster's own cleaning
        pass


def materialise(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives lost executors.

    ``rows``: that df has no more, small ones that are cheap to make. They go to as many files as they fill, or as there are cores.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    own = spark._jsc.hadoopConfiguration().get("fs.file.impl")
    df.write.options(**({} if own else RAW_FILES)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a table that ``materialise`` gave, once nothing reads it any more."""
    _remove(spark, df.stored_at)


def dealt(df: DataFrame, key: str, keys: int, most: int = 8) -> DataFrame:
    """df in partitions by ``key``, of which there are ``keys``: as many partitions as keys or as the session shuffles to,
    and ``most`` keys in one on average. A number that is asked for isn't coalesced, so small rows that stand for much work stay dealt.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(keys, max(usual, -(-keys // most)))), key)


def kept_rows(docs: DataFrame, judge, condition: str) -> DataFrame:
    """Rows of docs, with their columns as they were, for which judge's added columns meet a condition.

    judge gets doc_id, text, and all other columns in one, so that its own columns clash with none.
    """
    from pyspark.sql import functions as F

    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", *([F.struct(*(f"`{c}`" for c in rest)).alias("__rest")] if rest else []))
    return judge(packed).filter(condition).select(*(F.col(f"__rest.`{c}`").alias(c) if c in rest else F.col(c) for c in docs.columns))


def filesystem(path: str):
    """(pyarrow file system, path in it) of a path or URI in the shared folder, on the driver or an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def write_file(path: str, data: bytes | list[bytes]) -> None:
    """Write bytes, or parts one after another, under another name, then rename: a task that is run again replaces the file as a whole."""
    where, name = filesystem(path)
    where.create_dir(os.path.dirname(name), recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(part) as out:
        for piece in [data] if isinstance(data, bytes) else data:
            out.write(piece)
    where.move(part, name)


def open_file(path: str):
    """A seekable reader of a shared file."""
    where, name = filesystem(path)
    return where.open_input_file(name)


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of rows) of a string or binary column; null counts as empty. No copy of rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n, buffers = len(column), column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lots(offsets: np.ndarray, rows: int, size: int):
    """(first, end) of runs of rows, one after another: at most ``rows`` and ``size`` of what offsets count, or one row that is larger."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1))
        yield lo, hi
        lo = hi


def give_back() -> None:
    """Return freed memory to the system: Python workers stay for other tasks, and share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def segments(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of ragged runs: for each i, starts[i] .. starts[i] + lengths[i] - 1, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
