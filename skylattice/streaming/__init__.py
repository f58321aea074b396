"""Incremental writing with Structured Streaming: whole tiles as they fill, the rest when the stream ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TiledSink:
    """A ``foreachBatch`` sink that appends to a folder of compressed (or plain) tables.

    Rows wait in a pending Parquet folder until a tile is full; each batch writes the full tiles as one file and keeps the
    rest. What a batch begins with is found by its number alone: the last pending folder below it whose write was
    completed. So a batch that runs again, in this process or after a restart, gives its own files again, and rows count once.
    """

    def __init__(self, folder: str, order_by: str, tile_rows: int, compress: str | None = None):
        self.folder, self.order_by, self.tile_rows, self.compress = folder, order_by, tile_rows, compress

    def _pending(self, spark: SparkSession) -> list[int]:
        """Numbers of batches whose pending rows are there as a whole."""
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_pending")
        where = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not where.exists(root):
            return []
        done = [s.getPath() for s in where.listStatus(root) if where.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done if p.getName().isdigit())

    def _drop(self, spark: SparkSession, name: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_pending/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def __call__(self, batch: DataFrame, number: int) -> None:
        from ..operators.tables import numbered

        spark, schema = batch.sparkSession, batch.schema
        known = [n for n in self._pending(spark) if n < number]
        whole = spark.read.schema(schema).parquet(f"{self.folder}/_pending/{known[-1]:08d}").unionByName(batch) if known else batch
        staged = f"{self.folder}/_pending/all-{number:08d}"
        numbered(whole, self.order_by).write.mode("overwrite").parquet(staged)
        rows = spark.read.parquet(staged)
        full = rows.count() // self.tile_rows * self.tile_rows
        if full:
            self._write(rows.filter(F.col("_row") < full), f"{self.folder}/part-{number:08d}.fits")
        rows.filter(F.col("_row") >= full).drop("_row").write.mode("overwrite").parquet(f"{self.folder}/_pending/{number:08d}")
        self._drop(spark, f"all-{number:08d}")
        for n in known[:-1]:  # a batch that runs again needs the last one alone
            self._drop(spark, f"{n:08d}")

    def _write(self, rows: DataFrame, path: str) -> None:
        if self.compress:
            from ..operators.compressed import write_compressed_table

            write_compressed_table(rows, path, compress=self.compress, tile_rows=self.tile_rows)
        else:
            from ..operators.tables import write_table

            write_table(rows, path, "_row")

    def finish(self, spark: SparkSession) -> None:
        """Write what is left, as a shorter tile. Called again, it writes the same file; a stream that goes on begins anew."""
        known = self._pending(spark)
        if not known:
            return
        path = f"{self.folder}/_pending/{known[-1]:08d}"
        rest = spark.read.parquet(path)
        if not rest.isEmpty():
            from ..operators.tables import numbered

            schema = rest.schema
            self._write(numbered(rest, self.order_by), f"{self.folder}/part-{known[-1]:08d}.rest.fits")
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
