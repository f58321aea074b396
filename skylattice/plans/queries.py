"""Queries over FITS files made from Parquet tables, with the same results in SQL over the tables themselves.

Each writes a file with the engine's own sink, reads it with the engine's own source, and applies an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ascii_table as A
from ..functions import quantize as Q
from ..functions.checksum import datasum
from ..functions.codecs import Codec
from ..operators import catalog, images, mutate, select, tables
from ..operators.ascii import write_ascii
from ..operators.compressed import write_compressed_table
from .scratch import scratch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, order_by, **more) -> str:
    path = scratch(df.sparkSession, "table.fits")
    tables.write_table(df, path, order_by, **more)
    return path


def fits(df: DataFrame, order_by, columns=None, options: dict | None = None, **more) -> DataFrame:
    return tables.read(df.sparkSession, stored(df, order_by, **more), columns=columns, **(options or {}))


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.expr("unix_micros(cast(o_orderdate as timestamp))"))


R_ORDERS = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)"


@query("scan_bintable", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS o_orderdate, o_orderpriority FROM orders")
def scan_bintable(spark, sf_dir):
    return fits(orders(spark, sf_dir), "o_orderkey").drop("_row")


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS count_order
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, sf_dir):
    """The flagship: an aggregate over a scan that decodes seven columns."""
    items = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.expr("unix_micros(cast(l_shipdate as timestamp))"))
    columns = ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]
    q = fits(items, "l_orderkey", columns).filter(F.col("l_shipdate") <= 904694400000000)
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return q.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.count(F.lit(1)).alias("count_order"))


@query("dataset_scan", "SELECT o_custkey, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_custkey")
def dataset_scan(spark, sf_dir):
    """A folder with a file for each partition, read as one table."""
    path = scratch(spark, "parts")
    tables.write_table(orders(spark, sf_dir), path, "o_orderkey", dataset=True)
    return tables.read(spark, path, columns=["o_custkey", "o_orderkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("project_reorder", "SELECT o_totalprice, o_orderkey FROM orders")
def project_reorder(spark, sf_dir):
    return fits(orders(spark, sf_dir), "o_orderkey", ["O_TotalPrice ", "o_orderkey"]).drop("_row")


@query("single_column", "SELECT c_name FROM customer")
def single_column(spark, sf_dir):
    return fits(table(spark, sf_dir, "customer"), "c_custkey", ["c_name"]).drop("_row")


@query("as_bytes", "SELECT rn AS _row, hex(encode(c_mktsegment)) AS raw FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS rn FROM customer)")
def as_bytes(spark, sf_dir):
    df = fits(table(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment"], {"asBytes": True})
    return df.select("_row", F.hex(F.expr("cast(rtrim(replace(cast(c_mktsegment as string), '\\u0000', '')) as binary)")).alias("raw"))


@query("row_slice", f"SELECT rn AS _row, o_totalprice, o_orderkey FROM {R_ORDERS} WHERE rn >= 100 AND rn < 5000")
def row_slice(spark, sf_dir):
    df = orders(spark, sf_dir)
    return select.slice_rows(fits(df, "o_orderkey", ["o_totalprice", "o_orderkey"]), slice(100, 5000), df.count())


@query("row_slice_step", f"SELECT rn AS _row, o_orderkey FROM {R_ORDERS} WHERE rn >= 100 AND rn < 5000 AND (rn - 100) % 7 = 0")
def row_slice_step(spark, sf_dir):
    df = orders(spark, sf_dir)
    return select.slice_rows(fits(df, "o_orderkey", ["o_orderkey"]), slice(100, 5000, 7), df.count())


@query("row_slice_reverse", f"SELECT (n - 1 - rn) // 3 AS place, o_orderkey FROM {R_ORDERS}, (SELECT count(*) AS n FROM orders) WHERE (n - 1 - rn) % 3 = 0")
def row_slice_reverse(spark, sf_dir):
    df = orders(spark, sf_dir)
    return select.slice_rows(fits(df, "o_orderkey", ["o_orderkey"]), slice(None, None, -3), df.count(), "place").drop("_row")


@query("single_row", f"SELECT rn AS _row, o_orderkey, o_orderstatus FROM {R_ORDERS} WHERE rn = 17")
def single_row(spark, sf_dir):
    df = orders(spark, sf_dir)
    return select.one_row(fits(df, "o_orderkey", ["o_orderkey", "o_orderstatus"]), 17, df.count())


@query("fancy_rows_dedup", f"SELECT p.pos AS _pos, o_orderkey FROM {R_ORDERS} JOIN (VALUES (0, 900), (1, 3), (2, 17), (3, 1400)) AS p(pos, row) ON rn = p.row")
def fancy_rows_dedup(spark, sf_dir):
    df = orders(spark, sf_dir)
    return select.listed_rows(fits(df, "o_orderkey", ["o_orderkey"]), [900, 3, 17, 3, 1400, 900], df.count()).select("_pos", "o_orderkey")


@query("iter_chunks", f"SELECT rn // 1000 AS _chunk, count(*) AS n, min(o_orderkey) AS first FROM {R_ORDERS} GROUP BY rn // 1000")
def iter_chunks(spark, sf_dir):
    df = select.chunked(fits(orders(spark, sf_dir), "o_orderkey", ["o_orderkey"]), 1000)
    return df.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query("logical_column", "SELECT o_orderkey, o_orderstatus = 'F' AS done FROM orders")
def logical_column(spark, sf_dir):
    return fits(orders(spark, sf_dir).select("o_orderkey", (F.col("o_orderstatus") == "F").alias("done")), "o_orderkey").drop("_row")


@query("bit_pack", "SELECT o_orderkey, i::INTEGER AS i, ((o_orderkey >> i) & 1) = 1 AS bit FROM orders, range(11) AS t(i)")
def bit_pack(spark, sf_dir):
    bits = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.expr("1 = 1") & (F.getbit(F.col("o_orderkey"), i) == 1))
    df = fits(orders(spark, sf_dir).select("o_orderkey", bits.alias("bits")), "o_orderkey", forms={"bits": "11X"})
    return df.select("o_orderkey", F.posexplode("bits").alias("i", "bit"))


@query("string_trim", "SELECT c_custkey, rtrim(c_name) AS c_name FROM customer")
def string_trim(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.rpad("c_name", 30, " ").alias("c_name"))
    return fits(df, "c_custkey").drop("_row")


@query("f4_narrow", "SELECT o_orderkey, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS price FROM orders")
def f4_narrow(spark, sf_dir):
    df = fits(orders(spark, sf_dir).select("o_orderkey", F.col("o_totalprice").cast("float").alias("price")), "o_orderkey")
    return df.select("o_orderkey", F.col("price").cast("double").alias("price"))


@query("complex_parts", "SELECT o_orderkey, o_totalprice AS re, CAST(o_custkey AS DOUBLE) AS im FROM orders")
def complex_parts(spark, sf_dir):
    z = F.struct(F.col("o_totalprice").alias("re"), F.col("o_custkey").cast("double").alias("im"))
    return fits(orders(spark, sf_dir).select("o_orderkey", z.alias("z")), "o_orderkey").select("o_orderkey", "z.re", "z.im")


@query("subarray", "SELECT vec_id, j::INTEGER AS j, embedding[j + 1] AS value FROM embeddings, range(64) AS t(j)")
def subarray(spark, sf_dir):
    df = fits(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    return df.select("vec_id", F.posexplode("embedding").alias("j", "value"))


@query("subarray_tdim", "SELECT vec_id, (j // 16)::INTEGER AS a, (j % 16)::INTEGER AS b, embedding[j + 1] AS value FROM embeddings, range(64) AS t(j)")
def subarray_tdim(spark, sf_dir):
    cells = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda a: F.slice("embedding", a * 16 + 1, F.lit(16)))
    df = table(spark, sf_dir, "embeddings").select("vec_id", cells.alias("m"))
    df = fits(df, "vec_id", forms={"m": {"form": "64E", "dim": [4, 16]}})
    return df.select("vec_id", F.posexplode("m").alias("a", "line")).select("vec_id", "a", F.posexplode("line").alias("b", "value"))


@query("unsigned_types", "SELECT p_partkey, (p_size + 40000)::INTEGER AS u2, (p_size + 3000000000)::BIGINT AS u4, (p_size + 18446744073709500000::HUGEINT)::DECIMAL(20,0) AS u8, (p_size - 60)::TINYINT AS i1 FROM part")
def unsigned_types(spark, sf_dir):
    s = F.col("p_size")
    df = table(spark, sf_dir, "part").select("p_partkey", (s + 40000).cast("int").alias("u2"), (s + F.lit(3000000000)).cast("long").alias("u4"), (s.cast("decimal(20,0)") + F.lit("18446744073709500000").cast("decimal(20,0)")).cast("decimal(20,0)").alias("u8"), (s - 60).cast("tinyint").alias("i1"))
    return fits(df, "p_partkey", forms={"u2": {"form": "1I", "zero": 32768}, "u4": {"form": "1J", "zero": 2147483648}}).drop("_row")


@query("general_scale", "SELECT o_orderkey, 0.01 * o_custkey + 5 AS value FROM (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders)")
def general_scale(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", F.col("o_custkey").alias("value"))
    return fits(df, "o_orderkey", forms={"value": {"form": "1K", "scale": 0.01, "zero": 5}}).drop("_row")


@query("unscaled", "SELECT o_orderkey, o_custkey AS value FROM orders")
def unscaled(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", F.col("o_custkey").alias("value"))
    return fits(df, "o_orderkey", options={"scale": False}, forms={"value": {"form": "1K", "scale": 0.01, "zero": 5}}).drop("_row")


@query("tnull_mask", "SELECT o_orderkey, NULLIF(o_custkey % 10, 3) AS digit FROM orders")
def tnull_mask(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", (F.col("o_custkey") % 10).alias("digit"))
    return fits(df, "o_orderkey", options={"maskNull": True}, forms={"digit": {"form": "1K", "null": 3}}).drop("_row")


@query("variable_length", "SELECT vec_id, j::INTEGER AS j, embedding[j + 1] AS value FROM embeddings, range(64) AS t(j) WHERE j < vec_id % 64")
def variable_length(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("slice(embedding, 1, cast(vec_id % 64 as int))").alias("v"))
    return fits(df, "vec_id", forms={"v": "1PE"}).select("vec_id", F.posexplode("v").alias("j", "value"))


@query("variable_text", "SELECT event_id, event_type FROM events")
def variable_text(spark, sf_dir):
    return fits(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", forms={"event_type": "1QA"}).drop("_row")


# Images


def embedding_pixels(spark, sf_dir, value=lambda v: v) -> tuple[DataFrame, tuple[int, int]]:
    df = tables.numbered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    rows = df.count()
    return df.select(F.col("_row").alias("i0"), F.posexplode("embedding").alias("i1", "value")).select("i0", F.col("i1").cast("long").alias("i1"), value(F.col("value")).alias("value")), (rows, 64)


PIXELS = "(SELECT rn AS i0, j AS i1, embedding[j + 1] AS value FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS rn FROM embeddings), range(64) AS t(j))"
WHOLE = "CAST(trunc(value * 1000) AS INTEGER)"


def whole(v):
    """WHOLE of pixels: SQL keeps the product of a float a float, rounded before it is cut; a double's isn't rounded."""
    return (v * F.lit(1000).cast("float")).cast("int")


def image(spark, sf_dir, kind="f4", value=lambda v: v, **more) -> tuple[DataFrame, tuple[int, int]]:
    pixels, shape = embedding_pixels(spark, sf_dir, value)
    path = scratch(spark, "image.fits")
    options = more.pop("options", {})
    images.write_image(pixels, path, shape, kind, **more)
    return tables.read(spark, path, 0, **options), shape


@query("image_scan", f"SELECT i0, i1, value FROM {PIXELS}")
def image_scan(spark, sf_dir):
    return image(spark, sf_dir)[0]


@query("image_section", f"SELECT i0 - 10 AS i0, i1 - 5 AS i1, value FROM {PIXELS} WHERE i0 >= 10 AND i0 < 200 AND i1 >= 5 AND i1 < 20")
def image_section(spark, sf_dir):
    df, shape = image(spark, sf_dir)
    return select.section(df, (slice(10, 200), slice(5, 20)), shape)


@query("image_section_step", f"SELECT (i0 - 10) // 3 AS i0, (i1 - 1) // 2 AS i1, value FROM {PIXELS} WHERE i0 >= 10 AND i0 < 200 AND (i0 - 10) % 3 = 0 AND i1 >= 1 AND (i1 - 1) % 2 = 0")
def image_section_step(spark, sf_dir):
    df, shape = image(spark, sf_dir)
    return select.section(df, (slice(10, 200, 3), slice(1, None, 2)), shape)


@query("image_section_int", f"SELECT i1 AS i0, value FROM {PIXELS} WHERE i0 = 7")
def image_section_int(spark, sf_dir):
    df, shape = image(spark, sf_dir)
    return select.section(df, (7, ...), shape)


@query("image_unsigned", f"SELECT i0, i1, ({WHOLE} + 30000)::INTEGER AS value FROM {PIXELS}")
def image_unsigned(spark, sf_dir):
    return image(spark, sf_dir, "u2", lambda v: whole(v) + 30000)[0]


@query("image_blank", f"SELECT i0, i1, NULLIF({WHOLE} % 10, 3)::INTEGER AS value FROM {PIXELS}")
def image_blank(spark, sf_dir):
    return image(spark, sf_dir, "i4", lambda v: whole(v) % 10, blank=3, options={"maskNull": True})[0]


@query("image_reverse_scale", f"SELECT i0, i1, round_even((CAST(value AS DOUBLE) - 1.0) / 0.25, 0) * 0.25 + 1.0 AS value FROM {PIXELS}")
def image_reverse_scale(spark, sf_dir):
    return image(spark, sf_dir, "i2", lambda v: v.cast("double"), scale=(0.25, 1.0))[0]


def compressed(spark, sf_dir, kind, codec, value=lambda v: v, quantise=None, **more):
    pixels, shape = embedding_pixels(spark, sf_dir, value)
    path = scratch(spark, "tiles.fits")
    images.write_compressed(pixels, path, shape, kind, codec, quantise, **more)
    return tables.read(spark, path, 1), shape


@query("gzip1_image", f"SELECT i0, i1, value FROM {PIXELS}")
def gzip1_image(spark, sf_dir):
    return compressed(spark, sf_dir, "f4", Codec("GZIP_1", tile_shape=(20, 30)))[0]


@query("gzip2_image", f"SELECT i0, i1, value FROM {PIXELS}")
def gzip2_image(spark, sf_dir):
    return compressed(spark, sf_dir, "f4", Codec("GZIP_2", level=1))[0]


@query("rice_image", f"SELECT i0, i1, {WHOLE} AS value FROM {PIXELS}")
def rice_image(spark, sf_dir):
    return compressed(spark, sf_dir, "i4", Codec("RICE_1", tile_shape=(20, 30)), whole)[0]


@query("rice_image_i2", f"SELECT i0, i1, {WHOLE}::SMALLINT AS value FROM {PIXELS}")
def rice_image_i2(spark, sf_dir):
    return compressed(spark, sf_dir, "i2", Codec("RICE_1"), lambda v: whole(v).cast("smallint"))[0]


@query("plio_image", f"SELECT i0, i1, abs({WHOLE}) // 300 AS value FROM {PIXELS}")
def plio_image(spark, sf_dir):
    return compressed(spark, sf_dir, "i4", Codec("PLIO_1", tile_shape=(20, 64)), lambda v: F.expr("cast(abs(cast(value * 1000D as int)) div 300 as int)"))[0]


@query("hcompress_image", f"SELECT i0, i1, {WHOLE} AS value FROM {PIXELS}")
def hcompress_image(spark, sf_dir):
    return compressed(spark, sf_dir, "i4", Codec("HCOMPRESS_1"), whole)[0]


@query("hcompress_image_i2", f"SELECT i0, i1, {WHOLE}::SMALLINT AS value FROM {PIXELS}")
def hcompress_image_i2(spark, sf_dir):
    return compressed(spark, sf_dir, "i2", Codec("HCOMPRESS_1"), lambda v: whole(v).cast("smallint"))[0]


@query("hcompress_lossy", f"SELECT i0, count(*) AS n, true AS close FROM {PIXELS} GROUP BY i0")
def hcompress_lossy(spark, sf_dir):
    """Coefficients divided by a scale keep each pixel within some of it."""
    got, _ = compressed(spark, sf_dir, "i4", Codec("HCOMPRESS_1", scale=8, smooth=True), lambda v: F.expr("cast(value * 1000D as int)"))
    pixels, _ = embedding_pixels(spark, sf_dir, lambda v: F.expr("cast(value * 1000D as int)"))
    both = got.join(pixels.withColumnRenamed("value", "v"), ["i0", "i1"])
    return both.groupBy("i0").agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("value") - F.col("v"))) <= 16).alias("close"))


@query("tile_pruned_section", f"SELECT i0 - 40 AS i0, i1 AS i1, {WHOLE} AS value FROM {PIXELS} WHERE i0 >= 40 AND i0 < 60")
def tile_pruned_section(spark, sf_dir):
    df, shape = compressed(spark, sf_dir, "i4", Codec("RICE_1", tile_shape=(20, 30)), lambda v: F.expr("cast(value * 1000D as int)"))
    return select.section(df, (slice(40, 60),), shape)


@query("tile_geometry", f"SELECT (i0 // 20) * 3 + i1 // 30 AS tile, count(*) AS n FROM {PIXELS} GROUP BY ALL")
def tile_geometry(spark, sf_dir):
    pixels, shape = embedding_pixels(spark, sf_dir)
    return pixels.groupBy(images.tile_number(shape, (20, 30)).alias("tile")).agg(F.count(F.lit(1)).alias("n"))


@query("quantise_fixed_step", f"""SELECT i0, i1, (CASE WHEN x >= 0 THEN floor(x + 0.5) ELSE ceil(x - 0.5) END) * 0.125 + zero AS value FROM
  (SELECT i0, i1, (v - zero) / 0.125 AS x, zero FROM (SELECT i0, i1, CAST(value AS DOUBLE) AS v, trunc(min(CAST(value AS DOUBLE)) OVER (PARTITION BY i0) / 0.125 + 0.5) * 0.125 AS zero FROM {PIXELS}))""")
def quantise_fixed_step(spark, sf_dir):
    return compressed(spark, sf_dir, "f8", Codec("RICE_1"), lambda v: v.cast("double"), Q.Quantize(-0.125, "none"))[0]


@query("quantise_dithered", f"SELECT i0, count(*) AS n, true AS close FROM {PIXELS} GROUP BY i0")
def quantise_dithered(spark, sf_dir):
    """Subtractive dithering keeps each pixel within half a step."""
    got, _ = compressed(spark, sf_dir, "f4", Codec("RICE_1"), quantise=Q.Quantize(-0.01, "dither2", 7))
    pixels, _ = embedding_pixels(spark, sf_dir)
    both = got.join(pixels.withColumnRenamed("value", "v"), ["i0", "i1"])
    return both.groupBy("i0").agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("value") - F.col("v"))) <= 0.00501).alias("close"))


@query("dither_table", "WITH RECURSIVE r(i, x) AS (SELECT 0::BIGINT, 16807::BIGINT UNION ALL SELECT i + 1, (x * 16807) % 2147483647 FROM r WHERE i < 9999) SELECT i, CAST(x / 2147483647 AS FLOAT) AS value FROM r")
def dither_table(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(Q.table().tolist())), "i long, value float")


# ASCII tables


@query("ascii_table", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def ascii_table(spark, sf_dir):
    path = scratch(spark, "ascii.fits")
    write_ascii(orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_totalprice"), path, "o_orderkey")
    return tables.read(spark, path, 1).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("ascii_format", "SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 8, ' ') AS i, printf('%12.3f', o_totalprice) AS f, rpad(o_orderpriority, 6, ' ') AS a FROM orders")
def ascii_format(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", A.write_int(F.col("o_custkey"), 8).alias("i"), A.write_fixed(F.col("o_totalprice"), 12, 3).alias("f"), A.write_text(F.col("o_orderpriority"), 6).alias("a"))


@query("ascii_parse", "SELECT o_orderkey, o_custkey AS i, o_totalprice AS f, 0::BIGINT AS blank FROM orders")
def ascii_parse(spark, sf_dir):
    text = orders(spark, sf_dir).select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 12, " ").alias("i"), F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit("D0 ")).alias("f"), F.lit("   ").alias("b"))
    return text.select("o_orderkey", A.read_int(F.col("i")).alias("i"), A.read_float(F.col("f")).alias("f"), A.read_int(F.col("b")).alias("blank"))


# Compressed tables


def ztable(spark, sf_dir, **more) -> str:
    path = scratch(spark, "z.fits")
    df = orders(spark, sf_dir).withColumn("flag", F.col("o_orderstatus") == "F").withColumn("size", (F.col("o_custkey") % 100).cast("int"))
    write_compressed_table(df, path, "o_orderkey", **more)
    return path


@query("ztable_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS o_orderdate, o_orderpriority, o_orderstatus = 'F' AS flag, (o_custkey % 100)::INTEGER AS size FROM orders")
def ztable_scan(spark, sf_dir):
    return tables.read(spark, ztable(spark, sf_dir, tile_rows=1000), 1).drop("_row")


@query("ztable_slice", f"SELECT rn AS _row, o_totalprice FROM {R_ORDERS} WHERE rn >= 1100 AND rn < 1200")
def ztable_slice(spark, sf_dir):
    path = ztable(spark, sf_dir, tile_rows=1000)
    return select.slice_rows(tables.read(spark, path, 1, ["o_totalprice"]), slice(1100, 1200), orders(spark, sf_dir).count())


@query("ztable_variable", "SELECT vec_id, j::INTEGER AS j, embedding[j + 1] AS value FROM embeddings, range(64) AS t(j) WHERE j < vec_id % 64")
def ztable_variable(spark, sf_dir):
    path = scratch(spark, "zv.fits")
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("slice(embedding, 1, cast(vec_id % 64 as int))").alias("v"))
    write_compressed_table(df, path, "vec_id", tile_rows=128, forms={"v": "1PE"})
    return tables.read(spark, path, 1).select("vec_id", F.posexplode("v").alias("j", "value"))


# Aggregates and updates


@query("datasum", "SELECT CASE WHEN t = 0 THEN 0 ELSE ((t - 1) % 4294967295) + 1 END::BIGINT AS datasum FROM (SELECT sum(o_orderkey::HUGEINT * 7919 % 4294967296) AS t FROM orders)")
def datasum_query(spark, sf_dir):
    return orders(spark, sf_dir).agg(datasum(F.col("o_orderkey") * 7919 % 4294967296).alias("datasum"))


@query("checksum_verify", "SELECT true AS datasum_ok, true AS checksum_ok")
def checksum_verify(spark, sf_dir):
    path = stored(orders(spark, sf_dir), "o_orderkey", checksum=True)
    return spark.createDataFrame([catalog.verify(path, 1)], "datasum_ok boolean, checksum_ok boolean")


def rewritten(df: DataFrame, order_by="_row") -> DataFrame:
    return fits(df, order_by)


@query("set_column", "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders")
def set_column(spark, sf_dir):
    df = fits(orders(spark, sf_dir).select("o_orderkey", "o_totalprice"), "o_orderkey")
    return rewritten(mutate.set_column(df, "o_totalprice", F.col("o_totalprice") * 2)).drop("_row")


@query("set_rows", f"SELECT o_orderkey, CASE WHEN rn % 10 = 3 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM {R_ORDERS}")
def set_rows(spark, sf_dir):
    df = fits(orders(spark, sf_dir).select("o_orderkey", "o_totalprice"), "o_orderkey")
    new = df.filter("_row % 10 = 3").select("_row", F.lit(-1.0).alias("o_totalprice"))
    return rewritten(mutate.set_rows(df, new)).drop("_row")


@query("set_rows_last_wins", f"SELECT o_orderkey, CASE WHEN rn = 5 THEN 2.0 ELSE o_totalprice END AS o_totalprice FROM {R_ORDERS}")
def set_rows_last_wins(spark, sf_dir):
    df = fits(orders(spark, sf_dir).select("o_orderkey", "o_totalprice"), "o_orderkey")
    new = spark.createDataFrame([(5, 1.0, 0), (5, 2.0, 1)], "_row long, o_totalprice double, at int")
    return mutate.set_rows(df, new, "at").drop("_row")


@query("set_cell", f"SELECT o_orderkey, CASE WHEN rn = 42 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM {R_ORDERS}")
def set_cell(spark, sf_dir):
    df = fits(orders(spark, sf_dir).select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return rewritten(mutate.set_where(df, "o_orderstatus", F.col("_row") == 42, "X")).drop("_row")


@query("append_rows", f"SELECT rn AS _row, o_orderkey FROM {R_ORDERS} UNION ALL SELECT rn + (SELECT count(*) FROM orders), o_orderkey FROM {R_ORDERS}")
def append_rows(spark, sf_dir):
    df = fits(orders(spark, sf_dir).select("o_orderkey"), "o_orderkey")
    return rewritten(mutate.append(df, orders(spark, sf_dir).select("o_orderkey"), df.count(), "o_orderkey"))


@query("insert_column", "SELECT o_orderkey, o_custkey + 1 AS next, o_custkey FROM orders")
def insert_column(spark, sf_dir):
    df = fits(orders(spark, sf_dir).select("o_orderkey", "o_custkey"), "o_orderkey")
    return rewritten(mutate.insert_column(df, "next", F.col("o_custkey") + 1, after="o_orderkey")).drop("_row")


@query("delete_column", "SELECT o_orderkey, o_totalprice FROM orders")
def delete_column(spark, sf_dir):
    df = fits(orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")
    return rewritten(mutate.delete_column(df, "O_CUSTKEY")).drop("_row")


@query("repack_live_bytes", "SELECT sum((vec_id % 64) * 4)::BIGINT AS live_bytes FROM embeddings")
def repack_live_bytes(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("slice(embedding, 1, cast(vec_id % 64 as int))").alias("v"))
    path, target = stored(df, "vec_id", forms={"v": "1PE"}), scratch(spark, "repacked.fits")
    mutate.repack(spark, path, target, 1)
    return mutate.live_bytes(tables.read(spark, target), "v", 4)


@query("image_set_section", f"SELECT i0, i1, CASE WHEN i0 BETWEEN 10 AND 19 AND i1 < 8 THEN CAST(9 AS FLOAT) ELSE value END AS value FROM {PIXELS}")
def image_set_section(spark, sf_dir):
    df, _ = image(spark, sf_dir)
    return mutate.set_pixels(df, F.col("i0").between(10, 19) & (F.col("i1") < 8), 9.0)


@query("image_extend", f"SELECT i0, i1, value FROM {PIXELS} UNION ALL SELECT i0 + (SELECT count(*) FROM embeddings), i1, value FROM {PIXELS}")
def image_extend(spark, sf_dir):
    df, shape = image(spark, sf_dir)
    return mutate.extend_image(df, df, shape[0])


# Catalog


@query("hdu_catalog", """SELECT * FROM (VALUES (0, 'image', CAST(NULL AS VARCHAR), 1, '', false, 2880::BIGINT, 0::BIGINT)) AS t(hdu, kind, extname, extver, shape, has_data, data_offset, data_size)
  UNION ALL SELECT 1, 'table', 'ORDERS', 1, count(*)::VARCHAR, true, 5760, count(*) * (8 * 4 + max(strlen(o_orderstatus)) + max(strlen(o_orderpriority)))::BIGINT FROM orders""")
def hdu_catalog(spark, sf_dir):
    units = catalog.hdus(spark, stored(orders(spark, sf_dir), "o_orderkey", extname="ORDERS"))
    return units.withColumn("shape", F.array_join("shape", ","))


@query("header_cards", """WITH s AS (SELECT count(*) AS n, max(strlen(o_orderstatus)) AS a, max(strlen(o_orderpriority)) AS b FROM orders),
  c(place, key, type, value) AS (
    SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]), unnest(['XTENSION', 'BITPIX', 'NAXIS', 'NAXIS1', 'NAXIS2', 'PCOUNT', 'GCOUNT', 'TFIELDS']), unnest(['str', 'int', 'int', 'int', 'int', 'int', 'int', 'int']),
           unnest(['BINTABLE', '8', '2', CAST(32 + a + b AS VARCHAR), CAST(n AS VARCHAR), '0', '1', '6']) FROM s
    UNION ALL SELECT unnest([8, 10, 12, 14, 16, 18]), unnest(['TTYPE1', 'TTYPE2', 'TTYPE3', 'TTYPE4', 'TTYPE5', 'TTYPE6']), 'str', unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'])
    UNION ALL SELECT unnest([9, 11, 13, 15, 17, 19]), unnest(['TFORM1', 'TFORM2', 'TFORM3', 'TFORM4', 'TFORM5', 'TFORM6']), 'str', unnest(['1K', '1K', a || 'A', '1D', '1K', b || 'A']) FROM s
    UNION ALL SELECT unnest([20, 21]), unnest(['EXTNAME', 'ORIGIN']), 'str', unnest(['ORDERS', 'made here']))
  SELECT place::INTEGER AS place, key, type, value FROM c""")
def header_cards(spark, sf_dir):
    return catalog.cards(spark, stored(orders(spark, sf_dir), "o_orderkey", extname="ORDERS", header={"ORIGIN": "made here"}), "orders").drop("comment")


# Files that change


def opened(spark, path: str):
    from ..api import FITS

    return FITS(spark, path, "r+")


@query("append_keeps_cards", f"""SELECT rn AS _row, o_orderkey, 0.5 * o_custkey + 10 AS half, NULLIF(o_custkey % 10, 3) AS digit, 'TSCAL2=0.5 TZERO2=10 TNULL3=3 TUNIT2=m OBS=me' AS cards FROM
  (SELECT rn, o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey FROM {R_ORDERS} UNION ALL SELECT rn + (SELECT count(*) FROM orders), o_orderkey, CAST(o_custkey AS DOUBLE) FROM {R_ORDERS})""")
def append_keeps_cards(spark, sf_dir):
    """Rows of physical values appended in the file; the table's scale, null, unit and own cards stay."""
    df = orders(spark, sf_dir).select("o_orderkey", F.col("o_custkey").alias("half"), (F.col("o_custkey") % 10).alias("digit"))
    path = stored(df, "o_orderkey", forms={"half": {"form": "1K", "scale": 0.5, "zero": 10}, "digit": {"form": "1K", "null": 3}}, units={"half": "m"}, header={"OBS": "me"})
    with opened(spark, path) as f:
        f[1].append(df.withColumn("half", F.col("half") * 0.5 + 10), "o_orderkey")
        h = f[1].header
        cards = " ".join(f"{k}={h.get(k)}" for k in ("TSCAL2", "TZERO2", "TNULL3", "TUNIT2", "OBS"))
    got = tables.read(spark, path, 1, maskNull=True)
    return got.withColumns({"digit": F.col("digit").cast("double"), "cards": F.lit(cards)})


@query("repack_tdim", "SELECT vec_id, (j // 16)::INTEGER AS a, (j % 16)::INTEGER AS b, embedding[j + 1] AS value, '64E (16,4)' AS form FROM embeddings, range(64) AS t(j)")
def repack_tdim(spark, sf_dir):
    cells = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda a: F.slice("embedding", a * 16 + 1, F.lit(16)))
    path, target = stored(table(spark, sf_dir, "embeddings").select("vec_id", cells.alias("m")), "vec_id", forms={"m": {"form": "64E", "dim": [4, 16]}}), scratch(spark, "repacked.fits")
    mutate.repack(spark, path, target, 1)
    with opened(spark, target) as f:
        form = f"{f[1].header['TFORM2']} {f[1].header['TDIM2']}"
    df = tables.read(spark, target, 1).select("vec_id", F.posexplode("m").alias("a", "line")).select("vec_id", "a", F.posexplode("line").alias("b", "value"))
    return df.withColumn("form", F.lit(form))


@query("dataset_append", f"SELECT rn AS _row, o_orderkey FROM {R_ORDERS} UNION ALL SELECT rn + (SELECT count(*) FROM orders), o_orderkey FROM {R_ORDERS}")
def dataset_append(spark, sf_dir):
    path = scratch(spark, "twice")
    for _ in range(2):
        tables.write_table(orders(spark, sf_dir).select("o_orderkey"), path, "o_orderkey", dataset=True)
    return tables.read(spark, path)


@query("image_null_fill", f"SELECT i0, i1, NULLIF({WHOLE} % 10, 3)::INTEGER AS value, {WHOLE} % 10 = 3 AS blank FROM {PIXELS}")
def image_null_fill(spark, sf_dir):
    """Null pixels are stored as BLANK, and are null again where that is asked for."""
    masked = image(spark, sf_dir, "i4", lambda v: F.nullif(whole(v) % 10, F.lit(3)), blank=-2000000000, options={"maskNull": True})[0]
    return masked.withColumn("blank", F.col("value").isNull())


@query("mem_scan", "SELECT o_orderkey, o_totalprice FROM orders")
def mem_scan(spark, sf_dir):
    """A file in the driver's memory, read by workers."""
    from ..api import FITS
    from ..sources import storage

    path = stored(orders(spark, sf_dir).select("o_orderkey", "o_totalprice"), "o_orderkey")
    return FITS.from_bytes(spark, b"".join(storage.ranges(path, 0, storage.size_of(path))))[1].read().drop("_row")


def image_file(spark, sf_dir, codec=None, quantise=None, kind="i4"):
    """(path, unit) of the embeddings as an image."""
    value = whole if kind == "i4" else (lambda v: v)
    pixels, shape = embedding_pixels(spark, sf_dir, value)
    path = scratch(spark, "changed.fits")
    if codec:
        images.write_compressed(pixels, path, shape, kind, codec, quantise)
    else:
        images.write_image(pixels, path, shape, kind)
    return path, 1 if codec else 0


def set_in_file(spark, sf_dir, codec=None):
    path, unit = image_file(spark, sf_dir, codec)
    with opened(spark, path) as f:
        f[unit][10:20, :8] = 9
        f[unit][30, 4::20] = spark.createDataFrame([(k, 100 + k) for k in range(3)], "i0 long, value int")
    return tables.read(spark, path, unit)


SET = f"SELECT i0, i1, (CASE WHEN i0 BETWEEN 10 AND 19 AND i1 < 8 THEN 9 WHEN i0 = 30 AND i1 >= 4 AND (i1 - 4) % 20 = 0 THEN 100 + (i1 - 4) // 20 ELSE {WHOLE} END)::INTEGER AS value FROM {PIXELS}"
TWICE = f"SELECT i0, i1, {WHOLE} AS value FROM {PIXELS} UNION ALL SELECT i0 + (SELECT count(*) FROM embeddings), i1, {WHOLE} FROM {PIXELS} WHERE i0 < 7"


@query("image_file_set", SET)
def image_file_set(spark, sf_dir):
    return set_in_file(spark, sf_dir)


@query("zimage_set", SET)
def zimage_set(spark, sf_dir):
    return set_in_file(spark, sf_dir, Codec("RICE_1", tile_shape=(20, 30)))


def extended_in_file(spark, sf_dir, codec=None):
    path, unit = image_file(spark, sf_dir, codec)
    with opened(spark, path) as f:
        f[unit].extend(tables.read(spark, path, unit).filter("i0 < 7"))
    return tables.read(spark, path, unit)


@query("image_file_extend", TWICE)
def image_file_extend(spark, sf_dir):
    return extended_in_file(spark, sf_dir)


@query("zimage_extend", TWICE)
def zimage_extend(spark, sf_dir):
    """The last tiles are filled up, new ones follow."""
    return extended_in_file(spark, sf_dir, Codec("GZIP_2", tile_shape=(9, 64)))


@query("zimage_repack", f"SELECT i0, i1, CASE WHEN i0 < 5 THEN 1 ELSE {WHOLE} END AS value, true AS smaller FROM {PIXELS}")
def zimage_repack(spark, sf_dir):
    path, unit = image_file(spark, sf_dir, Codec("RICE_1", tile_shape=(4, 64)))
    with opened(spark, path) as f:
        f[unit][:5] = 1
        before = f[unit].header["PCOUNT"]
        f[unit].repack()
        smaller = f[unit].header["PCOUNT"] < before
    return tables.read(spark, path, unit).withColumn("smaller", F.lit(smaller))


@query("zimage_set_quantised", f"SELECT i0, i1 < 8 AND i0 BETWEEN 10 AND 19 AS changed, count(*) AS n, true AS close FROM {PIXELS} GROUP BY ALL")
def zimage_set_quantised(spark, sf_dir):
    """Tiles of a quantised image keep their scale when some of their pixels change."""
    path, unit = image_file(spark, sf_dir, Codec("RICE_1"), Q.Quantize(-0.01, "dither1", 5), "f4")
    with opened(spark, path) as f:
        f[unit][10:20, :8] = 0.25
    pixels, _ = embedding_pixels(spark, sf_dir)
    changed = F.col("i0").between(10, 19) & (F.col("i1") < 8)
    both = tables.read(spark, path, unit).join(pixels.withColumn("v", F.when(changed, 0.25).otherwise(F.col("value"))).drop("value"), ["i0", "i1"])
    return both.groupBy("i0", changed.alias("changed")).agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("value") - F.col("v"))) <= 0.0101).alias("close"))


@query("stream_append", "SELECT event_id, value FROM events")
def stream_append(spark, sf_dir):
    """A file stream into a folder of tables: full tiles as they come, the rest at the end."""
    from ..streaming import TiledSink

    folder = scratch(spark, "stream")
    source = table(spark, sf_dir, "events").select("event_id", "value")
    source.repartition(3).write.parquet(f"{folder}/_in")
    sink = TiledSink(folder, "event_id", 1024)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/_in")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    sink.finish(spark)
    return tables.read(spark, folder).drop("_row")
