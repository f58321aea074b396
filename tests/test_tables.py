import os

import pytest
from pyspark.sql import functions as F

from skylattice.api import FITS, read, read_header
from skylattice.operators import catalog, mutate, select, tables
from skylattice.operators.compressed import write_compressed_table
from skylattice.sources import storage
from skylattice.sources.layout import walk


def block(cards):
    text = "".join(c.ljust(80) for c in [*cards, "END"])
    return text.encode().ljust(-(-len(text) // 2880) * 2880)


def primary():
    return block(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0"])


def by_hand(extra=(), lines=(b"\x00\x00\x00\x01bob\x00x \x3f\x80\x00\x00", b"\xff\xff\xff\xffann   \x40\x00\x00\x00"), kind="BINTABLE", forms=("1J", "6A", "1E")):
    """A table made byte by byte."""
    head = [f"XTENSION= '{kind:<8}'", "BITPIX  = 8", "NAXIS   = 2", f"NAXIS1  = {len(lines[0])}", f"NAXIS2  = {len(lines)}", "PCOUNT  = 0", "GCOUNT  = 1", f"TFIELDS = {len(forms)}"]
    for k, f in enumerate(forms, 1):
        head += [f"TTYPE{k}  = 'col{k}'", f"TFORM{k}  = '{f}'"]
    data = b"".join(lines)
    return primary() + block([*head, *extra]) + data.ljust(-(-len(data) // 2880) * 2880, b" " if kind == "TABLE" else b"\0")


@pytest.fixture
def hand(tmp_path):
    path = tmp_path / "hand.fits"

    def make(*a, **k):
        path.write_bytes(by_hand(*a, **k))
        return str(path)

    return make


def test_bytes_by_hand(spark, hand):
    df = tables.read(spark, hand(["EXTNAME = 'One'", "TNULL1  = -1", "TUNIT3  = 'm'"]), "one")
    assert [tuple(r) for r in df.collect()] == [(0, 1, "bob", 1.0), (1, -1, "ann", 2.0)]
    assert df.schema["col3"].metadata["unit"] == "m"
    masked = tables.read(spark, hand(["TNULL1  = -1"]), 1, maskNull=True)
    assert [r["col1"] for r in masked.collect()] == [1, None]
    scaled = tables.read(spark, hand(["TSCAL1  = 0.5", "TZERO1  = 10"]), 1)
    assert [r["col1"] for r in scaled.collect()] == [10.5, 9.5]
    unsigned = tables.read(spark, hand(["TZERO1  = 2147483648"]), 1)
    assert [r["col1"] for r in unsigned.collect()] == [2147483649, 2147483647]


def test_text_that_is_not_ascii_raises(spark, hand):
    path = hand(lines=(b"\x00\x00\x00\x01\xe9bcdef\x3f\x80\x00\x00",))
    with pytest.raises(Exception, match="ASCII"):
        tables.read(spark, path, 1).collect()
    assert tables.read(spark, path, 1, ["col2"], asBytes=True).select(F.base64("col2")).first()[0] == "6WJjZGVm"


def test_ascii_table_by_hand(spark, hand):
    path = hand(["TBCOL1  = 1", "TBCOL2  = 10", "TBCOL3  = 16", "TNULL2  = '-99'"], (b"alice     1234    3.14 ", b"bob        -99 -.5D1   "), "TABLE", ("A8", "I5", "F8.2"))
    rows = tables.read(spark, path, 1, maskNull=True).collect()
    assert [(r["col1"], r["col2"], round(r["col3"], 4)) for r in rows] == [("alice", 1234, 3.14), ("bob", None, -5.0)]


def test_broken_files(spark, tmp_path):
    path = tmp_path / "x.fits"
    for data, why in ((b"", "shorter"), (b"x" * 2880, "ends|begin"), (primary().replace(b"BITPIX", b"BIT\x01IX"), "printable")):
        path.write_bytes(data)
        with pytest.raises(OSError, match=why):
            catalog.units(str(path))
    path.write_bytes(primary().replace(b"NAXIS ", b"NAX\x01S "))
    assert "NAX_S" in catalog.units(str(path), lenient=True)[0].header


@pytest.fixture(scope="module")
def numbers(spark, tmp_path_factory):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 0.5).alias("x"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    path = str(tmp_path_factory.mktemp("t") / "numbers.fits")
    tables.write_table(df, path, "k", extname="NUMBERS", units={"x": "m"}, header={"OBS": "me"}, checksum=True)
    return path


def test_filters_and_columns_reach_the_reader(spark, numbers):
    df = select.slice_rows(tables.read(spark, numbers, columns=["x"], rowsPerPartition=100), slice(250, 260), 1000)
    assert df.columns == ["_row", "x"] and [r["x"] for r in df.orderBy("_row").collect()] == [i * 0.5 for i in range(250, 260)]
    assert df.rdd.getNumPartitions() == 1
    assert tables.read(spark, numbers, rowsPerPartition=100).rdd.getNumPartitions() == 10


def test_selection_rules(spark, numbers):
    with FITS(spark, numbers) as f:
        t = f["numbers"]
        assert len(f) == 2 and t.nrows == 1000 and t.colnames == ["k", "x", "name"] and t.units["x"] == "m" and t.header["OBS"] == "me"
        assert [r["k"] for r in t[::-300].orderBy(F.desc("_row")).collect()] == [999, 699, 399, 99]
        assert [r["k"] for r in t[[5, -1, 5, 0]].orderBy("_pos").collect()] == [5, 999, 0]
        assert t["X"][3].first()["x"] == 1.5 and t[["name", "k"]].read().columns == ["_row", "name", "k"]
        assert sum(len(c) for c in t.iter(300)) == 1000 and next(iter(t))["k"] == 0
        assert t.verify_datasum() and t.verify_checksum() and f[0].verify_checksum() is None
        for bad in (["k", "K"], ["nope"], [], [1, "k"]):
            with pytest.raises(ValueError):
                t[bad]
        with pytest.raises(ValueError, match="no rows"):
            t[5:5]
        with pytest.raises(IndexError):
            t[1000]
        with pytest.raises(ValueError):
            f[9]
        assert "numbers" in f and "other" not in f and "NUMBERS" in repr(f)
        with pytest.raises(OSError):
            t.append(t.read())


def test_updates_in_a_file(spark, numbers, tmp_path):
    path = str(tmp_path / "u.fits")
    with open(numbers, "rb") as f, open(path, "wb") as g:
        g.write(f.read())
    with FITS(spark, path, "r+") as f:
        f[1].append(spark.createDataFrame([(5000, 1.0, "new")], "k long, x double, name string"), "k")
        f[1].delete_column("name")
        f[1].insert_column("y", F.col("k") * 2, position=0)
        f[1][3] = {"x": -1.0}
        f[1].edit(lambda h: h.__setitem__("OBS", "you"))
        f[1].add_checksum()
        got = f[1].read().orderBy("_row").collect()
        assert f[1].colnames == ["y", "k", "x"] and len(got) == 1001 and tuple(got[3]) == (3, 6, 3, -1.0) and got[-1]["k"] == 5000
        assert f[1].verify_checksum() and f[1].extname == "NUMBERS" and read_header(path, 1)["OBS"] == "you"


def test_updates_keep_a_tables_own_cards(spark, tmp_path):
    path = str(tmp_path / "own.fits")
    with FITS(spark, path, "w+") as f:
        for ascii in (False, True):
            f.write_table(spark.range(5).select(F.col("id").alias("k")), "k", ascii=ascii, extname="T")
    for unit in (1, 2):
        with FITS(spark, path, "r+") as f:
            f[unit].edit(lambda h: (h.__setitem__("OBS", ("you", "who looked")), h.__setitem__("EXPO", 2.5), h.add_comment("first"), h.add_comment("second"), h.add_history("made")))
            before = f[unit].header.to_dict(skip_protected=True)
            f[unit].append(spark.createDataFrame([(9,)], "k long"), "k")
            f[unit][0] = {"k": 7}
            after = read_header(path, unit)
            assert after["OBS"] == "you" and after.to_dict(skip_protected=True) == before
            assert [r["k"] for r in f[unit].read().orderBy("_row").collect()] == [7, 1, 2, 3, 4, 9]


def test_new_files_of_many_units(spark, tmp_path):
    path = tmp_path / "m.fits.gz"
    df = spark.range(100).select(F.col("id").alias("k"), F.array(F.col("id").cast("float")).alias("a"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>")).alias("v"))
    pixels = spark.range(60).select(F.expr("id div 10").alias("i0"), (F.col("id") % 10).alias("i1"), F.col("id").cast("int").alias("value"))
    with FITS(spark, path, "w+") as f:
        f.write_image(pixels, (6, 10), "i4", extname="IMG")
        f.write_table(df, "k", extname="T")
        f.write_table(df, "k", compress=True, extname="Z", tile_rows=30)
        f.write_table(df.select("k"), "k", ascii=True, extname="A")
        f.write_image(pixels, (6, 10), "i4", extname="IMG2")
        kinds = [u.kind for u in f]
        assert kinds == ["image", "table", "ztable", "ascii", "image"]
        for name in ("T", "Z"):
            got = f[name].read().orderBy("_row").collect()
            assert [r["k"] for r in got] == list(range(100)) and got[2]["v"] == [1, 2] and got[3]["v"] == [] and got[7]["a"] in ([7.0], 7.0)
        assert f["A"].read().agg(F.sum("k")).first()[0] == 4950
        assert f["IMG2"][2:4, ::5].orderBy("i0", "i1").collect()[-1]["value"] == 35
        assert f["Z"].ztile_rows == 30 and f["Z"].n_tiles == 4
    again = FITS.from_bytes(spark, storage.open_read(str(path)).read())
    assert len(again) == 5 and read(spark, path).count() == 60


def test_compressed_rows_of_all_letters(spark, tmp_path):
    df = spark.range(257).selectExpr("id as k", "cast(id as int) * -7 as j", "cast(id % 100 as smallint) as i", "cast(id as float) / 3 as e", "id % 2 = 0 as l", "repeat('ab', cast(id % 5 as int)) as s")
    path = str(tmp_path / "z.fits")
    write_compressed_table(df, path, "k", tile_rows=50)
    assert tables.read(spark, path).drop("_row").exceptAll(df).count() == 0
    with pytest.raises(ValueError):
        write_compressed_table(df, path, "k", {"k": "RICE_1"})


def test_sums_of_what_compressed_units_stand_for(spark, tmp_path):
    from skylattice.functions.codecs import Codec
    from skylattice.operators.images import write_compressed, write_image

    df = spark.range(130).selectExpr("id as k", "cast(id as int) * -7 as j", "id % 2 = 0 as l")
    pixels = spark.range(77).select(F.expr("id div 11").alias("i0"), (F.col("id") % 11).alias("i1"), F.expr("cast(id * 301 as smallint)").alias("value"))
    z, plain = str(tmp_path / "z.fits"), str(tmp_path / "p.fits")
    write_compressed_table(df, z, "k", tile_rows=50)
    tables.write_table(df, plain, "k", checksum=True)
    assert catalog.verify_plain_sum(z, 1) is None
    catalog.add_plain_sum(z, 1)
    assert catalog.verify_plain_sum(z, 1) and read_header(z, 1)["ZDATASUM"] == read_header(plain, 1)["DATASUM"]
    ragged = df.select("k", F.expr("array_repeat(j, cast(k % 5 as int))").alias("v"), F.expr("repeat('x', cast(k % 3 as int))").alias("s"))
    write_compressed_table(ragged, z, "k", tile_rows=130, forms={"v": "1PJ", "s": "1QA"})
    catalog.add_plain_sum(z, 1)
    assert catalog.verify_plain_sum(z, 1)
    one = ragged.drop("s")
    write_compressed_table(one, z, "k", tile_rows=50, forms={"v": "1PJ"})
    tables.write_table(one, plain, "k", forms={"v": "1PJ"}, checksum=True)
    assert str(catalog.plain_sum(z, 1)) == read_header(plain, 1)["DATASUM"]
    write_compressed(pixels, z, (7, 11), "i2", Codec("RICE_1", tile_shape=(2, 5)))
    write_image(pixels, plain, (7, 11), "i2")
    catalog.with_checksums(plain, 0)
    assert str(catalog.plain_sum(z, 1)) == read_header(plain, 0)["DATASUM"]


def test_fancy_changes(spark):
    df = spark.range(5).select(F.col("id").alias("_row"), F.lit("a").alias("s"))
    with pytest.raises(ValueError):
        mutate.set_rows(df, df.withColumnRenamed("s", "t"))
    with pytest.raises(ValueError):
        mutate.insert_column(df, "S", 1)
    assert mutate.set_rows(df, spark.createDataFrame([(1, None)], "_row long, s string")).filter("s IS NULL").count() == 1


def test_ranged_reads_over_http(spark, numbers):
    import threading
    from functools import partial
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    class Ranges(SimpleHTTPRequestHandler):
        asked: list = []
        plain: list = []
        who = None

        def do_GET(self):
            want = self.headers.get("Range")
            Ranges.who = self.headers.get("X-Who")
            if not want:
                self.plain.append(self.path)
            data = open(os.path.join(self.directory, os.path.basename(self.path)), "rb").read()
            if want:
                lo, hi = (int(x) for x in want.removeprefix("bytes=").split("-"))
                self.asked.append((lo, hi))
                self.send_response(206)
                self.send_header("Content-Range", f"bytes {lo}-{min(hi, len(data) - 1)}/{len(data)}")
                data = data[lo : hi + 1]
            else:
                self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(Ranges, directory=os.path.dirname(numbers)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/numbers.fits"
    for remote in (None, "ranged"):
        with storage.open_read(url, remote) as f:
            assert len(walk(f)) == 2
    before = len(Ranges.plain)
    assert tables.read(spark, url, rowsPerPartition=100).count() == 1000 and len(Ranges.plain) == before + 1  # one download for ten partitions
    before = len(Ranges.asked)
    ranged = tables.read(spark, url, remote=storage.Remote(ranged=True, block_bytes=4096, cache_bytes=1 << 16, headers={"X-Who": "me"}))
    assert ranged.filter("_row < 5").count() == 5 and len(Ranges.asked) > before and Ranges.who == "me" and len(Ranges.plain) == 2
    small = storage.RangeReader(url, storage.Remote(ranged=True, block_bytes=100, cache_bytes=1000))
    before = len(Ranges.asked)
    small.seek(150)
    assert small.read(500) == open(numbers, "rb").read()[150:650] and len(Ranges.asked) == before + 1
    with pytest.raises(ValueError):
        storage.open_read(numbers, "ranged")
    server.shutdown()


def test_file_urls(tmp_path):
    assert storage.from_file_url("file:///a%20b") == "/a b" and storage.from_file_url("file://localhost/x") == "/x"
    for bad in ("file://host/x", "file:///a%2"):
        with pytest.raises(ValueError):
            storage.from_file_url(bad)
    assert [storage.kind_of(x) for x in ("/a", "mem://x", "s3://b/k", "https://h")] == ["local", "memory", "shared", "http"]


def odd_table(spark):
    """Columns of every kind of form, by name: (select, form)."""
    return spark.range(7).selectExpr(
        "id as k", "array(array(id, id + 1), array(id + 2, id + 3)) as m", "transform(sequence(0, 10), i -> (id + i) % 2 = 0) as bits", "cast(id + 40000 as int) as u", "id as scaled",
        "if(id = 3, null, id) as n", "array_repeat(cast(id as int), cast(id as int)) as v", "concat('s', id) as s",
    ), {"m": {"form": "4K", "dim": [2, 2]}, "bits": "11X", "u": {"form": "1I", "zero": 32768}, "scaled": {"form": "1K", "scale": 0.5, "zero": 10}, "n": {"form": "1K", "null": -5}, "v": "1PJ"}


FORMS = {"k": "1K", "m": "4K", "bits": "11X", "u": "1I", "scaled": "1K", "n": "1K", "v": "1PJ", "s": "2A"}


def about(path, unit):
    h = read_header(path, unit)
    n = h["TFIELDS"]
    cards = {h[f"TTYPE{k}"]: {c: h[f"{c}{k}"] for c in ("TFORM", "TDIM", "TSCAL", "TZERO", "TNULL", "TUNIT", "TDISP") if f"{c}{k}" in h} for k in range(1, n + 1)}
    return cards, {k: h.get(k) for k in ("EXTNAME", "EXTVER", "OBS", "BUNIT")}


def test_updates_keep_forms_and_cards(spark, tmp_path):
    path = str(tmp_path / "odd.fits")
    df, forms = odd_table(spark)
    with FITS(spark, path, "w+") as f:
        f.write_table(df, "k", forms=forms, extname="ODD", units={"scaled": "m", "s": "name"}, header={"EXTVER": 3, "OBS": "me"})
        f.write_table(spark.range(2), "id", extname="NEXT")
    with FITS(spark, path, "r+") as f:
        f[1].edit(lambda h: (h.__setitem__("TDISP5", "F8.2"), h.__setitem__("BUNIT", "Jy")))
        cards, others = about(path, 1)
        assert {k: v["TFORM"] for k, v in cards.items()} == FORMS and cards["scaled"] == {"TFORM": "1K", "TSCAL": 0.5, "TZERO": 10, "TUNIT": "m", "TDISP": "F8.2"}
        before = f[1].read(mask_null=False, columns=[c for c in FORMS]).orderBy("_row").collect()
        f[1].append(f[1].read().drop("_row").filter("k = 2").withColumn("scaled", F.lit(99.5)))
        f[1].repack()
        f[1][0] = {"u": 65535}
        assert about(path, 1) == (cards, others)
        got = f[1].read().orderBy("_row").collect()
        assert len(got) == 8 and got[0]["u"] == 65535 and [tuple(r)[2:] for r in got[1:7]] == [tuple(r)[2:] for r in before[1:7]]
        assert got[7]["scaled"] == 99.5 and got[7]["m"] == [[2, 3], [4, 5]]
        f[1].delete_column("k")
        f[1].insert_column("z", F.lit(1), position=0)
        assert about(path, 1) == ({"z": {"TFORM": "1J"}} | {k: v for k, v in cards.items() if k != "k"}, others)
        f[1][1] = {"s": "a longer text"}
        assert f[1].formats[-1] == "13A" and [u.extname for u in f][2] == "NEXT" and f[2].read().count() == 2
    target = str(tmp_path / "copy.fits")
    mutate.repack(spark, path, target)
    assert about(target, 1) == about(path, 1) and len(FITS(spark, target)) == 3


def test_updates_keep_codecs(spark, tmp_path):
    path = str(tmp_path / "z.fits")
    write_compressed_table(spark.range(60).selectExpr("id as k", "cast(id as int) as j"), path, "k", {"j": "GZIP_1", "k": "GZIP_1"}, 20, units={"j": "s"})
    with FITS(spark, path, "r+") as f:
        f[1].append(spark.createDataFrame([(60, 1)], "k long, j int"), "k")
        f[1].repack()
        assert f[1].compression == {"k": "GZIP_1", "j": "GZIP_1"} and f[1].ztile_rows == 20 and f[1].units["j"] == "s" and f[1].n_tiles == 4
        assert f[1].read().agg(F.sum("k")).first()[0] == 60 * 61 // 2


def test_files_in_memory_are_read_by_workers(spark, numbers):
    with open(numbers, "rb") as f:
        data = f.read()
    with FITS.from_bytes(spark, data, "r+") as f:
        assert f["numbers"].read().agg(F.sum("k")).first()[0] == 999 * 500
        f["numbers"].append(spark.createDataFrame([(1, 1.0, "x")], "k long, x double, name string"), "k")
        assert f["numbers"].read().count() == 1001
        again = FITS.from_bytes(spark, f.to_bytes())
    assert again[1].read().count() == 1001 and again[1].header["OBS"] == "me"
    with FITS(spark, "mem://new", "w+") as f:
        f.write_table(spark.range(3), "id")
        assert f[1].read().count() == 3


def test_null_pixels_and_pixels_out_of_range(spark, tmp_path):
    pixels = spark.range(12).select(F.expr("id div 4").alias("i0"), (F.col("id") % 4).alias("i1"), F.expr("if(id = 5, null, cast(id as int))").alias("value"))
    path = str(tmp_path / "i.fits")
    from skylattice.functions.codecs import Codec
    from skylattice.operators.images import write_compressed, write_image

    for unit, write in ((0, write_image), (1, lambda *a, **k: write_compressed(*a, Codec("RICE_1"), **k))):
        for kind, blank in (("i2", -9), ("u2", 100 - 32768)):
            write(pixels, path, (3, 4), kind, blank=blank)
            assert [r["value"] for r in tables.read(spark, path, unit, maskNull=True).orderBy("i0", "i1").collect()] == [None if i == 5 else i for i in range(12)]
        with pytest.raises(Exception, match="BLANK"):
            write(pixels, path, (3, 4), "i2")
        with pytest.raises(Exception, match="outside"):
            write(pixels.select("i0", "i1", F.lit(70000).alias("value")), path, (3, 4), "i2")
    write_image(pixels.withColumn("value", F.col("value").cast("float")), path, (3, 4), "f4")
    assert tables.read(spark, path, 0).filter("isnan(value)").count() == 1


def test_dataset_appends_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "set")
    df = spark.range(10).selectExpr("id as k", "array_repeat(cast(id as int), cast(id % 3 as int)) as v")
    for n in (10, 20):
        tables.write_table(df, path, "k", dataset=True, forms={"v": "1PJ"})
        got = tables.read(spark, path).orderBy("_row").collect()
        assert [r["k"] for r in got] == [*range(10)] * (n // 10) and got[5]["v"] == [5, 5]
    tables.write_table(df.limit(3), path, "k", dataset=True, mode="overwrite", forms={"v": "1PJ"}, checksum=True)
    assert tables.read(spark, path).count() == 3 and not [x for x in os.listdir(tmp_path) if "parts" in x]
    assert all(catalog.verify(p, 1) == (True, True) for p in storage.paths_of(path))


def test_streamed_batches_run_again_and_restart(spark, tmp_path):
    from skylattice.streaming import TiledSink

    folder = str(tmp_path / "stream")
    lots = [spark.createDataFrame([(i * 4 + k,) for k in range(4)], "k long") for i in range(4)]
    keys = lambda: sorted(r["k"] for r in tables.read(spark, folder).collect())
    sink = TiledSink(folder, "k", 6)
    sink(lots[0], 0)
    sink(lots[1], 1)
    sink(lots[1], 1)  # again, in this process
    assert keys() == list(range(6))
    again = TiledSink(folder, "k", 6)  # after a restart: the last batch may come again
    again(lots[1], 1)
    again(lots[2], 2)
    assert keys() == list(range(12))
    again(lots[3], 3)
    for _ in range(2):
        again.finish(spark)
        assert keys() == list(range(16))
    TiledSink(folder, "k", 6)(spark.createDataFrame([(k,) for k in range(16, 22)], "k long"), 4)
    assert keys() == list(range(22))


def counted(monkeypatch, module, name):
    """How often, and with what, a function of a module is called in this process."""
    calls, real = [], getattr(module, name)

    def call(*a, **k):
        calls.append(a)
        return real(*a, **k)

    monkeypatch.setattr(module, name, call)
    return calls


def test_filters_choose_tiles_and_runs(spark, tmp_path, monkeypatch, numbers):
    import numpy as np

    from skylattice.functions import tiles
    from skylattice.functions.codecs import Codec
    from skylattice.operators.images import write_compressed
    from skylattice.sources import fits

    shape, path = (30, 20, 10), str(tmp_path / "z.fits")
    pixels = spark.range(6000).select(F.expr("id div 200").alias("i0"), F.expr("(id div 10) % 20").alias("i1"), (F.col("id") % 10).alias("i2"), F.col("id").cast("int").alias("value"))
    write_compressed(pixels, path, shape, "i4", Codec("RICE_1", tile_shape=(7, 6, 4)))
    want = np.arange(6000).reshape(shape)
    got = tables.read(spark, path, 1).filter("i0 >= 8 AND i0 < 13 AND i1 = 13 AND i2 > 4").orderBy("i0", "i1", "i2").collect()
    assert [r["value"] for r in got] == want[8:13, 13, 5:].reshape(-1).tolist()
    reader = fits.FitsReader({"path": path, "hdu": "1"}, None)
    list(reader.pushFilters([fits.GreaterThanOrEqual(("i0",), 8), fits.LessThan(("i0",), 13), fits.EqualTo(("i1",), 13), fits.GreaterThan(("i2",), 4)]))
    calls = counted(monkeypatch, tiles, "decode_tiles")
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == 25 and sum(len(c[2]) for c in calls) == 2  # one tile of 4 x 3 lines across, two along the last axis
    none = fits.FitsReader({"path": path, "hdu": "1"}, None)
    list(none.pushFilters([fits.EqualTo(("i1",), 99)]))
    assert sum(b.num_rows for p in none.partitions() for b in none.read(p)) == 0
    listed = fits.FitsReader({"path": numbers}, None)
    monkeypatch.setattr(fits, "GAP_BYTES", 1)
    list(listed.pushFilters([fits.In(("_row",), (900, 3, 5, 4, 1500))]))
    parts = listed.partitions()
    assert [p.runs for p in parts] == [[(3, 6), (900, 901)]] and sum(b.num_rows for p in parts for b in listed.read(p)) == 4
    plan = select.listed_rows(tables.read(spark, numbers), [900, 3, 900], 1000)
    assert {r["k"] for r in plan.collect()} == {3, 900}


def test_ascii_numbers_of_all_forms(spark, hand):
    texts = [b"  +12", b"-0007", b"     ", b"  -99", b"00042"]
    reals = [b" 1.5E+02", b"+2.5d-1 ", b"        ", b"    -.5 ", b"     7. "]
    path = hand(["TBCOL1  = 1", "TBCOL2  = 6", "TNULL1  = '-99'"], [a + b for a, b in zip(texts, reals, strict=True)], "TABLE", ("I5", "D8.2"))
    for mask, missing in ((True, None), (False, 0)):
        rows = tables.read(spark, path, 1, maskNull=mask).collect()
        assert [(r["col1"], r["col2"]) for r in rows] == [(12, 150.0), (-7, 0.25), (0, 0.0), (missing, -0.5), (42, 7.0)]
    with pytest.raises(Exception, match="Failed to parse"):
        tables.read(spark, hand(["TBCOL1  = 1"], [b"12x"], "TABLE", ("I3",)), 1).collect()


def test_datasets_of_compressed_tables_and_images(spark, tmp_path, monkeypatch):
    from skylattice.functions.codecs import Codec
    from skylattice.operators import images

    df = spark.range(95).selectExpr("id as k", "array_repeat(cast(id as int), cast(id % 4 as int)) as v")
    path = str(tmp_path / "z")
    for n in (1, 2):
        write_compressed_table(df, path, "k", tile_rows=30, forms={"v": "1PJ"}, dataset=True)
        got = tables.read(spark, path).orderBy("_row").collect()
        assert [r["k"] for r in got] == [*range(95)] * n and got[7]["v"] == [7, 7, 7] and len(storage.paths_of(path)) == 4 * n
    monkeypatch.setattr(images, "SLAB_BYTES", 400)
    pixels = spark.range(42 * 11).select(F.expr("id div 11").alias("i0"), (F.col("id") % 11).alias("i1"), F.col("id").cast("int").alias("value"))
    for name, write in (("plain", images.write_image), ("rice", lambda *a, **k: images.write_compressed(*a, Codec("RICE_1", tile_shape=(4, 5)), **k)), ("hcompress", lambda *a, **k: images.write_compressed(*a, Codec("HCOMPRESS_1", tile_shape=(4, 11)), **k))):
        path, n = str(tmp_path / name), 42 if name != "hcompress" else 40
        write(pixels.filter(f"i0 < {n}"), path, (n, 11), "u2" if name != "hcompress" else "i4", dataset=True)
        got = tables.read(spark, path).orderBy("i0", "i1").collect()
        assert [tuple(r) for r in got] == [(i // 11, i % 11, i) for i in range(n * 11)] and len(storage.paths_of(path)) > 2
        assert [r["value"] for r in tables.read(spark, path).filter("i0 = 33 AND i1 > 8").orderBy("i1").collect()] == [33 * 11 + 9, 33 * 11 + 10]
    assert not [x for x in os.listdir(tmp_path) if "parts" in x]


def test_setting_rows_by_any_key(spark, tmp_path):
    path = str(tmp_path / "s.fits")
    with FITS(spark, path, "w+") as f:
        f.write_table(spark.range(10).selectExpr("id as k", "id * 2 as v"), "k")
        u, want = f[1], [2 * i for i in range(10)]
        u[1:8:3] = {"V": -1}
        want[1:8:3] = [-1] * 3
        u[[0, -1]] = {"v": 7}
        want[0] = want[-1] = 7
        u[9:4:-2] = spark.createDataFrame([(0, 90), (1, 70), (2, 50)], "_pos long, v long")
        want[9:4:-2] = [90, 70, 50]
        u[[3, 3, 2]] = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "_pos long, v long")
        want[3], want[2] = 2, 3
        assert [r["v"] for r in u.read().orderBy("_row").collect()] == want
        u[["v", "k"]] = {"v": F.col("k") + 100, "k": F.col("_row") * 3}
        assert [tuple(r) for r in u.read().orderBy("_row").collect()] == [(i, 3 * i, i + 100) for i in range(10)]
        for key, value, why in ((slice(4, 4), {"v": 1}, ValueError), ([10], {"v": 1}, IndexError), (["v"], {"k": 1}, ValueError), (slice(0, 1), spark.createDataFrame([(1, 1)], "_pos long, v long"), ValueError), (1.5, {"v": 1}, ValueError)):
            with pytest.raises(why):
                u[key] = value


def test_created_units_hold_zeros(spark, tmp_path):
    from skylattice.functions.codecs import Codec

    with FITS(spark, str(tmp_path / "c.fits"), "w+") as f:
        f.create_image((0, 5), "i2", extname="GROWS", header={"OBS": "me"})
        f.create_image((3, 4), "u2", extname="OFFSET")
        f.create_image((6, 5), "i4", Codec("RICE_1"), extname="TILES")
        f.create_table("k long, x double, s string, v array<int>", 4, {"s": "3A"}, {"x": "m"}, "ROWS")
        assert [u.kind for u in f] == ["image", "image", "zimage", "table"] and [u.shape for u in f] == [(0, 5), (3, 4), (6, 5), (4,)]
        assert f["GROWS"].read().count() == 0 and f["GROWS"].header["OBS"] == "me"
        assert {r["value"] for r in f["OFFSET"].read().collect()} == {32768} and {r["value"] for r in f["TILES"].read().collect()} == {0}
        assert [tuple(r) for r in f["ROWS"].read().orderBy("_row").collect()] == [(i, 0, 0.0, "", []) for i in range(4)]
        f["GROWS"].extend(spark.range(10).select(F.expr("id div 5").alias("i0"), (F.col("id") % 5).alias("i1"), F.col("id").cast("smallint").alias("value")))
        assert f["GROWS"].shape == (2, 5) and f["GROWS"].read().agg(F.sum("value")).first()[0] == 45
        f["ROWS"][1] = {"x": 2.5}
        assert f["ROWS"][1].first()["x"] == 2.5
        for bad in ((3, 0), (-1,)):
            with pytest.raises(ValueError):
                f.create_image(bad, "i2")


def test_nulls_of_compressed_tables(spark, tmp_path):
    path = str(tmp_path / "n.fits")
    write_compressed_table(spark.range(50).selectExpr("id as k", "if(id % 7 = 0, null, id) as n"), path, "k", tile_rows=20, forms={"n": {"form": "1K", "null": -1}})
    assert [r["n"] for r in tables.read(spark, path, 1, maskNull=True).orderBy("_row").collect()] == [None if i % 7 == 0 else i for i in range(50)]
    assert tables.read(spark, path, 1).filter("n = -1").count() == 8
