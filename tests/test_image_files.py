"""Images changed in their files, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.api import FITS
from skylattice.classic import mode_of
from skylattice.functions.codecs import Codec
from skylattice.functions.quantize import Quantize

SHAPE = (11, 7, 6)


def frame(spark, values):
    at = np.indices(values.shape).reshape(values.ndim, -1)
    rows = [(*map(int, at[:, i]), v.item()) for i, v in enumerate(values.reshape(-1))]
    kind = {"i2": "smallint", "i4": "int", "i8": "bigint", "f4": "float", "f8": "double", "u2": "int", "u1": "smallint"}[values.dtype.str[1:]]
    return spark.createDataFrame(rows, ", ".join([f"i{k} long" for k in range(values.ndim)] + [f"value {kind}"]))


def array(df, shape, kind):
    out = np.zeros(shape, kind)
    rows = df.collect()
    assert len(rows) == out.size
    for r in rows:
        out[tuple(r[:-1])] = r["value"]
    return out


CASES = [("i2", None, None), ("u2", None, None), ("f4", None, None), ("i4", Codec("RICE_1", tile_shape=(4, 3, 6)), None), ("u2", Codec("GZIP_2", tile_shape=(3, 7, 4)), None), ("f8", Codec("GZIP_1", tile_shape=(4, 7, 6)), None), ("i4", Codec("PLIO_1", tile_shape=(1, 7, 6)), None)]


@pytest.mark.parametrize(("kind", "codec", "quantize"), CASES)
def test_set_extend_and_repack(spark, tmp_path, kind, codec, quantize):
    rng = np.random.default_rng(1)
    want = rng.integers(0, 1000, SHAPE).astype(kind)
    path = str(tmp_path / "x.fits")
    with FITS(spark, path, "w+") as f:
        f.write_image(frame(spark, want), SHAPE, kind, codec, extname="IMG", header={"OBS": "me"})
        f.write_table(spark.range(3), "id", extname="NEXT")
    with FITS(spark, path, "r+") as f:
        u = f["IMG"]
        u[2:9:3, 1, ::2] = 5
        want[2:9:3, 1, ::2] = 5
        block = rng.integers(0, 1000, (3, 4, 6)).astype(kind)
        u[5:8, 2:6] = frame(spark, block)
        want[5:8, 2:6] = block
        u[-1] = frame(spark, np.full((7, 6), 9).astype(kind))
        want[-1] = 9
        more = rng.integers(0, 1000, (6, 7, 6)).astype(kind)
        u.extend(frame(spark, more))
        want = np.concatenate([want, more])
        assert u.shape == want.shape and np.array_equal(array(u.read(), want.shape, kind), want)
        if codec is None:
            u.extend(frame(spark, more), start=15)
            want = np.concatenate([want[:15], more])
        else:
            before = u.header["PCOUNT"]
            u.repack()
            assert u.header["PCOUNT"] < before
        with u.extending() as add:
            add(frame(spark, more[:1]))
            add(frame(spark, more[1:3]))
            with pytest.raises(OSError, match="buffered"):
                u[0] = 1
        want = np.concatenate([want, more[:3]])
        assert np.array_equal(array(u.read(), want.shape, kind), want) and u.header["OBS"] == "me"
        assert [x.extname for x in f][-1] == "NEXT" and f["NEXT"].read().count() == 3
        for key, value in (((0, 0, 0), frame(spark, block)), ((slice(0, 2),), frame(spark, block))):
            with pytest.raises(ValueError):
                u[key] = value
        with pytest.raises(IndexError):
            u[99] = 1
        assert np.array_equal(array(f["IMG"].read(), want.shape, kind), want)


def test_quantised_tiles_keep_their_scale(spark, tmp_path):
    want = np.random.default_rng(2).normal(100, 5, (8, 12)).astype("f4")
    path = str(tmp_path / "q.fits")
    with FITS(spark, path, "w+") as f:
        f.write_image(frame(spark, want), want.shape, "f4", Codec("RICE_1", tile_shape=(4, 12)), Quantize(-0.01, "dither1", 3))
        u = f[1]
        before = array(u.read(), want.shape, "f4")
        u[1, 2:5] = 101.25
        got = array(u.read(), want.shape, "f4")
        assert np.abs(got[1, 2:5] - 101.25).max() <= 0.0051 and np.array_equal(got[4:], before[4:])
        mask = np.ones(want.shape, bool)
        mask[1, 2:5] = False
        assert np.abs(got - before)[mask].max() < 1e-4
        u.extend(frame(spark, want[:3]))
        assert u.shape == (11, 12) and np.abs(array(u.read(), (11, 12), "f4")[8:] - want[:3]).max() < 5
        with pytest.raises(Exception, match="scale"):
            u[0, 0] = 1e9
        assert u.quantize == ("SUBTRACTIVE_DITHER_1", 3) and u.tile_shape == (4, 12)


def test_general_scale_cache_and_handles(spark, tmp_path):
    want = np.arange(24).reshape(4, 6).astype("f8") * 0.25 + 1
    path = str(tmp_path / "s.fits")
    with FITS(spark, path, "w+") as f:
        f.write_image(frame(spark, want), want.shape, "i2", scale=(0.25, 1.0), header={"BUNIT": "Jy"})
        f[0][1, 1:3] = 7.5
        want[1, 1:3] = 7.5
        f[0].extend(frame(spark, want[:2]))
        want = np.concatenate([want, want[:2]])
        u = f[0]
        u.set_tile_cache_size(1 << 20)
        assert u.unit == "Jy" and np.array_equal(array(u.read(), want.shape, "f8"), want) and u.tile_cache_used > 0 and u.tile_cache_size == 1 << 20
        assert u.read() is u.read()
        u[0, 0] = 2.0
        assert u.tile_cache_used == 0 and u[0, 0].first()["value"] == 2.0
        u.clear_tile_cache()
    with pytest.raises(OSError):
        f[0][0, 0] = 1.0
    with FITS(spark, path, "r+") as f, pytest.raises(ZeroDivisionError), f[0].extending() as add:
        add(frame(spark, want))
        raise ZeroDivisionError
    with FITS(spark, path) as f:
        assert f[0].shape == (6, 6)


def test_appending_and_older_modes(spark, tmp_path):
    path = str(tmp_path / "t.fits")
    with FITS(spark, path, "w+") as f:
        f.write_table(spark.range(3).select(F.col("id").alias("k")), "k")
        with f[1].appending("k") as more:
            more(spark.range(3, 5).select(F.col("id").alias("k")))
            more(spark.range(5, 9).select(F.col("id").alias("k")))
        assert [r["k"] for r in f[1].read().orderBy("_row").collect()] == list(range(9))
    assert [mode_of(path, m) for m in ("r", 0, "rw", 1, "READWRITE", "r+")] == ["r", "r", "r+", "r+", "r+", "r+"]
    assert mode_of(path, "rw", True) == "w+" and mode_of(path + "x", "rw") == "w+"
    for bad in (("r", True), ("x", False)):
        with pytest.raises(ValueError):
            mode_of(path, *bad)
