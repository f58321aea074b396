import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.functions import quantize as Q
from skylattice.functions.checksum import decode_checksum, encode_checksum, folded, word_sum
from skylattice.functions import tiles
from skylattice.functions.codecs import Codec, decode, encode, hcompress, plio, rice

KINDS = ["u1", "i2", "i4"]


@given(st.sampled_from(KINDS), st.lists(st.integers(-(2**31), 2**31 - 1) | st.integers(-3, 3), min_size=1, max_size=150), st.sampled_from([8, 16, 32]))
@settings(max_examples=120, deadline=None)
def test_rice_round_trip(kind, values, block):
    x = np.array(values, np.int64).astype(kind)
    assert rice.decode_many([rice.encode(x, block)], np.array([len(x)]), np.dtype(kind), block)[0].tolist() == x.tolist()


@given(st.sampled_from(KINDS), st.integers(1, 400), st.integers(0, 31), st.sampled_from([8, 16, 32, 100]), st.integers(0, 1 << 30))
@settings(max_examples=150, deadline=None)
def test_rice_one_by_one_and_in_step_agree(kind, n, bits, block, seed):
    rng = np.random.default_rng(seed)
    info = np.iinfo(kind)
    x = np.clip(rng.integers(-(1 << bits), (1 << bits) + 1, n), info.min, info.max)
    x[: n // 3] = x[0]  # blocks without differences
    x = x.astype(kind)
    data = rice.encode(x, block)
    with pytest.MonkeyPatch.context() as patch:
        for least in (1, 300):
            patch.setattr(rice, "IN_STEP", least)
            assert np.array_equal(rice.decode_many([data], np.array([n]), np.dtype(kind), block)[0], x)
        if len(data) > 8:
            with pytest.raises(ValueError, match="ends inside"):
                rice.decode_many([data[: len(data) // 2]], np.array([n]), np.dtype(kind), block)


def test_rice_of_many_tiles_in_step():
    rng = np.random.default_rng(1)
    tiles = [(rng.normal(0, 10**k, n)).astype("i4") for k, n in ((0, 1), (1, 33), (3, 500), (5, 64), (8, 40), (0, 100))] + [np.zeros(70, "i4"), np.full(5, -(2**31), "i4")]
    got = rice.decode_many([rice.encode(t) for t in tiles], np.array([len(t) for t in tiles]), np.dtype("i4"))
    assert all(a.tolist() == b.tolist() for a, b in zip(got, tiles, strict=True))


def test_rice_stream_by_hand():
    # seed 5, then one block of differences 0, +1, -1: folded 0, 2, 1; split 0, so unary codes 1, 001, 01
    bits = f"{5:032b}" + f"{1:05b}" + "1" + "001" + "01"
    raw = bytes(int(bits.ljust(48, "0")[i : i + 8], 2) for i in range(0, 48, 8))
    assert rice.decode_many([raw], np.array([3]), np.dtype("i4"))[0].tolist() == [5, 6, 5]
    with pytest.raises(ValueError):
        rice.encode(np.zeros(4, "i8"))


@given(st.lists(st.tuples(st.integers(0, 2**27 - 1) | st.integers(0, 5), st.integers(1, 9000)), max_size=12))
@settings(max_examples=60, deadline=None)
def test_plio_round_trip(runs):
    x = np.concatenate([np.full(n, v) for v, n in runs]) if runs else np.zeros(0, int)
    assert plio.decode(plio.encode(x), len(x)).tolist() == x.tolist()


def test_plio_rejects():
    for bad in (-1, 2**27):
        with pytest.raises(ValueError):
            plio.encode(np.array([bad]))


@pytest.mark.parametrize("name", ["GZIP_1", "GZIP_2", "NOCOMPRESS"])
@pytest.mark.parametrize("kind", ["u1", "i2", "i4", "i8", "f4", "f8"])
def test_gzip_round_trip(name, kind):
    x = np.arange(50).astype(kind)
    assert decode(encode(x, Codec(name)), Codec(name), np.dtype(kind), 50).tolist() == x.tolist()


def test_codec_settings():
    assert Codec("rice").name == "RICE_1" and Codec("RICE_ONE") == Codec("RICE_1")
    for bad in ({"name": "LZW"}, {"name": "GZIP_1", "level": 10}):
        with pytest.raises(ValueError):
            Codec(**bad)


def test_dither_table_ends_where_the_standard_says():
    assert round(float(Q.table()[-1]) * Q.MODULUS) == pytest.approx(1043618065, rel=1e-6)


@pytest.mark.parametrize("method", ["none", "dither1", "dither2"])
def test_quantised_tiles(method):
    rng = np.random.default_rng(2)
    tile = rng.normal(100, 3, (20, 50)).astype("f4")
    tile[3, 4], tile[5, 5] = np.nan, 0
    settings_ = Q.Quantize(8, method, 3)
    stored, scale, zero = Q.quantise(tile, settings_, 9)
    back = Q.restore(stored, scale, zero, settings_.number, 9, 3, "f8").reshape(tile.shape)
    assert np.isnan(back[3, 4]) and np.nanmax(np.abs(back - tile)) <= scale * 0.51
    assert 0.1 < scale < 1.0 and (method != "dither2" or back[5, 5] == 0)
    assert Q.quantise(np.full((4, 20), 7.0), settings_, 1) is None


@given(st.binary(max_size=400))
@settings(max_examples=80, deadline=None)
def test_checksums(data):
    data += bytes(-len(data) % 4)
    total = sum(int.from_bytes(data[i : i + 4], "big") for i in range(0, len(data), 4))
    while total > 0xFFFFFFFF:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    assert word_sum(data) == total
    text = encode_checksum(total)
    assert text.isalnum() and len(text) == 16 and decode_checksum(text) == total
    words = (text[1:] + text[0]).encode()
    assert folded(total + sum(int.from_bytes(words[i : i + 4], "big") for i in range(0, 16, 4)) - 4 * 0x30303030 % (1 << 40)) in (0, 0xFFFFFFFF)


def test_datasum_anchor():
    assert word_sum(np.arange(64).astype(">i4").tobytes()) == 2016


@given(st.integers(4, 40), st.integers(4, 40), st.integers(0, 9), st.integers(0, 1 << 30))
@settings(max_examples=150, deadline=None)
def test_hcompress_round_trip(rows, columns, digits, seed):
    rng = np.random.default_rng(seed)
    tile = rng.integers(-(10**digits), 10**digits + 1, (rows, columns))
    for x in (tile, np.abs(tile), np.cumsum(tile // 50, 1)):
        assert np.array_equal(hcompress.decode(hcompress.encode(x)), x)


def test_hcompress_streams_by_hand():
    head = bytes.fromhex("dd99 00000004 00000004 00000000".replace(" ", ""))
    constant = head + (56).to_bytes(8, "big") + bytes([0, 0, 0]) + b"\0"  # a sum alone: 16 pixels of 7, times 8 over 16
    assert hcompress.encode(np.full((4, 4), 7)) == constant and (hcompress.decode(constant) == 7).all()
    # planes of the kind beside the sums: F, code 011 of a square whose first bit is set; F, code 111110 of none; end 0; sign -
    bits = "1111" + "011" + "1111" + "111110" + "0000"
    one = head + (0).to_bytes(8, "big") + bytes([0, 3, 0]) + int((bits * 1).ljust(24, "0"), 2).to_bytes(3, "big")
    got = hcompress.Bits(one[25:])
    assert got.plane((2, 2)).tolist() == [[1, 0], [0, 0]] and got.plane((2, 2)).tolist() == [[0, 0], [0, 0]] and got.nybbles(1)[0] == 0
    direct = hcompress.Bits(bytes([0b0000_1010, 0b0101_0000, 0b1111_0000]))
    assert direct.plane((2, 4)).tolist() == [[1, 0, 0, 1], [1, 0, 0, 1]]
    for bad in (b"", constant[:20], b"xx" + constant[2:], constant[:-1], constant[:22] + b"\1" + constant[23:]):
        with pytest.raises(ValueError, match="HCOMPRESS"):
            hcompress.decode(bad)


def test_hcompress_scale_and_smoothing():
    at = np.arange(64)
    smooth = (1000 * np.sin(at[:, None] / 9) + at * 20).astype(int)
    lossy = hcompress.encode(smooth, 200)
    plain, even = (np.abs(hcompress.decode(lossy, s) - smooth) for s in (False, True))
    assert len(lossy) < len(hcompress.encode(smooth)) / 3 and plain.max() < 200 and even.mean() < plain.mean()
    assert np.array_equal(hcompress.decode(hcompress.encode(smooth, 1)), smooth)


def test_hcompress_tiles():
    codec = Codec("HCOMPRESS_1")
    assert [tiles.default_tile((n, 50), codec) for n in (9, 30, 32, 33, 35, 49)] == [(9, 50), (30, 50), (16, 50), (24, 50), (24, 50), (20, 50)]
    for kind, shape, tile in (("i8", (8, 8), (8, 8)), ("i4", (8, 8, 8), (1, 8, 8)), ("i4", (8, 9), (4, 3)), ("i4", (9, 8), (8, 8))):
        with pytest.raises(ValueError, match="HCOMPRESS"):
            tiles.check(codec, np.dtype(kind), False, False, shape, tile)
    tiles.check(codec, np.dtype("f4"), False, True, (8, 8), (4, 8))
