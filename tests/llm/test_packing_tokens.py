import io
import tracemalloc
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm import packing, wavelet
from skylattice.llm.common import byte_rows
from skylattice.llm.tokens import Encoder, default_vocabulary, encoder
from skylattice.llm.wavelet import Shard

SCHEMA = "doc_id long, text string, piece string, length string, start string, part string"
ROWS = [(3, "hello there, world"), (1, None), (2, ""), (3, "hello there, world"), (None, "no id"), (5, "long words " * 3000), (4, "<|endoftext|> x")]


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "c", "c", None, "c") for d, t in rows], SCHEMA)


@given(st.lists(st.text(alphabet=st.sampled_from("ab Z'.,\n\t\r 1é漢 　“<|>endoftext!sl"), max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_ids_are_the_tokenizers(texts):
    tool = encoder(default_vocabulary())
    ids, offsets = tool.encode(*byte_rows(pa.array(texts, pa.string())))
    want = tool.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [w.ids for w in want]


def test_ids_with_a_small_table():
    tool = Encoder(default_vocabulary(), slots=64, arena=500)
    texts = [f"word{i} and other{i % 7}, again" for i in range(300)] * 2
    ids, offsets = tool.encode(*byte_rows(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [e.ids for e in tool.tokenizer.encode_batch(texts, add_special_tokens=False)]


def reference(rows, end):
    tool = encoder(default_vocabulary()).tokenizer
    return [(d, tool.encode(t or "", add_special_tokens=False).ids + [end]) for d, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_places_every_token_once(spark):
    got = packing.pack(docs(spark, ROWS), ids=True)
    want = defaultdict(list)
    for d, ids in reference(ROWS, 2):
        want[d].append(ids)
    by_doc, space = defaultdict(list), defaultdict(list)
    for r in got.collect():
        assert crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["ids"]))
        space[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, lists in want.items():
        n = len(lists)
        pieces = sorted(by_doc[d])
        for k, ids in enumerate(lists):
            mine = pieces[k::n]
            assert [i for _, _, p in mine for i in p] == ids
            assert [s for _, s, _ in mine] == np.cumsum([0] + [len(p) for _, _, p in mine])[:-1].tolist()
            assert all(len(p) == 1024 for _, _, p in mine[1:])
    for places in space.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(len(r["ids"]) for r in packing.sequences(got).collect()) == sum(len(i) for _, i in reference(ROWS, 2))


def test_packing_of_nothing(spark):
    assert packing.pack(docs(spark, [])).count() == 0


@given(st.lists(st.integers(1, 60), max_size=80))
@settings(max_examples=60, deadline=None)
def test_plan_fits_and_uses_all(lengths):
    counts = np.bincount(lengths, minlength=65)
    found = packing.plan(counts, 64)
    used = defaultdict(int)
    for bins, each in found:
        assert sum(k * n for k, n in each) <= 64
        for k, n in each:
            used[k] += bins * n
    assert all(used[k] == counts[k] for k in range(1, 65))
    bins = sum(b for b, _ in found)
    least, first_fit = -(-sum(lengths) // 64), []
    for x in sorted(lengths, reverse=True):  # no worse than first-fit decreasing by more than a bin
        for i, free in enumerate(first_fit):
            if free >= x:
                first_fit[i] -= x
                break
        else:
            first_fit.append(64 - x)
    assert least <= bins <= len(first_fit) + 1


@given(st.lists(st.integers(0, 12), max_size=9), st.integers(0, 30))
@settings(max_examples=80, deadline=None)
def test_fullest_is_the_best_subset(lengths, room):
    lengths = [x for x in lengths if x]
    got = packing.fullest(np.bincount(lengths, minlength=40), room)
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums}
    assert sum(k * n for k, n in got) == max(s for s in sums if s <= room)
    assert all(lengths.count(k) >= n for k, n in got)


@given(st.lists(st.integers(0, 300), max_size=200), st.sampled_from([8, 64, 1 << 16]))
@settings(max_examples=60, deadline=None)
def test_wavelet_matrix(ids, block):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(wavelet, "BLOCK_BITS", block)
        patch.setattr(wavelet, "STRETCH", 7)
        raw = wavelet.to_bytes(np.array(ids, np.uint32), 9, np.array([7, 8]), np.array([False, True]), np.array([len(ids) // 2, len(ids)]))
        m = Shard(io.BytesIO(raw), kept=3)
        doc_ids, missing, ends = m.documents()
        assert m.ids().tolist() == ids and missing.tolist() == [False, True] and ends.tolist() == [len(ids) // 2, len(ids)] and doc_ids.tolist() == [7, 8]
        for i in range(0, len(ids), 17):
            assert m.access(i) == ids[i]
        for t in {*ids[:4], 301, 600}:
            where = [i for i, x in enumerate(ids) if x == t]
            assert m.count(t) == len(where) and m.places(t).tolist() == where
            assert m.count(t, len(ids) // 3, len(ids)) == sum(i >= len(ids) // 3 for i in where)
            assert m.select(t, 1) == (where[1] if len(where) > 1 else -1)
        with pytest.raises(IndexError):
            m.access(len(ids))


def test_lookups_read_a_small_part_of_the_file():
    class Counted(io.BytesIO):
        got = 0

        def read(self, n=-1):
            data = super().read(n)
            self.got += len(data)
            return data

    ids = np.random.default_rng(4).zipf(1.3, 2_000_000) % 50_000
    raw = wavelet.to_bytes(ids, 16, np.array([1]), np.array([False]), np.array([len(ids)]))
    assert np.array_equal(Shard(io.BytesIO(raw)).ids(), ids)
    for ask, want in ((lambda m: m.access(1_234_567), int(ids[1_234_567])), (lambda m: m.count(3, 10, 1_000_000), int((ids[10:1_000_000] == 3).sum())), (lambda m: m.select(3, 1000), int(np.flatnonzero(ids == 3)[1000]))):
        file = Counted(raw)
        assert ask(Shard(file)) == want and file.got < len(raw) / 10
    with pytest.raises(ValueError, match="wavelet"):
        Shard(io.BytesIO(b"SWM1" + bytes(40)))


@pytest.mark.parametrize("rows", [ROWS, []])
def test_shards_read_back(spark, monkeypatch, rows):
    monkeypatch.setattr(wavelet, "SHARD_BYTES", 20)  # many shards
    monkeypatch.setattr(wavelet, "RUN_BITS", 1)
    manifest = wavelet.store(docs(spark, rows))
    got = wavelet.read_shards(manifest, 2).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    want = defaultdict(list)
    for d, ids in reference(rows, 0):
        want[d].append((len(ids), crc(ids)))
    at = 0
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        at += r["n_tokens"]


def test_writing_a_shard_takes_little_memory(spark, monkeypatch, tmp_path):
    frame, found = docs(spark, []), []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: found.append(f))
    monkeypatch.setattr(wavelet, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    wavelet.write_shards(frame, str(tmp_path))
    text = "".join(map(chr, np.random.default_rng(8).choice(np.r_[97:105, 33:40], 2_000)))
    rows = [pa.record_batch({"doc_id": range(i, i + 100), "text": [text] * 100}) for i in range(0, 2_000, 100)]
    list(found[0](iter(rows[:1])))  # tables of the process
    tracemalloc.start()
    (row,) = found[0](iter(rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = row.column(3)[0].as_py()
    assert n > 1_000_000 and peak < 14 * n
    with open(row.column(1)[0].as_py(), "rb") as f:
        ids = Shard(f).ids()
    assert (ids.reshape(2_000, -1) == [*reference([(1, text)], 0)[0][1]]).all()
