import base64
import hashlib
import io
import re
import zipfile
from collections import defaultdict

import numpy as np
import pytest

from skylattice.llm import decontaminate, warc
from skylattice.llm.warc import ZipReader, zip_stored


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directories_and_ranges(zip64):
    members = [("a/x.warc.gz", b"0123456789" * 50), ("indexes/é.cdx", b""), ("b", bytes(range(256)))]
    raw = zip_stored(members, zip64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:  # others read it too
        assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == members
    found = ZipReader(io.BytesIO(raw))
    assert list(found.members) == [n for n, _ in members]
    assert found.range("b", 10, 5) == bytes(range(10, 15)) and found.find("indexes/.*") == ["indexes/é.cdx"]
    with pytest.raises(ValueError, match="range"):
        found.range("b", 250, 10)


def test_zip_of_other_writers_and_damage():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"payload")
        z.writestr(zipfile.ZipInfo("packed"), b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK\x05\x06 inside"
    found = ZipReader(io.BytesIO(out.getvalue()))
    assert found.range("big", 0, 7) == b"payload"
    with pytest.raises(ValueError, match="compressed"):
        found.range("packed", 0, 1)
    with pytest.raises(ValueError, match="no end"):
        ZipReader(io.BytesIO(b"not a zip"))


PAGES = [(4, "http://x/4", "<p>a</p>"), (2, "http://x/2", "<p>a</p>"), (7, None, None), (9, "u\r\nX: y", ""), (5, "http://é", "é" * 200_000), (None, None, "<p>a</p>"), (None, "n", "alone"), (2, "http://x/2b", "<p>a</p>"), (11, "", "\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("rows", [PAGES, []])
def test_records_read_back(spark, rows):
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, first string")
    from skylattice.llm.common import materialise, shared_path

    archives = materialise(warc.write_archives(pages, shared_path(spark, "warc")), "manifest")
    got = warc.read_archives(archives, 2).collect()
    first = defaultdict(list)
    for p, _, h in rows:
        first[h or ""].append(p)
    assert len(got) == len(rows)
    want = []
    for p, _, h in rows:
        payload = (h or "").encode()
        known = [x for x in first[h or ""] if x is not None]
        alone = not known or p == min(known)
        want.append((p, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if alone else "revisit", None if alone else min(known)))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, window=8):
    out = []
    windows = [(i or "", tuple(w[k : k + min(window, len(w))])) for i, t in items for w in [WORD.findall((t or "").translate(FOLD))] if w for k in range(len(w) - min(window, len(w)) + 1)]
    for d, t in docs:
        w = WORD.findall((t or "").translate(FOLD))
        hit, found = set(), set()
        for i, p in windows:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(i)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=repr)


def cases(seed):
    rng = np.random.default_rng(seed)
    pick = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 6, n))  # noqa: E731  few words: windows overlap and repeat
    items = [("b1", pick(12)), ("b2", pick(8)), ("b3", pick(3)), ("b4", "w1"), ("b4", pick(20)), (None, pick(9)), ("b5", None), ("b6", "!!"), ("b7", "É Ü naïve Word2 x y z u v")]
    docs = [(int(d), pick(rng.integers(0, 400)).replace("w1 ", "W1, ")) for d in range(12)] + [(50, None), (51, ""), (None, pick(30)), (52, "é ü; É Ü naïve WORD2 x y z u v"), (52, "w1")]
    return docs, items


@pytest.mark.parametrize(("seed", "item_bytes"), [(1, 1 << 20), (2, 20)])
def test_decontamination_against_brute_force(spark, monkeypatch, seed, item_bytes):
    monkeypatch.setattr(decontaminate.benchmark_blocks, "__defaults__", (item_bytes,))
    monkeypatch.setattr(decontaminate, "LOT_BYTES", 500)
    docs, items = cases(seed)
    table = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, n_hit string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.scan(table, benchmark).drop("text").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items)


def test_decontamination_of_a_very_long_text(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota"
    text = "word " * 300_000 + item + " word" * 300_000
    benchmark = spark.createDataFrame([("b1", item), ("b2", "word " * 9)], "item_id string, text string")
    got = decontaminate.scan(spark.createDataFrame([(1, text), (2, item)], "doc_id long, text string"), benchmark).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got] == [(600_009, 600_009, 2, True), (9, 9, 1, False)]


def test_decontamination_without_items_or_rows(spark):
    docs, items = cases(3)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.scan(table, none).filter("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate.scan(table.limit(0), spark.createDataFrame(items, none.schema)).count() == 0


def test_stage_drops_a_document_with_one_whole_item(spark, tmp_path):
    item = "the quick brown fox jumps over the lazy dog near a quiet river bank"
    spark.createDataFrame([("b1", item), ("b2", "nine other words that no document here holds at all")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seven = " ".join(item.split()[:7])
    docs = [(1, f"Before. {item.upper()}! After."), (2, "clean prose about a river and a dog"), (3, f"{seven} and then something else"), (4, None), (5, "")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert not decontaminate.scan(table, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).filter("contaminated").count()  # op10's column: two items
    assert sorted(tuple(r) for r in decontaminate.decontaminate_stage(spark, table, str(tmp_path)).collect()) == docs[1:]
