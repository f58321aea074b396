import hashlib
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm import exact_dedup, jaccard
from skylattice.llm.components import components
from skylattice.llm.exact_dedup import CountingQuotientFilter

SCHEMA = "doc_id long, text string, lang string, keep_id string, node string, token string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, None, "clash", "clash", None) for d, t in rows], SCHEMA)


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 20), max_size=200), st.integers(1, 4))
@settings(max_examples=40, deadline=None)
def test_filters_merge_without_loss(values, parts):
    whole = CountingQuotientFilter.of(np.array(values, np.uint64))
    lots = [CountingQuotientFilter.from_bytes(CountingQuotientFilter.of(np.array(values[i::parts], np.uint64)).to_bytes()) for i in range(parts)]
    merged = CountingQuotientFilter.merge(lots)
    for a, b in zip(whole.items(), merged.items(), strict=True):
        assert a.tolist() == b.tolist()
    for v in values[:20]:
        assert merged.count(v) == values.count(v)
    assert sum(merged.items()[1]) == len(values)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (None, "a"), (None, "z"), (None, "z"), (7, "c"), (7, "c"), (8, "x" * 300_000), (9, "x" * 300_000), (10, "A")]


def test_exact_dedup_against_brute_force(spark):
    got = exact_dedup.annotate(docs(spark, ROWS)).collect()
    groups = defaultdict(list)
    for d, t in ROWS:
        groups[t or ""].append(d)
    assert len(got) == len(ROWS)
    for r in got:
        group = groups[r["text"] or ""]
        known = [d for d in group if d is not None]
        assert r["keep_id"] == (max(known) if known else None)
        assert r["group_size"] == len(group)
        assert r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    kept = [(r["doc_id"], r["text"] or "") for r in got if r["kept"]]
    assert len(kept) == len(groups) and {t for _, t in kept} == set(groups)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.annotate(docs(spark, [])).count() == 0
    kept = exact_dedup.dedup_stage(spark, docs(spark, ROWS), "").collect()
    assert len(kept) == 7 and {r["keep_id"] for r in kept} == {"clash"}


@pytest.mark.parametrize("shuffled", [False, True])
def test_dedup_joins_alike_when_broadcast_or_not(spark, monkeypatch, shuffled):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", -1 if shuffled else 10)
    got = exact_dedup.annotate(docs(spark, ROWS)).filter("kept").count()
    assert got == 7


def brute(rows, size=4, percent=85):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        sets.append((d, frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            k = len(x & y)
            if x and y and None not in (a, b) and 100 * k >= percent * (len(x) + len(y) - k):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=repr)


def planted(seed, n=40):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [vocabulary[i] for i in rng.integers(0, 400, 60)]
    rows, texts = [], []
    for d in range(n):
        kind = rng.integers(4)
        if kind == 0 and texts:  # a near copy, of a copy too
            words = list(texts[rng.integers(len(texts))])
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(len(words))] = f"new{rng.integers(10**6)}"
        elif kind == 1:
            words = passage + [vocabulary[i] for i in rng.integers(0, 400, rng.integers(0, 20))]
        else:
            words = [vocabulary[i] for i in rng.integers(0, 400, rng.integers(1, 150))]
        texts.append(words)
        rows.append((int(d), " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 4, 85), (2, 5, 80)])
def test_jaccard_join_against_brute_force(spark, seed, size, percent):
    rows = planted(seed) + [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "ONE two"), (905, "one  two three"), (906, "É one two three"), (907, "é one two three"), (None, "one two"), (910, "long " * 30_000), (911, "long " * 30_001)]
    got = jaccard.join(docs(spark, rows), size, percent)[0].collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, size, percent)


def test_jaccard_of_repeated_ids_and_of_nothing(spark):
    rows = [(5, "a b c d e"), (5, "x y z u v"), (3, "a b c d e"), (9, "x y z u v"), (9, "x y z u v")]
    got = jaccard.join(docs(spark, rows))[0].collect()
    assert {r["component_id"] for r in got} == {3} and len(got) == 5
    assert jaccard.join(docs(spark, []))[0].count() == 0


def test_stage_keeps_one_of_each_group(spark):
    rows = planted(3)
    kept = {r["doc_id"] for r in jaccard.jaccard_stage(spark, docs(spark, rows), "").collect()}
    assert kept == {c for _, _, c in brute(rows, 5, 80)}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (3, 2)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}


@pytest.mark.parametrize("words", [40, 400_000])
def test_sets_of_a_chunk_take_little_memory(tmp_path, words):
    """Temporary arrays grow with a lot, not with the chunk; a text beyond a lot counts whole."""
    text = np.frombuffer(" ".join(map(str, np.random.default_rng(6).integers(0, 1 << 30, words))).encode(), np.uint8)
    copies = max(1, jaccard.CHUNK_BYTES // len(text))
    offsets = np.arange(copies + 1) * len(text)
    path = str(tmp_path / "a.texts")
    jaccard.Chunk.save(path, np.tile(text, copies), offsets)
    jaccard.Chunk.sets(path, np.arange(1), 4)  # tables of the process
    tracemalloc.start()
    tokens, rows = jaccard.Chunk.sets(path, np.arange(copies), 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.diff(rows).tolist() == [words - 3] * copies
    if words == 40:
        assert peak < 9 * jaccard.CHUNK_BYTES
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jaccard, "LOT_BYTES", 1 << 12)
        again, _ = jaccard.Chunk.sets(path, np.arange(min(copies, 50)), 4)
        patch.setattr(jaccard, "LOT_TOKENS", 70)
        some = rows[: min(copies, 50) + 1]
        parts = jaccard.prefix_mask(again, some, 4, 85)
    assert np.array_equal(again, tokens[: len(again)])
    assert np.array_equal(parts, jaccard.prefix_mask(again, some, 4, 85))


def test_scratch_tables_start_few_programs(spark):
    """Each local file and checksum file has its mode set by a program, whose memory is an executor's twice until it is loaded."""
    import glob

    from skylattice.llm.common import materialise

    rows = spark.range(1000, numPartitions=40)
    many, few = materialise(rows, "scratch"), materialise(rows, "scratch", 1000)
    assert [len(glob.glob(f"{x.stored_at}/part-*.parquet")) for x in (many, few)] == [40, spark.sparkContext.defaultParallelism]
    for x in (many, few):
        assert sorted(r["id"] for r in x.collect()) == list(range(1000))
        assert not glob.glob(f"{x.stored_at}/.*.crc")


def test_components_go_to_few_files(spark, monkeypatch):
    """Tables of a round are as small as the links, however many partitions a shuffle has."""
    import glob

    from skylattice.llm import components as module

    written, real = [], module.materialise

    def counted(*args):
        out = real(*args)
        written.append(len(glob.glob(f"{out.stored_at}/part-*.parquet")))
        return out

    monkeypatch.setattr(module, "materialise", counted)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        links = spark.range(400).selectExpr("id AS a", "id + 1 AS b").filter("a % 10 <> 9")
        got = {r["node"]: r["component"] for r in module.components(links, 400).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 10 for i in range(400)}
    assert max(written) <= spark.sparkContext.defaultParallelism
