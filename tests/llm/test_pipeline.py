import corpus_pipeline
import pytest
from test_dedup_jaccard import brute as jaccard_brute
from test_warc_decontaminate import brute as window_brute

from skylattice.llm import registry, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    """The classifier's own decisions, then each later stage by plain Python over what is left."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    toxic = {r["doc_id"] for r in toxicity.op3_toxicity(spark, SF).collect() if r["predicted"]}
    left = [(d, t) for d, t in docs if d not in toxic]
    last = {}
    for d, t in left:
        last[t] = max(d, last.get(t, d))
    left = [(d, t) for d, t in left if last[t] == d]
    near = {d: c for d, _, c in jaccard_brute(left, 5, 80)}
    left = [(d, t) for d, t in left if near[d] == d]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in window_brute(left, items) if r[3]}  # a window of any one item
    assert bad  # the table holds passages that no earlier stage removes
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in left} - bad
    room = {}
    for r in got:
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert max(room.values()) <= 1024


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(None, None, "x", 1), (None, None, "x", 1), (1, "", "y", None), (2, "a b c", None, 2), (2, "a b c", None, 2)]
    for name, stage in corpus_pipeline.STAGES:
        df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_hit int")
        for part in (df, df.limit(0)):
            got = stage(spark, part, SF)
            got.collect()
            if name != "packing":
                assert got.columns == part.columns


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_carry_ids(spark, name):
    got = registry.QUERIES[name](spark, SF)
    key = "page_id" if name.startswith("op8") else "doc_id"
    table = "pages" if name.startswith("op8") else "documents"
    ids = [r[0] for r in got.select(key).collect()]
    assert set(ids) == {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
