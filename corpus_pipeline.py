"""A corpus pipeline of five training-data operators, each stage over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm.common import materialise
from skylattice.llm.decontaminate import decontaminate_stage
from skylattice.llm.exact_dedup import dedup_stage
from skylattice.llm.jaccard import jaccard_stage
from skylattice.llm.packing import packing_stage
from skylattice.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", dedup_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontamination", decontaminate_stage),
    ("packing", packing_stage),
]

#: A trained classifier, connected components and bin packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again.

    Null and empty texts pass the classifier as any text, count as equal in deduplication (one stays, as pairs of a null and an
    empty text are equal too), are similar to nothing, hold no benchmark passage, and are packed as an end id. Null and repeated
    doc_ids are judged row by row, but that of rows that repeat doc_id and text one stays. Further columns go
    along until the last stage. Empty tables give an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
