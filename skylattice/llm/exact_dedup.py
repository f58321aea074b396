"""Exact deduplication by counting quotient filters.

Each input partition folds the 64-bit fingerprints of its texts into counting quotient filters, one per range of the
fingerprint's leading bits. Filters of one range merge without loss: their remainders are sorted within quotients, so
a merge is a merge of sorted runs that adds counts. Fingerprints counted more than once go to byte verification,
where rows group by the text itself. Groups of equal texts then meet all rows by their digest: as a broadcast while there
are at most ``BROADCAST_ROWS`` of them, and then no row that the filter proves unique ever moves; by one shuffle of the
rows beyond, where adaptive execution splits a group that holds many.

Defined cases: null text counts as empty, and all empty texts are equal. Of equal texts the largest doc_id stays; a
null doc_id is smaller than any other, and of rows that repeat doc_id and text exactly one stays. An empty table gives
an empty result. Further columns of the input pass through; those named like a result column are replaced by it.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_rows, materialise

#: Fingerprints a merged filter holds on average.
BLOCK_ROWS = 200_000
#: Tables of repeated fingerprints, and of groups, up to this many rows (under 100 bytes each) are broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 500_000


def two_runs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending runs of (values, counts) as one: each value of the second finds its place in the first."""
    place = np.searchsorted(a[0], b[0]) + np.arange(len(b[0]))
    own = np.ones(len(a[0]) + len(b[0]), bool)
    own[place] = False
    out = []
    for x, y in zip(a, b, strict=True):
        merged = np.empty(len(own), x.dtype)
        merged[own], merged[place] = x, y
        out.append(merged)
    return out[0], out[1]


class CountingQuotientFilter:
    """Distinct 64-bit fingerprints and their counts.

    ``occupied`` has a bit per quotient, ``ends`` a bit per slot that ends a quotient's run, ``remainders`` a slot per
    fingerprint in order, ``repeated`` a bit per slot whose count is over one; such counts follow in ``counters``.
    """

    def __init__(self, bits: int, occupied, ends, remainders, repeated, counters):
        self.bits, self.occupied, self.ends = bits, occupied, ends
        self.remainders, self.repeated, self.counters = remainders, repeated, counters

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, bits: int | None = None) -> CountingQuotientFilter:
        """From fingerprints in any order; counts as given, or one each."""
        values = np.asarray(fingerprints, np.uint64)
        order = np.argsort(values, kind="stable")
        return cls.from_sorted(values[order], np.ones(len(values), np.int64) if counts is None else np.asarray(counts, np.int64)[order], bits)

    @classmethod
    def from_sorted(cls, values: np.ndarray, weights: np.ndarray, bits: int | None = None) -> CountingQuotientFilter:
        """From fingerprints in ascending order; counts of equal ones add up."""
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        values, weights = values[first], np.add.reduceat(weights, first) if len(first) else weights
        if bits is None:
            bits = max(3, min(24, int(np.ceil(np.log2(len(values) + 1)))))
        quotient = (values >> np.uint64(64 - bits)).astype(np.int64)
        occupied = np.zeros(1 << bits, bool)
        occupied[quotient] = True
        ends = np.concatenate([quotient[1:] != quotient[:-1], [True]]) if len(values) else np.zeros(0, bool)
        return cls(bits, occupied, ends, values & np.uint64((1 << (64 - bits)) - 1), weights > 1, weights[weights > 1])

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints in ascending order, counts)."""
        run = np.concatenate([[0], np.cumsum(self.ends)[:-1]]).astype(np.int64) if len(self.ends) else np.zeros(0, np.int64)
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        counts = np.ones(len(self.remainders), np.int64)
        counts[self.repeated] = self.counters
        return (quotient << np.uint64(64 - self.bits)) | self.remainders, counts

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The filter of all fingerprints together: sorted runs merge, counts add up, nothing is lost."""
        runs = [f.items() for f in filters] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        while len(runs) > 1:
            runs = [two_runs(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        return cls.from_sorted(*runs[0])

    def count(self, fingerprint: int) -> int:
        """How often a fingerprint was added: rank in the occupied bits gives the run, a binary search the slot."""
        quotient, rest = fingerprint >> (64 - self.bits), fingerprint & ((1 << (64 - self.bits)) - 1)
        if not self.occupied[quotient]:
            return 0
        stops = np.flatnonzero(self.ends)
        run = int(self.occupied[:quotient].sum())
        lo, hi = (int(stops[run - 1]) + 1 if run else 0), int(stops[run]) + 1
        at = lo + int(np.searchsorted(self.remainders[lo:hi], np.uint64(rest)))
        if at == hi or int(self.remainders[at]) != rest:
            return 0
        return int(self.counters[self.repeated[:at].sum()]) if self.repeated[at] else 1

    def to_bytes(self) -> bytes:
        width = -(-(64 - self.bits) // 8)
        packed = np.ascontiguousarray(self.remainders, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        head = struct.pack("<BIQQ", self.bits, width, len(self.remainders), len(self.counters))
        return head + b"".join((np.packbits(self.occupied).tobytes(), np.packbits(self.ends).tobytes(), packed.tobytes(), np.packbits(self.repeated).tobytes(), self.counters.astype("<u8").tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, width, n, k = struct.unpack_from("<BIQQ", data)
        at = struct.calcsize("<BIQQ")

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        flags = lambda size: np.unpackbits(take(-(-size // 8)), count=size).astype(bool)
        occupied, ends = flags(1 << bits), flags(n)
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :width] = take(n * width).reshape(n, width)
        repeated = flags(n)
        return cls(bits, occupied, ends, remainders.view("<u8").reshape(-1).astype(np.uint64), repeated, take(8 * k).view("<u8").astype(np.int64))


def repeated_fingerprints(rows: DataFrame, column: str, n_rows: int) -> DataFrame:
    """(fp long, copies long): values of a long column that occur more than once, by merged filters."""
    lead = max(4, int(np.ceil(np.log2(max(1, n_rows / BLOCK_ROWS)))))

    def build(batches):
        waiting: list[np.ndarray] = []
        size = 0
        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(waiting[-1])
            if size >= 4_000_000:
                yield pack(waiting)
                waiting, size = [], 0
        if size:
            yield pack(waiting)

    def pack(parts: list[np.ndarray]) -> pa.RecordBatch:
        values = np.sort(np.concatenate(parts))
        block = (values >> np.uint64(64 - lead)).astype(np.int64)
        keys, first = np.unique(block, return_index=True)
        shifted = np.split(values << np.uint64(lead), first[1:])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([CountingQuotientFilter.of(v).to_bytes() for v in shifted], pa.binary())], names=["block", "filter"])

    def merge(key, table):
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("filter")])
        values, counts = merged.items()
        values = (values >> np.uint64(lead)) | np.uint64(key[0].as_py() << (64 - lead))
        many = counts > 1
        return pa.table({"fp": pa.array(values[many].view(np.int64)), "copies": pa.array(counts[many], pa.int64())})

    filters = rows.select(column).mapInArrow(build, "block long, filter binary")
    return filters.groupBy("block").applyInArrow(merge, "fp long, copies long")


def annotate(docs: DataFrame) -> DataFrame:
    """The rows of docs with keep_id, group_size, kept and text_sha256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    prints = docs.select("doc_id", text.alias("__dd_text"), F.xxhash64(text).alias("__dd_fp"))
    found = materialise(repeated_fingerprints(prints.select("__dd_fp"), "__dd_fp", docs.count()), "dedup-fingerprints")
    repeated, few = found.select(F.col("fp").alias("__dd_fp")), found.count() <= BROADCAST_ROWS
    suspects = prints.join(F.broadcast(repeated) if few else repeated, "__dd_fp", "left_semi")
    groups = suspects.groupBy("__dd_fp", "__dd_text").agg(F.max("doc_id").alias("__dd_keep"), F.count(F.lit(1)).alias("__dd_size"))
    groups = groups.filter("__dd_size > 1").select(F.sha2("__dd_text", 256).alias("__dd_sha"), "__dd_keep", "__dd_size")
    groups = materialise(groups, "dedup-groups")
    n_groups = groups.count()
    # a repeated fingerprint is one group or, should prints meet, a few: so the table is as bounded as the fingerprints
    of = F.broadcast(groups) if few and n_groups <= BROADCAST_ROWS else groups
    rows = docs.drop("keep_id", "group_size", "kept", "text_sha256").withColumn("__dd_sha", F.sha2(text, 256)).join(of, "__dd_sha", "left")
    alone = F.col("__dd_size").isNull()
    rows = rows.withColumns({
        "keep_id": F.when(alone, F.col("doc_id")).otherwise(F.col("__dd_keep")),
        "group_size": F.when(alone, F.lit(1)).otherwise(F.col("__dd_size")).cast("long"),
        "kept": alone | F.col("doc_id").eqNullSafe(F.col("__dd_keep")),
        "text_sha256": F.col("__dd_sha"),
    })
    rows = rows.drop("__dd_sha", "__dd_keep", "__dd_size")
    # rows that repeat the doc_id that stays, and its text: one of them stays. Usually there are none, and no row moves
    last = suspects.select("doc_id", F.sha2("__dd_text", 256).alias("__dd_sha")).join(of, "__dd_sha").filter("doc_id <=> __dd_keep")
    twins = last.groupBy("__dd_sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("__dd_sha").alias("text_sha256"))
    twins = materialise(twins, "dedup-twins", n_groups)
    n_twins = twins.count()
    if not n_twins:
        return rows
    twins = twins.withColumn("__dd_twin", F.lit(True))
    rows = rows.join(F.broadcast(twins) if n_twins <= BROADCAST_ROWS else twins, "text_sha256", "left")
    twin = F.coalesce(F.col("kept") & F.col("__dd_twin"), F.lit(False))
    first = F.row_number().over(Window.partitionBy("text_sha256").orderBy(F.xxhash64(F.to_json(F.struct(*(f"`{c}`" for c in docs.columns))))))
    names = [F.col(f"`{c}`") for c in rows.columns if c not in ("kept", "__dd_twin")]
    one = rows.filter(twin).select(*names, (first == 1).alias("kept"))
    return rows.filter(~twin).select(*names, "kept").unionByName(one)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return annotate(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of equal texts stays, that with the largest doc_id.

    Null texts equal empty ones, so one of them all stays. A null doc_id is smaller than any other; of rows that repeat
    doc_id and text one stays.
    """
    return kept_rows(docs, annotate, "kept")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
