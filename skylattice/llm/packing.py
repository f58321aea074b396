"""Best-fit packing of tokenised documents by minimum bin slack.

A document is its token ids and an end id. Documents longer than a sequence are cut into full pieces, with a shorter
piece first, so only that piece competes for space. Pieces of one length are alike, so packing needs the number of
pieces by length alone: at most as many numbers as a sequence has tokens. For one bin after another, the longest
piece left opens the bin and a bitset subset-sum over the lengths left finds the fullest combination that still fits;
the combination is removed as often as the lengths left allow. Pieces then look up their place by length and rank
among pieces of that length; ranks come from counts of (length, bucket) pairs, so no length gathers in one task.

Defined cases: null text is empty and gives one piece with the end id alone. Null and repeated doc_ids pack like any
other row; pieces alike in doc_id, number and ids take their places in any order, and the result is the same. Texts of any
length are packed whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, materialise
from .tokens import crc, default_vocabulary, encoder

CAPACITY, END = 1024, 2
#: Pieces that a bucket of ranks holds on average, at most; there are as many buckets as shuffle partitions, at least.
BUCKET_ROWS = 100_000


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """[(length, times)]: a combination of the lengths left whose sum is the largest of at most ``room``.

    Bit s of ``reach`` says that some combination sums to s. Each length is taken in lots of 1, 2, 4 ... pieces, so a
    bounded number of pieces needs few steps; the bitset after each lot is kept for going back from the best sum.
    """
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left = min(int(counts[length]), room // length)
        lot = 1
        while left > 0:
            take = min(lot, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            lot *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of bins, [(length, pieces of it in each bin)])] for counts[length] pieces of each length."""
    counts, out = np.array(counts, np.int64), []
    for longest in range(capacity, 0, -1):
        while counts[longest] > 0:
            counts[longest] -= 1
            rest = fullest(counts, capacity - longest)
            counts[longest] += 1
            each = dict(rest)
            each[longest] = each.get(longest, 0) + 1
            bins = min(int(counts[k]) // n for k, n in each.items())
            for k, n in each.items():
                counts[k] -= bins * n
            out.append((bins, sorted(each.items(), reverse=True)))
    return out


class Places:
    """Where the piece of a given length and rank goes, from a plan."""

    def __init__(self, found: list[tuple[int, list[tuple[int, int]]]], capacity: int = CAPACITY):
        by_length: dict[int, list[tuple[int, int, int, int]]] = {}
        taken, sequence = [0] * (capacity + 1), 0
        for bins, each in found:
            offset = 0
            for length, n in each:
                by_length.setdefault(length, []).append((taken[length], n, sequence, offset))
                taken[length] += bins * n
                offset += length * n
            sequence += bins
        self.sequences = sequence
        self.table = {k: np.array(v, np.int64).T for k, v in by_length.items()}

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence ids, offsets)."""
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths).tolist():
            here = np.flatnonzero(lengths == length)
            first, n, base, start = self.table[length]
            k = np.searchsorted(first, ranks[here], "right") - 1
            within = ranks[here] - first[k]
            sequence[here] = base[k] + within // n[k]
            offset[here] = start[k] + within % n[k] * length
        return sequence, offset


def pieces(docs: DataFrame, vocabulary: str, end: int = END, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""

    def cut(batches):
        tool = encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                flat, offsets = tool.encode(*byte_rows(part.column(1)))
                rows: list[list] = [[], [], [], [], [], []]
                for k in range(part.num_rows):
                    own = np.append(flat[offsets[k] : offsets[k + 1]], np.uint32(end))
                    bounds = range(len(own) % capacity or capacity, len(own) + 1, capacity)
                    for p, hi in enumerate(bounds):
                        a = bounds[p - 1] if p else 0
                        for column, value in zip(rows, (k, p, a, hi - a, crc(own[a:hi]), own[a:hi] if ids else None), strict=True):
                            column.append(value)
                columns = [part.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:5])]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in rows[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, end: int = END, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset; with ``ids`` the token ids of each piece as well."""
    made = materialise(pieces(docs, vocabulary or default_vocabulary(), end, capacity, ids), "packing-pieces")
    n = made.count()
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // BUCKET_ROWS)
    dealt = made.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    counts = materialise(counts, "packing-counts", n)
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect():  # a row for each length: capacity at most
        histogram[row["length"]] = row["n"]
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(histogram, capacity), capacity))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("length", "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("__rank", rank).join(before, ["length", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    columns = made.columns

    def place(batches):
        for batch in batches:
            sequence, offset = places.value.of(batch.column("length").to_numpy(zero_copy_only=False), batch.column("__rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = made.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    return ranked.select(*columns, "__rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): whole sequences, from pack(..., ids=True). A group is one sequence, so it is small."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every document left, packed; null and empty texts are a piece of the end id alone.

    Its columns are op4_best_fit_packing's; all other columns of documents end here.
    """
    return pack(docs)
