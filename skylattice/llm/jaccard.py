"""N-gram Jaccard join by filters under several global orders.

Two documents whose shingle sets have Jaccard similarity t or more share a token among the first
``n - ceil(t n) + 1`` tokens of each set, under any order of all tokens. Candidates must do so under three orders:

1. by how many documents hold the token, then by hash;
2. and 3. two further hash orders.

The first order makes candidates; the second and third are intersected with it before sets are compared. Document
frequencies for the first order come from one exchange of sorted token arrays between chunks of documents and ranges
of tokens. A token in one document alone makes no candidate, and takes one from what its document can share with any
other: a document with too many of those links to nothing, and a pair needs enough others on both sides.

Documents with equal sets are one node. Nodes that share a prefix token are compared with one node of the token
first, that with the fewest tokens of its own, in as many pairs as there are nodes. The components of these links are found; where a token's nodes still
lie in several components, all pairs across components are compared. Pairs inside a component can't change it, so no
link between components is lost and none is counted.

Texts are copied to the shared folder in chunks once, so later steps fetch what they need and no shuffle moves text.

Defined cases: null and empty texts, or texts without words, have an empty set, link to nothing and are their own
component. Texts of fewer words than a shingle have one shingle, the whole. Rows with a null doc_id get n_shingles, link
to nothing, and have a null component_id. Rows that repeat a doc_id are one node of several texts. doc_ids are whole
numbers, or text of them; other text stops the job. Ties go to the smallest doc_id. Texts of any length count whole.
Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, dealt, drop_table, give_back, lots, materialise, open_file, segments, shared_path, write_file
from .components import components
from .hashing import hash_pieces, lower_ascii, words

#: Bytes of text in a chunk; documents that one sort takes at most, by the bits left for them above a token's 53.
CHUNK_BYTES, DOC_BITS = 8 << 20, 11
TOKEN_BITS = 64 - DOC_BITS
#: Bytes of text, and tokens, that are worked on at once: temporary arrays take some 20 times as much.
LOT_BYTES, LOT_TOKENS = 1 << 20, 1 << 18
#: Logarithm of the ranges of tokens that document frequencies are counted in, at most: a chunk sends a message to each.
BLOCK_BITS = 19

#: Bytes between words: space and tab to carriage return.
_INSIDE = np.ones(256, bool)
_INSIDE[0x20] = False
_INSIDE[0x09:0x0E] = False
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mix(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of hashes, another one for each k."""
    x = (x ^ _MIX[k]) * _MIX[(k + 3) % 8]
    x ^= x >> np.uint64(29)
    x = x * _MIX[(k + 5) % 8]
    return x ^ (x >> np.uint64(32))


def token_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all texts, each text's in ascending order without repeats; offsets of texts in them)."""
    found, counts, most = [], [np.zeros(1, np.int64)], (1 << DOC_BITS) - 1
    for lo, hi in lots(offsets, most, LOT_BYTES):
        own = offsets[lo : hi + 1]
        lower = lower_ascii()[data[own[0] : own[-1]]]
        starts, ends, rows = words(lower, own - own[0], _INSIDE)
        h, _ = hash_pieces(lower, starts, ends)
        n = np.diff(rows)
        windows = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        at = segments(windows, rows[:-1])
        doc = np.repeat(np.arange(len(n)), windows)
        span = np.minimum(n, size)[doc]
        token = np.zeros(len(at), np.uint64)
        for j in range(size):
            inside = at + np.minimum(j, np.maximum(span - 1, 0))
            token += np.where(j < span, mix(h[inside], j % 8) * _MIX[j % 8], np.uint64(j + 1))
        key = (doc.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (mix(token, 7) >> np.uint64(DOC_BITS))
        key.sort()
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        counts.append(np.bincount((key >> np.uint64(TOKEN_BITS)).astype(np.int64), minlength=len(n)))
        found.append(key & np.uint64((1 << TOKEN_BITS) - 1))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.cumsum(np.concatenate(counts))


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of n that any partner shares at least: ceil(t n)."""
    return -(-percent * n // 100)


class Chunk:
    """Some documents' texts in one shared file."""

    @staticmethod
    def save(path: str, data: np.ndarray, offsets: np.ndarray) -> None:
        write_file(path, struct.pack("<Q", len(offsets)) + offsets.astype("<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(data.tobytes()))

    @staticmethod
    def sets(path: str, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """token_sets() of the given rows."""
        with open_file(path) as f:
            raw = f.read()
        (n,) = struct.unpack_from("<Q", raw)
        offsets = np.frombuffer(raw, "<i8", n, 8)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8 + 8 * n :]) if offsets[-1] else b"", np.uint8)
        lengths = offsets[rows + 1] - offsets[rows]
        data = np.concatenate([np.zeros(0, np.uint8), *(data[a:b] for a, b in zip(offsets[rows].tolist(), offsets[rows + 1].tolist(), strict=True))])
        return token_sets(data, np.concatenate([[0], np.cumsum(lengths)]), size)


def describe(docs: DataFrame, size: int, folder: str) -> DataFrame:
    """(doc_id, n, s1, s2, chunk, row): set sizes and 128-bit set hashes; texts go to chunks."""

    def run(batches):
        give_back()  # what other steps left in this worker
        task, files = TaskContext.get(), 0
        waiting: list[tuple] = []
        total = 0

        def flush():
            nonlocal waiting, total, files
            path = f"{folder}/{task.partitionId():08d}-{files:06d}-{task.taskAttemptId()}.texts"
            data, offsets = np.concatenate([w[1] for w in waiting]), np.concatenate([[0], np.cumsum(np.concatenate([w[2] for w in waiting]))])
            ids = pa.chunked_array([w[0] for w in waiting]).combine_chunks()
            Chunk.save(path, data, offsets)
            tokens, rows = token_sets(data, offsets, size)
            signs = []
            for k in (1, 2):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens, k))])
                signs.append(pa.array((sums[rows[1:]] - sums[rows[:-1]]).view(np.int64)))
            n = len(ids)
            waiting, total, files = [], 0, files + 1
            return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(rows)), *signs, pa.array([path] * n), pa.array(np.arange(n), pa.int32())], names=["doc_id", "n", "s1", "s2", "chunk", "row"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                data, offsets = byte_rows(part.column(1))
                waiting.append((part.column(0), data, np.diff(offsets)))
                total += len(data)
                if total >= CHUNK_BYTES:
                    del part, data
                    row = flush()
                    give_back()
                    yield row
        if waiting:
            yield flush()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, chunk string, row int")


class Orders:
    """The first global order: the leading bits of a token, its range and a number in it, find its document frequency.

    Ranges hold some 2 million tokens, until there are ``1 << BLOCK_BITS``. Tokens alike in these bits count together, which
    keeps one order for all documents; a frequency of 1 is then still the token's own.
    """

    def __init__(self, total: int):
        keep = min(TOKEN_BITS - 1, max(32, int(np.ceil(np.log2(max(2, total)))) + 10))
        self.block_bits = min(BLOCK_BITS, max(5, keep - 31))
        self.low_bits = min(32, keep - self.block_bits)

    def key(self, tokens: np.ndarray) -> np.ndarray:
        return tokens >> np.uint64(TOKEN_BITS - self.block_bits - self.low_bits)

    def distinct(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys of tokens in ascending order, documents with each)."""
        return np.unique(self.key(tokens), return_counts=True)


def frequencies(nodes: DataFrame, orders: Orders, size: int, chunks: int) -> DataFrame:
    """(chunk, block, df): for the chunk's keys of a block in order, in how many nodes each is, 255 at most."""
    low = np.uint64((1 << orders.low_bits) - 1)

    def send(key, table):
        chunk = key[0].as_py()
        keys, counts = orders.distinct(Chunk.sets(chunk, table.column("row").to_numpy(), size)[0])
        block = (keys >> np.uint64(orders.low_bits)).astype(np.int32)
        blocks, first = np.unique(block, return_index=True)
        lows, some = np.split((keys & low).astype("<u4"), first[1:]), np.split(np.minimum(counts, 255).astype(np.uint8), first[1:])
        del keys, counts, block
        give_back()
        return pa.table({"block": pa.array(blocks), "chunk": pa.array([chunk] * len(blocks), pa.string()), "lows": pa.array([x.tobytes() for x in lows[: len(blocks)]], pa.binary()), "counts": pa.array([x.tobytes() for x in some[: len(blocks)]], pa.binary())})

    def answer(key, table):
        lows = [np.frombuffer(x.as_py(), "<u4") for x in table.column("lows")]
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("counts")])
        _, back = np.unique(np.concatenate(lows), return_inverse=True)
        df = np.minimum(np.bincount(back, counts), 255).astype(np.uint8)[back]
        parts = np.split(df, np.cumsum([len(x) for x in lows])[:-1])
        del counts, back
        give_back()
        return pa.table({"chunk": table.column("chunk"), "block": table.column("block"), "df": pa.array([x.tobytes() for x in parts], pa.binary())})

    sent = dealt(nodes.select("chunk", "row"), "chunk", chunks).groupBy("chunk").applyInArrow(send, "block int, chunk string, lows binary, counts binary")
    return dealt(sent, "block", 1 << orders.block_bits).groupBy("block").applyInArrow(answer, "chunk string, block int, df binary")


def prefixes(nodes: DataFrame, counts: DataFrame, orders: Orders, size: int, percent: int, chunks: int) -> DataFrame:
    """(token, node, n, most, place): prefix tokens under the first order that other nodes may share, and their places in it; most: shared at most."""

    def run(key, table):
        rows = np.asarray(table.column("row").is_valid())
        own = table.filter(pa.array(rows))
        back = table.filter(pa.array(~rows)).sort_by("block")
        at, node = own.column("row").to_numpy(), own.column("node").to_numpy()
        tokens, offsets = Chunk.sets(key[0].as_py(), at, size)
        keys, _ = orders.distinct(tokens)
        df = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_py(), np.uint8) for x in back.column("df"))])
        out: list[list] = [[], [], [], [], []]
        for lo, hi in lots(offsets, (1 << DOC_BITS) - 1, LOT_TOKENS):
            mine = tokens[offsets[lo] : offsets[hi]]
            n = np.diff(offsets[lo : hi + 1])
            doc = np.repeat(np.arange(hi - lo), n)
            rank = df[np.searchsorted(keys, orders.key(mine))].astype(np.uint64)
            single = rank == 1
            order = np.argsort((doc.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (rank << np.uint64(TOKEN_BITS - 8)) | (mix(mine, 3) >> np.uint64(DOC_BITS + 8)))
            place = np.empty(len(mine), np.int64)
            place[order] = np.arange(len(mine))
            place -= (offsets[lo:hi] - offsets[lo])[doc]
            most = n - np.bincount(doc[single], minlength=hi - lo)
            take = ~single & (place < (n - need(n, percent) + 1)[doc]) & (most >= need(n, percent))[doc]
            for column, value in zip(out, (mine[take].view(np.int64), node[lo:hi][doc[take]], n[doc[take]], most[doc[take]], place[take]), strict=True):
                column.append(value)
        del tokens, keys, df
        give_back()
        return pa.table(dict(zip(("token", "node", "n", "most", "place"), (pa.array(np.concatenate(c)) for c in out), strict=True)))

    rows = nodes.select("chunk", "row", "node", F.lit(None).cast("int").alias("block"), F.lit(None).cast("binary").alias("df"))
    more = counts.select("chunk", F.lit(None).cast("int").alias("row"), F.lit(None).cast("long").alias("node"), "block", "df")
    return dealt(rows.union(more), "chunk", chunks).groupBy("chunk").applyInArrow(run, "token long, node long, n long, most long, place long")


def parted(tokens: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each document's tokens as bytes."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * 8
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(tokens))])


def prefix_mask(tokens: np.ndarray, offsets: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Which tokens of each set are in its prefix under hash order k."""
    keep = np.zeros(len(tokens), bool)
    for lo, hi in lots(offsets, (1 << DOC_BITS) - 1, LOT_TOKENS):
        at = offsets[lo : hi + 1]
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.argsort((doc.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (mix(tokens[at[0] : at[-1]], k) >> np.uint64(DOC_BITS)))
        first = np.arange(len(order)) - (at[:-1] - at[0])[doc] < (n - need(n, percent) + 1)[doc]
        keep[at[0] + order[first]] = True
    return keep


def fetch(nodes: DataFrame, size: int, percent: int, chunks: int) -> DataFrame:
    """(node, whole, second, third): the set, and its prefixes under the second and third order, as bytes."""

    def run(key, table):
        tokens, offsets = Chunk.sets(key[0].as_py(), table.column("row").to_numpy(), size)
        n = np.diff(offsets)
        doc = np.repeat(np.arange(len(n)), n)
        columns = [parted(tokens, n)]
        for k in (4, 5):
            keep = prefix_mask(tokens, offsets, k, percent)
            columns.append(parted(tokens[keep], np.bincount(doc[keep], minlength=len(n))))
        del doc, keep
        give_back()
        return pa.table({"node": table.column("node"), **dict(zip(("whole", "second", "third"), (c.cast(pa.binary()) for c in columns), strict=True))})

    rows = dealt(nodes.select("chunk", "row", "node"), "chunk", chunks)
    return rows.groupBy("chunk").applyInArrow(run, "node long, whole binary, second binary, third binary")


def shared(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Of each pair of rows, the tokens in both. A row is an ascending array without repeats, as bytes."""
    out, sides = [], []
    for column in (a, b):
        data, offsets = byte_rows(column)
        sides.append((np.frombuffer(data.tobytes(), np.uint64), offsets // 8))
    for lo, hi in lots(sides[0][1] + sides[1][1], (1 << DOC_BITS) - 1, LOT_TOKENS):
        keys = []
        for tokens, offsets in sides:
            pair = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(offsets[lo : hi + 1]))
            keys.append((pair << np.uint64(TOKEN_BITS)) | tokens[offsets[lo] : offsets[hi]])
        both = np.concatenate(keys)
        both.sort(kind="stable")  # two ascending runs: a merge
        twice = both[1:][both[1:] == both[:-1]]
        out.append(np.bincount((twice >> np.uint64(TOKEN_BITS)).astype(np.int64), minlength=hi - lo))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that pass the second and third order's filters and whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                for k in (4, 6):  # second, then third
                    part = part.filter(pa.array(shared(part.column(k), part.column(k + 1)) > 0))
                n, m = (np.diff(byte_rows(part.column(k))[1]) // 8 for k in (2, 3))
                both = shared(part.column(2), part.column(3))
                yield part.select(["a", "b"]).filter(pa.array(100 * both >= percent * (n + m - both)))

    side = lambda k: sets.select(F.col("node").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("whole", "second", "third")))
    rows = pairs.join(side("b"), "b").join(side("a"), "a")
    return rows.select("a", "b", *(f"{c}_{k}" for c in ("whole", "second", "third") for k in ("a", "b"))).mapInArrow(run, "a long, b long")


def possible(n, most, place, m, most_of_m, place_of_m, percent: int):
    """Whether sets of n and m tokens, that share at most ``most`` with any other, may be found similar enough at a token.

    Such sets share ``least`` tokens or more, so some shared token is among the first n - least + 1 of one and among
    the first m - least + 1 of the other.
    """
    least = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (most >= least) & (most_of_m >= least) & (n - least >= place) & (m - least >= place_of_m)


def join(docs: DataFrame, size: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n_shingles, component_id; links: a, b between the smallest doc_ids of equal sets, enough to connect all that are connected)."""
    spark = docs.sparkSession
    found = materialise(describe(docs, size, shared_path(spark, "jaccard-texts")), "jaccard-sets")
    count = found.count()
    known = found.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = known.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "chunk", "row")).alias("one"))
    nodes = materialise(nodes.select("s1", "s2", "n", F.col("one.doc_id").alias("node"), "one.chunk", "one.row"), "jaccard-nodes", count)
    total, chunks = nodes.agg(F.sum("n"), F.count_distinct("chunk")).first()
    orders = Orders(int(total or 0))
    grams = materialise(prefixes(nodes, frequencies(nodes, orders, size, chunks), orders, size, percent, chunks), "jaccard-prefixes")
    n_grams = grams.count()
    # the node with the fewest tokens of its own is the likeliest to link to the token's others
    lead = grams.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("most")).alias("own"), "node", "n", "most", "place")).alias("lead"), F.count(F.lit(1)).alias("nodes")).filter("nodes > 1")
    near = materialise(grams.join(lead.select("token", "lead"), "token"), "jaccard-buckets", n_grams)
    sets = nodes.join(near.select("node").distinct(), "node", "left_semi")
    sets = materialise(fetch(sets, size, percent, chunks), "jaccard-fetched")
    first = near.filter("node <> lead.node").filter(possible(*(F.col(f"{x}{c}") for x in ("", "lead.") for c in ("n", "most", "place")), percent))
    first = first.select(F.least("lead.node", "node").alias("a"), F.greatest("lead.node", "node").alias("b")).distinct()
    links = materialise(verify(first, sets, percent), "jaccard-links")

    whole = found.filter("doc_id IS NOT NULL").join(nodes.select("s1", "s2", "n", "node"), ["s1", "s2", "n"], "left")
    again = whole.filter("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("rows"))
    again = materialise(again.filter("rows > 1 AND (a <> b OR a <> doc_id)").select("doc_id"), "jaccard-repeats", count)
    again = whole.join(again, "doc_id", "left_semi").filter("node IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    part = components(links.union(again), links.count() + count)
    labelled = near.join(part, "node", "left").select("token", "node", "n", "most", "place", F.col("lead.node").alias("lead"), F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("token")
    open_ = materialise(labelled.join(mixed, "token", "left_semi"), "jaccard-open", n_grams)
    a, b = open_.alias("a"), open_.alias("b")
    may = possible(*(F.col(f"{x}.{c}") for x in "ab" for c in ("n", "most", "place")), percent)
    across = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & (F.col("a.node") != F.col("a.lead")) & (F.col("b.node") != F.col("a.lead")) & may)
    more = materialise(verify(across.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), sets, percent), "jaccard-links")
    links = links.union(more)
    part = components(links.union(again), links.count() + count) if not more.isEmpty() else part
    for done in (grams, near, open_, sets):  # results below read none of them
        drop_table(spark, done)
    rows = found.join(nodes.select("s1", "s2", F.col("n").alias("n"), "node"), ["s1", "s2", "n"], "left")
    rows = rows.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id"))).join(part, "node", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id")), links


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component (five words, similarity 0.8) the smallest doc_id stays; null doc_ids stay.

    Null and empty texts are similar to nothing and stay. Rows that repeat a doc_id stay or go together.
    """
    rows = join(docs, size=5, percent=80)[0]
    gone = rows.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
