"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of 8 consecutive item words; an item of fewer words is one pattern. Patterns of one length are
searched together. Blocks are two words (one, for patterns of one word). The shift table says how far a search may
jump when the block at the end of its window is not near the end of any pattern; blocks that may end a pattern have
shift 0 and lead, by the block as hash, to a bucket of patterns, which are compared word by word. Many places of many
texts are searched at once by array operations: long texts are cut into stretches that overlap by a window.

Words are compared by 128-bit hashes. Items go to files in the shared folder, in blocks of a fixed number of bytes (or one
item); the driver sees the files' names alone. A task searches a lot of texts for one block after another, so its memory is
that of a lot and a block's tables, however many items there are; where one block holds all, its tables are built once.

Defined cases: null and empty texts have no words, no hits and are clean. Texts of any length are searched whole. Null items and items without words have no
window; a null item_id counts as the empty string. Repeated items with one item_id count once. Null and repeated
doc_ids are judged row by row. An empty benchmark or empty table gives zero hits or no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import byte_rows, kept_rows, materialise, open_file, shared_path, write_file
from .hashing import hash_pieces, lower_ascii, words

WINDOW, LEAST_ITEMS = 8, 2
#: Words of a text that one search runs through before the next begins; item bytes in one block of patterns.
STRETCH, ITEM_BYTES = 256, 16 << 20
#: Rows that are searched at once, and bytes of text that wait for all blocks of items where there are several.
ROWS, LOT_BYTES = 2000, 64 << 20

#: Bytes of words: digits, lower-case letters after folding, and all beyond ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every word of every text, and the texts' offsets in words."""
    lower = lower_ascii()[data]
    starts, ends, rows = words(lower, offsets, _INSIDE)
    return *hash_pieces(lower, starts, ends), rows


class WuManber:
    """Patterns of one length, as rows of word numbers from 1; 0 is any other word."""

    def __init__(self, patterns: np.ndarray, vocabulary: int):
        self.m, self.patterns, self.vocabulary = patterns.shape[1], patterns, vocabulary
        self.width = min(2, self.m)
        self.most = self.m - self.width + 1
        blocks = np.concatenate([self.block(patterns, j) for j in range(self.most)])
        shifts = np.repeat(np.arange(self.most)[::-1], len(patterns))
        order = np.lexsort((shifts, blocks))
        blocks, shifts = blocks[order], shifts[order]
        first = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        self.blocks, self.shifts = blocks[first], shifts[first]
        last = self.block(patterns, self.most - 1)
        self.order = np.argsort(last, kind="stable")
        self.from_ = np.searchsorted(last[self.order], self.blocks, "left")
        self.to = np.searchsorted(last[self.order], self.blocks, "right")

    def block(self, table: np.ndarray, j: int) -> np.ndarray:
        """The block of words that begins at column j."""
        b = table[:, j].astype(np.int64)
        return b * (self.vocabulary + 1) + table[:, j + 1] if self.width == 2 else b

    def search(self, text: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first words, patterns) of all occurrences that begin in starts[i] .. stops[i] - 1; they lie within text."""
        found_at, found = [], []
        at, stop = starts.copy(), stops.copy()
        while len(at):
            end = at + self.m - self.width
            block = text[end] * (self.vocabulary + 1) + text[end + 1] if self.width == 2 else text[end]
            k = np.minimum(np.searchsorted(self.blocks, block), len(self.blocks) - 1)
            known = self.blocks[k] == block
            shift = np.where(known, self.shifts[k], self.most)
            stay = np.flatnonzero(shift == 0)
            if len(stay):
                lo, n = self.from_[k[stay]], self.to[k[stay]] - self.from_[k[stay]]
                place = np.repeat(at[stay], n)
                ends = np.cumsum(n)
                pattern = self.order[np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(lo, n)]
                for j in range(self.m):  # direct comparison
                    same = text[place + j] == self.patterns[pattern, j]
                    place, pattern = place[same], pattern[same]
                found_at.append(place)
                found.append(pattern)
                shift[stay] = 1
            at = at + shift
            on = at < stop
            at, stop = at[on], stop[on]
        none = np.zeros(0, np.int64)
        return (np.concatenate(found_at), np.concatenate(found)) if found else (none, none)


class Patterns:
    """Windows of a block of items, ready to search."""

    def __init__(self, item_ids: list[str], texts: list[str], window: int = WINDOW):
        self.items = item_ids
        h, g, rows = word_hashes(*byte_rows(pa.array(texts, pa.string())))
        order = np.lexsort((g, h))
        keep = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]) if len(h) else np.zeros(0, bool)
        number = np.zeros(len(h), np.int64)
        number[order] = np.cumsum(keep)
        self.h, self.g = h[order][keep], g[order][keep]
        by_length: dict[int, tuple[list, list]] = {}
        for item in range(len(texts)):
            own = number[rows[item] : rows[item + 1]]
            m = min(window, len(own))
            if m:
                windows, items = by_length.setdefault(m, ([], []))
                windows.append(np.lib.stride_tricks.sliding_window_view(own, m))
                items.append(np.full(len(own) - m + 1, item))
        self.tools = [(WuManber(np.concatenate(w), len(self.h)), np.concatenate(i)) for w, i in by_length.values()]

    def numbers(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.zeros(len(h), np.int64)
        k = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where((self.h[k] == h) & (self.g[k] == g), k + 1, 0)

    def hits(self, h: np.ndarray, g: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """(hit flag of every word, sorted distinct (text, item))."""
        text, hit, pairs = self.numbers(h, g), np.zeros(len(h) + 1, np.int64), []
        for tool, items in self.tools:
            room = np.maximum(0, rows[1:] - rows[:-1] - tool.m + 1)
            parts = -(-room // STRETCH)
            begin = np.repeat(rows[:-1], parts) + STRETCH * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
            place, pattern = tool.search(text, begin, np.minimum(begin + STRETCH, np.repeat(rows[:-1] + room, parts)))
            np.add.at(hit, place, 1)
            np.add.at(hit, place + tool.m, -1)
            doc = np.searchsorted(rows, place, "right") - 1
            pairs.append(np.unique(doc * len(self.items) + items[pattern]))
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return np.cumsum(hit[:-1]) > 0, [divmod(int(x), len(self.items)) for x in both]


def benchmark_blocks(benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> list[str]:
    """Files of items, of at most item_bytes each (or one item), in the shared folder."""
    spark = benchmark.sparkSession
    folder = shared_path(spark, "benchmark")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def write(batches):
        context = TaskContext.get()
        waiting: list[pa.RecordBatch] = []
        size = files = 0

        def flush():
            nonlocal waiting, size, files
            path = f"{folder}/{context.partitionId():08d}-{files:06d}-{context.taskAttemptId()}.items"
            out = io.BytesIO()
            with pa.ipc.new_stream(out, waiting[0].schema) as stream:
                for part in waiting:
                    stream.write_batch(part)
            write_file(path, out.getvalue())
            waiting, size, files = [], 0, files + 1
            return pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

        for batch in batches:
            lengths = np.diff(byte_rows(batch.column(1))[1])
            lo = 0
            for i, n in enumerate(lengths.tolist()):
                if (waiting or i > lo) and size + n > item_bytes:
                    if i > lo:
                        waiting.append(batch.slice(lo, i - lo))
                    lo = i
                    yield flush()
                size += n
            if lo < batch.num_rows:
                waiting.append(batch.slice(lo))
        if waiting:
            yield flush()

    files = materialise(rows.coalesce(max(1, -(-size // item_bytes))).mapInArrow(write, "path string"), "benchmark-files")
    return sorted(r["path"] for r in files.collect())  # a name for each block


@lru_cache(maxsize=1)
def patterns(path: str, window: int) -> Patterns:
    """The tables of a file of items; the last ones stay."""
    with open_file(path) as f:
        table = pa.ipc.open_stream(io.BytesIO(f.read())).read_all()
    return Patterns(table.column("item_id").to_pylist(), table.column("text").to_pylist(), window)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_items: int = LEAST_ITEMS) -> DataFrame:
    """All columns of docs, with n_words, n_hit, n_items, items_sha256, contaminated; named columns of docs give way."""
    blocks = benchmark_blocks(benchmark)
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs = docs.drop(*added)
    names = docs.columns

    def judged(lot: list[pa.RecordBatch]):
        """The rows of a lot with their results; each block's tables are built once for all of it."""
        found = [(part, *word_hashes(*byte_rows(part.column(names.index("text"))))) for part in lot]
        hits = [np.zeros(len(h), bool) for _, h, _, _ in found]
        items: list[list[set]] = [[set() for _ in range(part.num_rows)] for part in lot]
        for path in blocks:
            tool = patterns(path, window)
            for k, (_, h, g, rows) in enumerate(found):
                flags, pairs = tool.hits(h, g, rows)
                hits[k] |= flags
                for doc, item in pairs:
                    items[k][doc].add(tool.items[item])
        for (part, _, _, rows), hit, own in zip(found, hits, items, strict=True):
            upto = np.concatenate([[0], np.cumsum(hit)])
            n = np.array([len(x) for x in own], np.int64)
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in own]
            more = [pa.array(np.diff(rows), pa.int64()), pa.array(upto[rows[1:]] - upto[rows[:-1]], pa.int64()), pa.array(n), pa.array(digest), pa.array(n >= least_items)]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*names, *added])

    def run(batches):
        lot, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                lot.append(batch.slice(lo, ROWS))
                size += int(byte_rows(lot[-1].column(names.index("text")))[1][-1])
                if len(blocks) < 2 or size >= LOT_BYTES:
                    yield from judged(lot)
                    lot, size = [], 0
        if lot:
            yield from judged(lot)

    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(added, ("long", "long", "long", "string", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str, least_items: int = 1) -> DataFrame:
    """Pipeline stage: documents with windows of ``least_items`` benchmark items or more go; one item's passage is enough.

    The column ``contaminated`` of op10_decontamination asks for LEAST_ITEMS different items. Null and empty texts stay, and
    so do all rows where the benchmark is empty. Null and repeated doc_ids are judged row by row.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return kept_rows(docs, lambda d: scan(d, benchmark, least_items=least_items), "NOT contaminated")


ORACLE = r"""
WITH folded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS m, array_to_string(list_slice(w, i, i + least(8, len(w)) - 1), ' ') AS body
  FROM items, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS t(i) WHERE len(w) > 0),
places AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS body
  FROM folded, (SELECT DISTINCT m FROM windows) AS lengths, unnest(range(1, len(w) - m + 2)) AS t(i)),
found AS (SELECT doc_id, item_id, m, i FROM places JOIN windows USING (m, body)),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(0, m)) AS t(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM folded LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
