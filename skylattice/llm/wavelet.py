"""Token ids in binary shards: a wavelet matrix per shard.

A shard holds the ids of consecutive documents as bit-planes, from the highest bit to the lowest. Each plane is stably
parted by its bit before the next plane is taken, so rank and select in the planes answer access to a token, counts
and places of a token from the one compressed file, without other indexes. Planes are stored in blocks of bits, each on
its own, with the set bits before each block: rank is a number of the directory and a popcount inside one block, select a
binary search in the directory and a scan of one block. A lookup reads a block or two of each plane by range, not the
shard. The file, little-endian:

    "SWM2", u8 planes, u8 null doc_ids, u64 ids, u64 documents
    u64 offset and size of a zstandard frame each of: doc_ids (i64), null flags, document ends (u64); size 0 where there is none
    per plane: u64 unset bits; per block of it: u64 offset, u64 set bits before it; at last u64 the file's size
    frames, then blocks: bits, most significant first in each byte, as a zstandard frame where that is smaller

Defined cases: null text is empty and holds the end id alone. Null doc_ids come first. Repeated doc_ids keep all
their rows, in the order of their texts' hashes. doc_ids are whole numbers, or text of them; other text stops the job. Texts
of any length are held whole. An empty table writes no shard and gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, give_back, materialise, open_file, shared_path, write_file
from .tokens import crc, default_vocabulary, encoder

END = 0
#: Bytes of text in a shard on average, and ids at which a task begins another shard.
SHARD_BYTES, SHARD_IDS = 32 << 20, 16_000_000
#: Ids that are parted at once.
STRETCH = 1 << 15
#: Bits of a block: 8 KiB.
BLOCK_BITS = 1 << 16
#: Logarithm of the partitions in a run, whose sizes are summed together.
RUN_BITS = 10
MAGIC, HEAD = b"SWM2", struct.Struct("<4sBBQQ")


def planes_of(ids: np.ndarray, bits: int):
    """(unset bits, packed bits) of each plane of a wavelet matrix, from the highest bit to the lowest. Stretches at a time stay in the cache."""
    kind, n = kind_of(bits), len(ids)
    now, other = ids.astype(kind, copy=False), np.empty(n, kind)
    for b in range(bits - 1, -1, -1):
        bit = (now & kind(1 << b)).astype(bool)
        packed = np.packbits(bit)
        zeros = n - int(np.bitwise_count(packed).sum())
        lo, hi = 0, zeros
        for at in range(0, n, STRETCH):
            part, one = now[at : at + STRETCH], bit[at : at + STRETCH]
            low, high = part.compress(~one), part.compress(one)
            other[lo : lo + len(low)], other[hi : hi + len(high)] = low, high
            lo, hi = lo + len(low), hi + len(high)
        yield zeros, packed
        now, other = other, np.empty(n, kind) if now is ids else now


def kind_of(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint32


def to_bytes(ids: np.ndarray, bits: int, doc_ids: np.ndarray, missing: np.ndarray, ends: np.ndarray) -> bytes:
    """A shard's file."""
    return b"".join(parts_of(ids, bits, doc_ids, missing, ends))


def parts_of(ids: np.ndarray, bits: int, doc_ids: np.ndarray, missing: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """A shard's file, in parts that follow one another."""
    pack = zstandard.ZstdCompressor(level=1).compress
    n_blocks = -(-len(ids) // BLOCK_BITS)
    at = HEAD.size + 48 + bits * (8 + 16 * n_blocks) + 8
    directory, body = [], []
    for raw in (doc_ids.astype("<i8").tobytes(), np.packbits(missing).tobytes() if missing.any() else b"", ends.astype("<u8").tobytes()):
        frame = pack(raw) if raw else b""
        directory.append(struct.pack("<QQ", at, len(frame)))
        body.append(frame)
        at += len(frame)
    for zeros, plane in planes_of(ids, bits):
        directory.append(struct.pack("<Q", zeros))
        ones = 0
        for lo in range(0, len(plane), BLOCK_BITS // 8):
            block = plane[lo : lo + BLOCK_BITS // 8]
            frame = pack(block.tobytes())
            frame = frame if len(frame) < len(block) else block.tobytes()
            directory.append(struct.pack("<QQ", at, ones))
            body.append(frame)
            at += len(frame)
            ones += int(np.bitwise_count(block).sum())
    directory.append(struct.pack("<Q", at))
    return [HEAD.pack(MAGIC, bits, bool(missing.any()), len(ids), len(doc_ids)) + b"".join(directory), *body]


class Shard:
    """A shard in a seekable file. Opening it reads the directory; a lookup reads the blocks that it needs, by range.

    ``kept`` blocks stay decoded. bits, n and n_docs as in the file's head.
    """

    def __init__(self, file, kept: int = 256):
        self.file, self.kept, self.cache = file, kept, OrderedDict()
        head = self._read(0, HEAD.size)
        if len(head) < HEAD.size or head[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        _, self.bits, self.nulls, self.n, self.n_docs = HEAD.unpack(head)
        n_blocks = -(-self.n // BLOCK_BITS)
        words = np.frombuffer(self._read(HEAD.size, 48 + self.bits * (8 + 16 * n_blocks) + 8), "<u8").astype(np.int64)
        self.frames = words[:6].reshape(3, 2)
        planes = words[6:-1].reshape(self.bits, 1 + 2 * n_blocks)
        self.zeros = planes[:, 0]
        #: Set bits before each block, and at the end; where each block begins in the file, and the last one ends.
        self.ranks = np.concatenate([planes[:, 2::2], (self.n - self.zeros)[:, None]], axis=1)
        starts = np.append(planes[:, 1::2].reshape(-1), words[-1])
        self.starts, self.n_blocks = starts, n_blocks

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _frame(self, k: int) -> bytes:
        at, n = self.frames[k].tolist()
        return zstandard.ZstdDecompressor().decompress(self._read(at, n)) if n else b""

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc_ids, null flags, ends of documents)."""
        missing = np.unpackbits(np.frombuffer(self._frame(1), np.uint8), count=self.n_docs).astype(bool) if self.nulls else np.zeros(self.n_docs, bool)
        return np.frombuffer(self._frame(0), "<i8"), missing, np.frombuffer(self._frame(2), "<u8").astype(np.int64)

    def _unpack(self, raw: bytes, b: int) -> np.ndarray:
        size = min(BLOCK_BITS, self.n - b * BLOCK_BITS) + 7 >> 3
        return np.frombuffer(raw if len(raw) == size else zstandard.ZstdDecompressor().decompress(raw), np.uint8)

    def block(self, plane: int, b: int) -> np.ndarray:
        """The packed bits of a block."""
        k = plane * self.n_blocks + b
        if k not in self.cache:
            at, stop = self.starts[k : k + 2].tolist()
            self.cache[k] = self._unpack(self._read(at, stop - at), b)
            if len(self.cache) > self.kept:
                self.cache.popitem(last=False)
        self.cache.move_to_end(k)
        return self.cache[k]

    def plane(self, plane: int) -> np.ndarray:
        """All bits of a plane, by one read."""
        k = plane * self.n_blocks
        at = self.starts[k : k + self.n_blocks + 1]
        raw = self._read(int(at[0]), int(at[-1] - at[0]))
        at = (at - at[0]).tolist()
        parts = [self._unpack(raw[at[b] : at[b + 1]], b) for b in range(self.n_blocks)]
        return np.unpackbits(np.concatenate(parts), count=self.n).view(bool) if parts else np.zeros(0, bool)

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane back to the first order, with one plane unpacked at a time."""
        kind = kind_of(self.bits)
        now, before = np.zeros(self.n, kind), np.empty(self.n, kind)
        for b in range(self.bits):
            bit, lo, hi = self.plane(self.bits - 1 - b), 0, int(self.zeros[self.bits - 1 - b])
            now[hi:] |= kind(1 << b)
            for at in range(0, self.n, STRETCH):
                part, one = before[at : at + STRETCH], bit[at : at + STRETCH]
                ones = np.flatnonzero(one)
                n = len(one) - len(ones)
                part[np.flatnonzero(~one)], part[ones] = now[lo : lo + n], now[hi : hi + len(ones)]
                lo, hi = lo + n, hi + len(ones)
            now, before = before, now
        return now

    def rank(self, plane: int, i: int) -> int:
        """Set bits among the first i of a plane: the directory's count before the block, and a popcount inside it."""
        b, rest = divmod(i, BLOCK_BITS)
        found = int(self.ranks[plane, b]) if b < self.n_blocks else self.n - int(self.zeros[plane])
        if rest:
            bits = self.block(plane, b)
            found += int(np.bitwise_count(bits[: rest >> 3]).sum())
            if rest & 7:
                found += int(bits[rest >> 3] >> (8 - (rest & 7))).bit_count()
        return found

    def selected(self, plane: int, one: int, wanted: np.ndarray) -> np.ndarray:
        """Places of set (or unset) bits number ``wanted`` (ascending, from 0) in a plane, block by block."""
        before = self.ranks[plane] if one else np.append(np.arange(self.n_blocks) * BLOCK_BITS, self.n) - self.ranks[plane]
        in_block = np.searchsorted(before, wanted, "right") - 1
        out = np.empty(len(wanted), np.int64)
        for b in np.unique(in_block).tolist():
            here = in_block == b
            bits = np.unpackbits(self.block(plane, b), count=min(BLOCK_BITS, self.n - b * BLOCK_BITS))
            out[here] = b * BLOCK_BITS + np.flatnonzero(bits == one)[wanted[here] - before[b]]
        return out

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(f"place {i} of {self.n}")
        value = 0
        for k in range(self.bits):
            one = int(self.block(k, i // BLOCK_BITS)[i % BLOCK_BITS >> 3]) >> (7 - (i & 7)) & 1
            up = self.rank(k, i)
            value = value << 1 | one
            i = int(self.zeros[k]) + up if one else i - up
        return value

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            a, b = self.rank(k, lo), self.rank(k, hi)
            z = int(self.zeros[k])
            lo, hi = (z + a, z + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token occurs in places lo .. hi - 1."""
        a, b = self._span(token, lo, self.n if hi is None else hi)
        return b - a

    def _up(self, token: int, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - k) & 1
            at = self.selected(k, one, at - int(self.zeros[k]) if one else at)
        return at

    def select(self, token: int, k: int) -> int:
        """The place of a token's occurrence number k, from 0; -1 if there are fewer."""
        a, b = self._span(token, 0, self.n)
        return int(self._up(token, np.array([a + k]))[0]) if 0 <= k < b - a else -1

    def places(self, token: int) -> np.ndarray:
        """All places of a token in ascending order: its span in the last plane, selected upwards."""
        a, b = self._span(token, 0, self.n)
        return self._up(token, np.arange(a, b))


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Writes the shards; (part long, path, n_docs, n_ids) of each, in ascending doc_id order by ``part``."""
    vocabulary = vocabulary or default_vocabulary()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))

    def write(batches):
        give_back()  # what other steps left in this worker
        tool, shard = encoder(vocabulary), TaskContext.get().partitionId()
        bits = max(1, int(tool.tokenizer.get_vocab_size() - 1).bit_length(), int(end).bit_length())
        kept: list[tuple] = []
        n = files = 0

        def flush():
            nonlocal kept, n, files
            ids, doc_ids, missing, sizes = (np.concatenate([x[k] for x in kept]) for k in range(4))
            kept = []
            path = f"{folder}/{shard:08d}-{files:05d}.swm"
            write_file(path, parts_of(ids, bits, doc_ids, missing, np.cumsum(sizes)))
            row = pa.RecordBatch.from_arrays([pa.array([shard << 20 | files]), pa.array([path]), pa.array([len(doc_ids)]), pa.array([len(ids)])], names=["part", "path", "n_docs", "n_ids"])
            n, files = 0, files + 1
            return row

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                flat, offsets = tool.encode(*byte_rows(part.column(1)))
                ids = np.insert(flat.astype(kind_of(bits)), offsets[1:], end)
                missing = np.asarray(part.column(0).is_null())
                kept.append((ids, part.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), missing, np.diff(offsets) + 1))
                n += len(ids)
                del flat, ids
                if n >= SHARD_IDS:
                    row = flush()
                    give_back()
                    yield row
        if kept:
            batch = part = None  # texts that are encoded
            row = flush()
            give_back()
            yield row

    dealt = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(write, "part long, path string, n_docs long, n_ids long")


def read_shards(manifest: DataFrame, shards: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards' bit-planes."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(path) as f:
                    shard = Shard(f)
                    doc_ids, missing, ends = shard.documents()
                    ids = shard.ids()
                starts = np.concatenate([[0], ends[:-1]])
                sums = [crc(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                del ids, shard
                give_back()
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=missing), pa.array(base + starts), pa.array(ends - starts), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("path", "base").repartition(shards).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, vocabulary: str | None = None, end: int = END, folder: str | None = None) -> DataFrame:
    """The manifest of freshly written shards, with ``base``: ids in all shards before."""
    spark = docs.sparkSession
    manifest = materialise(write_shards(docs, folder or shared_path(spark, "wavelet"), vocabulary, end), "wavelet-manifest")
    # sums in two steps: of runs of shards one after another, a short row for each run; then inside each run
    manifest = manifest.withColumn("run", F.shiftright("part", 20 + RUN_BITS))
    upto = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = manifest.groupBy("run").agg(F.sum("n_ids").alias("n_ids"))
    runs = runs.select("run", upto(Window.orderBy("run")).alias("base"))
    inside = manifest.withColumn("inside", upto(Window.partitionBy("run").orderBy("part")))
    return inside.join(runs, "run").select(*(c for c in manifest.columns if c != "run"), (F.col("base") + F.col("inside")).alias("base"))


def op7_wavelet_tokens(spark, sf_dir: str) -> DataFrame:
    manifest = store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_shards(manifest, max(1, manifest.count()))
