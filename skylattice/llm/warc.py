"""WARC records in ZIP-packaged archives, written in parallel and read back by byte ranges.

An archive is a ZIP file of stored members: ``archive/data.warc.gz`` with a gzip member per record, and
``indexes/index.cdxj`` with a line per record (key, date, JSON with offset and length). The reader takes the end of
the file, follows the central directory (and the ZIP64 one where numbers don't fit), finds the members' data, reads the
index, and then reads records by range from inside the stored member. Nothing is extracted.

Records with equal payloads: the one with the smallest page_id is a response, the others are revisits of it.

Defined cases: null html is an empty payload; a null url becomes a URN of the page_id. Rows that repeat the smallest
page_id of a payload are all responses. A null page_id is a revisit where any equal payload has a page_id, and a
response otherwise. An empty table writes no archive and gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, open_file, shared_path, write_file

#: Fixed values of the formats.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
NO16, NO32 = 0xFFFF, 0xFFFFFFFF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

#: Payload bytes at which a task begins another archive; bytes that one ranged read fetches at most, single records aside.
ARCHIVE_BYTES, RANGE_BYTES = 32 << 20, 4 << 20


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members. zip64: write ZIP64 fields and directories even where numbers would fit."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, at, sum32 = name.encode(), len(out), zlib.crc32(data)
        wide = zip64 or len(data) >= NO32 or at >= NO32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        size = NO32 if wide else len(data)
        head = struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 0x21, sum32, size, size, len(raw), len(extra))
        out += LOCAL + head + raw + extra + data
        more = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        head = struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, sum32, size, size, len(raw), len(more), 0, 0, 0, 0, NO32 if wide else at)
        central += CENTRAL + head + raw + more
    at, n = len(out), len(members)
    out += central
    wide = zip64 or at >= NO32 or n >= NO16
    if wide:
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(central), at)
        out += LOCATOR64 + struct.pack("<IQI", 0, at + len(central), 1)
    out += END + struct.pack("<HHHHIIH", 0, 0, *(2 * [NO16 if wide else n]), NO32 if wide else len(central), NO32 if wide else at, 0)
    return bytes(out)


class ZipReader:
    """Directory and byte ranges of a seekable ZIP file."""

    def __init__(self, file):
        self.file = file
        self.size = file.seek(0, 2) or file.tell()
        self.members = {m["name"]: m for m in self._directory()}

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _directory(self) -> list[dict]:
        base = max(0, self.size - 65_557)
        tail = self.read(base, self.size - base)
        at = tail.rfind(END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of a central directory")
        _, _, _, n, size, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
        if NO16 == n or NO32 in (size, start):
            locator = self.read(base + at - 20, 20)
            if locator[:4] == LOCATOR64:
                end = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end[:4] != END64:
                    raise ValueError("no end of a ZIP64 central directory")
                n, size, start = struct.unpack_from("<QQQ", end, 32)
        raw, found, at = self.read(start, size), [], 0
        for _ in range(n):
            if raw[at : at + 4] != CENTRAL:
                raise ValueError("damaged central directory")
            flags, method, _, _, sum32, packed, full, a, b, c, _, _, _, offset = struct.unpack_from("<HHHHIIIHHHHHII", raw, at + 8)
            name, extra = raw[at + 46 : at + 46 + a], raw[at + 46 + a : at + 46 + a + b]
            while len(extra) >= 4:
                kind, m = struct.unpack_from("<HH", extra)
                wide, extra = extra[4 : 4 + m], extra[4 + m :]
                if kind == 1:  # the fields that didn't fit, in this order
                    numbers = list(struct.unpack_from(f"<{m // 8}Q", wide))
                    full = numbers.pop(0) if full == NO32 else full
                    packed = numbers.pop(0) if packed == NO32 else packed
                    offset = numbers.pop(0) if offset == NO32 else offset
            found.append({"name": name.decode("utf-8" if flags & 0x800 else "cp437"), "method": method, "crc": sum32, "size": full, "packed": packed, "header": offset})
            at += 46 + a + b + c
        return found

    def start(self, name: str) -> int:
        """Where a stored member's data begins in the file."""
        m = self.members[name]
        if m["method"]:
            raise ValueError(f"{name} is compressed; ranges need a stored member")
        if "start" not in m:
            head = self.read(m["header"], 30)
            if head[:4] != LOCAL:
                raise ValueError("no local header")
            m["start"] = m["header"] + 30 + sum(struct.unpack_from("<HH", head, 26))
        return m["start"]

    def range(self, name: str, offset: int, n: int) -> bytes:
        if offset < 0 or n < 0 or offset + n > self.members[name]["size"]:
            raise ValueError("range outside of the member")
        return self.read(self.start(name) + offset, n)

    def find(self, pattern: str) -> list[str]:
        return [n for n in self.members if re.fullmatch(pattern, n)]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:x-page:{page_id}>"


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A WARC/1.1 response, or a revisit whose block keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = re.sub(r"[\r\n]+", " ", url) if url else _urn(page_id)[1:-1]
    head = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of an unpacked record; header names in lower case."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = lambda ls: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in ls)}
    head = fields(lines[1:])
    block = rest[: int(head["content-length"])]
    if len(block) != int(head["content-length"]):
        raise ValueError("cut record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return head, fields(http.decode("latin-1").split("\r\n")[1:]), payload


def write_archives(pages: DataFrame, folder: str, zip64: bool = True) -> DataFrame:
    """Writes the archives; (path, n_records) of each. pages: page_id, url, html."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("sha"), F.octet_length(html).alias("n"))
    first = rows.groupBy("sha", "n").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, ["sha", "n"], "left").select("page_id", "url", "html", "first")

    def write(batches):
        context, files = TaskContext.get(), 0
        # two attempts may get the rows in other orders: each has files of its own, and the manifest names the right ones
        task = f"{context.partitionId():08d}-{context.taskAttemptId()}"
        data, index, size = bytearray(), [], 0

        def flush():
            nonlocal data, index, size, files
            path = f"{folder}/{task}-{files:05d}.wacz"
            index.sort()
            lines = "".join(f"{key} 19700101000000 {json.dumps(entry)}\n" for key, entry in ((k, {"offset": o, "length": n, "filename": DATA}) for k, o, n in index))
            write_file(path, zip_stored([(DATA, bytes(data)), (INDEX, lines.encode())], zip64))
            row = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64())], names=["path", "n_records"])
            data, index, size, files = bytearray(), [], 0, files + 1
            return row

        for batch in batches:
            for page_id, url, text, one in zip(*(batch.column(k) for k in range(4)), strict=True):
                page_id, url, payload, one = page_id.as_py(), url.as_py(), text.as_py().encode(), one.as_py()
                kind = "response" if one is None or one == page_id else "revisit"
                packed = gzip.compress(record(kind, page_id, url, payload, base32_sha1(payload), one), 1, mtime=0)
                index.append((f"urn:x-page:{page_id}", len(data), len(packed)))
                data += packed
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if index:
            yield flush()

    return rows.mapInArrow(write, "path string, n_records long")


def read_archives(archives: DataFrame, partitions: int) -> DataFrame:
    """A row per record of the archives at ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""

    def number(urn: str) -> int | None:
        value = urn.rpartition(":")[2].rstrip(">")
        return None if value == "None" else int(value)

    def records(path: str):
        with open_file(path) as file:
            packed = ZipReader(file)
            for name in packed.find(r"indexes/.*\.cdxj?"):
                entries = [json.loads(x.split(" ", 2)[2]) for x in packed.range(name, 0, packed.members[name]["size"]).decode().splitlines()]
                entries.sort(key=lambda e: (e["filename"], e["offset"]))
                i = 0
                while i < len(entries):
                    first, j = entries[i], i + 1
                    end = first["offset"] + first["length"]
                    while j < len(entries) and (e := entries[j])["filename"] == first["filename"] and e["offset"] == end and end + e["length"] - first["offset"] <= RANGE_BYTES:
                        end, j = end + e["length"], j + 1
                    raw = packed.range(first["filename"], first["offset"], end - first["offset"])
                    for e in entries[i:j]:
                        at = e["offset"] - first["offset"]
                        yield parse(gzip.decompress(raw[at : at + e["length"]]))
                    i = j

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                for head, http, payload in records(path):
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != int(http["content-length"]) or base32_sha1(payload) != digest):
                        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
                    refers = number(head["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((number(head["warc-record-id"]), int(http["content-length"]), digest, kind, refers, head["warc-target-uri"], payload if kind == "response" else None))
                    size += len(payload)
                    if size >= 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    return archives.select("path").repartition(partitions).mapInArrow(read, schema)


def op8_warc_zip(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = materialise(write_archives(pages, shared_path(spark, "warc")), "warc-manifest")
    found = read_archives(archives, max(1, archives.count()))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
