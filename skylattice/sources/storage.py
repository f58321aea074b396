"""Places of FITS bytes: local and shared paths, file URLs, memory, gzip files, and HTTP with byte ranges."""

from __future__ import annotations

import gzip
import io
import os
import uuid
from collections import OrderedDict
from urllib.parse import unquote_to_bytes, urlsplit

#: Files in memory, by name; ``mem://`` names live as long as the process.
_memory: dict[str, bytes] = {}


class Remote:
    """How remote files are read: whole, or by ranges with a cache of blocks."""

    def __init__(self, *, ranged: bool = False, headers: dict | None = None, timeout: float | None = None, block_bytes: int = 1 << 20, cache_bytes: int = 32 << 20):
        if block_bytes <= 0 or cache_bytes < block_bytes:
            raise ValueError("block_bytes must be positive and cache_bytes at least as large")
        self.ranged, self.headers, self.timeout, self.block_bytes, self.cache_bytes = ranged, dict(headers or {}), timeout, block_bytes, cache_bytes

    def to_json(self) -> str:
        """All settings as text, which an option of a scan carries to executors."""
        import json

        return json.dumps({k: getattr(self, k) for k in ("ranged", "headers", "timeout", "block_bytes", "cache_bytes")})

    @classmethod
    def of(cls, given) -> Remote | None:
        """From a Remote, its JSON, or the word ranged."""
        import json

        if given is None or isinstance(given, Remote):
            return given
        return cls(ranged=True) if given == "ranged" else cls(**json.loads(given))

    def __repr__(self) -> str:
        return f"Remote(ranged={self.ranged}, timeout={self.timeout}, block_bytes={self.block_bytes}, cache_bytes={self.cache_bytes})"


def from_file_url(url: str) -> str:
    """The path of a file URL: host empty or localhost, percent escapes decoded."""
    parts = urlsplit(url)
    if parts.netloc.lower() not in ("", "localhost"):
        raise ValueError(f"file URL with a host: {url}")
    import re

    if re.search(r"%(?![0-9A-Fa-f]{2})", parts.path):
        raise ValueError(f"bad escape in {url}")
    return unquote_to_bytes(parts.path).decode()


class RangeReader(io.RawIOBase):
    """A seekable reader of an HTTP resource: missing blocks of a read come in as few requests as there are gaps."""

    def __init__(self, url: str, remote: Remote):
        self.url, self.remote, self.at, self.blocks = url, remote, 0, OrderedDict()
        status, headers, _ = self._fetch(0, 0)
        size = headers.get("Content-Range", "").rpartition("/")[2]
        if status != 206 or not size.isdigit():
            raise OSError(f"{url}: the server doesn't serve ranges")
        self.size = int(size)

    def _fetch(self, lo: int, hi: int):
        from urllib.request import Request, urlopen

        request = Request(self.url, headers=self.remote.headers | {"Range": f"bytes={lo}-{hi}"})
        with urlopen(request, timeout=self.remote.timeout) as answer:
            return answer.status, answer.headers, answer.read()

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, (0, self.at, self.size)[whence] + offset)
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        hi = self.size if n is None or n < 0 else min(self.size, self.at + n)
        if hi <= self.at:
            return b""
        step = self.remote.block_bytes
        wanted = range(self.at // step, (hi - 1) // step + 1)
        got = {b: self.blocks[b] for b in wanted if b in self.blocks}
        gap: list[int] = []
        for b in [*wanted, None]:
            if b is not None and b not in got:
                gap.append(b)
            elif gap:
                lo = gap[0] * step
                raw = self._fetch(lo, min(self.size, (gap[-1] + 1) * step) - 1)[2]
                got |= {g: raw[(g - gap[0]) * step : (g - gap[0] + 1) * step] for g in gap}
                gap = []
        for b in wanted:
            self.blocks[b] = got[b]
            self.blocks.move_to_end(b)
        while len(self.blocks) * step > self.remote.cache_bytes and len(self.blocks) > 1:
            self.blocks.popitem(last=False)
        raw = b"".join(got[b] for b in wanted)[self.at - wanted[0] * step : hi - wanted[0] * step]
        self.at = hi
        return raw


def coerce(path) -> str:
    path = os.fspath(path)
    return path.decode() if isinstance(path, bytes) else path


def kind_of(path: str) -> str:
    low = path.lower()
    for kind, heads in (("memory", ("mem://", "memkeep://")), ("http", ("http://", "https://")), ("ftp", ("ftp://", "ftps://")), ("file", ("file:",))):
        if low.startswith(heads):
            return kind
    return "shared" if "://" in path else "local"


def is_gzip(path: str) -> bool:
    return urlsplit(path).path.lower().endswith(".gz") if "://" in path else path.lower().endswith(".gz")


def open_read(path: str, remote: Remote | str | None = None):
    """A seekable binary reader, on the driver or an executor."""
    remote = Remote.of(remote)
    kind = kind_of(path)
    if remote is not None and kind != "http":
        raise ValueError("remote= is for http URLs")
    if kind == "http":
        if remote is not None and remote.ranged:
            if is_gzip(path):
                raise ValueError("a gzip file has no useful ranges")
            return RangeReader(path, remote)
        from urllib.request import Request, urlopen

        with urlopen(Request(path, headers=remote.headers if remote else {}), timeout=remote.timeout if remote else None) as answer:
            raw = answer.read()
    elif kind == "ftp":
        raw = ftp_bytes(path)
    elif kind == "memory":
        raw = _memory.get(path.replace("memkeep://", "mem://", 1), b"")
    elif kind == "shared":
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        if not is_gzip(path):
            return where.open_input_file(name)
        with where.open_input_stream(name, compression=None) as f:
            raw = f.read()
    else:
        name = from_file_url(path) if kind == "file" else path
        if not is_gzip(path):
            return open(name, "rb")
        with open(name, "rb") as f:
            raw = f.read()
    return io.BytesIO(gzip.decompress(raw) if is_gzip(path) and raw else raw)


def ftp_bytes(path: str) -> bytes:
    """A file by FTP, or by FTP over TLS with a protected data connection for ftps."""
    import ftplib

    at = urlsplit(path)
    out: list[bytes] = []
    with (ftplib.FTP_TLS if at.scheme.lower() == "ftps" else ftplib.FTP)() as ftp:
        ftp.connect(at.hostname or "", at.port or 21)
        ftp.login(unquote_to_bytes(at.username or "anonymous").decode(), unquote_to_bytes(at.password or "").decode())
        if isinstance(ftp, ftplib.FTP_TLS):
            ftp.prot_p()
        ftp.retrbinary("RETR " + unquote_to_bytes(at.path.lstrip("/")).decode(), out.append)
    return b"".join(out)


def write_bytes(path: str, chunks) -> None:
    """Write chunks of bytes under another name, then rename; gzip by suffix."""
    kind = kind_of(path)
    if kind in ("http", "ftp"):
        raise OSError("remote files are read-only")
    if kind == "memory":
        _memory[path.replace("memkeep://", "mem://", 1)] = b"".join(chunks)
        return
    if is_gzip(path):
        chunks = [gzip.compress(b"".join(chunks), mtime=0)]
    if kind == "shared":
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        where.create_dir(os.path.dirname(name), recursive=True)
        part = f"{name}.{uuid.uuid4().hex}.part"
        with where.open_output_stream(part) as out:
            for c in chunks:
                out.write(c)
        where.move(part, name)
        return
    name = from_file_url(path) if kind == "file" else path
    os.makedirs(os.path.dirname(os.path.abspath(name)), exist_ok=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as out:
        for c in chunks:
            out.write(c)
    os.replace(part, name)


def ranges(path: str, lo: int, hi: int, step: int = 16 << 20):
    """Bytes lo .. hi - 1 of a file, some at a time."""
    with open_read(path) as f:
        f.seek(lo)
        while lo < hi:
            data = f.read(min(step, hi - lo))
            if not data:
                raise OSError(f"{path} ends before byte {hi}")
            yield data
            lo += len(data)


def open_write(path: str):
    """A new file for bytes one after another; its name is the writer's own, so nothing else writes it."""
    if kind_of(path) == "shared":
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        where.create_dir(os.path.dirname(name), recursive=True)
        return where.open_output_stream(name)
    name = from_file_url(path) if kind_of(path) == "file" else path
    os.makedirs(os.path.dirname(os.path.abspath(name)), exist_ok=True)
    return open(name, "wb")


def move(source: str, target: str) -> None:
    """Rename within one store."""
    if kind_of(source) == "shared":
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(source)
        new = fs.FileSystem.from_uri(target)[1]
        where.create_dir(os.path.dirname(new), recursive=True)
        where.move(name, new)
        return
    source, target = (from_file_url(x) if kind_of(x) == "file" else x for x in (source, target))
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    os.replace(source, target)


def size_of(path: str) -> int:
    with open_read(path) as f:
        return f.seek(0, 2) or f.tell()


def remove(path: str) -> None:
    kind = kind_of(path)
    if kind == "memory":
        _memory.pop(path.replace("memkeep://", "mem://", 1), None)
    elif kind == "shared":
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        where.delete_file(name)
    else:
        os.remove(from_file_url(path) if kind == "file" else path)


def remove_folder(path: str) -> None:
    """A folder with all that is in it, where it is there."""
    if kind_of(path) == "shared":
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        if where.get_file_info(name).type == fs.FileType.Directory:
            where.delete_dir(name)
        return
    import shutil

    shutil.rmtree(from_file_url(path) if kind_of(path) == "file" else path, ignore_errors=True)


def spool(path: str, folder: str) -> str:
    """A file in memory as one in a folder that workers see too, named by its bytes; any other path as it is."""
    if kind_of(path) != "memory":
        return path
    import hashlib

    data = _memory.get(path.replace("memkeep://", "mem://", 1), b"")
    target = f"{folder.rstrip('/')}/{hashlib.sha256(data).hexdigest()}.fits"
    try:
        known = size_of(target) == len(data)
    except OSError:
        known = False
    if not known:
        write_bytes(target, [gunzipped(path, data)])
    return target


def gunzipped(path: str, data: bytes) -> bytes:
    return gzip.decompress(data) if is_gzip(path) and data else data


def paths_of(path: str) -> list[str]:
    """The FITS files of a path: itself, or those in it where it is a folder, by name."""
    kind = kind_of(path)
    if kind in ("local", "file"):
        name = from_file_url(path) if kind == "file" else path
        if os.path.isdir(name):
            return sorted(os.path.join(name, x) for x in os.listdir(name) if x.lower().endswith((".fits", ".fits.gz", ".fit")))
    elif kind == "shared":
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        if where.get_file_info(name).type == fs.FileType.Directory:
            head = path[: len(path) - len(name)] if path.endswith(name) else path.split("://")[0] + "://"
            return sorted(head + x.path for x in where.get_file_info(fs.FileSelector(name)) if x.path.lower().endswith((".fits", ".fits.gz", ".fit")))
    return [path]
