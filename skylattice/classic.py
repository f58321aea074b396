"""Files opened by the modes of an older FITS library: r, rw, READONLY and READWRITE, and clobber for a new file."""

from __future__ import annotations

import os

from . import api
from .sources import storage

READONLY, READWRITE = 0, 1


def mode_of(path, mode="r", clobber: bool = False) -> str:
    """The mode that api.FITS takes."""
    if isinstance(mode, str) and mode.lower() in ("r+", "w+"):
        return mode.lower()
    if mode in (READONLY, "r", "R", "READONLY"):
        if clobber:
            raise ValueError("clobber= is for writing")
        return "r"
    if mode in (READWRITE, "rw", "RW", "READWRITE"):
        path = storage.coerce(path)
        there = storage.kind_of(path) in ("local", "file") and os.path.exists(storage.from_file_url(path) if storage.kind_of(path) == "file" else path)
        return "r+" if there and not clobber else "w+"
    raise ValueError(f"mode {mode!r} isn't known")


def FITS(spark, filename, mode="r", clobber: bool = False, **more) -> api.FITS:  # noqa: N802  the older library's name
    return api.FITS(spark, filename, mode_of(filename, mode, clobber), **more)


read, read_header, write = api.read, api.read_header, api.write
