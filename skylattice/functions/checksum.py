"""DATASUM and CHECKSUM: sums of big-endian 32-bit words with carries added back, on bytes and as SQL aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ONES = 0xFFFFFFFF


def folded(total: int) -> int:
    """A sum of words with its carries added back."""
    return (total - 1) % ONES + 1 if total else 0


def word_sum(data: bytes) -> int:
    """The sum of data whose length is a multiple of four."""
    return folded(int(np.frombuffer(data, ">u4").sum(dtype=np.uint64)) if len(data) < 1 << 33 else sum(int(np.frombuffer(data[i : i + (1 << 30)], ">u4").sum(dtype=np.uint64)) for i in range(0, len(data), 1 << 30)))


def stream_sum(chunks) -> int:
    """The sum of chunks of any lengths as one run of bytes, padded with zeros."""
    total, rest = 0, b""
    for chunk in chunks:
        data = rest + bytes(chunk)
        whole = len(data) & ~3
        total = folded(total + word_sum(data[:whole]))
        rest = data[whole:]
    return folded(total + word_sum(rest + bytes(-len(rest) % 4)))


def encode_checksum(total: int) -> str:
    """16 characters, digits and letters, whose words sum to the complement of ``total``."""
    value = ONES - total
    columns = []
    for shift in (24, 16, 8, 0):
        byte = value >> shift & 0xFF
        four = [byte // 4 + (byte % 4 if k == 0 else 0) + 0x30 for k in range(4)]
        while any(0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 for c in four):
            for k in (0, 2):  # what one gains the other gives
                if any(0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 for c in four[k : k + 2]):
                    four[k] += 1
                    four[k + 1] -= 1
        columns.append(four)
    text = "".join(chr(columns[j][k]) for k in range(4) for j in range(4))
    return text[-1] + text[:-1]


def decode_checksum(text: str) -> int:
    raw = (text[1:] + text[0]).encode()
    return ONES - folded(sum(int.from_bytes(bytes(c - 0x30 for c in raw[i : i + 4]), "big") for i in range(0, 16, 4)))


def verify(header_bytes: bytes, total: int, header) -> tuple[bool | None, bool | None]:
    """(DATASUM holds, CHECKSUM holds), by the data's sum; None where the card is absent."""
    stored = header.get("DATASUM")
    data_ok = None if stored is None else int(str(stored).strip() or 0) == total
    whole = folded(word_sum(header_bytes) + total)
    return data_ok, None if header.get("CHECKSUM") is None else whole in (0, ONES)


def datasum(words: Column) -> Column:
    """DATASUM as an aggregate of words (bigint): partial sums on every task, one number each to shuffle."""
    total = F.sum(words.cast("decimal(38,0)"))
    one = F.lit(1).cast("decimal(38,0)")
    return F.when(F.coalesce(total, one * 0) == 0, F.lit(0).cast("bigint")).otherwise((F.pmod(total - one, F.lit(ONES).cast("decimal(38,0)")) + one).cast("bigint"))
