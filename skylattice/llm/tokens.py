"""Token ids of whole texts by a public byte-level BPE, with the work on repeated pieces of text done once.

A text is cut only where the tokenizer's own splitting always ends a word, so pieces encode alone as they do in
place. Each distinct piece goes through the ``tokenizers`` library; a bounded table keeps the ids of pieces that
were seen, and a batch of texts becomes ids by array operations.
"""

from __future__ import annotations

import zlib

import numpy as np

from .common import segments
from .hashing import BLOCK, hash_block

#: Fixed values. Byte classes for cutting; lead bytes that may begin a white-space character.
SPACE, NEWLINE, LETTER, MARK, OTHER, HIGH, UNSAFE = 1, 2, 3, 4, 5, 6, 7
LEADS_OF_SPACES = (0xC2, 0xE1, 0xE2, 0xE3)


def _classes() -> np.ndarray:
    out = np.full(256, UNSAFE, np.uint8)
    for b in range(0x21, 0x7F):
        out[b] = LETTER if chr(b).isalpha() else OTHER if chr(b).isdigit() or chr(b) == "'" else MARK
    out[0x80:] = HIGH
    out[list(LEADS_OF_SPACES)] = UNSAFE
    out[0x20], out[0x0A] = SPACE, NEWLINE
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces: each text's start, and the places where a byte-level BPE's splitting always cuts.

    These are: before a space that a visible character follows; between an ASCII letter and an ASCII mark other than
    the apostrophe; on both sides of a line end alone between visible characters.
    """
    n = len(data)
    kind = _classes()[data]
    ascii_seen = (kind == LETTER) | (kind == MARK) | (kind == OTHER)
    seen = ascii_seen | (kind == HIGH)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        cut[: n - 1] |= (kind[:-1] == SPACE) & seen[1:]
        cut[1:n] |= (kind[1:] == MARK) & (kind[:-1] == LETTER)
        alone = (kind[1:-1] == NEWLINE) & ascii_seen[:-2] & seen[2:]
        cut[1 : n - 1] |= alone
        cut[2:n] |= alone
    cut[offsets[:-1]] = True
    cut[n] = False
    return np.flatnonzero(cut)


class Encoder:
    """Encodes batches of UTF-8 texts. ``slots`` bounds the table of pieces seen, ``arena`` the ids it keeps."""

    def __init__(self, path: str, slots: int = 1 << 20, arena: int = 1 << 23):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.mask, self.room = np.uint64(slots - 1), arena
        self._clear(slots)

    def _clear(self, slots: int) -> None:
        self.key = np.zeros((2, slots), np.uint64)
        self.at, self.n = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        self.ids, self.used = np.zeros(min(self.room, 1 << 20), np.uint32), 0

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids by piece). Pieces without a line end or outer white space share calls, with line ends between."""
        from itertools import chain

        texts = [p.decode("utf-8", "replace") for p in pieces]
        plain = [i for i, t in enumerate(texts) if not t[-1].isspace() and "\n" not in t and (not t[0].isspace() or t[0] == " " and not t[1].isspace())]
        order, flat, sizes, line = [], [], [], self.newline[0] if len(self.newline) == 1 else -1
        runs = [plain[i : i + 256] for i in range(0, len(plain), 256)] if line >= 0 else []
        joined = ["\n".join([texts[i] for i in run]) + "\n" for run in runs]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        good = [ids.count(line) == len(run) for run, ids in zip(runs, found, strict=True)]
        if any(good):
            order = [i for run, ok in zip(runs, good, strict=True) if ok for i in run]
            together = np.fromiter(chain.from_iterable(ids for ids, ok in zip(found, good, strict=True) if ok), np.uint32)
            ends = np.flatnonzero(together == line)
            sizes.append(np.diff(ends, prepend=-1) - 1)
            flat.append(together[together != line])
        done = set(order)
        rest = [i for i in range(len(texts)) if i not in done]
        if rest:
            one = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)]
            order += rest
            sizes.append(np.array([len(x) for x in one], np.int64))
            flat.append(np.fromiter(chain.from_iterable(one), np.uint32))
        ids, n, order = np.concatenate(flat), np.concatenate(sizes), np.array(order)
        starts, out = np.cumsum(n) - n, np.empty(len(n), np.int64)
        out[order] = starts
        size = np.empty(len(n), np.int64)
        size[order] = n
        return ids[segments(size, out)], size

    def _block(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids by piece) of consecutive pieces that cover ``data``."""
        ends = np.append(starts[1:], len(data))
        h, g = hash_block(data, starts, ends)  # 0 marks an empty slot
        first, second = (h >> np.uint64(20)) & self.mask, (g >> np.uint64(20)) & self.mask
        slot = np.where((self.key[0, first] == h) & (self.key[1, first] == g), first, second).astype(np.int64)
        missed = np.flatnonzero((self.key[0, slot] != h) | (self.key[1, slot] != g))
        n, at = self.n[slot], self.at[slot]
        source = self.ids
        if len(missed):
            _, one, back = np.unique(h[missed] ^ (g[missed] * np.uint64(3)), return_index=True, return_inverse=True)
            new = missed[one]
            raw = data.tobytes()
            flat, sizes = self._encode_pieces([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            upto = self.used + len(flat)
            if self.used < upto <= self.room:
                if upto > len(self.ids):
                    self.ids = np.concatenate([self.ids[: self.used], np.empty(min(self.room, 2 * upto) - self.used, np.uint32)])
                self.ids[self.used : upto] = flat
                source = self.ids
            else:
                source = np.concatenate([self.ids[: self.used], flat])
            places = self.used + np.cumsum(sizes) - sizes
            n[missed], at[missed] = sizes[back], places[back]
            if upto <= self.room:
                free = self.key[0, first[new].astype(np.int64)] == 0
                where = np.where(free, first[new], second[new]).astype(np.int64)
                self.key[0, where], self.key[1, where] = h[new], g[new]
                self.at[where], self.n[where] = places, sizes
                # of two new pieces in one slot the last written stays, as for each array alike
                self.used = upto
            else:
                self._clear(len(self.at))
        return source[segments(n, at)], n

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of texts in them). data, offsets: UTF-8 bytes of all texts, as of ``byte_rows``."""
        count = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(count + 1, np.int64)
        whole = []
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            whole = [i for i in range(count) if any(s in raw[offsets[i] : offsets[i + 1]] for s in self.special)]
        del raw
        filled = offsets[:-1] < offsets[1:]
        begin = cuts(data, np.append(offsets[:-1][filled], len(data)))
        ids, sizes, i = [], [], 0
        while i < len(begin):  # whole pieces, BLOCK bytes at most
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + BLOCK, "right")) - 1)
            if j == len(begin) - 1 and len(data) - begin[i] <= BLOCK:
                j += 1
            lo, hi = int(begin[i]), int(begin[j]) if j < len(begin) else len(data)
            if hi - lo > BLOCK:
                found = np.array(self.tokenizer.encode(data[lo:hi].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                n = np.array([len(found)])
            else:
                found, n = self._block(data[lo:hi], begin[i:j] - lo)
            ids.append(found)
            sizes.append(n)
            i = j
        flat, n = np.concatenate(ids), np.concatenate(sizes)
        upto = np.concatenate([[0], np.cumsum(n)])
        out = upto[np.searchsorted(begin, offsets)]
        out[-1] = upto[-1]
        if whole:
            parts = [flat[a:b] for a, b in zip(out[:-1], out[1:], strict=True)]
            for k in whole:
                text = data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
                parts[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            flat = np.concatenate(parts)
            out = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return flat, out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder; it is kept between tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def default_vocabulary() -> str:
    """The public byte-level BPE's file; any other path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
