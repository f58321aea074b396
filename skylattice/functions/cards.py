"""Header cards of FITS files: parsing, typing, editing and writing, as the FITS standard lays them out."""

from __future__ import annotations

import re
from contextlib import contextmanager

BLOCK, CARD = 2880, 80
COMMENTARY = ("COMMENT", "HISTORY", "")

#: Keywords that describe structure, integrity or compression, alone and with a number.
PROTECTED = frozenset("SIMPLE BITPIX NAXIS EXTEND GROUPS PCOUNT GCOUNT XTENSION TFIELDS THEAP END CHECKSUM DATASUM ZIMAGE ZTABLE ZCMPTYPE ZBITPIX ZNAXIS ZSIMPLE ZEXTEND ZTENSION ZPCOUNT ZGCOUNT ZHECKSUM ZDATASUM ZQUANTIZ ZDITHER0 ZBLANK ZTILELEN ZTHEAP ZBLOCKED ZMASKCMP CONTINUE".split())
PROTECTED_NUMBERED = frozenset("NAXIS TTYPE TFORM TNULL TSCAL TZERO TDIM TBCOL PTYPE PSCAL PZERO ZNAXIS ZTILE ZNAME ZVAL ZFORM ZCTYP".split())

_INT = re.compile(r"[+-]?\d+$")
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([EeDd][+-]?\d+)?$")
_NAME = re.compile(r"[A-Z0-9_-]{1,8}$")


def is_protected(key: str) -> bool:
    """Whether users may not set a keyword, because the writer owns it."""
    name = normal(key)
    m = re.fullmatch(r"([A-Z]+?)(\d+)", name)
    return name in PROTECTED or bool(m and m[1] in PROTECTED_NUMBERED)


def normal(key: str) -> str:
    """A keyword's name for comparison: upper case, single spaces, without HIERARCH."""
    name = " ".join(key.upper().split())
    return name.removeprefix("HIERARCH ") if name.startswith("HIERARCH ") else name


def typed(text: str):
    """A value field's value: str, bool, int, float, complex, None where undefined, else the text itself."""
    text = text.strip()
    if not text:
        return None
    if text in ("T", "F"):
        return text == "T"
    if text[0] == "'":
        return text[1:-1].replace("''", "'").rstrip(" ") if len(text) > 1 else ""
    if _INT.match(text):
        return int(text)
    if _FLOAT.match(text):
        return float(text.upper().replace("D", "E"))
    m = re.fullmatch(r"\(\s*([^,]+?)\s*,\s*([^)]+?)\s*\)", text)
    if m and all(_FLOAT.match(x) or _INT.match(x) for x in m.groups()):
        return complex(*(float(x.upper().replace("D", "E")) for x in m.groups()))
    return text


def divide(field: str) -> tuple[str, str]:
    """(value field, comment): the slash that begins a comment lies outside of a quoted string."""
    s = field.lstrip()
    if s.startswith("'"):
        end = 1
        while end < len(s):
            if s[end] == "'":
                if s[end + 1 : end + 2] != "'":
                    break
                end += 1
            end += 1
        value, rest = s[: end + 1], s[end + 1 :]
        return value, rest.partition("/")[2].strip()
    value, _, comment = s.partition("/")
    return value.strip(), comment.strip()


def spelled(value) -> str:
    """A value as the standard writes it in a value field."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return f"{'T' if value else 'F':>20}"
    if isinstance(value, int):
        return f"{value:>20}"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError("headers hold finite numbers only")
        text = f"{value:.16G}"
        if "E" in text:
            head, _, tail = text.partition("E")
            text = f"{head if '.' in head else head + '.0'}E{tail}"
        elif "." not in text:
            text += ".0"
        return f"{text:>20}"
    if isinstance(value, complex):
        return f"({spelled(value.real).strip()}, {spelled(value.imag).strip()})"
    quoted = str(value).replace("'", "''")
    return f"'{quoted:<8}'"


def lines_of(key: str, value, comment: str = "") -> list[str]:
    """The 80-character cards of one entry: HIERARCH for long names, CONTINUE for long strings."""
    name = normal(key)
    text = spelled(value)
    head = f"{name:<8}= " if _NAME.match(name) else f"HIERARCH {' '.join(key.split()).removeprefix('HIERARCH ')} = "
    whole = head + text + (f" / {comment}" if comment else "")
    if len(whole) <= CARD:
        return [f"{whole:<80}"]
    if len(head + text) <= CARD:
        return [f"{whole[:CARD]:<80}"]
    if not isinstance(value, str):
        raise ValueError(f"{key}: the value doesn't fit a card")
    out, rest = [], str(value).replace("'", "''")
    lead = head
    while True:
        room = CARD - len(lead) - 3
        if len(rest) <= room + 1:
            last = f"{lead}'{rest}'" + (f" / {comment}" if comment else "")
            out.append(f"{last[:CARD]:<80}")
            return out
        cut = room - (1 if rest[:room].count("'") % 2 and rest[room - 1] == "'" and rest[room : room + 1] == "'" else 0)
        out.append(f"{lead}'{rest[:cut]}&'".ljust(CARD))
        rest, lead = rest[cut:], "CONTINUE  "


class Entry:
    """One keyword, with the cards that spell it."""

    def __init__(self, key: str, value, comment: str, lines: list[str]):
        self.key, self.value, self.comment, self.lines = key, value, comment, lines

    @property
    def name(self) -> str:
        return normal(self.key)


def parse(lines: list[str]) -> list[Entry]:
    out: list[Entry] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        name = line[:8].rstrip()
        if name == "END":
            break
        if name in COMMENTARY:
            out.append(Entry(name, line[8:].rstrip(), "", [line]))
            continue
        if name == "HIERARCH" and "=" in line:
            key, _, field = line[9:].partition("=")
            key = " ".join(key.split())
        elif line[8:10] == "= ":
            key, field = name, line[10:]
        elif name == "CONTINUE":
            continue
        else:
            out.append(Entry(name, line[8:].strip() or None, "", [line]))
            continue
        raw, comment = divide(field)
        used, value = [line], typed(raw)
        while isinstance(value, str) and raw.startswith("'") and value.endswith("&") and i < len(lines) and lines[i].startswith("CONTINUE"):
            raw, more = divide(lines[i][8:])
            value = value[:-1] + (raw[1:-1].replace("''", "'").rstrip() if raw.startswith("'") else "")
            comment = " ".join(x for x in (comment, more) if x)
            used.append(lines[i])
            i += 1
        out.append(Entry(key, value, comment, used))
    return out


class Header:
    """An ordered set of keywords; commentary keywords may repeat."""

    def __init__(self, entries: list[Entry] | None = None):
        self.entries = entries or []
        self.version = 0
        self._held: list[Entry] | None = None

    @classmethod
    def from_lines(cls, lines: list[str]) -> Header:
        return cls(parse(lines))

    def _find(self, key: str) -> Entry | None:
        name = normal(key)
        return next((e for e in self.entries if e.name == name and e.key not in COMMENTARY), None)

    def __getitem__(self, key: str):
        name = normal(key)
        if name in COMMENTARY:
            return [e.value for e in self.entries if e.key == name]
        found = self._find(key)
        if found is None:
            raise KeyError(key)
        return found.value

    def get(self, key: str, default=None):
        try:
            return self[key]
        except KeyError:
            return default

    def __contains__(self, key: str) -> bool:
        name = normal(key)
        return any(e.key == name for e in self.entries) if name in COMMENTARY else self._find(key) is not None

    def keys(self) -> list[str]:
        return list(dict.fromkeys(e.key for e in self.entries))

    def __iter__(self):
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self.keys())

    def values(self) -> list:
        return [self[k] for k in self.keys()]

    def items(self) -> list[tuple]:
        return [(k, self[k]) for k in self.keys()]

    def comment_of(self, key: str) -> str:
        found = self._find(key)
        if found is None:
            raise KeyError(key)
        return found.comment

    def cards(self) -> list[str]:
        return [line for e in self.entries for line in e.lines]

    def to_dict(self, skip_protected: bool = False) -> dict:
        return {k: self[k] if k in COMMENTARY else {"value": self[k], "comment": self.comment_of(k)} for k in self.keys() if not (skip_protected and is_protected(k))}

    def put(self, key: str, value, comment: str | None = None) -> None:
        """Set without the check for protected keywords; place, spelling and comment of a known keyword stay."""
        found = self._find(key)
        if found is None:
            name = normal(key)
            new = Entry(name if _NAME.match(name) else " ".join(key.split()), value, comment or "", [])
            new.lines = lines_of(new.key, value, new.comment)
            self.entries.append(new)
        else:
            found.value, found.comment = value, found.comment if comment is None else comment
            found.lines = lines_of(found.key, value, found.comment)
        self.version += 1

    def __setitem__(self, key: str, value) -> None:
        if normal(key) in COMMENTARY:
            raise ValueError("use add_comment, add_history or add_blank")
        if is_protected(key):
            raise ValueError(f"{key} is a protected keyword")
        if isinstance(value, tuple):
            self.put(key, value[0], value[1])
        else:
            self.put(key, value)

    def __delitem__(self, key: str) -> None:
        if is_protected(key):
            raise ValueError(f"{key} is a protected keyword")
        name = normal(key)
        kept = [e for e in self.entries if (e.key if name in COMMENTARY else e.name) != name]
        if len(kept) == len(self.entries):
            raise KeyError(key)
        self.entries = kept
        self.version += 1

    def drop(self, *keys: str) -> None:
        names = {normal(k) for k in keys}
        self.entries = [e for e in self.entries if e.key in COMMENTARY or e.name not in names]
        self.version += 1

    def set_comment(self, key: str, text: str) -> None:
        if normal(key) in COMMENTARY or is_protected(key):
            raise ValueError(f"{key} takes no comment")
        found = self._find(key)
        if found is None:
            raise KeyError(key)
        if found.value is None:
            raise ValueError(f"{key} is undefined")
        self.put(key, found.value, text)

    def _commentary(self, name: str, text: str) -> None:
        if not text.isascii() or not text.isprintable():
            raise ValueError("commentary is printable ASCII")
        for i in range(0, max(1, len(text)), 72):
            part = text[i : i + 72]
            self.entries.append(Entry(name, part.rstrip(), "", [f"{name:<8}{part:<72}"]))
        self.version += 1

    def add_comment(self, text: str) -> None:
        self._commentary("COMMENT", text)

    def add_history(self, text: str) -> None:
        self._commentary("HISTORY", text)

    def add_blank(self, text: str = "") -> None:
        self._commentary("", text)

    def update(self, other, copy_commentary: bool = False) -> None:
        """From a Header, protected keywords are passed over; in a mapping they are an error, before anything is set."""
        if isinstance(other, Header):
            for e in other.entries:
                if e.key in COMMENTARY:
                    if copy_commentary:
                        self._commentary(e.key, e.value)
                elif not is_protected(e.key):
                    self.put(e.key, e.value, e.comment)
            return
        bad = [k for k in other if is_protected(k)]
        if bad:
            raise ValueError(f"protected keywords: {', '.join(bad)}")
        for k, v in other.items():
            self[k] = v

    @contextmanager
    def edit(self):
        """Edits that all count on leaving, or none where an exception leaves."""
        draft = Header([Entry(e.key, e.value, e.comment, list(e.lines)) for e in self.entries])
        yield draft
        self.entries, self.version = draft.entries, self.version + 1

    def copy(self) -> Header:
        return Header([Entry(e.key, e.value, e.comment, list(e.lines)) for e in self.entries])

    def to_bytes(self) -> bytes:
        raw = "".join(self.cards() + ["END".ljust(CARD)]).encode("ascii")
        return raw + b" " * (-len(raw) % BLOCK)

    def __repr__(self) -> str:
        return "\n".join(x.rstrip() for x in self.cards())
