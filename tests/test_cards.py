import pytest

from skylattice.functions.cards import Header, is_protected, lines_of, parse, typed


@pytest.mark.parametrize(("text", "value"), [("'it''s  '", "it's"), ("''", ""), ("T", True), ("  42", 42), ("-1.5D3", -1500.0), (".5", 0.5), ("(1, -2.0)", 1 - 2j), ("", None), ("what is this", "what is this")])
def test_values(text, value):
    assert typed(text) == value


def test_cards_round_trip():
    h = Header()
    for k, v in {"A": 1, "FLAG": True, "F": 1e-30, "G": 3.0, "S": "O'Hara / x", "Z": 1 + 2j, "N": None}.items():
        h[k] = (v, "about")
    h["a long key"] = 5
    h["LONG"] = "x'" * 100
    h.add_comment("c" * 100)
    h.add_history("made")
    assert all(len(c) == 80 for c in h.cards()) and len(h.to_bytes()) % 2880 == 0
    text = h.to_bytes().decode()
    again = Header.from_lines([text[i : i + 80] for i in range(0, len(text), 80)])
    assert again.items() == h.items()
    assert again["COMMENT"] == ["c" * 72, "c" * 28] and again.comment_of("f") == "about" and again["A LONG KEY"] == 5


def test_edits():
    h = Header(parse([lines_of("EXPTIME", 3, "seconds")[0]]))
    h["exptime"] = 4
    assert h.cards() == [f"{'EXPTIME =                    4 / seconds':<80}"]
    for bad in ("NAXIS", "TTYPE12", "ZCMPTYPE"):
        assert is_protected(bad)
        with pytest.raises(ValueError):
            h[bad] = 1
    assert not is_protected("TTYPE") and not is_protected("MYKEY1")
    with pytest.raises(ValueError):
        h.update({"OK": 1, "BITPIX": 8})
    assert "OK" not in h
    with pytest.raises(RuntimeError), h.edit() as e:
        e["OK"] = 1
        raise RuntimeError
    assert "OK" not in h
    with h.edit() as e:
        e["OK"] = 1
        del e["EXPTIME"]
    assert h.keys() == ["OK"] and h.get("EXPTIME", 7) == 7
    with pytest.raises(KeyError):
        del h["NONE"]
