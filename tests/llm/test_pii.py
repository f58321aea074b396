import random
import re

import pytest

from skylattice.llm import pii

SCHEMA = "doc_id long, text string, surrogates string, place string, kind string"
TEXTS = [
    (1, "Mrs. Anna Kowalska met Mr. Smith at bob.K@Mail7.example.com and BOB.k@mail7.example.com."),
    (2, "call +1 (377) 555-0271 or +1 377 555 0271, ip 10.1.2.3, card 4111111111111111 or 4111-1111-1111-1111, ssn 123-45-6789"),
    (3, "Ms. ANNA KOWALSKA; Госпожа Анна Петрова. Κύριος Νίκος Παππάς"),
    (4, None),
    (5, ""),
    (6, "nothing here, version 1.2.3.4.5 and 12345"),
    (None, "to z@q.io, from z@q.io"),
    (6, "nothing here, version 1.2.3.4.5 and 12345"),
    (7, "z@q.io"),
    (7, "z@q.io"),
    (8, "long " * 100_000 + "z@q.io"),
]


@pytest.fixture(scope="module")
def done(spark):
    df = spark.createDataFrame([(d, t, "c", "c", "c") for d, t in TEXTS], SCHEMA)
    out = pii.replace(df, "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    return out.collect()


def made(done, doc):
    return [s["surrogate"] for r in done if r["doc_id"] == doc for s in r["surrogates"]]


def luhn(x):
    d = [int(c) for c in re.sub(r"\D", "", x)][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0


def test_rows_stay_whole(done):
    assert len(done) == len(TEXTS)
    by = {r["doc_id"]: r for r in done}
    assert by[4]["text"] is None and by[5]["text"] == "" and by[6]["text"] == TEXTS[5][1]
    assert {r["kind"] for r in done} == {"c"}
    assert by[1]["text"].endswith(made(done, 1)[3] + ".") and by[1]["n_entities"] == 4
    assert by[8]["text"] == "long " * 100_000 + made(done, 8)[0]


def test_format_type_and_coreference(done):
    name, short, mail, loud = made(done, 1)
    assert re.fullmatch(r"Mrs\. [A-Z][a-z]+na [A-Z][a-z]+", name) and re.fullmatch(r"Mr\. [A-Z][a-z]+", short)
    assert mail.lower() == loud.lower() and re.fullmatch(r"[a-z]{3}\.[A-Z]@[A-Z][a-z]{3}\d\.[a-z]{7}\.com", mail)
    first, second, ip, card, dashed, ssn = made(done, 2)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", first) and re.sub(r"\D", "", first) == re.sub(r"\D", "", second)
    assert re.fullmatch(r"(\d+\.){3}\d+", ip) and ip != "10.1.2.3"
    assert card == dashed.replace("-", "") and luhn(card) and card[0] == "4" and card != "4111111111111111"
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn)
    upper, cyrillic, greek = made(done, 3)
    assert upper.split()[2] == name.split()[2].upper()
    assert re.fullmatch(r"Госпожа [А-Я][а-я]+на [А-Я][а-я]+", cyrillic) and re.fullmatch(r"Κύριος [Α-Ω]\S+ος [Α-Ω]\S+", greek)
    same = {s for d in (None, 7, 8) for s in made(done, d)}
    assert len(same) == 1 and "z@q.io" not in same


def test_the_key_decides(spark, done):
    df = spark.createDataFrame([(d, t, "c", "c", "c") for d, t in TEXTS[:2]], SCHEMA)
    other = pii.replace(df, "another key").collect()
    assert not set(made(done, 2)) & set(made(other, 2))
    assert made(pii.replace(df, "k").collect(), 2) == made(done, 2)


def test_surrogates_never_meet(spark):
    """All 26 one-letter names of a host: as many as there are, where first attempts must meet and some values grow."""
    values = [f"{a}@q.io" for a in "abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    got = [r["text"] for r in pii.replace(df, "k").collect()]
    assert len(set(got)) == len(values) and not set(got) & set(values)


def test_a_space_too_small_stops_the_job(spark, monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 1)
    df = spark.createDataFrame([(i, f"{i}@q.io") for i in range(10)], "doc_id long, text string")
    with pytest.raises(ValueError, match="too small"):
        pii.replace(df, "k").collect()


NAMES = [("Anna", "Kowalska", "Mrs."), ("Piotr", "Novak", "Mr"), ("Alex", "O'Neil", "Dr."), ("Kim", "Lee-Hart", "Prof"), ("Νίκη", "Παππά", "Κυρία")]


def people(seed):
    """Texts in which a titled mention of some people is followed by mentions of any form."""
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        some = rng.sample(NAMES, 2)
        words = []
        for given, family, title in some:
            words += [f"{title} {given} {family}", "spoke"]
        for _ in range(rng.randrange(8)):
            given, family, title = rng.choice(some)
            words += [rng.choice([f"{given} {family}", family, given, f"{title} {family}", f"{family}'s", f"Dr. {given} {family}", family.upper(), "anna", "Other Name", "novak's"]), rng.choice(["left.", "and", "met", "with,"])]
        texts.append(" ".join(words))
    return texts


def test_coreference_by_brute_force(spark):
    texts = people(3)
    got = {r["doc_id"]: r for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    new: dict[str, set] = {}
    for i, text in enumerate(texts):
        known = {w.lower() for g, f, t in NAMES for w in (g, f) if f"{t} {g} {f}" in text}
        pattern = re.compile(r"(?<!\w)(?:" + "|".join(sorted(known, key=len, reverse=True)) + r")(?!\w)", re.I)
        old = [m for m in pattern.findall(text) if m[0].isupper()]
        # what is no name stays, so the texts agree but for the names
        rest = re.split("|".join(re.escape(x) for x in sorted(set(old), key=len, reverse=True)), text)
        out = re.fullmatch("(.+?)".join(re.escape(x) for x in rest), got[i]["text"], re.S)
        assert out, (text, got[i]["text"])
        for a, b in zip(old, out.groups(), strict=True):
            new.setdefault(a.lower(), set()).add(b.lower())
            assert a.isupper() == b.isupper() and b[0].isupper()
        assert not any(re.search(rf"(?<!\w){re.escape(w.title() if w != "o'neil" else "O'Neil")}(?!\w)", got[i]["text"]) for w in known)
    assert all(len(v) == 1 for v in new.values()) and len({min(v) for v in new.values()}) == len(new)


def test_gender_hosts_and_national_forms(spark):
    rows = [
        (1, "Mrs. Anna Kowalska spoke. Anna Kowalska left with Dr. Anna Kowalska. Kowalska's brown hat."),
        (2, "Dr. Anna Kowalska, and Prof. Sam Hill"),
        (3, "ann@mail.example.org bob@mail.example.org, (212) 555-0123 or 212-555-0199, 030 1234567, 3782 822463 10005"),
        (4, "in 2024-01-15 at 10.5, 1000 20, 123-456, room 100-200, and 0 12"),
    ]
    got = {r["doc_id"]: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    full = re.match(r"Mrs\. (\S+) (\S+) spoke", got[1]["text"])
    assert full[1].endswith("na") and got[1]["text"] == rows[0][1].replace("Anna", full[1]).replace("Kowalska", full[2])
    assert got[2]["text"].startswith(f"Dr. {full[1]} {full[2]}, and Prof. ") and re.search(r"Prof\. \S+lin ", got[2]["text"])
    a, b, *phones, card = [s["surrogate"] for s in got[3]["surrogates"]]
    assert a.split("@")[1] == b.split("@")[1] != "mail.example.org" and a != b
    assert [re.sub("[0-9]", "9", p) for p in phones] == ["(999) 999-9999", "999-999-9999", "999 9999999"] and "555-01" not in str(phones)
    assert re.fullmatch(r"3\d{3} \d{6} \d{5}", card) and luhn(card)
    assert got[4]["text"] == rows[3][1] and got[4]["n_entities"] == 0


def test_the_query_takes_its_key_from_the_session(spark, tmp_path):
    spark.createDataFrame([(1, "z@q.io")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = []
    for key in ("one", "two", "one", None, None):
        spark.conf.set(pii.KEY_SETTING, key) if key else spark.conf.unset(pii.KEY_SETTING)
        texts.append(pii.op1_pii_surrogates(spark, str(tmp_path)).first()["text"])
    assert texts[0] == texts[2] != texts[1] and texts[3] == texts[4] != "z@q.io"


def test_nothing(spark):
    assert pii.replace(spark.createDataFrame([], SCHEMA), "k").count() == 0
