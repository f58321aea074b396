"""PII surrogates: keyed replacements that keep type, gender, script and format.

Everything is DataFrame functions. A pattern finds mentions; a mention has parts (a name has a given name and a family
name), and a part has a canonical value, so that the same phone number in two formats is one entity. An entity's
surrogate is a function of a secret key, its kind, its canonical value and a count of attempts. Surrogates of all
distinct entities are checked against each other and against all entities: where two meet, or one is somebody's real
value, all but one try again until none meet. So different entities stay different and an entity has one surrogate
everywhere, in each mention's own format.

Kinds: email, phone, ip, card (keeps its first digit, and its checksum where it had a valid one), ssn, and names. A name is
found after a title, which tells the gender; letters are replaced within their script (Latin, Greek, Cyrillic), others stay.

Coreference: names that a title establishes are replaced in the whole text, without the title too, whole or in part
("Kowalska said"), where they begin with a capital. After a title that tells no gender a full name has the gender that the
text, else the whole corpus, knows for it, if it knows one alone. Addresses at one host have one host.

The key is the argument ``secret``; the query takes it from the setting ``KEY_SETTING`` of the session, and where that is
unset from random bytes of the driver's process, so that nobody can make the surrogates again.

Limits: a name without a titled mention in its own text stays. A phone number with its country's code and one without
are two entities. National phone numbers are found with separators alone.

Defined cases: null text stays null with no entities, empty text stays empty. Null doc_ids, and rows that repeat doc_id
and text, get the same text as their equals. Any number of mentions in a text of any length is replaced. An empty table
gives an empty result. Extra columns pass through, but for those named like a result column. Names and addresses grow
by a letter from the sixth attempt on, so they always find a place. Numbers keep their length: if after ``ROUNDS`` attempts
some still meet, there are nearly as many entities as numbers of that form, and the job stops with a ValueError.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KEY_SETTING = "spark.skylattice.pii.key"

#: Titles by gender, and patterns by kind in order of precedence.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Госпожа", "Κυρία")
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
NEUTRAL = ("Dr", "Prof", "Mx")
TITLES = r"(?:" + "|".join(FEMALE + MALE + NEUTRAL) + r")\.?"
#: A capitalised word, with hyphens and apostrophes inside, but for a possessive s.
WORD = r"\p{Lu}(?:\p{L}|['’-](?!s(?!\p{L}))(?=\p{L}))+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}.+_-])[\p{L}\p{N}.+_-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![\p{N}]|\.[\p{N}])",
    "ssn": r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])",
    "phone": r"(?<![\p{N}+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}|(?<![\p{L}.-])(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}(?:(?: [0-9]{3} )|(?:-[0-9]{3}-)|(?:\.[0-9]{3}\.))[0-9]{4}|0[0-9]{2,4}[ /-][0-9]{6,8})(?![.-][\p{N}]))(?![\p{N}])",
    "card": r"(?<![\p{N}\p{L}.-])[0-9]{4}(?:(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[ -][0-9]{6}[ -][0-9]{5})(?![\p{N}\p{L}])",
    "name": r"(?<![\p{L}\p{N}])" + TITLES + " " + WORD + "(?: " + WORD + ")?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every text with a mention holds, with what it may begin with ahead: most texts hold none of it, and are passed over.
HINT = "(?=[@+0-9" + "".join(sorted({t[0] for t in FEMALE + MALE + NEUTRAL})) + r"])(?:@|\+[0-9]|[0-9](?:\.[0-9]|[0-9]{2}[0-9 ./)-])|" + TITLES + r" \p{Lu})"
#: Letters of scripts, and syllables of names by script; endings of given names by gender.
SCRIPTS = {"latin": "abcdefghijklmnopqrstuvwxyz", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя"}
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "ha", "ka", "ke", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "ra", "re", "ro", "sa", "se", "ta", "te", "to", "va", "ve"),
    "greek": ("βα", "γα", "δα", "θε", "κα", "κο", "λα", "λε", "μα", "με", "να", "νο", "πα", "ρα", "σα", "τα"),
    "cyrillic": ("ба", "ва", "га", "да", "за", "ка", "ко", "ла", "ле", "ма", "ме", "на", "но", "па", "ра", "са"),
}
ENDINGS = {"latin": {"f": "na", "m": "son", "n": "lin"}, "greek": {"f": "ία", "m": "ος", "n": "ις"}, "cyrillic": {"f": "на", "m": "ов", "n": "ко"}}
#: Rounds of attempts after which we give up, rather than let two entities share a surrogate; attempts at which values grow.
ROUNDS, GROW = 30, 6


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def title_gender(title: Column) -> Column:
    title = F.regexp_replace(title, r"\.$", "")
    return F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m").otherwise("n")


def established(mentions: Column) -> Column:
    """array<struct<neutral, place, canon, role, gender, given, family>>: name words of titled mentions; those of a known gender first."""

    def of(m: Column, place: Column) -> Column:
        w = F.split(m, " ")
        gender, family = title_gender(F.element_at(w, 1)), F.lower(F.element_at(w, -1))
        given = F.when(F.size(w) == 3, F.lower(F.element_at(w, 2)))
        word = lambda canon, role: F.struct((gender == "n").alias("neutral"), place.alias("place"), canon.alias("canon"), F.lit(role).alias("role"), gender.alias("gender"), given.alias("given"), family.alias("family"))
        return F.when(F.size(w) == 3, F.array(word(F.lower(F.element_at(w, 2)), "given"), word(family, "family"))).otherwise(F.array(word(family, "family")))

    return F.array_sort(F.flatten(F.transform(F.filter(mentions, lambda m: m.rlike(f"^{TITLES} ")), of)))


def with_words(known: Column) -> Column:
    """The pattern of mentions in a text that establishes name words: these too, where they begin with a capital."""
    words = F.array_join(F.transform(F.array_distinct(F.transform(known, lambda k: k["canon"])), lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))), "|")
    return F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?=\p{Lu})(?iu:"), words, F.lit(r")(?![\p{L}\p{N}])"))


def parts_of(kind: Column, mention: Column, known: Column) -> Column:
    """array<struct<kind, canon, given, family>> of a mention; given and family where a full name is behind a given name."""
    words = F.split(mention, " ")
    none = F.lit(None).cast("string")
    part = lambda k, v, g=none, f=none: F.struct(k.alias("kind"), v.alias("canon"), g.alias("given"), f.alias("family"))

    def given_kind(gender: Column, given: Column, family: Column) -> Column:
        """Of a neutral title, what the text knows for the full name, if it is one gender."""
        same = F.array_distinct(F.transform(F.filter(known, lambda k: ~k["neutral"] & (k["given"] == given) & (k["family"] == family)), lambda k: k["gender"]))
        return F.concat(F.lit("given_"), F.when((gender == "n") & (F.size(same) == 1), F.element_at(same, 1)).otherwise(gender))

    family = F.lower(F.element_at(words, -1))
    given = F.lower(F.element_at(words, 2))
    titled = F.when(F.size(words) == 3, F.array(part(given_kind(title_gender(F.element_at(words, 1)), given, family), given, given, family), part(F.lit("family"), family))).otherwise(F.array(part(F.lit("family"), family)))

    def bare(hit: Column) -> Column:
        return F.when(hit["role"] == "given", F.array(part(given_kind(hit["gender"], hit["given"], hit["family"]), hit["canon"], hit["given"], hit["family"]))).otherwise(F.array(part(F.lit("family"), F.lower(mention))))

    hit = F.filter(known, lambda k: k["canon"] == F.lower(mention))
    bare_part = F.when(F.size(hit) > 0, bare(F.element_at(hit, 1))).otherwise(F.array(part(F.lit("family"), F.lower(mention))))
    canon = F.when(kind == "email", F.lower(mention)).when(kind == "ip", mention).otherwise(digits(mention))
    return F.when(kind == "name", F.when(mention.rlike(f"^{TITLES} "), titled).otherwise(bare_part)).otherwise(F.array(part(kind, canon)))


def stream(key: Column, kind: Column, canon: Column, attempt: Column) -> Column:
    """64 hexadecimal digits that only the key's holder can predict."""
    inner = F.sha2(F.concat_ws("\u0001", key, kind, canon, attempt.cast("string")), 256)
    return F.sha2(F.concat_ws("\u0002", key, inner), 256)


def nth(hexes: Column, i: Column | int, below: int) -> Column:
    """A number below ``below`` for place i, from 6 digits of the stream that begin at a place of its own."""
    at = F.pmod(F.lit(i) * 7 if isinstance(i, int) else i * 7, F.lit(59)) + 1
    turn = F.floor((F.lit(i) if isinstance(i, int) else i) / 59)
    return F.pmod(F.conv(F.substring(hexes, at, F.lit(6)), 16, 10).cast("long") + turn * 31, F.lit(below)).cast("int")


def letter(c: Column, i: Column, hexes: Column) -> Column:
    """Another letter of the same script and case, or another digit; other characters stay."""
    low, out = F.lower(c), c
    for letters in (*SCRIPTS.values(), "0123456789"):
        new = F.substring(F.lit(letters), nth(hexes, i, len(letters)) + 1, F.lit(1))
        out = F.when(F.instr(F.lit(letters), low) > 0, F.when(low == c, new).otherwise(F.upper(new))).otherwise(out)
    return out


def luhn(value: Column) -> Column:
    """The checksum of digits modulo 10, the last digit counted once."""
    n = F.length(value)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + let(F.substring(value, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.pmod(total, F.lit(10))


def surrogate(key: Column, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical value that replaces an entity's; of an email, what goes before its host's surrogate."""
    hexes = stream(key, kind, canon, attempt)

    def build(h: Column) -> Column:
        chars = F.split(canon, "")
        each = lambda first: F.array_join(F.transform(chars, lambda c, i: F.when(i < first, c).otherwise(letter(c, i, h))), "")
        more = F.when(attempt > GROW, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt - GROW, F.lit(1))), lambda i: F.substring(F.lit(SCRIPTS["latin"]), nth(h, i + 60, 26) + 1, F.lit(1))), "")).otherwise("")
        top = F.instr(canon, "@") - 1
        local = F.array_join(F.transform(F.split(F.substring(canon, F.lit(1), top), ""), lambda c, i: letter(c, i, h)), "")
        labels = F.split(canon, r"\.")
        host = F.transform(F.slice(labels, F.lit(1), F.size(labels) - 1), lambda x, j: F.array_join(F.transform(F.split(x, ""), lambda c, i: letter(c, i + 13 * (j + 1), h)), ""))
        host = F.concat(F.array_join(host, "."), more, F.lit("."), F.element_at(labels, -1))
        email = F.concat(local, more, F.lit("@"))
        ip = F.concat_ws(".", (nth(h, 1, 222) + 1).cast("string"), *(nth(h, i, 256).cast("string") for i in (2, 3)), (nth(h, 4, 254) + 1).cast("string"))
        body = let(each(F.lit(1)), lambda v: F.substring(v, F.lit(1), F.length(v) - 1))
        check = lambda b: F.pmod(F.lit(10) - luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")
        card = F.when(luhn(canon) == 0, let(body, lambda b: F.concat(b, check(b)))).otherwise(each(F.lit(1)))
        out = F.when(kind == "email", email).when(kind == "host", host).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", each(F.length(canon) - F.least(F.length(canon) - 1, F.lit(10)))).when(kind == "ssn", each(F.lit(0)))
        for script, syllables in SYLLABLES.items():
            table = F.array(*(F.lit(s) for s in syllables))
            made = lambda n, table=table, m=len(syllables): F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(table, nth(h, i, m) + 1)), "")
            gender = F.substring(kind, 7, 1)
            ending = F.when(gender == "f", ENDINGS[script]["f"]).when(gender == "m", ENDINGS[script]["m"]).otherwise(ENDINGS[script]["n"])
            name = F.when(kind == "family", made(F.lit(4) + attempt)).otherwise(F.concat(made(F.lit(3) + attempt), ending))
            if script != "latin":
                out = F.when(((kind == "family") | kind.startswith("given_")) & (F.instr(F.lit(SCRIPTS[script]), F.substring(canon, 1, 1)) > 0), name).otherwise(out)
            else:
                out = out.otherwise(name)
        return out

    return let(hexes, build)


def shaped(kind: Column, mention: Column, values: Column) -> Column:
    """The mention's own format with its parts' surrogates."""
    value = F.element_at(values, 1)
    upper = lambda c: (F.lower(c) != c)
    email = F.when(F.lower(mention) == mention, value).otherwise(F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(upper(F.substring(mention, i + 1, F.lit(1))), F.upper(c)).otherwise(c)), ""))
    start = F.struct(F.lit("").alias("done"), F.lit(1).alias("k"))
    number = F.aggregate(F.split(mention, ""), start, lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["done"], F.substring(value, s["k"], F.lit(1))).alias("done"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["done"], c).alias("done"), s["k"].alias("k"))))["done"]
    words = F.split(mention, " ")
    cased = lambda v, w: F.when(F.upper(w) == w, F.upper(v)).otherwise(F.concat(F.upper(F.substring(v, 1, 1)), F.substring(v, F.lit(2), F.length(v))))
    titled = F.array_join(F.concat(F.array(F.element_at(words, 1)), F.zip_with(values, F.slice(words, F.lit(2), F.size(words) - 1), cased)), " ")
    name = F.when(mention.rlike(f"^{TITLES} "), titled).otherwise(cased(value, mention))
    return F.when(kind == "email", email).when(kind == "ip", value).when(kind == "name", name).otherwise(number)


def settled(entities: DataFrame, key: Column) -> DataFrame:
    """(kind, canon, made) such that no two of a kind are alike, and none is a real value. entities: distinct (kind, canon, tail); made ends in tail."""
    state = entities.withColumn("attempt", F.lit(0))
    real = entities.select("kind", F.col("canon").alias("made"), F.lit(True).alias("taken"))
    for _ in range(ROUNDS):
        made = state.withColumn("made", F.concat(surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")), "tail"))
        # of those that meet, the one with the most attempts stays, then the smallest: who moves next changes, so rounds end
        first = made.groupBy("kind", "made").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(-F.col("attempt"), "canon"))["canon"].alias("stays"))
        judged = made.join(first, ["kind", "made"]).join(real, ["kind", "made"], "left")
        moves = F.coalesce("taken", F.lit(False)) | ((F.col("n") > 1) & (F.col("canon") != F.col("stays")))
        state = materialise(judged.select("kind", "canon", "tail", "made", (F.col("attempt") + moves.cast("int")).alias("attempt"), moves.alias("moved")), "pii-attempts")
        if state.filter("moved").isEmpty():
            return state.select("kind", "canon", "made")
        state = state.drop("moved", "made")
    raise ValueError(f"surrogates still meet after {ROUNDS} rounds; their space is too small for these entities")


def gendered(rows: DataFrame) -> DataFrame:
    """rows where given names after neutral titles have the one gender that the corpus knows for the full name."""
    known = rows.filter(F.col("kind").isin("given_f", "given_m")).filter("given IS NOT NULL")
    known = known.groupBy("given", "family").agg(F.min("kind").alias("x"), F.max("kind").alias("y")).filter("x = y").select("given", "family", "x")
    neutral = F.coalesce((F.col("kind") == "given_n") & F.col("given").isNotNull(), F.lit(False))
    found = rows.filter(neutral).join(known, ["given", "family"], "left").withColumn("kind", F.coalesce("x", "kind"))
    return rows.filter(~neutral).select(*rows.columns).union(found.select(*rows.columns))


def replace(docs: DataFrame, secret: str) -> DataFrame:
    """All columns of docs, text with surrogates, n_entities, and surrogates: array<struct<kind, surrogate>> in order."""
    key = F.lit(secret)
    docs = docs.drop("n_entities", "surrogates")
    columns = [c for c in docs.columns if c != "text"]
    hint = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    identity = F.sha2(F.concat_ws("\u0001", F.coalesce(F.col("doc_id").cast("string"), F.lit("\u0003")), "text"), 256)
    held = docs.filter(hint).withColumns({"__key": identity, "__known": established(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))})
    held = held.withColumn("__pattern", F.when(F.size("__known") > 0, with_words(F.col("__known"))).otherwise(ANY))
    held = held.withColumns({"__found": F.regexp_extract_all("text", F.col("__pattern"), F.lit(0)), "__between": F.split("text", F.col("__pattern"), -1)})
    held = materialise(held.select(*(F.col(f"`{c}`") for c in columns), "__key", "__known", "__found", "__between"), "pii-held")

    rows = held.select("__key", "__known", F.posexplode("__found").alias("place", "mention"))
    # rows that repeat doc_id and text have one key, and so one list of mentions
    rows = rows.groupBy("__key", "place").agg(F.first("mention").alias("mention"), F.first("__known").alias("__known")).withColumn("of", kind_of(F.col("mention")))
    rows = rows.select("__key", "place", "mention", "of", F.posexplode(parts_of(F.col("of"), F.col("mention"), F.col("__known"))).alias("part", "entity"))
    rows = materialise(rows.select("__key", "place", "mention", "of", "part", "entity.*"), "pii-mentions")
    rows = gendered(rows)
    entities = materialise(rows.select("kind", "canon").distinct(), "pii-entities")
    mails = entities.filter("kind = 'email'").withColumn("host", F.substring_index("canon", "@", -1))
    hosts = settled(mails.select(F.lit("host").alias("kind"), F.col("host").alias("canon"), F.lit("").alias("tail")).distinct(), key)
    mails = mails.join(hosts.select(F.col("canon").alias("host"), F.col("made").alias("tail")), "host").select("kind", "canon", "tail")
    values = settled(entities.filter("kind <> 'email'").withColumn("tail", F.lit("")).union(mails), key)

    rows = rows.join(values, ["kind", "canon"])
    rows = rows.groupBy("__key", "place").agg(F.first("of").alias("of"), F.first("mention").alias("mention"), F.array_sort(F.collect_list(F.struct("part", "made"))).alias("parts"))
    rows = rows.select("__key", "place", "of", shaped(F.col("of"), F.col("mention"), F.transform("parts", lambda p: p["made"])).alias("made"))
    lists = rows.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("place", F.col("of").alias("kind"), F.col("made").alias("surrogate")))).alias("__made"))
    none = F.array().cast("array<struct<kind:string,surrogate:string>>")
    made = F.coalesce(F.transform("__made", lambda m: F.struct(m["kind"].alias("kind"), m["surrogate"].alias("surrogate"))), none)
    text = F.array_join(F.flatten(F.zip_with("__between", made, lambda b, m: F.array(b, F.coalesce(m["surrogate"], F.lit(""))))), "")
    done = held.join(lists, "__key", "left").select(*(F.col(f"`{c}`") for c in columns), text.alias("text"), F.size(made).alias("n_entities"), made.alias("surrogates"))
    rest = docs.filter(~hint).select(*(F.col(f"`{c}`") for c in columns), "text", F.lit(0).alias("n_entities"), none.alias("surrogates"))
    return done.unionByName(rest)


@lru_cache(maxsize=1)
def drawn_key() -> str:
    from secrets import token_hex

    return token_hex(32)


def op1_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace(docs, spark.conf.get(KEY_SETTING, None) or drawn_key())
