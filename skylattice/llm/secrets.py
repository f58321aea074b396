"""Secret scan: rules give base findings, and a character convolutional network judges every candidate.

Base findings are matches of three fixed patterns. Candidates are the base findings and every run of at least 16
characters of secrets' alphabet that no base finding overlaps; of a run that some overlap, see candidates(). Each candidate, whole and with its surroundings, is cut into
windows that overlap; a network in numpy (character embedding, a convolution, maximum over places) scores windows, and
a candidate has its best window's score. It is trained on labelled findings that are made here by seeded rules: keys
and tokens of many forms in code and prose, and words, paths, rulers, numbers and names that are none. Scores are
calibrated on further findings, and thresholds are, for each kind of candidate, the highest that keep the recall asked for.

Defined cases: null and empty texts have no findings. Texts of any length are searched whole. Null and repeated
doc_ids are searched row by row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_rows, segments

#: Kinds of base findings in order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24, "cnn": 16}

#: Characters around a candidate, of a window, and between windows' starts; findings for training and for thresholds.
CONTEXT, WIDTH, STRIDE = 24, 64, 40
TRAINING, CALIBRATION, RECALL = 6000, 3000, 0.95

_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_RUN = np.zeros(256, bool)
_RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end in bytes of the text) of maximal runs of at least ``least`` bytes."""
    from .hashing import words

    starts, ends, rows = words(data, offsets, inside)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    long = ends - starts >= least
    return row[long], (starts - offsets[row])[long], (ends - offsets[row])[long]


class Network:
    """Character classes to 8 numbers and a mark for places inside the candidate; 5 wide, 24 filters; the best place of each; a logit."""

    SHAPES = (("embed", (97, 8)), ("conv", (45, 24)), ("bias", (24,)), ("out", (24,)), ("last", (1,)))

    def __init__(self, rng: np.random.Generator):
        self.p = {k: (rng.standard_normal(s) * (0.0 if k in ("bias", "last") else 0.4 if k == "embed" else 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in self.SHAPES}

    @staticmethod
    def codes(windows: np.ndarray) -> np.ndarray:
        """Bytes to classes: 0 padding, 1 .. 95 printable ASCII, 96 the rest."""
        return np.where(windows == 0, 0, np.where((windows >= 32) & (windows < 127), windows - 31, 96)).astype(np.int64)

    def forward(self, windows: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, tuple]:
        codes = self.codes(windows)
        x = np.concatenate([self.p["embed"][codes], marks[:, :, None].astype(np.float32)], 2)
        n, width, d = x.shape
        unfolded = np.lib.stride_tricks.sliding_window_view(x.reshape(n, width * d), 5 * d, 1)[:, ::d]
        z = unfolded.reshape(-1, 5 * d) @ self.p["conv"]
        z = z.reshape(n, width - 4, -1)
        at = z.argmax(1)
        top = np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p["bias"]
        hidden = np.maximum(top, 0)
        return hidden @ self.p["out"] + self.p["last"][0], (codes, unfolded, at, top, hidden)

    def logits(self, windows: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(windows[i : i + 512], marks[i : i + 512])[0] for i in range(0, len(windows), 512)] or [np.zeros(0, np.float32)])

    def gradients(self, kept: tuple, error: np.ndarray) -> dict[str, np.ndarray]:
        codes, unfolded, at, top, hidden = kept
        n, filters = at.shape
        back = error[:, None] * self.p["out"] * (top > 0)
        picked = unfolded[np.arange(n)[:, None], at]  # what each filter saw at its best place
        to_input = back[:, :, None] * self.p["conv"].T[None]
        embed = np.zeros_like(self.p["embed"])
        for j in range(5):
            np.add.at(embed, np.take_along_axis(codes, at + j, 1), to_input[:, :, 9 * j : 9 * j + 8])
        return {"embed": embed, "conv": np.einsum("nfk,nf->kf", picked, back), "bias": back.sum(0), "out": hidden.T @ error, "last": np.array([error.sum()], np.float32)}

    def fit(self, windows: np.ndarray, marks: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 6, batch: int = 64) -> None:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                rows, t = order[i : i + batch], t + 1
                z, kept = self.forward(windows[rows], marks[rows])
                error = ((1 / (1 + np.exp(-z)) - y[rows]) / len(rows)).astype(np.float32)
                for k, g in self.gradients(kept, error).items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= np.float32(0.01) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + np.float32(1e-7))


def windows_of(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of bytes, marks, candidate of each window); windows cover each candidate and its surroundings whole."""
    lo, hi = np.maximum(start - CONTEXT, 0), np.minimum(end + CONTEXT, (offsets[1:] - offsets[:-1])[row])
    count = np.maximum(1, -(-(hi - lo - WIDTH) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(row)), count)
    first = lo[owner] + STRIDE * (segments(count, np.zeros(len(count), np.int64)))
    place = first[:, None] + np.arange(WIDTH)
    valid = place < hi[owner][:, None]
    raw = np.where(valid, data[np.minimum(place + offsets[row[owner]][:, None], max(0, len(data) - 1))], 0)
    return raw, (place >= start[owner][:, None]) & (place < end[owner][:, None]), owner


def findings(n: int, rng: np.random.Generator) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Labelled findings: (texts, starts, ends, labels, kinds), half of them secrets; of every kind there are some that are none."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda alphabet, k: "".join(np.array([*alphabet])[rng.integers(0, len(alphabet), k)])
    choose = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = [a + b for a in "bcdfghlmnprstvwz" for b in ("a", "e", "i", "o", "u", "er", "on", "en", "ti", "est", "ing", "ción", "heit")]
    word = lambda k: "".join(choose(syllables) for _ in range(k))
    prose = lambda: " ".join(word(int(rng.integers(1, 4))) for _ in range(int(rng.integers(2, 7))))
    ascii_word = lambda k: word(k).replace("ó", "o")
    texts, starts, ends, labels, kinds = [], [], [], [], []
    for i in range(n):
        secret, kind = i % 2 == 0, "cnn"
        if secret:
            form, k = int(rng.integers(7)), int(rng.integers(20, 64))
            if form == 0:
                body, kind = pick(digits + "abcdef", max(24, k)), "hex"
            elif form == 1:
                body, kind = "AKIA" + pick(upper + digits, 16), "access"
            elif form == 2:
                body, kind = pick(upper + lower + digits, int(rng.integers(6, 40))), "assign"
            elif form == 3:
                body = choose(("ghp_", "sk_live_", "xoxb-", "glpat-", "AIza", "npm_")) + pick(upper + lower + digits, k)
            elif form == 4:
                body = pick(upper + lower + digits + "+/", k) + choose(("", "=", "=="))
            elif form == 5:
                body = "eyJ" + pick(upper + lower + digits + "-_", k) + "." + pick(upper + lower + digits + "-_", k)
                body = body.replace(".", "_")
            else:
                body = pick(upper + lower + digits + "-_", k)
            if kind == "assign":
                body = choose(("password", "Passwd", "secret", "token", "api_key", "APIKEY")) + choose((" = ", "=", ": ", '": "')) + body
            head = choose(("", "", "Bearer ", "key ", "export X=", "auth: ", '"', "url?sig="))
        else:
            form = int(rng.integers(13))
            if form < 3:
                body = ascii_word(int(rng.integers(6, 12)))
            elif form == 9:  # words in a secret's place
                value = choose((ascii_word(int(rng.integers(2, 5))), "-".join(ascii_word(2) for _ in range(int(rng.integers(2, 5)))), choose((".", "/", "_")).join(ascii_word(2) for _ in range(3)), ascii_word(2) + str(rng.integers(1, 10))))
                body, kind = choose(("password", "Passwd", "secret", "token", "api_key", "APIKEY")) + choose((" = ", "=", ": ", '": "')) + (value + "ness" if len(value) < 6 else value), "assign"
            elif form == 10:  # digests and counters where everybody may read them
                body, kind = choose((pick(digits + "abcdef", 64), pick(digits + "abcdef", 40), pick("01", int(rng.integers(24, 64))), pick(digits, int(rng.integers(24, 40))), choose(digits + "abcdef") * int(rng.integers(24, 64)))), "hex"
            elif form == 11:  # words in capitals
                body, kind = "AKIA" + "".join(ascii_word(2).upper() for _ in range(8))[: int(rng.integers(16, 30))].replace(" ", ""), "access"
            elif form == 12:  # placeholders
                body, kind = "AKIA" + choose((choose("X0A") * 16, "".join(choose(("KEY", "YOUR", "HERE", "TEST")) for _ in range(5))[:16].ljust(16, "X"))), "access"
            elif form == 3:
                body = "/".join(ascii_word(2) for _ in range(int(rng.integers(3, 7))))
            elif form == 4:
                body = choose("=-_+/") * int(rng.integers(16, 80))
            elif form == 5:
                body = choose("-_").join(ascii_word(2) for _ in range(int(rng.integers(3, 7))))
            elif form == 6:
                body = "".join(ascii_word(2).capitalize() for _ in range(int(rng.integers(3, 6))))
            elif form == 7:
                body = pick(digits, int(rng.integers(16, 24)))
            else:
                body = f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}-{ascii_word(3)}"
            body = body if len(body) >= 16 or kind != "cnn" else body * (16 // len(body) + 1)
            head = choose(("", "", "", "see ", "the ", "| ", '"', "/"))
            if kind == "hex":
                head = choose(("sha256:", "sha1 ", "commit ", "md5sum ", "integrity: ", "checksum ", "index ", "etag ", "digest="))
        before = prose() + " " + head
        texts.append(before + body + choose((" ", ".", '"', "\n", ", ")) + prose())
        b = len(before.encode())
        starts.append(b)
        ends.append(b + len(body.encode()))
        labels.append(secret)
        kinds.append(kind)
    return texts, np.array(starts), np.array(ends), np.array(labels, np.float32), kinds


class Judge:
    """The network with its calibration and a threshold for each kind."""

    def __init__(self, network: Network, slope: float, shift: float, thresholds: dict[str, float]):
        self.network, self.slope, self.shift, self.thresholds = network, slope, shift, thresholds

    def probabilities(self, data, offsets, row, start, end) -> np.ndarray:
        best = np.full(len(row), -1e9)
        for i in range(0, len(row), 4096):
            part = slice(i, i + 4096)
            windows, marks, owner = windows_of(data, offsets, row[part], start[part], end[part])
            np.maximum.at(best, owner + i, self.network.logits(windows, marks))
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -40, 40)))


@lru_cache(maxsize=1)
def train(seed: int = 5, recall: float = RECALL) -> Judge:
    """Trains on ``TRAINING`` findings; calibration and thresholds from ``CALIBRATION`` others."""
    from .toxicity import calibrate

    rng = np.random.default_rng(seed)
    network = Network(rng)

    def arrays(n: int):
        texts, start, end, y, kinds = findings(n, rng)
        data, offsets = byte_rows(pa.array(texts))
        return data, offsets, np.arange(n), start, end, y, np.array(kinds)

    data, offsets, row, start, end, y, _ = arrays(TRAINING)
    windows, marks, owner = windows_of(data, offsets, row, start, end)
    network.fit(windows, marks, y[owner], rng)
    data, offsets, row, start, end, y, kinds = arrays(CALIBRATION)
    z = np.full(len(y), -1e9)
    windows, marks, owner = windows_of(data, offsets, row, start, end)
    np.maximum.at(z, owner, network.logits(windows, marks))
    slope, shift = calibrate(z, y, np.ones(len(y)))
    p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -40, 40)))
    at = {k: float(np.quantile(p[(y == 1) & (kinds == k)], 1 - recall)) for k in (*KINDS, "cnn")}
    return Judge(network, slope, shift, at)


def base_spans(texts: list[str], raw: list[bytes], data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Of each text: (start, kind's number, end) of base findings in code points."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, (text, b) in enumerate(zip(texts, raw, strict=True)):
        small = b.lower()
        if any(w in small for w in WORDS) or b"passwd" in small:
            found[i] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
        if b"AKIA" in b:
            found[i] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    for i, a, b in zip(*(x.tolist() for x in runs(data, offsets, _HEX, LEAST["hex"])), strict=True):
        at = len(raw[i][:a].decode("utf-8", "replace"))
        found[i].append((at, 2, at + b - a))
    return found


def candidates(start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the network judges of a run that base findings (start, end, kind's number) overlap: the parts between them
    that are long enough; the run whole where they are hex alone and leave a shorter part, as a key may hold hex digits."""
    rests, at = [], start
    for a, b, _ in sorted(spans):
        if a > at:
            rests.append((at, a))
        at = max(at, b)
    if at < end:
        rests.append((at, end))
    long = [(a, b) for a, b in rests if b - a >= LEAST["cnn"]]
    if len(long) < len(rests) and all(k == 2 for *_, k in spans):
        return [(start, end), *long]
    return long


def scan(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """(doc_id, spans: kind, start, end, probability), findings in order of start, then kind; kind cnn is the network's own."""
    shared = docs.sparkSession.sparkContext.broadcast(judge or train())
    kind_id = docs.schema["doc_id"].dataType.simpleString()

    def judged(part: pa.RecordBatch) -> pa.RecordBatch:
        judge = shared.value
        data, offsets = byte_rows(part.column(1))
        whole = data.tobytes()
        raw = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        texts = [b.decode("utf-8", "replace") for b in raw]
        base = base_spans(texts, raw, data, offsets)
        rows, starts, ends, kinds = [], [], [], []
        for i, spans in enumerate(base):
            for a, k, b in spans:
                at = len(texts[i][:a].encode())
                rows.append(i)
                starts.append(at)
                ends.append(at + len(texts[i][a:b].encode()))
                kinds.append(k)
        taken: dict[int, list] = {}
        for i, a, b, k in zip(rows, starts, ends, kinds, strict=True):
            taken.setdefault(i, []).append((a, b, k))
        waiting = {i: sorted(spans, reverse=True) for i, spans in taken.items()}
        open_spans: dict[int, list] = {}
        for i, a, b in zip(*(x.tolist() for x in runs(data, offsets, _RUN, LEAST["cnn"])), strict=True):  # in order, apart
            near, queue = open_spans.get(i, []), waiting.get(i, [])
            while queue and queue[-1][0] < b:
                near.append(queue.pop())
            near = [t for t in near if t[1] > a]
            open_spans[i] = near
            for x, y in candidates(a, b, near):
                rows.append(i)
                starts.append(x)
                ends.append(y)
                kinds.append(3)
        p = judge.probabilities(data, offsets, np.array(rows, np.int64), np.array(starts, np.int64), np.array(ends, np.int64))
        out: list[list] = [[] for _ in texts]
        for i, a, b, k, q in zip(rows, starts, ends, kinds, p.tolist(), strict=True):
            name = (*KINDS, "cnn")[k]
            if k < 3 or q >= judge.thresholds["cnn"]:
                first = len(raw[i][:a].decode("utf-8", "replace"))
                out[i].append((first, k, {"kind": name, "start": first, "end": first + len(raw[i][a:b].decode("utf-8", "replace")), "probability": q, "confirmed": q >= judge.thresholds[name]}))
        spans = [[s[2] for s in sorted(o, key=lambda s: s[:2])] for o in out]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()), ("confirmed", pa.bool_())])))], names=["doc_id", "spans"])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                yield judged(batch.slice(lo, 1000))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_id}, spans array<struct<kind string, start long, end long, probability double, confirmed boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """The findings as counts, a hash of the base findings, and text."""
    from pyspark.sql import functions as F

    base = F.filter("spans", lambda s: s["kind"] != "cnn")
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in (*KINDS, "cnn")]
    return found.select("doc_id", *counts[:3], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), counts[3])


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
