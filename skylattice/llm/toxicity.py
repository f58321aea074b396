"""Toxicity: a logistic classifier of words and word beginnings, regularised by counterfactuals.

Training texts with identity terms are copied with each term swapped for others of its group; so are neutral sentences
that mention a group. Training adds the squared change of the score between a text and its copies to the loss, so a
mention of a group alone moves no score. Features are kept by a likelihood-ratio test on the training sample; the
score is calibrated on rows that neither the test nor the training saw. Scoring reads whole texts in array operations.

Training takes at most ``SAMPLE`` labelled rows of each label (those with the smallest hashes); every count of labels covers all rows.
All counterfactual copies of the texts that training learns from count, whatever the order of rows, and rows are sorted
before training, so one input gives one model.

Defined cases: null and empty texts have the score of a text without known words. Null labels and labels without a
document are left out; a document labelled twice trains twice. Rows with a null doc_id are scored and not held out.
Repeated rows are scored alike. Without labels of both kinds the score is 0. An empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import byte_rows, kept_rows
from .hashing import hash_pieces, lower_ascii, words

#: Labelled rows of each label that training and calibration take at most; features that training keeps at most.
SAMPLE, FEATURES = 4000, 3000
#: Weight of the counterfactual penalty and of squared weights.
COUNTERFACTUAL, DECAY = 1.0, 2e-4
THRESHOLD = 0.3
#: Bytes of word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6)

#: Terms that may be swapped for each other, and sentences that mention a group neutrally.
IDENTITY_GROUPS = (
    ("woman", "man", "women", "men", "girl", "boy", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "latino", "african", "european", "indigenous"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
    ("frau", "mann", "muslimisch", "christlich", "jüdisch"),
    ("femme", "homme", "musulman", "chrétien", "juif"),
    ("mujer", "hombre", "musulmán", "cristiano", "judío"),
)
NEUTRAL = ("i am a {} person", "my neighbour is {} and kind", "the {} community met today", "a {} colleague wrote this")

_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def features(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, features) without repeats, by row: 32-bit hashes of words and their beginnings; only those in ``keep``, as places in it."""
    lower = lower_ascii()[data]
    starts, ends, rows = words(lower, offsets, _INSIDE)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    parts = []
    for k, n in enumerate((None, *BEGINNINGS)):
        long = np.ones(len(starts), bool) if n is None else ends - starts > n
        stop = ends[long] if n is None else starts[long] + n
        h, _ = hash_pieces(lower, starts[long], stop)
        value = (((h >> np.uint64(30)) + np.uint64(k * 0x9E3779B1)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = row[long]
        if keep is not None:
            place = np.minimum(np.searchsorted(keep, value), max(0, len(keep) - 1))
            known = keep[place] == value if len(keep) else np.zeros(len(value), bool)
            value, at = place[known], at[known]
        parts.append((at.astype(np.int64) << 32) | value)
    both = np.unique(np.concatenate(parts))
    return both >> 32, both & 0xFFFFFFFF


def swap(text: str) -> list[str]:
    """Counterfactual copies: every identity term of a group becomes the next, and the one after, of its group."""
    import re

    out = []
    for step in (1, 2):
        terms = {t: g[(i + step) % len(g)] for g in IDENTITY_GROUPS for i, t in enumerate(g)}
        new = re.sub(r"[^\W\d_]+", lambda m: terms.get(m[0].lower(), m[0]), text)
        if new != text and new not in out:
            out.append(new)
    return out


def features_of(texts: list[str], keep: np.ndarray | None = None, lot: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """features() of texts, some at a time, so that the driver's memory holds the results alone."""
    rows, cols = [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)]
    for i in range(0, len(texts), lot):
        r, c = features(*byte_rows(pa.array(texts[i : i + lot], pa.string())), keep)
        rows.append((r + i).astype(np.int32))
        cols.append(c.astype(np.uint32))
    return np.concatenate(rows), np.concatenate(cols)


def matrix(texts: list[str], keep: np.ndarray) -> np.ndarray:
    rows, cols = features_of(texts, keep)
    x = np.zeros((len(texts), len(keep)), np.float32)
    x[rows, cols] = 1
    return x


def mean_change(pairs: Iterable[tuple[str, str]], keep: np.ndarray, lot: int = 300) -> np.ndarray:
    """Mean of d dᵀ over all (origin, copy), d the change of features: summed some pairs at a time, so that memory holds the sum alone."""
    total, n = np.zeros((len(keep), len(keep)), np.float32), 0
    for part in batched(pairs, lot):
        d = matrix([c for _, c in part], keep) - matrix([t for t, _ in part], keep)
        some = np.flatnonzero(d.any(0))
        total[np.ix_(some, some)] += d[:, some].T @ d[:, some]
        n += len(part)
    return total / np.float32(max(1, n))


class Model:
    """keep: feature hashes in ascending order; weights, bias and the calibration's two numbers."""

    def __init__(self, keep, weights, bias, slope=1.0, shift=0.0):
        self.keep, self.weights, self.bias, self.slope, self.shift = keep, weights, bias, slope, shift

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, cols = features(data, offsets, self.keep)
        return self.bias + np.bincount(rows, self.weights[cols], len(offsets) - 1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.logits(data, offsets) + self.shift)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def likelihood_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """G² of each feature against the label."""
    total = n_pos + n_neg
    out = np.zeros(len(pos))
    for seen, of in ((pos, n_pos), (neg, n_neg), (n_pos - pos, n_pos), (n_neg - neg, n_neg)):
        rest = (pos + neg) if seen is pos or seen is neg else total - pos - neg
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(seen > 0, 2 * seen * np.log(seen * total / (rest * of)), 0)
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pairs: np.ndarray, penalty: float = COUNTERFACTUAL, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias: weighted log loss, squared weights, and the mean squared score change over ``pairs``.

    pairs: mean_change() of the counterfactuals, or empty for no penalty. Steps are Adam's on the whole sample.
    """
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = (weight / weight.sum()).astype(np.float32)
    for t in range(1, steps + 1):
        error = (sigmoid(x @ w + b) - y).astype(np.float32) * share
        grad = x.T @ error + np.float32(DECAY) * w
        if len(pairs):
            grad += np.float32(2 * penalty) * (pairs @ w)
        gb = float(error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 / (1 + t / 100)
        w = w - np.float32(rate) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + np.float32(1e-8))
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of a logistic curve over logits, by damped Newton steps with a weak prior to 1 and 0."""
    a, c = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + c)
        e, h = weight * (p - y), weight * p * (1 - p)
        g = np.array([(e * z).sum() + (a - 1), e.sum() + 0.1 * c])
        k = np.array([[(h * z * z).sum() + 1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(k, g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, c = max(0.05, a - step[0]), c - step[1]
    return float(a), float(c)


def train_model(texts: list[str], y: np.ndarray, weight: np.ndarray, holdback: np.ndarray) -> Model:
    """texts with labels y; rows where ``holdback`` calibrate alone."""
    y = np.asarray(y, np.float64)
    learn = np.flatnonzero(~holdback)
    if not len(learn) or len(np.unique(y[learn])) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0)
    rows, values = features_of([texts[i] for i in learn])
    toxic = y[learn][rows] == 1
    found, total = np.unique(values, return_counts=True)
    some, hits = np.unique(values[toxic], return_counts=True)
    del rows, values, toxic
    pos = np.zeros(len(found))
    pos[np.searchsorted(found, some)] = hits
    neg = total - pos
    gain = likelihood_ratio(pos, neg, y[learn].sum(), (1 - y[learn]).sum())
    gain[pos + neg < 3] = 0
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    terms = features(*byte_rows(pa.array([" ".join(g) for g in IDENTITY_GROUPS])))[1]
    keep = np.unique(np.concatenate([found[best[gain[best] > 6.6]].astype(np.int64), terms]))
    x = matrix([texts[i] for i in learn], keep)
    copies = ((texts[i], c) for i in learn for c in swap(texts[i]))
    probes = [(p.format(g[0]), p.format(t)) for p in NEUTRAL for g in IDENTITY_GROUPS for t in g[1:]]
    pairs = mean_change(chain(copies, probes), keep)
    model = Model(keep, *fit(x, y[learn], weight[learn], pairs))
    rest = np.flatnonzero(holdback)
    if len(rest) and len(np.unique(y[rest])) == 2:
        at, cols = features_of([texts[i] for i in rest], keep)
        z = model.bias + np.bincount(at, model.weights[cols], len(rest))
        model.slope, model.shift = calibrate(z, y[rest], weight[rest])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows whose crc32(doc_id as text) mod 4 is not 2; those of remainder 3 calibrate."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"), fold.alias("fold")).filter("toxic IN (0, 1) AND fold <> 2")
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * sample short rows
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").select("doc_id", "text", "toxic", "fold")
    # in one order, so that one input gives one model
    got = rows.toArrow().sort_by([(c, "ascending") for c in ("doc_id", "text", "toxic")])
    y = got.column("toxic").to_numpy().astype(np.float64)
    seen = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([total.get(k, 1) / seen[k] for k in (0, 1)])[y.astype(int)] if len(y) else y
    weight = weight / max(1e-9, weight.mean()) if len(y) else weight
    return train_model(got.column("text").to_pylist(), y, weight, got.column("fold").to_numpy() == 3)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, with held_out, score and predicted; named columns of docs give way."""
    docs = docs.drop("held_out", "score", "predicted")
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                found = shared.value.scores(*byte_rows(part.column(names.index("text"))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = StructType(list(docs.schema.fields)).add("score", "double").add("predicted", "integer")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return docs.mapInArrow(run, schema).select(*names, held.alias("held_out"), "score", "predicted")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("text")


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier predicts as toxic go.

    Null and empty texts are scored as a text without known words; null and repeated doc_ids are judged row by row. Without
    labels of both kinds nothing goes.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept_rows(docs, lambda d: score(d, model), "predicted = 0")
