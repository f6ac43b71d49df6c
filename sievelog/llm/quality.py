"""A quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics come from a text's bytes alone; labels, language, source and id are no inputs. Shares are smoothed towards
typical values with the weight of SMOOTH characters or words, so that a short text is judged by little evidence, and
then taken to a log scale. Each class of the labelled documents gets its mean and its covariance. That of a class is
drawn towards the pooled one with the weight of POOLED rows, so that a class of few rows, or one, is judged by what all
rows show, and then shrunk towards a multiple of the identity. Both come from sums that tasks add up, a few hundred
numbers for each class; they are taken over at most about `per_class` labelled documents of each class, those with the
least hashes of their ids (a bound on the fit; every document is scored). A score is the logistic of the difference of
log densities plus log priors; the Mahalanobis terms use Cholesky factors made once.

Null text counts as empty; an empty text is scored like any other, a long one whole. Labels that are null are left out.
An id that is labelled several times counts once for each class; rows that share an id are scored each for itself, and
all learnt from. A null doc_id is not held out. Where a class has no labelled documents, all scores are 0.5, which
predicts 1. A score of exactly 0.5 predicts 1. Empty tables give no rows. Extra columns are ignored by `score` and kept
by `keep_good`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Characters or words of typical text that every share starts with.
SMOOTH = 40.0
#: Bytes of a word that count towards its length: a key or an address says little about the prose around it.
LONGEST = 16
#: Share of the identity in a class covariance.
SHRINKAGE = 0.25
#: Log-density differences are divided by this before the logistic, as the statistics aren't quite Gaussian.
TEMPERATURE = 2.0

_UPPER, _LOWER, _DIGIT, _MARK, _PAUSE, _HIGH = (np.zeros(256, np.uint8) for _ in range(6))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = 1
_HIGH[128:] = 1
_PAUSE[list(b".,;:?'\"()-")] = 1
_MARK[33:127] = 1
_MARK[(_UPPER + _LOWER + _DIGIT + _PAUSE) > 0] = 0
#: Typical shares that smoothing leans to: capitals, pauses, marks, repeated neighbours, repeated words, short and long words.
_TYPICAL = {"upper": 0.02, "pause": 0.02, "mark": 0.01, "echo": 0.005, "again": 0.2, "short": 0.2, "long": 0.05, "capital": 0.1, "bare": 0.01}
#: Rows that the pooled covariance counts for in that of a class.
POOLED = 24.0
#: Labelled documents of a class to learn from, about.
PER_CLASS = 50_000
FEATURES = [*_TYPICAL, "word_length", "spread", "words"]


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between edges."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[edges[1:]] - total[edges[:-1]]).astype(np.float64)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for every text."""
    starts, ends, first = common.word_bounds(data, offsets)
    rows = len(offsets) - 1
    size, n = np.diff(offsets).astype(np.float64), np.diff(first).astype(np.float64)
    row = np.repeat(np.arange(rows), np.diff(first))
    lower = np.where(_UPPER[data] > 0, data + np.uint8(32), data)
    hashes = common.Spans(lower).hash(starts, ends)
    length = np.minimum(ends - starts, LONGEST)
    echo = np.zeros(len(starts), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((hashes, row))
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    capital = _UPPER[data[starts]] > 0
    letters = np.concatenate([[0], np.cumsum(_UPPER[data] + _LOWER[data] + _HIGH[data] + _DIGIT[data], dtype=np.int64)])
    bare = letters[ends] == letters[starts]
    shares = {
        "upper": (_sums(_UPPER[data], offsets), size),
        "pause": (_sums(_PAUSE[data], offsets), size),
        "mark": (_sums(_MARK[data], offsets), size),
        "echo": (_sums(echo, first), n),
        "again": (_sums(again, first), n),
        "short": (_sums(length <= 2, first), n),
        "long": (_sums(length >= 14, first), n),
        "capital": (_sums(capital, first), n),
        "bare": (_sums(bare, first), n),
    }
    out = [np.log((k + SMOOTH * _TYPICAL[name]) / (of + SMOOTH)) for name, (k, of) in shares.items()]
    mean = (_sums(length, first) + SMOOTH * 6.0) / (n + SMOOTH)
    square = (_sums(length * length, first) + SMOOTH * 46.0) / (n + SMOOTH)
    return np.stack([*out, np.log(mean), np.log(np.maximum(square - mean * mean, 0.1)), np.log1p(n)], axis=1)


def _statistics(batches):
    for part in common.chunks(batches):
        x = statistics(*common.utf8(part.column("text")))
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], [*(c for c in part.schema.names if c != "text"), "x"])


def _moments(batches):
    """One row a class: its label, then rows, sums and sums of products."""
    d = len(FEATURES)
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, d)
        label = batch.column("quality").to_numpy()
        for c in np.unique(label):
            own = x[label == c]
            sums = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
            total[int(c)] = total.get(int(c), 0) + sums
    for c, sums in total.items():
        yield pa.RecordBatch.from_pydict({"quality": pa.array([c], pa.int32()), "m": pa.array([sums.tolist()])})


class Discriminant:
    """Two Gaussians, each with its own shrunken covariance."""

    def __init__(self, moments: dict[int, np.ndarray], shrinkage: float = SHRINKAGE):
        d = len(FEATURES)
        self.parts = []
        if len(moments) < 2:
            return
        whole = sum(m[0] for m in moments.values())
        means = {c: m[1 : d + 1] / m[0] for c, m in moments.items()}
        scatter = {c: m[d + 1 :].reshape(d, d) - m[0] * np.outer(means[c], means[c]) for c, m in moments.items()}
        pooled = (sum(scatter.values()) + np.eye(d)) / (whole + 1)  # one row's worth of the identity, where there is little else
        for c in (0, 1):
            n = moments[c][0]
            cov = (scatter[c] + POOLED * pooled) / (n + POOLED)
            cov = (1 - shrinkage) * cov + (shrinkage * np.trace(cov) / d + 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.parts.append((means[c], np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(n / whole)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), 0.5)
        density = []
        for mean, inverse, logdet, prior in self.parts:
            z = (x - mean) @ inverse.T
            density.append(prior - logdet - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -500, 500)))


def marked(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, quality) to learn from: no held-out ids, each once a class, about `per_class` of a class if there are more."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    sizes = known.groupBy("quality").agg(F.count("*").alias("n"))  # two rows
    share = F.least(F.lit(float(per_class)) / F.col("n"), F.lit(1.0)) * (1 << 32)
    below = sizes.select("quality", share.cast("long").alias("below"))
    return known.join(F.broadcast(below), "quality").filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 32) < F.col("below")).select("doc_id", "quality")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Discriminant:
    """From (doc_id, text) and (doc_id, quality). The labels are bounded and so broadcast; texts stay where they are read."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = known.join(F.broadcast(marked(labels, per_class)), "doc_id").select("quality", "text")
    # In one step: two in a row would hold two Python workers for every task.
    sums = rows.mapInArrow(lambda batches: _moments(_statistics(batches)), "quality int, m array<double>")
    d = len(FEATURES)
    added = sums.groupBy("quality").agg(*(F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(1 + d + d * d))).collect()
    return Discriminant({r[0]: np.array(r[1:], float) for r in added})


def held_out(doc_id) -> "F.Column":
    """Whether a row's label is kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(common.unsigned_crc32(doc_id) % 3 == 1, F.lit(False))


def _score(batches, model: Discriminant, threshold: float):
    for part in common.chunks(batches):
        scores = model.scores(statistics(*common.utf8(part.column("text"))))
        names = [c for c in part.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*names, "score", "predicted"])


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, by a model of the labelled rows that aren't held out."""
    common.ship(docs.sparkSession)
    model = fit(docs, labels, per_class)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _score(b, model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def _keep(batches, model: Discriminant, threshold: float):
    for part in common.chunks(batches):
        good = model.scores(statistics(*common.utf8(part.column("text")))) >= threshold
        yield part.filter(pa.array(good))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, whole. Their texts are not moved: they are scored where they are read."""
    common.ship(docs.sparkSession)
    model = fit(docs, labels, per_class)
    return docs.mapInArrow(lambda b: _keep(b, model, threshold), T.StructType(docs.schema.fields))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
