"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit, a binary classifier tells the languages with a one from those with a zero.
A classifier is linear in the shares of a text's byte n-grams (2 to 4 bytes, ASCII in lower case and its non-letters
made spaces, hashed to DIMENSIONS): the log-odds of the n-grams among the languages of either side, each language
weighing the same. The bits' margins are decoded by loss: the language whose codeword has the least sum of log(1 +
exp(-margin)), bits weighed by how well they tell training texts apart. Where the best two are close the answer is
marked ambiguous.

Training texts are at most about `per_language` different texts of each language, those with the least hashes; a
language of fewer texts is learnt from all of them, whatever the size of the others. Ids play no part, and rows that
repeat a text of a language count once. n-gram counts of whole texts are added up per language. Codewords are all ways
to split up to 6 languages in two, or CODE_BITS random splits of more, drawn from a fixed seed for the greatest distance.

Null texts and those without a letter get `und`, score 0. Where nothing can be learnt every text does, as in an empty
table, which gives no rows. Null languages are not learnt from. A null doc_id is not held out. Rows that share a doc_id
are predicted each for itself. Between languages whose losses tie the first by code point is named, and the answer is
marked ambiguous. Long texts are read whole, and counted in bounded memory. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 1 << 14
#: Training texts of a language, about.
PER_LANGUAGE = 2000
CODE_BITS = 31
#: Difference of the best two probabilities below which an answer is ambiguous.
AMBIGUOUS = 0.2
#: Tasks that count the sample.
COUNTERS = 8
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = 1


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1; any two differ in about half their columns."""
    if n <= 6:
        splits = np.arange(1, max(2, 1 << max(n - 1, 0)))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    best, far = None, -1
    rng = np.random.default_rng(11)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, max(CODE_BITS, int(np.ceil(4 * np.log2(n))))))
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + 10_000 * np.eye(n, dtype=int)
        if apart.min() > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, apart.min()
    return best


def gram_counts(data: np.ndarray, offsets: np.ndarray, most: int = 64):
    """Hashed n-gram counts of the rows, `most` rows at a time."""
    rows = len(offsets) - 1
    fold = _FOLD[data].astype(np.uint32)
    for at in range(0, rows, most):
        end = min(at + most, rows)
        a, b = offsets[at], offsets[end]
        text = fold[a:b]
        left = np.repeat(offsets[at + 1 : end + 1] - a, np.diff(offsets[at : end + 1])) - np.arange(b - a)
        row = np.repeat(np.arange(end - at), np.diff(offsets[at : end + 1]))
        counts = np.zeros((end - at) * DIMENSIONS, np.float64)
        code = text.copy()
        for n in (2, 3, 4):
            if len(text) < n:
                break
            code = code[: len(text) - n + 1] | (text[n - 1 :] << np.uint32(8 * (n - 1)))
            place = ((code ^ np.uint32(n * 0x1F123BB5)) * np.uint32(2654435761)) >> np.uint32(18)
            inside = left[: len(code)] >= n
            counts += np.bincount(row[: len(code)][inside] * DIMENSIONS + place[inside], minlength=len(counts))
        yield at, counts.reshape(-1, DIMENSIONS)


def _count(batches):
    total: dict[str, np.ndarray] = {}
    squares: dict[str, int] = {}
    for part in common.chunks(batches):
        langs = np.array(part.column("lang").to_pylist(), object)
        for at, counts in gram_counts(*common.utf8(part.column("text"))):
            own = langs[at : at + len(counts)]
            for lang in set(own):
                total[lang] = total.get(lang, 0) + counts[own == lang].sum(axis=0)
                squares[lang] = squares.get(lang, 0) + int((own == lang).sum())
    for lang, counts in total.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang], "n": pa.array([squares[lang]], pa.int64()), "counts": pa.array([counts.tolist()])})


class Codes:
    """Codewords of the languages and the weights of every bit's classifier."""

    ambiguous = AMBIGUOUS

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        if not self.langs:
            return
        self.code = codewords(len(self.langs))
        shares = np.stack([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * DIMENSIONS) for x in self.langs])
        weights = []
        for bit in self.code.T:
            one, zero = shares[bit > 0], shares[bit < 0]
            weights.append(np.log(one.mean(axis=0)) - np.log(zero.mean(axis=0)) if len(one) and len(zero) else np.zeros(DIMENSIONS))
        self.weights = np.stack(weights, axis=1)
        margin = shares @ self.weights  # what an average text of each language gives
        self.centre = np.array([(margin[c > 0, i].min() + margin[c < 0, i].max()) / 2 if (c > 0).any() and (c < 0).any() else 0.0 for i, c in enumerate(self.code.T)])
        apart = np.array([(margin[c > 0, i].min() - margin[c < 0, i].max()) if (c > 0).any() and (c < 0).any() else 0.0 for i, c in enumerate(self.code.T)])
        self.scale = 8.0 / np.maximum(np.abs(apart), 1e-3)
        self.loss_weight = np.maximum(apart, 1e-3) / np.maximum(apart, 1e-3).sum()

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability and whether it is ambiguous, for rows of n-gram counts."""
        share = (counts @ self.weights) / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        margin = (share - self.centre) * self.scale
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :]) @ self.loss_weight
        odds = np.exp((loss.min(axis=1, keepdims=True) - loss) * len(self.loss_weight) / 2)
        odds /= odds.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1)
        second = np.sort(odds, axis=1)[:, -2] if odds.shape[1] > 1 else np.zeros(len(odds))
        top = odds.max(axis=1)
        return best, top, top - second < self.ambiguous


def has_letter(data: np.ndarray, offsets: np.ndarray, texts) -> np.ndarray:
    """Whether each row holds a letter, of any script."""
    edges = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    out = edges[offsets[1:]] > edges[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


def _predict(batches, model: Codes):
    for part in common.chunks(batches):
        data, offsets = common.utf8(part.column("text"))
        some = has_letter(data, offsets, part.column("text"))
        langs, scores, unsure = [], [], []
        for _, counts in gram_counts(data, offsets) if model.langs else ():
            best, score, close = model.decode(counts)
            langs += [model.langs[i] for i in best]
            scores.append(score)
            unsure.append(close)
        if not model.langs:
            langs, scores, unsure = [UNKNOWN] * len(some), [np.zeros(len(some))], [np.ones(len(some), bool)]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": part.column("doc_id"),
                "held_out": part.column("held_out"),
                "lang_pred": pa.array([x if ok else UNKNOWN for x, ok in zip(langs, some)], pa.string()),
                "score": pa.array(np.where(some, np.concatenate(scores), 0.0)),
                "ambiguous": pa.array(np.concatenate(unsure) | ~some),
            }
        )


def held_out(doc_id) -> "F.Column":
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(common.unsigned_crc32(doc_id) % 5 == 0, F.lit(False))


def sample(rows: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) to learn from: of every language its different texts, about `per_language` of them if there are more."""
    known = rows.filter("not held_out and lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    # Copies are one before anything of theirs is moved, so no text weighs more for being repeated. A row a language.
    sizes = known.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(float(per_language)) / F.col("n"), F.lit(1.0)) * (1 << 32)
    dealt = known.join(F.broadcast(sizes.select("lang", share.cast("long").alias("below"))), "lang").filter(F.shiftrightunsigned("h", 32) < F.col("below"))
    return dealt.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Codes:
    """From (doc_id, held_out, text, lang)."""
    counts: dict[str, np.ndarray] = {}
    for r in sample(rows, per_language).repartition(COUNTERS).mapInArrow(_count, "lang string, n long, counts array<double>").collect():
        counts[r["lang"]] = counts.get(r["lang"], 0) + np.array(r["counts"])
    return Codes(counts)


def predict(docs: DataFrame, per_language: int = PER_LANGUAGE, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(rows, per_language)
    model.ambiguous = ambiguous
    return rows.drop("lang").mapInArrow(lambda b: _predict(b, model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(common.table(spark, sf_dir, "documents"))
