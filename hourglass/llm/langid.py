"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A word is its own feature and those of its character 2- to 4-grams with marked ends, hashed into ``buckets`` rows of an
embedding.  A text is the average over all features of all its words; a linear layer gives class scores.  Fitting takes
at most ``max_rows`` labelled texts (smallest hashes of their ids), collected as feature counts to the driver.  A part of
them is held back to fit the temperature of the softmax and the confidence below which a prediction would be rejected.

The average is linear, so a text's class scores are the mean of per-feature class scores: prediction broadcasts one
buckets x classes table, sums it once for each different word and adds up words.

Defined results: ``und`` with score 0 for a null text, one without a letter, or (with ``reject``) one below the
calibrated confidence; ties go to the first language in sorted order; repeated rows are predicted one by one; rows with
a null language or text train nothing; of several texts of one id and language the least one trains; without labelled
rows every prediction is ``und`` with score 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

LETTER = regex.compile(r"\p{L}")  # the same letters as in fit; number signs are none
UNDETERMINED = "und"
BITS, DIMENSIONS, LEAST_STEPS = 18, 16, 300
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(256, MULTIPLIER))  # a word is told apart by its first 255 characters and the sum of the rest


def subwords(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its word) of every feature: the word and its 2- to 4-grams, ``<`` and ``>`` marking its ends."""
    code = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - np.repeat(first, size)
    whole = np.add.reduceat(code * POWERS[np.minimum(place, len(POWERS) - 1)], first)
    hashes, owners = [whole], [np.arange(len(words))]
    for n in (2, 3, 4):
        h = np.full(max(len(code) - n + 1, 0), np.uint64(n))
        for i in range(n):
            h = h * MULTIPLIER + code[i:len(h) + i]
        inside = word[:len(h)] == word[n - 1:][:len(h)]
        hashes.append(h[inside])
        owners.append(word[:len(h)][inside])
    return (mix(np.concatenate(hashes)) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def counted(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    words = Counter(words_of(text))
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bucket, owner = subwords(list(words), bits)
    n = np.fromiter(words.values(), np.int64, len(words))[owner]
    distinct, back = np.unique(bucket, return_inverse=True)
    return distinct, np.bincount(back, n).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x classes: class scores of a feature
    bias: np.ndarray
    temperature: float
    least: float  # calibrated confidence for rejection

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: list[str], bits: int = BITS, dimensions: int = DIMENSIONS,
          epochs: int = 6, rate: float = 0.5, seed: int = 11) -> Model:
    """Stochastic gradient descent over (buckets, counts) rows; the rate falls linearly to zero.

    Few rows are gone over more often than ``epochs``, so that there are ``LEAST_STEPS`` steps.
    """
    languages = sorted(set(y))
    if not languages:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    known = np.array([languages.index(k) for k in y])
    shares = [n / max(n.sum(), 1) for _, n in rows]
    embedding = rng.uniform(-1 / dimensions, 1 / dimensions, (1 << bits, dimensions))
    weight, bias = np.zeros((dimensions, len(languages))), np.zeros(len(languages))
    order = rng.permutation(len(rows))
    back = order[: len(order) // 5] if len(order) >= 20 else order[:0]
    kept = order[len(back):]
    epochs = max(epochs, -(-LEAST_STEPS // max(len(kept), 1)))
    step, steps = 0, epochs * len(kept)
    for _ in range(epochs):
        for i in rng.permutation(kept):
            lr = rate * (1 - step / steps)
            step += 1
            x, s = rows[i][0], shares[i]
            hidden = s @ embedding[x]
            z = hidden @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[known[i]] -= 1.0
            back_hidden = weight @ p
            weight -= lr * np.outer(hidden, p)
            bias -= lr * p
            # the share of a feature is small: the rate of the embeddings is relative to the features of a row
            embedding[x] -= lr * len(x) ** 0.5 * np.outer(s, back_hidden)
    model = Model(languages, (embedding @ weight).astype(np.float32), bias, 1.0, 0.0)
    if len(back):
        mean = np.array([shares[i] @ model.table[rows[i][0]].astype(np.float64) for i in back])
        truth = known[back]

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(model.probabilities(mean)[np.arange(len(back)), truth] + 1e-12).mean()

        model.temperature = min((float(t) for t in np.geomspace(0.05, 20, 121)), key=loss)
        p = model.probabilities(mean)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
        model.least = float(right[len(right) // 100]) if len(right) else 0.0  # keeps 99 of 100 right predictions
    return model


def fit(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_rows: int = 3000,
        bits: int = BITS) -> Model:
    """Learn from at most ``max_rows`` rows of ``df`` that have a language and a letter (smallest id hashes)."""
    rows = df.select(F.col(doc_id).alias("_id"), F.col(lang).cast("string").alias("y"), F.col(text).cast("string").alias("t"))
    rows = rows.where(F.col("y").isNotNull() & F.col("t").rlike(r"\p{L}"))
    ids = (rows.select("_id", "y").distinct()
           .orderBy(F.xxhash64("_id"), "_id", "y").limit(max_rows))  # bounded by max_rows: it may be broadcast
    # one text for each id and language, so that max_rows bounds the rows
    chosen = rows.join(F.broadcast(ids), ["_id", "y"], "left_semi").groupBy("_id", "y").agg(F.min("t").alias("t")).select("t", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [counted(t.as_py() or "", bits) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32) for x, _ in both], pa.list_(pa.int32())),
                                              pa.array([n.astype(np.int32) for _, n in both], pa.list_(pa.int32())),
                                              b.column(1)], ["x", "n", "y"])

    got = chosen.mapInArrow(features, "x array<int>, n array<int>, y string").toArrow()
    return train([(np.asarray(x.values, np.int64), np.asarray(n.values, np.float64))
                  for x, n in zip(got["x"], got["n"], strict=True)], got["y"].to_pylist(), bits)


class WordScores(dict):
    """Word -> row of ``sums``: class scores summed over its features, and their number.  Emptied at ``most`` words."""

    def __init__(self, model: Model, bits: int = BITS, most: int = 300_000):
        super().__init__()
        self.model, self.bits, self.most = model, bits, most
        self.sums = np.empty((most, len(model.languages) + 1))

    def learn(self, words: list[str]) -> None:
        bucket, owner = subwords(words, self.bits)
        at = len(self)
        for k in range(len(self.model.languages)):
            self.sums[at:at + len(words), k] = np.bincount(owner, self.model.table[bucket, k], len(words))
        self.sums[at:at + len(words), -1] = np.bincount(owner, minlength=len(words))
        self.update(zip(words, range(at, at + len(words)), strict=True))

    def mean(self, text: str) -> np.ndarray:
        """Mean class scores over all features of a text with at least one word."""
        total, words = np.zeros(self.sums.shape[1]), words_of(text)
        for at in range(0, len(words), self.most // 4):
            part = words[at:at + self.most // 4]
            new = [w for w in set(part) if w not in self]
            if len(self) + len(new) > self.most:
                self.clear()
                new = list(set(part))
            if new:
                self.learn(new)
            total += self.sums[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0)
        return total[:-1] / total[-1]


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), reject: bool = False,
            bits: int = BITS) -> DataFrame:
    """Columns ``keep`` plus lang_pred and score, the calibrated probability of the predicted language."""
    held = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(text).cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", lang_pred string, score double"

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        scores = WordScores(m, bits)
        for b in batches:
            langs, sure = [], []
            for t in b.column(0):
                s = t.as_py()
                p = m.probabilities(scores.mean(s)) if m.languages and s and LETTER.search(s) else None
                k = int(p.argmax()) if p is not None else 0
                none = p is None or (reject and p[k] < m.least)
                langs.append(UNDETERMINED if none else m.languages[k])
                sure.append(0.0 if none else float(p[k]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs, pa.string()), pa.array(sure, pa.float64())],
                                             [*keep, "lang_pred", "score"])

    return rows.mapInArrow(predicted, schema)
