"""Quality classifier: Naive Bayes support vectors over word and shape n-grams.

Features are indicators of hashed n-grams of a whole text: words (1 and 2), word shapes (1 to 3; letters, digits and
marks folded, so ``word###`` and ``other###`` agree) and runs of one repeated word.  Each indicator is scaled by its
log-count ratio ``r = log((p / sum p) / (q / sum q))`` of the two classes (add-one smoothed), each row is brought to
unit length, and a linear L2-regularised hinge-loss model is fitted by dual coordinate descent.  Margins become scores
by Platt's sigmoid, fitted on a held-back part of the training rows.

Fitting takes at most ``max_rows`` labelled rows, chosen by the smallest hashes of their ids, and runs in one task on
their feature indices, so that the driver holds the model alone; scoring is a map over all rows with two fixed-size weight tables (2**bits floats) as broadcast.

Defined results: a null or empty text has no features and gets the score of the bias alone; a document with several
labels counts with their majority (a tie is 1), one with several texts with the least of them; null labels are left out;
with one class only, all rows score its smoothed share, (1 + n) / (2 + n), and without labels 0.5; repeated rows are scored
one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

BITS = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SALTS = {k: np.uint64(xxhash.xxh64_intdigest(k)) for k in ("w1", "w2", "s1", "s2", "s3", "r2", "r3")}


class Folded(dict):
    """Code point -> its class: letters ``a`` or ``A``, digits ``0``, a mark as itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        k = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return k


FOLDED, RUNS = Folded(), re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Classes of the characters, runs of one class folded."""
    return RUNS.sub(r"\1", word.translate(FOLDED))


class Words(dict):
    """Word -> row of ``pairs`` (hash of the word, hash of its shape); emptied at ``most`` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most, self.pairs = most, np.empty((most + 1, 2), np.uint64)
        self.shapes: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.pairs[k] = self.hashes(word)
        return k

    def hashes(self, word: str) -> tuple[int, int]:
        s = shape(word)
        h = self.shapes.get(s)
        if h is None:
            if len(self.shapes) >= self.most:
                self.shapes.clear()
            h = self.shapes[s] = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
        return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")), h

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.most // 2 and len(self) + len(words) > self.most:
            self.clear()
        if len(words) > self.most:  # a text longer than the memory: without it
            both = np.array([self.hashes(w) for w in words], np.uint64)
        else:
            both = self.pairs[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]
        return both[:, 0], both[:, 1]


def features(text: str | None, words: Words, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature indices of a whole text."""
    parts = text.split() if text else []
    if not parts:
        return np.empty(0, np.int64)
    w, s = words.of(parts)
    grams = [w ^ SALTS["w1"], s ^ SALTS["s1"]]
    if len(w) > 1:
        two = w[1:] == w[:-1]
        grams += [(w[:-1] * MULTIPLIER + w[1:]) ^ SALTS["w2"], (s[:-1] * MULTIPLIER + s[1:]) ^ SALTS["s2"],
                  np.full(int(two.any()), SALTS["r2"])]
        if len(w) > 2:
            grams += [((s[:-2] * MULTIPLIER + s[1:-1]) * MULTIPLIER + s[2:]) ^ SALTS["s3"],
                      np.full(int((two[1:] & two[:-1]).any()), SALTS["r3"])]
    return np.unique((mix(np.concatenate(grams)) >> np.uint64(64 - bits)).astype(np.uint32)).astype(np.int64)


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratios, float32
    weight: np.ndarray  # of the scaled and normalised features, times the ratio: float32
    bias: float
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        if not len(x):
            return self.bias
        norm = float(np.sqrt(np.square(self.ratio[x], dtype=np.float64).sum()))
        return (float(self.weight[x].sum(dtype=np.float64)) / norm if norm else 0.0) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -500, 500))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, bits: int) -> np.ndarray:
    """Add-one smoothed log ratio of each feature's share among the indicators of class 1 and of class 0."""
    p, q = (1.0 + sum((np.bincount(rows[i], minlength=1 << bits) for i in np.flatnonzero(y == c)), np.zeros(1 << bits))
            for c in (1, 0))
    return np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray,
                            epochs: int = 30, tolerance: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss: one dual variable at a time, clipped to [0, cost]; the bias is a constant feature."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([np.dot(v, v) + 1.0 for v in values])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v, s = rows[i], values[i], y[i]
            gradient = s * (np.dot(w[x], v) + b) - 1.0
            if alpha[i] == 0:
                gradient = min(gradient, 0.0)
            elif alpha[i] == cost[i]:
                gradient = max(gradient, 0.0)
            if abs(gradient) > 1e-12:
                worst = max(worst, abs(gradient))
                new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
                step, alpha[i] = (new - alpha[i]) * s, new
                w[x] += step * v
                b += step
        if worst < tolerance:
            break
    return w, b


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope (at least a small positive one) and offset of the sigmoid, by Newton steps with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -50, 50)))
        g, h = p - t, p * (1 - p) + 1e-9
        grad = np.array([np.dot(g, margins), g.sum()]) + np.array([1e-3 * a, 0.0])
        hess = np.array([[np.dot(h, margins * margins) + 1e-3, np.dot(h, margins)], [np.dot(h, margins), h.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit_rows(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, cost: float = 1.0, seed: int = 7) -> Model:
    """Fit on feature rows and 0/1 labels; every fifth row of each class is held back for the sigmoid."""
    y = np.asarray(y)
    if len(set(y.tolist())) < 2:
        p = (1 + y.sum()) / (2 + len(y))
        return Model(np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))

    def machine(keep: np.ndarray) -> Model:
        part, labels = [rows[i] for i in keep], y[keep]
        ratio = log_count_ratio(part, labels, bits)
        values = []
        for x in part:
            v = ratio[x].astype(np.float64)
            values.append(v / (np.linalg.norm(v) or 1.0))
        share = np.where(labels == 1, 0.5 / max((labels == 1).mean(), 1e-9), 0.5 / max((labels == 0).mean(), 1e-9))
        w, b = dual_coordinate_descent(part, values, np.where(labels == 1, 1.0, -1.0), 1 << bits, cost * share, seed=seed)
        return Model(ratio, (w * ratio).astype(np.float32), b, 1.0, 0.0)

    order = np.argsort(y, kind="stable")
    back = order[::5]
    kept = np.setdiff1d(np.arange(len(y)), back)
    if len(set(y[back].tolist())) == 2 and len(set(y[kept].tolist())) == 2:
        first = machine(kept)
        slope, offset = platt(np.array([first.margin(rows[i]) for i in back]), y[back])
    else:
        slope, offset = 4.0, 0.0
    model = machine(np.arange(len(y)))
    model.slope, model.offset = slope, offset
    return model


def fit(df: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
        max_rows: int = 6000, bits: int = BITS) -> Model:
    """Train on the documents of ``df`` that ``labels`` marks, at most ``max_rows`` of them (smallest id hashes)."""
    votes = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
             .agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("y")))
    ids = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # bounded by max_rows: it may be broadcast
    # one text for each id, so that max_rows bounds the rows
    marked = ids.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, done = Words(), TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(np.arange(done, done + b.num_rows), pa.int64()),
                 pa.array([features(t.as_py(), words, bits).astype(np.int32) for t in b.column(0)], pa.list_(pa.int32())),
                 b.column(1)], ["part", "nth", "x", "y"])
            done += b.num_rows

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        y: list[np.ndarray] = []
        for b in batches:
            rows += [np.asarray(x.values, np.int64) for x in b.column(2)]
            y.append(b.column(3).to_numpy())
        m = fit_rows(rows, np.concatenate([*y, np.empty(0, np.int32)]), bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.ratio.tobytes()]), pa.array([m.weight.tobytes()]), *[pa.array([v], pa.float64()) for v in (m.bias, m.slope, m.offset)]],
            ["ratio", "weight", "bias", "slope", "offset"])

    # max_rows at most, in one task in a fixed order; a task without rows answers for no labels at all
    ordered = marked.mapInArrow(indices, "part int, nth bigint, x array<int>, y int").repartition(1).sortWithinPartitions("part", "nth")
    got = ordered.mapInArrow(fitted, "ratio binary, weight binary, bias double, slope double, offset double").first()
    if got is None:
        return fit_rows([], np.empty(0, np.int32), bits)
    return Model(np.frombuffer(got["ratio"], np.float32), np.frombuffer(got["weight"], np.float32), *map(float, got[2:]))


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3,
          bits: int = BITS) -> DataFrame:
    """Columns ``keep`` plus score (0 to 1, higher for label 1) and predicted (1 if score >= threshold)."""
    held = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(text).cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", score double, predicted int"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m = Words(), held.value
        for b in batches:
            s = np.array([m.score(features(t.as_py(), words, bits)) for t in b.column(0)], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             [*keep, "score", "predicted"])

    return rows.mapInArrow(scored, schema)


def keep_accepted(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, bits: int = BITS) -> DataFrame:
    """The rows of ``df`` with a score of ``threshold`` or more; all columns stay."""
    held = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m = Words(), held.value
        for b in batches:
            yield b.filter(pa.array([m.score(features(t.as_py(), words, bits)) >= threshold for t in b.column(at)], pa.bool_()))

    return df.mapInArrow(accepted, df.schema)
