"""Toxicity: a linear classifier with a counterfactual penalty on identity terms.

Features are indicators of hashed words and word pairs of a whole lower-cased text (marks inside and around a word left
out, so ``i-d-i-o-t!`` is a word).  For every labelled sentence that mentions a term of an identity group, the sentence is
written again with each other term of the group and with the group's neutral word; the squared change of the score is a
penalty beside the logistic loss, so a group's name can't carry what the insults around it carry, and neutral mentions
aren't taken for toxic ones.  An L1 penalty keeps the model to the words that matter, so that the length of a text
doesn't add up.  Fitting is an accelerated proximal gradient descent in numpy; margins become scores by Platt's sigmoid.

Fitting takes at most ``max_rows`` labelled documents (smallest hashes of their ids, one row for each id) as feature
indices to the driver.  All sentences of their whole texts count in the penalty; equal changes are counted on Spark, so the
driver gets each change of a sentence's features once, however many sentences and texts it stands in.  Scoring is a map
over all rows and whole texts with one table of 2**bits weights as broadcast.

Defined results: a null or empty text gets the score of the bias alone; a document with several labels counts with
their majority (a tie is 1), one with several texts with the least of them; null labels are left out; with one class
only, all rows score its smoothed share, (1 + n) / (2 + n), and without labels 0.5; repeated rows are scored one by one;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, stage
from .nbsvm import platt

BITS = 20
MENTIONS = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PAIR = np.uint64(xxhash.xxh64_intdigest("pair"))
SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")
MARKS = re.compile(r"[\W_]+")

# Parameter: groups of terms that may stand for each other; the first of a group is its neutral word.
IDENTITY_GROUPS: list[list[str]] = [
    ["believer", "muslim", "christian", "jew", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant", "mormon"],
    ["believers", "muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants",
     "mormons"],
    ["religious", "islamic", "jewish", "orthodox", "evangelical"],
    ["person", "man", "woman", "boy", "girl", "transgender", "nonbinary"],
    ["people", "men", "women", "boys", "girls"],
    ["orientation", "gay", "lesbian", "bisexual", "straight", "queer", "homosexual", "heterosexual"],
    ["ethnic", "black", "white", "asian", "african", "european", "hispanic", "latino", "latina", "arab", "native", "mexican",
     "chinese", "indian", "american", "german", "french", "turkish", "russian"],
    ["resident", "immigrant", "refugee", "migrant", "foreigner", "citizen"],
    ["residents", "immigrants", "refugees", "migrants", "foreigners", "citizens"],
    ["patient", "disabled", "deaf", "blind", "autistic", "paralyzed"],
    ["aged", "old", "elderly", "young", "teenage"],
]


def words(text: str | None) -> list[str]:
    return [w for w in (MARKS.sub("", part) for part in text.lower().split()) if w] if text else []


class Hashes(dict):
    """Part between white space -> hash of its word, or 0 where it holds none; emptied at ``most`` parts."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, part: str) -> int:
        if len(self) >= self.most:
            self.clear()
        w = MARKS.sub("", part)
        h = self[part] = (xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) or 1) if w else 0
        return h


def features(text: str | None, hashes: Hashes, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature indices of a whole text."""
    parts = text.lower().split() if text else []
    w = np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))
    w = w[w != 0]
    pairs = (w[:-1] * MULTIPLIER + w[1:]) ^ PAIR
    return np.unique((mix(np.concatenate([w, pairs])) >> np.uint64(64 - bits)).astype(np.uint32)).astype(np.int64)


def swaps(sentence: str, groups: list[list[str]] = IDENTITY_GROUPS) -> Iterator[str]:
    """The sentence with every mention of a group's term replaced, once for each other term of the group."""
    found = words(sentence)
    for group in groups:
        terms = set(group)
        here = terms & set(found)
        if here and here != {group[0]}:
            for other in group:
                if here != {other}:
                    yield " ".join(other if w in terms else w for w in found)


def counterfactuals(text: str | None, hashes: Hashes, groups: list[list[str]] = IDENTITY_GROUPS,
                    bits: int = BITS, most: int | None = MENTIONS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices lost, indices gained) of the swapped sentences of a text: of all of them if ``most`` is None, which is
    what ``fit`` asks for, or of the first ``most`` for a look at a text."""
    out = []
    every = {w for g in groups for w in g}
    seen = 0
    for sentence in SENTENCES.split(text) if text else ():
        if seen == most or every.isdisjoint(words(sentence)):
            continue
        seen += 1
        old = features(sentence, hashes, bits)
        for other in swaps(sentence, groups):
            new = features(other, hashes, bits)
            out.append((np.setdiff1d(old, new), np.setdiff1d(new, old)))
    return out


@dataclass
class Model:
    weight: np.ndarray  # float32, by feature index
    bias: float
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        return float(self.weight[x].sum(dtype=np.float64)) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -500, 500))))


class Sparse:
    """Rows of (column, value) pairs: products with a vector from either side."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray] | None, width: int):
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        self.rows, self.width = len(rows), width
        self.at = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), size)
        self.value = np.concatenate(values) if values else np.ones(len(self.at))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at] * self.value, self.rows)

    def transposed(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, v[self.row] * self.value, self.width)


def moves(changes: list[tuple[np.ndarray, np.ndarray]], width: int) -> Sparse:
    """(indices lost, indices gained) as rows of -1 and 1."""
    return Sparse([np.concatenate(c) for c in changes],
                  [np.concatenate((-np.ones(len(a)), np.ones(len(b)))) for a, b in changes], width)


def descend(x: Sparse, y: np.ndarray, share: np.ndarray, changes: Sparse, fairness: float, l1: float, l2: float,
            steps: int = 250) -> tuple[np.ndarray, float]:
    """Weights and bias of least loss: logistic, + fairness * mean squared change + l1 |w| + l2 |w|^2 / 2."""
    n = x.width
    average = fairness / max(changes.rows, 1)

    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        z, d = x.times(w) + b, changes.times(w)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        value = np.dot(share, np.logaddexp(0, z) - y * z) + average * np.dot(d, d) + l2 * np.dot(w, w) / 2
        g = share * (p - y)
        return value, x.transposed(g) + 2 * average * changes.transposed(d) + l2 * w, g.sum()

    w, b = np.zeros(n), 0.0
    u, c, t, rate = w, b, 1.0, 1.0
    for _ in range(steps):
        value, gw, gb = loss(u, c)
        while True:  # the step that the loss allows
            v = u - rate * gw
            v = np.sign(v) * np.maximum(np.abs(v) - rate * l1, 0.0)
            e = c - rate * gb
            dw, db = v - u, e - c
            if loss(v, e)[0] <= value + np.dot(gw, dw) + gb * db + (np.dot(dw, dw) + db * db) / (2 * rate) + 1e-12:
                break
            rate /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = max(np.abs(v - w).max(initial=0.0), abs(e - b))
        u, c = v + (t - 1) / t2 * (v - w), e + (t - 1) / t2 * (e - b)
        w, b, t, rate = v, e, t2, rate * 1.2
        if moved < 1e-5:
            break
    return w, float(b)


def fit_rows(rows: list[np.ndarray], y: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]] | Sparse, bits: int = BITS,
             fairness: float = 10.0, l1: float = 1e-3, l2: float = 1e-3, least: int = 3, times: np.ndarray | None = None) -> Model:
    """Fit on feature rows, 0/1 labels and the (lost, gained) indices of swapped sentences, as pairs or ``moves`` of them.
    ``times``: how often each change occurs, once if not given.

    Features of fewer than ``least`` rows are left out, but for those that a swap moves.  Every fifth row of each class
    is held back for the sigmoid.
    """
    y = np.asarray(y, np.float64)
    if len(set(y.tolist())) < 2:
        p = 0.5 if not len(y) else (1 + y.sum()) / (2 + len(y))
        return Model(np.zeros(1 << bits, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    often = np.bincount(np.concatenate(rows), minlength=1 << bits) >= least
    known = np.full(1 << bits, -1)
    known[often] = np.arange(often.sum())
    width = int(often.sum())
    small = [known[x][often[x]] for x in rows]
    moved = changes if isinstance(changes, Sparse) else moves(changes, 1 << bits)
    if times is not None:  # the mean over all occurrences
        fairness *= moved.rows / max(times.sum(), 1)
        moved.value = moved.value * np.sqrt(times)[moved.row]
    here = often[moved.at]
    moved.at, moved.row, moved.value, moved.width = known[moved.at[here]], moved.row[here], moved.value[here], width

    def machine(keep: np.ndarray) -> tuple[np.ndarray, float]:
        t = y[keep]
        share = np.where(t == 1, 0.5 / max(t.sum(), 1), 0.5 / max((1 - t).sum(), 1))  # both classes weigh the same
        return descend(Sparse([small[i] for i in keep], None, width), t, share, moved, fairness, l1, l2)

    order = np.argsort(y, kind="stable")
    back = order[::5]
    kept = np.setdiff1d(np.arange(len(y)), back)
    slope, offset = 4.0, 0.0
    if len(set(y[back].tolist())) == 2 and len(set(y[kept].tolist())) == 2:
        w, b = machine(kept)
        slope, offset = platt(np.array([w[small[i]].sum() + b for i in back]), y[back])
    w, b = machine(np.arange(len(y)))
    weight = np.zeros(1 << bits, np.float32)
    weight[often] = w
    return Model(weight, b, slope, offset)


def fit(df: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
        max_rows: int = 6000, groups: list[list[str]] = IDENTITY_GROUPS, fairness: float = 10.0, bits: int = BITS) -> Model:
    """Train on the documents of ``df`` that ``labels`` marks, at most ``max_rows`` of them (smallest id hashes)."""
    votes = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
             .agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("y")))
    ids = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # bounded by max_rows: it may be broadcast
    marked = (ids.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
              .select("text", "y"))

    marked = stage(marked, "toxicity")

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            x = pa.array([features(t.as_py(), hashes, bits).astype(np.int32) for t in b.column(0)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([x, b.column(1)], ["x", "y"])

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = Hashes(), pa.list_(pa.int32())
        for b in batches:
            for t in b.column(0):
                found = counterfactuals(t.as_py(), hashes, groups, bits, None)
                yield pa.RecordBatch.from_arrays([pa.array([c[k].astype(np.int32) for c in found], held) for k in (0, 1)],
                                                 ["lost", "gained"])

    got = marked.mapInArrow(indices, "x array<int>, y int").toArrow()
    folded = (marked.select("text").mapInArrow(changed, "lost array<int>, gained array<int>")
              .groupBy("lost", "gained").agg(F.count(F.lit(1)).alias("n")).toArrow().combine_chunks())
    rows = [np.asarray(x.values, np.int64) for x in got["x"]]
    return fit_rows(rows, got["y"].to_numpy(), _moves_of(folded, 1 << bits), bits, fairness, times=folded["n"].to_numpy())


def _moves_of(table: pa.Table, width: int) -> Sparse:
    """``moves`` of the columns ``lost`` and ``gained``."""
    out = Sparse([], None, width)
    out.rows = table.num_rows
    for name, sign in (("lost", -1.0), ("gained", 1.0)):
        lists = table[name].combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        out.at, out.row = np.concatenate((out.at, at)), np.concatenate((out.row, np.repeat(np.arange(out.rows), size)))
        out.value = np.concatenate((out.value, np.full(len(at), sign)))
    return out


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5,
          bits: int = BITS) -> DataFrame:
    """Columns ``keep`` plus score (0 to 1, higher for label 1) and predicted (1 if score >= threshold)."""
    held = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(text).cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", score double, predicted int"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, m = Hashes(), held.value
        for b in batches:
            s = np.array([m.score(features(t.as_py(), hashes, bits)) for t in b.column(0)], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             [*keep, "score", "predicted"])

    return rows.mapInArrow(scored, schema)
