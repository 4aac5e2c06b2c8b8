"""Logistic regression by Newton steps from distributed Gram sums, with its inference table.  [K14 K15]

Each step is one pass: a task adds up ``X'WX``, ``X'(y - p)`` and the log likelihood of its rows, one number a cell, the
cells are summed over all tasks by a shuffle of at most (terms + 2)^2 / 2 keys, and the driver solves a system of as many
equations as there are terms.  The rows never leave their tasks and any number of them can take part.

What the plain fit can't estimate is told apart by name instead of spoiling the rest: a term that is a linear combination
of those before it is ``aliased``; a term all of whose non-zero rows have one sign and one label is ``separated`` (its
coefficient has no finite optimum; those rows are predicted with certainty, so they leave the fit with the term); if some
combination of terms separates the labels, every remaining term is ``separated``.  Such terms have null estimates.

Rows with a null or NaN feature or label are left out; no rows left give null estimates, ``no rows``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import complete

INTERCEPT = "intercept"


def gram_sums(df: DataFrame, label: str, terms: Sequence[str], beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(X'WX, X'(y - p), log likelihood, rows) at ``beta``."""
    k = len(terms)
    columns = [F.lit(1.0) if t == INTERCEPT else F.col(f"`{t}`").cast("double") for t in terms]
    rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)], F.col(label).cast("double").alias("y"))
    upper = np.triu_indices(k)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]) + k + 2)
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
            y = b.column(k).to_numpy(zero_copy_only=False)
            z = x @ beta
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            total += np.concatenate([((x * (p * (1 - p))[:, None]).T @ x)[upper], x.T @ (y - p),
                                     [(y * z - np.logaddexp(0, z)).sum(), len(y)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], ["cell", "value"])

    got = rows.mapInArrow(add_up, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(len(upper[0]) + k + 2)
    for r in got:
        total[r["cell"]] = r["value"]
    h = np.zeros((k, k))
    h[upper] = total[:len(upper[0])]
    return h + np.triu(h, 1).T, total[len(upper[0]):-2], float(total[-2]), int(total[-1])


def independent(gram: np.ndarray, least: float = 1e-9) -> list[int]:
    """Columns that are no combination of those before them, by Cholesky in the order given."""
    kept: list[int] = []
    for i in range(len(gram)):
        rest = gram[i, i]
        if kept:
            rest -= gram[i, kept] @ np.linalg.solve(gram[np.ix_(kept, kept)], gram[kept, i])
        if gram[i, i] > 0 and rest > least * gram[i, i]:
            kept.append(i)
    return kept


def one_sided(df: DataFrame, label: str, terms: Sequence[str]) -> dict[str, int]:
    """Terms all of whose non-zero rows have one sign and one label, with that label (one aggregate)."""
    on = {t: F.col(f"`{t}`").cast("double") != 0 for t in terms}
    got = df.agg(*[a for i, t in enumerate(terms) for a in (
        F.min(F.when(on[t], F.col(label))).alias(f"l{i}"), F.max(F.when(on[t], F.col(label))).alias(f"h{i}"),
        F.min(F.col(f"`{t}`").cast("double")).alias(f"a{i}"), F.max(F.col(f"`{t}`").cast("double")).alias(f"b{i}"))]).first()
    return {t: int(got[f"l{i}"]) for i, t in enumerate(terms)
            if got[f"l{i}"] is not None and got[f"l{i}"] == got[f"h{i}"] and (got[f"a{i}"] >= 0 or got[f"b{i}"] <= 0)}


@dataclass
class Logit:
    """Estimates by term; ``certain``: separated terms with the label of their non-zero rows."""
    coef: dict[str, float]
    error: dict[str, float]
    status: dict[str, str]
    certain: dict[str, int]

    def table(self, df: DataFrame, digits: int = 4) -> DataFrame:
        """(term, coef, std_err, z, p_value, status) in the order of the terms."""
        rows = []
        for t, status in self.status.items():
            c, e = self.coef.get(t), self.error.get(t)
            z = c / e if c is not None and e else None
            p = math.erfc(abs(z) / math.sqrt(2)) if z is not None else None
            rows.append((t, *[round(v, digits) if v is not None else None for v in (c, e, z, p)], status))
        return df.sparkSession.createDataFrame(rows, "term string, coef double, std_err double, z double, p_value double, status string")

    def probability(self) -> Column:
        """Fitted probability of label 1; null where nothing could be fitted."""
        out = F.lit(None).cast("double")
        if self.coef:
            z = sum((F.lit(c) * (F.lit(1.0) if t == INTERCEPT else F.col(f"`{t}`").cast("double")) for t, c in self.coef.items()), F.lit(0.0))
            out = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        for t, y in reversed(self.certain.items()):
            out = F.when(F.col(f"`{t}`").cast("double") != 0, float(y)).otherwise(out)
        return out


def fit(df: DataFrame, label: str, features: Sequence[str], intercept: bool = False, steps: int = 60, tolerance: float = 1e-9) -> Logit:
    """[K14] Unregularised fit; ``df`` is read once a step and should be a written table."""
    terms = [*features, INTERCEPT] if intercept else list(features)
    status = dict.fromkeys(terms, "ok")
    rows, certain = complete(df, [*features, label]), {}
    while found := one_sided(rows, label, [t for t in terms if status[t] == "ok" and t != INTERCEPT]):
        t, y = next(iter(found.items()))  # one after the other: the next may owe its one-sidedness to the same rows
        certain[t] = y
        status[t] = "separated"
        rows = rows.where(F.col(f"`{t}`").cast("double") == 0)
    live = [t for t in terms if status[t] == "ok"]
    gram, gradient, value, n = gram_sums(rows, label, live, np.zeros(len(live))) if live else (np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    if not n:
        return Logit({}, {}, {t: s if s != "ok" else "no rows" for t, s in status.items()}, certain)
    kept = independent(gram)
    for i, t in enumerate(live):
        if i not in kept:
            status[t] = "aliased"
    live = [live[i] for i in kept]
    beta = np.zeros(len(live))
    h, g = gram[np.ix_(kept, kept)], gradient[kept]
    for _ in range(steps):
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        share = 1.0
        while True:
            new = beta + share * step
            h2, g2, value2, _ = gram_sums(rows, label, live, new)
            if value2 >= value - 1e-9 * abs(value) or share < 1e-4:
                break
            share /= 2
        beta, h, g, value = new, h2, g2, value2
        if np.abs(share * step).max(initial=0.0) < tolerance * (1 + np.abs(beta).max(initial=0.0)):
            break
        if -value < 1e-8 * n:  # all rows predicted with certainty
            break
    else:
        value = 0.0
    if live and (-value < 1e-8 * n or np.linalg.cond(h) > 1e14):
        status |= dict.fromkeys(live, "separated")
        return Logit({}, {}, status, certain)
    error = np.sqrt(np.diag(np.linalg.inv(h))) if live else []
    return Logit(dict(zip(live, map(float, beta), strict=True)), dict(zip(live, map(float, error), strict=True)), status, certain)
