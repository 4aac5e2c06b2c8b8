"""Near-duplicate vectors by spherical-cap filters: structured product codes, list decoding, join and verification.

A random rotation is followed by a cut into ``BLOCKS`` parts, each with a small code of random directions; a filter is one
code word for each part, so ``t`` words a part make ``t ** BLOCKS`` filter directions.  A vector belongs to every filter
whose inner product with it exceeds a cap height; list decoding finds them all from the parts' scores without going
through the filters.  The height lets a vector into ``per_vector`` filters on average, and the number of filters follows
the number of vectors, so a filter holds about as many unrelated vectors at any size.  ``codes`` independent rotations
are used.

1. One map writes each vector's double values, its filters and its components rounded to a byte each.  Equal vectors are
   folded into one representative with a number of copies.
2. Vectors that share a filter are compared by their bytes, which gives a spanning forest for each filter, never its pairs.
   The bytes bound the angle to the vector itself, so no linked pair is passed over, and what else passes lies within the
   rounding of the threshold: unrelated vectors make no components.  Filters with more than ``limit`` vectors are compared
   in pairs of blocks.
3. The forests' components are verified exactly, cosine in double precision, in pairs of blocks: links are counted, and
   the components of the true links are the classes.

Defined results: null or zero vectors and vectors with null or non-finite components link with nothing and are classes of
their own; vectors of different lengths never link; repeated rows are copies of each other; ties in the threshold link;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import forest, in_blocks, in_groups
from .common import stage
from .components import connected_components

BLOCKS, BLOCK = 3, 512


def cap(d: int) -> tuple[np.ndarray, np.ndarray]:
    """(angle, share of the unit sphere in ``d`` dimensions within that angle of a direction)."""
    angle = np.linspace(0, np.pi, 200_001)
    mass = np.cumsum(np.sin(angle) ** (d - 2)) if d > 1 else np.where(angle < np.pi, 0.5, 1.0)
    return angle, mass / mass[-1]


class Code:
    """Filters of one rotation for vectors of length ``d``.

    Caps are never narrower than the angle of ``threshold``, else short vectors, which need few directions, would share
    none; there are then fewer filters.
    """

    def __init__(self, d: int, filters: int, per_vector: float, threshold: float, seed: int):
        rng = np.random.default_rng([seed, d])
        blocks = BLOCKS if d >= 3 * BLOCKS else 1
        angle, share = cap(d)
        at = max(np.searchsorted(share, min(per_vector / filters, 0.5)), np.searchsorted(angle, np.arccos(threshold)))
        self.height = float(np.cos(angle[at]))
        self.words = max(2, int(np.ceil(min(filters, per_vector / share[at]) ** (1 / blocks))))
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        self.parts = np.array_split(np.arange(d), blocks)
        self.codes = []
        for p in self.parts:
            c = rng.normal(size=(self.words, len(p)))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(blocks))

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Numbers of all filters that each row exceeds, and of its best one."""
        turned = unit @ self.rotation
        scores = [turned[:, p] @ c.T for p, c in zip(self.parts, self.codes, strict=True)]
        return [self._list([s[k] for s in scores]) for k in range(len(unit))]

    def _list(self, scores: list[np.ndarray]) -> np.ndarray:
        number, total = np.zeros(1, np.int64), np.zeros(1)
        rest = sum(s.max() for s in scores)
        best = 0
        for s in scores:
            best = best * self.words + int(s.argmax())
            rest -= s.max()
            both = total[:, None] + s[None, :]
            i, j = np.nonzero(both + rest >= self.height)  # what the parts to come can't lift any more goes
            number, total = number[i] * self.words + j, both[i, j]
        return number if len(number) else np.array([best])


@lru_cache(maxsize=64)
def code(d: int, filters: int, per_vector: float, threshold: float, seed: int) -> Code:
    return Code(d, filters, per_vector, threshold, seed)


def rounded(unit: np.ndarray) -> np.ndarray:
    """Rows scaled so that the largest component is 127, as bytes."""
    return np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)


def may_link(q: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of the pairs whose vectors may reach the threshold, from their rounded rows: all that do are among them.

    Rounding moves a row of length ``r`` by at most sqrt(d) / 2, which turns it by the arc sine of sqrt(d) / 2r at most.
    """
    x = q.astype(np.float64)
    length = np.linalg.norm(x, axis=1)
    x /= length[:, None]
    turn = np.arcsin(np.minimum(1.0, np.sqrt(q.shape[1]) / (2 * length)))
    most = np.arccos(threshold) + turn[:, None] + turn[None, :] + 1e-6
    return x @ x.T >= np.cos(np.minimum(most, np.pi)) - 1e-9


def described(df: DataFrame, vec_id: str, vector: str, filters: int, per_vector: float, threshold: float,
              codes: int) -> DataFrame:
    """(rid, vec_id, f1, f2, d, vector, bytes, filters) of every row; d is 0 for vectors that link with nothing."""
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    signed = lambda v: v - (1 << 64) if v >> 63 else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 36, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                vectors = []
                for v in b.column(1):
                    x = None if not v.is_valid or v.values.null_count else np.asarray(v.values, np.float64)
                    # the scale is taken out first, so the norm of a finite vector neither overflows nor vanishes
                    top = np.abs(x).max(initial=0.0) if x is not None else 0.0
                    vectors.append(x / top if 0 < top < np.inf else None)
                rid = [first + done + k for k in range(len(vectors))]
                done += len(vectors)
                f = [xxhash.xxh128_intdigest(x.tobytes()) if x is not None else r for x, r in zip(vectors, rid, strict=True)]
                found: list = [[] for _ in vectors]
                small: list = [b""] * len(vectors)
                for d in {len(x) for x in vectors if x is not None}:
                    own = [k for k, x in enumerate(vectors) if x is not None and len(x) == d]
                    unit = np.array([vectors[k] for k in own])
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    for seed in range(codes):
                        for k, numbers in zip(own, code(d, filters, per_vector, threshold, seed).decode(unit), strict=True):
                            found[k] += [signed(xxhash.xxh64_intdigest(b"%d,%d,%d" % (d, seed, n))) for n in numbers.tolist()]
                    for k, q in zip(own, rounded(unit), strict=True):
                        small[k] = q.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid, pa.int64()), b.column(0), pa.array([signed(x >> 64) if v is not None else -1 for x, v in zip(f, vectors, strict=True)], pa.int64()),
                     pa.array([signed(x & ((1 << 64) - 1)) for x in f], pa.int64()),
                     pa.array([0 if x is None else len(x) for x in vectors], pa.int64()),
                     pa.array([b"" if x is None else x.tobytes() for x in vectors], pa.binary()), pa.array(small, pa.binary()),
                     pa.array(found, pa.list_(pa.int64()))],
                    ["rid", "vec_id", "f1", "f2", "d", "vector", "bytes", "filters"])

    return stage(rows.mapInArrow(run, f"rid bigint, vec_id {kind}, f1 bigint, f2 bigint, d bigint, vector binary, "
                                      "bytes binary, filters array<bigint>"), "vectors")


def candidate_edges(reps: DataFrame, threshold: float, limit: int) -> DataFrame:
    """(a, b): spanning forests of the vectors of a filter that may be linked."""
    here = reps.select("rid", F.explode("filters").alias("node"))  # a vector lists a filter once
    count = stage(here.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "caps")
    found = here.join(count, "node").join(reps.select("rid", "bytes"), "rid")
    rows = in_blocks(found, "n", "rid", limit).select("node", "b1", "b2", "rid", "bytes")

    def compare(c: dict) -> Iterator[tuple[int, int]]:
        ids = c["rid"].to_numpy()
        if len(ids) < 2:
            return
        # one length: it parts the filters
        q = np.frombuffer(b"".join(c["bytes"].to_pylist()), np.int8).reshape(len(ids), -1)
        yield from forest(may_link(q, threshold), ids)

    return in_groups(rows, ["node", "b1", "b2"], "a bigint, b bigint", compare)


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """(rid, links, other) from (comp, n, rid, copies, vector): exact cosines within components, block by block."""
    rows = in_blocks(members, "n", "rid", BLOCK).select("comp", "b1", "b2", "own", "rid", "copies", "vector")

    def compare(c: dict) -> Iterator[tuple]:
        ids, own, copies = (c[k].to_numpy() for k in ("rid", "own", "copies"))
        if len(ids) < 2:
            return
        x = np.array([np.frombuffer(v, np.float64) for v in c["vector"].to_pylist()])  # one length: it parts the filters
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        counted = linked if c["b1"][0].as_py() == c["b2"][0].as_py() else linked & (own[:, None] != own[None, :])
        for k, links in zip(ids.tolist(), (counted @ copies).tolist(), strict=True):
            if links:
                yield k, links, None
        for a, b in forest(linked, ids):
            yield a, 0, b

    return in_groups(rows, ["comp", "b1", "b2"], "rid bigint, links bigint, other bigint", compare)


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9,
                    per_vector: float = 24, codes: int = 5, limit: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    ``n_links`` counts the other rows with a cosine of ``threshold`` or more, ``component_id`` is the smallest id reachable
    by links, ``kept`` tells whether that is the row's own id.
    """
    filters = max(64, df.count())
    v = described(df, vec_id, vector, filters, per_vector, threshold, codes)
    folded = stage(v.groupBy("f1", "f2").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies")), "folded")
    reps = v.join(folded.select(F.col("rep").alias("rid"), "copies"), "rid").where("d > 0")
    comps = stage(connected_components(candidate_edges(reps, threshold, limit))
                  .withColumnRenamed("node", "rid").withColumnRenamed("component", "comp"), "candidates")
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    members = reps.select("rid", "copies", "vector").join(comps, "rid").join(sizes, "comp")
    links = stage(verified(members, threshold), "links")
    count = links.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = connected_components(links.where("other is not null"), "rid", "other")
    each = (folded.join(count, folded.rep == count.rid, "left").drop("rid")
            .join(classes, F.col("rep") == classes.node, "left")
            .select("f1", "f2", F.coalesce("component", "rep").alias("root"),
                    (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    rows = stage(v.select("vec_id", "f1", "f2").join(each, ["f1", "f2"]), "members")
    first = rows.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return (rows.join(first, "root")
            .select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")))
