"""Connected components of an edge table: forests of the tasks' own edges, then alternating large-star and small-star rounds.

Each task first replaces its edges by a spanning forest of stars, at most ``SMALL`` edges at a time, so that repeated links and
those within a task cost no shuffle.  Every round after that is two grouped minimums over the edges that are left; a hot node's
neighbours are pre-aggregated in the map tasks and no neighbour list is ever collected into one task.  The number of edges
never grows.  Once ``SMALL`` edges or fewer are left (16 bytes each), as many as a task takes at a time anyway, they are one
forest more instead of further rounds: a round is some seven exchanges, and for each of them the driver holds a plan and a
thread.  Edges are written to the shared folder after each round, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, stage

SMALL = 1 << 19


def stars(u: np.ndarray, v: np.ndarray, centres: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node but the smallest ones; those too with ``centres``."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(ids))
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    out = np.ones(len(ids), bool) if centres else label != np.arange(len(ids))
    return ids[out], ids[label[out]]


def forests(edges: DataFrame, small: int = SMALL, centres: bool = False) -> DataFrame:
    """Edges (u, v) that link the same nodes as those of ``edges``, u > v: stars of the edges of each task, ``small`` at a time.

    With ``centres`` a star's smallest node has a row (v, v)."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return stars(*(np.concatenate(c) for c in zip(*held, strict=True)), centres)

        for b in batches:
            names = b.schema.names
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n > small:
                new = joined()
                held, n = [new], len(new[0])
                if n > small // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, new)), names)
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, joined())), names)

    return edges.select("u", "v").mapInArrow(run, f"u {kind}, v {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60,
                         keep: Stages | None = None, small: int = SMALL) -> DataFrame:
    """(node, component) for every node of an edge; ``component`` is the smallest node reachable.

    Null ends and self-loops link nothing.  Nodes without an edge are not in the result.  With ``keep`` a round's edges are
    deleted once the next round's are written, and the last ones are its to drop.
    """
    write = keep or stage
    now = write(forests(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))), small), "edges")
    for _ in range(most_rounds):
        if now.count() <= small:
            whole = write(forests(now.coalesce(1), small, centres=True), "edges")
            if keep:
                keep.drop(now)
            return whole.select(F.col("u").alias("node"), F.col("v").alias("component"))
        # large star: a node's larger neighbours (those on whose edge it is v) move to its smallest neighbour
        lowest = now.groupBy("u").agg(F.min("v").alias("m"))
        large = (now.join(lowest.withColumnRenamed("u", "v"), "v", "left")
                 .select("u", F.coalesce("m", "v").alias("v")))
        # small star: a node and its smaller neighbours move to the smallest of them
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        both = large.join(least, "u")
        moved = (both.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        new = write(moved, "edges")
        # done when every node hangs on exactly one node that hangs on none
        ends = (new.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
                .unionByName(new.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
        left = (ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
                .where((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).limit(1).count())
        if keep:
            keep.drop(now)
        now = new
        if not left:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
