"""Groups of any size compared in blocks: every pair of blocks is a group of its own, streamed through a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forest(linked: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """(id, smallest id) for each node of each component of two or more, from a symmetric boolean matrix."""
    left = np.ones(len(ids), bool)
    for s in np.argsort(ids):
        if not left[s]:
            continue
        reached = np.zeros(len(ids), bool)
        reached[s] = True
        edge = reached
        while edge.any():
            edge = linked[edge].any(axis=0) & left & ~reached
            reached = reached | edge
        left &= ~reached
        yield from ((int(ids[k]), int(ids[s])) for k in np.flatnonzero(reached) if k != s)


def in_groups(rows: DataFrame, by: list[str], schema: str, work: Callable) -> DataFrame:
    """``work(columns) -> rows`` on each group of equal ``by``; the groups of a task are streamed, not collected."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], fields)

        fields = [f.split()[0] for f in schema.split(", ")]
        types = [{"bigint": pa.int64(), "boolean": pa.bool_()}[f.split()[1]] for f in schema.split(", ")]

        def group(t: pa.Table) -> None:
            out.extend(work({c: t[c] for c in names}))

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            keys = [t[c].to_numpy() for c in by]
            change = np.zeros(len(t) - 1, bool) if len(t) else np.zeros(0, bool)
            for k in keys:
                change |= k[1:] != k[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                group(t.slice(a, z - a))
                if len(out) > 50_000:
                    yield flush()
            rest = t.slice(cuts[-1])
        if rest is not None and len(rest):
            group(rest)
        if out:
            yield flush()

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def in_blocks(rows: DataFrame, size: str, member: str, block: int) -> DataFrame:
    """Rows with (b1, b2): each row goes to the pairs of blocks its own block belongs to; small groups are one block."""
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member), n.cast("bigint")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1),
                        lambda k: F.struct(F.least(own, k).alias("b1"), F.greatest(own, k).alias("b2")))
    return rows.select("*", own.alias("own"), F.explode(pairs).alias("p")).select("*", "p.b1", "p.b2").drop("p")


def in_single_blocks(rows: DataFrame, group: str, size: str, member: str, block: int, bridges: int = 32) -> DataFrame:
    """Rows with (b1, b2), equal: a large group is cut into single blocks, which do not meet but in some ``bridges`` of its
    members that go to all of them.  No more than ``size * (1 + bridges / block)`` rows a group, about."""
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    draw = lambda salt: F.xxhash64(F.lit(salt), group, member)
    bridge = F.pmod(draw(1), F.col(size).cast("bigint")) < F.lit(bridges)
    own = F.pmod(draw(0), n.cast("bigint")).cast("int")
    at = F.when((n > 1) & bridge, F.sequence(F.lit(0), n - 1)).otherwise(F.array(own))
    return rows.select("*", F.explode(at).alias("b1")).withColumn("b2", F.col("b1"))


def in_blocks_by_label(rows: DataFrame, size: str, member: str, label: str, core: str, n_core: str, block: int) -> DataFrame:
    """Rows with (b1, b2) such that members with different labels meet, and all that have not the label ``core``.

    ``core`` is a label that ``n_core`` of the group's ``size`` members have, or null.  Its members meet only the others: with
    at most ``block`` others a group makes no more than about twice its rows.
    """
    most = F.coalesce(F.col(n_core), F.lit(0))
    others = F.ceil((F.col(size) - most) / F.lit(block)).cast("int")
    cores = F.ceil(most / F.lit(block)).cast("int")
    inside = F.coalesce(F.col(label) == F.col(core), F.lit(False))
    at = F.xxhash64(member)
    own = F.when(inside, others + F.pmod(at, cores.cast("bigint")).cast("int")).otherwise(F.pmod(at, others.cast("bigint")).cast("int"))
    blocks = F.sequence(F.lit(0), F.when(inside, others).otherwise(others + cores) - 1)
    # a block that meets another one is compared in itself there
    met = F.when((others + cores > 1) & ~inside, F.filter(blocks, lambda k: k != own)).otherwise(blocks)
    pairs = F.transform(met, lambda k: F.struct(F.least(own, k).alias("b1"), F.greatest(own, k).alias("b2")))
    return rows.select("*", F.explode(pairs).alias("p")).select("*", "p.b1", "p.b2").drop("p")
