"""N-gram Jaccard join by chosen paths: near-duplicate documents on word shingles.

Each document is the set of its ``n``-word shingles.  One run of the chosen-path recursion puts a set ``x`` into the
children of its node that belong to those tokens ``t`` of ``x`` whose hash, drawn anew for every node, is below
``1 / (threshold |x|)``: two sets that meet the threshold share a child with probability 1 - 1/e or more.  Nodes of at
most ``limit`` sets are compared at once, larger ones are split again, up to ``DEPTH`` times; what is still large then
(copies of one text never split) is compared in blocks, every pair of blocks in its own group.

A pair in a node that is split must share the next child too, so a run finds it with the chance that a branching process
of mean 1 lives through ``DEPTH`` steps (0.37).  A pair that shares no split node in the first runs is missed with chance
1/e a run; sets that were in a split node, both sets of all other pairs among them, go through more runs.  The two chances
and that of the sketches to tell a linked pair apart add up to less than ``1 - recall``.

1. One map over the documents writes, for each, the fingerprint of its set, a bottom-``SKETCH`` sketch and its paths
   through the first runs.  Documents with equal sets are folded into one representative with a number of copies.
2. Nodes are counted (partial sums first), and only sets in nodes of two or more go on.  Inside a node, sketches are
   compared; a node returns a spanning forest of what it found, never its pairs.  This goes in three rounds: ``LEAD`` runs,
   all first runs, and the later runs, whose paths a second map draws for the documents that need them.  From the
   second round on a set carries the component that the rounds before gave it: nodes within one component are passed over,
   and a node's forest joins components only, so a large group of copies is linked once and not in every node of every run.
   The first round only prepares that: it splits no node and compares a large one in single blocks, with a few of its sets in
   all of them.  The second round has its nodes again, and there and in the third the sets of a node's largest component meet
   the others only, at once where these are few.
3. The forests' components are verified exactly on whole texts, again in blocks: the number of linked documents for
   each representative, and a spanning forest of the true links, whose components are the classes.

Memory in a task is a block pair.  Nothing is collected to the driver.

Defined results: a text of 1 to n-1 words is one shingle; null and empty texts have none, link with nothing and are
classes of their own; repeated rows are copies of each other, of which one is kept; null ids sort last in a class, whose
id is null only if all its ids are; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import forest, in_blocks, in_blocks_by_label, in_groups, in_single_blocks
from .common import Stages, WordHashes, content_key, mix, shingle_hashes, stage, with_likely_keys
from .components import connected_components

DEPTH, SKETCH, BLOCK = 3, 64, 256
LEAD = 3  # trees of the first round
ALL = float(1 << 64)


def survival(depth: int) -> float:
    """Least chance that a pair at the threshold shares a path of ``depth`` children in a run."""
    s = 1.0
    for _ in range(depth):
        s = 1 - math.exp(-s)
    return s


def runs_for(recall: float) -> tuple[int, int]:
    """(first runs, all runs): misses are shared out to pairs outside split nodes (0.2), inside (0.6) and sketches (0.2)."""
    miss = 1 - recall
    first = math.ceil(math.log(0.2 * miss) / math.log(1 - survival(1)))
    return first, max(first, math.ceil(math.log(0.6 * miss) / math.log(1 - survival(DEPTH))))


def least_common(threshold: float, recall: float) -> np.ndarray:
    """By sketch size, the common values below which a linked pair stays with a chance of 0.2 of the misses at most."""
    out = np.zeros(SKETCH + 1)
    for k in range(1, SKETCH + 1):
        tail = np.cumsum([math.comb(k, c) * threshold ** c * (1 - threshold) ** (k - c) for c in range(k + 1)])
        out[k] = np.searchsorted(tail, 0.2 * (1 - recall), side="right")
    return out


def children(tokens: np.ndarray, nodes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``nodes``, path hashes) of the children of the nodes that the set goes to."""
    share = 1 / (threshold * len(tokens))
    factors = mix(nodes) | np.uint64(1)  # tokens are hashes already: a random odd factor draws anew
    step = max(1, (1 << 16) // len(tokens))
    owners, out = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for k in range(0, len(nodes), step):
        h = factors[k:k + step, None] * tokens
        at, token = np.nonzero(h < np.uint64(int(share * ALL)) if share < 1 else np.ones(h.shape, bool))
        owners.append(at + k)
        out.append(mix(h[at, token] ^ nodes[at + k]))
    return np.concatenate(owners), np.concatenate(out)


def paths(tokens: np.ndarray, runs: int, threshold: float, first: int = 0) -> list[tuple]:
    """(p1, p2, p3), signed, for every path of the set through the trees ``first`` to ``runs``; None where a path ends early."""
    return [p for _, p in paths_by_run(tokens, runs, threshold, first)]


def paths_by_run(tokens: np.ndarray, runs: int, threshold: float, first: int = 0) -> list[tuple[int, tuple]]:
    """(number of the tree, path) for every path of the set, as ``paths`` has them."""
    trees, a = children(tokens, np.arange(first + 1, runs + 1, dtype=np.uint64), threshold)
    of_b, b = children(tokens, a, threshold)
    of_c, c = children(tokens, b, threshold)
    tree = (trees + first + 1).tolist()
    x, y, z = (v.view(np.int64).tolist() for v in (a, b, c))
    up, last = of_b.tolist(), of_c.tolist()
    below, end = set(up), set(last)
    out = [(tree[k], (x[k], None, None)) for k in range(len(x)) if k not in below]
    out += [(tree[up[k]], (x[up[k]], y[k], None)) for k in range(len(y)) if k not in end]
    out += [(tree[up[k]], (x[up[k]], y[k], p)) for k, p in zip(last, z, strict=True)]
    return out


def common_counts(rows: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays: products of incidence matrices, chunk by chunk."""
    values, where, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    shared = n[where] > 1
    place = (np.cumsum(n > 1) - 1)[where][shared]
    owner = owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(rows), len(rows)))
    last = int(place[-1]) + 1 if len(place) else 0
    for first in range(0, last, columns):
        a, b = np.searchsorted(place, [first, first + columns])
        held = np.zeros((len(rows), min(columns, last - first)), np.float32)
        held[owner[a:b], place[a:b] - first] = 1
        out += held @ held.T
    return out


PATHS = pa.list_(pa.struct([("p1", pa.int64()), ("p2", pa.int64()), ("p3", pa.int64())]))
CHAINS = "array<struct<p1 bigint, p2 bigint, p3 bigint>>"


def path_lists(found: list[list[tuple]]) -> pa.Array:
    flat = [p for f in found for p in f]
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    columns = [pa.array([p[k] for p in flat], pa.int64()) for k in range(DEPTH)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(PATHS.value_type)))


def sets(df: DataFrame, doc_id: str, text: str, n: int, threshold: float, runs: int) -> DataFrame:
    """(rid, key, doc_id, f1, f2, size, sketch, lead, paths) of every row; ``lead`` are the paths of the first ``LEAD`` runs,
    ``paths`` those of the others up to ``runs``.  A sketch holds the low halves of its hashes."""
    docs = df.select(content_key(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first, done = WordHashes(), TaskContext.get().partitionId() << 36, 0
        signed = lambda v: None if v is None else v - (1 << 64) if v >> 63 else v
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                rid, f1, f2, size, sketch, lead, found = [], [], [], [], [], [], []
                for t in b.column(2):
                    s = shingle_hashes(t.as_py(), n, words)
                    rid.append(first + done)
                    done += 1
                    both = xxhash.xxh128_intdigest(s.tobytes()) if len(s) else rid[-1]
                    f1.append(signed(both >> 64) if len(s) else -1)
                    f2.append(signed(both & ((1 << 64) - 1)))
                    size.append(len(s))
                    low = np.partition(mix(s), SKETCH - 1)[:SKETCH] if len(s) > SKETCH else mix(s)
                    sketch.append(np.unique(low.astype(np.uint32)).tobytes())
                    drawn = paths_by_run(s, runs, threshold) if len(s) else []
                    lead.append([p for tree, p in drawn if tree <= LEAD])
                    found.append([p for tree, p in drawn if tree > LEAD])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid, pa.int64()), b.column(0), b.column(1), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(sketch, pa.binary()), path_lists(lead), path_lists(found)],
                    ["rid", "key", "doc_id", "f1", "f2", "size", "sketch", "lead", "paths"])

    return docs.mapInArrow(described, f"rid bigint, key binary, doc_id {kind}, f1 bigint, f2 bigint, size bigint, "
                                      f"sketch binary, lead {CHAINS}, paths {CHAINS}")


def later_paths(texts: DataFrame, n: int, threshold: float, first: int, last: int) -> DataFrame:
    """(rid, paths) through the trees ``first`` to ``last`` from (rid, text)."""
    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                found = [paths(shingle_hashes(t.as_py(), n, words), last, threshold, first) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), path_lists(found)], ["rid", "paths"])

    return texts.select("rid", "text").mapInArrow(drawn, f"rid bigint, paths {CHAINS}")


def mixed(chains: DataFrame, depth: int, keep: Stages) -> tuple[DataFrame, DataFrame]:
    """(node, rid, comp) at a depth, and (node, n) of the nodes there with sets of several components."""
    here = chains.where(F.col(f"p{depth}").isNotNull()).select(F.col(f"p{depth}").alias("node"), "rid", "comp").distinct()
    count = keep(here.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                 .where("n > 1 and lo <> hi").select("node", "n"), f"nodes{depth}")
    return here, count


def nodes(chains: DataFrame, limit: int, keep: Stages) -> tuple[DataFrame, DataFrame]:
    """From (rid, comp, p1, p2, p3): (node, rid, comp, n, core, n_core) of the nodes to compare, those with sets of several
    components that have at most ``limit`` sets, or at most ``limit`` besides those of one component, and at the last depth
    any others; and the chains through nodes that are split at the first depth.  ``core`` is the component of more than half
    of the sets of a node above ``limit``, if there is one."""
    out, split, alive = [], [], chains
    for depth in range(1, DEPTH + 1):
        here, count = mixed(alive, depth, keep)
        large = count.where(F.col("n") > limit)
        cores = (here.join(large, "node").groupBy("node", "n", "comp").agg(F.count(F.lit(1)).alias("n_core"))
                 .where("2 * n_core > n").select("node", F.col("comp").alias("core"), "n_core"))
        if depth == DEPTH:
            found = here.join(count, "node").join(cores, "node", "left")
        else:
            # the core meets the few others only: at most about twice the node's rows
            cores = keep(large.join(cores, "node", "left"), f"large{depth}")
            few = F.coalesce(F.col("n") - F.col("n_core") <= limit, F.lit(False))
            none = [F.lit(None).cast("bigint").alias(c) for c in ("core", "n_core")]
            found = here.join(count.where(F.col("n") <= limit).select("*", *none).unionByName(cores.where(few)), "node")
            # written, as it is read three times from here on
            going = alive if depth == 1 else alive.where(F.col(f"p{depth + 1}").isNotNull())
            alive = keep(going.join(cores.where(~few).select(F.col("node").alias(f"p{depth}")), f"p{depth}", "left_semi"), f"split{depth}")
            split.append(alive)
        out.append(found)
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o)
    return both, split[0]


def candidate_edges(found: DataFrame, sketches: DataFrame, threshold: float, limit: int, recall: float = 0.9999,
                    whole: bool = True) -> DataFrame:
    """(a, b): spanning forests of the components whose sets agree in their sketches, node by node; those between the blocks
    of a large node may be missing unless ``whole``."""
    blocks = (in_blocks_by_label(found, "n", "rid", "comp", "core", "n_core", limit) if whole
              else in_single_blocks(found, "node", "n", "rid", limit))
    rows = (blocks.join(sketches.select("rid", "size", "sketch"), "rid")
            .select("node", "b1", "b2", "rid", "comp", "size", "sketch"))
    least = least_common(threshold, recall)

    def compare(c: dict) -> Iterator[tuple[int, int]]:
        ids, of = np.unique(c["comp"].to_numpy(), return_inverse=True)
        if len(ids) < 2:
            return
        size = c["size"].to_numpy()
        common = common_counts([np.frombuffer(x, np.uint32) for x in c["sketch"].to_pylist()])
        # |x and y| >= threshold * max(|x|, |y|) for linked sets; slack for the sample
        linked = common >= least[np.minimum(np.maximum.outer(size, size), SKETCH)]
        if len(ids) < len(of):
            order = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[order], np.arange(len(ids)))
            linked = np.logical_or.reduceat(np.logical_or.reduceat(linked[order][:, order], starts, 0), starts, 1)
        yield from forest(linked, ids)

    return in_groups(rows, ["node", "b1", "b2"], "a bigint, b bigint", compare)


def candidates(df: DataFrame, reps: DataFrame, doc_id: str, text: str, n: int, threshold: float, limit: int, recall: float,
               keep: Stages) -> DataFrame:
    """(rid, comp): components of the candidate links among the representatives, for those that have any."""
    first, last = runs_for(recall)

    def chains(rows: DataFrame, path: str) -> DataFrame:
        return rows.select("rid", "comp", F.explode(path).alias("c")).select("rid", "comp", "c.*")

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(comps, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))

    def joined(found: DataFrame, name: str) -> DataFrame:
        """``comps`` after the components that the nodes' forests link are put together."""
        own = Stages(df.sparkSession)
        edges = candidate_edges(found, reps, threshold, limit, recall, whole=comps is not None)
        now = (connected_components(edges, keep=own)
               .select(F.col("node").alias("comp"), F.col("component").alias("top")))
        if comps is None:
            out = keep(now.select(F.col("comp").alias("rid"), F.col("top").alias("comp")), name)
        else:
            moved = comps.join(now, "comp", "left").select("rid", F.coalesce("top", "comp").alias("comp"))
            fresh = now.join(comps.select(F.col("rid").alias("comp")), "comp", "left_anti")
            out = keep(moved.unionByName(fresh.select(F.col("comp").alias("rid"), F.col("top").alias("comp"))), name)
        own.drop()
        return out

    comps = None
    here, count = mixed(chains(reps.withColumn("comp", F.col("rid")), "lead"), 1, keep)
    comps = joined(here.join(count, "node"), "comps1")
    found, split = nodes(chains(labelled(reps.select("rid", F.concat("lead", "paths").alias("paths"))), "paths"), limit, keep)
    again = keep(split.select("rid").distinct().join(reps.select("rid", "key"), "rid"), "again")
    comps = joined(found, "comps2")
    texts = df.select(content_key(doc_id, text).alias("key"), F.col(text).cast("string").alias("text"))
    more = keep(later_paths(with_likely_keys(texts, again).join(again, "key"), n, threshold, first, last), "later")
    found, _ = nodes(chains(labelled(more), "paths"), limit, keep)
    return joined(found, "comps3")


def verified(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """(rid, links, other) from (comp, n, rid, copies, text): exact comparison within components, block by block.

    Rows with ``links`` count the documents linked to a representative in one pair of blocks; rows with ``other`` are
    edges of a spanning forest.
    """
    rows = in_blocks(members, "n", "rid", BLOCK).select("comp", "b1", "b2", "own", "rid", "copies", "text")
    memory: list[WordHashes] = []

    def compare(c: dict) -> Iterator[tuple]:
        ids, first = np.unique(c["rid"].to_numpy(), return_index=True)
        if len(ids) < 2:
            return
        if not memory:
            memory.append(WordHashes())
        own, copies = c["own"].to_numpy()[first], c["copies"].to_numpy()[first]
        found = [shingle_hashes(c["text"][int(k)].as_py(), n, memory[0]) for k in first]
        size = np.array([len(s) for s in found], float)
        common = common_counts(found)
        linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if c["b1"][0].as_py() != c["b2"][0].as_py():
            counted = linked & (own[:, None] != own[None, :])  # pairs inside a block are counted in the block's own group
        else:
            counted = linked
        for k, links in zip(ids.tolist(), (counted @ copies).tolist(), strict=True):
            if links:
                yield k, links, None
        for a, b in forest(linked, ids):
            yield a, 0, b

    return in_groups(rows, ["comp", "b1", "b2"], "rid bigint, links bigint, other bigint", compare)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8,
                    recall: float = 0.9999, limit: int = 512) -> DataFrame:
    """(doc_id, key, class_id, n_links, class_size, kept) of every row.

    ``n_links`` counts the other rows whose Jaccard similarity is ``threshold`` or more, ``class_id`` is the smallest id
    reachable by links, ``kept`` marks one row of each class; ``key`` is the content key over id and text.
    """
    keep = Stages(df.sparkSession)
    s = keep(sets(df, doc_id, text, n, threshold, runs_for(recall)[0]), "sets")
    folded = keep(s.groupBy("f1", "f2").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies")), "folded")
    reps = keep(s.where("size > 0").join(folded.select(F.col("rep").alias("rid"), "copies"), "rid")
                .select("rid", "key", "copies", "size", "sketch", "lead", "paths"), "reps")
    comps = candidates(df, reps, doc_id, text, n, threshold, limit, recall, keep)
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    # written, so that Spark knows how few they are before it plans the join with the texts
    members = keep(reps.select("rid", "key", "copies").join(comps, "rid").join(sizes, "comp"), "candidates")
    texts = df.select(content_key(doc_id, text).alias("key"), F.col(text).cast("string").alias("text"))
    links = keep(verified(with_likely_keys(texts, members).join(members, "key").select("comp", "n", "rid", "copies", "text"), n, threshold), "links")
    count = links.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = connected_components(links.where("other is not null"), "rid", "other", keep=keep)
    each = (folded.join(count, folded.rep == count.rid, "left").drop("rid")
            .join(classes, F.col("rep") == classes.node, "left")
            .select("f1", "f2", F.coalesce("component", "rep").alias("root"),
                    (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    rows = stage(s.select("rid", "key", "doc_id", "f1", "f2").join(each, ["f1", "f2"]), "members")
    keep.drop()
    first = rows.groupBy("root").agg(
        F.count(F.lit(1)).alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("rid"))).alias("first"))
    return (rows.join(first, "root")
            .select("doc_id", "key", F.col("first.id").alias("class_id"), "n_links", "class_size",
                    (F.col("rid") == F.col("first.rid")).alias("kept")))


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8,
                         recall: float = 0.9999, limit: int = 512) -> DataFrame:
    """``df`` with one row of each class; all columns stay."""
    kept = near_duplicates(df, doc_id, text, n, threshold, recall, limit).where("kept").select("key")
    again = df.groupBy(content_key(doc_id, text).alias("key")).count().where("count > 1").select("key")
    rows = df.select(content_key(doc_id, text).alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    chosen = stage(rows.join(kept, "key", "left_semi").join(again.withColumn("again", F.lit(True)), "key", "left"), "kept")
    return (chosen.where("again is null").select("row.*")
            .unionByName(chosen.where("again").dropDuplicates(["key"]).select("row.*")))
