"""Conversation prefix trie: shared prefixes as nodes, rolled up by centroid decomposition of the parent-edge forest.

A conversation is rebuilt from the first ``h`` turns of another one and its own later turns.  Its turns are put in order
by ranges: the rows are dealt by (conversation, turn), each piece is numbered for itself, and the counts of the pieces
before it are added, so that a conversation of any length is spread over many tasks.  A prefix is known by the running
sums of a 124-bit hash of its (position, role, text); the sums too are taken piece by piece.

Roll-up.  A node weighs as many conversations as pass through it, so the weight of a whole subtree follows from its
members' lengths and needs no roll-up itself.  In every component, which is a tree with a top, the centroid is the deepest
node with half of the weight or more below it.  It is taken out, and the component falls into the part above and one
part for each child.  The total of what lay below the centroid is its share of the roll-up, and is added to each
node on the path from the centroid to the top; the weights on that path are less by the centroid's.  Every component is
halved, so the number of rounds is at most the logarithm of the number of turns.  All components are split in the same
few joins: a node finds its child of the centroid by its first member's turn at that depth, and the path is the run of
turns of the centroid's first member.  Components of at most ``small`` nodes are split to the end by the same rule in one
task each; they are streamed, so a task holds one of them at a time.

Members' ids go into a node's SHA-256 in runs of ``RUN`` sorted ids, made in parallel; the digest of a node is the one
thing that is serial, and streams through a fixed buffer.

Defined results: rows without a conversation id are left out; null roles and texts are empty; turns sort nulls first, then
by role and by the MD5 of the text, and repeated rows are turns of their own; a conversation that is shorter than its
head keeps what there is; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

WORD = r"[^\x20\x09-\x0D]+"
SUMS = ["s1", "s2", "s3", "s4"]
SMALL = 20_000
RUN = 500
HEAD = 3  # turns that a conversation may take from another one


def _hash_parts(value: Column) -> list[Column]:
    """Four 31-bit numbers of a value's MD5: their sums stay far below 2**63."""
    digest = F.md5(value)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint").bitwiseAND(0x7FFFFFFF).alias(s)
            for k, s in enumerate(SUMS)]


def _key(sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *sums)))


def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, piece, turn, what, words): one row for each turn, dealt into pieces by conversation and order."""
    both = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"),
        F.concat_ws(":", F.hex(both[0]), F.md5(both[1])).alias("what"),
        F.regexp_count(both[1], F.lit(WORD)).cast("bigint").alias("words"))
    # the last key keeps equal rows of one conversation from falling into one piece
    dealt = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(
        "conv", F.col("turn").asc_nulls_first(), "what", "nth")
    return stage(dealt.select("conv", F.spark_partition_id().cast("bigint").alias("piece"), "turn", "what", "nth", "words"), "turns")


def rebuilt(turns: DataFrame, head: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """(conv, length) of every rebuilt conversation, and its turns as (conv, length, depth, key, parent, child, words).

    ``head`` and ``base`` are expressions of ``conv``: how many turns come first, at most ``HEAD``, and from which
    conversation.
    """
    pieces = turns.groupBy("conv", "piece").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n").over(Window.partitionBy("conv"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))
    pieces = stage(pieces.select("conv", "piece", n.alias("own"), before.alias("before")), "pieces")  # a row a piece, not a turn
    owns = pieces.groupBy("conv").agg(F.max("own").alias("own"))
    heads = (owns.select("conv", "own", head.cast("bigint").alias("h"), base.alias("base"))
             .join(owns.select(F.col("conv").alias("base"), F.col("own").alias("there")), "base", "left")
             .withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))))
    heads = stage(heads.select("conv", "base", "h", "taken",
                               (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "heads")
    in_piece = Window.partitionBy("conv", "piece").orderBy(F.col("turn").asc_nulls_first(), "what", "nth")
    ranked = turns.join(pieces.join(heads, "conv"), ["conv", "piece"]).withColumn(
        "rank", F.row_number().over(in_piece) + F.col("before"))
    ranked = stage(ranked.select("conv", "piece", "rank", "h", "taken", "length", "what", "words"), "ranked")
    own = ranked.where("rank > h").select("conv", "piece", "length", (F.col("rank") - F.col("h") + F.col("taken")).alias("depth"),
                                          "what", "words")
    first = ranked.where(F.col("rank") <= HEAD).select(F.col("conv").alias("base"), F.col("rank").alias("depth"), "what", "words")
    lent = (heads.where("taken > 0").join(first, "base").where("depth <= taken")
            .select("conv", F.lit(-1).cast("bigint").alias("piece"), "length", "depth", "what", "words"))
    rows = own.unionByName(lent).select("*", *_hash_parts(F.concat_ws(":", "depth", "what")))
    rows = stage(rows.drop("what"), "hashed")
    totals = rows.groupBy("conv", "piece").agg(*[F.sum(s).alias(s) for s in SUMS])
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "piece", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"o{s}") for s in SUMS])
    running = Window.partitionBy("conv", "piece").orderBy("depth")
    # running sums within a piece; the sum up to the turn before is less by the turn's own hash
    rows = (rows.join(totals, ["conv", "piece"])
            .select("conv", "length", "depth", "words", *SUMS, *[(F.sum(s).over(running) + F.col(f"o{s}")).alias(f"t{s}") for s in SUMS]))
    rows = rows.select("conv", "length", "depth", _key([F.col(f"t{s}") for s in SUMS]).alias("key"),
                       _key([F.col(f"t{s}") - F.col(s) for s in SUMS]).alias("parent"), "words")
    return heads.select("conv", "length"), stage(rows, "prefixes")


def _decompose(parent: list[int], weight: list[int], values: list[list[int]]) -> list[list[int]]:
    """Roll-ups of one component whose nodes are in order of depth, the top first; ``parent`` -1 at the top.

    Centroids are taken out from the top level down, noted with their paths, and summed up the other way round: then the
    roll-up of a part's top is the part's total.
    """
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n)]
    for x in range(1, n):
        children[parent[x]].append(x)
    weight, gone, taken = list(weight), bytearray(n), []
    tops = [0]
    while tops:
        top = tops.pop()
        while not gone[top]:
            path, x, whole = [], top, weight[top]
            while (down := next((c for c in children[x] if not gone[c] and 2 * weight[c] >= whole), None)) is not None:
                path.append(x)
                x = down
            parts = [c for c in children[x] if not gone[c]]
            gone[x] = 1
            children[x] = []
            for p in path:
                weight[p] -= weight[x]
            taken.append((x, path, parts))
            tops += parts
    sums = [[0] * n for _ in values]
    for x, path, parts in reversed(taken):
        for total, own in zip(sums, values, strict=True):
            below = own[x] + sum(total[c] for c in parts)
            total[x] += below
            for p in path:
                total[p] += below
    return sums


def _small_components(nodes: DataFrame) -> DataFrame:
    """Nodes of components that fit into a task, with their part of the roll-up added."""
    names = ["component", "depth", "key", "parent", "weight", "leaf", "saved", "leaves", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def solved(t: pa.Table) -> pa.RecordBatch:
            """Whole components, one after the other."""
            rows = {c: t[c].to_pylist() for c in names}
            leaves, total = rows["leaves"], rows["total"]
            start = 0
            for end in range(1, len(t) + 1):
                if end < len(t) and rows["component"][end] == rows["component"][start]:
                    continue
                here = {k: i for i, k in enumerate(rows["key"][start:end])}
                parent = [here.get(p, -1) for p in rows["parent"][start:end]]
                a, b = _decompose(parent, rows["weight"][start:end], [rows["leaf"][start:end], rows["saved"][start:end]])
                for i in range(end - start):
                    leaves[start + i] += a[i]
                    total[start + i] += b[i]
                start = end
            return pa.RecordBatch.from_arrays([t["key"].combine_chunks(), pa.array(leaves, pa.int64()), pa.array(total, pa.int64())],
                                              ["key", "leaves", "total"])

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not len(t):
                continue
            component = t["component"].to_pylist()
            cut = len(t)
            while cut and component[cut - 1] == component[-1]:
                cut -= 1
            if cut:
                yield solved(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and len(rest):
            yield solved(rest)

    return (nodes.select(*names).repartition("component").sortWithinPartitions("component", "depth")
            .mapInArrow(run, "key binary, leaves bigint, total bigint"))


def rolled_up(nodes: DataFrame, prefixes: DataFrame, small: int = SMALL, most_rounds: int = 200) -> DataFrame:
    """(key, leaves, total): subtree sums of ``leaf`` and ``saved`` over a forest of ``nodes``.

    ``nodes``: key, parent, depth, first (smallest member), weight (of its whole subtree), leaf, saved.
    ``prefixes``: conv, depth, key for the members named by ``first``.
    """
    zero = F.lit(0).cast("bigint")
    now = nodes.select("key", "parent", "depth", "first", "weight", "leaf", "saved", zero.alias("leaves"), zero.alias("total"),
                       F.lit(b"").alias("component"))
    now, done = stage(now, "trie"), []
    for _ in range(most_rounds):
        size = now.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max("weight").alias("whole"), F.min("depth").alias("top"))
        size = stage(size, "trie-components")
        large = size.where(F.col("size") > small)
        done.append(_small_components(now.join(size.where(F.col("size") <= small), "component", "left_semi")))
        if large.isEmpty():
            break
        now = now.join(large.drop("size"), "component")
        centroid = now.where("2 * weight >= whole").groupBy("component").agg(
            F.max_by(F.struct("key", "first", "depth", "weight", "top"), "depth").alias("c"))
        centroid = stage(centroid.select("component", F.col("c.key").alias("c_key"), F.col("c.first").alias("c_first"),
                                         F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight"),
                                         F.col("c.top").alias("c_top")), "trie-centroids")  # one row for each large component
        now = now.join(centroid, "component").drop("whole", "top", "c_top", "c_first")
        # below the centroid: the first member of a node passes through it, and goes on to the child that names the part
        turns = prefixes.select(F.col("conv").alias("first"), F.col("depth").alias("c_depth"), F.col("key").alias("at"),
                                F.col("child").alias("part"))
        parts = now.select("component", "first", "c_depth", "c_key").distinct().join(turns, ["first", "c_depth"]).where(
            "at = c_key").select("component", "first", "part")
        now = now.join(parts, ["component", "first"], "left")
        below = F.col("part").isNotNull() & (F.col("depth") > F.col("c_depth"))
        now = now.withColumn("below", below)
        sums = now.where("below OR key = c_key").groupBy("component").agg(F.sum("leaf").alias("add_leaves"), F.sum("saved").alias("add_total"))
        added = centroid.join(sums, "component")
        # the path: turns of the centroid's first member between the top and the centroid, by blocks of depths
        block = 1024
        runs = added.select("*", F.explode(F.sequence(F.floor(F.col("c_top") / block), F.floor(F.col("c_depth") / block))).alias("block"))
        path = (prefixes.withColumn("block", F.floor(F.col("depth") / block)).select(F.col("conv").alias("c_first"), "block", "depth", "key")
                .join(runs, ["c_first", "block"]).where("depth >= c_top AND depth <= c_depth")
                .select("key", "add_leaves", "add_total", F.when(F.col("key") != F.col("c_key"), F.col("c_weight")).alias("less")))
        now = now.join(path, "key", "left").select(
            "key", "parent", "depth", "first", (F.col("weight") - F.coalesce("less", zero)).alias("weight"), "leaf", "saved",
            (F.col("leaves") + F.coalesce("add_leaves", zero)).alias("leaves"), (F.col("total") + F.coalesce("add_total", zero)).alias("total"),
            F.when(F.col("key") == F.col("c_key"), F.lit(None)).when(F.col("below"), F.col("part")).otherwise(F.col("component")).alias("component"))
        now = stage(now, "trie-split")
        done.append(now.where("component IS NULL").select("key", "leaves", "total"))
        now = now.where("component IS NOT NULL")
    else:
        raise RuntimeError(f"the trie did not fall apart in {most_rounds} rounds")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the ascending, comma-joined ids ``conv`` of each ``key``."""
    dealt = stage(ends.repartitionByRange("key", "conv").select("key", "conv", F.spark_partition_id().alias("piece")), "ends")
    order = F.row_number().over(Window.partitionBy("key", "piece").orderBy("conv"))
    runs = (dealt.select("key", "piece", "conv", F.floor((order - 1) / RUN).alias("run"))
            .groupBy("key", "piece", "run").agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for b in batches:
            keys, out = b.column(0).to_pylist(), []
            for k, ids in zip(keys, b.column(1), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out])], ["key", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends"])

    return (runs.repartition("key").sortWithinPartitions("key", "piece", "run").select("key", "ids")
            .mapInArrow(digest, "key binary, ends string"))


def prefix_trie(df: DataFrame, head: Column | None = None, base: Column | None = None, conv: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text", small: int = SMALL) -> DataFrame:
    """Nodes of the trie: key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``head`` and ``base`` are expressions of the column ``conv``; without them conversations are taken as they are.
    """
    convs, rows = rebuilt(ordered_turns(df, conv, turn, role, text), head if head is not None else F.lit(0),
                          base if base is not None else F.col("conv"))
    none = _key([F.lit(0).cast("bigint") for _ in SUMS])
    tops = convs.select("conv", "length", F.lit(0).cast("bigint").alias("depth"), none.alias("key"), F.lit(None).cast("binary").alias("parent"),
                        F.lit(0).cast("bigint").alias("words"))
    members = tops.unionByName(rows)
    nodes = (members.groupBy("key").agg(
        F.min("conv").alias("first"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"),
        F.max("words").alias("words"), F.sum("length").alias("lengths")))
    nodes = stage(nodes.select("key", "first", "depth", "parent", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                               (F.col("lengths") - F.col("n_convs") * (F.col("depth") - 1)).alias("weight")), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                  .withColumn("leaf", (F.col("n_children") == 0).cast("bigint")), "nodes")
    # the turns of first members alone: a conversation that is the first member of any node is that of its last one
    ends = members.where("depth = length").select("key", "conv")
    firsts = ends.groupBy("key").agg(F.min("conv").alias("conv")).select("conv")
    after = members.select("conv", (F.col("depth") - 1).alias("depth"), F.col("key").alias("child"))
    prefixes = stage(members.select("conv", "depth", "key").join(firsts, "conv", "left_semi").join(after, ["conv", "depth"], "left"),
                     "firsts")
    sums = rolled_up(nodes, prefixes, small)
    above = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("first").alias("parent_conv_id"))
    found = nodes.join(above, "parent", "left").join(sums, "key").join(_ends_digest(ends), "key", "left")
    return found.select("key", F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
                        F.col("leaves").alias("n_leaves"), F.col("total").alias("saved_tokens"),
                        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
