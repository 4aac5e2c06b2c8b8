"""LM scoring by prediction by partial matching (PPM), next to a unigram word score.

The model is a trie of byte contexts up to ``ORDER`` symbols, pretrained on the training documents: for each context, how
often each symbol followed.  A symbol seen ``c`` times is coded by ``(2c - 1) / 2n`` in the longest context that the trie
has, where ``n`` symbols of ``d`` kinds were seen; a context that lacks it pays an escape of ``d / 2n`` (PPM's method D)
and the next shorter context is asked, without the symbols that the longer one would have coded (symbol exclusion).  What
no context codes is uniform over the rest of the alphabet: the bytes of lower-cased UTF-8 and the end of a text.  Contexts
reach back over the start of the text.

Counting is one map that sums the symbol strings of its documents, deals them by the last ``NEAR`` symbols of their context
and sums them there, with all orders whose contexts are that long or longer; the few shorter ones are grouped sums.  Every edge is used in scoring, however many there are:

1. Code lengths of the at most ``max_edges`` most frequent whole strings go to the tasks, which look them up.
2. All other strings are dealt, with the edges, into buckets by the last ``NEAR`` symbols of their context.  A bucket has
   all edges of contexts that long or longer which its strings can ask for; those of shorter contexts (no more than the
   alphabet allows) go to all tasks.  Edges of a bucket come first, then its strings are streamed through them.  The sums
   that a task has for texts of one partition of the input travel as one row, and are added up partition by partition.

Word score: tokens are runs without white space (space and U+0009 to U+000D), A-Z lower-cased, and one end for each text.
The ``hot_words`` most frequent words go to the tasks with the trie; all others are counted by a join.

Defined results: a null text is empty: its only token and only symbol is the end; repeated rows are learnt from and
scored one by one; no training documents give uniform symbols and a word score of unseen tokens; a very long text is
coded in slices; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, stage

ORDER = 6  # context symbols
WIDTH = 8  # bits of a symbol; START and END are no bytes of UTF-8, as none is above 0xF7
START, END = 0xFF, 0xFE
ALPHABET = 0xF8 - 26 + 1  # A-Z are lower-cased; the end is a symbol
TAG = 56  # the bits above tell the number of symbols of a key
EMPTY = np.uint64(2 ** 64 - 1)  # no key has that value
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # multiplicative hashing: 2**64 over the golden ratio
SLICE = 1 << 20  # strings that wait for a row or a sum
STEP = 1 << 18  # strings that are looked up at once
NEAR = 3  # context symbols that tell the bucket
DEALT = 1024  # buckets in which strings are counted
PART = 36  # bits of a row id below the number of its partition
BUCKET, CHUNK = 250_000, 512  # edges of a bucket on average, strings or edges of a row
TOKENS = re.compile("[^\x20\x09-\x0D]+")


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def words_of(raw: bytes) -> list[str]:
    """Words of a lower-cased text, without the end."""
    text = raw.decode("utf-8", "surrogatepass")
    lines = text.replace("\n", " ")
    if lines.isprintable():  # no white space but spaces
        return [w for w in lines.split(" ") if w]
    return TOKENS.findall(text)


def strings(text: bytes, before: int = ORDER) -> Iterator[np.ndarray]:
    """Codes of the ``before`` symbols before each symbol and itself, over the whole text and its end, by slices."""
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw) + 1, SLICE):
        body = raw[max(at - before, 0):at + SLICE].astype(np.uint64)
        s = np.concatenate([np.full(max(before - at, 0), START, np.uint64), body,
                            np.full(int(at + SLICE > len(raw)), END, np.uint64)])
        n = len(s) - before
        code = np.zeros(n, np.uint64)
        for k in range(before + 1):
            code = (code << np.uint64(WIDTH)) | s[k:k + n]
        yield code


def counted(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by code of partial (codes, counts)."""
    c, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)
    return c[first], np.add.reduceat(n, first) if len(c) else n


class Table:
    """Open-addressing table from 64-bit keys to rows of a value array, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * max(len(keys), 1) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, EMPTY)
        self.values = np.zeros((1 << bits, *values.shape[1:]), values.dtype)
        left, slot = np.arange(len(keys)), self._home(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot] == EMPTY
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * SPREAD >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, values): values of unknown keys are zero."""
        slot = self._home(keys)
        held = self.keys[slot]
        known = held == keys
        out = self.values[slot]
        out[~known] = 0
        left = np.flatnonzero(~known & (held != EMPTY))
        slot = slot[left]
        while len(left):
            slot = slot + 1 & self.mask
            held = self.keys[slot]
            hit = held == keys[left]
            known[left[hit]] = True
            out[left[hit]] = self.values[slot[hit]]
            more = ~hit & (held != EMPTY)
            left, slot = left[more], slot[more]
        return known, out


def of_order(code: np.ndarray, j: int) -> np.ndarray:
    """Key of the last ``j + 1`` symbols: they and, in the top bits, their number."""
    return (code & np.uint64((1 << WIDTH * (j + 1)) - 1)) | np.uint64((j + 1) << TAG)


def bucket_of(code: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the last ``NEAR`` symbols before the last one."""
    near = (code >> np.uint64(WIDTH)) & np.uint64((1 << WIDTH * NEAR) - 1)
    return ((near * SPREAD >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array, all first ones, all second ones and so on, which compresses well if it is sorted."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind)[:, 0]


def packed(code: np.ndarray, other: np.ndarray, buckets: int, ordered: bool = False) -> tuple[list[int], list[bytes], list[bytes]]:
    """(bucket, codes, others) by rows of at most ``CHUNK`` codes of one bucket; ``ordered``: the codes ascend."""
    bucket = bucket_of(code, buckets)
    order = np.argsort(bucket.astype(np.uint16), kind="stable") if ordered and buckets <= 1 << 16 else np.lexsort((code, bucket))
    bucket, code, other = bucket[order], code[order], other[order]
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(code)]
    out: tuple[list[int], list[bytes], list[bytes]] = ([], [], [])
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        for k in range(a, z, CHUNK):
            out[0].append(int(bucket[a]))
            out[1].append(planes(code[k:min(k + CHUNK, z)]))
            out[2].append(planes(other[k:min(k + CHUNK, z)]))
    return out


@dataclass
class Model:
    """Edges (keys as of_order, counts) of all orders, and the words' figures."""

    edges: np.ndarray
    counts: np.ndarray
    hot: pa.Array  # words
    hot_counts: np.ndarray
    tokens: int
    vocabulary: int
    ends: int

    @cached_property
    def unseen(self) -> float:
        """log10 of a token that training lacks."""
        return float(np.log10(0.1 / self.denominator))

    @property
    def denominator(self) -> float:
        return self.tokens + 0.1 * (self.vocabulary + 1)

    @cached_property
    def words(self) -> tuple[dict[str, int], np.ndarray]:
        return dict(zip(self.hot.to_pylist(), range(len(self.hot)), strict=True)), np.log10((self.hot_counts + 0.1) / self.denominator)

    @cached_property
    def trie(self) -> tuple[Table, Table, float]:
        """Edge table (log10 of the direct probability, log10 of 2c - 1), context table (log10 of the direct escape,
        log10 of 2n for what is left of the next shorter context, log10 of the escape from that), log10 of an uncoded symbol."""
        order = (self.edges >> np.uint64(TAG)).astype(np.int64) - 1
        direct = np.zeros(len(self.edges))
        contexts, figures = [], []
        shorter: tuple | None = None
        with np.errstate(divide="ignore"):
            for j in range(ORDER + 1):
                at = np.flatnonzero(order == j)
                code, n = self.edges[at] & np.uint64((1 << TAG) - 1), self.counts[at].astype(np.float64)
                by = np.argsort(code, kind="stable")
                at, code, n = at[by], code[by], n[by]
                context = code >> np.uint64(WIDTH)
                first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(at) else at
                total, kinds = (np.add.reduceat(n, first), np.diff(np.append(first, len(at)))) if len(at) else (n, n)
                owner = np.repeat(np.arange(len(first)), kinds.astype(np.int64))
                direct[at] = np.log10((2 * n - 1) / (2 * total[owner])) if len(at) else direct[at]
                left, escape = np.zeros(len(first)), np.zeros(len(first))
                if j and len(at):
                    codes, counts, names, totals, different = shorter
                    mine = np.uint64((1 << WIDTH * j) - 1)  # the same symbol in the next shorter context
                    taken = np.add.reduceat(counts[np.searchsorted(codes, code & mine)], first)
                    up = np.searchsorted(names, (context[first] & (mine >> np.uint64(WIDTH))))
                    rest, fresh = totals[up] - taken, different[up] - kinds
                    left = np.where(rest > 0, np.log10(2 * rest), 0.0)
                    escape = np.where(fresh > 0, np.log10(fresh) - left, 0.0)  # nothing left: the escape is certain
                contexts.append((context[first] << np.uint64(WIDTH)) | np.uint64((j + 1) << TAG))
                figures.append(np.stack([np.log10(kinds / (2 * total)) if len(at) else total, left, escape], axis=1))
                shorter = code, n, context[first], total, kinds
                if j == 0:
                    rest_of_alphabet = float(-np.log10(max(ALPHABET - len(at), 1)))
        return (Table(self.edges, np.stack([direct, np.log10(2.0 * self.counts - 1)], axis=1).astype(np.float32)),
                Table(np.concatenate(contexts), np.concatenate(figures).astype(np.float32)), rest_of_alphabet)

    def code_length(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each string after the others."""
        edges, contexts, uncoded = self.trie
        known, value = edges.find(of_order(code, ORDER))
        out = value[:, 0].astype(np.float64)
        left = np.flatnonzero(~known)
        longer = np.zeros((len(left), 3))  # figures of the context that was escaped from
        escaped = np.zeros(len(left), bool)
        for j in range(ORDER, -1, -1):
            if not len(left):
                break
            key = of_order(code[left], j)
            seen, figures = contexts.find(key & ~np.uint64((1 << WIDTH) - 1))
            coded, value = edges.find(key)
            out[left] += np.where(coded, np.where(escaped, value[:, 1] - longer[:, 1], value[:, 0]),
                                  np.where(seen, np.where(escaped, longer[:, 2], figures[:, 0]), 0.0))
            escaped = (escaped | seen)[~coded]
            longer = np.where(seen[:, None], figures, longer)[~coded]
            left = left[~coded]
        out[left] += uncoded
        return out

    def score(self, raw: bytes) -> float:
        return float(sum(self.code_length(c).sum() for c in strings(raw)))


def all_orders(code: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(edges, counts) of the orders ``ORDER`` to ``NEAR`` from distinct ascending whole strings of a bucket."""
    for j in range(ORDER, NEAR - 1, -1):
        if j < ORDER:
            code, n = counted([code & np.uint64((1 << WIDTH * (j + 1)) - 1)], [n])
        yield of_order(code, j), n


def count_strings_and_words(df: DataFrame, text: str = "text") -> DataFrame:
    """(kind, code, word, n): 0 edges of the orders from NEAR on, 1 words, 2 texts; summed, written to the shared folder."""
    rows = df.select(F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        codes: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size, texts = 0, 0

        def batch(kind: int, word: list[str], n: list[int]) -> pa.RecordBatch:
            k = len(n)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, kind, np.int32)), pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.nulls(k, pa.int32()),
                 pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], ["kind", "word", "n", "bucket", "codes", "counts"])

        def dealt(c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            bucket, keys, counts = packed(c, n.astype(np.int64), DEALT, ordered=True)
            k = len(bucket)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(k, np.int32)), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.array(bucket, pa.int32()),
                 pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["kind", "word", "n", "bucket", "codes", "counts"])

        def sum_up() -> None:
            nonlocal size
            c = np.concatenate(codes)
            parts.append(np.unique(c, return_counts=True))
            codes.clear()
            size = 0

        for b in batches:
            for t in b.column(0):
                raw = lowered(t.as_py())
                texts += 1
                words.update(words_of(raw))
                for c in strings(raw):
                    codes.append(c)
                    size += len(c)
                    if size > SLICE:
                        sum_up()
                if len(words) > 200_000:
                    yield batch(1, list(words), list(words.values()))
                    words.clear()
                if sum(len(c) for c, _ in parts) > 1_500_000:
                    c, n = counted([c for c, _ in parts], [n for _, n in parts])
                    parts[:] = [(c, n)]
                    if len(c) > 1_000_000:
                        yield dealt(c, n)
                        parts.clear()
        if codes:
            sum_up()
        if parts:
            yield dealt(*counted([c for c, _ in parts], [n for _, n in parts]))
        if words:
            yield batch(1, list(words), list(words.values()))
        if texts:
            yield batch(2, [""], [texts])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = -1
        wait: list[tuple[np.ndarray, np.ndarray]] = []
        out: list[tuple[np.ndarray, np.ndarray]] = []
        size = made = 0

        def settle() -> None:
            nonlocal size, made
            if wait:
                for e, n in all_orders(*counted([c for c, _ in wait], [n for _, n in wait])):
                    out.append((e, n))
                    made += len(e)
            wait.clear()
            size = 0

        def rows_of() -> pa.RecordBatch:
            nonlocal made
            edge, n = np.concatenate([e for e, _ in out]), np.concatenate([n for _, n in out])
            out.clear()
            made = 0
            return pa.RecordBatch.from_arrays([pa.array(edge.astype(np.int64)), pa.array(n)], ["code", "n"])

        for b in batches:
            for bucket, code, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != at:
                    settle()
                    at = bucket
                    if made > SLICE // 4:
                        yield rows_of()
                wait.append((from_planes(code, np.uint64), from_planes(n, np.int64)))
                size += len(wait[-1][0])
                if size > 2 * SLICE:
                    wait[:] = [counted([c for c, _ in wait], [n for _, n in wait])]
                    size = 0
        settle()
        if out:
            yield rows_of()

    keep = Stages(df.sparkSession)
    partial = keep(rows.mapInArrow(run, "kind int, word string, n bigint, bucket int, codes binary, counts binary"), "partial")
    edges = (partial.where("kind = 0").select("bucket", "codes", "counts").repartition("bucket").sortWithinPartitions("bucket")
             .mapInArrow(summed, "code bigint, n bigint"))
    words = partial.where("kind > 0").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    out = stage(edges.select(F.lit(0).alias("kind"), "code", F.lit("").alias("word"), "n")
                .unionByName(words.select("kind", F.lit(0).cast("bigint").alias("code"), "word", "n")), "counts")
    keep.drop()
    return out


def least_count(edges: DataFrame, max_edges: int, parts: int = 1000) -> int:
    """Smallest count such that at most ``max_edges`` edges have it or more.

    One grouped count by powers of two finds the power in which it lies, and each further one a thousandth of that range.
    """
    spread = dict(edges.groupBy(F.length(F.bin("n"))).count().toDF("bits", "edges").collect())
    size, low, width = 0, 1, 1
    for bits in sorted(spread, reverse=True):
        if size + spread[bits] > max_edges:
            low = width = 1 << (bits - 1)
            break
        size += spread[bits]
    else:
        return 1
    while True:  # ``size`` edges have low + width or more; those from ``low`` on are too many
        step = -(-width // parts)
        inside = edges.where((F.col("n") >= low) & (F.col("n") < low + width))
        spread = dict(inside.groupBy(F.floor((F.col("n") - low) / step)).count().toDF("part", "edges").collect())
        for part in sorted(spread, reverse=True):
            if size + spread[part] > max_edges:
                if step == 1:
                    return low + part + 1
                low, width = low + part * step, min(step, width - part * step)
                break
            size += spread[part]


def edges_of(counts: DataFrame) -> DataFrame:
    """(edge, n) of all orders, from tables in the shared folder."""
    out = counts.where("kind = 0").select(F.col("code").alias("edge"), "n")
    # each shorter order is summed from the next longer one, which is written first
    now = out.where(F.shiftright("edge", TAG) == NEAR + 1).select(F.col("edge").alias("code"), "n")
    for j in range(NEAR - 1, -1, -1):
        shorter = F.col("code").bitwiseAND(F.lit((1 << WIDTH * (j + 1)) - 1))
        now = stage(now.groupBy(shorter.alias("code")).agg(F.sum("n").alias("n")), f"order{j}")
        out = out.unionByName(now.select(F.col("code").bitwiseOR(F.lit((j + 1) << TAG)).alias("edge"), "n"))
    return out


def with_words(counts: DataFrame, edges: DataFrame, hot_words: int) -> Model:
    """The model of these edges, which come to the driver, and of all words."""
    words, texts = counts.where("kind = 1"), counts.where("kind = 2")
    n = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = words.orderBy(F.desc("n"), "word").limit(hot_words).select("word", "n").toArrow()
    got = edges.toArrow()
    return Model(got["edge"].to_numpy().astype(np.uint64), got["n"].to_numpy(), hot["word"].combine_chunks(),
                 hot["n"].to_numpy(), n["n"] + ends, n["v"] + int(ends > 0), ends)


def fit(counts: DataFrame, hot_words: int = 300_000, max_edges: int = 2_000_000) -> Model:
    """A model that fits into memory: of the edges with a least count, ``max_edges`` at most.  ``score`` uses all edges."""
    edges = edges_of(counts)
    least = least_count(edges, max_edges)
    return with_words(counts, edges.where(F.col("n") >= least), hot_words)


def frequent_strings(edges: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, log10 of the probabilities in the full model) of the most frequent whole strings, ``most`` at most."""
    whole = edges.where(F.col("edge") >= F.lit((ORDER + 1) << TAG)).withColumn("context", F.shiftright("edge", WIDTH))
    least = least_count(whole, most)
    totals = whole.groupBy("context").agg(F.sum("n").alias("total"))
    got = whole.where(F.col("n") >= least).join(totals, "context").select("edge", "n", "total").toArrow()
    code = got["edge"].to_numpy().astype(np.uint64) & np.uint64((1 << TAG) - 1)
    return code, np.log10((2.0 * got["n"].to_numpy() - 1) / (2.0 * got["total"].to_numpy())).astype(np.float32)


def resolved(edges: DataFrame, asked: DataFrame, model: Broadcast, buckets: int) -> DataFrame:
    """(rid, score): sum of the code lengths of the strings asked for, (rid, bucket, codes, owners), for every rid that asks.

    ``owners`` count from ``rid``, which tells the partition of the input in its bits above ``PART``.
    """
    longer = edges.where(F.col("edge") >= F.lit((NEAR + 1) << TAG)).select("edge", "n")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            bucket, keys, counts = packed(np.concatenate([k for k, _ in wait]), np.concatenate([c for _, c in wait]), buckets)
            wait.clear()
            k = len(bucket)
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), pa.array(np.full(k, -1), pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(counts, pa.binary())], ["bucket", "rid", "codes", "others"])

        for b in batches:
            wait.append((b.column(0).to_numpy().astype(np.uint64), b.column(1).to_numpy().astype(np.int64)))
            if sum(len(k) for k, _ in wait) > SLICE:
                yield rows()
        if wait:
            yield rows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = model.value
        at, here = -1, short
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        ask: list[tuple[int, np.ndarray, np.ndarray]] = []
        rids: list[np.ndarray] = []
        costs: list[np.ndarray] = []
        fresh = True

        def settle() -> None:
            nonlocal here, fresh
            if not ask:
                return
            if fresh:
                here = replace(short, edges=np.concatenate([short.edges, *keys]), counts=np.concatenate([short.counts, *counts]))
                keys.clear()
                counts.clear()
                fresh = False
            c, n = counted([o.astype(np.int64) + r for r, _, o in ask], [here.code_length(np.concatenate([c for _, c, _ in ask]))])
            rids.append(c)
            costs.append(n)
            ask.clear()

        def sums() -> pa.RecordBatch:
            r, c = counted(rids, costs)
            rids.clear()
            costs.clear()
            part = r >> PART
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(r)]
            pieces = [slice(a, z) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array([int(part[p.start]) for p in pieces], pa.int64()), pa.array([planes(r[p]) for p in pieces], pa.binary()),
                 pa.array([c[p].tobytes() for p in pieces], pa.binary())], ["part", "rids", "scores"])

        for b in batches:
            for bucket, rid, code, other in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if bucket != at:
                    settle()
                    keys.clear()
                    counts.clear()
                    at, fresh = bucket, True
                if rid < 0:  # edges come before the strings
                    keys.append(from_planes(code, np.uint64))
                    counts.append(from_planes(other, np.int64))
                else:
                    ask.append((rid, from_planes(code, np.uint64), from_planes(other, np.uint32)))
                    if len(ask) * CHUNK > STEP:
                        settle()
                        if sum(map(len, rids)) > SLICE:
                            yield sums()
        settle()
        if rids:
            yield sums()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size = -1, 0
        wait: list[tuple[np.ndarray, np.ndarray]] = []

        def total() -> tuple[np.ndarray, np.ndarray]:
            return counted([r for r, _ in wait], [c for _, c in wait])

        for b in batches:
            for part, rid, score in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if part != at and wait:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in total()], ["rid", "score"])
                    wait.clear()
                    size = 0
                at = part
                wait.append((from_planes(rid, np.int64), np.frombuffer(score)))
                size += len(wait[-1][0])
                if size > SLICE:
                    wait[:] = [total()]
                    size = 0
        if wait:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in total()], ["rid", "score"])

    dealt = longer.mapInArrow(deal, "bucket int, rid bigint, codes binary, others binary")
    sums = (dealt.unionByName(asked.select("bucket", "rid", "codes", F.col("owners").alias("others")))
            .repartition("bucket").sortWithinPartitions("bucket", "rid").mapInArrow(run, "part bigint, rids binary, scores binary"))
    return sums.repartition("part").sortWithinPartitions("part").mapInArrow(added, "rid bigint, score double")


def score(df: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", hot_words: int = 300_000,
          max_edges: int = 2_000_000) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score) of every row of ``df``.

    ``training`` tells the rows to learn from.  ``score`` is the model's log10 probability of the whole text, ``base_score``
    that of its tokens under smoothed unigrams, ``n_known`` the tokens that training has.  ``hot_words`` and ``max_edges``
    bound what the tasks look up by themselves and don't change a result.
    """
    counts = count_strings_and_words(df.where(training), text)
    edges = edges_of(counts)
    short = F.col("edge") < F.lit((NEAR + 1) << TAG)
    model = with_words(counts, edges.where(short), hot_words)
    held = df.sparkSession.sparkContext.broadcast(model)
    often = df.sparkSession.sparkContext.broadcast(frequent_strings(edges, max_edges))
    buckets = max(12, edges.where(~short).count() // BUCKET)
    rows = df.select(F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id"),
                     F.coalesce(training, F.lit(False)).alias("training"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rare_kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        index, logs = m.words
        known_codes, known_costs = often.value
        frequent = Table(known_codes, known_costs)
        first, done = TaskContext.get().partitionId() << PART, 0
        rest: list[tuple[np.ndarray, np.ndarray]] = []

        def asked() -> pa.RecordBatch:
            bucket, codes, owners = packed(np.concatenate([c for c, _ in rest]), np.concatenate([o for _, o in rest]), buckets)
            rest.clear()
            columns = {"rid": pa.array(np.full(len(bucket), first), pa.int64()), "bucket": pa.array(bucket, pa.int32()),
                       "codes": pa.array(codes, pa.binary()), "owners": pa.array(owners, pa.binary())}
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(bucket), f.type)) for f in fields], [f.name for f in fields])

        end = float(np.log10((m.ends + 0.1) / m.denominator))
        for whole in batches:
            fields = [pa.field("rid", pa.int64()), whole.schema.field(1).with_name("doc_id"), pa.field("training", pa.bool_()),
                      pa.field("n_tokens", pa.int64()), pa.field("n_known", pa.int64()), pa.field("base_score", pa.float64()),
                      pa.field("score", pa.float64()), pa.field("rare", rare_kind), pa.field("bucket", pa.int32()),
                      pa.field("codes", pa.binary()), pa.field("owners", pa.binary())]
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                texts = [lowered(t.as_py()) for t in b.column(0)]
                sums = np.zeros(len(texts))
                wait: list[tuple[int, np.ndarray]] = []
                size = 0

                def settle(done: int, sums: np.ndarray = sums, wait: list = wait) -> None:
                    code = np.concatenate([c for _, c in wait])
                    owner = np.repeat([k for k, _ in wait], [len(c) for _, c in wait])
                    hit, cost = frequent.find(code)
                    sums += np.bincount(owner, cost, len(sums))
                    rest.append((code[~hit], (owner[~hit] + done).astype(np.uint32)))
                    wait.clear()

                for k, t in enumerate(texts):
                    for c in strings(t):
                        wait.append((k, c))
                        size += len(c)
                        if size > STEP:
                            settle(done)
                            size = 0
                            if sum(len(c) for c, _ in rest) > SLICE:
                                yield asked()
                if wait:
                    settle(done)
                if sum(len(c) for c, _ in rest) > SLICE:
                    yield asked()
                n_tokens, n_known, base, rare = [], [], [], []
                for t in texts:
                    words = words_of(t)
                    k = np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))
                    hot = k >= 0
                    n_tokens.append(len(words) + 1)
                    n_known.append(int(hot.sum()) + int(m.ends > 0))
                    base.append(float(logs[k[hot]].sum()) + end)
                    rare.append([{"word": w, "n": c} for w, c in Counter([words[i] for i in np.flatnonzero(~hot)]).items()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first + done + i for i in range(len(texts))], pa.int64()), b.column(1), b.column(2),
                     pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()),
                     pa.array(sums, pa.float64()), pa.array(rare, rare_kind), pa.nulls(len(texts), pa.int32()),
                     pa.nulls(len(texts), pa.binary()), pa.nulls(len(texts), pa.binary())], [f.name for f in fields])
                done += len(texts)
        if rest:
            yield asked()

    both = stage(rows.mapInArrow(run, f"rid bigint, doc_id {kind}, training boolean, n_tokens bigint, n_known bigint, "
                                      "base_score double, score double, rare array<struct<word string, n bigint>>, "
                                      "bucket int, codes binary, owners binary"), "scored")
    each = both.where("bucket is null").drop("bucket", "codes", "owners")
    cold = resolved(edges, both.where("bucket is not null"), held, buckets).withColumnRenamed("score", "cold")
    known = counts.where("kind = 1").select("word", F.col("n").alias("c"))
    rest = (each.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.n").join(known, "word", "left")
            .groupBy("rid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"),
                                F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(model.denominator))).alias("add")))
    return each.join(rest, "rid", "left").join(cold, "rid", "left").select(
        "doc_id", "training", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(model.tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("add", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("cold", F.lit(0.0))).alias("score"))
