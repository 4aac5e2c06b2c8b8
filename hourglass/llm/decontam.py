"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Words are the lower-cased runs of letters and digits.  A document leaks a benchmark item if, laid against the item at
some offset, a window of ``WINDOW`` words agrees in all but ``SUBSTITUTIONS`` of them.  Two fixed masks (``MASKS``) pick
6 of 8 or 9 neighbouring words; whichever two words of a window are replaced, one of the masks finds six untouched ones
there (a test runs through all cases), so no leak is missed.  Test and training hashes are joined, hits that lie on one
diagonal (document, item, offset) are one candidate, and each candidate is verified word by word around its hits.

Shorter items are sought whole: those of ``SHORT`` to 12 words with one word replaced at most, through three masks that
pick 6 of up to 8 neighbouring words and miss none of them (tested likewise), those of 1 to 7 words unchanged, through a mask
of their own length.

A document's positions are first tested against a bitmap of the benchmark's hashes, by the pair of words that begins every
mask (but that of a single word) and then by the masks, all at one place of the plan.  Its size has a bound (2**22 bits), so
the literal in the plan has one too, however large the benchmark; a full bitmap would only let more rows into the join.  A
small benchmark's bitmap is folded to some 32 bits a hash, as the driver keeps the plan, its texts and its tasks' copies.
Only positions that pass leave the map side, as (key, position, hash); documents meet their candidates by content key.

Defined results: null and empty texts, in documents or in the benchmark, match nothing; equal items count once, under
their smallest id; repeated rows of documents (same id and text) share their result rows; no benchmark, or an empty table,
gives an empty result; other columns are neither read nor needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_key, stage, with_likely_keys

WINDOW, SUBSTITUTIONS, SHORT = 13, 2, 8
PAIR = (0, 1)
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 7, 8))
SHORT_MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 4, 5, 6, 7), (0, 1, 2, 3, 6, 7))
BITS = 22


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text; null for a null text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(words: Column, at: Column, k: int, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + F.lit(o)) for o in mask])


def _starts(words: Column, mask: tuple[int, ...]) -> Column:
    """Positions at which the mask fits into the words."""
    n = F.size(words) - F.lit(mask[-1] + 1)
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def _all_masks() -> list[tuple[int, int, tuple[int, ...]]]:
    """(least words, most words, mask): which items each mask seeks."""
    whole = [(n, n, tuple(range(n))) for n in range(1, SHORT)]
    return whole + [(SHORT, WINDOW - 1, m) for m in SHORT_MASKS] + [(WINDOW, 1 << 30, m) for m in MASKS]


def _seeds(words: Column, k: int, mask: tuple[int, ...]) -> Column:
    return F.transform(_starts(words, mask),
                       lambda i: F.struct(i.alias("pos"), _seed(words, i, k, mask).alias("seed")))


def _pairs(words: Column) -> Column:
    return F.transform(_starts(words, PAIR), lambda i: _seed(words, i, -1, PAIR))


def _bitmap(seeds: DataFrame) -> tuple[Column, int]:
    """2**bits bits as a constant array of longs (at most 2**(BITS - 6) rows come to the driver), and their number ``bits``."""
    slot = F.col("seed").bitwiseAND(F.lit((1 << BITS) - 1))
    rows = (seeds.select(slot.alias("slot")).distinct()
            .groupBy(F.shiftright("slot", 6).cast("int").alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("slot") % 64).cast("int"))).alias("bits"))
            .collect())
    n = sum((r["bits"] & ((1 << 64) - 1)).bit_count() for r in rows)
    bits = min(BITS, max(12, (32 * n).bit_length()))
    words = [0] * (1 << (bits - 6))
    for r in rows:
        words[r["word"] % len(words)] |= r["bits"]  # signed, as longs are
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>"), bits


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, key, item_id, doc_start, n_compared, n_matched, n_places): the best overlap of each document and item.

    ``doc_start`` is the word of the document on which the item's first compared word lies, ``n_compared`` the words of
    the item that lie within the document, ``n_matched`` those that agree, ``n_places`` the offsets that leak.  ``key``
    is the document's content key over id and text.
    """
    items = (benchmark.select(F.col(item_id).alias("item_id"), word_hashes(F.col(item_text)).alias("item"))
             .where(F.size("item") > 0).groupBy("item").agg(F.min("item_id").alias("item_id")))
    items = stage(items.withColumn("n", F.size("item")), "benchmark")
    kinds = items.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect()  # 13 at most
    used = {k: (lo, hi, m) for k, (lo, hi, m) in enumerate(_all_masks())
            if any(min(lo, WINDOW) <= r["n"] <= min(hi, WINDOW) for r in kinds)}
    if not used:  # no benchmark: a mask that finds nothing keeps the plan alike
        used = {0: _all_masks()[0]}
    seeds = reduce(DataFrame.unionByName, [
        items.where(F.col("n").between(lo, hi)).select("item", "item_id", "n", F.explode(_seeds(F.col("item"), k, m)).alias("s"))
        for k, (lo, hi, m) in used.items()])
    seeds = stage(seeds.select("item_id", F.xxhash64("item").alias("item_key"), F.col("s.pos").alias("item_pos"),
                               F.col("s.seed").alias("seed")), "seeds")
    pairs = items.select(F.explode(_pairs(F.col("item"))).alias("seed"))
    bitmap, bits = _bitmap(seeds.select("seed").unionByName(pairs))

    def known(h: Column) -> Column:
        slot = h.bitwiseAND(F.lit((1 << bits) - 1))
        word = F.get(bitmap, F.shiftright(slot, 6).cast("int"))
        return F.call_function("shiftright", word, (slot % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
                       content_key(doc_id, text).alias("key"))
    tokens = rows.select("key", word_hashes(F.col("text")).alias("words"))
    w = F.col("words")

    # longer masks begin with two neighbours: positions whose pair the benchmark doesn't have go before the masks are tried
    tokens = tokens.withColumn("at", F.filter(_starts(w, PAIR), lambda i: known(_seed(w, i, -1, PAIR))))

    def passing(at: Column, masks: list[tuple[int, tuple[int, ...]]]) -> Column:
        here = F.flatten(F.transform(at, lambda i: F.array(*[
            F.struct(i.alias("pos"), F.when(i + F.lit(m[-1]) < F.size(w), _seed(w, i, k, m)).alias("seed")) for k, m in masks])))
        return F.filter(here, lambda x: F.coalesce(known(x["seed"]), F.lit(False)))

    long, single = ([(k, m) for k, (_, _, m) in used.items() if (len(m) > 1) == more] for more in (True, False))
    found = [passing(at, masks) for at, masks in ((F.col("at"), long), (_starts(w, (0,)), single)) if masks]
    # no filter on ``at``: the optimiser would push it down and compute the words anew for every position
    hits = (tokens.select("key", F.explode(F.concat(*found)).alias("h"))
            .select("key", F.col("h.pos").alias("pos"), F.col("h.seed").alias("seed"))
            .join(seeds, "seed")
            .select("key", "item_id", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct())
    hits = stage(hits, "hits")  # few or many: Spark then knows their size when it plans the join with the texts
    best = (hits.join(items.select("item", "item_id", "n", F.xxhash64("item").alias("item_key")), ["item_id", "item_key"])
            .join(with_likely_keys(rows, hits), "key"))
    # the words of the document that the item covers, cut out before anything else is done with the row
    first = F.greatest(F.lit(0), -F.col("shift"))
    cut = best.select("key", "doc_id", "item_id", "n", "shift", first.alias("first"),
                      F.slice("item", first + 1, F.col("n")).alias("item"),
                      F.slice(word_hashes(F.col("text")), first + F.col("shift") + 1, F.col("n")).alias("part"))
    m = F.least(F.size("item"), F.size("part"))
    same = F.transform(F.sequence(F.lit(1), m), lambda i: (F.get("item", i - 1) == F.get("part", i - 1)).cast("int"))
    scored = cut.select("key", "doc_id", "item_id", "n", (F.col("first") + F.col("shift")).alias("doc_start"),
                        same.alias("same"))
    length = F.least(F.lit(WINDOW), F.col("n"))
    least = length - F.when(F.col("n") >= WINDOW, F.lit(SUBSTITUTIONS)).when(F.col("n") >= SHORT, F.lit(1)).otherwise(F.lit(0))
    windows = F.when(F.size("same") >= length, F.sequence(F.lit(1), F.size("same") - length + 1)).otherwise(
        F.array().cast("array<int>"))
    leak = F.exists(windows, lambda i: F.aggregate(F.slice("same", i, length), F.lit(0), lambda a, x: a + x) >= least)
    found = scored.where(leak).withColumn("n_matched", F.aggregate("same", F.lit(0), lambda a, x: a + x))
    return (found.groupBy("key", "doc_id", "item_id")
            .agg(F.max(F.struct("n_matched", (-F.col("doc_start")).alias("at"), F.size("same").alias("n"))).alias("b"),
                 F.countDistinct("doc_start").alias("n_places"))
            .select("doc_id", "key", "item_id", (-F.col("b.at")).cast("bigint").alias("doc_start"),
                    F.col("b.n").cast("bigint").alias("n_compared"), F.col("b.n_matched").cast("bigint").alias("n_matched"),
                    "n_places"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that leak a benchmark item; all columns stay."""
    leaks = stage(find_leaks(docs, benchmark, doc_id, text).select("key").distinct(), "leaks")  # few: Spark then knows it
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), content_key(doc_id, text).alias("key"))
    return rows.join(leaks, "key", "left_anti").select("row.*")
