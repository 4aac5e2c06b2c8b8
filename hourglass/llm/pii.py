"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction on top, in DataFrame operations only.

Seeds are the spans of four fixed patterns (``email``, ``ip``, ``card``, ``phone``), leftmost and without overlap for each
kind, that pass their checks.  Candidates are the matches of looser patterns of the same kinds, with the word before and
the word after as context.  A lexical pattern is a kind with the word before, with the word after, or with both; a
candidate surface (an instance) hangs on the patterns it occurs in.  Over this graph Spark repeats, from the seeds on:

* a pattern's confidence is the share of its occurrences whose instance is accepted, if at least ``support`` different
  accepted instances support it;
* an instance is accepted if it is a seed, or one of its patterns has a confidence of ``confidence`` or more.

Until nothing is added, however long the chain, and the occurrences of accepted instances in such patterns become spans,
unless a span of their kind overlaps them.  Base spans always stay.  (``most_rounds`` is far beyond any chain; an error is
raised there rather than spans left out.)

The graph is summed to (kind, instance, pattern) counts before any round, patterns are scored by grouped sums, and a hot
context word is a partial sum in each map task.  Places come from the lengths of the pieces between matches, by a window
over one document's matches; only context words and lengths leave the map side, never texts.  Context words are whole
words; one of more than ``LONG`` characters is named by its SHA-256, so that its size is bounded.

Defined results: a null or empty text has no spans; repeated rows are searched one by one with the same result; a text of
any length is searched whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import content_key, stage

KINDS = ("email", "ip", "card", "phone")
LONG = 64
# The patterns of the contract.  Their runs are made possessive and start where a run starts (or where the
# last match ended), which finds the same matches in time linear in the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What an identifier of each kind that the fixed pattern misses may look like: obscured or partial addresses, groups of
# digits with other separators, numbers without the plus sign.
LOOSE = {
    "email": r"(?<![^\s<(\[])[A-Za-z0-9._%+-]++(?:\x20?[\[(]at[\])]\x20?|@)[A-Za-z0-9-]++"
             r"(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of 13 to 19 digits has a valid check digit."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def passes(kind: str, s: Column) -> Column:
    """Whether a match of the base pattern of ``kind`` counts."""
    digits = _digits(s)
    if kind == "ip":
        parts = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) > 3, F.lit(False)).otherwise(
            F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _next_word(gap: Column, backwards: bool) -> Column:
    """The word of ``gap`` next to a match, in lower case; the search is anchored, so it is linear in the text."""
    word = F.regexp_extract(F.reverse(gap) if backwards else gap, r"^\s*+(\S++)", 1)
    word = F.lower(F.reverse(word) if backwards else word)
    return F.when(F.length(word) <= LONG, word).otherwise(F.sha2(word, 256))


def _matches(text: Column, pattern: str, might: Column) -> Column:
    """Array of (gap, size, surface, before, after) for each match: the lengths of the text before it since the last match
    and of itself, itself, and the words next to it.  ``might`` is a cheap test that texts without matches fail."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    row = F.transform(found, lambda s, i: F.struct(
        F.length(F.get(gaps, i)).alias("gap"), F.length(s).alias("size"), s.alias("surface"),
        _next_word(F.get(gaps, i), True).alias("before"), _next_word(F.get(gaps, i + 1), False).alias("after")))
    empty = F.array().cast("array<struct<gap:int,size:int,surface:string,before:string,after:string>>")
    return F.when(might, row).otherwise(empty)


def _might(text: Column, kind: str, loose: bool) -> Column:
    if kind == "email":
        return F.contains(text, F.lit("@")) | (F.rlike(text, F.lit(r"(?:\[|\()at(?:\]|\))")) if loose else F.lit(False))
    if kind == "phone" and not loose:
        return F.contains(text, F.lit("+"))
    if kind == "ip" and loose:
        return F.contains(text, F.lit(":"))
    return F.rlike(text, F.lit("[0-9]"))


def matches_of(rows: DataFrame, patterns: dict[str, str], loose: bool) -> DataFrame:
    """(key, kind, at, gap, size, surface, before, after) of all matches in (key, text) rows, once for each key."""
    text = F.col("text")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), _matches(text, p, _might(text, k, loose)).alias("found"))
                     for k, p in patterns.items()])
    flat = rows.select("key", F.explode(each).alias("e")).select("key", "e.kind", F.posexplode("e.found").alias("at", "m"))
    # rows with one text find the same matches: any of them will do
    return (flat.select("key", "kind", "at", "m.*").groupBy("key", "kind", "at")
            .agg(*[F.first(c).alias(c) for c in ("gap", "size", "surface", "before", "after")]))


def with_places(matches: DataFrame) -> DataFrame:
    """(key, kind, start, end, surface, before, after)"""
    w = Window.partitionBy("key", "kind").orderBy("at")  # the matches of one text
    return (matches.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(w))
            .select("key", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "surface", "before", "after"))


def base_spans(rows: DataFrame) -> DataFrame:
    """(key, kind, start, end, surface, before, after) of the matches of the fixed patterns that pass their checks."""
    ok = F.lit(False)
    for k in KINDS:
        ok = F.when(F.col("kind") == k, passes(k, F.col("surface"))).otherwise(ok)
    return with_places(matches_of(rows, BASE, False)).where(ok)


def _patterns() -> Column:
    """The lexical patterns of an occurrence; the start and the end of a text are words of their own."""
    before = F.when(F.col("before") == "", "^").otherwise(F.col("before"))
    after = F.when(F.col("after") == "", "$").otherwise(F.col("after"))
    return F.array(F.concat(before, F.lit(" _")), F.concat(F.lit("_ "), after), F.concat(before, F.lit(" _ "), after))


def instance(kind: Column, surface: Column) -> Column:
    """Surfaces that name one identifier: digits of numbers, addresses in lower case."""
    return F.when(kind.isin("card", "phone"), _digits(surface)).otherwise(F.lower(surface))


def bootstrap(seeds: DataFrame, candidates: DataFrame, support: int = 5, confidence: float = 0.9,
              most_rounds: int = 1000) -> DataFrame:
    """(kind, instance, pattern) of the graph whose instance is accepted and whose pattern is confident at the end.

    Accepted instances only grow in number, hence so do the patterns' scores, and the rounds come to an end.
    """
    def graph(o: DataFrame, seed: bool) -> DataFrame:
        return (o.select("kind", instance(F.col("kind"), F.col("surface")).alias("instance"),
                         F.explode(_patterns()).alias("pattern"))
                .groupBy("kind", "instance", "pattern").agg(F.count(F.lit(1)).alias("n")).withColumn("seed", F.lit(seed)))

    edges = stage(graph(seeds, True).unionByName(graph(candidates, False))
                  .groupBy("kind", "instance", "pattern").agg(F.sum("n").alias("n"), F.max("seed").alias("seed")), "graph")
    # the surfaces of seeds count as seeds wherever they stand; only patterns of seeds can ever be confident at first
    accepted = stage(edges.where("seed").select("kind", "instance").distinct(), "accepted")
    have = accepted.count()
    for _ in range(most_rounds):
        known = edges.join(accepted.withColumn("good", F.lit(1)), ["kind", "instance"], "left")
        scored = (known.groupBy("kind", "pattern")
                  .agg(F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum("n").alias("all"),
                       F.count("good").alias("support")))
        confident = stage(scored.where((F.col("support") >= support) & (F.col("pos") >= confidence * F.col("all")))
                          .select("kind", "pattern"), "patterns")
        more = stage(edges.join(confident, ["kind", "pattern"]).select("kind", "instance").unionByName(accepted).distinct(),
                     "accepted")
        now = more.count()
        if now == have:
            break
        accepted, have = more, now
    else:
        raise RuntimeError(f"the bootstrap still grows after {most_rounds} rounds")
    return edges.where("not seed").join(confident, ["kind", "pattern"]).select("kind", "instance", "pattern").distinct()


def find_pii(df: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = 5, confidence: float = 0.9,
             most_rounds: int = 1000) -> DataFrame:
    """(doc_id, key, spans, found): ``spans`` are (kind, start, end, surface, base) sorted by kind as listed, then start.

    ``found`` is the same without what the bootstrap added.  ``start`` and ``end`` count code points, ``end`` exclusive.
    """
    all_rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
                         content_key(text).alias("key"))  # equal texts have equal spans
    some = all_rows.where(F.rlike("text", F.lit(r"[0-9@]|[\[(]at[\])]"))).select("key", "text")
    seeds = stage(base_spans(some), "spans")
    loose = stage(with_places(matches_of(some, LOOSE, True)), "candidates")
    taken = seeds.select("key", "kind", F.col("start").alias("s"), F.col("end").alias("e"))
    fresh = loose.join(taken, (loose.key == taken.key) & (loose.kind == taken.kind) & (loose.start < taken.e)
                       & (taken.s < loose.end), "left_anti")
    fresh = stage(fresh, "fresh")
    good = bootstrap(seeds, fresh, support, confidence, most_rounds)
    added = (fresh.withColumn("instance", instance(F.col("kind"), F.col("surface"))).withColumn("pattern", F.explode(_patterns()))
             .join(good, ["kind", "instance", "pattern"], "left_semi").select("key", "kind", "start", "end", "surface").distinct())
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = (seeds.select("key", "kind", "start", "end", "surface").withColumn("base", F.lit(True))
             .unionByName(added.withColumn("base", F.lit(False)))
             .groupBy("key").agg(F.sort_array(F.collect_list(F.struct(
                 order.alias("rank"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"),
                 "kind", "surface", "base"))).alias("spans")))  # the spans of one text
    out = all_rows.select("doc_id", "key").join(spans, "key", "left")
    empty = F.array().cast(spans.schema["spans"].dataType)
    out = out.withColumn("spans", F.coalesce("spans", empty))
    return out.withColumn("found", F.filter("spans", lambda s: s["base"]))
