"""Decontamination: the masks miss no window, and results equal a brute-force alignment."""

import itertools
import random
import re

import duckdb

from hourglass.llm import decontam
from hourglass.llm.decontam import BITS, MASKS, SHORT, SHORT_MASKS, SUBSTITUTIONS, WINDOW, drop_leaks, find_leaks
from hourglass.llm.queries import OP5_SQL


def test_masks_are_lossless():
    for gone in itertools.combinations(range(WINDOW), SUBSTITUTIONS):
        assert any(not {at + o for o in mask} & set(gone) for mask in MASKS for at in range(WINDOW - mask[-1]))
    for n in range(SHORT, WINDOW):
        for p in range(n):
            assert any(p not in {at + o for o in mask} for mask in SHORT_MASKS for at in range(n - mask[-1]))


def words(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def brute(docs, items):
    first = {}
    for i, t in items:
        if words(t):
            first[tuple(words(t))] = min(first.get(tuple(words(t)), i), i)
    out = set()
    for d, t in docs:
        w = words(t)
        for b, i in first.items():
            length = min(WINDOW, len(b))
            need = length - (SUBSTITUTIONS if len(b) >= WINDOW else 1 if len(b) >= 8 else 0)
            for shift in range(-len(b) + 1, len(w)):
                lo, hi = max(0, -shift), min(len(b), len(w) - shift)
                same = [b[j] == w[j + shift] for j in range(lo, hi)]
                if any(sum(same[s:s + length]) >= need for s in range(len(same) - length + 1)):
                    out.add((d, i))
                    break
    return out


def make():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["the"] * 30
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([40, 15, 13, 12, 8, 5, 4, 1, 30])] + [(20, None), (21, "")]
    items.append((30, items[0][1].upper() + "!"))  # equal words as item 0
    docs = []
    for d in range(120):
        w = text(rng.randint(0, 80))
        if d % 2:
            b = words(items[d % 9][1])
            a = rng.randint(0, len(b) // 2)
            piece = [x if rng.random() > 0.12 else "zz" for x in b[a:a + rng.randint(8, 40)]]
            w[len(w) // 2:len(w) // 2] = piece
        docs.append((d, rng.choice([" ", ", ", "###\n"]).join(w)))
    return docs + [(200, None), (201, ""), (202, items[2][1]), (None, items[1][1]), (1, docs[1][1]), (1, docs[1][1])], items


def test_matches_brute_force(spark):
    docs, items = make()
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item string, `key` int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(d, b).collect()}
    assert got == brute(docs, items) and len(got) > 15
    kept = drop_leaks(d, b)
    leaky = {k for k, _ in got}
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in docs if k not in leaky)


def test_short_items(spark):
    """One word of an item of 8 to 12 words may be replaced, whichever; shorter items are found unchanged only."""
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in (1, 2, 5, 7, 8, 10, 12)]
    docs, want = [], set()
    for n, t in items:
        w = t.split()
        docs.append((1000 * n, " ".join(["und", *w, "so"])))
        want.add((1000 * n, n))
        for p in range(n):
            docs.append((1000 * n + 1 + p, " ".join(["a", *w[:p], "zz", *w[p + 1:], "b"])))
            if n >= 8:
                want.add((1000 * n + 1 + p, n))
        if n >= 8:
            docs.append((1000 * n + 500, " ".join(["zz", "yy", *w[2:]])))  # two replaced
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = find_leaks(d, b).drop("key")
    assert {(r.doc_id, r.item_id) for r in rows.collect()} == want == brute(docs, items)
    db = duckdb.connect()
    db.register("documents", d.toPandas())
    db.register("benchmark", b.toPandas())
    sql = db.sql(OP5_SQL)
    assert sorted(map(tuple, rows.select(*sql.columns).collect())) == sorted(sql.fetchall())


def test_empty_tables(spark):
    docs, items = make()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert find_leaks(d.limit(0), b).count() == 0
    assert find_leaks(d, b.limit(0)).count() == 0 and drop_leaks(d, b.limit(0)).count() == len(docs)


def test_bitmap_of_a_small_benchmark_is_a_short_literal_that_misses_no_hash(spark):
    rng = random.Random(4)
    for n in (0, 1, 3000):
        seeds = [rng.randrange(-1 << 63, 1 << 63) for _ in range(n)]
        bitmap, bits = decontam._bitmap(spark.createDataFrame([(x,) for x in seeds], "seed long"))
        words = spark.range(1).select(bitmap.alias("b")).first().b
        assert len(words) == 1 << (bits - 6) and bits <= BITS and len(words) <= max(64, n)
        slots = {x & ((1 << bits) - 1) for x in seeds}
        assert {64 * k + j for k, v in enumerate(words) for j in range(64) if v >> j & 1} == slots
    monkey, decontam.BITS = decontam.BITS, 12  # a full bitmap of the largest size
    try:
        bitmap, bits = decontam._bitmap(spark.range(40_000).selectExpr("id as seed"))
        assert bits == 12 and set(spark.range(1).select(bitmap.alias("b")).first().b) == {-1}
    finally:
        decontam.BITS = monkey


def test_masks_share_one_copy_of_the_bitmap(spark, monkeypatch):
    """Items of all lengths use every mask: the literal stands in the plan for pairs, for masks and for single words."""
    seen = []
    real = decontam.stage
    monkeypatch.setattr(decontam, "stage", lambda df, name: seen.append((name, df)) or real(df, name))
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(1, 20)]
    docs = [(100 + n, f"a b {t} c d") for n, t in items] + [(1, "a b c d"), (2, None)]
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                                    spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(100 + n, n) for n, _ in items}
    hits = next(df for name, df in seen if name == "hits")
    assert len(hits._jdf.queryExecution().analyzed().toString()) < 60_000
