"""PPM against a plain recursive version, probabilities that sum to one, word scores against a counter."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hourglass.llm import ppm
from hourglass.llm.ppm import ALPHABET, END, ORDER, START, TOKENS, Table, count_strings_and_words, fit, lowered, score, strings
from hourglass.llm.queries import op4_lm_scoring


def symbols(t):
    return [START] * ORDER + list(lowered(t)) + [END]


def tree(texts, least=1):
    top = Counter()
    for t in texts:
        s = symbols(t)
        for i in range(ORDER, len(s)):
            for j in range(ORDER + 1):
                top[tuple(s[i - j:i]), s[i]] += 1
    out = defaultdict(dict)
    for (c, x), n in top.items():
        if n >= least:
            out[c][x] = n
    return out


def cost(trie, context, x):
    p, gone = 1.0, set()
    for j in range(ORDER, -1, -1):
        here = {k: n for k, n in trie.get(tuple(context[len(context) - j:]), {}).items() if k not in gone}
        if here:
            total = 2 * sum(here.values())
            if x in here:
                return p * (2 * here[x] - 1) / total
            p *= len(here) / total
            gone |= set(here)
    return p / max(ALPHABET - len(gone), 1)


TEXTS = ["abracadabra abracadabra", "The theme. THE END", "", None, "aaaaaaaaaaaa", "é ü\tß", "abra \x85cad  x\x1cy"] * 3


def model_of(spark, texts, **kw):
    return fit(count_strings_and_words(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)), **kw)


@pytest.mark.parametrize("max_edges,least", [(10 ** 6, 1), (150, None)])
def test_scores_equal_a_plain_version(spark, max_edges, least):
    m = model_of(spark, TEXTS, max_edges=max_edges)
    assert len(m.edges) <= max_edges
    trie = tree(TEXTS, least or min(m.counts))
    assert sum(map(len, trie.values())) == len(m.edges)
    for t in ["abracadabra", "", "the xyz", "zzzzz", "\x00é€", "abrabrabr THE"]:
        s = symbols(t)
        want = sum(math.log10(cost(trie, s[i - ORDER:i], s[i])) for i in range(ORDER, len(s)))
        assert m.score(lowered(t)) == pytest.approx(want, abs=1e-4)


def test_probabilities_sum_to_one(spark):
    m = model_of(spark, TEXTS)
    for context in ([START] * ORDER, symbols("abrac")[-ORDER - 1:-1], [200] * ORDER, symbols("the t")[-ORDER - 1:-1]):
        code = 0
        for x in context:
            code = code << ppm.WIDTH | x
        codes = np.array([code << ppm.WIDTH | x for x in [*range(0xF8), END] if not 65 <= x <= 90], np.uint64)
        assert len(codes) == ALPHABET and (10 ** m.code_length(codes)).sum() == pytest.approx(1, abs=1e-4)


def test_no_training_is_uniform(spark):
    m = model_of(spark, [])
    assert m.score(b"abc") == pytest.approx(-4 * math.log10(ALPHABET))


@pytest.mark.parametrize("max_edges", [1, 20, 10 ** 6])
def test_scoring_uses_every_edge_whatever_fits_a_task(spark, max_edges):
    import pyspark.sql.functions as F
    texts = [*TEXTS, "abracadabra", "the xyz", "zzzzz", "\x00é€", "abrabrabr THE"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    trie = tree(TEXTS)
    for r in score(df, F.col("doc_id") < len(TEXTS), max_edges=max_edges).collect():
        s = symbols(texts[r.doc_id])
        assert r.score == pytest.approx(sum(math.log10(cost(trie, s[i - ORDER:i], s[i])) for i in range(ORDER, len(s))), abs=1e-4)


def test_slices_equal_the_whole(monkeypatch):
    t = lowered("some text of a few words " * 9)
    whole = np.concatenate(list(strings(t)))
    monkeypatch.setattr(ppm, "SLICE", 7)
    assert (np.concatenate(list(strings(t))) == whole).all() and len(whole) == len(t) + 1


def test_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 60, 5000).astype(np.uint64))
    t = Table(keys, np.arange(len(keys))[:, None])
    known, at = t.find(np.concatenate([keys, keys + np.uint64(1)]))
    assert known[:len(keys)].all() and (at[:len(keys), 0] == np.arange(len(keys))).all()
    assert (known[len(keys):] == np.isin(keys + np.uint64(1), keys)).all()


def brute_words(rows, training):
    toks = lambda t: TOKENS.findall(lowered(t).decode()) + ["\n"]  # noqa: E731  the end is no word
    c = Counter(w for (d, t) in rows if training(d) for w in toks(t))
    n, v = sum(c.values()), len(c)
    return [(d, len(toks(t)), sum(w in c for w in toks(t)), n,
             sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t))) for d, t in rows]


@pytest.mark.parametrize("hot", [3, 1000])
def test_word_scores(spark, hot):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100, "unseen words " * 3000), (3, "the"), (3, "the")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string").repartition(4)
    import pyspark.sql.functions as F
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score < 0)
                 for r in score(df, F.col("doc_id") < 15, hot_words=hot).collect())
    assert got == sorted((*x[:4], round(x[4], 6), True) for x in brute_words(rows, lambda d: d < 15))
    assert score(df.limit(0), F.col("doc_id") < 15).count() == 0


def test_query_beats_unigrams_of_words_on_held_out_text(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    want = {r[0]: r for r in brute_words(rows, lambda d: not held(d))}
    got = op4_lm_scoring(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[1:4] and r.base_score == pytest.approx(w[4], rel=1e-9)
        assert r.held_out == held(r.doc_id)
    kept = [r for r in got if r.held_out]
    assert sum(r.score for r in kept) > sum(r.base_score for r in kept)


@pytest.mark.parametrize("parts", [3, 1000])
def test_least_count(spark, parts):
    counts = [1] * 40 + [2] * 9 + [3, 3, 4, 7, 8, 500, 501, 1023, 1024, 1024, 9_999_999]
    df = spark.createDataFrame([(n,) for n in counts], "n long").coalesce(1)
    for most in (0, 1, 4, 11, 60, 100):
        got = ppm.least_count(df, most, parts)
        assert sum(n >= got for n in counts) <= most and (got == 1 or sum(n >= got - 1 for n in counts) > most)


def test_every_text_has_one_sum_and_its_parts_travel_together(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(20)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = count_strings_and_words(df)
    edges = ppm.edges_of(counts)
    raw = [lowered(t) for t in texts]
    want = Counter(int(e) for t in raw for c in strings(t) for j in range(ORDER + 1) for e in ppm.of_order(c, j))
    assert {r.edge: r.n for r in edges.collect()} == want
    model = ppm.with_words(counts, edges.where(F.col("edge") < F.lit((ppm.NEAR + 1) << ppm.TAG)), 100)
    rows = []
    for part in (0, 5):  # row ids of two partitions of the input
        code = np.concatenate([c for t in raw[:50] for c in strings(t)])
        owner = np.concatenate([np.full(len(t) + 1, k, np.uint32) for k, t in enumerate(raw[:50])])
        for bucket, c, o in zip(*ppm.packed(code, owner, 40), strict=True):
            rows.append((part << ppm.PART, bucket, bytearray(c), bytearray(o)))
    asked = spark.createDataFrame(rows, "rid long, bucket int, codes binary, owners binary")
    got = ppm.resolved(edges, asked, spark.sparkContext.broadcast(model), 40).collect()
    whole = fit(counts)
    assert sorted(r.rid for r in got) == [p << ppm.PART | k for p in (0, 5) for k in range(50)]
    assert all(abs(r.score - whole.score(raw[r.rid & 63])) < 1e-3 for r in got)
