"""Toxicity: held-out accuracy, effect of the counterfactual penalty, optimum of the solver, odd rows."""

import random

import numpy as np
import pytest

import __spark_entry__ as E
from hourglass.llm import toxicity as T

SF = "/root/testdata/sf0.01"
PLAIN = "the meeting started early and we talked about plans for a garden near the river with friends".split()
INSULTS = ["moron", "idiot", "scum"]


def corpus(seed: int, n: int, biased: bool):
    """Insults make a sentence toxic; if ``biased``, insults mostly stand beside one group's name."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        toxic = k % 3 == 0
        w = r.choices(PLAIN, k=12)
        if toxic:
            w.insert(r.randrange(12), r.choice(INSULTS))
        if r.random() < ((0.9 if toxic else 0.05) if biased else 0.3):
            w.insert(r.randrange(12), "muslim")
        rows.append((" ".join(w) + ".", int(toxic)))
    return rows


def fitted(rows, fairness):
    h = T.Hashes()
    changes = [c for t, _ in rows for c in T.counterfactuals(t, h)]
    return T.fit_rows([T.features(t, h) for t, _ in rows], np.array([y for _, y in rows]), changes, fairness=fairness)


def test_penalty_spares_neutral_mentions():
    train = corpus(1, 900, True)
    neutral = [" ".join(random.Random(k).choices(PLAIN, k=12)) + " muslim friend." for k in range(100)]
    fair, biased, h = fitted(train, 10.0), fitted(train, 0.0), T.Hashes()

    def mean(m, texts):
        return np.mean([m.margin(T.features(t, h)) for t in texts])

    without = [t.replace("muslim ", "") for t in neutral]
    assert mean(biased, neutral) - mean(biased, without) > 5 * abs(mean(fair, neutral) - mean(fair, without))
    test = corpus(2, 300, False)
    assert np.mean([(fair.score(T.features(t, h)) >= 0.5) == y for t, y in test]) > 0.97


def test_swaps():
    assert sorted(T.swaps("A Deaf man!", [["patient", "deaf", "blind"]])) == ["a blind man", "a patient man"]
    assert list(T.swaps("nothing here", [["patient", "deaf"]])) == []
    assert T.counterfactuals(None, T.Hashes()) == [] and T.counterfactuals("", T.Hashes()) == []
    assert len(T.counterfactuals("Gay. " * 100, T.Hashes(), [["orientation", "gay"]])) == T.MENTIONS


def test_all_sentences_of_a_text_count():
    h, groups = T.Hashes(), [["orientation", "gay"]]
    assert len(T.counterfactuals("Gay. " * 100, h, groups, most=None)) == 100
    late = "Nice day. " * 5 + "Gay word. " * 40 + "Gay night."
    assert set(T.counterfactuals(late, h, groups, most=None)[-1][1]) <= set(T.features("orientation night", h))


def test_fit_takes_all_sentences_and_counts_equal_ones(spark, monkeypatch):
    """The 21st and later sentences of a text reach the solver, each with the number of its occurrences."""
    texts = [" ".join(f"The deaf man number{k} came." for k in range(30)), "The deaf cat came. " * 50, "A moron.", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    seen = {}

    def caught(rows, y, changes, bits, fairness, times=None):
        seen.update(rows=changes.rows, times=times, at=changes.at)

    monkeypatch.setattr(T, "fit_rows", caught)
    groups = [["patient", "deaf"]]
    T.fit(df, labels, groups=groups)
    every = [c for t in texts for c in T.counterfactuals(t, T.Hashes(), groups, most=None)]
    distinct = {(tuple(a), tuple(b)) for a, b in every}
    assert len(every) == 80 and seen["times"].sum() == 80 and seen["rows"] == len(distinct)
    assert set(seen["at"]) == {k for a, b in every for k in (*a, *b)}


def test_counted_changes_equal_repeated_ones():
    r = np.random.default_rng(5)
    rows = [np.flatnonzero(r.random(12) < 0.4) for _ in range(90)]
    y = np.array([float(0 in x) if r.random() < 0.9 else 1.0 for x in rows])
    one, two = (np.array([0, 3]), np.array([4])), (np.array([1]), np.array([2]))
    whole = T.fit_rows(rows, y, [one] * 7 + [two], 4)
    counted = T.fit_rows(rows, y, [one, two], 4, times=np.array([7, 1]))
    assert np.allclose(whole.weight, counted.weight, atol=1e-6) and whole.bias == pytest.approx(counted.bias, abs=1e-6)


def test_optimum():
    """No step in any single weight lowers the loss."""
    r = np.random.default_rng(3)
    rows = [np.flatnonzero(r.random(12) < 0.4) for _ in range(60)]
    y = np.array([float(0 in x) if r.random() < 0.9 else 1.0 for x in rows])
    changes = [(np.array([1]), np.array([2])), (np.array([0, 3]), np.array([4]))]
    x = T.Sparse(rows, None, 12)
    d = T.Sparse([np.concatenate(c) for c in changes],
                 [np.concatenate((-np.ones(len(a)), np.ones(len(b)))) for a, b in changes], 12)
    share = np.full(60, 1 / 60)
    w, b = T.descend(x, y, share, d, 3.0, 1e-3, 1e-3, steps=5000)

    def loss(w, b):
        dense = np.zeros((60, 12))
        for i, at in enumerate(rows):
            dense[i, at] = 1
        z = dense @ w + b
        moved = [w[c[1]].sum() - w[c[0]].sum() for c in changes]
        return share @ (np.log1p(np.exp(z)) - y * z) + 3 * np.mean(np.square(moved)) + 1e-3 * np.abs(w).sum() + 5e-4 * w @ w

    best = loss(w, b)
    for k in range(12):
        for step in (-0.01, 0.01):
            v = w.copy()
            v[k] += step
            assert loss(v, b) > best - 1e-9


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(1, 1), (2, 1)], 0.75), ([(1, 0), (2, None)], 1 / 3)])
def test_few_classes(spark, labels, want):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (None, None)], "doc_id bigint, text string")
    model = T.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = T.score(docs, model).collect()
    assert len(got) == 3 and all(r["score"] == pytest.approx(want) for r in got)
    empty = docs.where("doc_id > 5")
    assert T.score(empty, T.fit(empty, spark.createDataFrame([], "doc_id bigint, toxic int"))).collect() == []


def test_odd_rows(spark):
    rows = [(k, t, "score", 1) for k, (t, _) in enumerate(corpus(4, 120, False))]
    labels = [(k, y) for k, (_, y) in enumerate(corpus(4, 120, False))] + [(0, 1), (0, 0), (None, 1), (7, None)]
    odd = [(None, "moron", None, 2), (500, None, None, 2), (501, "", "x", 2), (502, "!!! ...", "x", 2), (502, "!!! ...", "x", 2),
           (503, "MORON! " * 50_000, "x", 2), (3, "another text of a labelled id", "x", 2)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id bigint, text string, score string, y int")
    model = T.fit(docs.repartition(3), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = [(r["doc_id"], r["score"], r["predicted"]) for r in T.score(docs, model).collect()]
    assert len(got) == len(rows) + len(odd) and all(0 <= s <= 1 and p == int(s >= 0.5) for _, s, p in got)
    by = dict((d, s) for d, s, _ in got)
    assert by[500] == by[501] == by[502] and by[503] > 0.5 and by[None] > by[500]


def test_query_held_out(spark):
    """Every row comes back, scored as the plain sum over its features does; held-out documents are told apart."""
    got = {r["doc_id"]: r for r in E.queries()["op12_toxicity"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len({r["doc_id"] for r in docs})
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r["predicted"], labels[d]) for d, r in got.items() if r["held_out"] and d in labels]
    assert np.mean([p == y for p, y in held]) > 0.93
