"""Language ID and quality classifier: held-out accuracy, the solver's optimum, odd rows."""

import zlib

import numpy as np
import pytest

from hourglass.llm import langid, nbsvm
from hourglass.llm.queries import op9_language_id, op10_quality

SF = "/root/testdata/sf0.01"


def crc(k):
    return zlib.crc32(str(k).encode())


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op9_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == (crc(r.doc_id) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    rows = [(1, "en", "the house and the dog"), (2, "fr", "la maison et le chien"), (3, None, "x"), (4, "en", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(df)
    assert model.languages == ["en", "fr"]
    odd = spark.createDataFrame([(1, None, "n"), (2, "", "n"), (3, "123 !! ", "n"), (None, "le chien " * 30000, "n")],
                                "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] == "fr"
    model.least = 1.1
    assert {r.lang_pred for r in langid.predict(odd, model, reject=True).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model).count() == 0
    none = langid.fit(df.where("lang is null"))
    assert {(r.lang_pred, r.score) for r in langid.predict(df, none).collect()} == {("und", 0.0)}
    signs = spark.createDataFrame([(k, x) for k, x in enumerate(["½", "² ①", "Ⅷ", "12 _", "ª"])], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.predict(signs, langid.fit(df)).orderBy("doc_id").collect()] == [True] * 4 + [False]
    many = langid.fit(spark.createDataFrame([(1, "en", f"text {k}") for k in range(50)] + [(2, "fr", "le")], "doc_id long, lang string, text string"))
    assert many.languages == ["en", "fr"]


def test_word_scores_equal_direct_average():
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b"], rng.normal(size=(1 << langid.BITS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    text = "Ab abc ab é xyz " * 7 + "q" * 400
    x, n = langid.counted(text)
    want = (n[:, None] * model.table[x].astype(np.float64)).sum(axis=0) / n.sum()
    for most in (8, 1000):
        assert np.allclose(langid.WordScores(model, most=most).mean(text), want)


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op10_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.98


def test_dual_coordinate_descent_reaches_the_optimum():
    """Primal and dual objective meet."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0, 1.0, -1.0)
    rows, cost = [np.arange(6)] * 60, np.full(60, 0.7)
    w, b = nbsvm.dual_coordinate_descent(rows, list(x), y, 6, cost, epochs=3000, tolerance=1e-9)
    margin = y * (x @ w + b)
    primal = 0.5 * (w @ w + b * b) + 0.7 * np.maximum(0, 1 - margin).sum()
    for _ in range(200):  # no neighbour does better
        v, c = w + 0.01 * rng.normal(size=6), b + 0.01 * rng.normal()
        assert 0.5 * (v @ v + c * c) + 0.7 * np.maximum(0, 1 - y * (x @ v + c)).sum() >= primal - 1e-9


def test_log_count_ratio():
    r = nbsvm.log_count_ratio([np.array([0, 1]), np.array([0]), np.array([2])], np.array([1, 1, 0]), 2)
    p, q = np.array([3, 2, 1, 1]) / 7, np.array([1, 1, 2, 1]) / 5
    assert np.allclose(r, np.log(p / q))


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(i, "good words stand here" if i % 2 else "bad!! marks!! here!!", 1) for i in range(40)]
                                 + [(77, None, 1), (78, "", 1), (None, "x " * 50000, 1)], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 1), (77, None), (None, 1), (9999, 0)],
                                   "doc_id long, quality int")
    model = nbsvm.fit(docs, labels)
    got = {r.doc_id: r.score for r in nbsvm.score(docs, model).collect()}
    assert len(got) == 43 and got[31] > got[30] and got[77] == got[78] and 0 <= got[None] <= 1
    assert nbsvm.score(docs.limit(0), model).count() == 0
    for part, want in (("quality = 1", 16 / 17), ("quality = 0 and doc_id < 3", 1 / 4), ("quality > 5", 0.5)):
        got = nbsvm.score(docs, nbsvm.fit(docs, labels.where(part))).collect()
        assert all(r.score == pytest.approx(want) for r in got) and len(got) == 43


def test_shapes():
    assert [nbsvm.shape(w) for w in ("word###", "OF!!", "Ab12c", "é", "|", "a" * 70 + "1")] == ["a#", "A!", "Aa0a", "a", "|", "a0"]


@pytest.mark.parametrize("query", ["op9_language_id", "op10_quality", "op12_toxicity"])
def test_empty_tables(spark, tmp_path, query):
    import __spark_entry__ as E
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert E.queries()[query](spark, str(tmp_path)).collect() == []


def test_the_driver_holds_no_training_rows(spark, monkeypatch):
    from hourglass.llm import nbsvm

    rows = [(k, f"{'good' if k % 2 else 'bad'} word{k % 7} text {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(type(docs), "toArrow", lambda df: seen.append(df))  # the training rows would come this way
    model = nbsvm.fit(docs, labels)
    assert model.score(nbsvm.features("good word1 text", nbsvm.Words())) > 0.5 > model.score(nbsvm.features("bad word1 text", nbsvm.Words()))
    assert not seen and len(model.weight) == 1 << nbsvm.BITS
