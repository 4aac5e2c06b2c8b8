"""The pipeline against brute force, stage by stage, on the smallest tables."""

import pytest
from test_chosen_path import brute as near_brute
from test_decontam import brute as leak_brute
from test_line_dedup import brute as line_brute
from test_packing import check_pieces
from tokenizers import Tokenizer

import corpus_pipeline as P
from hourglass.llm.queries import bpe_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Rows after each stage, each on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, work in P.STAGES:
        docs = P.stage(work(spark, docs, SF), "test")
        out.append(docs.collect())
    return out


def test_stage_names_and_columns(kept):
    assert len(P.STAGES) == 5 and all(r[0].__fields__ == kept[0][0].__fields__ for r in kept[:5])


def test_quality_drops_what_labels_call_bad(spark, kept):
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in kept[1]}
    assert left < {r.doc_id for r in kept[0]}
    clean = [d in left for d, q in good.items() if q == 1]
    assert sum(clean) >= 0.98 * len(clean)  # 87 labels: one text of four words is too little to go by
    assert sum(d in left for d, q in good.items() if q == 0) <= 1


def test_lines(kept):
    want = line_brute([(r.doc_id, r.source, r.text) for r in kept[1]], 0.1, 2)
    assert sorted((r.doc_id, r.source, r.text) for r in kept[2]) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in kept[2])


def test_near_duplicates(kept):
    rows = [(r.doc_id, r.text) for r in kept[2]]
    want = {d for d, c, _, _ in near_brute(rows) if d == c}
    assert {r.doc_id for r in kept[3]} == want and len(kept[3]) < len(kept[2])


def test_leaks(spark, kept):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, _ in leak_brute([(r.doc_id, r.text) for r in kept[3]], items)}
    assert {r.doc_id for r in kept[4]} == {r.doc_id for r in kept[3]} - bad and bad


def test_packing_and_run(spark, kept):
    t = Tokenizer.from_file(bpe_path())
    want = {r.doc_id: t.encode(r.text, add_special_tokens=False).ids + [1] for r in kept[4]}
    for rows in (kept[5], P.run(spark, SF).collect()):
        check_pieces([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in rows], want)


def test_hostile_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated ids and clashing names go through all stages; so do empty tables."""
    docs = spark.createDataFrame(
        [(None, "null id here", "en", "s", 1, "k"), (1, None, None, None, None, None), (2, "", "en", "s", 0, "k"), (3, "word " * 30_000, "en", "s", 9, "k"),
         (3, "other text of a repeated id", "en", "s", 9, "k"), (4, "same text of two rows", "en", "t", 1, "k"), (4, "same text of two rows", "en", "t", 1, "k")],
        "doc_id long, text string, lang string, source string, n_chars long, `key` string")
    labels = spark.createDataFrame([(1, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int")
    for name, part in (("full", docs), ("empty", docs.limit(0))):
        at = f"{tmp_path}/{name}"
        part.write.parquet(f"{at}/documents.parquet")
        (labels if name == "full" else labels.limit(0)).write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = {(r.doc_id, r.doc_tokens) for r in P.run(spark, at).collect()}
        if name == "empty":
            assert got == set()
        else:
            assert {d for d, _ in got} == {None, 1, 2, 3, 4} and len(got) == 6
