"""Packing: exact round trip against the tokenizer itself, windows, leftovers, odd texts."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from hourglass.llm.packing import WIDTH, Packer, merged, pack
from hourglass.llm.queries import bpe_path, op1_packing
from hourglass.llm.tokens import Encoder

ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n x", "x \n", "tab\tand\r\nline", "a\x1cb", "é ü ß   x", "it's we'll",
       "<|endoftext|> x", "hello <|endoftext|> world<|endoftext|>", "<|endoftext|><|endoftext|>", "١٢٣ 12ab!!", "a " * 50, "\U0001F600 \U0001F600", "word. \nNext", "  lead", "trail  ", "x\n\n\ny z",
       "zero​width á", "x﻿y z"]


@pytest.fixture(scope="module")
def hf():
    t = Tokenizer.from_file(bpe_path())
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_encoder_equals_tokenizer(hf):
    e = Encoder(bpe_path(), most=20)  # so small that it is emptied again and again
    rng = random.Random(1)
    made = ["".join(rng.choice("ab é\n\t 1.,'sß \x1f　") for _ in range(60)) for _ in range(300)]
    for s in ODD + made:
        assert np.frombuffer(e.encode(s), "<u4").tolist() == hf(s), repr(s)


def test_query_round_trip(spark, hf):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_packing(spark, sf).collect()
    check_pieces([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in rows],
                 {k: hf(t or "") + [1] for k, t in docs.items()})


def check_pieces(rows, want, capacity=2048):
    by_doc, by_seq = {}, {}
    for d, start, length, crc, n, seq, offset in rows:
        assert n == len(want[d]) and length > 0
        ids = np.array(want[d][start:start + length], "<u4").tobytes()
        assert len(ids) == WIDTH * length and zlib.crc32(ids) == crc
        by_doc.setdefault(d, []).append((start, length))
        by_seq.setdefault(seq, []).append((offset, length))
    assert set(by_doc) == set(want)
    for d, spans in by_doc.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(want[d])
    padding = 0
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0


def test_hostile_rows(spark, hf):
    rows = [(1, None, "x"), (2, "", "y"), (3, "word " * 9000, None), (5, "a", "b"), (5, "a", "b"), (None, "null id", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = pack(df, bpe_path(), windows=2).collect()
    assert sum(r.length for r in got) == sum(len(hf(t or "")) + 1 for _, t, _ in rows)
    assert sum(r.length for r in got if r.doc_id is None) == len(hf("null id")) + 1
    assert pack(df.limit(0), bpe_path()).count() == 0


def test_bounded_windows_and_best_fit():
    done = []
    p = Packer(10, 2, lambda pieces: done.append([(d, s, len(i) // WIDTH) for d, s, i, _ in pieces]))
    for d, n in enumerate([6, 8, 2, 25, 7]):
        p.add(d, bytes(WIDTH * n))
        assert len(p.open) <= 2
    # 2 goes to the window of 8 (best fit, full); 25 is two slices and 5; 5 tops up nothing, opens; 7 fits none: cut
    assert done[:3] == [[(1, 0, 8), (2, 0, 2)], [(3, 0, 10)], [(3, 10, 10)]]
    assert done[3] == [(0, 0, 6), (4, 0, 4)]
    assert [sum(len(x[2]) // WIDTH for x in w) for _, w in p.open] == [5 + 3]


@pytest.mark.parametrize("sizes", [[], [3], [10], [10, 10, 1], [7, 7, 7, 7], [1] * 29])
def test_merge_of_leftovers(sizes):
    seqs = list(merged(iter([(k, 0, bytes(WIDTH * n), n) for k, n in enumerate(sizes)]), 10))
    lengths = [sum(len(p[2]) // WIDTH for p in s) for s in seqs]
    assert sum(lengths) == sum(sizes) and all(n == 10 or n & (n - 1) == 0 for n in lengths)
    assert lengths.count(10) == sum(sizes) // 10


def test_large_ids_beside_a_null(spark):
    """Ids beyond 2**53 come back as they are, in leftovers too."""
    df = spark.createDataFrame([(9007199254740993, "a b"), (None, "c"), (9007199254740995, "d")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in pack(df, bpe_path()).collect()} == {9007199254740993, None, 9007199254740995}
