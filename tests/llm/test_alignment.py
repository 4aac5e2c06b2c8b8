"""Alignment of two tokenizers against a plain version that walks over byte offsets."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as E
from hourglass.llm import alignment
from hourglass.llm.queries import bpe_path, piece_path

SF = "/root/testdata/sf0.001"


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(bpe_path())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path())
        self.bytes_a = alignment.token_bytes(bpe_path())

    def byte_string(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ends(self, text):
        """(ids and ends of A, ids and ends of B), or nothing."""
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        out = []
        for ids, of in ((a, self.bytes_a.__getitem__), (b, self.byte_string)):
            at, run, joined = 0, [], b""
            for i in ids:
                at += len(of(i))
                joined += of(i)
                run.append((i, at))
            if joined != (" " + text).encode():
                return [], []
            out.append(run)
        return tuple(out)


def brute(rows):
    """doc rows (id, text) -> Counter of result rows."""
    plain, done, count = Plain(), [], Counter()
    for d, text in rows:
        a, b = plain.ends(text)
        ends_a, ends_b = defaultdict(list), defaultdict(list)
        for i, e in a:
            ends_a[e].append(i)
        for i, e in b:
            ends_b[e].append(i)
        both = sorted(set(ends_a) & set(ends_b))
        links = [(x, y) for e in both for x in ends_a[e] for y in ends_b[e]]
        groups, low = [], 0
        for e in both:
            groups.append(",".join(str(i) for i, x in a if low < x <= e) + "|" + ",".join(str(i) for i, x in b if low < x <= e))
            low = e
        count.update(links)
        done.append((d, len(a), len(b), len(groups), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return Counter((d, na, nb, ng, len(ln), sum(count[x] == most[x[1]] for x in ln), sum(count[x] for x in ln), g)
                   for d, na, nb, ng, ln, g in done)


ODD = ["", None, " ", "  two  spaces ", "a\tb\nc\n\n", "▁sign", "x ▁y", "<s>hi</s> <|endoftext|> <0x41>", "ﬁ ² ①  x​z",
       "漢字かな交じり文 😀😀", "\x00nul", "é é", "word " * 3000 + "end", "x" * 5000, "same text", "same text"]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def test_odd_rows(spark):
    rows = [*enumerate(ODD), (None, "no id"), (9007199254740993, "large id")]
    df = spark.createDataFrame([(d, t, "extra", 1) for d, t in rows], "doc_id bigint, text string, groups string, block int")
    for block in (alignment.BLOCK, 50):
        got = alignment.align(df.repartition(3), bpe_path(), piece_path(), block=block).select(*COLUMNS)
        assert Counter(map(tuple, got.collect())) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align(df, bpe_path(), piece_path()).collect() == []


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(rows))
    got = E.queries()["op13_alignment"](spark, SF)
    assert Counter(map(tuple, got.select(*COLUMNS[:-1], "groups_sha256").collect())) == want


@given(st.lists(st.integers(1, 60), unique=True), st.lists(st.integers(1, 60), unique=True), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_pieces_find_all_shared_ends(a, b, piece):
    a, b = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    i, j = alignment.shared_ends(a, b, piece)
    assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    cut = alignment.diagonals(a, b, piece)
    sizes = np.diff(np.concatenate(([0], np.arange(piece, len(a) + len(b), piece), [len(a) + len(b)])))
    assert len(cut) == len(sizes) - 1 and (sizes <= piece).all()


@pytest.mark.parametrize("piece", [1, 2, 7, 1000])
def test_piece_size_changes_nothing(piece):
    both = alignment.Aligner(bpe_path(), piece_path())
    texts = [both.tokens(t) for t in ("Alignment of several tokens", "über straße 12345", "a b c")]
    g, w, c = both.align(texts, piece)
    g2, w2, c2 = both.align(texts)
    assert (g, w, c.tolist()) == (g2, w2, c2.tolist())
