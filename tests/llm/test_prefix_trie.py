"""Prefix trie against a plain dictionary of prefixes, and roll-ups against plain sums over descendants."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hourglass.llm import prefix_trie as T

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
def rule():
    conv = F.col("conv")
    return F.crc32(conv.cast("string")) % 4, conv - conv % 20


def brute(rows, rebuild=True):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), (role or "").encode().hex().upper() + ":" + hashlib.md5((text or "").encode()).hexdigest(),
                             (role or "", text or "")))
    for c in turns:
        turns[c] = [x for _, _, x in sorted(turns[c], key=lambda x: x[:2])]
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        whole = (turns.get(c - c % 20, [])[:h] + own[h:]) if rebuild else own
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def conversations(seed, n, longest=7):
    r = random.Random(seed)
    out = []
    for c in range(n):
        path = [r.choice("ab" if d < 4 else "abcdef") for d in range(r.randint(0, longest))]
        out += [(c, d, "user" if d % 2 else "assistant", f"turn {x} " * (1 + ord(x) % 3)) for d, x in enumerate(path)]
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ODD = [(None, 1, "user", "no id"), (100, None, "user", "first"), (100, 0, None, "second"), (100, 1, "user", None), (100, 1, "user", None),
       (100, 1, "a", "tie"), (101, 5, "user", ""), (102, None, None, None), (9007199254740993, 0, "user", "large id"),
       (-3, 0, "user", "\x1cnot\x85white space"), (103, 0, "user", "x " * 100_000)]


@pytest.mark.parametrize("small", [T.SMALL, 6])
def test_against_plain(spark, small):
    rows = conversations(5, 60) + ODD[:9] + ODD[10:] + [(200, d, "user", f"long {d}") for d in range(300)] + [(220, d, "user", f"long {d % 7}") for d in range(150)]
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], SCHEMA + ", key string, piece binary").repartition(3)
    got = T.prefix_trie(df, *rule(), small=small).select(*COLUMNS)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_as_they_are(spark):
    rows = conversations(6, 40) + [(c, d, "user", f"same {d}") for c in range(50, 1300) for d in range(2)] + ODD
    got = T.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(2)).select(*COLUMNS)
    assert Counter(map(tuple, got.collect())) == brute(rows, False)


def test_empty(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA), *rule()).collect() == []
    assert T.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "random", "comb"])
def test_centroids_of_one_component(shape):
    r = random.Random(4)
    n = 300
    parent = [-1] + [{"chain": x - 1, "star": 0, "random": r.randrange(x), "comb": x - 1 if x % 2 else max(x - 2, 0)}[shape]
                     for x in range(1, n)]
    value = [r.randrange(10) for _ in range(n)]
    weight, want = [r.randint(1, 5) for _ in range(n)], list(value)
    for x in range(n - 1, 0, -1):
        weight[parent[x]] += weight[x]
        want[parent[x]] += want[x]
    assert T._decompose(parent, weight, [value]) == [want]
