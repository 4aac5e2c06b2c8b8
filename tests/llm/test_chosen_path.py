"""Chosen-path join and components against brute force, in one block and in many."""

import math
import os
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourglass.llm import chosen_path as C
from hourglass.llm.blocks import in_blocks_by_label, in_single_blocks
from hourglass.llm.common import Stages, WordHashes, shingle_hashes, with_likely_keys
from hourglass.llm.components import connected_components


def shingles(t, n=5):
    w = t.lower().split() if t else []
    return {tuple(w[i:i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()


def brute(rows, threshold=0.8):
    s = [shingles(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(range(len(rows)), 2):
        if s[a] and s[b] and len(s[a] & s[b]) >= threshold * len(s[a] | s[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(((rows[k][0], least(rows[j][0] for j in groups[find(k)]), links[k], len(groups[find(k)]))
                   for k in range(len(rows))), key=repr)


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    line = "this common line stands in a great many of the documents here"
    rows = []
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120, 300]))] + line.split() * (g % 2)
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, rows[0][1]), (906, "long " * 30000),
             (907, "long " * 30001), (None, rows[1][1]), (5, rows[5][1]), (5, rows[5][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,limit,seed", [(256, 512, 0), (7, 6, 1)])
def test_matches_brute_force(spark, monkeypatch, block, limit, seed):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, size int, `key` string").repartition(5)
    out = C.near_duplicates(df, limit=limit).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.class_size) for r in out), key=repr) == brute(rows)
    assert sum(r.kept for r in out) == len({(r.class_id, r.class_size) if r.class_size > 1 else (r.doc_id, r.key) for r in out})


def test_drop_keeps_one_of_each(spark):
    rows = corpus(2)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, size int, `key` string")
    out = C.drop_near_duplicates(df)
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == df.columns and all(n == 0 for _, _, n, _ in brute(kept))
    assert len(kept) == sum(1 / n for _, _, _, n in brute(rows)).__round__()
    assert C.drop_near_duplicates(df.limit(0)).count() == 0


def test_paths_are_shared_often_enough():
    rng = np.random.default_rng(1)
    hit = 0
    for _ in range(400):
        x = rng.integers(0, 1 << 63, 100).astype(np.uint64)
        a, b = np.sort(x[:90]), np.sort(x[10:])  # 80 shared of 100: similarity 0.8
        one = {p[0] for p in C.paths(a, 1, 0.8)} & {p[0] for p in C.paths(b, 1, 0.8)}
        hit += bool(one)
    assert hit / 400 > 0.6


def test_pairs_at_the_threshold_in_split_nodes_are_found(spark):
    rng = random.Random(3)
    rows = []
    for g in range(1000):
        w = [f"v{rng.randrange(10 ** 9)}" for _ in range(104)]  # 100 shingles, 80 of them in the prefix
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w[:84]))]
    out = C.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), limit=1).collect()
    assert sum(r.n_links != 1 for r in out) == 0


def test_sketches_keep_their_share_of_the_misses():
    least = int(C.least_common(0.8, 0.9999)[C.SKETCH])
    chance = lambda m: sum(math.comb(64, c) * 0.8 ** c * 0.2 ** (64 - c) for c in range(m))
    assert chance(least) <= 2e-5 < chance(least + 1)


def test_common_counts_in_chunks():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 80, rng.integers(0, 60))).astype(np.uint64) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in rows] for a in rows]
    for columns in (7, 1 << 14):
        got = C.common_counts(rows, columns)
        off = ~np.eye(12, dtype=bool)
        assert (got[off] == np.array(want)[off]).all()


def test_short_and_null_texts():
    w = WordHashes(most=3)
    assert len(shingle_hashes(None, 5, w)) == len(shingle_hashes(" ", 5, w)) == 0
    assert len(shingle_hashes("a b", 5, w)) == 1 and len(shingle_hashes("a b c d e f", 5, w)) == 2


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(190)] + [(k, k + 1) for k in range(400, 470)] + \
            [(500, k) for k in range(501, 560)] + [(None, 3), (9, 9), (7, 8), (7, 8)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in list(root)}
    assert connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("small", [0, 3, 40, 1 << 19])
def test_components_in_rounds_and_in_one_forest(spark, small):
    rng = random.Random(11)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k + 1, k) for k in range(300, 340)] + \
            [(k, 999 - k) for k in range(500, 560)] + [(600, k) for k in range(700, 730)] + [(None, 3), (9, 9), (7, 8), (8, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    links = {frozenset(e) for e in edges if e[0] is not None and e[0] != e[1]}
    want = {k: k for e in links for k in e}
    for _ in want:
        for a, b in map(tuple, links):
            want[a] = want[b] = min(want[a], want[b])
    rows = connected_components(df, small=small).collect()
    assert len(rows) == len(want) and {r.node: r.component for r in rows} == want
    assert connected_components(df.limit(0), small=small).count() == 0


def test_few_edges_take_no_rounds(spark, monkeypatch):
    written = []
    call = Stages.__call__
    monkeypatch.setattr(Stages, "__call__", lambda self, frame, name: written.append(name) or call(self, frame, name))
    keep = Stages(spark)
    df = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long").repartition(7)
    rows = connected_components(df, keep=keep).collect()
    assert len(rows) == 201 and {r.component for r in rows} == {0}
    assert written == ["edges"] * 2 and len(keep.paths) == 1  # one row an edge in each task's forest, then the one forest
    keep.drop()


def test_bitmap_lets_every_key_pass_and_few_others(spark):
    rows = spark.range(20_000).selectExpr("cast(cast(id as string) as binary) as key", "id", "1 as slot")
    keys = rows.where("id % 40 = 3")
    got = {r.id for r in with_likely_keys(rows, keys).collect()}
    want = set(range(3, 20_000, 40))
    assert want <= got and len(got - want) < 20
    assert with_likely_keys(rows, keys, bits=8).count() == 20_000
    assert with_likely_keys(rows, keys.limit(0)).count() == 0


def test_dropped_stages_are_gone(spark):
    keep = Stages(spark)
    a, b = keep(spark.range(5), "a"), keep(spark.range(6), "b")
    paths = [p.removeprefix("file:") for _, p in keep.paths.values()]
    keep.drop(a)
    assert b.count() == 6 and list(map(os.path.exists, paths)) == [False, True]
    keep.drop()
    assert not os.path.exists(paths[1])


def test_copies_known_from_the_first_run_make_no_more_edges(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]
    rows = []
    for k in range(300):
        w = list(base)
        w[rng.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keep = Stages(spark)
    s = keep(C.sets(df, "doc_id", "text", 5, 0.8, 11), "sets")
    chains = lambda label: s.selectExpr("rid", f"{label} as comp", "explode(paths) as c").select("rid", "comp", "c.*")
    many, _ = C.nodes(chains("rid"), 512, keep)
    none, _ = C.nodes(chains("0L"), 512, keep)
    assert C.candidate_edges(many, s, 0.8, 512).count() > 1000 and none.count() == 0
    assert [r.n_links for r in C.near_duplicates(df).collect()] == [299] * 300


def test_members_of_the_largest_component_meet_the_others_only(spark):
    labels = [*[(1, k, 100, 1000, 100, 900) for k in range(900)], *[(1, 1000 + k, 1000 + k, 1000, 100, 900) for k in range(100)],
              *[(2, 5000 + k, k % 7, 700, None, None) for k in range(700)], (3, 1, 1, 2, None, None), (3, 2, 2, 2, None, None)]
    df = spark.createDataFrame(labels, "node long, rid long, comp long, n long, core long, n_core long")
    groups: dict = {}
    for r in in_blocks_by_label(df, "n", "rid", "comp", "core", "n_core", 128).collect():
        groups.setdefault((r.node, r.b1, r.b2), set()).add((r.rid, r.comp))
    assert sum(len(g) for k, g in groups.items() if k[0] == 1) <= 900 + 100 * 8
    assert sum(len(g) for k, g in groups.items() if k[0] == 2) <= 700 * 6 and max(map(len, groups.values())) < 3 * 128
    met = {(k[0], a, b) for k, g in groups.items() for a, x in g for b, y in g if x != y}
    by_node: dict = {}
    for node, rid, comp, *_ in labels:
        by_node.setdefault(node, []).append((rid, comp))
    assert met == {(k, a, b) for k, g in by_node.items() for a, x in g for b, y in g if x != y}


def test_large_nodes_with_few_outsiders_are_compared_at_once(spark):
    # node 1: 390 sets of one component and 10 others; node 2: 400 sets of as many components; node 3: small
    rows = [*[(k, 0 if k >= 10 else 1000 + k, 1, 10 + k % 3, 100 + k % 9) for k in range(400)],
            *[(k, 2000 + k, 2, 20 + k % 2, None) for k in range(500, 900)], (1, 1, 3, None, None), (2, 2, 3, None, None)]
    df = spark.createDataFrame(rows, "rid long, comp long, p1 long, p2 long, p3 long")
    keep = Stages(spark)
    found, split = C.nodes(df, 250, keep)
    sizes = {(r.node, r.n, r.core, r.n_core): r["count"] for r in found.groupBy("node", "n", "core", "n_core").count().collect()}
    assert sizes == {(1, 400, 0, 390): 400, (3, 2, None, None): 2, (20, 200, None, None): 200, (21, 200, None, None): 200}
    assert {r.p1 for r in split.collect()} == {2} and split.count() == 400
    keep.drop()


def test_the_first_round_splits_no_node(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]
    rows = [(k, " ".join(f"x{k}" if j == k else w for j, w in enumerate(base))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    written = []
    call = Stages.__call__

    def counted(self, frame, name):
        out = call(self, frame, name)
        written.append((name, out.count() if name.startswith(("split", "comps")) else 0))
        return out

    monkeypatch.setattr(Stages, "__call__", counted)
    assert [r.n_links for r in C.near_duplicates(df, limit=50).collect()] == [299] * 300
    names = [n for n, _ in written]
    assert not any(n.startswith("split") for n in names[:names.index("comps1")])
    assert written[names.index("comps1")][1] > 270 and sum(k for n, k in written if n.startswith("split")) < 300


def test_rows_of_large_nodes_follow_their_sets(spark):
    df = spark.range(60_000).selectExpr("id % 2 as node", "id as rid", "30000L as n")
    rows = in_single_blocks(df, "node", "n", "rid", 256)
    sizes = [r["count"] for r in rows.groupBy("node", "b1", "b2").count().collect()]
    assert rows.count() < 1.3 * 60_000 and len(sizes) == 2 * 118 and max(sizes) < 2 * 256
    shared = rows.groupBy("node", "rid").agg(F.count("*").alias("k")).where("k > 1")
    assert {r["node"]: r["count"] >= 10 for r in shared.groupBy("node").count().collect()} == {0: True, 1: True}
    assert in_single_blocks(df.where("rid < 40").withColumn("n", F.lit(20)), "node", "n", "rid", 256).count() == 40
