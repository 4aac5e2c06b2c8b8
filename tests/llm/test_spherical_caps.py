"""Spherical caps: links and classes against brute force, recall at the threshold, hostile rows."""

import numpy as np
import pytest

from hourglass.llm import spherical_caps as S


def brute(rows, threshold=0.9):
    ok = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and None not in v}
    ok = {k: v for k, v in ok.items() if np.isfinite(v).all() and v.any()}
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    keys = sorted(ok)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            x, y = ok[a] / np.abs(ok[a]).max(), ok[b] / np.abs(ok[b]).max()
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in range(len(rows)):
        least.setdefault(find(k), []).append(rows[k][0])
    low = {r: min((i for i in v if i is not None), default=None) for r, v in least.items()}
    return sorted(((rows[k][0], n[k], low[find(k)], rows[k][0] == low[find(k)]) for k in range(len(rows))), key=repr)


def make():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(250, 32))
    rows = [x]
    for spread in (0.02, 0.2, 0.4):
        rows.append(x[:40] + spread * rng.normal(size=(40, 32)))
    rows.append(x[3] + 0.1 * rng.normal(size=(60, 32)))  # a cluster larger than a block
    v = np.concatenate(rows).tolist()
    v += [v[0], v[0], [2 * z for z in v[1]], [-z for z in v[1]], [0.0] * 32, None, [], [None, 1.0], [float("nan")] * 32,
          [float("inf")] + [0.0] * 31, [1e-300] * 32, [1e300] * 32, [1.0] * 32, [1.0, 2.0], [2.0, 4.0], [1.0], [3.0], [-1.0]]
    rows = [(k, z) for k, z in enumerate(v)]
    return rows + [(5, v[5]), (None, v[6]), (None, None)]


@pytest.mark.parametrize("block,limit", [(512, 2048), (16, 8)])
def test_matches_brute_force(spark, monkeypatch, block, limit):
    monkeypatch.setattr(S, "BLOCK", block)
    rows = make()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, d int, signs string")
    got = sorted((tuple(r) for r in S.near_duplicates(df.repartition(4), limit=limit).collect()), key=repr)
    want = brute(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert S.near_duplicates(df).count() == 0


@pytest.mark.parametrize("d", [64, 10, 4, 2])
def test_recall_at_the_threshold(d):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    o = rng.normal(size=(300, d))
    o -= (o * x).sum(axis=1, keepdims=True) * x
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * o
    hit = np.zeros(300, bool)
    for seed in range(5):
        c = S.Code(d, 10_000, 24, 0.9, seed)
        hit |= [bool(len(np.intersect1d(a, b))) for a, b in zip(c.decode(x), c.decode(y), strict=True)]
    assert hit.mean() > 0.97


def test_list_decoding_is_complete():
    c = S.Code(12, 400, 20, 0.9, 1)
    x = np.random.default_rng(3).normal(size=(20, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned, w = x @ c.rotation, c.words
    for row, got in zip(turned, c.decode(x), strict=True):
        s = [row[p] @ k.T for p, k in zip(c.parts, c.codes, strict=True)]
        full = s[0][:, None, None] + s[1][None, :, None] + s[2][None, None, :]
        want = np.flatnonzero(full.ravel() >= c.height)
        assert set(want) == set(got) or (not len(want) and got[0] == full.argmax())
        assert got.max() < w ** 3


def test_rounded_vectors_miss_no_link():
    rng = np.random.default_rng(4)
    for d in (1, 2, 7, 64, 300):
        x = rng.normal(size=(200, d)) ** rng.choice([1, 3, 9], size=(200, 1))  # some with one large component
        x = np.concatenate([x, x + 0.45 * np.linalg.norm(x, axis=1, keepdims=True) * rng.normal(size=(200, d)) / np.sqrt(d)])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        linked = x @ x.T >= 0.9
        assert not (linked & ~S.may_link(S.rounded(x), 0.9)).any()


def test_unrelated_vectors_make_no_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    x = np.concatenate([x, x[:20] + 0.1 * rng.normal(size=(20, 64))])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    v = S.described(df, "vec_id", "embedding", len(x), 24, 0.9, 5)
    groups = S.connected_components(S.candidate_edges(v, 0.9, 2048)).groupBy("component").count().collect()
    assert sorted(r["count"] for r in groups) == [2] * 20
