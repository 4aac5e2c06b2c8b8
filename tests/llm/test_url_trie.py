"""URL rules: trie, join and a brute-force version agree; host and path as defined."""

import random

from hourglass.llm.url_trie import Trie, judge, judge_by_join


def brute(rules, host, path):
    fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[4], max(fits)[3]) if fits else None


def test_trie_against_brute_force(spark):
    rng = random.Random(2)
    labels, paths = ["net", "a", "b", "example", "net.a"], ["", "/", "/a", "/a/", "/ab", "/a/b", "/a//", "//", "a"]
    rules = sorted({(rng.choice(["allow", "block"]), ".".join(rng.choices(labels, k=rng.randint(1, 3))), rng.choice(paths))
                    for _ in range(60)})
    cases = [(".".join(rng.choices(labels, k=rng.randint(1, 4))), rng.choice(paths) + rng.choice(paths)) for _ in range(800)]
    trie = Trie(rules)
    assert [trie.find(h, p) for h, p in cases] == [brute(rules, h, p) for h, p in cases]
    df = spark.createDataFrame([(i, f"http://{h}/{p}") for i, (h, p) in enumerate(cases)], "page_id long, url string")
    a = sorted(tuple(r) for r in judge(df, rules, keep=["page_id"]).fillna("-").collect())
    r = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert a == sorted(tuple(r) for r in judge_by_join(df, r, keep=["page_id"]).fillna("-").collect())
    assert [x[3:] for x in a] == [(lambda f: (f[1], f[0]) if f else ("-", "allow"))(brute(rules, h, "/" + p)) for h, p in cases]


def test_hosts_and_paths(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EX.ample.NET", "x://h?q/a", "x://h#f/a", "x://h/a/b?c#d", "x://h/a://b",
            "x://É.net/é\n/z", "x://h" + "/p" * 5000]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = judge(df, [("block", "net", "")], keep=["page_id"]).orderBy("page_id").collect()
    assert [(r.host, r.path) for r in rows[:10]] == [
        ("", ""), ("", ""), ("", ""), ("", ""), ("ex.ample.net", ""), ("h", ""), ("h", ""), ("h", "/a/b"), ("h", "/a://b"),
        ("É.net", "/é\n/z")]
    assert [r.verdict for r in rows].count("block") == 2
    assert judge(df.limit(0), [("block", "net", "/")]).count() == 0 and judge(df, []).count() == len(urls)
