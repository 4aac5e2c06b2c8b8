"""Line dedup against a brute-force version, with nulls, copies, clashing names and an empty table."""

from collections import defaultdict

from hourglass.llm.line_dedup import BLANKS, drop_boilerplate


def brute(rows, ratio, min_pages):
    pages, on = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for _, host, text in rows:
        pages[host].add(text or "")
        for line in (text.split("\n") if text is not None else []):
            if line.strip(BLANKS):
                on[host][line.strip(BLANKS)].add(text)
    gone = {h: {k for k, v in on[h].items() if len(v) >= min_pages and len(v) > ratio * len(pages[h])} for h in pages}
    return [(d, h, t if t is None else "\n".join(x for x in t.split("\n") if x.strip(BLANKS) not in gone[h]))
            for d, h, t in rows]


def make():
    rows = [(i, "a" if i % 3 else "b", f"foot\nbody {i}\n\n foot \nseen {i % 4}\n") for i in range(40)]
    rows += [(100 + i, "a", "copied page\nfoot") for i in range(30)]  # one page in thirty copies
    rows += [(200, None, None), (201, None, ""), (None, None, "x\ny"), (202, "c", "once"), (3, "b", "other text of 3"),
             (5, "a", "foot"), (5, "a", "foot"), (300, "a", "\n".join(f"l{i}" for i in range(20000)) + "\nfoot")]
    return rows


def test_matches_brute_force(spark):
    rows = make()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    for ratio, least in ((0.1, 5), (0.3, 2), (0.9, 2)):
        got = [tuple(r) for r in drop_boilerplate(df, ratio=ratio, min_pages=least).collect()]
        assert sorted(got, key=repr) == sorted(brute(rows, ratio, least), key=repr)


def test_copies_do_not_make_boilerplate(spark):
    df = spark.createDataFrame([(i, "h", "all the same\ntext") for i in range(50)] + [(99, "h", "other")],
                               "doc_id long, source string, text string")
    assert drop_boilerplate(df, min_pages=2).where("text = ''").count() == 0


def test_clashing_names_empty_and_counts(spark):
    df = spark.createDataFrame([(i, "h", f"foot\nmy {i}", "k", 7, 1) for i in range(9)],
                               "doc_id long, source string, text string, `key` string, line int, `a.b` int")
    out = drop_boilerplate(df, counts=True)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert {tuple(r) for r in out.collect()} == {(i, "h", f"my {i}", "k", 7, 1, 2, 1) for i in range(9)}
    assert drop_boilerplate(df.limit(0)).count() == 0
