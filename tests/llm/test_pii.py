"""Personal data: base spans equal plain regular expressions, the bootstrap finds what stands in known contexts."""

import hashlib
import random
import re

from hourglass.llm.pii import BASE, KINDS, find_pii
from hourglass.llm.queries import op3_pii

# The patterns as the contract states them.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PLAIN[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def made():
    rng = random.Random(3)
    parts = ["a", "@", ".", "1", "25", "0", "4111111111111111", "+1 (437) 555-0689", "+", "-", " ", "  ", "é", "\U0001F600",
             "x.y%z@m-1.example.com", "256.1.1.1", "010.001.255.0", "10.0.0.1", ".5", "\n", "4111-1111-1111-1111", "(", ")", "Z"]
    rows = [(k, "".join(rng.choices(parts, k=rng.randint(0, 14)))) for k in range(500)]
    return rows + [(900, None), (901, ""), (902, "9" * 40000), (903, "a" * 40000), (904, "a.b@c" + ".d" * 9000),
                   (905, "1." * 9000), (906, "+1" + "()" * 9000 + "5"), (None, "a@b.cc"), (7, rows[7][1]), (7, rows[7][1]),
                   (908, "a@b.c%d@e.f g@h a@b.c-d@e.f"), (909, "1.2.3.4.5.6.7.8.9")]


def test_base_spans(spark):
    rows = made()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kind string, start int").repartition(4)
    got = sorted((r.doc_id, [(s["kind"], s["start"], s["end"]) for s in r.found]) for r in find_pii(df).collect()
                 if r.doc_id is not None)
    want = sorted((d, plain_spans(t)) for d, t in rows if d is not None)
    assert got == want and sum(len(s) for _, s in got) > 300
    assert find_pii(df.limit(0)).count() == 0


def test_base_patterns_on_one_line():
    assert set(BASE) == set(KINDS)


def test_query_digest(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = plain_spans(docs[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] >= [0, 0, 0, 0]


def test_bootstrap_discovers_from_context(spark):
    rng = random.Random(5)
    num = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    rows = [(k, f"filler {num(2)} then phone: +1 {num(3)} {num(3)} {num(4)} please") for k in range(40)]
    rows += [(100 + k, f"phone: (0{num(2)}) {num(3)} {num(4)} please") for k in range(3)]  # no plus sign: the base misses it
    rows.append((200, "phone: (042) 777 1234 please, and ring (042) 777 1234 tonight"))
    rows += [(300 + k, f"order ({num(3)}) {num(3)} {num(4)} shipped") for k in range(30)]  # another context
    rows += [(400 + k, f"write to joe{num(3)}@mail.example.com today") for k in range(20)]
    rows.append((500, "write to ann [at] mail [dot] example [dot] com today"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    added = {r.doc_id: [(s["kind"], s["surface"]) for s in r.spans if not s["base"]] for r in find_pii(df).collect()}
    assert all([k for k, _ in added[d]] == ["phone"] for d in (100, 101, 102))
    assert added[200] == [("phone", "(042) 777 1234")]
    assert added[500] == [("email", "ann [at] mail [dot] example [dot] com")]
    assert not any(added[d] for d in list(range(40)) + list(range(300, 330)) + list(range(400, 420)))


def test_bootstrap_follows_long_chains_and_whole_words(spark):
    """Each context is known from the numbers that the one before found: nine rounds; context words differ after 64 characters."""
    number = lambda c, k: f"({c:03d}) 5{k:02d} 12{k:02d}"
    rows = [(k, f"ring0 +1 {k:03d} 555 {k:04d} now0") for k in range(8)]
    rows += [(50 + k, f"ring0 {number(1, k)} now0") for k in range(6)]
    for c in range(1, 9):  # the numbers of context c stand in context c + 1 too, beside new ones
        rows += [(1000 * c + k, f"ring{c} {number(c, k)} now{c}") for k in range(6)]
        rows += [(1000 * c + 100 + k, f"ring{c} {number(c + 1, k)} now{c}") for k in range(6)]
    long = "x" * 80
    rows += [(20000 + k, f"{long}a +1 {k:03d} 666 {k:04d} {long}c") for k in range(8)]
    rows += [(20100, f"{long}a (777) 666 1234 {long}c"), (20200, f"{long}b (777) 666 4321 {long}d")]
    rows += [(30000 + k, f"mail m{k}@h.example.org here") for k in range(8)] + [(30100, "mail q [at] h [dot] x here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    added = {r.doc_id: [s["surface"] for s in r.spans if not s["base"]] for r in find_pii(df, confidence=0.5).collect()}
    assert all(added[1000 * 8 + 100 + k] == [number(9, k)] for k in range(6))
    assert added[20100] == ["(777) 666 1234"] and added[20200] == []
    assert added[30100] == ["q [at] h [dot] x"]
