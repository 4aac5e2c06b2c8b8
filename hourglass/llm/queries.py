"""The operators over the driver tables, with the parameters a production run would use, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chosen_path, decontam, langid, line_dedup, nbsvm, packing, pii, ppm, prefix_trie, spherical_caps, toxicity, url_trie
from .common import table


def bpe_path() -> str:
    """The public byte-level BPE file; its folder is the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing_digest(packing.pack(table(spark, sf, "documents"), bpe_path()))


def packing_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    found = chosen_path.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", "class_id", "n_links", "class_size", "kept")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[u.i : u.i + 4], ' ') AS g
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
l AS (
  SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE c * 10 >= 8 * (x.n + y.n - c)),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM r GROUP BY a),
n AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, class_size, doc_id = class_id AS kept
FROM k LEFT JOIN n USING (doc_id)
"""


URL_RULES: list[url_trie.Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"),
                                  ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict for every page's url."""
    return url_trie.judge(table(spark, sf, "pages"), URL_RULES, keep=["page_id"])


OP8_SQL = """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


def op2_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Links and classes of all embeddings at a cosine of 0.9."""
    return spherical_caps.near_duplicates(table(spark, sf, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM k LEFT JOIN n USING (vec_id)
"""


def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_pii(table(spark, sf, "documents"))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(F.filter("spans", lambda s: s["kind"] == F.lit(k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(written(F.col("found")), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


def op4_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Log probability of every document under the model of those that are not held out."""
    found = ppm.score(table(spark, sf, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
                        "score")


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a document and a benchmark item it leaks."""
    return decontam.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("key")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
  FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT min(item_id) AS item_id, w, len(w) AS n
  FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
        FROM benchmark WHERE text IS NOT NULL)
  GROUP BY w HAVING len(w) >= 1),
dw AS (SELECT doc_id, len(w) AS dn, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
bw AS (SELECT item_id, n, unnest(w) AS word, unnest(range(n)) AS j FROM b),
m AS (
  SELECT doc_id, dn, item_id, n, pos - j AS shift, j,
         least(n, 13) AS len, CASE WHEN n >= 13 THEN 11 WHEN n >= 8 THEN n - 1 ELSE n END AS need
  FROM dw JOIN bw USING (word)),
g AS (
  SELECT doc_id, item_id, shift, any_value(len) AS len, any_value(need) AS need, count(*) AS n_matched,
         greatest(0, -any_value(shift)) AS lo, least(any_value(n), any_value(dn) - any_value(shift)) AS hi
  FROM m GROUP BY doc_id, item_id, shift HAVING count(*) >= any_value(need)),
c AS (
  SELECT g.*, least(m.j, g.hi - g.len) AS s FROM g JOIN m USING (doc_id, item_id, shift) WHERE g.hi - g.lo >= g.len),
k AS (
  SELECT DISTINCT c.doc_id, c.item_id, c.shift, c.lo, c.hi, c.n_matched
  FROM (SELECT DISTINCT * FROM c) c
  JOIN m ON m.doc_id = c.doc_id AND m.item_id = c.item_id AND m.shift = c.shift AND m.j >= c.s AND m.j < c.s + c.len
  GROUP BY c.doc_id, c.item_id, c.shift, c.lo, c.hi, c.n_matched, c.s, c.need HAVING count(*) >= c.need)
SELECT doc_id, item_id,
       first(lo + shift ORDER BY n_matched DESC, lo + shift) AS doc_start,
       first(hi - lo ORDER BY n_matched DESC, lo + shift) AS n_compared,
       max(n_matched) AS n_matched, count(*) AS n_places
FROM k GROUP BY doc_id, item_id
"""


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the lines that stand on more than a tenth of its source's pages."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, counts=True).select("doc_id", "text", "n_lines", "n_dropped")


OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, text, md5(coalesce(text, '')) AS page,
         string_split(text, chr(10)) AS lines
  FROM documents),
l AS (
  SELECT DISTINCT source, page, trim(u.line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM d, unnest(d.lines) AS u(line)),
f AS (
  SELECT source, line, count(*) AS n_pages FROM l WHERE line <> '' GROUP BY source, line),
t AS (
  SELECT source, count(DISTINCT page) AS host_pages FROM d GROUP BY source),
gone AS (
  SELECT f.source, list(f.line) AS lines FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source
  WHERE f.n_pages >= 2 AND f.n_pages > 0.1 * t.host_pages GROUP BY f.source),
j AS (
  SELECT d.doc_id, d.text, d.lines,
         list_transform(d.lines, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS trimmed,
         coalesce(g.lines, []) AS gone
  FROM d LEFT JOIN gone g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id,
       array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, trimmed[i])), chr(10)) AS text,
       coalesce(len(list_filter(trimmed, lambda x: x <> '')), 0) AS n_lines,
       coalesce(len(list_filter(trimmed, lambda x: list_contains(gone, x))), 0) AS n_dropped
FROM j
"""


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learnt from the documents that are not held out."""
    docs = table(spark, sf, "documents")
    bucket = F.crc32(F.col("doc_id").cast("string")) % 3
    model = langid.fit(docs.where(bucket != 1))
    rows = docs.select("doc_id", "text", (bucket == 1).alias("held_out"))
    return langid.predict(rows, model, keep=("doc_id", "held_out"))


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that are not held out."""
    docs = table(spark, sf, "documents")
    bucket = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    model = nbsvm.fit(docs, labels.where(bucket != 0))
    return nbsvm.score(docs.select("doc_id", "text", (bucket == 0).alias("held_out")), model, keep=("doc_id", "held_out"))


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Trie of all conversations, each rebuilt on the first turns of the first one of its twenty."""
    conv = F.col("conv")
    found = prefix_trie.prefix_trie(table(spark, sf, "conversations"), head=F.crc32(conv.cast("string")) % 4, base=conv - conv % 20)
    return found.drop("key")


OP11_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, hex(encode(coalesce(role, ''))),
                                          md5(coalesce(text, ''))) AS r,
         md5(coalesce(role, '')) || md5(coalesce(text, '')) AS what,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT DISTINCT c, encode(c::VARCHAR) AS digits FROM t),
crc AS (
  SELECT c, digits, 0::BIGINT AS i, 4294967295::BIGINT AS v FROM k
  UNION ALL
  SELECT c, digits, i + 1, CASE WHEN i % 9 = 0
    THEN xor(v, ascii(substr(decode(digits), (i // 9 + 1)::INTEGER, 1)))::BIGINT
    ELSE xor(v >> 1, 3988292384 * (v & 1))::BIGINT END
  FROM crc WHERE i < 9 * octet_length(digits)),
h AS (SELECT c, xor(v, 4294967295) % 4 AS h FROM crc WHERE i = 9 * octet_length(digits)),
n AS (SELECT c, max(r) AS n FROM t GROUP BY c),
m AS (SELECT h.c, h.h, least(h.h, coalesce(n.n, 0)) AS taken FROM h LEFT JOIN n ON n.c = h.c - h.c % 20),
b AS (
  SELECT m.c, t.r AS d, t.what, t.words FROM m JOIN t ON t.c = m.c - m.c % 20 AND t.r <= m.taken
  UNION ALL
  SELECT m.c, t.r - m.h + m.taken, t.what, t.words FROM m JOIN t ON t.c = m.c AND t.r > m.h),
p AS (
  SELECT c, 0 AS d, '' AS p, 0 AS words FROM k
  UNION ALL
  SELECT c, d, string_agg(what, '') OVER (PARTITION BY c ORDER BY d), words FROM b),
z AS (SELECT c, max(d) AS d FROM p GROUP BY c),
x AS (
  SELECT p.p, p.d, min(p.c) AS conv_id, count(*) AS n_convs, max(p.words) AS words,
         sha256(coalesce(string_agg(CASE WHEN z.d = p.d THEN p.c::VARCHAR END, ',' ORDER BY p.c), '')) AS ends
  FROM p JOIN z ON z.c = p.c GROUP BY p.p, p.d),
y AS (
  SELECT x.*, up.conv_id AS parent_conv_id,
         (SELECT count(*) FROM x w WHERE w.d = x.d + 1 AND starts_with(w.p, x.p)) AS n_children
  FROM x LEFT JOIN x up ON up.d = x.d - 1 AND starts_with(x.p, up.p))
SELECT a.conv_id, a.d::BIGINT AS depth, a.parent_conv_id, a.n_convs, a.n_children,
       count(*) FILTER (WHERE e.n_children = 0) AS n_leaves, sum((e.n_convs - 1) * e.words)::BIGINT AS saved_tokens,
       a.ends AS ends_sha256
FROM y a JOIN y e ON e.d >= a.d AND starts_with(e.p, a.p)
GROUP BY a.p, a.conv_id, a.d, a.parent_conv_id, a.n_convs, a.n_children, a.ends
"""


def op12_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels that are not held out."""
    docs = table(spark, sf, "documents")
    bucket = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(bucket != 0))
    return toxicity.score(docs.select("doc_id", "text", (bucket == 0).alias("held_out")), model, keep=("doc_id", "held_out"))


def piece_path() -> str:
    """The public sentencepiece model; its folder is the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document."""
    found = alignment.align(table(spark, sf, "documents"), bpe_path(), piece_path(), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_embedding_dedup, op3_pii, op4_lm_scoring, op5_decontamination, op6_line_dedup, op7_jaccard_join, op8_url_filter, op9_language_id, op10_quality,
                                op11_prefix_trie, op12_toxicity, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": OP2_SQL, "op5_decontamination": OP5_SQL, "op6_line_dedup": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op8_url_filter": OP8_SQL,
            "op11_prefix_trie": OP11_SQL}
