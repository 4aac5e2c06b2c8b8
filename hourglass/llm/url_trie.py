"""URL filter: allow and block rules in one trie over reversed host labels and path segments.

A rule (host, path) fits its host and every subdomain when the url's path starts with the rule's path.  The longest
fitting rule decides: more host labels first, then the longer path; of an allow and a block rule for the same host and
path, block wins.  Urls that no rule fits get ``default``.

The trie goes to the tasks as one Spark broadcast variable, whose size is bounded: rule sets of more than
``MAX_BROADCAST_RULES`` are joined instead (``judge_by_join``, exact as well).

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule.  Repeated rows are
judged one by one; an empty table gives an empty result; other columns of the input are carried along untouched by
``judge`` only if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rule = tuple[str, str, str]  # verdict ("allow" or "block"), host, path

MAX_BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nodes are dicts: host labels from the top-level domain down, then path segments under the ``PATH`` edge.

    A path edge is a segment with its closing ``/``; a rule path that ends inside a segment hangs as an open end on the
    node before it.
    """

    PATH, ENDS, RULE = 0, 1, 2  # keys that no label (a string) can clash with

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r} is neither allow nor block")
            node = self.root
            for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATH, {})
            *closed, tail = path.split("/")
            for segment in closed:
                node = node.setdefault(segment + "/", {})
            if tail:
                node = node.setdefault(self.ENDS, {}).setdefault(tail, {})
            if node.get(self.RULE, ("", ""))[0] != "block":
                node[self.RULE] = (verdict, host + path)

    def _below(self, node: dict, path: str) -> tuple[str, str] | None:
        best, at = node.get(self.RULE), 0
        while True:
            ends = node.get(self.ENDS)
            if ends:
                fits = [t for t in ends if path.startswith(t, at)]
                if fits:
                    best = ends[max(fits, key=len)][self.RULE]
            cut = path.find("/", at) + 1
            node = node.get(path[at:cut]) if cut else None
            if node is None:
                return best
            best, at = node.get(self.RULE, best), cut

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if self.PATH in node:
                best = self._below(node[self.PATH], path) or best
        return best


def judge(df: DataFrame, rules: Sequence[Rule], url: str = "url", keep: Sequence[str] = (),
          default: str = "allow") -> DataFrame:
    """Columns ``keep`` plus host, path, rule (null if none fits), verdict; one row per input row."""
    if len(rules) > MAX_BROADCAST_RULES:
        return judge_by_join(df, df.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string"),
                             url, keep, default)
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))
    u = F.col(url)
    parts = df.select(*keep, host_of(u).alias("host"), path_of(u).alias("path"))
    found = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    @F.pandas_udf(found)
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for hosts, paths in batches:
            hits = [find(h, p) or (default, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": pd.Series([r for _, r in hits], dtype=object),
                                "verdict": pd.Series([v for v, _ in hits], dtype=object)})

    return parts.withColumn("_found", decide("host", "path")).select(*keep, "host", "path", "_found.rule", "_found.verdict")


def judge_by_join(df: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = (),
                  default: str = "allow") -> DataFrame:
    """The same for rule sets too large to broadcast: (host, path) pairs join the rules on every host suffix."""
    u = F.col(url)
    parts = df.select(F.struct(*keep).alias("_keep") if keep else F.lit(1).alias("_keep"),
                      host_of(u).alias("host"), path_of(u).alias("path"))
    r = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("_suffix"), F.col("path").alias("_prefix"),
                     F.concat("host", "path").alias("rule"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (parts.select("host", "path").distinct().withColumn("_suffix", F.explode(suffixes))
            .join(r, "_suffix").where(F.startswith(F.col("path"), F.col("_prefix")))
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.size(F.split("_suffix", r"\.")).alias("n"), F.length("_prefix").alias("m"),
                                (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("_best")))
    out = parts.join(best, ["host", "path"], "left")
    return out.select(*[F.col("_keep")[k].alias(k) for k in keep], "host", "path", F.col("_best.rule").alias("rule"),
                      F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
