"""Line dedup by site-relative frequency: drop a line from the pages of a host on which it is boilerplate.

For every host, the pages that contain a line are divided by all pages of the host; lines above ``ratio`` that stand on
two pages or more are dropped from every page of that host.  Exact copies of a page under one host count as one page, above
and below the stroke, so a group of copies can't turn its own text into boilerplate.  A line is what stands between line
feeds, compared without white space at its ends; blank lines are neither counted nor dropped.

Only hashes (64 bits a line, 128 a page) and counts are shuffled for the statistics, pre-aggregated in the map tasks; a
line found on a third of all pages is a few partial counts in each task.  A host's boilerplate is one short list: a line on
a share of ``ratio`` of the pages takes that share of all their lines, so there are at most 1 / ratio times the lines of an
average page.  Pages meet the list of their host by (host, salt), so a host with a third of all pages is spread over
``SALTS`` keys where Spark doesn't broadcast the lists.

Defined results: a null text stays null and has no lines; an empty text has one blank line; a null host is a host of its
own; repeated rows are cleaned alike, each kept; an empty table gives an empty table.  All columns of the input are
returned, whatever their names; ``text`` alone is changed.  A page of which every line is dropped keeps an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\x0b\x0c"
SALTS = 16


def _line_key(line: Column) -> Column:
    """64-bit hash of a line, null for a blank one."""
    edge = F.left(line, F.lit(1)).isin(*BLANKS) | F.right(line, F.lit(1)).isin(*BLANKS)
    trimmed = F.when(edge, F.btrim(line, F.lit(BLANKS))).otherwise(line)
    return F.nullif(F.xxhash64(trimmed), F.xxhash64(F.lit("")))


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("-"))


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 2) -> DataFrame:
    """(host, line, n_pages, host_pages) of the lines to drop; ``line`` is the hash of the trimmed line."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    pages = df.select(_host(host).alias("host"), F.xxhash64(whole).alias("p1"), F.xxhash64(F.lit(1), whole).alias("p2"),
                      F.col(text).alias("text"))
    on = (pages.select("host", "p1", "p2", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _line_key))).alias("line"))
          .where(F.col("line").isNotNull()).distinct()
          .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages))
    total = pages.select("host", "p1", "p2").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    return on.join(total, "host").where(F.col("n_pages") > F.lit(ratio) * F.col("host_pages"))


def drop_boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 2,
                     counts: bool = False) -> DataFrame:
    """``df`` with the boilerplate lines gone from ``text``; ``counts`` adds n_lines and n_dropped (blank ones aside)."""
    lists = (boilerplate(df, host, text, ratio, min_pages).groupBy("host").agg(F.collect_list("line").alias("gone"))
             .select("host", "gone", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    old = F.col("row").getField(text)
    rows = (df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _host(host).alias("host"),
                      F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)).cast("int").alias("salt"))
            .join(lists, ["host", "salt"], "left")
            .select("row", "gone", F.transform(F.split(old, "\n"), lambda x: F.struct(x.alias("line"), _line_key(x).alias("key"))).alias("lines")))

    def dropped(x: Column) -> Column:
        return F.coalesce(F.array_contains("gone", x["key"]), F.lit(False))

    # the lines are an argument, never inside a lambda: they would be split and hashed anew for each of them
    left = F.transform(F.filter("lines", lambda x: ~dropped(x)), lambda x: x["line"])
    new = F.when(F.col("gone").isNull(), old).otherwise(F.array_join(left, "\n"))
    out = [new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns]
    if counts:
        n, m = (F.size(F.filter("lines", lambda x: x["key"].isNotNull())), F.size(F.filter("lines", dropped)))
        out += [F.when(old.isNull(), 0).otherwise(n).cast("bigint").alias("n_lines"),
                F.when(old.isNull(), 0).otherwise(m).cast("bigint").alias("n_dropped")]
    return rows.select(*out)
