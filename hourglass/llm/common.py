"""Helpers shared by the operators: content keys, stage tables in the shared folder, word tokens, hashing."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def content_key(*cols: Column | str) -> Column:
    """16-byte key of the values of ``cols``, nulls told apart from empty strings.

    Rows that agree in all of ``cols`` share the key, so a key join treats repeated rows alike and never depends on
    row order or partition ids.  Lengths are part of the key, so neighbouring values can't run together.
    """
    parts = []
    for c in cols:
        s = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts += [F.coalesce(F.length(s).cast("string"), F.lit("-")), F.coalesce(s, F.lit(""))]
    return F.unhex(F.md5(F.concat_ws("\x01", *parts)))


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage, so that what follows can use the rows several times and a lost executor costs a re-read only.
    """
    return _written(df, name)[0]


class Stages:
    """Stage tables that nothing reads once a later table is written: ``drop`` deletes them then, or those given.

    What is left behind reads only tables that stay, so a lost executor is no reason to keep the others.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _written(df, name)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for k in [id(f) for f in frames] if frames else list(self.paths):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(k)[1])
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def with_likely_keys(rows: DataFrame, keys: DataFrame, key: str = "key", bits: int = 1 << 23) -> DataFrame:
    """``rows`` whose ``key`` may be among those of ``keys``: all that are, and few others while ``keys`` are fewer than bits.

    For the map side of a join with wide rows.  A bitmap of hashed keys goes to every task in pieces of 4 KB; its size, 1 MB
    for 2**23 bits, doesn't follow the tables.  A full bitmap lets all rows pass, so the join itself must still be done.
    """
    slot = lambda: F.pmod(F.xxhash64(key), F.lit(bits)) + F.lit(1)
    pieces = (keys.select(slot().alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bitmap_piece"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap_bits")))
    at = F.bitmap_bit_position(slot())
    byte = F.conv(F.hex(F.substring("bitmap_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(pieces), F.bitmap_bucket_number(slot()) == F.col("bitmap_piece"))
    return (met.where(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
            .drop("bitmap_piece", "bitmap_bits"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """Word -> signed-free 64-bit hash, remembered for up to ``most`` words (cleared when full)."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit values (two xor-shift-multiply rounds); overflow wraps."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, n: int, words_of: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of a text.

    Words are the white-space separated parts of the lower-cased text.  A text of 1 to n-1 words is one shingle; a
    null or empty text has none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = words_of.of(words)
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)
