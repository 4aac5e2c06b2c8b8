"""[A1/A2/A3] Table scans: parquet folders and catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """[A3] Parquet scan of ``{sf_dir}/{name}.parquet``.

    Schema comes from the footers; projections and filters applied later are
    pushed into the scan by Catalyst (``ReadSchema`` / ``PushedFilters``).
    """
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Parquet bytes of the larger table in a partition of ``by_key`` (some 500,000 rows of flat columns), and how many partitions
# it takes before their number is set.
PART_BYTES, LEAST_PARTS = 8 << 20, 16


def bytes_of(spark: SparkSession, path: str) -> int:
    """Length of all files of a table, from the file system alone."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def by_key(spark: SparkSession, sf_dir: str, large: str, large_key: str, other: DataFrame, other_key: str) -> tuple[DataFrame, DataFrame]:
    """Table ``large`` and ``other``, dealt by their join keys into partitions whose number follows the size of ``large``.

    The join, and what is grouped by its key after it, then hold about ``PART_BYTES`` of the table in a task at any size.
    AQE alone merges partitions by their compressed bytes, up to ten million flat rows in one.  Small tables are left to it.
    """
    rows = read(spark, sf_dir, large)
    parts = -(-bytes_of(spark, f"{sf_dir.rstrip('/')}/{large}.parquet") // PART_BYTES)
    if parts < LEAST_PARTS:
        return rows, other
    return rows.repartition(parts, large_key), other.repartition(parts, other_key)


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """[A3] Parquet scan of an arbitrary folder (feature tables written by a sink)."""
    return spark.read.parquet(path)


def table(spark: SparkSession, name: str, database: str | None = None) -> DataFrame:
    """[A1/A2] Catalog scan; ``database`` gives the qualified ``db.table`` form."""
    return spark.table(f"{database}.{name}" if database else name)


def publish(df: DataFrame, name: str) -> str:
    """[A2/A4] Expose ``df`` in the session-independent ``global_temp`` database; returns the
    qualified name (``global_temp.<name>``) to scan it with ``table``."""
    df.createOrReplaceGlobalTempView(name)
    db = df.sparkSession.conf.get("spark.sql.globalTempDatabase", "global_temp")
    return f"{db}.{name}"


def register(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    """[A4] Expose the driver tables as temp views (for SQL users)."""
    for n in names:
        read(spark, sf_dir, n).createOrReplaceTempView(n)
