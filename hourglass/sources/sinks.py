"""[A6] Feature-table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_feature_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                        max_records_per_file: int | None = None) -> None:
    """[A6] Write a feature table as parquet (overwrite), optionally partitioned.

    ``path`` should be shared storage on a cluster; written files make the
    table restartable input for later jobs (and cut the producing lineage).
    """
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    w.parquet(path)
