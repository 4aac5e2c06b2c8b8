"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every hourglass job relies on.  Timestamps in the inputs are
# TIMESTAMP_NTZ and all operators use NTZ arithmetic, but the session zone is
# pinned anyway so string <-> timestamp conversions are reproducible.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ui.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "hourglass",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the hourglass defaults.

    ``shuffle_partitions`` should be sized so one shuffle partition stays
    around 128-256 MB at the target scale; locally it defaults to 2x cores.
    """
    master = master or os.environ.get("HOURGLASS_MASTER", "local[*]")
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    if shuffle_partitions is None:
        shuffle_partitions = 2 * (os.cpu_count() or 4)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("HOURGLASS_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is left alone; a
    cluster master without it is an error, since executors would write to their
    own disks.  Only under a local master (tests) a private folder under the
    system temp dir is created and registered, and removed when Python ends.
    """
    sc = spark.sparkContext
    already = sc.getCheckpointDir()
    if already:
        return already
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", sc.master):
            raise RuntimeError(f"master {sc.master!r} needs spark.checkpoint.dir, a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="hourglass-ckpt-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
    sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


@contextlib.contextmanager
def sql_conf(spark: SparkSession, **settings: str):
    """Temporarily set SQL confs (``spark.sql.`` prefix implied), restoring them after."""
    old = {}
    for k, v in settings.items():
        key = k if k.startswith("spark.") else f"spark.sql.{k}"
        old[key] = spark.conf.get(key, None)
        spark.conf.set(key, str(v))
    try:
        yield spark
    finally:
        for key, v in old.items():
            if v is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, v)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared checkpoint folder and read it back.

    Used between the stages of multi-pass pipelines.  Constraint propagation
    is switched off while the (possibly many-way-join) plan is optimised: on
    wide plans it is super-linear and only infers redundant not-null filters.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with sql_conf(spark, **{"constraintPropagation.enabled": "false"}):
        return df.checkpoint(eager=True)
