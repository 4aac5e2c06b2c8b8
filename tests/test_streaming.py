"""The streaming hourly panel emits, after the final watermark, what the batch panel computes."""

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from hourglass.plans.registry import vitals_wide
from hourglass.streaming.panel_stream import start_hourly_panel

SF = "/root/testdata/sf0.001"


def test_stream_panel_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="hourglass-stream-")
    sink, ckpt, src = (os.path.join(root, d) for d in ("sink", "ckpt", "events"))
    os.makedirs(src)
    shutil.copy(f"{SF}/events.parquet", os.path.join(src, "part-0.parquet"))  # file streams watch a folder
    q = start_hourly_panel(spark, src, sink, ckpt, watermark="0 seconds")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.parquet(sink)
    exp = vitals_wide(spark, SF, "outer")
    # append mode holds back the hours that the watermark (the newest measurement) has not passed yet
    newest = (spark.read.parquet(src).where("event_type <> 'error'").selectExpr("max(ts) AS t").first().t)
    done = exp.where(F.col("hour_mark") + F.expr("INTERVAL 1 HOUR") <= F.lit(newest).cast("timestamp_ntz"))
    assert got.count() > 0 and got.count() < exp.count() + 1
    assert got.exceptAll(exp.select(*got.columns)).count() == 0
    assert done.select(*got.columns).exceptAll(got).count() == 0
