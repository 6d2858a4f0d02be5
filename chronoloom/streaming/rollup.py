"""Sums of a stream by key and time window, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.series import Panel


def streamed(df: DataFrame, panel: Panel, lateness: str = "1 day") -> DataFrame:
    """keys, time (start of the window), target (sum), n, of a streaming or batch DataFrame; windows are as wide as the panel's frequency.

    Rows later than ``lateness`` behind the latest one are dropped by the watermark of a stream.
    """
    rows = panel.checked(df).withColumn(panel.time, F.col(panel.time).cast("timestamp")).withWatermark(panel.time, lateness)
    window = F.window(panel.time, f"{panel.seconds} seconds")
    out = rows.groupBy(*panel.keys, window.alias("_w")).agg(F.sum(panel.target).alias(panel.target), F.count(panel.target).alias("n"))
    return out.select(*panel.keys, F.col("_w.start").alias(panel.time), panel.target, "n")
