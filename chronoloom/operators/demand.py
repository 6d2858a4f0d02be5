"""Demand classes by the mean interval between rows and the squared coefficient of variation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.series import Panel

#: The bounds between the classes.
INTERVAL, VARIATION = 1.34, 0.49


def classified(df: DataFrame, panel: Panel) -> DataFrame:
    """One row a series: adi, cv2, classification (Zero, Smooth, Lumpy, Erratic or Intermittent), in one aggregation."""
    rows = panel.checked(df)
    y, day = F.col(panel.target), F.to_date(panel.time)
    n = F.count(F.lit(1))
    stats = rows.groupBy(*panel.keys).agg(
        F.when(n > 1, F.datediff(F.max(day), F.min(day)) / (n - 1)).alias("adi"),
        F.when(F.avg(y) == 0, F.when(F.var_samp(y) > 0, F.lit(float("inf")))).otherwise(F.try_divide(F.var_samp(y), F.avg(y) * F.avg(y))).alias("cv2"),
        F.coalesce(F.max(F.abs(y)) == 0, F.lit(False)).alias("_zero"),
    )
    a, c = F.col("adi"), F.col("cv2")
    label = F.when(F.col("_zero"), "Zero").when((a <= INTERVAL) & (c <= VARIATION), "Smooth").when((a >= INTERVAL) & (c >= VARIATION), "Lumpy")
    label = label.when((a < INTERVAL) & (c > VARIATION), "Erratic").when((a > INTERVAL) & (c < VARIATION), "Intermittent").otherwise("Zero")
    return stats.select(*panel.keys, "adi", "cv2", label.alias("classification"))
