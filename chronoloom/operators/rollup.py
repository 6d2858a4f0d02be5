"""Weekly sums of daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.errors import OptionError
from chronoloom.series import Panel

DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def weekly(df: DataFrame, panel: Panel, day: str = "MON", strict: bool = True) -> DataFrame:
    """Sums by weeks that start on ``day``, labelled by that day; partial weeks at the ends stay.

    With ``strict``, series that hold nulls, are not contiguous or have under
    seven rows raise an error.
    """
    if day not in DAYS:
        raise OptionError(f"day: one of {DAYS}, not {day!r}")
    rows = panel.checked(df).withColumn(panel.time, F.to_date(panel.time))
    if strict:
        w = panel.by()
        n = F.count(F.lit(1)).over(w)
        bad = F.when(F.count(panel.target).over(w) < n, "nulls").when(F.datediff(F.max(panel.time).over(w), F.min(panel.time).over(w)) + 1 != n, "gaps or duplicates").when(n < 7, "under seven rows")
        rows = rows.withColumn("_bad", bad)
        rows = rows.withColumn(panel.target, F.when(F.col("_bad").isNull(), F.col(panel.target)).otherwise(F.raise_error(F.concat(F.lit("series with "), F.col("_bad"))).cast("double")))
    start = F.date_sub(F.next_day(panel.time, day), 7)
    return rows.groupBy(*panel.keys, start.alias(panel.time)).agg(F.sum(panel.target).alias(panel.target))
