"""The data model: many series in one long DataFrame, and their frequencies."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.errors import ColumnNamesError, ColumnTypeError, OptionError
from chronoloom.scans import ROWS, Blocks, seconds, small

#: Frequency aliases and their seconds.
ALIASES = {"D": 86400, "W": 604800, "H": 3600, "h": 3600, "T": 60, "min": 60, "S": 1, "s": 1}


@dataclass(frozen=True)
class Panel:
    """Which columns of a DataFrame are keys, time and target, and the series' frequency.

    ``keys`` may be one name or several. ``freq`` is a number and an alias, such
    as D, 7D, H or 0.5H. Times are dates where the frequency is whole days, else
    timestamps without zone. Series that may not fit a task are dealt into blocks;
    ``block`` asks for that, in blocks of about so many rows (0: never), else sizes decide.
    """

    keys: tuple[str, ...]
    time: str = "ds"
    target: str = "y"
    freq: str = "D"
    block: int | None = None

    def __post_init__(self) -> None:
        keys = (self.keys,) if isinstance(self.keys, str) else tuple(self.keys)
        object.__setattr__(self, "keys", keys)
        self.seconds  # noqa: B018  fails early on an unknown alias

    @property
    def seconds(self) -> int:
        found = re.fullmatch(r"(\d*\.?\d*)([A-Za-z]+)", self.freq)
        if not found or found[2] not in ALIASES:
            raise OptionError(f"unknown frequency {self.freq!r}")
        return round(float(found[1] or 1) * ALIASES[found[2]])

    @property
    def daily(self) -> bool:
        return self.seconds % 86400 == 0

    @property
    def days(self) -> int:
        return self.seconds // 86400

    @property
    def step(self) -> Column:
        return F.expr(f"interval {self.days} days" if self.daily else f"interval {self.seconds} seconds")

    def checked(self, df: DataFrame) -> DataFrame:
        """Only the panel's columns, with the target as a double; errors for missing columns and wrong types."""
        missing = [c for c in (*self.keys, self.time, self.target) if c not in df.columns]
        if missing:
            raise ColumnNamesError(f"no columns {missing} among {df.columns}")
        kinds = {f.name: f.dataType for f in df.schema.fields}
        if not isinstance(kinds[self.target], T.NumericType):
            raise ColumnTypeError(f"{self.target} must be a number, not {kinds[self.target].simpleString()}")
        if not isinstance(kinds[self.time], (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise ColumnTypeError(f"{self.time} must be a time, not {kinds[self.time].simpleString()}")
        return df.select(*self.keys, self.time, F.col(self.target).cast("double").alias(self.target))

    def by(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def ordered(self) -> WindowSpec:
        return self.by().orderBy(self.time)

    def sized(self, df: DataFrame) -> Panel:
        """The panel with its choice of blocks made, by the size of ``df``: what is joined to it later counts as no more rows."""
        return replace(self, block=(0 if small(df) else ROWS) if self.block is None else self.block)

    def blocks(self, df: DataFrame) -> Blocks:
        """``df`` in blocks along time, where series may be long."""
        return Blocks(df, self.keys, seconds(F.col(self.time), df.schema[self.time].dataType), self.block)

    def bucketed(self, df: DataFrame) -> DataFrame:
        """``df`` with each time set to the start of its bin; bins start at each series' first day."""
        if self.daily:
            day = F.to_date(self.time)
            if self.days > 1:
                first = F.min(day).over(self.by())
                day = F.date_add(first, (F.floor(F.datediff(day, first) / self.days) * self.days).cast("int"))
            return df.withColumn(self.time, day)
        seconds = F.unix_seconds(F.col(self.time).cast("timestamp"))
        # where steps divide a day, bins from a series' first midnight are bins from any midnight
        first = F.lit(0) if 86400 % self.seconds == 0 else F.floor(F.min(seconds).over(self.by()) / 86400) * 86400
        at = first + F.floor((seconds - first) / self.seconds) * self.seconds
        return df.withColumn(self.time, F.timestamp_seconds(at).cast("timestamp_ntz"))

    def moved(self, steps: Column | int) -> Column:
        """The time ``steps`` steps later."""
        steps = F.lit(steps) if isinstance(steps, int) else steps
        if self.daily:
            return F.date_add(self.time, (steps * self.days).cast("int"))
        return F.col(self.time) + F.make_dt_interval(secs=(steps * self.seconds).cast("decimal(18,6)"))


def regularity(df: DataFrame, panel: Panel) -> DataFrame:
    """One row a series: n, nulls, first, last, and whether it is contiguous at the panel's frequency."""
    if panel.daily:
        gap = F.datediff(F.max(panel.time), F.min(panel.time)) / panel.days
    else:
        gap = (F.unix_seconds(F.max(panel.time).cast("timestamp")) - F.unix_seconds(F.min(panel.time).cast("timestamp"))) / panel.seconds
    n = F.count(F.lit(1))
    return df.groupBy(*panel.keys).agg(n.alias("n"), (n - F.count(panel.target)).alias("nulls"), F.min(panel.time).alias("first"), F.max(panel.time).alias("last"), ((gap + 1 == n) & (F.count_distinct(panel.time) == n)).alias("regular"))
