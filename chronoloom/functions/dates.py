"""Calendar features of a time column, plain or as points on a circle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.errors import FrequencyError, LengthError, OptionError
from chronoloom.series import Panel, regularity

#: A feature needs more rows than these, by frequency, to be seen in all its values.
ROWS = {
    "month": {"D": 365, "7D": 52, "H": 8784, "0.5H": 17568},
    "week": {"D": 31, "7D": 4, "H": 744, "0.5H": 1488},
    "dayofweek": {"D": 6, "H": 168, "0.5H": 336},
    "dayofmonth": {"D": 31, "7D": 4, "H": 744, "0.5H": 1488},
    "weekofyear": {"D": 365, "7D": 52, "H": 8784, "0.5H": 17568},
}
#: The frequencies at which the time of day has a sense.
CLOCK = {"hour": ("H", "0.5H"), "minutes": ("0.5H",)}
PLAIN = ("month", "week", "dayofweek", "dayofmonth", "weekofyear", "hour", "minutes")


def feature(name: str, time: str) -> Column:
    """month, week of the month (0: to the 7th, 1: to the 22nd, 2), dayofweek (Monday 0), dayofmonth, weekofyear (ISO), hour, minutes."""
    t = F.col(time)
    day = F.dayofmonth(t)
    made = {
        "month": F.month,
        "week": lambda _: F.when(day <= 7, 0).when(day <= 22, 1).otherwise(2),
        "dayofweek": F.weekday,
        "dayofmonth": F.dayofmonth,
        "weekofyear": F.weekofyear,
        "hour": F.hour,
        "minutes": F.minute,
    }
    if name not in made:
        raise OptionError(f"date feature: one of {PLAIN}, not {name!r}")
    return made[name](t).cast("int")


def _turn(name: str, time: str) -> Column:
    """The feature as a part of its cycle."""
    x = feature(name, time)
    if name == "hour":
        return (x + F.minute(time) / 60) / 24
    if name == "dayofmonth":
        return x / F.dayofmonth(F.last_day(time))
    return x / {"month": 12, "week": 3, "weekofyear": 52, "dayofweek": 7, "minutes": 60}[name]


def checked(df: DataFrame, panel: Panel, names: Sequence[str]) -> DataFrame:
    """``df``, if each series is regular and long enough for the features at the panel's frequency; one aggregation decides.

    A feature that has no sense at the frequency raises an error at once.
    """
    freq = {"7D": "7D", "W": "7D", "D": "D", "H": "H", "h": "H", "0.5H": "0.5H", "30T": "0.5H", "30min": "0.5H"}.get(panel.freq)
    for name in names:
        feature(name, panel.time)
        if freq is None or freq not in CLOCK.get(name, ROWS.get(name, {freq: 0})):
            raise FrequencyError(f"{name} has no sense at the frequency {panel.freq}")
    least = max([ROWS[n][freq] for n in names if n in ROWS], default=0)
    found = regularity(panel.checked(df), panel).agg(F.min("n").alias("n"), F.bool_and("regular").alias("regular")).first()
    if found["n"] is not None and not found["regular"]:
        raise FrequencyError(f"a series does not have the frequency {panel.freq}")
    if found["n"] is not None and found["n"] <= least:
        raise LengthError(f"{list(names)} need over {least} rows at the frequency {panel.freq}; a series has {found['n']}")
    return df


def with_features(df: DataFrame, time: str, names: Sequence[str], panel: Panel | None = None) -> DataFrame:
    """``df`` with a column for each feature; with a ``panel``, ``checked`` first."""
    if panel:
        checked(df, panel, names)
    return df.select("*", *[feature(n, time).alias(n) for n in names])


def with_polar(df: DataFrame, time: str, names: Sequence[str], panel: Panel | None = None) -> DataFrame:
    """``df`` with sin_ and cos_ columns for each feature; with a ``panel``, ``checked`` first."""
    if panel:
        checked(df, panel, names)
    pairs = [f(2 * F.pi() * _turn(n, time)).alias(f"{k}_{n}") for n in names for k, f in (("sin", F.sin), ("cos", F.cos))]
    return df.select("*", *pairs)
