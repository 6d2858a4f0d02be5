"""Panels from Parquet, CSV or JSON files, with their columns typed at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.errors import ColumnNamesError, FrameTypeError, OptionError
from chronoloom.series import Panel


def read_panel(spark: SparkSession, path: str, panel: Panel, form: str = "parquet", schema: str | None = None) -> DataFrame:
    """The panel's columns of the files at ``path``: keys as strings, time, target as a double.

    CSV and JSON need a ``schema``, so that codes with leading zeros stay strings
    and no pass is spent on inference. Only these columns are read.
    """
    if form not in ("parquet", "csv", "json"):
        raise OptionError(f"form: parquet, csv or json, not {form!r}")
    if form != "parquet" and not schema:
        raise OptionError(f"{form} needs a schema")
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.csv(path, header=True) if form == "csv" else reader.json(path) if form == "json" else reader.parquet(path)
    missing = [c for c in (*panel.keys, panel.time, panel.target) if c not in df.columns]
    if missing:
        raise ColumnNamesError(f"no columns {missing} among {df.columns}")
    return df.select(*[F.col(k).cast("string").alias(k) for k in panel.keys], panel.time, F.col(panel.target).cast("double").alias(panel.target))


def as_frames(data: object) -> DataFrame | list[DataFrame]:
    """A Spark DataFrame of a Spark or pandas-on-Spark one; lists of them, nested or not, give flat lists."""
    if isinstance(data, DataFrame):
        return data
    if callable(found := getattr(data, "to_spark", None)):
        return found()
    if isinstance(data, (list, tuple)):
        found = [as_frames(x) for x in data]
        return [f for one in found for f in (one if isinstance(one, list) else [one])]
    raise FrameTypeError(f"no DataFrame: {type(data).__name__}")


def first_series(df: DataFrame, panel: Panel) -> DataFrame:
    """The rows of the series with the least keys (null keys match)."""
    least = df.select(*panel.keys).orderBy(*panel.keys).limit(1).collect()
    out = df
    for k in panel.keys if least else ():
        out = out.where(F.col(k).eqNullSafe(F.lit(least[0][k])))
    return out
