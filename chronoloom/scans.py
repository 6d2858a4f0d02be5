"""Series of any length: ordered blocks, scans over blocks, halo rows and exact quantiles.

A window by a series' keys holds the series in one task. A long series is dealt
into blocks instead, which follow each other in the order of a value (a time or
the target): windows then hold a block, with a few rows of its neighbours (a
halo) for lags and frames, or with what a scan over the blocks' totals carries
into it. Plans whose rows fit a task anyway keep the plain windows; the results
are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes, as Spark estimates them, that one task may hold.
SMALL = 64_000_000
#: A block has about so many rows, or a SHARE-th of all rows if that is more; and parts of a block that is split.
ROWS, SHARE, FAN = 50_000, 1000, 256
#: Splits of a block: enough to tell any two doubles apart in steps of FAN, but for outlandish values.
LEVELS = 6

#: Of a block's totals: (blocks before it, blocks after it, in order) -> what is carried into it.
Carry = Callable[[WindowSpec, WindowSpec], Column]


def small(df: DataFrame) -> bool:
    """Whether all rows of ``df`` fit one task, by Spark's estimate; no job runs. Rows of unknown size do not."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL


def fits(df: DataFrame, block: int | None) -> bool:
    """Whether plain windows will do: as ``block`` says (0: yes, a number of rows: no), else by size."""
    return small(df) if block is None else block == 0


def seconds(time: Column, kind: T.DataType) -> Column:
    """A time as a double that keeps its order: seconds, or days of a date. Texts all count as 0, as only their own order is known."""
    if isinstance(kind, T.DateType):
        return F.unix_date(time).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(time) / 1e6
    if isinstance(kind, T.TimestampNTZType):  # without a zone, so that no hour counts twice
        since = time - F.lit("1970-01-01").cast("timestamp_ntz")
        return sum((F.extract(F.lit(unit), since).cast("double") * n for unit, n in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))), F.lit(0.0))
    return F.lit(0.0)


def matched(df: DataFrame, stats: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` joined with ``stats`` by ``on``, where nulls match."""
    named = stats.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(on)], *[c for c in stats.columns if c not in on])
    same = F.lit(True)
    for i, k in enumerate(on):
        same = same & df[k].eqNullSafe(named[f"__k{i}"])
    return df.join(named, same, how).drop(*[f"__k{i}" for i in range(len(on))])


def settled(df: DataFrame) -> DataFrame:
    """``df`` as rows that several jobs read without making them anew: a checkpoint where the session has a folder for them (``spark.checkpoint.dir``), else kept on executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def dealt(df: DataFrame, keys: Sequence[str], value: str, rows: int = ROWS) -> DataFrame:
    """``df`` with ``_block``: numbers that follow the order of ``value`` (a double, not null) within a key.

    Keys, then blocks, with more rows than the bound are split by value, FAN ways
    at a time, in turns evenly and evenly in logarithms, as values may span many
    magnitudes; they are SHARE at most, so their ranges are broadcast. Rows of
    equal value stay together.
    """

    def scaled(c: str, level: int) -> Column:
        v = F.col(c)
        return F.signum(v) * (F.ln(F.abs(v)) + 750) if level % 2 else v  # of 0: null, which is set to 0

    out, total, hot = df.withColumn("_block", F.lit(0).cast("long")), None, []
    for level in range(LEVELS):
        cells = out.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
        if total is None:
            total = cells.agg(F.sum("_n")).first()[0] or 0
        hot = cells.where((F.col("_n") > max(rows, total // SHARE)) & (F.col("__lo") < F.col("__hi"))).drop("_n").collect()
        if not hot:
            break
        ranges = F.broadcast(df.sparkSession.createDataFrame(hot, cells.drop("_n").schema))
        at, low, high = (F.coalesce(scaled(c, level), F.lit(0.0)) for c in (value, "__lo", "__hi"))
        place = F.floor(F.try_divide(at - low, high - low) * FAN)
        out = matched(out, ranges, [*keys, "_block"]).withColumn("_block", F.col("_block") * FAN + F.coalesce(F.least(F.greatest(place, F.lit(0)), F.lit(FAN - 1)), F.lit(0))).drop("__lo", "__hi")
    return out


class Blocks:
    """``rows`` of series in order, in blocks where they are many; ``split`` says whether.

    ``rows`` must not hold null values of ``value``. ``block`` asks for blocks of
    so many rows (0: for none); without it the size of the plan decides.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], value: Column, block: int | None = None):
        self.keys = list(keys)
        self.split = not fits(df, block)
        self.rows = dealt(settled(df.withColumn("__value", value.cast("double"))), self.keys, "__value", block or ROWS).drop("__value") if self.split else df

    @property
    def by(self) -> list[str]:
        return [*self.keys, "_block"] if self.split else self.keys

    def local(self, *order: str) -> WindowSpec:
        """The window over a block's rows in order."""
        return Window.partitionBy(*self.by).orderBy(*order)

    def back(self, *order: str) -> WindowSpec:
        """A row and all those behind it, the farthest first: a running frame, as Spark would make one of rows up to the end anew for every row."""
        return Window.partitionBy(*self.by).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)

    def carried(self, df: DataFrame, totals: Mapping[str, Column], carry: Mapping[str, Carry]) -> DataFrame:
        """``df`` (rows with their blocks) with what a scan over the blocks' ``totals`` carries into each row's block: null where there is one block."""
        if not self.split:
            return df.select("*", *[F.lit(None).alias(n) for n in carry])
        cells = df.groupBy(*self.by).agg(*[c.alias(n) for n, c in totals.items()])
        order = Window.partitionBy(*self.keys).orderBy("_block")
        past, future = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
        return matched(df, cells.select(*self.by, *[f(past, future).alias(n) for n, f in carry.items()]), self.by)

    def haloed(self, order: Sequence[str], before: int = 0, after: int = 0) -> DataFrame:
        """The rows, and in each block the ``before`` rows ahead of it and ``after`` rows behind it, with ``_halo`` true."""
        if not self.split:
            return self.rows.withColumn("_halo", F.lit(False))
        names = self.rows.columns
        out = self.rows.withColumn("_halo", F.lit(False))
        for n, up in ((before, True), (after, False)):
            if not n:
                continue
            turn = [F.col(c).asc() if up else F.col(c).desc() for c in order]
            back = [F.col(c).desc() if up else F.col(c).asc() for c in order]
            edge = self.rows.withColumn("__e", F.row_number().over(Window.partitionBy(*self.by).orderBy(*back))).where(F.col("__e") <= n).drop("__e")
            along = Window.partitionBy(*self.keys).orderBy(F.col("_block").asc() if up else F.col("_block").desc(), *turn)
            met = edge.select(*self.by, F.collect_list(F.struct(*[F.col(c) for c in names if c != "_block"])).over(along.rowsBetween(-n, -1)).alias("__p"), F.lag("_block").over(along).alias("__b"))
            # the first edge row of a block stands behind the n last rows of all blocks before
            halo = met.where(F.col("__b") != F.col("_block")).select(*self.by, F.explode("__p").alias("__p"))
            out = out.unionByName(halo.select(*[F.col("_block") if c == "_block" else F.col(f"__p.{c}").alias(c) for c in names], F.lit(True).alias("_halo")))
        return out


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, shares: Sequence[float], name: str = "_q", block: int | None = None) -> DataFrame:
    """One row a key: the exact quantiles of ``value`` as the array ``name``, linear between neighbours, nulls left out.

    Where rows are many, they are counted by blocks of values; cumulative counts
    find the blocks that hold the wanted ranks, and only these are ordered.
    """
    if fits(df, block):
        return df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(q)) for q in shares])).alias(name))
    rows = settled(df.select(*keys, value.cast("double").alias("_v")).where("_v is not null"))
    deal = dealt(rows, keys, "_v", block or ROWS)
    by = [*keys, "_block"]
    over = Window.partitionBy(*keys)
    order = over.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    cells = deal.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.select(*by, "_n", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"), F.sum("_n").over(over).alias("_total"))
    place = [F.lit(float(q)) * (F.col("_total") - 1) for q in shares]
    ranks = F.array_distinct(F.array(*[g(p).cast("long") for p in place for g in (F.floor, F.ceil)]))
    asked = cells.select(*by, "_before", "_total", F.explode(F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))).alias("_r"))
    chosen = matched(deal, asked.groupBy(*by).agg(F.lit(True).alias("_some")), by, "inner")
    counts = chosen.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*by, "_v", "_n", F.sum("_n").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
    found = matched(counts, asked, by, "inner").where((F.col("_r") - F.col("_before") < F.col("_upto")) & (F.col("_r") - F.col("_before") >= F.col("_upto") - F.col("_n")))
    held = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"), F.max("_total").alias("_total"))

    def between(p: Column) -> Column:
        low, high = F.col("_m")[F.floor(p).cast("long")], F.col("_m")[F.ceil(p).cast("long")]
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return held.select(*keys, F.array(*[between(p) for p in place]).alias(name))
