"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)

#: Folders written inside each open ``scratch``.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine serves a session whose executors
    are threads of this process; on a cluster it would lose rows, so that is an error.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Later jobs then start from files that outlive any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in any file system that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget(table: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing will read any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        delete(table.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end; results must be written by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def release() -> None:
    """Give memory that a task used back to the system, as Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit moves about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse.

    Sums of products with them are rolling hashes. These only find candidates,
    which may be too many: what is equal is decided by digests or by comparison.
    """

    _held: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    @classmethod
    def up_to(cls, least: int) -> tuple[np.ndarray, np.ndarray]:
        """At least so many powers of the base and of its inverse."""
        if len(cls._held[0]) < least:
            base = int(np.random.default_rng(0).integers(0, 1 << 63)) * 2 + 1
            size = 1 << max(least - 1, 1 << 16).bit_length()
            powers = []
            for b in (base, pow(base, -1, 1 << 64)):
                out = np.ones(size, np.uint64)
                done = 1
                while done < size:
                    out[done : 2 * done] = out[:done] * np.uint64(pow(b, done, 1 << 64))
                    done *= 2
                powers.append(out)
            cls._held = tuple(powers)
        return cls._held


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A rolling hash of each ``size`` bytes in a row."""
    values = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    power, back = Powers.up_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * back[: len(sums) - size])


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (codes, offsets, dictionary).

    ``codes[offsets[i]:offsets[i + 1]]`` are the words of text ``i`` as indices
    into ``dictionary``. A null text has no words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    before = np.concatenate(([0], np.cumsum(full)))
    encoded = flat.filter(pa.array(full)).dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    return encoded.indices.to_numpy().astype(np.int64), before[offsets], encoded.dictionary


def sub_batches(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of record batches, in order, cut and joined to batches of about ``most`` bytes of ``column`` (one row at least); then memory is released."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = int(ends[low - 1]) if low else 0
            high = int(np.searchsorted(ends, before + most - size, "right"))
            if high == low and held:
                yield _joined(held)
                held, size = [], 0
                continue
            high = max(high, low + 1)
            held.append(batch.slice(low, high - low))
            size += int(ends[high - 1]) - before
            low = high
    if held:
        yield _joined(held)
    held.clear()
    release()


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


#: Rows of a group that one window ranks, about.
RANKED = 512


def ranked(df: DataFrame, group: list[str], order: list[str], size: str, name: str = "rank") -> DataFrame:
    """``df`` with a gapless rank from 0 within ``group``, for groups of any size.

    The column ``size`` holds the rows of a row's group, which is dealt over as
    many parts of about RANKED rows as that needs, by a hash of ``order`` (which
    must identify a row). A row's rank is the rows of the parts before its own
    plus its place in its part; so the windows hold one part of a group, or its
    counts by part, never a whole group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.ceil(F.col(size) / RANKED)))
    keys = [*group, "_salt"]
    counts = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return salted.withColumn("_place", place).join(starts, keys).withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_salt", "_place", "_before")


def met_with(rows: DataFrame, key: str, values: DataFrame, size: str) -> DataFrame:
    """``rows`` inner-joined by ``key`` with ``values`` (a written table of one row a key), whose column ``size`` counts a key's rows; hot keys as in ``looked_up``."""
    hot = [r[0] for r in values.where(F.col(size) * HOT >= F.lit(rows.count())).select(key).collect()]
    if not hot:
        return rows.join(values, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(is_hot).join(F.broadcast(values.where(is_hot)), key).unionByName(rows.where(~is_hot).join(values, key))


def crc32_of(column: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes, as a long; of a null: of no bytes."""
    return F.crc32(F.coalesce(column, F.lit("")).cast("binary"))


def packed(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of ``values`` cut at ``offsets``."""
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))


def finite(vectors: DataFrame, vector_column: str, *others: Column) -> DataFrame:
    """``others`` and ``embedding`` (doubles) of the rows whose vector is not null, holds no null or non-finite component and has the commonest length (of equals the shorter)."""
    rows = vectors.select(*others, F.col(vector_column).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("embedding").isNotNull() & ~bad)
    top = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (top[0]["d"] if top else 0))


#: A key is hot with at least one of so many rows, so no more keys than this are.
HOT = 1000


def looked_up(rows: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """``rows`` left-joined by ``key`` with ``values``, which has one row a key at most.

    Keys that hold a thousandth of all rows or more (a thousand keys at most) meet
    their values by broadcast; the others shuffle, none of them hot. Null keys are left out.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("_n") * HOT >= total).select(key).collect()]
    keys = F.broadcast(rows.sparkSession.createDataFrame([(k, True) for k in hot], f"`{key}` {rows.schema[key].dataType.simpleString()}, _hot boolean"))
    marked = rows.where(F.col(key).isNotNull()).join(keys, key, "left")
    few = F.broadcast(values.join(keys, key).drop("_hot"))
    return marked.where("_hot").drop("_hot").join(few, key, "left").unionByName(marked.where("_hot is null").drop("_hot").join(values, key, "left"))
