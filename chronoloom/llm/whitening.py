"""Whitening of embeddings: covariance by generated SQL sums, principal axes by LAPACK.

The covariance of d dimensions is d * (d + 1) / 2 sums of centred products, the
upper triangle, all made by one aggregation in generated SQL. What reaches the
driver is these sums alone, whatever the table; the d x d matrix is decomposed
there, and rows are projected in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, COMPONENTS = 256, 4
#: Sums of products of a group, at most.
WIDTH = 48

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def products(d: int) -> tuple[int, int, list[str]]:
    """(blocks, width, SQL of ``width`` sums) for the upper triangle of d columns ``c[0]`` .. ``c[d - 1]``.

    Each unordered pair is (i, i + k modulo d) for one i and a k of at most d / 2.
    Rows are grouped by ``q`` = i + d * block of offsets, so that the generated
    code stays small and compiled however many pairs there are.
    """
    offsets = d // 2 + 1
    blocks = -(-offsets // WIDTH)
    width = -(-offsets // blocks)
    return blocks, width, [f"sum(c[q % {d}] * c[(q % {d} + (q div {d}) * {width} + {t}) % {d}]) AS s{t}" for t in range(width)]


def covariance(df: DataFrame, vector: str, means: Sequence[float], n: int) -> np.ndarray:
    """The covariance (divisor ``n``) of a column of vectors: centred, then multiplied, then summed, all pairs in one aggregation."""
    d = len(means)
    blocks, width, sql = products(d)
    centre = ", ".join(f"{m!r}D" for m in means)
    centred = df.selectExpr(f"zip_with({vector}, array({centre}), (v, m) -> double(v) - m) AS c")
    sums = centred.selectExpr("c", f"explode(sequence(0, {d * blocks - 1})) AS q").groupBy("q").agg(*[F.expr(s) for s in sql])
    out = np.zeros((d, d))
    for q, *values in sums.collect():  # about d * d / 2 numbers
        i = q % d
        for t, s in enumerate(values):
            if (k := q // d * width + t) <= d // 2:
                out[i, (i + k) % d] = out[(i + k) % d, i] = s
    return out / n


def axes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns, each with its largest entry positive)."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return e, u * np.where(u[np.abs(u).argmax(0), np.arange(len(e))] < 0, -1.0, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def deviations(x: np.ndarray, n: int, sums: Sequence[int]) -> list[int | None]:
    """The exact sum over dimensions of (n * x - S)**2 of each row; None beyond 64 bits."""
    most = n * int(max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0) + max(map(abs, sums), default=0)
    if x.shape[1] * most * most < 1 << 63:
        far = n * x - np.array(sums, np.int64)
        return np.einsum("nd,nd->n", far, far).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def _projected(means: np.ndarray, turn: np.ndarray):
    """Whitened vectors w of rows x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = (_matrix(batch.column("x")) - means) @ turn
            yield pa.RecordBatch.from_arrays([common.packed(w.ravel(), np.arange(len(w) + 1) * w.shape[1], pa.float64())], names=["w"])

    return run


def _rows(n: int, sums: list[int], means: np.ndarray, turn: np.ndarray, shares: list[float], error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shares)
        for batch in batches:
            x = _matrix(batch.column("x"))
            w = np.full((len(x), k), np.nan)
            w[:, : turn.shape[1]] = (x - means) @ turn
            each = lambda a: pa.array(np.repeat(np.arange(len(x)), k)) if a is None else a.take(pa.array(np.repeat(np.arange(len(x)), k)))
            components, share = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.tile(shares, len(x))
            yield pa.RecordBatch.from_arrays(
                [each(batch.column("vec_id")), pa.array(components), pa.array(np.full(len(x) * k, n)), each(pa.array(deviations(x, n, sums), pa.int64())), pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(share, mask=np.isnan(share)), pa.array(np.full(len(x) * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whitened(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """Each vector's whitened coordinates on the leading principal axes, one row a vector and component.

    A component c counts as the integer floor(scale * c). The axes are those of
    the distinct integer vectors. ``deviation`` is exact, and null beyond 64 bits;
    ``whitened`` is null on an axis without variance (beyond rounding), as in a
    table of one distinct vector; ``explained`` is the axis' share of the
    variance, null where there is none. ``identity_error`` is measured: the
    largest entry of the whitened vectors' own covariance less the identity.

    Vectors that are null, hold null or non-finite components or are not of the
    commonest length take no part; repeated rows and null ids keep their rows;
    equal eigenvalues come in LAPACK's order; other columns are ignored. An empty
    table, or vectors of length 0, give no rows. Work on products grows with the
    square of the length.
    """
    spark = vectors.sparkSession
    rows = common.finite(vectors, vector_column, F.col(id_column).cast("long").alias("vec_id"))
    rows = rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c * float(scale)).cast("long")).alias("x"))
    fit = common.written(rows.select("x").distinct(), "fit")
    d = fit.select(F.size("x")).first()
    if not d or not d[0]:
        return spark.createDataFrame([], SCHEMA)
    d = d[0]
    n, *sums = fit.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[i].cast("decimal(20,0)")) for i in range(d)]).first()
    sums = [int(s) for s in sums]
    means = [s / n for s in sums]
    v = covariance(fit, "x", means, n)
    e, u = axes(v)
    k = min(components, d)
    real = int((e[:k] > e[0] * d * np.finfo(float).eps).sum()) if e[0] > 0 else 0
    turn, centre = u[:, :real] / np.sqrt(e[:real]), np.array(means)
    error = 0.0
    if real:
        flat = fit.mapInArrow(_projected(centre, turn), "w array<double>")
        middle = flat.agg(*[F.avg(F.col("w")[i]) for i in range(real)]).first()
        error = float(np.abs(covariance(flat, "w", list(middle), n) - np.eye(real)).max())
    total = float(np.trace(v))
    shares = [max(float(x), 0.0) / total if total > 0 else math.nan for x in e[:k]]
    return rows.mapInArrow(_rows(n, sums, centre, turn, shares, error), SCHEMA)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` whitened on their first four principal axes."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
