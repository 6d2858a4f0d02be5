"""Nearest neighbours by score-aware (anisotropic) quantisation and exact reranking.

A unit vector is split into its part along the nearest of a few centres, kept as
a float, and a remainder, whose direction is coded: one of sixteen codewords for
every two dimensions, chosen to minimise the error parallel to the remainder more
strictly than the error across it, as the parallel part is what distorts large
inner products. A query's inner products with all codewords form tables; scanning
a block of codes adds up table entries, and the best of each block are compared
again with the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, EVERY = 5, 50
#: The index is fitted on at most so many vectors; all vectors are indexed.
FIT_ROWS = 16_384
CENTRES, WORDS, STEP = 128, 16, 2
#: The paper's threshold T: errors matter at inner products of at least T.
T = 0.2
#: Rows in a block of codes, queries in a block, and rows of a block that are compared exactly.
BLOCK, QUERIES, RERANK = 16_384, 1024, 512
#: Vectors that are coded at once.
CHUNK = 1024


@dataclass
class Index:
    """Centres (unit vectors) and codebooks (parts, WORDS, STEP)."""

    centres: np.ndarray
    books: np.ndarray
    penalty: float

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(centre, length along it, length of the remainder, its direction) of unit vectors."""
        which = (x @ self.centres.T).argmax(1)
        c = self.centres[which]
        along = np.einsum("nd,nd->n", x, c)
        rest = x - along[:, None] * c
        size = np.sqrt(np.einsum("nd,nd->n", rest, rest))
        return which, along, size, rest / np.maximum(size, 1e-12)[:, None]

    def codes(self, u: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """A codeword number for each part of each direction: coordinate descent on the anisotropic loss."""
        return np.concatenate([self._codes(u[k : k + CHUNK], sweeps) for k in range(0, len(u), CHUNK)]) if len(u) else np.zeros((0, len(self.books)), np.int64)

    def _codes(self, u: np.ndarray, sweeps: int) -> np.ndarray:
        n, m = len(u), len(self.books)
        cut = u.reshape(n, m, STEP)
        dots = np.einsum("nms,mws->nmw", cut, self.books)
        own = np.einsum("nms,nms->nm", cut, cut)
        across = own[:, :, None] - 2 * dots + np.einsum("mws,mws->mw", self.books, self.books)  # squared error of a part
        along = own[:, :, None] - dots  # its share of the error along the direction
        code = across.argmin(2)
        total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for p in range(m):
                total -= np.take_along_axis(along[:, p], code[:, p, None], 1)[:, 0]
                code[:, p] = (across[:, p] + (self.penalty - 1) * (total[:, None] + along[:, p]) ** 2).argmin(1)
                total += np.take_along_axis(along[:, p], code[:, p, None], 1)[:, 0]
        return code


def fit(x: np.ndarray, seed: int = 4) -> Index:
    """Centres by spherical k-means and codebooks by alternating minimisation, on a sample of unit vectors."""
    random = np.random.default_rng(seed)
    n, d = x.shape
    centres = x[random.permutation(n)[:CENTRES]].copy()
    for _ in range(10):
        which = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            total = x[which == c].sum(0)
            if (norm := np.sqrt((total**2).sum())) > 1e-9:
                centres[c] = total / norm
    pad = -d % STEP
    index = Index(centres, np.zeros((0, WORDS, STEP)), max((d - 1) * T**2 / (1 - T**2), 1.0))
    _, _, size, u = index.parts(x)
    u = np.pad(u[size > 1e-9], ((0, 0), (0, pad)))
    if not len(u):
        u = np.zeros((1, d + pad))
    m = (d + pad) // STEP
    cut = u.reshape(len(u), m, STEP)
    index.books = np.stack([cut[random.integers(0, len(u), WORDS), p] for p in range(m)])
    for _ in range(8):
        code = index.codes(u, 1)
        chosen = np.stack([index.books[p, code[:, p]] for p in range(m)], 1)
        share = np.einsum("nms,nms->nm", cut - chosen, cut)
        total = share.sum(1)
        for p in range(m):
            others = total - share[:, p]
            for w in range(WORDS):
                own = cut[code[:, p] == w, p]
                if not len(own):
                    index.books[p, w] = cut[random.integers(0, len(u)), p]
                    continue
                o = others[code[:, p] == w]
                left = len(own) * np.eye(STEP) + (index.penalty - 1) * own.T @ own
                right = own.sum(0) + (index.penalty - 1) * ((o + np.einsum("ns,ns->n", own, own))[:, None] * own).sum(0)
                index.books[p, w] = np.linalg.solve(left + 1e-9 * np.eye(STEP), right)
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of record batches in batches of ``most``; the last may be smaller."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            yield table.slice(0, most).combine_chunks().to_batches()[0]
            held = table.slice(most).to_batches()
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part: finite, not zero, of the commonest length."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = ~F.exists("embedding", lambda v: v != 0.0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & ~zero)
    top = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (top[0]["d"] if top else 0))


def _blocks(index: Index, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _gathered(batches, BLOCK):
            batch = whole.sort_by("vec_id")
            x = _matrix(batch.column("embedding"))
            which, along, size, u = index.parts(x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None])
            code = index.codes(np.pad(u, ((0, 0), (0, -u.shape[1] % STEP)))).astype(np.uint8)
            if code.shape[1] % 2:
                code = np.pad(code, ((0, 0), (0, 1)))
            pairs = code[:, ::2] | code[:, 1::2] << 4  # two codes of four bits a byte
            cells = (pairs.T.copy(), which.astype("<u2"), along.astype("<f4"), size.astype("<f4"), batch.column("vec_id").to_numpy().astype("<i8"), x.astype(kind))
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in cells], names=["codes", "centre", "along", "size", "ids", "vectors"])

    return run


CELLS = "codes binary, centre binary, along binary, size binary, ids binary, vectors binary"


def _packed_queries(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, QUERIES):
            cells = batch.column("vec_id").to_numpy().astype("<i8").tobytes(), _matrix(batch.column("embedding")).astype(kind).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["query_ids", "queries"])

    return run


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the index fitted on all the vectors, if any."""
    held = [(b.column("vec_id").to_numpy(), _matrix(b.column("embedding"))) for b in batches if b.num_rows]
    if not held:
        return
    ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
    x = x[np.argsort(ids, kind="stable")]
    index = fit(x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None])
    cells = (index.centres.tobytes(), index.books.tobytes())
    yield pa.RecordBatch.from_arrays([*(pa.array([c], pa.binary()) for c in cells), pa.array([index.penalty])], names=["centres", "books", "penalty"])


def _scan(index: Index, k: int, rerank: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(index.books)
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                ids, qids = np.frombuffer(cell["ids"], "<i8"), np.frombuffer(cell["query_ids"], "<i8")
                x, q = (np.frombuffer(cell[c], kind).reshape(n, -1) for c, n in (("vectors", len(ids)), ("queries", len(qids))))
                pairs = np.frombuffer(cell["codes"], np.uint8).reshape(-1, len(ids))
                centre, along, size = (np.frombuffer(cell[c], t) for c, t in (("centre", "<u2"), ("along", "<f4"), ("size", "<f4")))
                q = q.astype(np.float64)
                norm, qnorm = np.einsum("nd,nd->n", x, x, dtype=np.float64), np.einsum("nd,nd->n", q, q)
                unit = q / np.sqrt(qnorm)[:, None]
                to_centre = (unit @ index.centres.T).astype(np.float32)
                single = np.zeros((len(q), 2 * len(pairs), WORDS), np.float32)
                single[:, :m] = np.einsum("qms,mws->qmw", np.pad(unit, ((0, 0), (0, m * STEP - unit.shape[1]))).reshape(len(q), m, STEP), index.books)
                tables = (single[:, 1::2, :, None] + single[:, ::2, None, :]).reshape(len(q), len(pairs), WORDS * WORDS)  # by byte: high code, low code
                rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for j in range(len(q)):
                    total = np.zeros(len(ids), np.float32)
                    for table, byte in zip(tables[j], pairs, strict=True):
                        total += table[byte]
                    rough = to_centre[j][centre] * along + total * size
                    if len(ids) > rerank:
                        edge = np.partition(rough, len(ids) - rerank)[len(ids) - rerank]
                        above, level = np.flatnonzero(rough > edge), np.flatnonzero(rough == edge)
                        some = np.concatenate((above, level[: rerank - len(above)]))  # of equals the smaller ids, as rows are sorted
                    else:
                        some = np.arange(len(ids))
                    some = some[ids[some] != qids[j]]
                    exact = np.einsum("nd,d->n", x[some].astype(np.float64), q[j]) / np.sqrt(norm[some] * qnorm[j])
                    best = np.lexsort((ids[some], -exact))[:k]
                    rows.append((np.full(len(best), qids[j]), ids[some][best], exact[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, every: int = EVERY, rerank: int = RERANK) -> DataFrame:
    """The ``k`` nearest other rows (by cosine) of each row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score: the exact cosine, in double
    precision; equal scores go by smaller id. Null or zero vectors, vectors with
    null or non-finite components, those not of the commonest length, and rows
    without an id take no part. Rows with equal vectors are candidates each; rows
    with a query's own id are not its candidates. No rows, or a single one, give
    no rows. ``rerank`` rows of each block of codes are compared exactly, so a
    block that holds no more is searched exactly.
    """
    rows = usable(vectors, id_column, vector_column)
    # the sample: rows with the least hashes of their ids, whatever the layout; they meet in one task
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).repartition(1)
    got = sample.mapInArrow(_fitted, "centres binary, books binary, penalty double").collect()  # one row at most
    if not got:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = np.frombuffer(got[0]["books"]).reshape(-1, WORDS, STEP)
    centres = np.frombuffer(got[0]["centres"])
    index = Index(centres.reshape(-1, rows.select(F.size("embedding").alias("d")).first()["d"]), books, got[0]["penalty"])
    # floats go as they are, so that no digit is lost
    kind = "<f4" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "<f8"
    blocks = rows.mapInArrow(_blocks(index, kind), CELLS)
    blocks = common.written(blocks.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096))), "blocks")
    queries = rows.where(F.col("vec_id") % every == 0).mapInArrow(_packed_queries(kind), "query_ids binary, queries binary")
    # every block of queries meets every block of codes, by the blocks' numbers: a scan of all codes
    parts = blocks.select("part").distinct()
    numbers = parts.agg(F.sort_array(F.collect_list("part"))).first()[0]  # 4096 numbers at most
    spread = common.written(queries, "queries").withColumn("part", F.explode(F.array(*[F.lit(int(p)) for p in numbers])))
    near = blocks.join(spread, "part").drop("part").mapInArrow(_scan(index, k, rerank, kind), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # Spark keeps k rows a query before the shuffle
    top = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")


def op4_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all ``embeddings`` for every fiftieth of them."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
