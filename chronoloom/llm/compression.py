"""Vector codes by heap-ordered k-means: four bytes a vector, in exact integer arithmetic.

Integer vectors are cut into equal parts, each position with a codebook of its
own. A block of rows, made once within its partition, keeps for each codebook
entry a heap of the parts assigned to it, keyed by slack: the distance to the
second-nearest entry (a lower bound) less the distance to the own one (an upper
bound). Entries move between rounds; the slack of an entry's parts shrinks by its
own move and the largest other one, so an entry adds up its drift and only parts
whose key the drift has reached are popped and compared with all entries again.
What reaches the driver is sums by entry, of the parts that changed place alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vectors import _gathered

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of a block, parts compared at once, and labels whose sums may be broadcast.
BLOCK, CHUNK, LABELS = 16_384, 2048, 10_000
#: Share of a distance that covers what is lost in floating point, by far.
MARGIN = 1e-9

CELLS = "payload binary, kind string, x binary, keys binary, place binary, starts binary, moved binary, slots binary"


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, of equals the first; squared distance; that of the second-nearest, infinite without one), exact."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * parts.shape[1] * most * most < 1 << 53 else np.int64  # both exact; the former in one product of matrices
    b = book.astype(kind)
    own = (b * b).sum(1)
    which, first, second = np.zeros(len(parts), np.int32), np.zeros(len(parts)), np.full(len(parts), np.inf)
    for k in range(0, len(parts), CHUNK):
        p = parts[k : k + CHUNK].astype(kind)
        far = (p * p).sum(1)[:, None] - 2 * (p @ b.T) + own
        at = far.argmin(1)
        rows = np.arange(len(p))
        which[k : k + CHUNK], first[k : k + CHUNK] = at, far[rows, at]
        if len(book) > 1:
            far[rows, at] = far.max() + 1
            second[k : k + CHUNK] = far.min(1)
    return which, first, second


def violated(keys: np.ndarray, starts: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Places of all members with a key up to their heap's drift: down from each root, past no larger key."""
    sizes = np.diff(starts)
    heap = np.flatnonzero(sizes)
    at, found = np.zeros(len(heap), np.int64), []
    while len(heap):
        hit = keys[starts[heap] + at] <= drift[heap]
        heap, at = heap[hit], at[hit]
        found.append(starts[heap] + at)
        heap, at = np.repeat(heap, 2), (2 * at[:, None] + (1, 2)).ravel()
        inside = at < sizes[heap]
        heap, at = heap[inside], at[inside]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def exchanged(keys: np.ndarray, place: np.ndarray, starts: np.ndarray, out: np.ndarray, entry: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The heaps after their members at ``out`` moved to ``entry`` with ``key``; heaps that lose and get none stay as they are."""
    heap = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    touched = np.zeros(len(starts) - 1, bool)
    touched[heap[out]] = touched[entry] = True
    left = np.ones(len(keys), bool)
    left[out] = False
    sizes = np.bincount(heap[left], minlength=len(touched)) + np.bincount(entry, minlength=len(touched))
    fresh = np.concatenate(([0], np.cumsum(sizes)))
    new_keys, new_place = np.empty_like(keys), np.empty_like(place)
    still = ~touched[heap]
    to = fresh[heap] + np.arange(len(keys)) - starts[heap]
    new_keys[to[still]], new_place[to[still]] = keys[still], place[still]
    some = left & ~still
    h, k, p = np.concatenate((heap[some], entry)), np.concatenate((keys[some], key)), np.concatenate((place[some], place[out]))
    order = np.lexsort((k, h))  # a sorted array is a heap
    h = h[order]
    to = fresh[h] + np.arange(len(h)) - np.searchsorted(h, h)
    new_keys[to], new_place[to] = k[order], p[order]
    return new_keys, new_place, fresh


def _shifts(x: np.ndarray, entries: int, old: np.ndarray | None, new: np.ndarray) -> np.ndarray:
    """For each entry of a position: parts gained less parts lost, and their sum."""
    out = np.zeros((entries, 1 + x.shape[1]), np.int64)
    with_count = np.concatenate((np.ones((len(x), 1), np.int64), x), 1)
    np.add.at(out, new, with_count)
    if old is not None:
        np.subtract.at(out, old, with_count)
    return out


class Round:
    """The codebooks (position, entry, component) of a round, and each entry's drift so far."""

    def __init__(self, books: np.ndarray, drift: np.ndarray):
        self.books, self.drift = books, drift

    def first(self, x: np.ndarray, p: int) -> tuple[np.ndarray, ...]:
        """Keys, places, starts of the heaps of position ``p``, and the shifts of its entries."""
        cut = self.cut(x, p)
        entry, key = self.assigned(cut, p)
        order = np.lexsort((key, entry))
        starts = np.concatenate(([0], np.cumsum(np.bincount(entry, minlength=len(self.books[p])))))
        return key[order], order.astype(np.int32), starts, _shifts(cut, len(self.books[p]), None, entry)

    def later(self, x: np.ndarray, p: int, keys: np.ndarray, place: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        cut = self.cut(x, p)
        out = violated(keys, starts, self.drift[p])
        entry, key = self.assigned(cut[place[out]], p)
        old = np.searchsorted(starts, out, "right") - 1
        shifts = _shifts(cut[place[out]], len(self.books[p]), old, entry)
        return *exchanged(keys, place, starts, out, entry, key), shifts

    def cut(self, x: np.ndarray, p: int) -> np.ndarray:
        s = self.books.shape[2]
        return x[:, p * s : (p + 1) * s]

    def assigned(self, parts: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        entry, near, second = nearest(parts, self.books[p])
        upper, lower = np.sqrt(near), np.sqrt(second)
        return entry, np.where(np.isinf(second), np.inf, lower - upper - MARGIN * (lower + upper)) + self.drift[p][entry]

    def moved(self, books: np.ndarray) -> Round:
        """The round after: entries' drift grows by their move and the largest other one."""
        gap = books - self.books
        move = np.sqrt((gap.astype(np.float64) ** 2).sum(2))
        top = np.sort(move, 1)
        largest, next_ = top[:, -1:], top[:, -2:-1] if books.shape[1] > 1 else 0 * top
        other = np.where(move.argmax(1)[:, None] == np.arange(books.shape[1]), next_, largest)
        return Round(books, self.drift + (move + other) * (1 + MARGIN))


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _cells(payload: bytes, x: np.ndarray, heaps: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """A block as one row of CELLS; integers as narrow as they can be."""
    most = int(np.abs(x).max(initial=0))
    kind = next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max)
    shifts = np.stack([h[3] for h in heaps])
    flat = shifts.reshape(-1, shifts.shape[2])
    slots = np.flatnonzero(flat.any(1))
    cells = (payload, kind, x.astype(kind).tobytes(), *(b"".join(h[k].astype(t).tobytes() for h in heaps) for k, t in ((0, "<f8"), (1, "<i4"), (2, "<i8"))), flat[slots].astype("<i8").tobytes(), slots.astype("<i4").tobytes())
    return pa.RecordBatch.from_arrays([pa.array([c], pa.string() if isinstance(c, str) else pa.binary()) for c in cells], names=[c.split()[0] for c in CELLS.split(", ")])


def _started(now: Round, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, BLOCK):
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            if np.abs(x).max(initial=0) > limit:
                raise ValueError(f"components beyond {limit} after scaling: squared distances would leave 64 bits")
            positions, _, s = now.books.shape
            x = np.pad(x, ((0, 0), (0, positions * s - x.shape[1])))
            payload = _ipc(batch.drop_columns("x"))
            yield _cells(payload, x, [now.first(x, p) for p in range(positions)])
        common.release()

    return run


def _opened(row: dict, now: Round) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """The vectors and the heaps (keys, places, starts) of a block."""
    positions, entries, s = now.books.shape
    x = np.frombuffer(row["x"], row["kind"]).reshape(-1, positions * s).astype(np.int64)
    held = [np.frombuffer(row[c], t).reshape(positions, -1) for c, t in (("keys", "<f8"), ("place", "<i4"), ("starts", "<i8"))]
    return x, list(zip(*held, strict=True))


def _updated(now: Round):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, heaps = _opened(row, now)
                yield _cells(row["payload"], x, [now.later(x, p, *h) for p, h in enumerate(heaps)])
        common.release()

    return run


def _coded(now: Round):
    """The payload's rows with their codes and errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, heaps = _opened(row, now)
                codes, error = np.zeros((len(x), len(heaps)), np.uint8), np.zeros(len(x), np.int64)
                for p, h in enumerate(heaps):
                    _, place, starts, _ = now.later(x, p, *h)
                    codes[place, p] = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                    gap = now.cut(x, p) - now.books[p][codes[:, p]]
                    error += np.einsum("nd,nd->n", gap, gap)
                text = codes.tobytes().hex()
                width = 2 * len(heaps)
                payload = pa.ipc.open_stream(row["payload"]).read_all().combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*payload.columns, pa.array([text[k * width : (k + 1) * width] for k in range(len(x))], pa.string()), pa.array(error)], names=[*payload.schema.names, "code", "error"])
        common.release()

    return run


def _summed(width: int):
    """The shifts of a task's blocks, added up: a row for each slot that moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for slot, shift in zip(np.frombuffer(row["slots"], "<i4").tolist(), np.frombuffer(row["moved"], "<i8").reshape(-1, width), strict=True):
                    total[slot] = total.get(slot, 0) + shift
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["slot", "shift"])

    return run


def _digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of each vector.

    Components become floor(scale * x); vectors are cut into ``parts`` positions
    (zeros fill up a length that does not divide). Codebooks start as the parts
    of the first ``entries`` vectors by id (nulls last; repeated ids by their
    components; fewer vectors: fewer entries, up to 256). ``rounds`` rounds assign each part to its
    nearest entry, of equals the first, and set entries to the floored means of
    their parts; entries without parts stay. ``error`` is the squared distance
    after a last assignment, ``label_error`` its sum over equal labels, nulls
    together. All of it is exact; a component so large that distances would leave
    64 bits is an error.

    Vectors that are null, hold null or non-finite components or are not of the
    commonest length take no part. Repeated rows keep their rows. Other columns
    are ignored, whatever their names. An empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    label = F.col(label_column) if label_column else F.lit(None).cast("int")
    rows = common.finite(vectors, vector_column, F.col(id_column).cast("long").alias("vec_id"), label.alias("label"))
    rows = rows.select("vec_id", "label", F.transform("embedding", lambda c: F.floor(c * float(scale)).cast("long")).alias("x"))
    start = [r["x"] for r in rows.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()]
    kind = rows.schema["label"].dataType.simpleString()
    if not start or not start[0]:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string")
    d = len(start[0])
    limit = math.isqrt((1 << 61) // d)
    s = -(-d // parts)
    if max(abs(v) for r in start for v in r) > limit:
        raise ValueError(f"components beyond {limit} after scaling: squared distances would leave 64 bits")
    books = np.pad(np.array(start, np.int64), ((0, 0), (0, parts * s - d))).reshape(len(start), parts, s).transpose(1, 0, 2)
    now = Round(books, np.zeros(books.shape[:2]))
    blocks = common.written(rows.mapInArrow(_started(now, limit), CELLS), "codes")
    sums = np.zeros((parts * len(start), 1 + s), np.int64)
    for k in range(rounds):
        shifts = blocks.select("moved", "slots").mapInArrow(_summed(1 + s), "slot int, shift array<long>")
        for slot, *shift in shifts.groupBy("slot").agg(*[F.sum(F.col("shift")[i]) for i in range(1 + s)]).collect():  # one row an entry at most
            sums[slot] += shift
        counts = sums[:, :1]
        means = np.where(counts > 0, np.floor_divide(sums[:, 1:], np.maximum(counts, 1)), now.books.reshape(-1, s))
        now = now.moved(means.reshape(now.books.shape))
        if k + 1 < rounds:
            last, blocks = blocks, common.written(blocks.mapInArrow(_updated(now), CELLS), "codes")
            common.forget(last)
    coded = common.written(blocks.mapInArrow(_coded(now), f"vec_id long, label {kind}, code string, error long"), "coded")
    common.forget(blocks)
    totals = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "_label")
    if totals.limit(LABELS + 1).count() <= LABELS:
        totals = F.broadcast(totals)
    joined = coded.join(totals, coded["label"].eqNullSafe(totals["_label"]), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(_digest(now.books)).alias("codebooks_sha256"))


def op11_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` as four bytes each, with their errors."""
    found = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """The same codes by plain assignment of every part in every round."""
    far = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
    tables = [
        f"v AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x FROM v, range({PARTS}) r(part))",
        f"b0 AS MATERIALIZED (SELECT part, entry, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        tables.append(f"a{k} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, part, min(struct_pack(far := {far}, entry := entry)) AS best, any_value(p.x) AS x FROM p JOIN b{k} b USING (part) GROUP BY vec_id, part)")
        if k < ROUNDS:
            means = f"SELECT part, best.entry AS entry, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS m FROM a{k}, range(1, (SELECT max(len(x)) FROM p) + 1) r(i) GROUP BY part, best.entry, i"
            tables.append(f"m{k} AS (SELECT part, entry, list(m ORDER BY i) AS x FROM ({means}) GROUP BY part, entry)")
            tables.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))")
    tables.append(f"digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})")
    tables.append(f"coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)")
    return "WITH " + ",\n".join(tables) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"


#: For distinct ids.
ORACLE = _oracle()
