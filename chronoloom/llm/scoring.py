"""Language-model scoring by deleted interpolation.

Counts of words and word pairs come from all training texts. Batches of texts
send each distinct n-gram once to its bucket (by hash), with the batch's counts;
buckets add them up and send totals back, in the batch's order. One fold of the
training texts is held out: on its word pairs, with the counts of the other
folds, expectation-maximisation learns how much weight the maximum-likelihood
estimate gets, for each bucket of context frequencies. (The estimate of single
words has one context, the empty one, so one weight.) The final model uses these
weights with the counts of all training texts. What is learned from are counts of
ratios between the two estimates, in bins of an eighth of a power of two.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, TEST_FOLD, HELD_FOLD = 7, 2, 3
#: Bytes of text that share requests; bytes of input for each bucket of n-grams.
BATCH, BUCKET = 8_000_000, 12_000_000
#: Bits that tell pairs of words apart in a bucket.
PAIR_BITS = 48
END, START = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Context frequencies fall into buckets by powers of two; ratios of estimates into bins of an eighth of a power of two.
FREQUENCIES, BINS, FINE = 48, 1024, 8
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _streams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, contexts, offsets): hashes of each text's words and end, and of what stands before each."""
    codes, offsets, words = common.words_of(texts, lower=True)
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)
    n = len(offsets) - 1
    ends = offsets + np.arange(n + 1)  # with one end for each text
    stream = np.empty(ends[-1], np.uint64)
    last = ends[1:] - 1
    inner = np.ones(len(stream), bool)
    inner[last] = False
    stream[inner] = own[codes] if len(codes) else 0
    stream[last] = END
    context = np.empty_like(stream)
    context[1:] = stream[:-1]
    context[ends[:-1]] = START
    return stream, context, ends


def _pairs(stream: np.ndarray, context: np.ndarray) -> np.ndarray:
    return common.mixed(common.mixed(context) * common.GOLD + stream)


def _edges(buckets: int) -> np.ndarray:
    """The least hash of each bucket."""
    return np.array([-(-(k << 64) // buckets) for k in range(buckets)], np.uint64)


def _planes(values: np.ndarray) -> np.ndarray:
    """The bytes of 64-bit numbers: all lowest bytes, then all second ones, and so on."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _squeezed(values: np.ndarray) -> bytes:
    """Small numbers, compressed."""
    return zstandard.compress(_planes(values).tobytes(), 1)


def _unsqueezed(data: bytes) -> np.ndarray:
    return _from_planes(zstandard.decompress(data)) if data else np.zeros(0, np.uint64)


def _sealed(keys: np.ndarray) -> bytes:
    """Rising numbers as their differences, whose high bytes are compressed; the four low ones are as good as random."""
    planes = _planes(np.diff(keys, prepend=np.uint64(0)))
    return planes[:4].tobytes() + zstandard.compress(planes[4:].tobytes(), 1)


def _unsealed(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_from_planes(data[: 4 * n] + zstandard.decompress(data[4 * n :])), dtype=np.uint64) if n else np.zeros(0, np.uint64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each batch of texts: its number, doc_ids, folds and compressed texts; the held-out fold is apart."""
    press = zstandard.ZstdCompressor(3)
    part = TaskContext.get().partitionId()
    for k, batch in enumerate(common.sub_batches(batches, most=BATCH)):
        held = batch.column("fold").to_numpy() == HELD_FOLD
        cells = [part << 24 | k]
        for mask in (~held, held):
            some = batch.filter(pa.array(mask))
            texts = [(t or "").encode() for t in some.column("text").to_pylist()]
            cells += [some.column("doc_id").to_pylist(), some.column("fold").to_pylist(), [len(t) for t in texts], press.compress(b"".join(texts))]
        kinds = (pa.int64(), *(pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()) * 2)
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names=["batch", "ids", "folds", "sizes", "z", "held_ids", "held_folds", "held_sizes", "held_z"])


PACKS = "batch long, ids array<long>, folds array<int>, sizes array<long>, z binary, held_ids array<long>, held_folds array<int>, held_sizes array<long>, held_z binary"


def _texts(sizes: list[int], *z: bytes) -> pa.Array:
    data = b"".join(map(zstandard.decompress, z))
    ends = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(data))


def _unpacked(cells: dict) -> tuple[list[int | None], np.ndarray, pa.Array]:
    """(doc_ids, folds, texts) of a batch's row, held-out texts last."""
    return cells["ids"] + cells["held_ids"], np.array(cells["folds"] + cells["held_folds"], np.int64), _texts(cells["sizes"] + cells["held_sizes"], cells["z"], cells["held_z"])


def _each(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


REQUESTS = "bucket long, batch long, n_words int, n_pairs int, words binary, pairs binary, counts binary, held binary"


def _requests(buckets: int):
    """For each batch and bucket: the batch's distinct words and pairs in it, with their counts in all training texts and in held-out ones."""
    edges = _edges(buckets)
    shift = np.uint64(max(0, 64 - PAIR_BITS - (buckets.bit_length() - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in REQUESTS.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
        for number, folds, texts in ((row["batch"], *_unpacked(row)[1:]) for batch in batches for row in _each(batch)):
            stream, context, ends = _streams(texts)
            fold = np.repeat(folds, np.diff(ends))
            sides = []
            for keys in (np.append(stream, START), _pairs(stream, context)):
                keys, which = np.unique(keys, return_inverse=True)
                counts, held = (np.bincount(which[: len(stream)], mask, len(keys)).astype(np.uint64) for mask in (fold != TEST_FOLD, fold == HELD_FOLD))
                if not sides:  # starts count as contexts: as often as there are training texts
                    counts[which[-1]], held[which[-1]] = int((folds != TEST_FOLD).sum()), int((folds == HELD_FOLD).sum())
                sides.append((keys, counts, held, np.append(np.searchsorted(keys, edges), len(keys))))
            (words, c1, h1, cut1), (pairs, c2, h2, cut2) = sides
            out = []
            for b in np.flatnonzero(np.diff(cut1) + np.diff(cut2)).tolist():
                i, j, k, m = cut1[b], cut1[b + 1], cut2[b], cut2[b + 1]
                own = (_sealed(words[i:j] - edges[b]), _sealed((pairs[k:m] - edges[b]) >> shift))
                out.append((b, number, j - i, m - k, *own, _squeezed(np.concatenate((c1[i:j], c2[k:m]))), _squeezed(np.concatenate((h1[i:j], h2[k:m])))))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            common.release()

    return run


ANSWERS = "batch long, bucket long, words binary, pairs binary, words_rest binary, pairs_rest binary"


def _answer(edges: np.ndarray):
    """A bucket's totals for each request, in its order, and without the held-out texts where the batch's held-out texts have the n-gram; and sums (batch -1)."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        start = START - edges[bucket] if edges[bucket] <= START else None
        batches, n_words, n_pairs = (table.column(c).to_pylist() for c in ("batch", "n_words", "n_pairs"))
        counts, held = ([_unsqueezed(x.as_py()) for x in table.column(c)] for c in ("counts", "held"))
        cells: list[list] = [batches, [bucket] * len(batches)]
        rests, sums = [], b""
        for kind, (sizes, name) in enumerate(((n_words, "words"), (n_pairs, "pairs"))):
            side = slice(None, 1) if kind == 0 else slice(1, None)
            of = lambda x, n: np.split(x, [n])[side][0]
            keys, which = np.unique(np.concatenate([_unsealed(x.as_py(), n) for x, n in zip(table.column(name), sizes, strict=True)]), return_inverse=True)
            some, own_held = (np.concatenate([of(x, n) for x, n in zip(xs, n_words, strict=True)]) for xs in (counts, held))
            total, out = (np.bincount(which, x, len(keys)).astype(np.uint64) for x in (some, own_held))
            rest, ends = total - out, np.cumsum(sizes)
            parts = np.split(which, ends[:-1])
            cells.append([_squeezed(total[w]) for w in parts])
            rests.append([_squeezed(rest[w[h > 0]]) for w, h in zip(parts, np.split(own_held, ends[:-1]), strict=True)])
            if kind == 0:
                word = keys != start if start is not None else np.ones(len(keys), bool)
                # of the held-out words, how many were found how often in the rest (in bins)
                bins = np.bincount(_bin(rest[word]), out[word], BINS).astype("<u8").tobytes()
                sums = struct.pack("<4Q", int((total[word] > 0).sum()), int(total[word].sum()), int((rest[word] > 0).sum()), int(rest[word].sum()))
        cells += rests
        for c, x in zip(cells, (-1, bucket, sums, bins, b"", b""), strict=True):
            c.append(x)
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
        del counts, held, keys, which, some, own_held, total, out, rest, parts
        common.release()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=[x.split()[0] for x in ANSWERS.split(", ")])

    return run


def _bin(counts: np.ndarray) -> np.ndarray:
    """Bin of a count: 0 to 64 have their own, then an eighth of a power of two each."""
    big = np.maximum(counts, 1).astype(np.float64)
    return np.where(counts <= 64, counts, np.floor(65 + FINE * (np.log2(big) - 6))).astype(np.int64).clip(0, BINS - 1)


def _middle(bins: np.ndarray) -> np.ndarray:
    return np.where(bins <= 64, bins, 2.0 ** (6 + (bins - 65 + 0.5) / FINE))


def mixture(ratio: np.ndarray, n: np.ndarray, rounds: int = 200) -> float:
    """The weight of an estimate that is ``ratio`` times the other one, by expectation-maximisation over ``n`` held-out counts."""
    weight, total = 0.5, n.sum()
    if not total:
        return 0.0
    for _ in range(rounds):
        new = float((n * weight * ratio / (weight * ratio + 1 - weight)).sum() / total)
        if abs(new - weight) < 1e-9:
            break
        weight = new
    return min(weight, 1 - 1e-9)


def _looked_up(answers: pa.Table, suffix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Counts of a batch's distinct words and pairs, in the order of their keys."""
    order = np.argsort(answers.column("bucket").to_numpy())
    return tuple(np.concatenate([np.zeros(0, np.uint64), *(_unsqueezed(answers.column(c + suffix)[k].as_py()) for k in order.tolist())]) for c in ("words", "pairs"))


def _counted(texts: pa.Array, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(c(word), c(context), c(context, word), offsets) of all tokens of a batch."""
    stream, context, ends = _streams(texts)
    keys, which = np.unique(np.append(stream, START), return_inverse=True)
    single = words[which]
    before = np.empty(len(stream), np.uint64)
    before[1:] = single[:-2]
    before[ends[:-1]] = single[-1]
    _, both = np.unique(_pairs(stream, context), return_inverse=True)
    return single[:-1], before, pairs[both], ends


def _frequency(before: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(before, 1).astype(np.float64))).astype(np.int64).clip(0, FREQUENCIES - 1)


def score(docs: DataFrame) -> DataFrame:
    """Scores of documents (doc_id, text).

    One row a document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probabilities of the unigram baseline and of the
    interpolated model). A null text is empty: its only token is the end. A null
    doc_id counts as an empty one, in training. Repeated rows count and are scored
    each. Texts of any length are counted and scored whole, in memory that grows
    with the longest. No rows give no rows; columns beyond doc_id and text are not
    read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("fold", F.pmod(common.crc32_of(F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    packs = common.written(rows.mapInArrow(_pack, PACKS), "packs")
    requests = packs.mapInArrow(_requests(buckets), REQUESTS)
    answers = common.written(requests.groupBy("bucket").applyInArrow(_answer(_edges(buckets)), ANSWERS), "answers")
    # sums: one row a bucket, added up in Spark; bins: BINS numbers
    sums = answers.where("batch = -1")

    def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for total, rest in zip(batch.column("words").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                bins = np.frombuffer(rest, "<u8")
                full = np.flatnonzero(bins)
                at += [-4, -3, -2, -1, *full.tolist()]
                n += [*struct.unpack("<4Q", total), *bins[full].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["at", "n"])

    got = {r["at"]: r["n"] for r in sums.mapInArrow(_unpack, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}  # BINS + 4 rows at most
    v, total, v_rest, n_rest = (got.pop(k, 0) for k in (-4, -3, -2, -1))
    at, n = np.array(sorted(got), np.int64), np.array([got[k] for k in sorted(got)], np.float64)
    single = mixture(_middle(at) / max(n_rest, 1) * (v_rest + 1), n)

    def ratios(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:  # no held-out texts in this batch
            return pa.table({"f": pa.array([], pa.int32()), "r": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        row = next(_each(docs))
        one, before, two, _ = _counted(_texts(row["held_sizes"], row["held_z"]), *_looked_up(answers, "_rest"))
        ok = before > 0
        low = single * one[ok] / max(n_rest, 1) + (1 - single) / (v_rest + 1)
        with np.errstate(divide="ignore"):
            ratio = np.log2(two[ok] / before[ok] / low)
        bins = np.where(two[ok] > 0, np.floor(ratio * FINE) + BINS // 2, 0).clip(0, BINS - 1).astype(np.int64)
        hist = np.bincount(_frequency(before[ok]) * BINS + bins, minlength=FREQUENCIES * BINS)
        full = np.flatnonzero(hist)
        return pa.table({"f": pa.array((full // BINS).astype(np.int32)), "r": pa.array((full % BINS).astype(np.int32)), "n": pa.array(hist[full].astype(np.int64))})

    held = answers.where("batch >= 0").select("batch", "bucket", "words_rest", "pairs_rest")
    learn_from = packs.where(F.size("held_ids") > 0).select("batch", "held_sizes", "held_z")
    hist = learn_from.groupBy("batch").cogroup(held.groupBy("batch")).applyInArrow(ratios, "f int, r int, n long")
    found = hist.groupBy("f", "r").agg(F.sum("n").alias("n")).collect()  # FREQUENCIES * BINS rows at most
    weights = np.zeros(FREQUENCIES)
    for f in range(FREQUENCIES):
        own = [r for r in found if r["f"] == f]
        r, n = np.array([x["r"] for x in own], np.float64), np.array([x["n"] for x in own], np.float64)
        weights[f] = mixture(np.where(r > 0, 2.0 ** ((r - BINS // 2 + 0.5) / FINE), 0.0), n)

    def scores(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        doc_ids, folds, texts = _unpacked(next(_each(docs)))
        one, before, two, ends = _counted(texts, *_looked_up(answers))
        low = single * one / max(total, 1) + (1 - single) / (v + 1)
        weight = np.where(before > 0, weights[_frequency(before)], 0.0)
        model = np.log10(weight * two / np.maximum(before, 1) + (1 - weight) * low)
        base = np.log10((one + 1.0) / (total + 1.0 * (v + 1)))
        add = lambda x: np.add.reduceat(x, ends[:-1])  # noqa: E731  each text has a token
        common.release()
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "held_out": pa.array(folds == TEST_FOLD), "n_tokens": pa.array(np.diff(ends)), "n_known": pa.array(add((one > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(ends) - 1, total, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(model))})

    return packs.groupBy("batch").cogroup(answers.where("batch >= 0").select("batch", "bucket", "words", "pairs").groupBy("batch")).applyInArrow(scores, SCORES)


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, by a word-pair model of the training folds."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
