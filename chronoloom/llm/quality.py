"""Quality rules: fixed base rules, then a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word n-grams (1 and 2) and
hashed character n-grams (2 and 4), each as a share of the text's n-grams. It learns
from a bounded sample of labelled rows, in one task of an executor; a disjoint part
of the sample calibrates its probabilities (Platt scaling). Every text is scored whole, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

#: At most so many labelled rows are read to fit and calibrate the classifier.
FIT_ROWS = 3000
BITS = 14
WIDTH = 1 << BITS
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: A text is kept if its calibrated probability of good quality is at least this.
THRESHOLD = 0.5
SYMBOLS = b"#*$%&|<>"
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
#: Brings shares of n-grams, about 1 / WIDTH each, to a scale at which the fit is well conditioned.
SCALE = float(WIDTH) ** 0.75


@dataclass
class Model:
    """Weights of the 2 * WIDTH features and the bias, with calibration already folded in."""

    weights: np.ndarray
    bias: float


class Texts:
    """A batch of texts as words and bytes, and what the rules count in them."""

    def __init__(self, texts: pa.Array):
        self.texts = pc.fill_null(texts.cast(pa.large_string()), "")
        self.codes, self.words, self.dictionary = common.words_of(self.texts)
        self.n = len(self.texts)
        buffers = self.texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[self.texts.offset : self.texts.offset + self.n + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
        self.bytes = data[offsets[0] : offsets[-1]]
        self.ends = offsets - offsets[0]

    def summed(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sums of ``values`` between consecutive offsets."""
        total = np.concatenate(([0], np.cumsum(values)))
        return total[offsets[1:]] - total[offsets[:-1]]

    def counts(self) -> dict[str, np.ndarray]:
        doc = np.repeat(np.arange(self.n), np.diff(self.words))
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        points = ((self.bytes & 0xC0) != 0x80) & ~space[self.bytes]
        lines = pc.split_pattern(self.texts, "\n")
        at = lines.offsets.to_numpy()
        line = lines.flatten().dictionary_encode()
        worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(line.dictionary)), 0).to_numpy(zero_copy_only=False)
        code = line.indices.to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(self.n), np.diff(at))
        used = worded[code] if len(code) else np.zeros(0, bool)
        different = np.unique(owner[used] * (len(worded) + 1) + code[used]) // (len(worded) + 1)
        dup = np.bincount(owner[used], minlength=self.n) - np.bincount(different, minlength=self.n)
        return {
            "n_words": np.diff(self.words),
            "word_chars": self.summed(points, self.ends),
            "n_symbols": self.summed(symbol[self.bytes], self.ends),
            "n_dup_lines": dup,
            "n_repeat_words": self.repeated(doc),
        }

    def repeated(self, doc: np.ndarray) -> np.ndarray:
        """Words in WINDOW-word windows found twice or more in their text."""
        total = len(self.codes)
        if total < WINDOW:
            return np.zeros(self.n, np.int64)
        word = common.mixed((self.codes.astype(np.uint64) + np.uint64(1)) * common.GOLD)
        key = np.zeros(total - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            key = key * np.uint64(0x5851F42D4C957F2D) + word[k : total - WINDOW + 1 + k]
        inside = np.flatnonzero(doc[: total - WINDOW + 1] == doc[WINDOW - 1 :])
        key = common.mixed(key[inside] + common.mixed(doc[inside].astype(np.uint64) + np.uint64(7)))
        _, which, found = np.unique(key, return_inverse=True, return_counts=True)
        starts = inside[found[which] > 1]
        change = np.zeros(total + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + WINDOW, -1)
        return self.summed(np.cumsum(change[:-1]) > 0, self.words)

    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        """(each character's UTF-8 bytes as one number, offsets of the texts)."""
        lead = (self.bytes & 0xC0) != 0x80
        start = np.flatnonzero(lead)
        width = np.diff(np.append(start, len(self.bytes)))
        out = self.bytes[start].astype(np.uint64)
        for k in range(1, 4):
            wide = np.flatnonzero(width > k)
            out[wide] = out[wide] << np.uint64(8) | self.bytes[start[wide] + k]
        return out, np.concatenate(([0], np.cumsum(lead)))[self.ends]

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(feature of each n-gram, offsets of the texts) for words, word pairs and character n-grams."""
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in self.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
        word = own[self.codes] if len(own) else np.zeros(0, np.uint64)
        out = []
        for items, offsets, sizes, shift in ((word, self.words, (1, 2), 0), (*self.characters(), (2, 4), WIDTH)):
            doc = np.repeat(np.arange(self.n), np.diff(offsets))
            for n in sizes:
                if len(items) < n:
                    continue
                gram = items[: len(items) - n + 1].copy()
                for k in range(1, n):
                    gram = common.mixed(gram) * common.GOLD + items[k : len(items) - n + 1 + k]
                gram = common.mixed(gram + np.uint64(n))[doc[: len(gram)] == doc[n - 1 :]]
                out.append(((gram >> np.uint64(64 - BITS)).astype(np.int64) + shift, np.concatenate(([0], np.cumsum(np.maximum(np.diff(offsets) - n + 1, 0))))))
        return out

    def scores(self, model: Model) -> np.ndarray:
        total = np.full(self.n, model.bias)
        for at, offsets in self.features():
            total += SCALE * self.summed(model.weights[at], offsets) / np.maximum(np.diff(offsets), 1)
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))

    def sparse(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(features, values) of each text, by feature."""
        found = self.features()
        out = []
        for k in range(self.n):
            some = [(at[o[k] : o[k + 1]], SCALE / max(o[k + 1] - o[k], 1)) for at, o in found]
            at = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in some)])
            at, which = np.unique(at, return_inverse=True)
            out.append((at.astype("<u2"), np.bincount(which, np.repeat([w for _, w in some], [len(x) for x, _ in some]), len(at)).astype("<f4")))
        return out


class Matrix:
    """A sparse matrix of features by rows and by columns, for products from either side."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        sizes = np.array([len(a) for a, _ in rows], np.int64)
        self.shape = (len(rows), width)
        self.at = np.concatenate([np.zeros(0, np.uint16), *(a for a, _ in rows)])
        self.value = np.concatenate([np.zeros(0, np.float32), *(v for _, v in rows)])
        self.starts, self.full = (np.cumsum(sizes) - sizes)[sizes > 0], np.flatnonzero(sizes)
        order = np.argsort(self.at, kind="stable")
        self.row, self.turned = np.repeat(np.arange(len(rows), dtype=np.uint16), sizes)[order], self.value[order]
        self.columns, self.heads = np.unique(self.at[order], return_index=True)

    def times(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[0], np.float32)
        if len(self.full):
            out[self.full] = np.add.reduceat(self.value * v[self.at], self.starts)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[1], np.float32)
        if len(self.columns):
            out[self.columns] = np.add.reduceat(self.turned * r[self.row], self.heads)
        return out


def logistic(x: Matrix, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise mean log loss + penalty * |w|^2 / 2 (accelerated gradient descent)."""
    n, d = x.shape
    y, penalty = y.astype(np.float32), np.float32(penalty)
    w, b = np.zeros(d, np.float32), 0.0
    v, c = w.copy(), b
    probe = np.ones(d, np.float32) / np.float32(d**0.5)
    for _ in range(20):  # the largest eigenvalue of the curvature bounds the step
        probe = x.back(x.times(probe))
        probe /= max(np.linalg.norm(probe), 1e-30)
    rate = np.float32(1) / np.float32(0.25 * (np.linalg.norm(x.times(probe)) ** 2 / n + 1) * 1.1 + penalty)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(v) + np.float32(c), -60, 60)))
        w2, b2 = v - rate * (x.back(p - y) / np.float32(n) + penalty * v), c - float(rate) * float(np.mean(p - y))
        v, c = w2 + np.float32(t / (t + 3)) * (w2 - w), b2 + t / (t + 3) * (b2 - b)
        w, b = w2, b2
    return w, b


def learned(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model | None:
    """A model fitted on the first three quarters of ``rows`` and calibrated on the rest; None without both kinds in each."""
    cut = len(rows) * 3 // 4
    if len(set(y[:cut])) < 2 or len(set(y[cut:])) < 2:
        return None
    weights, bias = logistic(Matrix(rows[:cut], 2 * WIDTH), y[:cut], 1e-4, 200)
    margin = Matrix(rows[cut:], 2 * WIDTH).times(weights) + bias
    middle, spread = float(margin.mean()), float(margin.std()) or 1.0
    one = Matrix([(np.zeros(1, np.uint16), np.array([m], np.float32)) for m in (margin - middle) / spread], 1)
    a, b = logistic(one, y[cut:], 1e-3, 300)
    slope = float(a[0]) / spread
    return Model((weights * slope).astype(np.float32), float(b) + (bias - middle) * slope)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Fit and calibrate on at most ``rows`` labelled documents; None without labels of both kinds.

    The sample is the labelled rows with the least hashes of doc_id, so it does
    not depend on how the table is laid out. Null labels are left out; of several
    labels of a document the greatest counts; of several texts of a document the
    one with the least hash. The sample meets in one task.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sub_batches(batches, most=1_000_000):
            at, value = zip(*Texts(batch.column("text")).sparse(), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([x.tobytes() for x in at], pa.binary()), pa.array([x.tobytes() for x in value], pa.binary())], names=["doc_id", "quality", "at", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "quality", "at", "value")), strict=True)]
        held.sort(key=lambda r: xxhash.xxh3_64_intdigest(str(r[0])))
        model = learned([(np.frombuffer(a, "<u2"), np.frombuffer(v, "<f4")) for _, _, a, v in held], np.array([q for _, q, _, _ in held], np.float64))
        held.clear()
        common.release()
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    vectors = found.mapInArrow(features, "doc_id long, quality int, at binary, value binary")
    got = vectors.repartition(1).mapInArrow(learn, "weights binary, bias double").collect()  # one row at most
    return Model(np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"]) if got else None


def verdicts(texts: pa.Array, model: Model | None, threshold: float = THRESHOLD) -> dict[str, np.ndarray]:
    """What the rules count and decide for a batch of texts."""
    batch = Texts(texts)
    out = batch.counts()
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["probability"] = batch.scores(model) if model else np.full(batch.n, np.nan)
    out["kept"] = ~out["base_failed"] & (np.isnan(out["probability"]) | (out["probability"] >= threshold))
    return out


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: what the base rules count, their verdict, and the classifier's.

    A null or empty text has no words and fails; a text of any length is judged
    whole. Without a model the base rules decide
    alone and the probability is null. Repeated rows are scored each; no rows
    give no rows; other columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sub_batches(batches, most=1_000_000):
            v = verdicts(batch.column("text"), model, threshold)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v[c].astype(np.int64)) for c in names), pa.array(v["base_failed"]), pa.array(v["kept"]), pa.array(v["probability"], from_pandas=True)], names=["doc_id", *names, "base_failed", "kept", "probability"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COLUMNS)


def keep(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules keep, with all their columns, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sub_batches(batches, most=1_000_000):
            yield batch.select(["own"]).filter(pa.array(verdicts(batch.column("text"), model, threshold)["kept"]))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("text").cast("string").alias("text"))
    kept = rows.mapInArrow(run, StructType([rows.schema["own"]]))
    return kept.select(*[F.col("own").getField(c).alias(c) for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, by a classifier fitted on ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
