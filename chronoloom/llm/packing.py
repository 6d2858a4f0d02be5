"""Best-fit packing of tokenised documents into sequences of fixed length.

Best-fit decreasing needs only how many pieces there are of each length, so
the packing itself is solved on that histogram (``capacity`` entries at most,
whatever the input's size); Spark tokenises, counts, ranks the pieces of each
length, and looks up each piece's sequence and offset in the solved runs.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    """The default vocabulary file, from the installed collection of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class SegmentTree:
    """Which remaining capacities have an open bin; finds the least one that is large enough."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.held = [0] * (2 * self.width)

    def add(self, at: int, by: int) -> None:
        at += self.width
        while at:
            self.held[at] += by
            at >>= 1

    def least(self, low: int) -> int:
        """The least position >= low that holds something, or -1."""
        at = low + self.width
        while not self.held[at]:
            while at & 1:
                at >>= 1
            if not at:
                return -1
            at += 1  # the right neighbour's subtree
        while at < self.width:
            at *= 2
            if not self.held[at]:
                at += 1
        return at - self.width


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pack ``counts[length]`` pieces of each length; runs (length, rank, count, bin, offset).

    A run puts the pieces of its length with ranks ``rank .. rank + count - 1``
    into the bins ``bin .. bin + count - 1`` at ``offset``. The result is that
    of the one-by-one algorithm: pieces by falling length, each into the open
    bin with the least sufficient room, else into a new one.
    """
    tree, open_bins, runs, bins = SegmentTree(capacity), defaultdict(deque), [], 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            open_bins[room].append((first, count))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.least(length)
            if room < 0:
                room, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = open_bins[room].popleft()
                tree.add(room, -1)
            each = room // length  # a bin that takes one piece is then the tightest, until it is full
            whole = min(count, left // each)
            for layer in range(each if whole else 0):
                runs.append((length, rank + layer * whole, whole, first, capacity - room + layer * length))
            rank, left = rank + whole * each, left - whole * each
            put(room - each * length, first, whole)
            rest = min(left, each - 1) if whole < count else 0
            if rest:
                for layer in range(rest):
                    runs.append((length, rank + layer, 1, first + whole, capacity - room + layer * length))
                rank, left = rank + rest, left - rest
                put(room - rest * length, first + whole, 1)
            if (kept := count - whole - (rest > 0)) and room < capacity:
                put(room, first + whole + (rest > 0), kept)
    return runs


class WordTokenizer:
    """Token ids of texts, with each distinct word tokenised once, as a rule.

    The tokenizer drops white space and joins nothing across it, so a text's
    ids are those of its words in a row. A word of Latin letters with full
    stops or commas behind it is tokenised as its lower-case letters, then its
    punctuation; any other word goes to the tokenizer as it is. If a vocabulary
    does not behave so on a probe text, whole texts are tokenised.
    """

    #: So many parts of words are remembered, by 128-bit digests; beyond, all are forgotten.
    KEEP = 1_000_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        # A special token's string holds no white space, so it stays inside one word.
        probe = "It's  Éa,b. x1y22 ... naïve\tfoo_bar <|endoftext|>z\n你好 Word,. a.,"
        whole = self._lists([probe])[0]
        self.by_word = whole == [i for w in self._lists(re.findall(r"[^\x20\x09-\x0D]+", probe)) for i in w] and self._lists(["Éa,."])[0] == sum(self._lists(["éa", ",."]), [])

    def _forget(self) -> None:
        self.keys = np.zeros(0, "S16")  # sorted, with the place and number of each part's ids
        self.place, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _lists(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of the ids of distinct parts; those that are not remembered are tokenised."""
        keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "S16")
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(parts), bool)
        inside = np.flatnonzero(at < len(self.keys))
        new[inside] = self.keys[at[inside]] != keys[inside]
        todo = np.flatnonzero(new)
        if len(todo):
            todo = todo[np.argsort(keys[todo], kind="stable")]
            places, sizes = [], []
            for low in range(0, len(todo), 10_000):
                lists = self._lists([parts[k].decode() for k in todo[low : low + 10_000].tolist()])
                n = np.array([len(x) for x in lists], np.int32)
                flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(n.sum()))
                if self.used + len(flat) > len(self.ids):
                    self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)))
                self.ids[self.used : self.used + len(flat)] = flat
                places.append(self.used + np.cumsum(n) - n)
                sizes.append(n)
                self.used += len(flat)
            into = at[todo]
            self.keys, self.place, self.size = np.insert(self.keys, into, keys[todo]), np.insert(self.place, into, np.concatenate(places)), np.insert(self.size, into, np.concatenate(sizes))
            at = np.searchsorted(self.keys, keys)
        return self.place[at], self.size[at]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts; a null text has no ids."""
        if not self.by_word:
            each = [np.array(x, np.uint32) for x in self._lists([x or "" for x in texts.to_pylist()])]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
        codes, offsets, words = common.words_of(texts)
        if not len(words):
            return np.zeros(0, np.uint32), offsets
        core = pc.ascii_rtrim(words, ".,")
        # below U+0250 (two bytes up to C9 8F) lower() maps each letter by itself and nothing composes
        plain = pc.and_(pc.utf8_is_alpha(core), pc.invert(pc.match_substring_regex(core, "[^\x00-\u024f]|İ")))
        heads = pc.if_else(plain, pc.utf8_lower(core), words).dictionary_encode()
        # a word's punctuation lies behind its core
        own, whole = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (core, words))
        some = np.flatnonzero(plain.to_numpy(zero_copy_only=False) & (own < whole))
        marks = pa.array([w[k:] for w, k in zip(words.take(pa.array(some)).cast(pa.large_binary()).to_pylist(), own[some].tolist(), strict=True)], pa.large_binary()).dictionary_encode()
        parts = self._ids_of(heads.dictionary.cast(pa.large_binary()).to_pylist())
        place, size = np.zeros((2, len(words), 2), np.int64)
        place[:, 0], size[:, 0] = (x[heads.indices.to_numpy()] for x in parts)
        parts = self._ids_of(marks.dictionary.to_pylist())
        place[some, 1], size[some, 1] = (x[marks.indices.to_numpy()] for x in parts)
        n = size.sum(1)[codes]
        stops = np.concatenate(([0], np.cumsum(n)))
        # ids of each distinct word laid end to end, then of each word in turn
        parts = size.ravel()
        laid = np.cumsum(parts) - parts
        own = self.ids[np.repeat(place.ravel() - laid, parts) + np.arange(parts.sum())]
        out = own[np.repeat(laid[::2][codes] - stops[:-1], n) + np.arange(stops[-1])]
        if len(self.keys) > self.KEEP:
            self._forget()
        return out, stops[offsets]


@lru_cache(1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a worker process."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise ``doc_id, text`` and cut documents of over ``capacity`` ids (id 0 ends each)."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(path)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in common.sub_batches(batches, most=2_000_000):
            ids, offsets = encode(batch.column("text"))
            rows: list[tuple[int, int, int, int, int]] = []
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(0)).astype("<u4")
                for p, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append((doc, p, at, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents ``doc_id, text`` into sequences of at most ``capacity`` tokens.

    One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null and empty texts are one id (0); several rows with one doc_id are
    packed each; no rows give no rows; other columns are ignored. Equal lengths
    are interchangeable, so ties cannot change how many sequences there are.
    """
    table = common.written(pieces(docs, path, capacity), "pieces")
    lengths = table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # capacity rows at most
    counts = {r["length"]: r["n"] for r in lengths}
    runs = sorted(best_fit_decreasing(counts, capacity))
    shift = 40  # ranks below 2**40
    keys, firsts, bins, offs = (np.array(x, np.int64) for x in ([r[0] << shift | r[1] for r in runs], [r[1] for r in runs], [r[3] for r in runs], [r[4] for r in runs]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(keys, (b.column("length").to_numpy() << shift) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(bins[at] + rank - firsts[at]), pa.array(offs[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    sizes = docs.sparkSession.createDataFrame(lengths, "length long, n long")
    rank = common.ranked(table.join(F.broadcast(sizes), "length"), ["length"], ["doc_id", "piece", "ids_crc32"], "n")
    return rank.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, packed into sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
