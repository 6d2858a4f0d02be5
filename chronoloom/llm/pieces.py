"""Sampled subword segmentation by forward filtering and backward sampling.

The piece lattice of a text has an edge for each vocabulary piece that matches
somewhere; a segmentation's probability is proportional to the product of its
pieces' weights. No piece of the vocabulary has a word mark behind another
character (this is checked), so the lattice falls apart at word starts, and a
worker runs the forward filter once for each distinct word. Backward sampling
then runs over all words of a batch together, each drawing from random numbers
that depend on the row's key, the word's place in the text and the seed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Piece weight: (rank + 2) ** -ALPHA, as a BPE vocabulary holds merge ranks and no probabilities.
ALPHA, SEED = 1.0, 20


def model_path() -> str:
    """The default vocabulary file, from the installed collection of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Lattice:
    """The vocabulary as a byte trie in one table, with the piece and weight at each node."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.zeros(256, np.int64)
        table: list[dict[int, int]] = [{}]
        piece: list[int] = [-1]
        weight: list[float] = [0.0]
        self.surface: list[bytes] = [b""] * model.get_piece_size()
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            if model.is_byte(i):
                value = int(text[3:5], 16)
                self.byte[value], self.surface[i] = i, bytes([value])
                continue
            if MARK in text.lstrip(MARK):
                raise ValueError(f"piece {text!r} crosses a word start")
            self.surface[i] = text.replace(MARK, " ").encode()
            at = 0
            for b in text.replace(MARK, " ").encode():  # white-space marks are spaces here, so a real mark is no piece
                if b not in table[at]:
                    table[at][b] = len(table)
                    table.append({})
                    piece.append(-1)
                    weight.append(0.0)
                at = table[at][b]
            score = model.get_score(i)
            rank = -score if -1e8 < score <= 0 else model.get_piece_size()
            piece[at], weight[at] = i, -alpha * float(np.log(rank + 2))
        self.next = np.zeros((len(table), 256), np.int32)
        for k, row in enumerate(table):
            for b, to in row.items():
                self.next[k, b] = to
        self.piece, self.weight = np.array(piece), np.array(weight)
        self.fallback = -alpha * float(np.log(model.get_piece_size() + 2))
        self.sizes = np.array([len(s) for s in self.surface], np.int64)
        self.forget()

    def edges(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece, weight) of all edges over ``data``; ``ends[i]``: the end of the word that holds byte i.

        A byte of a character that no piece of one character covers gets its byte piece.
        """
        lead = (data & 0xC0) != 0x80
        start = np.flatnonzero(lead)
        node, at = np.zeros(len(start), np.int64), start.copy()
        out, single = [], np.zeros(len(data), bool)
        width = np.diff(np.append(start, len(data)))
        wide = np.zeros(len(data), np.int64)
        wide[start] = width
        first = start.copy()
        while len(first):
            node = self.next[node, data[at]].astype(np.int64)
            at = at + 1
            ok = node > 0
            first, node, at = first[ok], node[ok], at[ok]
            hit = self.piece[node] >= 0
            f, n, t = first[hit], node[hit], at[hit]
            out.append((f, t, self.piece[n], self.weight[n]))
            single[f[t - f == wide[f]]] = True
            more = at < ends[first]
            first, node, at = first[more], node[more], at[more]
        covered = np.repeat(single[start], width)
        bare = np.flatnonzero(~covered)
        out.append((bare, bare + 1, self.byte[data[bare]], np.full(len(bare), self.fallback)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def words(self, words: list[bytes]) -> dict[str, np.ndarray]:
        """Forward filter of distinct words.

        Nodes are byte positions; a node's edges are those that end there, with
        running shares of its forward mass, so that sampling goes backwards.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))
        data = np.frombuffer(b"".join(words), np.uint8)
        a, b, piece, weight = self.edges(data, np.repeat(first[1:], sizes))
        # Node of position p of word w: first[w] + w + p (a word of n bytes has n + 1 nodes).
        word = np.repeat(np.arange(len(words)), sizes)
        shift = word[a]
        source, target, deep = a + shift, b + shift, b - first[:-1][shift]
        order = np.lexsort((piece, target, deep))
        source, target, piece, weight, deep = source[order], target[order], piece[order], weight[order], deep[order]
        mass = np.full(len(data) + len(words), -np.inf)
        mass[first[:-1] + np.arange(len(words))] = 0.0
        cut = np.flatnonzero(np.diff(deep, prepend=-1, append=-2)) if len(deep) else np.zeros(1, np.int64)
        share = np.zeros(len(source))
        for low, high in zip(cut[:-1], cut[1:], strict=True):  # by the position at which edges end
            value, t = mass[source[low:high]] + weight[low:high], target[low:high]
            head = np.flatnonzero(np.diff(t, prepend=-1))
            top = np.maximum.reduceat(value, head)
            top = np.where(np.isfinite(top), top, 0.0)
            counts = np.diff(np.append(head, len(t)))
            part = np.exp(value - np.repeat(top, counts))
            total = np.add.reduceat(part, head)
            with np.errstate(divide="ignore"):
                mass[t[head]] = top + np.log(total)
            run = np.cumsum(part)
            before = run[head] - part[head]
            with np.errstate(divide="ignore", invalid="ignore"):
                share[low:high] = np.where(np.repeat(total, counts) > 0, (run - np.repeat(before, counts)) / np.repeat(total, counts), 0.0)
        order = np.argsort(target, kind="stable")
        source, target, piece, share = source[order], target[order], piece[order], share[order]
        starts = np.searchsorted(target, np.arange(len(mass) + 1))
        return {"source": source, "piece": piece, "share": np.minimum(share, 1.0) + target, "starts": starts, "end": first[1:] + np.arange(len(words)), "begin": first[:-1] + np.arange(len(words)), "mass": mass}

    def add(self, words: list[bytes]) -> None:
        """Append the filtered lattices of ``words`` to those that are kept."""
        self.codes.update(zip(words, range(len(self.codes), len(self.codes) + len(words)), strict=True))
        new, old = self.words(words), self.net
        nodes, edges = len(old["starts"]) - 1, len(old["source"])
        for name, by in (("source", nodes), ("piece", 0), ("share", nodes), ("end", nodes), ("begin", nodes)):
            self.net[name] = np.concatenate((old[name], (new[name] + by).astype(old[name].dtype)))
        self.net["starts"] = np.concatenate((old["starts"][:-1], (new["starts"] + edges).astype(old["starts"].dtype)))

    def forget(self) -> None:
        self.codes: dict[bytes, int] = {}  # the words' numbers
        none = np.zeros(0, np.int32)
        self.net = {"source": none, "piece": none, "share": np.zeros(0), "starts": np.zeros(1, np.int32), "end": none, "begin": none}

    def sample(self, net: dict[str, np.ndarray], codes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a segmentation of each word occurrence: (pieces, offsets); ``state``: its random state."""
        node, begin = net["end"][codes].astype(np.int64), net["begin"][codes]
        live = np.flatnonzero(node > begin)
        steps, step = [], 0
        while len(live):
            u = (common.mixed(state[live] + np.uint64((step + 1) * int(common.GOLD) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            at, last = net["starts"][node[live]].copy(), net["starts"][node[live] + 1] - 1
            mark = node[live] + u
            todo = np.flatnonzero(at < last)
            while len(todo):  # a node has a few edges
                todo = todo[net["share"][at[todo]] <= mark[todo]]
                at[todo] += 1
                todo = todo[at[todo] < last[todo]]
            steps.append((live, net["piece"][at]))
            node[live] = net["source"][at]
            live = live[node[live] > begin[live]]
            step += 1
        n = np.zeros(len(codes), np.int64)
        for who, _ in steps:
            n[who] += 1
        offsets = np.concatenate(([0], np.cumsum(n)))
        out = np.zeros(offsets[-1], np.int32)
        for k, (who, piece) in enumerate(steps):  # the k-th draw is the k-th piece from the word's end
            out[offsets[who + 1] - 1 - k] = piece
        return out, offsets

    def decode(self, ids: list[int]) -> str:
        """The text of a list of piece ids; the exact inverse of encoding."""
        return b"".join(self.surface[i] for i in ids)[1:].decode()


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, texts' first words) of texts without nulls, each with a space put before it.

    A word is spaces and what follows up to the next space, so only a text's last
    word may be spaces alone. An empty text has no words.
    """
    raw = [b" " + t.encode() if t else b"" for t in texts.to_pylist()]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([0, *map(len, raw)])
    space = data == 0x20
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[ends[:-1][np.diff(ends) > 0]] = True
    starts = np.flatnonzero(head)
    return data, starts, np.searchsorted(starts, ends)


#: So many distinct words' lattices are kept from batch to batch; beyond, all are forgotten.
KEEP = 250_000


def encode_batch(lattice: Lattice, keys: list[object], texts: pa.Array, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids, offsets) of a batch of texts, sampled by row key."""
    if len(lattice.codes) > KEEP:
        lattice.forget()
    data, starts, offsets = split_words(pc.fill_null(texts.cast(pa.large_string()), ""))
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
    distinct = words.dictionary.to_pylist()
    if new := [w for w in distinct if w not in lattice.codes]:
        lattice.add(new)
    codes = np.fromiter(map(lattice.codes.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
    row = np.array([xxhash.xxh3_64_intdigest(str(k), seed) for k in keys], np.uint64)
    n = np.diff(offsets)
    place = np.arange(len(codes)) - np.repeat(offsets[:-1], n)
    state = common.mixed(np.repeat(row, n) + place.astype(np.uint64) * common.MIX2)
    ids, ends = lattice.sample(lattice.net, codes, state)
    return ids, ends[offsets]


@lru_cache(1)
def lattice_of(path: str, alpha: float = ALPHA) -> Lattice:
    """One lattice for all tasks of a worker process."""
    return Lattice(path, alpha)


def encode(docs: DataFrame, path: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, ids: a sampled segmentation of each whole text.

    It depends on doc_id, text, ``alpha`` and ``seed`` alone, so any layout or
    retry gives the same ids; rows with one doc_id and text get the same ids.
    Null and empty texts have no ids. A word of any length is segmented whole, in
    time and memory that grow with its length. Words are told apart by their bytes.
    No rows give no rows; columns beyond doc_id and text are not read. ``alpha`` 0 draws segmentations evenly; a
    large one tends to the best segmentation.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path, alpha)
        for batch in common.sub_batches(batches, most=2_000_000):
            ids, offsets = encode_batch(lattice, batch.column("doc_id").to_pylist(), batch.column("text"), seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), common.packed(ids, offsets, pa.int32())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give an empty text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        for batch in batches:
            texts = [lattice.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, each text segmented by its doc_id."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
