"""Near-duplicate detection with ProbMinHash signatures, banding and verification.

A text's elements are its shingles of five words, weighted by 1 + ln(count).
Each element is a Poisson process with its weight as rate; an arrival falls into
a random register, which keeps the earliest arrival's element. A process ends
when its next arrival comes later than all registers hold. Two signatures agree
in a register with the probability Jaccard similarity of the weighted sets.

Equal texts are one node. Nodes that share a band meet in a bucket. First each
node is compared with the pivot (the bucket member that meets most others) that
it shares most bands with; pairs of 0.8 and more by the exact similarity become
links. Members of buckets that are then still in several components are looked at
again: those that share one of their rare elements, are in different components
and whose finer signatures do not rule out the threshold are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORDS, THRESHOLD = 5, 0.8
#: 0.8 ** 5 of the bands of a pair at the threshold agree: none of 25 in one pair of 20,000.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Registers (a byte each) of the fine signatures, which members that meet again have.
FINE = 1024
#: Fine signatures that agree in a smaller share rule a pair out: six standard deviations under the threshold.
FLOOR = THRESHOLD - 6 * (THRESHOLD * (1 - THRESHOLD) / FINE) ** 0.5
#: Members of a group whose signatures are compared with as many others in one step.
BLOCK = 256
#: A pair meets at its first common element if the second is among so many behind the first; else again at such a one.
EARLIER = 64
#: Pairs of two components that are compared exactly in the first round.
FIRST = 16


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of each text's distinct shingles, sorted by text and hash; and a hash of each text's words.

    Fewer than five words are one shingle; a text without words has none.
    """
    codes, offsets, words = common.words_of(texts)
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)
    word = common.mixed(own[codes]) if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    size = np.minimum(n, WORDS)
    count = np.where(n > 0, n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][doc]
    key = np.zeros(len(doc), np.uint64)
    for k in range(WORDS):
        inside = k < size[doc]
        step = word[np.minimum(first + k, max(len(word) - 1, 0))] if len(word) else key
        key = np.where(inside, common.mixed(key * common.GOLD + step + np.uint64(k + 1)), key)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))) if len(doc) else np.zeros(0, np.int64)
    total = np.diff(np.append(new, len(doc)))
    place = np.arange(len(word)) - np.repeat(offsets[:-1], n)
    spread = common.mixed(word + common.mixed(place.astype(np.uint64)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)))
    whole = common.mixed(sums[offsets[1:]] - sums[offsets[:-1]] + n.astype(np.uint64))
    return doc[new], key[new], total, whole


def weights(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """For each of ``n`` texts, the element (its hash) that arrives first in each register; 0 without elements."""
    when = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, np.uint64)
    doc, element, weight, clock, step = doc, key, weight, np.zeros(len(doc)), 0
    while len(doc):
        u = common.mixed(element + np.uint64((2 * step + 1) * int(common.GOLD) & (1 << 64) - 1))
        v = common.mixed(element + np.uint64((2 * step + 2) * int(common.GOLD) & (1 << 64) - 1))
        clock = clock - np.log1p(-(u >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight
        at = doc * registers + ((v >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(when, at, clock)
        won = when[at] == clock
        who[at[won]] = element[won]
        live = np.unique(doc)
        last = np.zeros(n)
        last[live] = when.reshape(n, registers)[live].max(1)
        more = clock < last[doc]  # later arrivals of the others cannot win any register
        doc, element, weight, clock = doc[more], element[more], weight[more], clock[more]
        step += 1
    return who.reshape(n, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two sets of (sorted hashes, weights); 0 if either is empty."""
    (ha, wa), (hb, wb) = a, b
    at = np.searchsorted(hb, ha)
    both = np.zeros(len(ha), bool)
    inside = at < len(hb)
    both[inside] = hb[at[inside]] == ha[inside]
    if not both.any():
        return 0.0
    if not (wa > 1).any() and not (wb > 1).any():
        n = int(both.sum())
        return n / (len(ha) + len(hb) - n)
    alone = np.ones(len(hb), bool)
    alone[at[both]] = False
    # elements with equal pairs of weights contribute alike
    x, y = np.concatenate((wa, np.zeros(alone.sum()))), np.concatenate((np.zeros(len(ha)), wb[alone]))
    y[: len(ha)][both] = wb[at[both]]
    kinds, n = np.unique(np.stack((x, y), 1), axis=0, return_counts=True)
    x, y = kinds.T
    met = (x > 0) & (y > 0)
    total = 0.0
    for low in range(0, int(met.sum()), 256):
        p, q = x[met][low : low + 256, None], y[met][low : low + 256, None]
        total += float((n[met][low : low + 256] / (np.maximum(x[None] / p, y[None] / q) * n).sum(1)).sum())
    return total


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.sub_batches(batches, most=3_000_000):
        doc, key, count, whole = shingles(batch.column("text"))
        n = batch.num_rows
        first = signatures(doc, key, weights(count), n)
        first = first.reshape(n, BANDS, ROWS)
        band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * common.MIX1, (n, BANDS))
        for r in range(ROWS):
            band = common.mixed(band * common.GOLD + first[:, :, r])
        filled = np.bincount(doc, minlength=n) > 0
        # a second hash of the text: of its shingles and their counts
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(common.mixed(key + count.astype(np.uint64) * common.MIX2), dtype=np.uint64)))
        ends = np.searchsorted(doc, np.arange(n + 1))
        again = sums[ends[1:]] - sums[ends[:-1]]
        offsets = np.concatenate(([0], np.cumsum(np.where(filled, BANDS, 0))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(whole.view(np.int64)), pa.array(again.view(np.int64)), common.packed(band[filled].ravel().view(np.int64), offsets, pa.int64())], names=["doc_id", "t", "k1", "k2", "bands"])


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(3)
    for batch in common.sub_batches(batches):
        z = [press.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(z, pa.binary())], names=["doc_id", "t", "z"])


def _sets(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted hashes, weights) of compressed texts."""
    press = zstandard.ZstdDecompressor()
    doc, key, count, _ = shingles(pa.array([press.decompress(t).decode() for t in texts], pa.large_string()))
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(key[a:b], weights(count[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _linked(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # the pivot of the pairs at hand; pairs come sorted by it
        for batch in common.sub_batches(batches, "zb", 500_000):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            places = {x: k for k, x in enumerate(a) if x not in held}  # each pivot is decoded once a batch
            za, zb = batch.column("za"), batch.column("zb").to_pylist()
            fresh = _sets([*(za[k].as_py() for k in places.values()), *zb])
            pivots = held | dict(zip(places, fresh, strict=False))
            rest = fresh[len(places) :]
            sims = np.array([similarity(pivots[x], s) for x, s in zip(a, rest, strict=True)])
            held = {a[-1]: pivots[a[-1]]}
            ok = sims >= threshold - 1e-12
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[ok]), pa.array(np.array(b, np.int64)[ok])], names=["a", "b"])

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root, element, share of the text's weights) of compressed texts (node, root, z)."""
    for batch in common.sub_batches(batches, "z", 500_000):
        sets = _sets(batch.column("z").to_pylist())
        sizes = [len(keys) for keys, _ in sets]
        cells = (
            np.repeat(batch.column("node").to_numpy(), sizes),
            np.repeat(batch.column("root").to_numpy(), sizes),
            np.concatenate([keys for keys, _ in sets]).view(np.int64),
            np.concatenate([w / max(w.sum(), 1.0) for _, w in sets]),
        )
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=["node", "root", "element", "share"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sig: a byte a register) of compressed texts (node, z)."""
    for batch in common.sub_batches(batches, "z", 500_000):
        sets = _sets(batch.column("z").to_pylist())
        doc = np.repeat(np.arange(len(sets)), [len(keys) for keys, _ in sets])
        first = signatures(doc, np.concatenate([keys for keys, _ in sets]), np.concatenate([w for _, w in sets]), len(sets), FINE)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([row.tobytes() for row in first.astype(np.uint8)], pa.binary())], names=["node", "sig"])


def _common(left: list[list[int]], right: list[list[int]]) -> np.ndarray:
    """Whether each list of ``left`` has an item in common with each of ``right``."""
    flat = [np.array([x for items in side for x in items], np.int64) for side in (left, right)]
    both = np.intersect1d(*flat)
    has = [np.zeros((len(side), len(both)), np.float32) for side in (left, right)]
    for side, items, marks in zip((left, right), flat, has, strict=True):
        owner = np.repeat(np.arange(len(side)), [len(x) for x in side])
        held = np.isin(items, both)
        marks[owner[held], np.searchsorted(both, items[held])] = 1
    return has[0] @ has[1].T > 0


def _agreeing(floor: float, threshold: float):
    """Pairs (a < b) of different roots (ra, rb) whose fine signatures agree in a share of at least ``floor``.

    Of blocks (left and right: lists of node, root, sig, onward, earlier; no right:
    the left with itself). A pair whose ``onward`` rule it out is left out, and one
    that has an element in common among ``earlier`` is another block's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[np.ndarray] = [np.zeros((0, 5), np.int64)]
            for r in range(batch.num_rows):
                left, right = (batch.column(c)[r].as_py() for c in ("left", "right"))
                alone, right = right is None, right or left
                (na, ra, sa, oa), (nb, rb, sb, ob) = ((np.array([x["node"] for x in side]), np.array([x["root"] for x in side]), np.frombuffer(b"".join(x["sig"] for x in side), np.uint8).reshape(len(side), FINE), np.array([x["onward"] for x in side])) for side in (left, right))
                apart = (ra[:, None] != rb[None, :]) & (1 / oa[:, None] + 1 / ob[None, :] <= 1 + 1 / threshold + 1e-9)
                apart &= ~_common([x["earlier"] for x in left], [x["earlier"] for x in right])
                met = np.argwhere(np.triu(apart, 1) if alone else apart)
                for low in range(0, len(met), BLOCK * 32):
                    i, j = met[low : low + BLOCK * 32].T
                    equal = (sa[i] == sb[j]).sum(1)
                    ok = equal >= floor * FINE
                    i, j = i[ok], j[ok]
                    turned = (na[i] > nb[j])[:, None]
                    ends = np.where(turned, np.column_stack((nb[j], na[i])), np.column_stack((na[i], nb[j])))
                    rows.append(np.column_stack((ends, np.minimum(ra[i], rb[j]), np.maximum(ra[i], rb[j]), equal[ok])))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(rows).T], names=["a", "b", "ra", "rb", "equal"])

    return run


def prefixes(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(element, n, node, root, onward) of the rare elements of ``members`` (node, root, z) that any similar pair of different roots has one of in common.

    Elements are in one order, by their frequency ``n`` among members. ``onward``
    is the share of a text's weights that lies on an element and those behind it,
    as far as other members hold them. A pair's similarity is at most
    1 / (1 / p + 1 / q - 1), p and q being the shares of either's weights that lie on
    common elements (see ``candidates``), so at the first common element of a pair at
    the threshold both ``onward`` are at least the threshold. A template that many
    texts hold comes last and brings no pairs, until it makes up that share.
    Elements of one root alone bring no pairs either.
    """
    elements = common.written(members.select("node", "root", "z").mapInArrow(_elements, "node long, root long, element long, share double"), "elements")
    counts = elements.groupBy("element").agg(F.count(F.lit(1)).alias("n"), (F.min("root") < F.max("root")).alias("mixed")).where("n > 1")
    shared = common.met_with(elements, "element", common.written(counts, "counts"), "n")
    onward = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("element")).rowsBetween(Window.unboundedPreceding, 0)
    early = shared.withColumn("onward", F.sum("share").over(onward)).where(F.col("mixed") & (F.col("onward") >= threshold - 1e-9))
    return early.select("element", "n", "node", "root", "onward")


def candidates(members: DataFrame, threshold: float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """Pairs (a, b, ra, rb, equal) of ``members`` (node, root, z) of different roots that may be at the threshold by their first common element.

    With p and q of the weights on common elements, an element that has the shares
    x and y of these adds 1 / (1 / x + (1 - q) / y) to the similarity at most; that is
    concave, so all add 1 / (1 / p + 1 / q - 1) at most. ``onward`` of the first common
    element bounds p and q: one of them must be 0.89 where 0.8 is the threshold, so
    a template that makes up less of all texts brings no pairs. ``equal`` is the
    number of registers that agree; pairs under ``floor`` are left out.
    """
    early = common.written(prefixes(members, threshold), "prefixes")
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    most = 1 + 1 / threshold + 1e-9
    groups = early.groupBy("element").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("onward").alias("top"), *marks)
    groups = groups.where((F.col("low") < F.col("high")) & (2 / F.col("top") <= most))
    # of elements that the same nodes hold the first is enough: onward is largest there
    groups = groups.groupBy("size", "x0", "x1").agg(F.min(F.struct("n", "element", "top")).alias("first"))
    groups = groups.select("first.element", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("g"), "first.top")
    met = common.met_with(early, "element", common.written(groups, "groups"), "size").where(1 / F.col("onward") + 1 / F.col("top") <= most)
    before = Window.partitionBy("node").orderBy("n", "element").rowsBetween(-EARLIER, -1)
    met = common.written(met.select("*", F.collect_list("element").over(before).alias("earlier")), "met")
    fine = members.join(met.select("node").distinct(), "node", "left_semi").select("node", "z").mapInArrow(_fine, "node long, sig binary")
    dealt = met.withColumn("part", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).join(common.written(fine, "fine"), "node")
    blocks = dealt.groupBy("element", "part", "g").agg(F.collect_list(F.struct("node", "root", "sig", "onward", "earlier")).alias("left"))
    blocks = common.written(blocks, "blocks")
    alone = blocks.select("left", F.lit(None).cast(blocks.schema["left"].dataType).alias("right"))
    large = blocks.where("g > 1")
    others = large.select("element", F.col("part").alias("other"), F.col("left").alias("right"))
    pairs = large.join(others, "element").where("part < other").select("left", "right")
    return alone.union(pairs).mapInArrow(_agreeing(floor, threshold), "a long, b long, ra long, rb long, equal long").distinct()


def between(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """Links between members (node, root) of different components: enough of them to join what is to be joined.

    Candidates are compared exactly in rounds: for each two components the
    likeliest pairs first, sixteen times as many in each round; pairs that a link has
    brought into one component are done.
    """
    members = common.written(members.join(texts, "node"), "members")
    left = common.written(candidates(members, threshold, floor), "candidates")
    found, most = left.select("a", "b").limit(0), FIRST
    while not left.isEmpty():
        order = Window.partitionBy("ra", "rb").orderBy(F.desc("equal"), "a", "b")
        tried = common.written(left.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k"), "tried")
        new = links(tried.select("a", "b"), texts, threshold)
        rest = left.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        if not new.isEmpty():
            found = found.union(new)
            labels = components(tried.join(new, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
            for end in ("ra", "rb"):
                rest = rest.join(labels.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
            rest = rest.where("ra <> rb").select("a", "b", F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb"), "equal")
        left, most = common.written(rest, "candidates"), 16 * most
    return found


def links(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose texts (node, z) are similar, as a table."""
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")), "a")
    return common.written(two.select("a", "b", "za", "zb").mapInArrow(_linked(threshold), "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b): root is the least node of its component.

    Alternates large and small stars until nothing changes; the number of rounds
    grows with the logarithm of a component's size.
    """
    now = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.written(large.where("u <> v"), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, common.written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        common.forget(before)
        common.forget(large)


def _classed(docs: DataFrame, threshold: float, floor: float = FLOOR) -> DataFrame:
    """doc_id, t (a hash of the text), class_id and root (a number of the class) of each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    signed = common.written(rows.mapInArrow(_sign, "doc_id long, t long, k1 long, k2 long, bands array<long>"), "signed")
    known = signed.where("doc_id is not null")
    # a node is a text (as a list of words), numbered when it is written
    copies = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    copies = common.written(copies.withColumn("node", F.monotonically_increasing_id()), "copies")
    nodes = known.join(copies, ["k1", "k2"]).where("doc_id = least").dropDuplicates(["node"])
    met = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = common.written(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    met = common.written(met.join(buckets, "bucket"), "met")  # bucket, node, band, n
    heavy = common.written(met.groupBy("node").agg(F.sum("n").alias("w")), "heavy")
    met = common.written(met.drop("n").join(heavy, "node"), "weighed")
    # texts of the nodes that meet others, compressed, once
    wanted = nodes.select("node", "doc_id", "t").join(heavy.select("node"), "node")
    texts = rows.mapInArrow(_press, "doc_id long, t long, z binary").join(wanted, ["doc_id", "t"]).dropDuplicates(["node"]).select("node", "z")
    texts = common.written(texts, "texts")

    pivots = met.groupBy("bucket").agg(F.max_by("node", F.struct("w", -F.col("node"))).alias("pivot"))
    stars = met.join(common.written(pivots, "pivots"), "bucket").where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("shared"))
    best = stars.groupBy("node").agg(F.max_by("pivot", F.struct("shared", -F.col("pivot"))).alias("a")).select("a", F.col("node").alias("b"))
    labels = components(links(common.written(best, "pairs"), texts, threshold))
    rooted = met.join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("root", "node").alias("root"))
    split = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    mixed = rooted.join(common.written(split, "split"), "bucket").select("node", "root").distinct()
    more = between(mixed, texts, threshold, floor)
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    # the least doc_id of each class of several nodes
    members = labels.union(labels.select("root", "root").distinct()).join(copies.select("node", "least"), "node")
    leasts = common.written(members.groupBy("root").agg(F.min("least").alias("class_id")), "leasts")
    many = members.join(leasts, "root").select("node", "root", "class_id")
    by_text = copies.join(many, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "least").alias("class_id"))
    found = signed.join(by_text, ["k1", "k2"], "left")
    return found.select("doc_id", "t", *(F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("class_id", "root")))


def classes(docs: DataFrame, threshold: float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """One row a document: doc_id and class_id, the least doc_id of its class.

    Classes are the components of the graph whose links join equal texts (word by
    word) and texts of similarity ``threshold`` or more. The similarity compares
    shares of the weights, so a text and its repetition are similar. A null text
    has no words; texts without words are one class. Rows with one doc_id get one
    row each, by their own text; rows with a null doc_id have a null class. Texts
    of any length are compared whole, in memory that grows with the longest. No
    rows give no rows; columns beyond doc_id and text are not read. Of pairs that
    meet again after the first links, those whose signatures agree in a share
    under ``floor`` are not compared; 0 compares all.
    """
    return _classed(docs, threshold, floor).select("doc_id", "class_id")


def keep(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class, the one with the least doc_id, and all its columns, whatever their names.

    Of several rows with that doc_id in a class one stays. Rows with a null doc_id stay.
    """
    found = common.written(_classed(docs, threshold), "classes").where("root is not null")
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("kept")).select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.t").alias("kept_t"))
    best = common.written(best, "kept")
    rest = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    rest = rest.withColumn("doc_id", F.col("own").getField("doc_id").cast("long")).withColumn("t", F.xxhash64(F.col("own").getField("text").cast("string")))
    named = rest.where("doc_id is not null").join(best, (F.col("doc_id") == F.col("kept_id")) & (F.col("t") == F.col("kept_t")), "left_semi")
    if not found.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        named = named.dropDuplicates(["doc_id", "t"])
    return named.union(rest.where("doc_id is null")).select(*[F.col("own").getField(c).alias(c) for c in docs.columns])


def op3_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: the class of near-duplicates that each belongs to."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
