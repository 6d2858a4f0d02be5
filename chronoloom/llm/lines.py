"""Line deduplication by pairwise alignment.

Documents that share lines are paired, each pair is aligned by patience diff,
and blocks of lines that both hold in the same order are deleted from the later
document (the one with the larger doc_id). Runs of lines just long enough to be
deleted find the pairs. These are stars at first: a shared run pairs each later
holder with its first holder, so a run held by n documents makes n - 1 pairs. A
document with a run that such pairs leave meets the run's other earlier holders,
one of each outline: documents whose shared lines follow each other alike delete
the same lines, so the result is that of all pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pairs of one earlier document that are aligned in one place.
SLICE = 128
SPANS = "spans array<struct<start:int,end:int,other:long>>"
#: Runs of lines of fewer characters neither pair documents nor are deleted on their own.
MIN_CHARS = 20
#: A round may try so large a share of the pairs tried so far, as rounds cost the same jobs however few runs are left.
ROUND = 0.25
#: Lines held more often make the coarse outlines, which only order what is tried.
COMMON = 64


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first number, whose second numbers rise (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        back[k] = last[at - 1] if at else -1
        if at == len(tops):
            tops.append(y)
            last.append(k)
        else:
            tops[at], last[at] = y, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b) of equal items, rising in both.

    Equal heads and tails are aligned, then the items found once in either, by
    the longest rising run, then what lies between those, alike. Where nothing is
    found once, the k-th occurrence of an item stands for itself.
    """
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, i2, j, j2 = stack.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        in_a, in_b = Counter(a[i:i2]), Counter(b[j:j2])
        once = {x: k for k, x in enumerate(b[j:j2], j) if in_b[x] == 1 and in_a.get(x) == 1}
        pairs = [(k, once[x]) for k, x in enumerate(a[i:i2], i) if x in once]
        if not pairs:
            seen: Counter = Counter()
            places = {}
            for k in range(j, j2):
                places[b[k], seen[b[k]]] = k
                seen[b[k]] += 1
            seen.clear()
            for k in range(i, i2):
                if (key := (a[k], seen[a[k]])) in places:
                    pairs.append((k, places[key]))
                seen[a[k]] += 1
            out.extend(rising(pairs))  # anchors of the last resort are not refined further
            continue
        anchors = rising(pairs)
        out.extend(anchors)
        for (p, q), (p2, q2) in zip([(i - 1, j - 1), *anchors], [*anchors, (i2, j2)], strict=True):
            if p + 1 < p2 and q + 1 < q2:
                stack.append((p + 1, p2, q + 1, q2))
    return sorted(out)


def blocks(a: list[int], b: list[int], sizes: list[int], least: int = MIN_CHARS) -> list[tuple[int, int]]:
    """(first, end) of the lines of b in aligned common blocks of at least ``least`` characters."""
    out: list[list[int]] = []
    previous = (-2, -2)
    for x, y in patience(a, b):
        if out and (x, y) == (previous[0] + 1, previous[1] + 1):
            out[-1][1] = y + 1
        else:
            out.append([y, y + 1])
        previous = (x, y)
    return [(s, e) for s, e in out if sum(sizes[s:e]) >= least]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def runs(hashes: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, end, key) of the shortest runs of lines of at least ``least`` characters from each line on and up to each line.

    Documents are cut at ``offsets``. Each line of a block of at least ``least``
    characters is in such a run within the block.
    """
    n = len(hashes)
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(n)
    end = np.maximum(np.searchsorted(total, total[:-1] + least, "left"), at + 1)
    first = np.minimum(np.searchsorted(total, total[1:] - least, "right") - 1, at)
    on, upto = end <= offsets[1:][doc], first >= offsets[:-1][doc]
    doc = np.concatenate((doc[on], doc[upto]))
    first, end = np.concatenate((at[on], first[upto])), np.concatenate((end[on], at[upto] + 1))
    power, back = common.Powers.up_to(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(common.mixed(hashes.view(np.uint64) + common.GOLD) * power[:n])))
    return doc, first, end, common.mixed((sums[end] - sums[first]) * back[first]).view(np.int64)


def _seeds(least: int):
    """Each document's keys of runs; where it has ``spans``, of those that the spans do not cover entirely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            hashes, sizes = (batch.column(c).flatten().to_numpy() for c in ("hashes", "sizes"))
            doc, first, end, key = runs(hashes, sizes, offsets, least)
            if "spans" in batch.schema.names:
                spans = batch.column("spans")
                owner = np.repeat(offsets[:-1], pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
                flat, change = spans.flatten(), np.zeros(len(hashes) + 1, np.int64)
                np.add.at(change, owner + flat.field("start").to_numpy(), 1)
                np.add.at(change, owner + flat.field("end").to_numpy(), -1)
                bare = np.concatenate(([0], np.cumsum(np.cumsum(change[:-1]) == 0)))
                some = bare[end] > bare[first]
                doc, key = doc[some], key[some]
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            once = np.ones(len(doc), bool)
            once[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
            doc = pa.array(doc[once])
            yield pa.RecordBatch.from_arrays([batch.column("row").take(doc), batch.column("doc_id").take(doc), pa.array(key[once])], names=["row", "doc_id", "key"])

    return run


def _align(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans = [], []
            for r in range(0, batch.num_rows, 256):  # lists of a few rows at a time
                part = batch.slice(r, 256).to_pydict()
                for row, other, a, b, sizes in zip(*(part[c] for c in ("row", "other", "a", "b", "sizes")), strict=True):
                    if found := blocks(a, b, sizes, least):
                        rows.append(row)
                        spans.append([{"start": s, "end": e, "other": other} for s, e in found])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("other", pa.int64())])))], names=["row", "spans"])

    return run


def gathered(spans: DataFrame) -> DataFrame:
    """One row a document of all its spans."""
    return spans.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def aligned(pairs: DataFrame, one: DataFrame, least: int) -> DataFrame:
    """row, spans: what each of the ``pairs`` (first, row), a written table, deletes, if anything."""
    later = one.select("row", F.col("hashes").alias("b"), "sizes")
    if pairs.count() <= SLICE:
        earlier = one.select(F.col("row").alias("first"), F.col("doc_id").alias("other"), F.col("hashes").alias("a"))
        return pairs.join(later, "row").join(earlier, "first").select("row", "other", "a", "b", "sizes").mapInArrow(_align(least), f"row long, {SPANS}")
    # an earlier document of many pairs is repeated for each SLICE of them
    busy = pairs.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("g")).where("g > 1")
    busy = common.written(busy, "busy")
    dealt = pairs.join(busy, "first", "left").select("first", "row", F.pmod(F.xxhash64("row"), F.coalesce("g", F.lit(1))).cast("int").alias("part"))
    earlier = one.select(F.col("row").alias("first"), F.col("doc_id").alias("other"), F.col("hashes").alias("a")).join(busy, "first", "left")
    earlier = earlier.select("first", "other", "a", F.explode(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1)).alias("part"))
    return dealt.join(later, "row").join(earlier, ["first", "part"]).select("row", "other", "a", "b", "sizes").mapInArrow(_align(least), f"row long, {SPANS}")


def outlines(some: DataFrame, one: DataFrame) -> DataFrame:
    """row, full, coarse of the rows in ``some``: digests of the order of their shared lines.

    ``full`` covers each line that another of the rows holds, and where other lines
    stand between, before or behind them. What a row's alignment with a document of
    ``some`` deletes depends on nothing else. ``coarse`` covers the order of common lines.
    """
    held = one.join(some.select("row").distinct(), "row").select("row", F.size("hashes").alias("size"), F.posexplode("hashes").alias("at", "hash"))
    held = common.written(held, "held")
    counts = held.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("low"), F.max("row").alias("high"))
    shared = common.written(counts.where("low < high").select("hash", (F.col("n") > COMMON).alias("common")), "shared")
    lists = held.join(shared, "hash").groupBy("row").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("at", "hash", "common"))).alias("s"))
    gap = lambda x, i: x["at"] - F.coalesce(F.get("s", i - 1)["at"], F.lit(-1)) > 1
    full = F.transform("s", lambda x, i: F.concat(F.when(gap(x, i), "+").otherwise(","), x["hash"].cast("string")))
    behind = F.when(F.element_at("s", -1)["at"] < F.col("size") - 1, "+").otherwise(",")
    coarse = F.transform(F.filter("s", lambda x: x["common"]), lambda x: x["hash"].cast("string"))
    return lists.select("row", F.md5(F.concat(F.concat_ws("", full), behind)).alias("full"), F.md5(F.concat_ws(",", coarse)).alias("coarse"))


def removals(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """doc_id, digest, spans: the lines (first, end, other) to delete of each document that loses any; other: the earlier document.

    A document is a doc_id and a text (``digest``: the text's hash). First each run
    of lines pairs its later holders with its first. Where a line of a run is left,
    because it stands in a crossing place of that pair, its document meets other
    earlier holders, the first of each outline (see ``outlines``), four times as
    many each round (more where few runs are left), until the line is covered or none is left. The first of each
    coarse outline come first, as a document mostly has the outline of an earlier one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null and text <> ''")
    # per document: hashes and lengths of its lines
    hashed = rows.select("doc_id", F.xxhash64("text").alias("digest"), F.transform(_lines(F.col("text")), lambda x: F.xxhash64(x)).alias("hashes"), F.transform(_lines(F.col("text")), lambda x: F.length(x)).alias("sizes"))
    one = common.written(hashed.dropDuplicates(["doc_id", "digest"]).withColumn("row", F.monotonically_increasing_id()), "lines")
    seeds = common.written(one.mapInArrow(_seeds(least), "row long, doc_id long, key long"), "seeds")
    holders = seeds.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.min_by("row", "doc_id").alias("first")).where("n > 1")
    holders = common.written(holders, "holders")  # so that Spark can split a line that many documents hold
    pairs = common.written(seeds.join(holders, "key").where("least < doc_id").select("first", "row").distinct(), "pairs")
    spans = common.written(gathered(aligned(pairs, one, least)), "spans")

    def left(met: DataFrame, among: DataFrame) -> DataFrame:
        """The runs in ``among`` of the later documents of ``met`` that ``spans`` do not cover."""
        some = met.select("row").distinct()
        bare = one.join(some, "row").join(spans.join(some, "row"), "row", "left").mapInArrow(_seeds(least), "row long, doc_id long, key long")
        return common.written(bare.join(among, [c for c in among.columns if c not in ("n", "doc_id")]).select("row", bare["doc_id"], "key", "n"), "bare")

    bare = left(pairs, holders.where("n > 2").select("key", "n"))
    if not bare.isEmpty():
        having = common.written(seeds.join(bare.select("key"), "key", "left_semi"), "having")
        marks = common.written(outlines(having, one), "outlines")
        firsts = having.join(marks, "row").groupBy("key", "coarse", "full").agg(F.min(F.struct("doc_id", F.col("row").alias("first"))).alias("m"))
        firsts = common.written(firsts.select("key", "coarse", "m"), "firsts")
        leads = firsts.groupBy("key", "coarse").agg(F.min("m").alias("lead"))
        sizes = common.written(firsts.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "sizes")
        ordered = firsts.join(leads, ["key", "coarse"]).join(sizes, "key").select("key", "size", (F.col("m") != F.col("lead")).alias("later"), "m.doc_id", "m.first")
        ranks = common.ranked(ordered, ["key"], ["later", "doc_id", "first"], "size")
        ranks = common.written(ranks.select("key", "first", F.col("doc_id").alias("least"), "rank"), "ranks")
        bare = common.written(bare.drop("n").join(sizes.withColumnRenamed("size", "n"), "key"), "bare")
        tried, low, high = pairs, 0, 1
        while (n := bare.count()) > 0:
            high = max(high, low + int(ROUND * tried.count()) // n)
            others = ranks.where((F.col("rank") >= low) & (F.col("rank") < high))
            more = bare.join(others, "key").where("least < doc_id").select("first", "row").distinct().join(tried, ["first", "row"], "left_anti")
            more = common.written(more, "pairs")
            some = not more.isEmpty()
            if some:
                spans = common.written(gathered(spans.union(aligned(more, one, least))), "spans")
            low, high = high, 4 * high
            rest = bare.where(F.col("n") > low)
            if not some or rest.isEmpty():
                bare = rest
                continue
            tried = common.written(tried.union(more), "tried")  # one table again, so that plans do not grow by rounds
            bare = left(rest, rest)
    return spans.join(one.select("row", "doc_id", "digest"), "row").select("doc_id", "digest", "spans")


def cleaned(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """own (a struct of the columns of ``docs``, whatever their names), text, n_lines, n_removed, spans; see ``dedup``."""
    spans = removals(docs, least).select(F.col("doc_id").alias("other_id"), F.col("digest").alias("other_digest"), "spans")
    rest = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.lit(0).alias("text")).alias("own"), F.col("text").cast("string").alias("text"))
    rest = rest.withColumn("doc_id", F.col("own").getField("doc_id").cast("long")).withColumn("digest", F.xxhash64("text"))
    out = rest.join(spans, (rest["doc_id"] == spans["other_id"]) & (rest["digest"] == spans["other_digest"]), "left").select("own", "text", "spans")
    kept = F.filter(_lines(F.col("text")), lambda x, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    out = out.withColumn("n_lines", F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(_lines(F.col("text")))))
    out = out.withColumn("kept", F.when(F.col("spans").isNotNull(), kept))
    out = out.withColumn("n_removed", F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")))
    return out.withColumn("text", F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.concat_ws("\n", "kept"))).drop("kept")


def _own(names: list[str]) -> list[Column]:
    return [F.col("text") if c == "text" else F.col("own").getField(c).alias(c) for c in names]


def dedup(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """``docs`` with aligned common blocks deleted from later documents.

    Keeps all rows and columns, whatever their names, but these: ``text`` is what
    is left; ``n_lines`` and ``n_removed`` count lines and ``spans`` lists (start,
    end, other) of the deleted lines, and stand for any column of ``docs`` with
    such a name. Null and empty texts have no lines to lose, and no rows give no
    rows. Texts of any length are aligned whole, in memory that grows with their
    number of lines. A document is a doc_id and a text: rows with one doc_id are
    not later than each other, each loses its own lines, and equal rows lose the
    same. Rows with a null doc_id stay as they are. Equal lines are those with
    equal 64-bit hashes.
    """
    own = ("n_lines", "n_removed", "spans")
    return cleaned(docs, least).select(*_own([c for c in docs.columns if c not in own]), *own)


def texts(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the text that ``dedup`` leaves, and all their other columns as they are."""
    return cleaned(docs, least).select(*_own(docs.columns))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: what is left of each text, and how many lines were deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "text", "n_lines", "n_removed", "spans")
