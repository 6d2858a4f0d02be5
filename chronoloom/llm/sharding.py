"""Resharding by minimum-cost flow: move the fewest bytes from old shards to new ones.

A shard that must give up rows gives up its smallest ones. Spark counts rows by
shard and size class, then finds the exact size in whose midst each shard's
surplus ends; rows of a shard below, at and above that size form blocks. The flow
between blocks and new shards is solved on the blocks (three for each old shard,
whatever the input's size); Spark then gives each row its shard and slot by its
rank in its block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

OLD_SHARDS, NEW_SHARDS, ROW_BYTES = 32, 40, 16


class Flow:
    """Minimum-cost flow by the primal-dual method: shortest paths, then all paths of that cost."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def sent(self, edge: int) -> int:
        return self.room[edge ^ 1]

    def solve(self, source: int, sink: int) -> tuple[int, int]:
        """(flow, cost); costs of edges must not be negative."""
        n, total, spent = len(self.out), 0, 0
        height = [0] * n
        while True:
            far = [None] * n
            far[source], queue = 0, [(0, source)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    if self.room[e]:
                        b, x = self.to[e], d + self.cost[e] + height[a] - height[self.to[e]]
                        if far[b] is None or x < far[b]:
                            far[b] = x
                            heapq.heappush(queue, (x, b))
            if far[sink] is None:
                return total, spent
            for a in range(n):
                height[a] += far[sink] if far[a] is None else min(far[a], far[sink])
            at = [0] * n  # each node's next edge, so that a phase looks at an edge once
            while True:
                path, a, on = [], source, {source}
                while a != sink:
                    while at[a] < len(self.out[a]):
                        e = self.out[a][at[a]]
                        b = self.to[e]
                        if self.room[e] and b not in on and self.cost[e] + height[a] - height[b] == 0:
                            break
                        at[a] += 1
                    else:
                        if not path:
                            break
                        on.discard(a)
                        a = self.to[path.pop() ^ 1]
                        at[a] += 1
                        continue
                    path.append(e)
                    a = b
                    on.add(a)
                if not path:
                    break
                most = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= most
                    self.room[e ^ 1] += most
                    spent += most * self.cost[e]
                total += most


def plan(blocks: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Transfers (old shard, class, new shard, rows) that move the fewest bytes.

    ``blocks``: (old shard, class, rows, bytes). New shards get row counts at
    most one apart. A row that stays costs nothing; one that moves costs its
    block's mean bytes. Which shards get the odd rows is part of the solution.
    """
    rows = sum(b[2] for b in blocks)
    least, odd = divmod(rows, shards)
    source, sink, pool, extra = 0, 1, 2, 3
    first = 4
    flow = Flow(first + shards + len(blocks))
    into = [flow.edge(pool, first + s, rows) for s in range(shards)]
    if odd:
        flow.edge(extra, sink, odd)
    for s in range(shards):
        flow.edge(first + s, sink, least)
        if odd:
            flow.edge(first + s, extra, 1)
    stay, move = [], []
    for k, (shard, _, n, size) in enumerate(blocks):
        node = first + shards + k
        flow.edge(source, node, n)
        stay.append(flow.edge(node, first + shard, n) if shard < shards else None)
        move.append(flow.edge(node, pool, n, max(1, round(size / n))))
    flow.solve(source, sink)
    out, need = [], [[s, flow.sent(e)] for s, e in enumerate(into) if flow.sent(e)]
    for (shard, kind, _, _), a, b in zip(blocks, stay, move, strict=True):
        if a is not None and flow.sent(a):
            out.append((shard, kind, shard, flow.sent(a)))
        left = flow.sent(b)
        while left:
            some = min(left, need[-1][1])
            out.append((shard, kind, need[-1][0], some))
            need[-1][1] -= some
            left -= some
            if not need[-1][1]:
                need.pop()
    return out


def _limits(sized: DataFrame, shards: int) -> dict[int, int]:
    """For each old shard that may have to give up rows: the size of the largest row that leaves if one more leaves than must."""
    spark = sized.sparkSession
    # shards times about a hundred classes
    classes = sized.groupBy("old_shard", F.floor(F.log2("size") * 2).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n")).orderBy("old_shard", "class").collect()
    least, total = sum(r["n"] for r in classes) // shards, {}
    for r in classes:
        total[r["old_shard"]] = total.get(r["old_shard"], 0) + r["n"]
    left = {s: n - least - 1 for s, n in total.items() if 0 <= s < shards and n > least}
    wanted = []
    for r in classes:
        if (at := left.get(r["old_shard"], -1)) >= 0:
            if at < r["n"]:
                wanted.append((r["old_shard"], r["class"], at))
            left[r["old_shard"]] = at - r["n"]
    if not wanted:
        return {}
    some = sized.withColumn("class", F.floor(F.log2("size") * 2).cast("int")).join(F.broadcast(spark.createDataFrame(wanted, "old_shard int, class int, at long")), ["old_shard", "class"])
    sizes = some.groupBy("old_shard", "at", "size").agg(F.count(F.lit(1)).alias("n"))  # the sizes of one class of a shard
    sizes = sizes.withColumn("upto", F.sum("n").over(Window.partitionBy("old_shard").orderBy("size")))
    return {r["old_shard"]: r["size"] for r in sizes.where("upto > at").groupBy("old_shard").agg(F.min("size").alias("size")).collect()}  # a row a shard


def reshard(docs: DataFrame, shards: int = NEW_SHARDS, old: str = "old_shard") -> DataFrame:
    """Deal ``docs`` (doc_id, text, an old shard number) into ``shards`` shards of equal row counts.

    Returns doc_id, size, text_crc32, law, old_shard, shard, slot, grown_shard.
    A null text counts as empty (size 16); a null old shard counts as new rows
    that lie nowhere yet; equal doc_ids are dealt each; rows of equal size are
    alike, and a hash picks which of them leave; texts of any length only count
    by their size; no rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), common.crc32_of(text).alias("text_crc32"), F.coalesce(F.col(old), F.lit(-1)).cast("int").alias("old_shard"))
    sized = common.written(sized, "sizes")
    limits = spark.createDataFrame(sorted(_limits(sized, shards).items()), "old_shard int, limit long")  # a row a shard
    above = (F.col("size") > F.col("limit")).cast("int") + (F.col("size") >= F.col("limit")).cast("int")
    sized = sized.join(F.broadcast(limits), "old_shard", "left").withColumn("kind", F.coalesce(above, F.lit(0))).drop("limit")
    found = sized.groupBy("old_shard", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()  # three rows a shard
    blocks = [(r["old_shard"] if r["old_shard"] >= 0 else 1 << 30, r["kind"], r["n"], r["b"]) for r in found]
    counts = spark.createDataFrame([(r["old_shard"], r["kind"], r["n"]) for r in found], "old_shard int, kind int, n long")
    # by shard and class; a block's rows go to its targets by rank, a target's slots are filled block by block
    taken = dict.fromkeys(range(shards), 0)
    ranks: dict[tuple[int, int], int] = {}
    runs = []
    for shard, kind, target, n in sorted(plan(sorted(blocks), shards)):
        key = (-1 if shard == 1 << 30 else shard, kind)
        runs.append(((key[0] + 1) * 256 + kind, ranks.get(key, 0), target, taken[target]))
        ranks[key] = ranks.get(key, 0) + n
        taken[target] += n
    runs.sort()
    shift = 40
    keys, firsts, targets, slots = (np.array(x, np.int64) for x in ([r[0] << shift | r[1] for r in runs], [r[1] for r in runs], [r[2] for r in runs], [r[3] for r in runs]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rank, old_shard = b.column("rank").to_numpy(), b.column("old_shard").to_numpy().astype(np.int64)
            at = np.searchsorted(keys, ((old_shard + 1) * 256 + b.column("kind").to_numpy()) << shift | rank, "right") - 1
            n = b.num_rows
            cols = {"doc_id": b.column("doc_id"), "size": b.column("size"), "text_crc32": b.column("text_crc32"), "law": pa.array(["rows"] * n), "shard": pa.array(targets[at].astype(np.int32)), "slot": pa.array(slots[at] + rank - firsts[at]), "grown_shard": pa.nulls(n, pa.int32()), "old_shard": b.column("old_shard")}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    order = ["doc_id", "text_crc32", "size"]
    ranks = common.ranked(sized.join(F.broadcast(counts), ["old_shard", "kind"]), ["old_shard", "kind"], order, "n")
    return ranks.mapInArrow(place, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, old_shard int")


def rewrite(docs: DataFrame, moves: DataFrame, path: str, text_column: str = "text", old_column: str = "old_shard") -> DataFrame:
    """Write the files of the shards that a resharding changes, and no others, under ``path``.

    A shard is affected if a row leaves or enters it; its files are replaced, and
    those of a shard left without rows are deleted. Files lie in a folder
    ``new_shard=N`` each, hold the rows by ``new_slot``, and as many as a task can
    take; these two names replace columns of ``docs``, all others stay. Returns the
    affected shards (shard, rows). Rows are matched by doc_id, text and size, and
    rows that share all three by number, as either may take either's place; so
    repeated rows and null ids are written once each. Nothing is affected if every
    row stays.
    """
    spark = docs.sparkSession
    changed = moves.where(~F.col("old_shard").eqNullSafe(F.col("shard")))
    affected = changed.select(F.explode(F.array("old_shard", "shard")).alias("shard")).where("shard >= 0").distinct()
    counts = affected.join(moves.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")), "shard", "left").fillna(0, ["rows"])
    counts = common.written(counts, "affected")
    rest = docs.drop("new_shard", "new_slot")
    marks = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("doc_id").isNull(), common.crc32_of(F.col(text_column)), F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long") + ROW_BYTES)
    theirs = (marks[0], marks[1], F.col("text_crc32"), F.col("size"))

    def numbered(df: DataFrame, by: tuple, marked: str, old_column: str) -> DataFrame:
        named = df.select("*", *[c.alias(f"{marked}{i}") for i, c in enumerate(by)])
        number = F.row_number().over(Window.partitionBy(*[f"{marked}{i}" for i in range(len(by))]).orderBy(F.coalesce(F.col(old_column), F.lit(-1))))  # copies of one row, shard by shard: a running count
        return named.withColumn(f"{marked}{len(by)}", number)

    ours = numbered(rest, marks, "_m", old_column)
    into = numbered(moves.select("doc_id", "text_crc32", "size", "old_shard", F.col("shard").alias("new_shard"), F.col("slot").alias("new_slot")), theirs, "_t", "old_shard")
    into = into.join(F.broadcast(affected.withColumnRenamed("shard", "new_shard")), "new_shard")  # as many rows as shards
    same = F.lit(True)
    for i in range(len(marks) + 1):
        same = same & (ours[f"_m{i}"] == into[f"_t{i}"])
    placed = ours.join(into, same).select(*[ours[f"`{c}`"] for c in rest.columns], into["new_slot"], into["new_shard"])
    ordered = placed.repartitionByRange("new_shard", "new_slot").sortWithinPartitions("new_shard", "new_slot")  # a large shard is many tasks
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("new_shard").parquet(path)
    for r in counts.where("rows = 0").collect():  # a row a shard
        common.delete(spark, f"{path}/new_shard={r['shard']}")
    return counts


def op9_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, from 32 shards by a hash of doc_id to 40 shards with equal row counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reshard(docs.withColumn("old_shard", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(OLD_SHARDS)).cast("int")))
