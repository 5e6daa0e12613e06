"""Resharding by minimum-cost flow.

Rows lie in old shards. The new shards have capacities in rows, at most one apart; an old shard's number stays its
own. Rows of one old shard and one size class (a power of two) are a block. A flow of least cost moves rows from
blocks to shards: staying costs nothing, moving costs the block's mean bytes, so that the rows that must leave an
overfull shard are its smallest. Only block totals reach the driver; their number is bounded by old shards times 64.

Within a block all rows cost its mean, so the bytes moved are the fewest to within a factor of two for each row.

A row's number in its block, gapless over all tasks, tells into which part of the block's flow it falls, and with
that its new shard and its slot there. `rewrite` then writes only the shards that gain or lose a row.

Edge cases: null text has size `OVERHEAD` and checksum 0, a text of any length is one row; rows are told apart by their
place, so ids may repeat or be null; columns called shard or slot are replaced, all others pass through; an empty table
gives no row; rows with equal text start in one old shard and mostly stay together, but no group is kept whole
against the capacities.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import binary_text, free_name, lean, materialise, numbered, remove, without

OVERHEAD = 16
OLD_SHARDS = 32
SHARDS = 40


class Flow:
    """Minimum-cost flow by shortest augmenting paths with potentials."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = []  # to, room, cost; edge i ^ 1 goes back
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.edges))
            self.edges.append([y, r, c])
        return len(self.edges) - 2

    def used(self, edge: int) -> int:
        return self.edges[edge ^ 1][1]

    def run(self, source: int, sink: int) -> int:
        """Sends as much as fits, as cheaply as can be; returns the cost."""
        potential, total = [0] * len(self.out), 0
        while True:
            far, came = [float("inf")] * len(self.out), [-1] * len(self.out)
            far[source], queue = 0, [(0, source)]
            while queue:
                d, node = heapq.heappop(queue)
                if d > far[node]:
                    continue
                for i in self.out[node]:
                    to, room, cost = self.edges[i]
                    if room and (new := d + cost + potential[node] - potential[to]) < far[to]:
                        far[to], came[to] = new, i
                        heapq.heappush(queue, (new, to))
            if came[sink] < 0:
                return total
            potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far, strict=True)]
            path, node = [], sink
            while node != source:
                path.append(came[node])
                node = self.edges[came[node] ^ 1][0]
            amount = min(self.edges[i][1] for i in path)
            for i in path:
                self.edges[i][1] -= amount
                self.edges[i ^ 1][1] += amount
                total += amount * self.edges[i][2]


def transfers(blocks: dict[int, tuple[int, int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """block -> (shard, rows) in order, from block -> (old shard, rows, bytes); shard sizes differ by one row at most."""
    total = sum(rows for _, rows, _ in blocks.values())
    each, names = total // shards, sorted(blocks)
    hub, source, sink = len(names) + shards, len(names) + shards + 1, len(names) + shards + 2
    flow = Flow(sink + 1)
    # a full shard's one row more comes after all else: any such row costs more than every possible move
    last = 1 + sum(size for _, _, size in blocks.values())
    into = []
    for shard in range(shards):
        flow.edge(len(names) + shard, sink, each, 0)
        flow.edge(len(names) + shard, sink, 1, last)
        into.append(flow.edge(hub, len(names) + shard, total, 0))
    own, away = {}, {}
    for k, block in enumerate(names):
        shard, rows, size = blocks[block]
        flow.edge(source, k, rows, 0)
        if shard < shards:
            own[block] = flow.edge(k, len(names) + shard, rows, 0)
        away[block] = flow.edge(k, hub, rows, max(1, -(-size // rows)))
    flow.run(source, sink)
    open_ = [[shard, flow.used(e)] for shard, e in enumerate(into) if flow.used(e)]
    parts: dict[int, list[tuple[int, int]]] = {}
    for block in names:
        parts[block] = [(blocks[block][0], n)] if block in own and (n := flow.used(own[block])) else []
        left = flow.used(away[block])
        while left:
            take = min(left, open_[-1][1])
            parts[block].append((open_[-1][0], take))
            left -= take
            open_[-1][1] -= take
            if not open_[-1][1]:
                open_.pop()
    return parts


def measured(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """doc_id, size, checksum and hash of the text, the old shard (by the text's hash) and the block."""
    text = binary_text(text_column)
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    old = F.pmod(F.xxhash64(text), F.lit(OLD_SHARDS)).cast("int")
    return docs.select(
        F.col("doc_id").cast("long"),
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        old.alias("old_shard"),
    ).withColumn("block", F.col("old_shard") * 64 + F.floor(F.log2("size")).cast("int"))


def reshard(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows (with block, old_shard and size) with shard and slot appended."""
    rows = without(rows, "shard", "slot")
    task, counted, position = (free_name(rows, n) for n in ("task_id", "slot_in_task", "position"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{task} int, {counted} long"])
    names, where = [*rows.columns, task, counted], rows.columns.index("block")

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number_ = np.zeros(64 * (OLD_SHARDS + 1), np.int64), TaskContext.get().partitionId()
        for batch in parts:
            block = batch.column(where).to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            ordered = block[order]
            starts = np.searchsorted(ordered, ordered)
            slot = np.empty(len(block), np.int64)
            slot[order] = seen[ordered] + np.arange(len(block)) - starts
            seen += np.bincount(block, minlength=len(seen))
            task_id = pa.array(np.full(len(block), number_, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, task_id, pa.array(slot)], names=names)

    fixed = materialise(rows.mapInArrow(lean(number), schema))
    totals = fixed.groupBy("block").agg(
        F.first("old_shard").alias("old"), F.count("*").alias("n"), F.sum("size").alias("bytes")
    )
    parts = transfers({r.block: (r.old, r.n, r.bytes) for r in totals.collect()}, shards)
    table, filled = {}, [0] * shards
    for block, flows in parts.items():
        at, columns = 0, []
        for shard, n in flows:
            columns.append((at, shard, filled[shard] - at))
            filled[shard] += n
            at += n
        table[block] = tuple(np.array(c, np.int64) for c in zip(*columns, strict=True))
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            position_ = batch.column(position).to_numpy(zero_copy_only=False)
            shard, slot = np.empty(len(block), np.int32), np.empty(len(block), np.int64)
            for b in np.unique(block):
                at = np.flatnonzero(block == b)
                start, to, shift = shared.value[b]
                part = np.searchsorted(start, position_[at], side="right") - 1
                shard[at], slot[at] = to[part], position_[at] + shift[part]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in rows_names), pa.array(shard), pa.array(slot)],
                names=[*rows_names, "shard", "slot"],
            )

    rows_names = rows.columns
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "shard int, slot long"])
    placed = numbered(fixed, "block", counted, task, position)
    return placed.select(*(F.col(f"`{n}`") for n in rows_names), position).mapInArrow(lean(place), out)


def rewrite(docs: DataFrame, placed: DataFrame, path: str, text_column: str = "text") -> list[int]:
    """Writes the affected shards, those that gain or lose a row, under path as shard=N, each once also if it runs again;
    returns their numbers. placed comes from `reshard(measured(docs))`.

    Rows of one id and text are alike, so the k-th of them in docs takes the k-th place. A shard that loses all its rows
    loses its folder.
    """
    moved = placed.filter("shard <> old_shard")
    touched = moved.select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct()
    affected = sorted(r.s for r in touched.collect())
    docs = without(docs, "shard", "slot")
    h, k, i = (free_name(docs, n) for n in ("h", "k", "i"))
    alike = Window.partitionBy(i, h)
    mine = docs.withColumn(i, F.col("doc_id").cast("long")).withColumn(h, F.xxhash64(binary_text(text_column)))
    mine = mine.withColumn(k, F.row_number().over(alike.orderBy(F.lit(0))))
    rows = placed.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), "shard", "slot")
    rows = rows.withColumn(k, F.row_number().over(alike.orderBy("shard", "slot"))).filter(F.col("shard").isin(affected)).alias("p")
    same = mine[i].eqNullSafe(F.col(f"p.{i}")) & (mine[h] == F.col(f"p.{h}")) & (mine[k] == F.col(f"p.{k}"))
    joined = mine.join(rows, same).select(*(mine[c] for c in docs.columns), "p.shard", "p.slot")
    joined = joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    joined.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    left = {r.shard for r in placed.select("shard").distinct().collect()}
    for shard in set(affected) - left:
        remove(docs.sparkSession, f"{path}/shard={shard}")
    return affected
