"""Exact top-k search with M-trees: paged metric nodes, covering radii, parent distances, best-first.

The largest inner product becomes a nearest neighbour: with M the largest norm of a tree, a vector x gets one more
component sqrt(M^2 - |x|^2), a query gets 0, and |q' - x'|^2 = |q|^2 + M^2 - 2 q.x falls as the product grows.

Rows are dealt into trees of at most `TREE_ROWS` distinct vectors. Equal vectors of a tree are one entry with its
smallest ids: k + 1 of them decide any result, as ties go to the smaller id. A tree is bulk-loaded top down; each
page holds up to `PAGE` entries with their distance to the page's router, and each inner entry the radius that
covers all below it. The pages are rows of a table, one row for each tree.

A search keeps a queue of nodes by lower bound. Before a distance to an entry is computed, |d(q, router) - d(entry,
router)| minus the radius bounds it from below; entries that cannot reach the k-th best are skipped. Bounds carry
a small slack for rounding, and integer products decide, so results are exact; a product beyond 64 bits is an error. Queries come in blocks of a
bounded size that go to all trees; the trees' lists are merged by a ranked window that keeps k rows of each task.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, as query or candidate; a
query is compared with the vectors of its own dimension; a query's own id is no candidate, also where it repeats; equal
scores go to the smaller id; fewer candidates than k give fewer rows; an empty table gives none; only the two named
columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import materialise

PAGE = 64
TREE_ROWS = 16_384
#: Queries that one pass over the trees takes.
BLOCK_QUERIES = 4096
SLACK = 1e-6

TREE_SCHEMA = (
    "dim int, vectors binary, ids binary, id_ends binary, first_child binary, n_child binary, is_leaf binary, "
    "router binary, radius binary, to_parent binary, entry_order binary, entry_dist binary, lift double"
)


def scaled(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of the rows without null or non-finite components."""
    x = F.col(vector_column)
    good = F.coalesce(
        x.isNotNull()
        & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))),
        F.lit(False),
    )
    floor = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    return vectors.filter(good & (F.size(x) > 0)).select(F.col(id_column).cast("long").alias("vec_id"), floor.alias("v"))


class Tree:
    """Nodes as flat arrays. Node i holds children nodes or, if a leaf, entries entry_order[first : first + n]."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.first, self.count, self.leaf, self.router, self.radius, self.to_parent = [], [], [], [], [], []
        self.order = np.empty(len(points), np.int64)
        self.dist = np.empty(len(points))
        self._fill = 0
        self.root = self._build(np.arange(len(points)))

    def _distances(self, rows: np.ndarray, to: int) -> np.ndarray:
        gap = self.points[rows] - self.points[to]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _build(self, rows: np.ndarray) -> int:
        """Level by level, so that the children of a node are consecutive."""
        middle = self.points[rows].mean(0)
        router = int(rows[((self.points[rows] - middle) ** 2).sum(1).argmin()])
        self._node(router, 0.0)
        queue = [(0, rows)]
        for node, rows in queue:
            far = self._distances(rows, self.router[node])
            self.radius[node] = float(far.max())
            if len(rows) <= PAGE:
                near = far.argsort(kind="stable")
                self.first[node], self.count[node] = self._fill, len(rows)
                self.order[self._fill : self._fill + len(rows)] = rows[near]
                self.dist[self._fill : self._fill + len(rows)] = far[near]
                self._fill += len(rows)
                continue
            groups = self._split(rows)
            self.first[node], self.count[node], self.leaf[node] = len(self.first), len(groups), False
            for router, members in groups:
                gap = self.points[router] - self.points[self.router[node]]
                queue.append((self._node(router, float(np.sqrt(gap @ gap))), members))
        return 0

    def _node(self, router: int, to_parent: float) -> int:
        for values, value in (
            (self.first, 0), (self.count, 0), (self.leaf, True), (self.router, router), (self.radius, 0.0), (self.to_parent, to_parent)
        ):
            values.append(value)
        return len(self.first) - 1

    def _split(self, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Groups around far-apart routers, each row with its nearest; halves where that does not separate."""
        wanted = min(16, -(-len(rows) // PAGE) + 1)
        routers = [int(rows[0])]
        best = self._distances(rows, routers[0])
        owner = np.zeros(len(rows), np.int64)
        while len(routers) < wanted and best.max() > 0:
            new = int(rows[best.argmax()])
            gap = self._distances(rows, new)
            owner[gap < best] = len(routers)
            best = np.minimum(best, gap)
            routers.append(new)
        groups = [(r, rows[owner == k]) for k, r in enumerate(routers) if (owner == k).any()]
        if len(groups) < 2 or max(len(g) for _, g in groups) > 0.95 * len(rows):
            half = self._distances(rows, routers[-1]).argsort(kind="stable")
            cut = len(rows) // 2
            groups = [(int(rows[half[0]]), rows[half[:cut]]), (int(rows[half[cut]]), rows[half[cut:]])]
        return groups


def build_trees(vectors: DataFrame, keep_ids: int) -> DataFrame:
    """One row for each tree over (vec_id, v)."""

    def flush(ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        distinct, owner = np.unique(rows, axis=0, return_inverse=True)
        by = np.lexsort((ids, owner.ravel()))
        ids, owner = ids[by], owner.ravel()[by]
        starts = np.searchsorted(owner, np.arange(len(distinct)))
        keep = np.arange(len(ids)) - starts[owner] < keep_ids
        ids, owner = ids[keep], owner[keep]
        squares = (distinct.astype(np.float64) ** 2).sum(1)
        lift = float(squares.max())
        points = np.column_stack([distinct.astype(np.float64), np.sqrt(np.maximum(lift - squares, 0))])
        tree = Tree(points)
        put = lambda values, kind: pa.array([np.asarray(values, kind).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([distinct.shape[1]], pa.int32()),
                put(distinct, np.int64),
                put(ids, np.int64),
                put(np.searchsorted(owner, np.arange(len(distinct)), side="right"), np.int64),
                put(tree.first, np.int64),
                put(tree.count, np.int64),
                put(tree.leaf, np.bool_),
                put(tree.router, np.int64),
                put(tree.radius, np.float64),
                put(tree.to_parent, np.float64),
                put(tree.order, np.int64),
                put(tree.dist, np.float64),
                pa.array([lift]),
            ],
            names=[c.split()[0] for c in TREE_SCHEMA.split(", ")],
        )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, list] = {}
        rows: dict[int, list] = {}
        for batch in parts:
            lengths = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                some = batch.filter(pa.array(lengths == dim))
                ids.setdefault(dim, []).append(some.column(0).to_numpy(zero_copy_only=False))
                rows.setdefault(dim, []).append(some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                if sum(map(len, ids[dim])) >= TREE_ROWS:
                    yield flush(np.concatenate(ids.pop(dim)), np.concatenate(rows.pop(dim)))
        for dim in list(ids):
            yield flush(np.concatenate(ids[dim]), np.concatenate(rows[dim]))

    return vectors.mapInArrow(run, TREE_SCHEMA)


class Searcher:
    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        dim = row["dim"]
        self.vectors = read("vectors", np.int64).reshape(-1, dim)
        squares = (self.vectors.astype(np.float64) ** 2).sum(1)
        self.points = np.column_stack(
            [self.vectors.astype(np.float64), np.sqrt(np.maximum(row["lift"] - squares, 0))]
        )
        self.ids, self.id_ends = read("ids", np.int64), read("id_ends", np.int64)
        self.first, self.count = read("first_child", np.int64), read("n_child", np.int64)
        self.leaf, self.router = read("is_leaf", np.bool_), read("router", np.int64)
        self.radius, self.to_parent = read("radius", np.float64), read("to_parent", np.float64)
        self.order, self.dist = read("entry_order", np.int64), read("entry_dist", np.float64)
        self.lift, self.computed = row["lift"], 0
        self.largest = int(np.abs(self.vectors).max(initial=0))

    def _gap(self, rows: np.ndarray, query: np.ndarray, square: float) -> np.ndarray:
        self.computed += len(rows)
        return np.sqrt(np.maximum(square + self.lift - 2 * (self.points[rows, :-1] @ query), 0.0))

    def _products(self, rows: np.ndarray, query: np.ndarray) -> list[int]:
        """Exact inner products: in 64 bits where no sum can leave them, else in numbers of any length."""
        most = self.largest * int(np.abs(query).max(initial=0)) * len(query)
        kind = np.int64 if most < 1 << 63 else object
        return (self.vectors[rows].astype(kind) @ query.astype(kind)).tolist()

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best entries of this tree, without the query's own id, best first."""
        q = query.astype(np.float64)
        square = float(q @ q)
        slack = SLACK * (1 + math.sqrt(square + self.lift))
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        limit = math.inf  # no entry farther than this can enter
        at = self._gap(self.router[:1], q, square)
        queue = [(max(0.0, float(at[0]) - self.radius[0]), 0, float(at[0]))]
        while queue:
            bound, node, to_router = heapq.heappop(queue)
            if bound > limit + slack:
                break
            lo, hi = self.first[node], self.first[node] + self.count[node]
            if not self.leaf[node]:
                children = np.arange(lo, hi)
                near = np.abs(to_router - self.to_parent[lo:hi]) - self.radius[lo:hi]
                children = children[near <= limit + slack]
                if len(children):
                    gaps = self._gap(self.router[children], q, square)
                    bounds = np.maximum(gaps - self.radius[children], 0.0)
                    for b, c, g in zip(bounds.tolist(), children.tolist(), gaps.tolist(), strict=True):
                        if b <= limit + slack:
                            heapq.heappush(queue, (b, c, g))
                continue
            entries = self.order[lo:hi][np.abs(to_router - self.dist[lo:hi]) <= limit + slack]
            if not len(entries):
                continue
            self.computed += len(entries)
            for entry, score in zip(entries.tolist(), self._products(entries, query), strict=True):
                if len(best) == k and score < best[0][0]:
                    continue
                for vec_id in self.ids[(self.id_ends[entry - 1] if entry else 0) : self.id_ends[entry]].tolist():
                    if vec_id == query_id:
                        continue
                    item = (score, -vec_id)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    else:
                        break  # ids of an entry ascend
            if len(best) == k:
                limit = math.sqrt(max(square + self.lift - 2 * best[0][0], 0.0))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _search_block(trees: DataFrame, ids: list[int], queries: list[list[int]], k: int) -> DataFrame:
    shared = trees.sparkSession.sparkContext.broadcast((ids, queries))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in batch.to_pylist():
                tree, out = Searcher(row), []
                for query_id, query in zip(*shared.value, strict=True):
                    if len(query) == row["dim"]:
                        out += [(query_id, i, s) for s, i in tree.top(query_id, np.asarray(query, np.int64), k)]
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"]
                )

    return trees.mapInArrow(run, "query_id long, vec_id long, score long")


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 1024,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest products of every query over all other rows."""
    base = scaled(vectors, id_column, vector_column, scale)
    trees = materialise(build_trees(base, k + 1))
    asked = scaled(queries, id_column, vector_column, scale)
    found, ids, block = [], [], []
    for row in asked.toLocalIterator(prefetchPartitions=False):
        ids.append(row.vec_id)
        block.append(row.v)
        if len(ids) == BLOCK_QUERIES:
            found.append(_search_block(trees, ids, block, k))
            ids, block = [], []
    if ids or not found:
        found.append(_search_block(trees, ids, block, k))
    every = found[0]
    for other in found[1:]:
        every = every.unionAll(other)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
