"""The two distance kernels: a query set against all rows, and all rows against a bounded set of centres.

Both run as Arrow batches through numpy products, in double precision. A first pass by |x|^2 + |q|^2 - 2 x.q finds
candidates with a slack for its rounding; candidates are scored again by plain sums, which decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries for one pass over the vectors, and how many are scored at a time.
QUERY_BLOCK, QUERY_STEP = 4096, 128
#: Centres that may be sent to all tasks, and their components altogether.
MOST_CENTERS, MOST_COMPONENTS = 1 << 17, 1 << 25


def matrix(column: pa.Array) -> np.ndarray:
    """An array column as rows of doubles; all rows have one length."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def distances(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """[query, row], quickly."""
    products = q @ x.T
    if metric != "l2":
        return 1.0 - products
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * products, 0.0)


def exact(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of the rows of x to one query by plain sums."""
    return ((x - q) ** 2).sum(1) if metric == "l2" else 1.0 - (x * q).sum(1)


def _nearest(metric: str, x: np.ndarray, ids: np.ndarray, q: np.ndarray, rough: np.ndarray, k: int):
    """(distances, places) of the k rows nearest to one query, ties to the smaller id."""
    if len(rough) > k:
        limit = np.partition(rough, k - 1)[k - 1]
        at = np.flatnonzero(rough <= limit + 1e-9 * (1.0 + abs(limit) + float(q @ q)))
    else:
        at = np.arange(len(rough))
    true = exact(metric, x[at], q)
    order = np.lexsort((ids[at], true))[:k]
    return true[order], at[order]


def knn(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    vector_id: str = "vec_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query: str = "query",
) -> DataFrame:
    """query_id, rnk (from 1), vec_id, dist: the k nearest rows of each query by (dist, vec_id).

    Queries go out in blocks of a fixed size; a task keeps k rows for each query of a block, and a ranked window
    merges the tasks. Vectors are read once for each block and never shuffled.
    """
    base = vectors.filter(F.col(vector).isNotNull()).select(F.col(vector_id).cast("long").alias("i"), F.col(vector).alias("v"))
    asked = queries.filter(F.col(query).isNotNull()).select(F.col(query_id).cast("long").alias("i"), F.col(query).alias("v"))
    blocks, block = [], []
    for row in asked.toLocalIterator():
        block.append((row.i, row.v))
        if len(block) == QUERY_BLOCK:
            blocks.append(_scan(base, block, k, metric))
            block = []
    if block or not blocks:
        blocks.append(_scan(base, block, k, metric))
    found = blocks[0]
    for other in blocks[1:]:
        found = found.unionAll(other)
    ranked = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return (
        found.withColumn("rnk", F.row_number().over(ranked))
        .filter(F.col("rnk") <= k)
        .select("query_id", F.col("rnk").cast("long").alias("rnk"), "vec_id", "dist")
    )


def _scan(base: DataFrame, block: list, k: int, metric: str) -> DataFrame:
    ids = np.array([i for i, _ in block], np.int64)
    rows = np.array([v for _, v in block], np.float64) if block else np.zeros((0, 0))
    shared = base.sparkSession.sparkContext.broadcast((ids, rows))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = shared.value
        best: list = [(np.empty(0), np.empty(0, np.int64))] * len(q)
        for batch in parts:
            x_ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            if not len(x) or not len(q):
                continue
            for at in range(0, len(q), QUERY_STEP):
                for j, rough in enumerate(distances(metric, x, q[at : at + QUERY_STEP]), at):
                    dist, place = _nearest(metric, x, x_ids, q[j], rough, k)
                    d, i = np.concatenate([best[j][0], dist]), np.concatenate([best[j][1], x_ids[place]])
                    order = np.lexsort((i, d))[:k]
                    best[j] = d[order], i[order]
        for at in range(0, len(q), 256):
            some = best[at : at + 256]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(query_ids[at : at + 256], [len(d) for d, _ in some])),
                    pa.array(np.concatenate([i for _, i in some])),
                    pa.array(np.concatenate([d for d, _ in some])),
                ],
                names=["query_id", "vec_id", "dist"],
            )

    return base.mapInArrow(run, "query_id long, vec_id long, dist double")


def collected_centers(centers: DataFrame, center_id: str = "center_id", center: str = "center") -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of a set of centres, whose size is checked before it reaches the driver."""
    size = centers.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(center)), F.lit(0)).alias("c")).first()
    if size.n > MOST_CENTERS or size.c > MOST_COMPONENTS:
        raise ValueError(f"{size.n} centres with {size.c} components; use knn() from the other side")
    rows = centers.select(F.col(center_id).cast("long").alias("i"), F.col(center).alias("c")).orderBy("i").collect()
    return np.array([r.i for r in rows], np.int64), np.array([r.c for r in rows], np.float64) if rows else np.zeros((0, 0))


def nearest_centers(
    vectors: DataFrame,
    centers: tuple[np.ndarray, np.ndarray],
    k: int = 1,
    metric: str = "l2",
    vector_id: str = "vec_id",
    vector: str = "embedding",
    penalty: np.ndarray | None = None,
) -> DataFrame:
    """vec_id, rnk, center_id, dist: the k nearest centres of each row by (dist + penalty, center_id). No shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast((*centers, penalty))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c, extra = shared.value
        for batch in parts:
            x_ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            if not len(x) or not len(c):
                continue
            columns: tuple[list, ...] = ([], [], [], [])
            for at in range(0, len(x), QUERY_STEP):
                for j, rough in enumerate(distances(metric, c, x[at : at + QUERY_STEP]), at):
                    if extra is None:
                        dist, place = _nearest(metric, c, ids, x[j], rough, k)
                    else:
                        true = exact(metric, c, x[j])
                        place = np.lexsort((ids, true + extra))[:k]
                        dist = true[place]
                    for column, value in zip(
                        columns, (np.full(len(place), x_ids[j]), np.arange(1, len(place) + 1), ids[place], dist), strict=True
                    ):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in columns], names=["vec_id", "rnk", "center_id", "dist"]
            )

    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(vector_id).cast("long"), vector)
    return rows.mapInArrow(run, "vec_id long, rnk long, center_id long, dist double")
