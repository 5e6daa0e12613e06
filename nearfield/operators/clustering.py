"""Balanced k-means, head selection and the inverted-list access path built on its centres."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import vectors as V

from nearfield.operators import lineage
from nearfield.operators.kernels import collected_centers, matrix, nearest_centers

Centers = tuple[np.ndarray, np.ndarray]


def assign(vectors: DataFrame, centers: Centers, metric: str = "l2", counts: np.ndarray | None = None, weight: float = 0.0) -> DataFrame:
    """Each row's centre by dist + weight * count of the centre: vec_id, center_id, dist."""
    penalty = None if counts is None else weight * np.asarray(counts, np.float64)
    return nearest_centers(vectors, centers, 1, metric, penalty=penalty).select("vec_id", "center_id", "dist")


def means(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """center_id, n and the mean of each centre's rows. Tasks add up their own rows first; no row is shuffled twice."""
    rows = assigned.select("vec_id", "center_id").join(vectors.select("vec_id", "embedding"), "vec_id")

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in parts:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            for c in np.unique(ids).tolist():
                own = x[ids == c]
                sums[c] = sums.get(c, 0) + own.sum(0)
                counts[c] = counts.get(c, 0) + len(own)
        yield pa.RecordBatch.from_pydict(
            {
                "center_id": pa.array(list(sums), pa.int64()),
                "n": pa.array([counts[c] for c in sums], pa.int64()),
                "total": pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64())),
            }
        )

    partial = rows.select("center_id", "embedding").mapInArrow(add, "center_id long, n long, total array<double>")
    flat = partial.select("center_id", "n", F.posexplode("total").alias("pos", "x"))
    by_dim = flat.groupBy("center_id", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return (
        by_dim.groupBy("center_id")
        .agg(F.max("n").alias("n"), whole.alias("total"))
        .select("center_id", "n", F.transform("total", lambda x: x / F.col("n")).alias("center"))
    )


@dataclass
class KMeans:
    centers: Centers
    counts: np.ndarray
    movement: list[float]


def initial_centers(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows by the smallest seeded hash of their id: the same for any partitioning."""
    first = vectors.orderBy(V.seeded(seed, "vec_id"), "vec_id").limit(k)
    return first.select(F.col("vec_id").alias("center_id"), F.col("embedding").alias("center"))


def kmeans(
    vectors: DataFrame, k: int, metric: str = "l2", factor: float = 0.0, rounds: int = 20, seed: int = 0, snap: bool = True
) -> KMeans:
    """Balanced k-means: factor weighs how full a centre was in the round before. Ends when centres rest.

    With snap, each centre becomes its nearest real row. An empty centre takes the farthest row of the largest one.
    """
    ids, rows = collected_centers(initial_centers(vectors, k, seed))
    counts, weight, moves = np.zeros(len(ids)), 0.0, []
    for _ in range(rounds):
        assigned = assign(vectors, (ids, rows), metric, counts, weight).persist()
        found = {r.center_id: r for r in means(vectors, assigned).collect()}
        far = assigned.groupBy("center_id").agg(
            F.max_by("vec_id", F.struct("dist", "vec_id")).alias("far"), F.max("dist").alias("most"), F.avg("dist").alias("mean")
        )
        spread = {r.center_id: r for r in far.collect()}
        assigned.unpersist()
        new = rows.copy()
        for j, c in enumerate(ids.tolist()):
            if c in found:
                new[j] = found[c].center
                if metric != "l2":
                    new[j] /= max(np.linalg.norm(new[j]), V.TINY_NORM)
        counts = np.array([found[c].n if c in found else 0 for c in ids.tolist()], np.float64)
        if (counts == 0).any() and found:
            largest = int(ids[counts.argmax()])
            row = vectors.filter(F.col("vec_id") == spread[largest].far).select("embedding").first()
            new[int(np.flatnonzero(counts == 0)[0])] = row.embedding
        if found:
            largest = spread[int(ids[counts.argmax()])]
            weight = factor * max(0.0, (largest.most - largest.mean) / counts.max())
        moves.append(float(((new - rows) ** 2).sum()))
        rows = new
        if moves[-1] < 1e-3:
            break
    if snap:
        assigned = assign(vectors, (ids, rows), metric)
        medoid = assigned.groupBy("center_id").agg(F.min_by("vec_id", F.struct("dist", "vec_id")).alias("vec_id"))
        for r in medoid.join(vectors, "vec_id").select("center_id", "embedding").collect():
            rows[np.flatnonzero(ids == r.center_id)[0]] = r.embedding
    return KMeans((ids, rows), counts, moves)


def best_factor(vectors: DataFrame, k: int, factors: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)) -> float:
    """The factor that spreads rows most evenly over the centres."""
    return min(factors, key=lambda f: (float(np.std(kmeans(vectors, k, factor=f, rounds=5).counts)), f))


def random_heads(vectors: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """round(ratio * n) rows by seeded hash."""
    return initial_centers(vectors, max(1, round(ratio * vectors.count())), seed)


def hierarchical(vectors: DataFrame, branches: int = 8, leaf: int = 64, depth: int = 6) -> DataFrame:
    """vec_id and the path of a balanced k-means tree, one pass of splits for each level.

    A level's nodes above `leaf` rows are split together: their centres are the `branches` smallest hashes of each
    node, refined once, and every row goes to the nearest centre of its own node.
    """
    rows = vectors.select("vec_id", "embedding").withColumn("path", F.lit(""))
    for level in range(depth):
        sizes = rows.groupBy("path").count()
        open_ = sizes.filter(F.col("count") > leaf).select("path")
        if open_.isEmpty():
            break
        first = Window.partitionBy("path").orderBy(V.seeded(level, "vec_id"), "vec_id")
        seeds = (
            rows.join(open_, "path")
            .withColumn("b", F.row_number().over(first))
            .filter(F.col("b") <= branches)
            .groupBy("path")
            .agg(F.collect_list(F.struct("b", F.col("embedding").alias("c"))).alias("seeds"))
        )
        best = F.array_min(F.transform("seeds", lambda s: F.struct(V.l2(F.col("embedding"), s["c"]).alias("d"), s["b"].alias("b"))))
        step = F.when(F.col("seeds").isNull(), "").otherwise(F.concat(F.lit("/"), best["b"].cast("string")))
        # a node of equal rows does not split; its path stays and ends at the depth limit
        rows = rows.join(seeds, "path", "left").select("vec_id", "embedding", F.concat("path", step).alias("path"))
        rows = lineage.cut(rows)
    return rows.select("vec_id", "path")


def diversified(vectors: DataFrame, centers: Centers, replicas: int = 8, candidates: int = 64, factor: float = 1.0, strict: bool = False) -> DataFrame:
    """Posting assignment: of each row's nearest centres keep c unless a kept one is nearer to c than the row is.

    A centre is rejected if factor * d(kept, c) < d(row, c); with strict also if they are equal (the update path).
    Gives vec_id, center_id, dist, rnk (order of choice); at least the nearest centre stays. No shuffle.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = shared.value
        for batch in parts:
            x_ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            out: list[tuple] = []
            for row in range(len(x)):
                dist = ((c - x[row]) ** 2).sum(1)
                kept: list[int] = []
                for j in np.lexsort((ids, dist))[:candidates].tolist():
                    gaps = factor * ((c[kept] - c[j]) ** 2).sum(1)
                    if not ((gaps <= dist[j]) if strict else (gaps < dist[j])).any():
                        kept.append(j)
                        out.append((int(x_ids[row]), int(ids[j]), float(dist[j]), len(kept)))
                        if len(kept) == replicas:
                            break
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["vec_id", "center_id", "dist", "rnk"],
                )

    rows = vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), "embedding")
    return rows.mapInArrow(run, "vec_id long, center_id long, dist double, rnk long")


def cut(postings: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows of each list by (dist, vec_id); `kept` is false for what a capped list would lose."""
    order = Window.partitionBy("center_id").orderBy("dist", "vec_id")
    return postings.withColumn("place", F.row_number().over(order).cast("long")).withColumn("kept", F.col("place") <= limit)


def cut_reachable(postings: DataFrame, limit: int) -> DataFrame:
    """Like `cut`, but a row that would be in no list keeps its nearest one, so that every row can be found."""
    marked = cut(postings, limit)
    own = Window.partitionBy("vec_id")
    marked = marked.withColumn("alone", ~F.max("kept").over(own))
    marked = marked.withColumn("choice", F.row_number().over(own.orderBy("dist", "center_id")))
    return marked.filter("kept OR (alone AND choice = 1)").drop("place", "kept", "alone", "choice")


def replica_histogram(postings: DataFrame, vectors: DataFrame) -> DataFrame:
    """replicas, rows: how many lists hold a row; rows in none count as 0."""
    counts = postings.groupBy("vec_id").count()
    every = vectors.select("vec_id").join(counts, "vec_id", "left")
    return every.groupBy(F.coalesce("count", F.lit(0)).alias("replicas")).agg(F.count("*").alias("rows"))


def list_sizes(postings: DataFrame, width: int = 16) -> DataFrame:
    """size_from, lists: how many inverted lists have a length in each step of `width`."""
    sizes = postings.groupBy("center_id").count()
    return sizes.groupBy((F.floor(F.col("count") / width) * width).alias("size_from")).agg(F.count("*").alias("lists"))


def probe(queries: DataFrame, centers: Centers, nprobe: int, max_ratio: float | None = None) -> DataFrame:
    """query_id, center_id, prnk of the lists to read; lists beyond max_ratio times the nearest distance are left out."""
    found = nearest_centers(queries, centers, nprobe, vector_id="query_id", vector="query")
    found = found.select(F.col("vec_id").alias("query_id"), "center_id", F.col("rnk").alias("prnk"), "dist")
    if max_ratio is not None:
        nearest = F.min("dist").over(Window.partitionBy("query_id"))
        found = found.withColumn("bound", nearest * max_ratio).filter("bound <= 0.1 OR dist <= bound").drop("bound")
    return found.drop("dist")


def ivf_search(
    vectors: DataFrame, postings: DataFrame, queries: DataFrame, centers: Centers, k: int, nprobe: int, metric: str = "l2", max_ratio: float | None = None
) -> DataFrame:
    """query_id, rnk, vec_id, dist over the rows in the nprobe nearest lists of each query; a row counts once.

    The join on center_id is what partitioning or bucketing the postings table by it makes local.
    """
    lists = probe(queries, centers, nprobe, max_ratio)
    pairs = lists.join(postings.select("center_id", "vec_id"), "center_id").select("query_id", "vec_id").distinct()
    scored = pairs.join(queries, "query_id").join(vectors.select("vec_id", "embedding"), "vec_id")
    scored = scored.select("query_id", "vec_id", V.METRICS[metric](F.col("embedding"), F.col("query")).alias("dist"))
    order = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return (
        scored.withColumn("rnk", F.row_number().over(order).cast("long"))
        .filter(F.col("rnk") <= k)
        .select("query_id", "rnk", "vec_id", "dist")
    )


def ivf_sweep(vectors: DataFrame, postings: DataFrame, queries: DataFrame, centers: Centers, k: int, nprobes: tuple[int, ...], metric: str = "l2") -> DataFrame:
    """Results of `ivf_search` for several budgets (nprobe, query_id, rnk, vec_id, dist) from one pass: each row is scored once and
    belongs to every budget that reads its nearest list.
    """
    lists = probe(queries, centers, max(nprobes))
    first = lists.join(postings.select("center_id", "vec_id"), "center_id").groupBy("query_id", "vec_id").agg(F.min("prnk").alias("prnk"))
    scored = first.join(queries, "query_id").join(vectors.select("vec_id", "embedding"), "vec_id")
    scored = scored.select("query_id", "vec_id", "prnk", V.METRICS[metric](F.col("embedding"), F.col("query")).alias("dist"))
    each = scored.withColumn("nprobe", F.explode(F.array(*[F.lit(n) for n in nprobes]))).filter("prnk <= nprobe")
    order = Window.partitionBy("nprobe", "query_id").orderBy("dist", "vec_id")
    ranked = each.withColumn("rnk", F.row_number().over(order).cast("long")).filter(F.col("rnk") <= k)
    return ranked.select("nprobe", "query_id", "rnk", "vec_id", "dist")


def residuals(vectors: DataFrame, assigned: DataFrame, centers: DataFrame) -> DataFrame:
    """vec_id, center_id, residual: the row minus its centre."""
    joined = assigned.select("vec_id", "center_id").join(vectors.select("vec_id", "embedding"), "vec_id")
    return joined.join(centers, "center_id").select("vec_id", "center_id", V.minus("embedding", "center").alias("residual"))


def closure_assign(vectors: DataFrame, centers: Centers, factor: float, most: int) -> DataFrame:
    """Every centre within factor times the nearest distance, `most` at the most: vec_id, center_id, dist, rnk."""
    found = nearest_centers(vectors, centers, most)
    nearest = F.min("dist").over(Window.partitionBy("vec_id"))
    return found.withColumn("nearest", nearest).filter(F.col("dist") <= F.col("nearest") * factor).drop("nearest")


def capacity_assign(vectors: DataFrame, centers: Centers, limit: int) -> DataFrame:
    """Each row in one centre with at most `limit` rows: nearest rows first, the others try their next choice.

    Round r offers rows that have no place their r-th choice; a centre takes its nearest up to what is left.
    """
    if vectors.filter(F.col("embedding").isNotNull()).count() > limit * len(centers[0]):
        raise ValueError(f"{len(centers[0])} centres of {limit} rows are too few for these rows")
    choices = nearest_centers(vectors, centers, len(centers[0])).persist()
    placed = choices.limit(0).select("vec_id", "center_id", "dist")
    for r in range(1, len(centers[0]) + 1):
        asking = choices.filter(F.col("rnk") == r).join(placed.select("vec_id"), "vec_id", "left_anti")
        used = placed.groupBy("center_id").count()
        order = Window.partitionBy("center_id").orderBy("dist", "vec_id")
        taken = (
            asking.withColumn("n", F.row_number().over(order))
            .join(used, "center_id", "left")
            .filter(F.col("n") <= F.lit(limit) - F.coalesce("count", F.lit(0)))
            .select("vec_id", "center_id", "dist")
        )
        placed = lineage.cut(placed.unionByName(taken))
    choices.unpersist()
    return placed


def route(queries: DataFrame, shard_centers: Centers, top: int) -> DataFrame:
    """query_id, shard_id, rnk: the shards whose centre is nearest to each query."""
    found = nearest_centers(queries, shard_centers, top, vector_id="query_id", vector="query")
    return found.select(F.col("vec_id").alias("query_id"), F.col("center_id").alias("shard_id"), "rnk")


