"""Inserts, deletes, upserts, merging and compaction of vector tables and of their inverted lists.

Tables are immutable; every change is a new DataFrame, and deletes are tombstones until a compaction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import lineage
from nearfield.operators.clustering import Centers, assign
from nearfield.operators.kernels import collected_centers, matrix, nearest_centers
from nearfield.operators.search import within

#: A table is compacted when more than this share of its rows is deleted.
COMPACT_SHARE = 0.4


def inserted(vectors: DataFrame, new: DataFrame) -> DataFrame:
    return vectors.unionByName(new, allowMissingColumns=True)


def deleted(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("vec_id").distinct(), "vec_id", "left_anti")


def missing(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids of a delete that no live row has."""
    return ids.select("vec_id").distinct().join(vectors.select("vec_id"), "vec_id", "left_anti")


def deleted_by_vector(vectors: DataFrame, targets: DataFrame, first_only: bool = False) -> DataFrame:
    """Without the rows that equal a target vector (distance under 1e-6); with first_only one row for each target."""
    hits = within(vectors, targets, V.SAME)
    if first_only:
        hits = hits.groupBy("query_id").agg(F.min_by("vec_id", F.struct("dist", "vec_id")).alias("vec_id"))
    return deleted(vectors, hits)


def upserted(vectors: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The newest row of each key: rows of `new` win, and among rows of one side the largest vec_id."""
    both = vectors.withColumn("age_", F.lit(0)).unionByName(new.withColumn("age_", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc("age_"), F.desc("vec_id"))
    return both.withColumn("n_", F.row_number().over(order)).filter("n_ = 1").drop("n_", "age_")


def merged(vectors: DataFrame, other: DataFrame) -> DataFrame:
    """Both tables; ids of `other` continue after the largest of the first. Equal rows stay."""
    base = vectors.agg(F.coalesce(F.max("vec_id") + 1, F.lit(0)).alias("base_"))
    shifted = other.crossJoin(F.broadcast(base)).withColumn("vec_id", F.col("vec_id") + F.col("base_")).drop("base_")
    return vectors.unionByName(shifted)


def needs_compaction(total: int, dead: int) -> bool:
    return total > 0 and dead / total > COMPACT_SHARE


#: Ids, or leading digits of a hash, that are numbered in one task.
BLOCK = 1 << 16


def numbered_by(rows: DataFrame, column: str) -> DataFrame:
    """rows with `place`, from 0 in the order of a column of distinct ids or hex hashes. Blocks of values are numbered
    apart and begin where the counts of those before end; only the counts are in one window.
    """
    text = dict(rows.dtypes)[column] == "string"
    block = F.substring(column, 1, 4) if text else F.floor(F.col(column) / BLOCK)
    marked = rows.withColumn("block_", block)
    counts = marked.groupBy("block_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("block_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    own = F.row_number().over(Window.partitionBy("block_").orderBy(column)) - 1
    return marked.withColumn("own_", own).join(starts, "block_").withColumn("place", F.col("start_") + F.col("own_")).drop("block_", "own_", "start_")


def compaction(vectors: DataFrame, tombstones: DataFrame) -> DataFrame:
    """old_id, new_id of the live rows: holes below the live count are filled from the tail, the last row first.

    Ids are positions from 0. Only tombstones and the rows of the tail move; both are numbered by blocks of ids.
    """
    dead = tombstones.select("vec_id").distinct()
    total = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max("vec_id"), F.lit(-1)).alias("m")).first()
    alive = deleted(vectors.select("vec_id"), dead)
    n = alive.count()
    holes = dead.filter(F.col("vec_id") < n)
    tail = alive.filter(F.col("vec_id") >= n)
    tail = tail.select(F.col("vec_id").alias("old_id"), (-F.col("vec_id")).alias("back"))
    fill = numbered_by(holes, "vec_id").join(numbered_by(tail, "back").drop("back"), "place")
    assert total.m < total.n, "compaction takes ids that are positions from 0"
    stay = alive.filter(F.col("vec_id") < n).select(F.col("vec_id").alias("old_id"), F.col("vec_id").alias("new_id"))
    return stay.unionByName(fill.select("old_id", F.col("vec_id").alias("new_id")))


def fresh(postings: DataFrame, versions: DataFrame) -> DataFrame:
    """Posting records of the current version of a live row. versions: vec_id, version, deleted."""
    now = versions.filter(~F.col("deleted")).select("vec_id", "version")
    return postings.join(now, ["vec_id", "version"], "left_semi")


def oversize(postings: DataFrame, limit: int) -> DataFrame:
    return postings.groupBy("center_id").count().filter(F.col("count") > limit).select("center_id")


def undersize(postings: DataFrame, threshold: int) -> DataFrame:
    return postings.groupBy("center_id").count().filter(F.col("count") <= threshold).select("center_id", "count")


def split(postings: DataFrame, vectors: DataFrame, limit: int, first_new_id: int, rounds: int = 4) -> DataFrame:
    """vec_id, center_id: lists above `limit` cut in two around two far members, the second half under a new id.

    All large lists split together, each around its own two centres, refined by means; no list is gathered in one
    task. Rows of a list whose members are all equal stay where they are: nothing is dropped.
    """
    large = oversize(postings, limit)
    rows = postings.join(large, "center_id").join(vectors.select("vec_id", "embedding"), "vec_id").select("center_id", "vec_id", "embedding")
    rows = rows.persist()  # every round reads them
    one = rows.groupBy("center_id").agg(F.min_by("embedding", "vec_id").alias("c1"))
    two = rows.join(one, "center_id").groupBy("center_id").agg(
        F.max_by("embedding", F.struct(V.l2("embedding", "c1"), -F.col("vec_id"))).alias("c2"), F.first("c1").alias("c1")
    )
    two = lineage.cut(two.select("center_id", F.col("c1").cast("array<double>").alias("c1"), F.col("c2").cast("array<double>").alias("c2")))
    for _ in range(rounds):
        two = lineage.cut(_sides(rows, two))
    number = numbered_by(large, "center_id").select("center_id", (F.col("place") + F.lit(first_new_id)).alias("new_"))
    right = V.l2("embedding", "c2") < V.l2("embedding", "c1")
    halves = rows.join(two, "center_id").join(number, "center_id").select("vec_id", F.when(right, F.col("new_")).otherwise(F.col("center_id")).cast("long").alias("center_id"))
    halves = lineage.cut(halves)
    rows.unpersist()
    return postings.join(large, "center_id", "left_anti").select("vec_id", "center_id").unionByName(halves)


def _sides(rows: DataFrame, two: DataFrame) -> DataFrame:
    """center_id, c1, c2: the means of the rows that are nearer to c1 and to c2; a centre without rows stays. Tasks add
    up their own rows first."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, bool], list] = {}
        for batch in parts:
            if not batch.num_rows:
                continue
            ids, x, c1, c2 = batch.column(0).to_numpy(zero_copy_only=False), *(matrix(c) for c in batch.columns[1:])
            right = ((x - c2) ** 2).sum(1) < ((x - c1) ** 2).sum(1)
            keys, at = np.unique(2 * ids + right, return_inverse=True)
            totals, counts = np.zeros((len(keys), x.shape[1])), np.bincount(at, minlength=len(keys))
            np.add.at(totals, at, x)
            for key, total, n in zip(keys.tolist(), totals, counts.tolist(), strict=True):
                own = sums.setdefault((key >> 1, bool(key & 1)), [0.0, 0])
                own[0], own[1] = own[0] + total, own[1] + n
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.float64()))
        columns = ([c for c, _ in sums], [r for _, r in sums], [n for _, n in sums.values()], [t.tolist() for t, _ in sums.values()])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["center_id", "right", "n", "total"])

    known = rows.filter(F.col("embedding").isNotNull()).join(two, "center_id").select("center_id", "embedding", "c1", "c2")
    partial = known.mapInArrow(add, "center_id long, right boolean, n long, total array<double>")
    flat = partial.select("center_id", "right", "n", F.posexplode("total").alias("pos", "x"))
    mean = flat.groupBy("center_id", "right", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    sides = mean.groupBy("center_id", "right").agg(whole.alias("c"))
    found = sides.groupBy("center_id").agg(F.max(F.when(~F.col("right"), F.col("c"))).alias("n1"), F.max(F.when(F.col("right"), F.col("c"))).alias("n2"))
    return two.join(found, "center_id").select("center_id", F.coalesce("n1", "c1").alias("c1"), F.coalesce("n2", "c2").alias("c2"))


def split_by_id(postings: DataFrame, limit: int, first_new_id: int, seed: int) -> DataFrame:
    """vec_id, center_id: lists above `limit` cut into pieces of about half of it by a seeded hash of the id, whatever
    their vectors are; the first piece keeps the list's id."""
    sizes = postings.groupBy("center_id").count().filter(F.col("count") > limit)
    pieces = sizes.select("center_id", F.ceil(2 * F.col("count") / limit).alias("pieces_"))
    most = pieces.agg(F.max("pieces_")).first()[0] or 1
    number = numbered_by(pieces, "center_id").select("center_id", "pieces_", (F.col("place") * most + first_new_id).alias("new_"))
    piece = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.col("pieces_"))
    cut = postings.join(number, "center_id").withColumn("piece_", piece)
    cut = cut.select("vec_id", F.when(F.col("piece_") > 0, F.col("new_") + F.col("piece_")).otherwise(F.col("center_id")).cast("long").alias("center_id"))
    return postings.join(number, "center_id", "left_anti").select("vec_id", "center_id").unionByName(cut)


#: Nearest longer lists that a short one may move into.
CHOICES = 64


def merge_targets(postings: DataFrame, centers: DataFrame, threshold: int, limit: int) -> DataFrame:
    """center_id, into: short lists and a list that is not short with which they stay under the limit.

    Rounds of offers: each short list without a place asks its nearest choice that still has room for it, and a target
    takes its nearest askers while they fit together; the others ask again. Ends when nobody can ask.
    """
    spark = postings.sparkSession
    sizes = postings.groupBy("center_id").count()
    short, large = sizes.filter(F.col("count") <= threshold), sizes.filter(F.col("count") > threshold)
    targets = collected_centers(large.join(centers, "center_id"))
    asking = short.join(centers, "center_id").select(F.col("center_id").alias("vec_id"), F.col("center").alias("embedding"))
    if not len(targets[0]):
        return spark.createDataFrame([], "center_id long, into long")
    near = nearest_centers(asking, targets, CHOICES).select(F.col("vec_id").alias("center_id"), F.col("center_id").alias("into"), "dist")
    offers = near.join(short.withColumnRenamed("count", "m"), "center_id")
    offers = offers.join(large.select(F.col("center_id").alias("into"), (F.lit(limit) - F.col("count")).alias("room")), "into")
    offers = lineage.cut(offers)
    placed = offers.limit(0).select("center_id", "into", "m")
    while True:
        used = placed.groupBy("into").agg(F.sum("m").alias("used"))
        fits = offers.join(placed.select("center_id"), "center_id", "left_anti").join(used, "into", "left")
        fits = fits.withColumn("free", F.col("room") - F.coalesce("used", F.lit(0))).filter("m <= free")
        best = fits.groupBy("center_id").agg(F.min_by(F.struct("into", "dist", "m", "free"), F.struct("dist", "into")).alias("o"))
        best = best.select("center_id", "o.into", "o.dist", "o.m", "o.free")
        upto = Window.partitionBy("into").orderBy("dist", "center_id").rowsBetween(Window.unboundedPreceding, 0)
        taken = best.withColumn("sum_", F.sum("m").over(upto)).filter("sum_ <= free").select("center_id", "into", "m")
        taken = lineage.cut(taken)
        if taken.isEmpty():
            return placed.select("center_id", "into")
        placed = placed.unionByName(taken)


def merge_small(postings: DataFrame, centers: DataFrame, threshold: int, limit: int) -> DataFrame:
    """vec_id, center_id after the short lists have moved into their targets."""
    target = merge_targets(postings, centers, threshold, limit)
    moved = postings.join(target, "center_id", "left")
    return moved.select("vec_id", F.coalesce("into", "center_id").alias("center_id")).distinct()


def reassign_check(postings: DataFrame, vectors: DataFrame, centers: Centers) -> DataFrame:
    """vec_id, center_id, nearest of rows whose list is not that of their nearest centre."""
    best = assign(vectors, centers).select("vec_id", F.col("center_id").alias("nearest"))
    return postings.select("vec_id", "center_id").join(best, "vec_id").filter(F.col("center_id") != F.col("nearest"))


def reassigned(postings: DataFrame, vectors: DataFrame, centers: Centers) -> DataFrame:
    """New posting records of rows that moved, one version later; readers keep the newest version."""
    wrong = reassign_check(postings, vectors, centers)
    return wrong.join(postings, ["vec_id", "center_id"]).select("vec_id", F.col("nearest").alias("center_id"), (F.col("version") + 1).alias("version"))


def trace(current: DataFrame, reserve: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """op, vec_id of one batch: `size` seeded deletes from the current rows and as many inserts from the reserve."""
    def pick(df: DataFrame, op: str) -> DataFrame:
        return df.orderBy(V.seeded(f"{seed}:{op}", "vec_id"), "vec_id").limit(size).select(F.lit(op).alias("op"), "vec_id")

    return pick(current, "delete").unionByName(pick(reserve, "insert"))


def remapped(truth: DataFrame, mapping: DataFrame) -> DataFrame:
    """Truth rows with local ids replaced by global ones (local_id, global_id)."""
    return truth.join(mapping.withColumnRenamed("local_id", "vec_id"), "vec_id").drop("vec_id").withColumnRenamed("global_id", "vec_id")


