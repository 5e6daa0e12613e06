"""The update cycle of inverted lists: heads, appends, splits, merges, moves, refinement, a log and workloads over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import lineage, maintenance
from nearfield.operators.clustering import Centers, assign
from nearfield.operators.kernels import collected_centers


def heads_by_thresholds(paths: DataFrame, select: int, split: int) -> DataFrame:
    """center_id: of each tree leaf with `select` rows or more, one row for each `split` rows begun, by seeded hash."""
    order = Window.partitionBy("path").orderBy(V.seeded(0, "vec_id"), "vec_id")
    sizes = paths.groupBy("path").agg(F.count("*").alias("size")).filter(F.col("size") >= select)
    ranked = paths.join(sizes, "path").withColumn("n", F.row_number().over(order))
    return ranked.filter(F.col("n") <= F.ceil(F.col("size") / split)).select(F.col("vec_id").alias("center_id"))


def dynamic_thresholds(paths: DataFrame, ratio: float, selects: range = range(2, 11), splits: range = range(2, 65)) -> tuple[int, int]:
    """The thresholds whose number of heads is nearest to ratio * rows, found on the histogram of leaf sizes."""
    sizes = paths.groupBy("path").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("leaves")).collect()
    rows = sum(r.size * r.leaves for r in sizes)
    heads = lambda a, b: sum(-(-r.size // b) * r.leaves for r in sizes if r.size >= a)
    return min(((abs(heads(a, b) - ratio * rows), a, b) for a in selects for b in splits))[1:]


def dynamic_heads(paths: DataFrame, ratio: float) -> DataFrame:
    return heads_by_thresholds(paths, *dynamic_thresholds(paths, ratio))


def appended(lists: DataFrame, new: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lists with the new records, ids of lists over the limit, new rows whose list is gone and that need another)."""
    known = lists.select("center_id").distinct()
    lost = new.join(known, "center_id", "left_anti").select("vec_id")
    every = lists.unionByName(new.join(known, "center_id", "left_semi"))
    return every, maintenance.oversize(every, limit), lost


def centers_of(lists: DataFrame, vectors: DataFrame) -> DataFrame:
    """center_id, center: the mean of each list's rows."""
    flat = lists.join(vectors.select("vec_id", "embedding"), "vec_id").select("center_id", F.posexplode("embedding").alias("pos", "x"))
    mean = flat.groupBy("center_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return mean.groupBy("center_id").agg(whole.alias("center"))


def maintained(lists: DataFrame, new: DataFrame, vectors: DataFrame, limit: int, threshold: int, rounds: int = 4) -> DataFrame:
    """vec_id, center_id after one cycle: append, move rows whose list is gone to the nearest centre, split what is too
    long, merge what is too short. Every row of lists and new keeps a list, and no list is longer than limit.

    `rounds` rounds split around two centres; what is too long after them is cut by a hash of the id until nothing is.
    If there is no list at all, the new rows open those that they name. Ids of new rows must not be in lists yet.
    """
    lists, new = lists.select("vec_id", "center_id"), new.select("vec_id", "center_id")
    if not new.join(lists, "vec_id", "left_semi").isEmpty():
        raise ValueError("new rows have ids that are in the lists already")
    every, _, lost = appended(lists, new, limit)
    if lists.isEmpty():
        every, lost = new, lost.limit(0)
    homeless = vectors.join(lost, "vec_id", "left_semi")
    every = every.unionByName(assign(homeless, collected_centers(centers_of(lists, vectors))).select("vec_id", "center_id"))
    every, done = lineage.cut(every.distinct()), 0
    while not maintenance.oversize(every, limit).isEmpty():
        top = every.agg(F.max("center_id")).first()[0]
        every = maintenance.split(every, vectors, limit, top + 1) if done < rounds else maintenance.split_by_id(every, limit, top + 1, done)
        every, done = lineage.cut(every), done + 1
    return maintenance.merge_small(every, centers_of(every, vectors), threshold, limit)


def broken_assumption(lists: DataFrame, vectors: DataFrame, centers: Centers) -> DataFrame:
    """center_id, n, broken: how many rows of each list are nearer to another centre."""
    best = assign(vectors, centers).select("vec_id", F.col("center_id").alias("nearest"))
    rows = lists.select("vec_id", "center_id").join(best, "vec_id")
    broken = F.sum(F.when(F.col("center_id") != F.col("nearest"), 1).otherwise(0)).alias("broken")
    return rows.groupBy("center_id").agg(F.count("*").alias("n"), broken)


def refined(vectors: DataFrame, lists: DataFrame, tombstones: DataFrame) -> DataFrame:
    """vec_id, center_id of the live rows under the ids that a compaction gives them."""
    mapping = maintenance.compaction(vectors, tombstones)
    return lists.join(mapping, lists.vec_id == mapping.old_id).select(F.col("new_id").alias("vec_id"), "center_id")


def needs_rebuild(added: int, limit: int = 1000) -> bool:
    """Trees are built again after so many rows were added."""
    return added >= limit


def replayed(base: DataFrame, log: DataFrame, checkpoint: int = -1) -> DataFrame:
    """base after the log's records (seq, op, vec_id, and the columns of base) beyond the checkpoint; the last of an id counts."""
    later = log.filter(F.col("seq") > checkpoint)
    last = later.groupBy("vec_id").agg(F.max("seq").alias("seq"))
    final = later.join(last, ["vec_id", "seq"])
    kept = base.join(last.select("vec_id"), "vec_id", "left_anti")
    return kept.unionByName(final.filter("op = 'insert'").select(*base.columns))


def key_values(log: DataFrame) -> DataFrame:
    """key, value of a log (seq, key, op, value) of put, merge (append), delete: a key's records since its last reset."""
    reset = log.filter("op IN ('put', 'delete')").groupBy("key").agg(F.max("seq").alias("reset"))
    live = log.join(reset, "key", "left").filter("op <> 'delete' AND (reset IS NULL OR seq >= reset)")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"])
    return live.groupBy("key").agg(F.array_join(parts, "|").alias("value"))


def stress_trace(current: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """op, vec_id: seeded deletes, and inserts of the same rows again."""
    gone = current.orderBy(V.seeded(seed, "vec_id"), "vec_id").limit(size).select("vec_id")
    return gone.select(F.lit("delete").alias("op"), "vec_id").unionByName(gone.select(F.lit("insert").alias("op"), "vec_id"))


def workload(rows: DataFrame, base: int, days: int, size: int, seed: int = 0) -> DataFrame:
    """day, op, vec_id: rows in seeded order; `base` of them are there on day 0, each day deletes the `size` oldest and
    inserts the next `size`, if there are so many.
    """
    numbered = maintenance.numbered_by(rows.select("vec_id", V.seeded(seed, "vec_id").alias("h")), "h")
    place = F.col("place")
    insert = numbered.filter((place >= base) & (place < base + days * size)).select((F.floor((place - base) / size) + 1).alias("day"), F.lit("insert").alias("op"), "vec_id")
    delete = numbered.filter(place < F.least(F.lit(days * size), F.lit(base))).select((F.floor(place / size) + 1).alias("day"), F.lit("delete").alias("op"), "vec_id")
    return insert.unionByName(delete)
