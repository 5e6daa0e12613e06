"""Facts about the ramp: row i has ten components equal to i; queries are 2i."""

import pytest
from pyspark.sql import functions as F

from nearfield.functions import dsl
from nearfield.functions import vectors as V
from nearfield.index import VectorIndex
from nearfield.operators import clustering as C
from nearfield.operators import maintenance as M
from nearfield.operators import search as S
from nearfield.operators.kernels import knn


def ramp(spark, n, shift=0):
    x = F.col("id").cast("float")
    return spark.range(n).select((F.col("id") + shift).alias("vec_id"), F.array_repeat(x, 10).alias("embedding"), F.col("id").cast("string").alias("meta"))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.range(3).select(F.col("id").alias("query_id"), F.array_repeat((F.col("id") * 2).cast("float"), 10).alias("query"))


def found(hits, rows):
    out = {}
    for r in hits.join(rows.select("vec_id", "meta"), "vec_id").orderBy("query_id", "rnk").collect():
        out.setdefault(r.query_id, []).append(r.meta)
    return [sorted(out[q]) for q in sorted(out)]


def test_ramp_neighbours(spark, queries):
    rows = ramp(spark, 2000)
    assert found(knn(rows, queries, 3), rows) == [["0", "1", "2"], ["1", "2", "3"], ["3", "4", "5"]]


def test_ramp_added_twice_then_deleted_by_vector(spark, queries):
    rows = M.inserted(ramp(spark, 2000), ramp(spark, 2000, 2000))
    assert found(knn(rows, queries, 3), rows) == [["0", "0", "1"], ["1", "2", "2"], ["3", "4", "4"]]
    left = M.deleted_by_vector(rows, queries)
    assert left.count() == 4000 - 6
    assert found(knn(left, queries, 3), left) == [["1", "1", "3"], ["1", "1", "3"], ["3", "3", "5"]]
    assert M.deleted_by_vector(rows, queries, first_only=True).count() == 4000 - 3


def test_upsert_by_key_keeps_one_row_each(spark, queries):
    rows = M.upserted(ramp(spark, 2000), ramp(spark, 2000, 2000), "meta")
    assert rows.count() == 2000 and rows.agg(F.min("vec_id")).first()[0] == 2000
    assert found(knn(rows, queries, 3), rows) == [["0", "1", "2"], ["1", "2", "3"], ["3", "4", "5"]]


def test_filter_excludes(spark, queries):
    rows = ramp(spark, 2000)
    hits = found(S.filtered_knn(rows, queries, 3, F.col("meta") != "2"), rows)
    assert all("2" not in h for h in hits) and all(len(h) == 3 for h in hits)


def test_paging_in_order_and_monotone(spark):
    it = S.ResultIterator(ramp(spark, 6000), [0.0] * 10, max_check=5)
    first, second = it.next(5), it.next(9)
    assert [i for i, _ in first + second] == list(range(10)) and it.relaxed_mono
    pages = [r.vec_id for n in (1, 2) for r in S.page(ramp(spark, 100), spark.sql("SELECT 0L AS query_id, array_repeat(0f, 10) AS query"), 5, n).orderBy("rnk").collect()]
    assert pages == list(range(10))


def test_ties_go_to_the_smaller_id_and_short_results(spark):
    rows = spark.createDataFrame([(5, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (9, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<float>")
    assert [(r.rnk, r.vec_id) for r in knn(rows, q, 2).orderBy("rnk").collect()] == [(1, 3), (2, 4)]
    assert knn(rows, q, 10).count() == 3
    assert knn(rows.limit(0), q, 10).count() == 0 and knn(rows, q.limit(0), 10).count() == 0


def test_value_semantics(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "x array<float>, z array<float>")
    r = row.select(
        V.l2("x", "z").alias("l2"), V.cosine("x", "x").alias("cos"), V.cosine("x", "x", 127).alias("cos127"),
        V.normalized("x").alias("n"), V.normalized("z").alias("nz"),
    ).first()
    assert (r.l2, r.cos, r.cos127) == (25.0, -24.0, 127 * 127 - 25.0)
    assert r.n == [0.6, 0.8] and r.nz[0] == pytest.approx(2**-0.5)


def test_query_text():
    q = dsl.parse("$indexname:a,b $resultnum=5 $extractmetadata:true 1|2.5|-3")
    assert (q.indexes, q.k, q.with_metadata, q.vector) == (["a", "b"], 5, True, [1.0, 2.5, -3.0])
    assert dsl.parse("$datatype:int8 #AQID").vector == [1.0, 2.0, 3.0]
    assert dsl.parse(dsl.unparse(q)).vector == q.vector
    with pytest.raises(ValueError):
        dsl.parse("$resultnum:5")


def test_index_verbs(spark, queries, tmp_path):
    rows = ramp(spark, 300)
    index = VectorIndex.build(rows, metric="l2").build_lists(heads=12)
    exact = {(r.query_id, r.vec_id) for r in index.search(queries, 5).collect()}
    ivf = {(r.query_id, r.vec_id) for r in VectorIndex(index.vectors, index.parameters.with_(NProbe=6), postings=index.postings, centers=index.centers).search(queries, 5, mode="ivf").collect()}
    assert len(exact & ivf) / len(exact) >= 0.9
    gone = index.delete(rows.filter("vec_id = 0"))
    assert 0 not in {r.vec_id for r in gone.search(queries, 3).collect()}
    assert index.merge(gone).vectors.count() == 599 and index.merge(gone).vectors.select("vec_id").distinct().count() == 599
    index.save(str(tmp_path / "i"))
    again = VectorIndex.load(spark, str(tmp_path / "i"))
    assert {(r.query_id, r.vec_id) for r in again.search(queries, 5).collect()} == exact
    assert again.parameters == index.parameters


def test_every_row_stays_reachable_and_split_drops_none(spark):
    rows = ramp(spark, 200)
    centers = C.collected_centers(rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("center_id"), F.col("embedding").alias("center")))
    lists = C.diversified(rows, centers, replicas=3)
    assert C.cut_reachable(lists, 5).select("vec_id").distinct().count() == 200
    assigned = C.assign(rows, centers)
    halves = M.split(assigned, rows, 20, 1000)
    assert halves.count() == 200 and halves.select("center_id").distinct().count() > 4
    same = rows.withColumn("embedding", F.array_repeat(F.lit(1.0).cast("float"), 10))
    assert M.split(C.assign(same, centers), same, 20, 1000).count() == 200
    placed = C.capacity_assign(rows, centers, 60)
    assert placed.count() == 200 and placed.groupBy("center_id").count().agg(F.max("count")).first()[0] <= 60


def test_compaction_fills_holes(spark):
    rows = ramp(spark, 50)
    mapping = {r.old_id: r.new_id for r in M.compaction(rows, rows.filter("vec_id % 7 = 0")).collect()}
    assert sorted(mapping.values()) == list(range(len(mapping))) and all(o % 7 for o in mapping)
