"""Updates, named indexes and further access paths on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.__main__ import main
from nearfield.catalogue import Catalogue, abortable
from nearfield.functions import compression
from nearfield.index import VectorIndex
from nearfield.operators import access as A
from nearfield.operators import clustering as C
from nearfield.operators import evaluation as E
from nearfield.operators import lifecycle as L
from nearfield.operators import maintenance as M
from nearfield.operators.kernels import knn
from nearfield.sources import formats


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(300)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").persist()


def test_merging_never_goes_over_the_limit(spark):
    rng = random.Random(1)
    sizes = {c: rng.randint(1, 9) for c in range(12)} | {c: rng.randint(11, 20) for c in range(12, 18)}
    lists = spark.createDataFrame([(100 * c + k, c) for c, n in sizes.items() for k in range(n)], "vec_id long, center_id long")
    centers = spark.createDataFrame([(c, [rng.random(), rng.random()]) for c in sizes], "center_id long, center array<double>")
    after = M.merge_small(lists, centers, 10, 25).groupBy("center_id").count().collect()
    assert sum(r["count"] for r in after) == sum(sizes.values()) and max(r["count"] for r in after) <= 25
    room = max(25 - r["count"] for r in after if r.center_id >= 12)
    assert all(r["count"] > room for r in after if r.center_id < 12)  # those that stayed fit nowhere
    assert M.merge_targets(lists.filter("center_id < 12"), centers, 10, 25).count() == 0


def test_too_little_capacity_is_an_error(vectors):
    with pytest.raises(ValueError, match="too few"):
        C.capacity_assign(vectors, (np.array([0, 1]), np.zeros((2, 4))), 100)


def test_queries_without_hits_have_no_recall(spark):
    truth = spark.createDataFrame([(1, 1, 5, 0.5), (2, 1, 6, 0.5)], "query_id long, rnk long, vec_id long, dist double")
    got = {r.query_id: r.recall for r in E.recall_by_distance(truth.filter("query_id = 1"), truth, 1).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_numbers_follow_the_order(spark):
    ids = [3 * k + (k % 5) * 70_000 for k in range(500)]
    got = M.numbered_by(spark.createDataFrame([(i,) for i in ids], "vec_id long").repartition(4), "vec_id").collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.place)] == sorted(ids) and {r.place for r in got} == set(range(500))


def test_all_leaves_are_exact_and_few_are_close(vectors):
    q = vectors.filter("vec_id % 60 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    truth = knn(vectors, q, 5)
    rows = lambda df: sorted((r.query_id, r.rnk, r.vec_id) for r in df.collect())
    assert rows(A.kd_search(vectors, q, 5, 3, 8)) == rows(truth)
    assert E.recall(A.kd_search(vectors, q, 5, 3, 4), truth, 5).agg(F.avg("recall")).first()[0] > 0.6
    with pytest.raises(ValueError):
        A.kd_search(vectors, q, 5, 20, 1)


def test_a_scan_ends_when_it_runs_out_of_patience(spark):
    rows = spark.createDataFrame([(k, [float(k)], [float(k)]) for k in range(50)], "vec_id long, a array<double>, b array<double>")
    q = spark.createDataFrame([(0, [0.0], [0.0])], "query_id long, qa array<double>, qb array<double>")
    scan = lambda **more: [r.vec_id for r in A.lock_step_scan(rows, q, {"a": "qa", "b": "qb"}, [1.0, 1.0], 3, 40, **more).orderBy("rnk").collect()]
    assert scan() == [0, 1, 2] == scan(patience=2)
    far = rows.withColumn("b", F.array(F.when(F.col("vec_id") == 20, -500.0).otherwise(F.col("vec_id") * 3.0)))
    assert A.lock_step_scan(far, q, {"a": "qa", "b": "qb"}, [1.0, 0.0], 1, 40, 1).first().vec_id == 0


def test_appends_name_full_and_missing_lists(spark):
    lists = spark.createDataFrame([(k, k % 2) for k in range(6)], "vec_id long, center_id long")
    new = spark.createDataFrame([(10, 0), (11, 0), (12, 7)], "vec_id long, center_id long")
    every, over, lost = L.appended(lists, new, 4)
    assert every.count() == 8 and [r.center_id for r in over.collect()] == [0] and [r.vec_id for r in lost.collect()] == [12]


def test_replay_takes_the_last_record(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "vec_id long, x string")
    log = spark.createDataFrame([(0, "delete", 2, None), (1, "insert", 3, "c"), (2, "delete", 3, None), (3, "delete", 1, None), (4, "insert", 1, "z")], "seq long, op string, vec_id long, x string")
    assert sorted(map(tuple, L.replayed(base, log, 0).collect())) == [(1, "z"), (2, "b")]


def test_catalogue_runs_query_strings(spark, vectors):
    named = Catalogue(spark, {n: VectorIndex.build(vectors.filter(f"vec_id % 2 = {k}"), metric="l2") for k, n in enumerate("ab")})
    got = named.execute("$resultnum:2 0|0|0|0", "$indexname:b $resultnum:3 1|1|1|1").collect()
    assert sorted((r.index_name, r.query_id) for r in got) == [("a", 0)] * 2 + [("b", 0)] * 2 + [("b", 1)] * 3
    with pytest.raises(KeyError, match="nothing"):
        named.execute("$indexname:nothing 1|1|1|1")
    assert named.execute().count() == 0
    with abortable(spark, "some") as stop:
        assert vectors.count() == 300 and callable(stop)


def test_commands(spark, vectors, tmp_path):
    at = lambda name: str(tmp_path / name)
    vectors.withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(at("v"))
    main(["build", at("v"), at("i"), "--heads", "8"], spark)
    main(["search", at("i"), at("o"), "--query", "$resultnum:4 0|0|0|0"], spark)
    assert spark.read.parquet(at("o")).count() == 4
    main(["quantize", at("v"), at("q"), "--subspaces", "2", "--codes", "8"], spark)
    assert spark.read.parquet(at("q")).filter("size(codes) = 2 AND size(reconstructed) = 4").count() == 300
    main(["trace", at("v"), at("v"), at("t"), "--size", "5"], spark)
    assert spark.read.parquet(at("t")).count() == 10


def test_npy_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "x.npy", x)
    got = formats.npy(spark, str(tmp_path / "x.npy")).orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3] and np.array_equal([r.embedding for r in got], x)


def test_compression_without_enough_to_train_on(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc")), (2, None), (3, bytearray(b""))], "k long, raw binary")
    dictionary = compression.trained(df, "raw", "k")
    back = compression.decompressed(compression.compressed(df, "raw", dictionary), "raw", dictionary)
    assert [None if r.raw is None else bytes(r.raw) for r in back.orderBy("k").collect()] == [b"abc", None, b""]
