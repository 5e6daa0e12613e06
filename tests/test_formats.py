import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.sources import formats as X


def rows(spark):
    return spark.range(20).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.col("id") * k).cast("float")).alias("embedding"))


def same(a, b):
    pick = lambda df: sorted((r.vec_id, tuple(r.embedding)) for r in df.collect())
    return pick(a) == pick(b)


@pytest.mark.parametrize("dtype", ["float", "int8", "uint8", "int16"])
def test_binary_round_trips(spark, tmp_path, dtype):
    df = rows(spark)
    X.write_default(df, str(tmp_path / "d.bin"), dtype)
    X.write_xvec(df, str(tmp_path / "x.bin"), dtype)
    assert same(X.read_vectors(spark, str(tmp_path / "d.bin"), "default", dtype=dtype), df)
    assert same(X.read_xvec(spark, str(tmp_path / "x.bin"), dtype), df)
    assert X.read_default(spark, str(tmp_path / "d.bin"), dtype, 5, 9).count() == 4
    X.append_default(df, str(tmp_path / "d.bin"), dtype)
    assert X.read_default(spark, str(tmp_path / "d.bin"), dtype).count() == 40
    both = f"{tmp_path / 'x.bin'},{tmp_path / 'x.bin'}"
    assert X.read_xvec(spark, both, dtype).count() == 40


def test_text_metadata_truth_results_trace(spark, tmp_path):
    df = rows(spark).withColumn("meta", F.concat(F.lit("a\tb"), "vec_id"))
    X.write_text(df, str(tmp_path / "t"))
    back = X.read_text(spark, str(tmp_path / "t"))
    assert {(r.meta, tuple(r.embedding)) for r in back.collect()} == {(r.meta, tuple(r.embedding)) for r in df.collect()}
    X.write_metadata(df, str(tmp_path / "m"), str(tmp_path / "mi"))
    assert {r.vec_id: bytes(r.meta).decode() for r in X.read_metadata(spark, str(tmp_path / "m"), str(tmp_path / "mi")).collect()} == {r.vec_id: r.meta for r in df.collect()}
    hits = spark.createDataFrame([(0, 1, 7, 0.5), (0, 2, 3, 0.75), (1, 1, 2, 1.0)], "query_id long, rnk long, vec_id long, dist double")
    X.write_truth(hits, str(tmp_path / "tr"))
    assert {(r.query_id, r.rnk, r.vec_id) for r in X.read_truth(spark, str(tmp_path / "tr")).collect()} == {(0, 1, 7), (0, 2, 3), (1, 1, 2)}
    X.write_results(hits, str(tmp_path / "r"), 2, 2)
    assert {tuple(r) for r in X.read_results(spark, str(tmp_path / "r")).collect()} == {tuple(r) for r in hits.collect()}
    assert {r.line for r in X.result_lines(hits).collect()} == {"0.5@7|0.75@3", "1.0@2"}
    (tmp_path / "u").write_bytes(np.array([2, 1, 2, 8, 9], "<i4").tobytes())
    assert [(r.op, r.vec_id) for r in X.read_trace(spark, str(tmp_path / "u")).collect()] == [("delete", 1), ("delete", 2), ("insert", 8), ("insert", 9)]
    (tmp_path / "g").write_bytes(np.array([2, 2, 5, 6, 7, 8], "<i4").tobytes())
    assert X.read_truth(spark, str(tmp_path / "g"), "default").count() == 4
