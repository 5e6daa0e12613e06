"""The update cycle keeps every row and every limit."""

import numpy as np
import pytest

from nearfield.operators import lifecycle as L


def test_a_cycle_keeps_rows_and_limits(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(260, 4))
    x[100:200] = x[100]  # copies don't split by distance
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    lists = spark.createDataFrame([(k, k % 3) for k in range(200)], "vec_id long, center_id long")
    new = spark.createDataFrame([(k, k % 3 + 90) for k in range(200, 260)], "vec_id long, center_id long")  # all lists are gone
    done = L.maintained(lists, new, vectors, 20, 3, rounds=2).collect()
    sizes = np.unique([r.center_id for r in done], return_counts=True)[1]
    assert sorted(r.vec_id for r in done) == list(range(260)) and sizes.max() <= 20
    with pytest.raises(ValueError, match="already"):
        L.maintained(lists, lists.limit(1), vectors, 20, 3)


def test_a_cycle_without_lists_opens_those_that_are_named(spark):
    vectors = spark.createDataFrame([(k, [float(k)]) for k in range(30)], "vec_id long, embedding array<double>")
    new = spark.createDataFrame([(k, 7) for k in range(30)], "vec_id long, center_id long")
    done = L.maintained(new.limit(0), new, vectors, 20, 3).collect()
    assert sorted(r.vec_id for r in done) == list(range(30))
    assert np.unique([r.center_id for r in done], return_counts=True)[1].max() <= 20
