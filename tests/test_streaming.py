import numpy as np

from nearfield.streaming import maintenance as T


def test_feed_keeps_the_newest_state(spark, tmp_path):
    feed, root = str(tmp_path / "feed"), str(tmp_path / "root")
    centers = (np.array([0, 1]), np.array([[0.0, 0.0], [10.0, 10.0]]))

    def send(rows):
        spark.createDataFrame(rows, T.FEED).coalesce(1).write.mode("append").parquet(feed)

    send([(1, "insert", 1, [0.0, 1.0]), (2, "insert", 2, [9.0, 9.0]), (3, "insert", 3, [1.0, 1.0]), (4, "insert", 4, [1.0, 1.0]), (5, "delete", 4, None)])
    T.start(T.feed(spark, feed), root, str(tmp_path / "ck"), centers).awaitTermination()
    send([(6, "delete", 2, None), (7, "delete", 3, None), (8, "insert", 3, [10.0, 9.0])])
    T.start(T.feed(spark, feed), root, str(tmp_path / "ck"), centers).awaitTermination()
    live = {(r.vec_id, r.center_id): r.embedding for r in T.current(spark, root).collect()}
    assert {v for v, _ in live} == {1, 3} and live[(3, 1)] == [10.0, 9.0]
    # a batch that runs again leaves the same rows
    T.apply_batch(spark.createDataFrame([(6, "delete", 2, None), (8, "insert", 3, [10.0, 9.0])], T.FEED), 1, root, centers)
    assert {r.vec_id for r in T.current(spark, root).collect()} == {1, 3}
