"""A change feed kept up by Structured Streaming: each micro-batch becomes one version of the index's tables.

A version is a folder of Parquet files, `postings/batch=N` with the inserts of batch N and `tombstones/batch=N` with
its deletes. Batches write by overwrite of their own folder, so a batch that runs twice leaves the same rows, and the
stream's checkpoint says which batch comes next. Readers take the newest record of an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators.clustering import Centers, diversified

FEED = "seq long, op string, vec_id long, embedding array<float>"


def feed(spark: SparkSession, path: str) -> DataFrame:
    """seq (grows with time), op ('insert' or 'delete'), vec_id, embedding as files arrive."""
    return spark.readStream.schema(FEED).parquet(path)


def apply_batch(changes: DataFrame, batch: int, root: str, centers: Centers, replicas: int = 4) -> None:
    """The last change of an id in a batch counts, by seq (of equal ones the delete); an insert is assigned to its lists, a delete becomes a tombstone."""
    order = Window.partitionBy("vec_id").orderBy(F.desc("seq"), "op")
    last = changes.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
    new = last.filter("op = 'insert'")
    lists = diversified(new, centers, replicas).select("vec_id", "center_id")
    records = lists.join(new.select("vec_id", "embedding"), "vec_id")
    records.repartition("center_id").sortWithinPartitions("center_id").write.mode("overwrite").parquet(f"{root}/postings/batch={batch}")
    last.filter("op = 'delete'").select("vec_id").write.mode("overwrite").parquet(f"{root}/tombstones/batch={batch}")


def start(changes: DataFrame, root: str, checkpoint: str, centers: Centers, replicas: int = 4, available_now: bool = True) -> StreamingQuery:
    writer = changes.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, root, centers, replicas))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, root: str) -> DataFrame:
    """center_id, vec_id, embedding of the live rows: the newest insert of an id with no later delete."""
    postings = spark.read.schema("vec_id long, center_id long, embedding array<float>, batch int").parquet(f"{root}/postings")
    dead = spark.read.schema("vec_id long, batch int").parquet(f"{root}/tombstones")
    newest = postings.groupBy("vec_id").agg(F.max("batch").alias("batch"))
    killed = dead.groupBy("vec_id").agg(F.max("batch").alias("dead"))
    live = newest.join(killed, "vec_id", "left").filter(F.col("dead").isNull() | (F.col("dead") < F.col("batch")))
    return postings.join(live.select("vec_id", "batch"), ["vec_id", "batch"]).select("center_id", "vec_id", "embedding")
