"""Indexes by name, and query strings run against them."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.dsl import parse
from nearfield.index import VectorIndex


class Catalogue:
    """Named indexes. A query string names those it asks, or asks all."""

    def __init__(self, spark: SparkSession, indexes: dict[str, VectorIndex] | None = None):
        self.spark, self.indexes = spark, dict(indexes or {})

    def register(self, name: str, index: VectorIndex) -> None:
        self.indexes[name] = index

    def select(self, names: list[str]) -> dict[str, VectorIndex]:
        unknown = [n for n in names if n not in self.indexes]
        if unknown:
            raise KeyError(f"no index called {', '.join(unknown)}")
        return {n: self.indexes[n] for n in names or sorted(self.indexes)}

    def execute(self, *texts: str) -> DataFrame:
        """index_name, query_id (the string's place), rnk, vec_id, dist, and payload columns if the string asks for them.

        Strings that ask the same index for the same number of results run as one search.
        """
        groups: dict[tuple, list] = {}
        for n, text in enumerate(texts):
            query = parse(text)
            for name in self.select(query.indexes):
                groups.setdefault((name, query.k, query.with_metadata), []).append((n, query.vector))
        found = None
        for (name, k, payload), rows in sorted(groups.items(), key=lambda g: g[0]):
            asked = self.spark.createDataFrame(rows, "query_id long, query array<double>")
            hits = self.indexes[name].search(asked, k, with_payload=payload).withColumn("index_name", F.lit(name))
            found = hits if found is None else found.unionByName(hits, allowMissingColumns=True)
        if found is None:
            return self.spark.createDataFrame([], "index_name string, query_id long, rnk long, vec_id long, dist double")
        return found


@contextmanager
def abortable(spark: SparkSession, group: str):
    """Jobs inside belong to a group; calling what this gives ends them from another thread."""
    spark.addTag(group)
    try:
        yield lambda: spark.interruptTag(group)
    finally:
        spark.removeTag(group)
