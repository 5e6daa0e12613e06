"""One object with the verbs of a vector index. Every verb returns a DataFrame or a new index."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import clustering, maintenance, quantization, search
from nearfield.operators.kernels import knn


@dataclass(frozen=True)
class Parameters:
    """Build and search parameters with their defaults (fixed values)."""

    metric: str = "cosine"
    heads_ratio: float = 0.2
    replicas: int = 8
    candidates: int = 64
    rng_factor: float = 1.0
    list_limit: int = 118
    nprobe: int = 64
    max_dist_ratio: float = 10000.0
    merge_threshold: int = 10
    max_check: int = 8192
    base: int = 1

    def with_(self, **changes: object) -> Parameters:
        """Names ignore case."""
        known = {k.lower(): k for k in self.__dataclass_fields__}
        return replace(self, **{known[k.lower()]: v for k, v in changes.items()})


@dataclass
class VectorIndex:
    """Rows (vec_id, embedding, any payload), with inverted lists once `build_lists` has run."""

    vectors: DataFrame
    parameters: Parameters = field(default_factory=Parameters)
    tombstones: DataFrame | None = None
    postings: DataFrame | None = None
    centers: clustering.Centers | None = None
    codebook: np.ndarray | None = None

    @classmethod
    def build(cls, vectors: DataFrame, normalized: bool = False, **parameters: object) -> VectorIndex:
        """Cosine indexes normalise stored vectors unless they are; queries are never changed."""
        p = Parameters().with_(**parameters)
        if p.metric == "cosine" and not normalized:
            vectors = vectors.withColumn("embedding", V.normalized("embedding", p.base))
        return cls(vectors, p)

    def _live(self) -> DataFrame:
        return self.vectors if self.tombstones is None else search.live(self.vectors, self.tombstones)

    def build_lists(self, heads: int | None = None) -> VectorIndex:
        p, rows = self.parameters, self._live()
        k = heads or max(1, round(p.heads_ratio * rows.count()))
        centers = clustering.kmeans(rows, k, "l2", factor=0.0).centers
        lists = clustering.diversified(rows, centers, p.replicas, p.candidates, p.rng_factor)
        kept = clustering.cut_reachable(lists, p.list_limit).select("vec_id", "center_id")
        return replace(self, postings=kept, centers=centers)

    def search(
        self, queries: DataFrame, k: int, where: Column | None = None, mode: str = "exact", with_payload: bool = False, search_deleted: bool = False
    ) -> DataFrame:
        """query_id, rnk, vec_id, dist (and the payload). mode: exact, ivf or pq (pq results are rescored)."""
        rows = self.vectors if search_deleted else self._live()
        rows = rows if where is None else rows.filter(where)
        p = self.parameters
        if mode == "ivf":
            hits = clustering.ivf_search(rows, self.postings, queries, self.centers, k, p.nprobe, p.metric, p.max_dist_ratio)
        elif mode == "pq":
            codes = quantization.encode(rows, self.codebook)
            rough = quantization.pq_search(codes, queries, self.codebook, 4 * k)
            hits = quantization.reranked(rough, rows, queries, k, p.metric)
        else:
            hits = knn(rows, queries, k, p.metric)
        return search.with_payload(hits, rows.drop("embedding")) if with_payload else hits

    def iterator(self, query: list[float], where: Column | None = None, search_deleted: bool = False) -> search.ResultIterator:
        rows = self.vectors if search_deleted else self._live()
        return search.ResultIterator(rows, query, self.parameters.metric, self.parameters.max_check, where)

    def sample(self, vec_id: int) -> DataFrame:
        return self.vectors.filter(F.col("vec_id") == vec_id)

    def add(self, rows: DataFrame, key: str | None = None) -> VectorIndex:
        """With a key, a row replaces the one of the same key."""
        new = maintenance.upserted(self._live(), rows, key) if key else maintenance.inserted(self.vectors, rows)
        return replace(self, vectors=new, tombstones=None if key else self.tombstones, postings=None)

    def delete(self, ids: DataFrame) -> VectorIndex:
        dead = ids.select("vec_id") if self.tombstones is None else self.tombstones.unionByName(ids.select("vec_id"))
        return replace(self, tombstones=dead.distinct())

    def delete_vectors(self, targets: DataFrame, first_only: bool = False) -> VectorIndex:
        kept = maintenance.deleted_by_vector(self._live(), targets, first_only)
        gone = self._live().select("vec_id").join(kept.select("vec_id"), "vec_id", "left_anti")
        return self.delete(gone)

    def delete_by(self, where: Column) -> VectorIndex:
        return self.delete(self.vectors.filter(where))

    def merge(self, other: VectorIndex) -> VectorIndex:
        return replace(self, vectors=maintenance.merged(self._live(), other._live()), tombstones=None, postings=None)

    def compact(self) -> VectorIndex:
        return replace(self, vectors=self._live(), tombstones=None)

    def train_quantizer(self, subspaces: int, codes: int = 256) -> VectorIndex:
        return replace(self, codebook=quantization.train(self._live(), subspaces, codes))

    def save(self, path: str) -> None:
        """Tables and a manifest; a clone is a save under another path."""
        self._live().write.mode("overwrite").parquet(f"{path}/vectors")
        if self.postings is not None:
            self.postings.repartition("center_id").sortWithinPartitions("center_id", "vec_id").write.mode("overwrite").parquet(f"{path}/postings")
        spark = self.vectors.sparkSession
        manifest = {"parameters": self.parameters.__dict__}
        if self.centers is not None:
            manifest["centers"] = [self.centers[0].tolist(), self.centers[1].tolist()]
        if self.codebook is not None:
            manifest["codebook"] = self.codebook.tolist()
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
        centers = manifest.get("centers")
        return cls(
            spark.read.parquet(f"{path}/vectors"),
            Parameters(**manifest["parameters"]),
            postings=spark.read.parquet(f"{path}/postings") if centers else None,
            centers=(np.array(centers[0], np.int64), np.array(centers[1])) if centers else None,
            codebook=np.array(manifest["codebook"]) if "codebook" in manifest else None,
        )
