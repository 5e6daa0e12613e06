"""From raw documents to packed training sequences.

Each stage works on all rows that the one before kept, and is written and read again before the next. The first
four return the columns of documents. Documents go if they are toxic (score of one half or more), if no learned
language can be told with a posterior of one half or if they have no letter, if they are a copy or near copy (five
words, similarity 0.8) of a document with a smaller id, and if they hold a benchmark passage (ten words, or a
whole shorter item). What is left is packed.

Rows with a null text or one without a letter go as unidentified; ids may repeat or be null, rows are judged by id and
text; texts of any length are read whole; an empty table stays empty; extra columns pass through the first four stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontam, langid, ngram_join, packing, toxicity
from nearfield.llm.common import forget, free_name, give_back, materialise, remove, rest, shared_folder, small_batches, table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage with whole documents going to its Python workers in batches of a few MB. Before it begins, the driver
    and then the executors let go of what the stage before left there: their memory is bounded too."""

    @wraps(stage)
    def run_bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        forget()
        give_back()
        rest(spark)
        return stage(spark, docs, sf_dir)

    return run_bounded


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = toxicity.held_out(5, 0)
    model = toxicity.fit(docs.filter(~held), table(spark, sf_dir, "labels").filter(~held))
    return toxicity.keep(docs, model)


@bounded
def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs, langid.fit(docs.filter(langid.may_learn(3, 1))))


@bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, width=5, percent=80)


@bounded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "row_hash")  # of id and text, as ids may repeat or be null
    marked = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    index = decontam.stored_index(marked, id_column=name)
    hits = decontam.search_index(index, table(spark, sf_dir, "benchmark"))
    bad = materialise(hits.filter("size(spans) > 0").select(F.col("doc_id").alias("bad_hash")))
    forget(index)
    return marked.join(bad, marked[name] == bad.bad_hash, "left_anti").drop(name)


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, path, packing.crc32_of).withColumnRenamed("measured", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unidentified),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL can express the learned stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # nothing reads the stage before any more
            remove(spark, f"{folder}/{k - 1}")
    return docs
