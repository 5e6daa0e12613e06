"""python -m nearfield build|search|quantize|trace: the verbs of an index over Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from nearfield.catalogue import Catalogue
from nearfield.index import VectorIndex
from nearfield.operators import maintenance, quantization


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="nearfield")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, names in {
        "build": ("vectors", "index"), "search": ("index", "output"), "quantize": ("vectors", "output"), "trace": ("vectors", "reserve", "output"),
    }.items():
        one = verbs.add_parser(verb)
        for name in names:
            one.add_argument(name)
    verbs.choices["build"].add_argument("--heads", type=int)
    verbs.choices["build"].add_argument("--metric", default="l2")
    verbs.choices["search"].add_argument("--query", action="append", default=[])
    verbs.choices["quantize"].add_argument("--subspaces", type=int, default=16)
    verbs.choices["quantize"].add_argument("--codes", type=int, default=256)
    verbs.choices["trace"].add_argument("--size", type=int, default=1000)
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.verb == "build":
        index = VectorIndex.build(spark.read.parquet(a.vectors), metric=a.metric)
        (index.build_lists(a.heads) if a.heads else index).save(a.index)
    elif a.verb == "search":
        Catalogue(spark, {"index": VectorIndex.load(spark, a.index)}).execute(*a.query).write.mode("overwrite").parquet(a.output)
    elif a.verb == "quantize":
        rows = spark.read.parquet(a.vectors)
        quantization.write_quantized(rows, quantization.train(rows, a.subspaces, a.codes), a.output)
    else:
        found = maintenance.trace(spark.read.parquet(a.vectors), spark.read.parquet(a.reserve), a.size)
        found.write.mode("overwrite").parquet(a.output)


if __name__ == "__main__":
    main()
