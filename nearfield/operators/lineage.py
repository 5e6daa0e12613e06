"""Cutting lineage with reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as written to the folder of spark.checkpoint.dir; a local folder stands in only where none is set, as in tests."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="nearfield-"))
    return df.checkpoint()
