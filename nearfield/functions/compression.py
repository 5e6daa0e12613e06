"""Columns of bytes through zstd with a trained dictionary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import vectors as V

#: Rows that a dictionary is trained on, and the leading bytes of each that it looks at.
TRAINING_ROWS, TRAINING_BYTES = 1000, 4096


def trained(df: DataFrame, column: str, key: str, size: int = 16_384) -> bytes:
    """A dictionary from the rows with the smallest hashes; empty where there are too few to train one."""
    some = df.filter(F.octet_length(column) > 0).orderBy(V.seeded(0, key)).limit(TRAINING_ROWS)
    samples = [bytes(r.s) for r in some.select(F.substring(column, 1, TRAINING_BYTES).alias("s")).collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _mapped(df: DataFrame, column: str, make: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    at = df.columns.index(column)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for batch in parts:
            values = [None if v is None else change(v) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(values, pa.binary()), *batch.columns[at + 1 :]], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def compressed(df: DataFrame, column: str, dictionary: bytes = b"", level: int = 3) -> DataFrame:
    """df with a binary column compressed; null stays null."""
    return _mapped(df, column, lambda: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress)


def decompressed(df: DataFrame, column: str, dictionary: bytes = b"") -> DataFrame:
    return _mapped(df, column, lambda: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress)
