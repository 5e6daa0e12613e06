"""Readers and writers of the binary and text vector files.

Binary files are read as Spark's binaryFile or binaryRecords, so any store that Spark reads will do. Files of the
DEFAULT kind are one int32 row count, one int32 dimension and the values; XVEC rows carry their dimension each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Element types of the files (fixed values).
DTYPES = {"float": "<f4", "int8": "i1", "uint8": "u1", "int16": "<i2"}
#: Bytes of a file that one task decodes at a time.
_CHUNK = 8 << 20


def _blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _decoded(blobs: DataFrame, dtype: str, header: bool) -> DataFrame:
    """path, pos, embedding of every row of each file."""
    kind = np.dtype(DTYPES[dtype])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                buffer = data.as_buffer()
                if header:
                    rows, dim = np.frombuffer(buffer, "<i4", 2).tolist() if buffer.size >= 8 else (0, 0)
                    values = np.frombuffer(buffer, kind, rows * dim, 8).reshape(rows, dim)
                else:
                    dim = int(np.frombuffer(buffer, "<i4", 1)[0]) if buffer.size >= 4 else 0
                    record = np.dtype([("dim", "<i4"), ("v", kind, (dim,))])
                    table = np.frombuffer(buffer, record)
                    if (table["dim"] != dim).any():
                        raise ValueError(f"{path}: rows of different dimensions")
                    values = table["v"]
                step = max(1, _CHUNK // max(1, 4 * dim))
                for at in range(0, len(values), step):
                    some = np.ascontiguousarray(values[at : at + step], np.float32)
                    lists = pa.ListArray.from_arrays(np.arange(0, some.size + 1, max(dim, 1), dtype=np.int32), pa.array(some.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(some)), pa.array(np.arange(at, at + len(some))), lists], names=["path", "pos", "embedding"]
                    )

    return blobs.mapInArrow(run, "path string, pos long, embedding array<float>")


def _numbered(rows: DataFrame) -> DataFrame:
    """vec_id over all files in order of their path: a file's start is the sum of the counts before it."""
    counts = rows.groupBy("path").count()
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("path", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), "path").select((F.col("start") + F.col("pos")).alias("vec_id"), "embedding")


def read_default(spark: SparkSession, path: str, dtype: str = "float", start: int | None = None, end: int | None = None) -> DataFrame:
    rows = _numbered(_decoded(_blobs(spark, path), dtype, header=True))
    if start is not None:
        rows = rows.filter(F.col("vec_id") >= start)
    return rows.filter(F.col("vec_id") < end) if end is not None else rows


def read_xvec(spark: SparkSession, path: str, dtype: str = "float") -> DataFrame:
    """path may name several files with commas; they follow one another in order of their paths."""
    blobs = None
    for one in path.split(","):
        own = _blobs(spark, one)
        blobs = own if blobs is None else blobs.unionByName(own)
    return _numbered(_decoded(blobs, dtype, header=False))


def read_text(spark: SparkSession, path: str, delimiter: str = "|") -> DataFrame:
    """meta, embedding of lines `meta<TAB>v|v|v`; the last tab divides them."""
    line = spark.read.text(path)
    parts = line.select(
        F.regexp_extract("value", r"^(.*)\t([^\t]*)$", 1).alias("meta"), F.regexp_extract("value", r"^(.*)\t([^\t]*)$", 2).alias("v")
    )
    values = F.filter(F.split("v", f"\\{delimiter}"), lambda s: s != "")
    return parts.select("meta", F.transform(values, lambda s: s.cast("float")).alias("embedding"))


def read_metadata(spark: SparkSession, content: str, index: str) -> DataFrame:
    """vec_id, meta (binary): the index file is int32 n and n + 1 uint64 offsets into the content file."""
    blobs = _blobs(spark, content).select(F.lit(1).alias("k"), F.col("content").alias("c"))
    offsets = _blobs(spark, index).select(F.lit(1).alias("k"), F.col("content").alias("o"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for data, table in zip(batch.column(0), batch.column(1), strict=True):
                raw, table = data.as_buffer(), table.as_buffer()
                n = int(np.frombuffer(table, "<i4", 1)[0])
                at = np.frombuffer(table, "<u8", n + 1, 4).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(n), pa.int64()), pa.array([raw[a:b].to_pybytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    names=["vec_id", "meta"],
                )

    return blobs.join(offsets, "k").select("c", "o").mapInArrow(run, "vec_id long, meta binary")


def read_truth(spark: SparkSession, path: str, kind: str = "txt") -> DataFrame:
    """query_id, rnk, vec_id from lines of ids, XVEC rows of ids or a DEFAULT file of ids."""
    if kind == "txt":
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), "value")
        number = F.row_number().over(Window.orderBy("n")) - 1
        rows = lines.select(number.cast("long").alias("query_id"), F.split(F.trim("value"), r"\s+").alias("ids"))
    else:
        def ids(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                for data in batch.column(1):
                    flat = np.frombuffer(data.as_buffer(), "<i4")
                    if kind == "xvec":
                        k = int(flat[0])
                        table = flat.reshape(-1, k + 1)[:, 1:]
                    else:
                        table = flat[2 : 2 + flat[0] * flat[1]].reshape(flat[0], flat[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range(len(table)), pa.int64()), pa.array(table.tolist(), pa.list_(pa.int64()))], names=["query_id", "ids"]
                    )

        rows = _blobs(spark, path).mapInArrow(ids, "query_id long, ids array<long>")
    exploded = rows.select("query_id", F.posexplode("ids").alias("p", "id"))
    return exploded.select("query_id", (F.col("p") + 1).cast("long").alias("rnk"), F.col("id").cast("long").alias("vec_id"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """query_id, rnk, vec_id, dist of a result file: int32 n, int32 k, then n * k of (int32 id, float32 dist)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for data in batch.column(1):
                buffer = data.as_buffer()
                n, k = np.frombuffer(buffer, "<i4", 2).tolist()
                table = np.frombuffer(buffer, np.dtype([("i", "<i4"), ("d", "<f4")]), n * k, 8)
                place = np.arange(n * k)
                keep = table["i"] >= 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((place // max(k, 1))[keep]),
                        pa.array((place % max(k, 1) + 1)[keep]),
                        pa.array(table["i"][keep].astype(np.int64)),
                        pa.array(table["d"][keep].astype(np.float64)),
                    ],
                    names=["query_id", "rnk", "vec_id", "dist"],
                )

    return _blobs(spark, path).mapInArrow(run, "query_id long, rnk long, vec_id long, dist double")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """op, vec_id of an update trace: int32 n, n deleted ids, n inserted ids."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for data in batch.column(1):
                flat = np.frombuffer(data.as_buffer(), "<i4")
                n = int(flat[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["delete"] * n + ["insert"] * n), pa.array(flat[1 : 1 + 2 * n].astype(np.int64))], names=["op", "vec_id"]
                )

    return _blobs(spark, path).mapInArrow(run, "op string, vec_id long")


def read_vectors(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    """One entry for all formats: default, xvec, txt or any that Spark reads into (vec_id, embedding)."""
    readers = {"default": read_default, "xvec": read_xvec, "txt": read_text}
    return readers[fmt](spark, path, **options) if fmt in readers else spark.read.format(fmt).options(**options).load(path)


def key_range(df: DataFrame, key: str, start: object, count: int) -> DataFrame:
    """The `count` rows from a key on, in order."""
    return df.filter(F.col(key) >= F.lit(start)).orderBy(key).limit(count)


# Writers. These formats are one local file each by definition, so they are for result sets that a driver can hold;
# tables are written as Parquet.


def _stream(df: DataFrame, path: str, head: bytes, pack) -> None:
    with open(path, "wb") as out:
        out.write(head)
        for row in df.toLocalIterator():
            out.write(pack(row))


def write_default(vectors: DataFrame, path: str, dtype: str = "float") -> None:
    rows = vectors.count()
    first = vectors.select(F.size("embedding").alias("d")).first()
    head = np.array([rows, first.d if first else 0], "<i4").tobytes()
    _stream(vectors.orderBy("vec_id").select("embedding"), path, head, lambda r: np.asarray(r[0]).astype(DTYPES[dtype]).tobytes())


def append_default(vectors: DataFrame, path: str, dtype: str = "float") -> None:
    """Adds rows to a file and corrects its row count."""
    rows = vectors.count()
    with open(path, "r+b") as out:
        before = int(np.frombuffer(out.read(4), "<i4")[0])
        out.seek(0, 2)
        for row in vectors.orderBy("vec_id").select("embedding").toLocalIterator():
            out.write(np.asarray(row[0]).astype(DTYPES[dtype]).tobytes())
        out.seek(0)
        out.write(np.array([before + rows], "<i4").tobytes())


def write_xvec(vectors: DataFrame, path: str, dtype: str = "float") -> None:
    def pack(r) -> bytes:
        return np.array([len(r[0])], "<i4").tobytes() + np.asarray(r[0]).astype(DTYPES[dtype]).tobytes()

    _stream(vectors.orderBy("vec_id").select("embedding"), path, b"", pack)


def write_text(vectors: DataFrame, path: str, delimiter: str = "|") -> None:
    values = F.array_join(F.transform("embedding", lambda v: v.cast("string")), delimiter)
    vectors.select(F.concat_ws("\t", F.col("meta").cast("string"), values)).write.mode("overwrite").text(path)


def write_metadata(rows: DataFrame, content: str, index: str) -> None:
    at, offsets = 0, [0]
    with open(content, "wb") as out:
        for row in rows.orderBy("vec_id").select(F.col("meta").cast("binary")).toLocalIterator():
            out.write(row[0])
            at += len(row[0])
            offsets.append(at)
    with open(index, "wb") as out:
        out.write(np.array([len(offsets) - 1], "<i4").tobytes() + np.array(offsets, "<u8").tobytes())


def write_truth(truth: DataFrame, path: str) -> None:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rnk", "vec_id"))), lambda s: s["vec_id"].cast("string"))
    lines = truth.groupBy("query_id").agg(F.array_join(ids, " ").alias("value"))
    lines.repartitionByRange(1, "query_id").sortWithinPartitions("query_id").select("value").write.mode("overwrite").text(path)


def write_results(hits: DataFrame, path: str, queries: int, k: int) -> None:
    """Missing places are id -1 with the largest distance over ten."""
    place = {}
    for r in hits.select("query_id", "rnk", "vec_id", "dist").toLocalIterator():
        place[(r.query_id, r.rnk)] = (r.vec_id, r.dist)
    table = np.zeros(queries * k, np.dtype([("i", "<i4"), ("d", "<f4")]))
    table["i"], table["d"] = -1, np.finfo(np.float32).max / 10
    for (q, rank), pair in place.items():
        table[q * k + rank - 1] = pair
    with open(path, "wb") as out:
        out.write(np.array([queries, k], "<i4").tobytes() + table.tobytes())


def result_lines(hits: DataFrame, base: int = 1) -> DataFrame:
    """query_id, line: `dist@vid|dist@vid`, distances over base squared."""
    pair = F.concat_ws("@", (F.col("dist") / float(base * base)).cast("string"), F.col("vec_id").cast("string"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("rnk", pair.alias("p")))), lambda s: s["p"])
    return hits.groupBy("query_id").agg(F.array_join(items, "|").alias("line"))


def npy(spark: SparkSession, path: str) -> DataFrame:
    """vec_id (the row's place in its file) and embedding of two-dimensional .npy files; a file is read by one task."""
    import io

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for content in batch.column(0):
                rows = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                if rows.ndim != 2:
                    raise ValueError(f"an array of {rows.ndim} dimensions holds no vectors")
                for at in range(0, len(rows), 4096):
                    some = rows[at : at + 4096].astype(np.float32)
                    ends = pa.array(np.arange(len(some) + 1) * rows.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(at, at + len(some))), pa.ListArray.from_arrays(ends, pa.array(some.ravel()))], names=["vec_id", "embedding"]
                    )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "vec_id long, embedding array<float>")
