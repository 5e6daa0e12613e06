"""What the operators share: shared-folder tables, whole-column reads and distributed row numbering."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Turns A-Z into a-z in UTF-8 bytes and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is made only where none is configured (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext.getCheckpointDir()
        if known is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nearfield-"))
            known = spark.sparkContext.getCheckpointDir()
        folder = known
    return folder.rstrip("/")


def materialise(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there, columns still prune.

    group_bytes is for long rows: readers hold a row group at a time, which else has a hundred rows at least. Their values
    are hardly ever the same, so no dictionary of them is tried.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/nearfield-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if group_bytes is not None:
        checks = ("parquet.block.size.row.check.min", "parquet.page.size.row.check.min")
        writer = writer.options(**{"parquet.block.size": group_bytes, **dict.fromkeys(checks, 1), "parquet.enable.dictionary": "false"})
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._nearfield_path = path
    return table


def small_batches(spark: SparkSession, limit: str = "4m") -> None:
    """Bounds the Arrow batches of the session where it has no bound of its own.

    Rows are whole documents here: the usual 64 MB a batch are held several times over, by the JVM and by each worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, limit)


def shuffles(spark: SparkSession) -> set[str]:
    """The numbers of the shuffles that Spark keeps on disk."""
    kept = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    return set(kept.keySet().mkString(",").split(",")) - {""}


def forget(*tables: DataFrame, gone: frozenset[str] | set[str] = frozenset()) -> None:
    """Deletes tables that `materialise` wrote and nothing reads any more, and lets Spark clean up their shuffles.

    Spark drops a shuffle only once a collection finds that neither Python nor a listener holds its plan any more. With
    `gone`, collections go on, for some seconds at most, until these shuffles are dropped.
    """
    for df in tables:
        path = getattr(df, "_nearfield_path", None)
        if path is not None:
            remove(df.sparkSession, path)
    spark, end = SparkSession.getActiveSession(), time.monotonic() + 15
    jvm, patience = spark._jvm, 2
    while True:
        gc.collect()
        # a worker thread tells the JVM which objects Python dropped; only after that can their shuffles go
        waiting, until = getattr(jvm._gateway_client, "finalizer_deque", ()), time.monotonic() + patience
        while waiting and time.monotonic() < until:
            time.sleep(0.02)
        jvm.System.gc()
        if not gone:
            return
        until = min(end, time.monotonic() + 1)  # a thread of its own removes what the collection found
        while shuffles(spark) & gone and time.monotonic() < until:
            time.sleep(0.05)
        if not shuffles(spark) & gone or time.monotonic() >= end:
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_text(column: str = "text") -> F.Column:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it where df has a column so called already (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def batches(rows: Iterator[pa.RecordBatch], columns: list[str], limit: int, most: int = 1 << 30) -> Iterator[list[list]]:
    """Python lists of the columns, cut so that the first (binary) column has about `limit` bytes and there are `most`
    rows at a time."""
    for batch in rows:
        size = batch.column(columns[0]).nbytes
        step = min(most, max(1, batch.num_rows * limit // max(size, 1)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield [part.column(c).to_pylist() for c in columns]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """Gives memory back to the system when a task ends: a Python worker stays alive, idle, beside the next ones."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()  # what the task before held itself
        yield from run(parts)
        give_back()

    return task


def give_back() -> None:
    """What this Python process holds and doesn't use goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def rest(spark: SparkSession) -> None:
    """Lets executors give back what they don't use: their heaps, which else stay as large as they ever were beside the
    Python workers, and the memory of these workers with the broadcasts that they had last.

    A task for each core collects the garbage of its JVM; if cores are busy, an executor may be left out.
    """
    cores = spark.sparkContext.defaultParallelism
    collected = spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("gc"))
    collected.mapInArrow(lean(lambda parts: parts), "gc string").collect()


def numbered(df: DataFrame, group: str, counted: str = "slot_in_task", task: str = "task_id", position: str = "position") -> DataFrame:
    """Adds `position`, gapless from 0 in each group, to rows that carry (task, group, number in that pair).

    df must be materialised: its (task, number) pairs stay fixed. Only one count for each task and group is
    sorted in a window, never the rows.
    """
    n, start = free_name(df, "n"), free_name(df, "start")
    counts = df.groupBy(group, task).agg((F.max(counted) + 1).alias(n))
    before = Window.partitionBy(group).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, task, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    return df.join(starts, [group, task]).withColumn(position, F.col(start) + F.col(counted)).drop(start)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names in any case: an appended column replaces one that df has already."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
