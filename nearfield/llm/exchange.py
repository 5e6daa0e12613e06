"""Which hashed keys do several items of a table hold, and how many? Answered chunk by chunk, packed.

A chunk is a run of items that one task reads. It sends its distinct keys, sorted, cut into buckets of the key space
and packed: one row for each chunk and bucket. A bucket adds up the counts of all chunks and answers each chunk with
the keys that two items at least hold. A key that several items of one chunk hold is sent once, so a key of any
frequency costs a bucket one entry for each chunk; which items hold it travels past the buckets with the chunk's
payload. Nothing is dropped: keys of one item only get no answer because nobody shares them.

A task that runs again must read the same items in the same order, as Spark's scans do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import lean

#: Items of a chunk; the largest 16-bit number stands for several.
ITEMS = 60_000
_MANY = 65_535
#: Bytes of text whose keys one bucket takes.
BUCKET_BYTES = 4 << 20
SCHEMA = "bucket int, chunk long, kind int, n int, body binary"


def buckets_for(texts: DataFrame) -> int:
    """How many buckets the keys of a table (text binary) need."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // BUCKET_BYTES))


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes and so on, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplaned(body: bytes, at: int, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    part = np.frombuffer(body, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(part.T).view(kind).ravel()


def packed(keys: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys with a 16-bit and a 32-bit number each."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    body = _planes(gaps) + _planes(owner.astype(np.uint16)) + _planes(counts.astype(np.uint32))
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpacked(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = zstandard.ZstdDecompressor().decompress(body)
    keys = np.cumsum(_unplaned(whole, 0, n, np.uint64), dtype=np.uint64)
    return keys, _unplaned(whole, 8 * n, n, np.uint16), _unplaned(whole, 10 * n, n, np.uint32)


def dealt_counts(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The rows of a chunk that keeps its items elsewhere: distinct sorted keys and how many of its items hold each."""
    return _batch(_cut(chunk, keys, np.zeros(len(keys), np.uint16), counts, buckets))


def dealt(chunk: int, keys: np.ndarray, owner: np.ndarray, payload: bytes, buckets: int) -> pa.RecordBatch:
    """The rows that a chunk sends. keys: of all items, distinct within an item; owner: the item of each."""
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    several = np.repeat(counts > 1, counts)
    own = packed(keys[several], owner[several], np.zeros(int(several.sum()), np.uint32))
    rows = [(int(chunk % buckets), chunk, 1, int(several.sum()), len(own).to_bytes(8, "little") + own + payload)]
    return _batch(rows + _cut(chunk, keys[first], np.where(counts > 1, _MANY, owner[first]), counts, buckets))


def _cut(chunk: int, distinct: np.ndarray, holder: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple]:
    rows = []
    ends = np.searchsorted(((distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)).tolist():
        part = slice(ends[b], ends[b + 1])
        rows.append((b, chunk, 0, int(ends[b + 1] - ends[b]), packed(distinct[part], holder[part], counts[part])))
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "chunk", "kind", "n", "body"]
    )


def _answers(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """The replies of one bucket to its chunks."""
    parts = [unpacked(body, n) for _, n, body in rows]
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    sums = np.add.reduceat(counts[order].astype(np.int64), first)
    total = np.empty(len(keys), np.int64)
    total[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
    at, out = 0, []
    for (chunk, n, _), (own, holder, _) in zip(rows, parts, strict=True):
        held = total[at : at + n]
        live = held > 1
        if live.any():
            out.append((0, chunk, 0, int(live.sum()), packed(own[live], holder[live], np.minimum(held[live], 0xFFFFFFFF))))
        at += n
    if out:
        yield _batch(out)


def runs(parts: Iterator[pa.RecordBatch], by: str) -> Iterator[list[dict]]:
    """Rows with one value of the column they are sorted by."""
    waiting: list[dict] = []
    for batch in parts:
        for row in batch.to_pylist():
            if waiting and waiting[0][by] != row[by]:
                yield waiting
                waiting = []
            waiting.append(row)
    if waiting:
        yield waiting


def answered(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of the same schema: for each chunk and bucket the keys that two items at least hold with their totals, and
    the chunks' own rows (kind 1) as they came."""

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(parts, "bucket"):
            through = [(r["bucket"], r["chunk"], r["kind"], r["n"], r["body"]) for r in run if r["kind"] == 1]
            for r in through:
                yield _batch([r])
            if len(through) < len(run):
                yield from _answers([(r["chunk"], r["n"], r["body"]) for r in run if r["kind"] == 0])

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(meet), SCHEMA)


def exchanged(
    rows: DataFrame, buckets: int, assemble: Callable[[int, bytes, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str
) -> DataFrame:
    """Runs assemble(chunk, payload, keys, owner, total) for each chunk of the dealt rows: every pair of a key and an
    item that holds it, for the keys that two items of the table at least hold, with the number of such items."""

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(parts, "chunk"):
            mine = next(r for r in run if r["kind"] == 1)
            size = int.from_bytes(mine["body"][:8], "little")
            keys, owner, _ = unpacked(mine["body"][8 : 8 + size], mine["n"])
            k, o, t = replies(run)
            several = o == _MANY
            order = np.argsort(k[several])
            total = t[several][order][np.searchsorted(k[several][order], keys)] if len(keys) else np.empty(0, np.uint32)
            keys, owner = np.concatenate([k[~several], keys]), np.concatenate([o[~several], owner])
            total = np.concatenate([t[~several], total])
            yield assemble(mine["chunk"], mine["body"][8 + size :], keys, owner.astype(np.int64), total.astype(np.int64))

    return by_chunk(answered(rows, buckets), gather, schema)


def replies(run: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys, owners and totals of a chunk's answers."""
    found = [unpacked(r["body"], r["n"]) for r in run if r["kind"] == 0]
    found.append((np.empty(0, np.uint64), np.empty(0, np.uint16), np.empty(0, np.uint32)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def by_chunk(rows: DataFrame, gather: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lean(gather), schema)
