"""Packing: non-negative least squares over shallow length combinations that fill a window.

A document's ids are cut into whole windows and one rest. Only the histogram of the rests, in `CLASSES` length
classes (rounded up), is global. Combinations of up to `DEPTH` classes that fill the window exactly are the columns
of a non-negative least squares problem, the histogram its right side. The repeat counts are rounded down, and what
is left is packed greedily, again on the histogram: the longest class first, then the longest that still fits.

A rest's number in its class, gapless over all tasks, decides its sequence and its place there; nothing but the
class histogram reaches the driver, and only counts for each task and class are sorted.

Tokens are those of the tokenizer for the whole text. It treats the stretches between ASCII white space apart, so
the ids of a stretch are remembered; the table of them is emptied when it is full.

Edge cases: null and empty texts are one piece, the end id alone; a rest of 0 ids makes no piece; rows that repeat a
doc_id, equal texts among them, are packed each for itself; a text of any length is cut into windows; rests of one class
go by their place; an empty table gives no piece; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import LOWER, batches, binary_text, lean, materialise, numbered

WINDOW = 2048
CLASSES = 128
DEPTH = 3
END_ID = 1
_STRETCHES = 1_200_000
#: The normaliser of a tokenizer whose stretches between white space may be encoded apart, and what stands between them.
APART = ["NFC", "Replace", "Lowercase"]
_MARK = "\0"
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[\s]|\Z)")


class Ids(dict):
    """The ids of a stretch as little-endian 32-bit bytes.

    Stretches are told apart only for a tokenizer that drops case and white space (`APART`); with any other, whole texts
    are encoded.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        steps = (rules["normalizer"] or {}).get("normalizers", [])
        cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.apart = [r["type"] for r in steps] == APART and cuts[0].get("behavior") == "Removed" and len(mark) == 1
        self.mark = mark[0] if self.apart else -1

    @classmethod
    def kept(cls, path: str) -> Ids:
        """One table for the life of a Python worker, over all its tasks."""
        holder = sys.modules.setdefault("nearfield_worker_tables", types.ModuleType("nearfield_worker_tables"))
        tables = holder.__dict__.setdefault("ids", {})
        if path not in tables:
            tables[path] = cls(path)
        return tables[path]

    @staticmethod
    def stretches(text: bytes) -> list[bytes]:
        """What may be encoded apart. The tokenizer drops case, and a full stop or comma after a letter stands alone."""
        if b"<|" not in text:  # names of special tokens keep their case
            text = _STOP.sub(rb" \1", text.translate(LOWER))
        return text.split()

    def encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def learn(self, stretches: set[bytes]) -> None:
        """Encodes new stretches, many in one text with a mark between; those that hold the mark on their own."""
        new = stretches.difference(self)
        if len(self) + len(new) > _STRETCHES:
            self.clear()
            new = stretches
        mark = _MARK.encode()
        odd = [s for s in new if mark in s or b"<|" in s]
        for s, ids in zip(odd, self.encoded(odd), strict=True):
            self[s] = ids.tobytes()
        plain = list(new.difference(odd)) if odd else list(new)
        for at in range(0, len(plain), 20_000):
            parts = [plain[k : min(k + 200, at + 20_000)] for k in range(at, min(at + 20_000, len(plain)), 200)]
            for part, ids in zip(parts, self.encoded([b" \0 ".join(p) for p in parts]), strict=True):
                whole, start = ids.tobytes(), 0
                for s, end in zip(part, [*(4 * np.flatnonzero(ids == self.mark)).tolist(), len(whole)], strict=True):
                    self[s] = whole[start:end]
                    start = end + 4

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text with the end id."""
        end = np.uint32(END_ID).tobytes()
        if not self.apart:
            yield from (ids.tobytes() + end for ids in self.encoded(texts))
            return
        split = [self.stretches(t) for t in texts]
        self.learn(set().union(*split))
        for one in split:
            yield b"".join([*map(self.__getitem__, one), end])


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson). Fewer rounds than it takes to rest only cost padding:
    `plan` covers the histogram exactly from any non-negative counts."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, right = a.T @ a, a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(right).max(initial=0.0)))
    for _ in range(rounds or 6 * a.shape[0]):
        gradient = np.where(passive, -np.inf, right - gram @ x)
        new = int(gradient.argmax())
        if gradient[new] <= tolerance:
            break
        passive[new] = True
        while True:
            at = np.flatnonzero(passive)
            own = gram[np.ix_(at, at)]
            s = np.linalg.solve(own + 1e-10 * np.trace(own) / len(at) * np.eye(len(at)), right[at])
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            gone = at[x[at] <= 1e-12 * max(1.0, x.max())]
            passive[gone], x[gone] = False, 0.0
            if not len(gone) or not passive.any():
                break
    return x


def combinations(classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Class numbers (1 to classes) that sum to the window, up to `depth` of them."""
    found = []
    for n in range(1, depth):
        for head in combinations_with_replacement(range(1, classes), n):
            last = classes - sum(head)
            if last >= head[-1]:
                found.append((*head, last))
    return [(classes,), *found]


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats): exact cover of histogram[c] rests of class c, c from 1."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    columns = [c for c in combinations(len(left) - 1) if all(left[k] for k in c)]
    if columns:
        a = np.zeros((len(left), len(columns)))
        for j, c in enumerate(columns):
            for k in c:
                a[k, j] += 1
        solved = nnls(a[1:], left[1:].astype(float))
        # what rounding down leaves is offered to the exact combinations again, the largest fractions first
        for turn, order in enumerate((range(len(columns)), np.argsort(-(solved % 1), kind="stable"))):
            for j in order:
                c = columns[j]
                fits = min(left[k] // c.count(k) for k in c)
                whole = int(fits if turn else min(np.floor(solved[j] + 1e-6), fits))
                if whole > 0:
                    out.append((c, whole))
                    for k in c:
                        left[k] -= whole
    while left.any():
        room, used, take = len(left) - 1, [], left.copy()
        while room and (fits := np.flatnonzero(take[: room + 1])).size:
            k = int(fits[-1])
            used.append(k)
            take[k] -= 1
            room -= k
        whole = int(min(left[k] // used.count(k) for k in set(used)))
        out.append((tuple(used), whole))
        for k in used:
            left[k] -= whole
    return out


def cut(docs: DataFrame, path: str, measure: Callable[[bytes], int], text_column: str = "text") -> DataFrame:
    """One row for each piece, with `measured` of its ids and, for rests, the class and its number in the task."""
    unit = WINDOW // CLASSES

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, task = Ids.kept(path), [0] * (CLASSES + 1), TaskContext.get().partitionId()
        for texts, docs_ in batches(parts, ["text", "doc_id"], 4 << 20):
            out = []
            for doc_id, ids in zip(docs_, known.of(texts), strict=True):
                total = len(ids) // 4
                for start in range(0, total, WINDOW):
                    piece = ids[4 * start : 4 * (start + WINDOW)]
                    length = len(piece) // 4
                    kind = 0 if length == WINDOW else -(-length // unit)
                    number = seen[kind]
                    seen[kind] += 1
                    out.append((doc_id, start, length, measure(piece), total, kind, task, number))
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    names="doc_id start length measured doc_tokens kind task_id slot_in_task".split(),
                )

    schema = (
        "doc_id long, start long, length long, measured long, doc_tokens long, kind int, task_id int, slot_in_task long"
    )
    return docs.select(F.col("doc_id").cast("long"), binary_text(text_column).alias("text")).mapInArrow(lean(run), schema)


def pack(docs: DataFrame, path: str, measure: Callable[[bytes], int], text_column: str = "text") -> DataFrame:
    """doc_id, start, length, measured, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces = materialise(cut(docs, path, measure, text_column))
    counts = {r.kind: r["count"] for r in pieces.groupBy("kind").count().collect()}
    chosen = plan(np.array([0, *(counts.get(k, 0) for k in range(1, CLASSES + 1))]))
    # whole windows are sequences 0 to counts[0] - 1; then each combination has a range of its own
    spans: dict[int, list[tuple[int, int, int, int, int]]] = {}
    first, used = counts.get(0, 0), [0] * (CLASSES + 1)
    for combination, repeats in chosen:
        for k in set(combination):
            many = combination.count(k)
            spans.setdefault(k, []).append((used[k], used[k] + many * repeats, many, first, combination.index(k)))
            used[k] += many * repeats
        first += repeats
    shared = spark.sparkContext.broadcast(
        {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in spans.items()}
    )

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            position = batch.column("position").to_numpy(zero_copy_only=False)
            sequence, order = position.copy(), np.zeros(len(position), np.int64)
            for k in np.unique(kind[kind > 0]):
                at = np.flatnonzero(kind == k)
                lo, _, many, start, slot = shared.value[k]
                span = np.searchsorted(lo, position[at], side="right") - 1
                within = position[at] - lo[span]
                sequence[at] = start[span] + within // many[span]
                order[at] = slot[span] + within % many[span]
            names = ["doc_id", "start", "length", "measured", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(order)],
                names=[*names, "sequence_id", "place"],
            )

    placed = numbered(pieces, "kind").mapInArrow(
        lean(place), "doc_id long, start long, length long, measured long, doc_tokens long, sequence_id long, place long"
    )
    # a sequence has a bounded number of pieces: each fills a class at least
    before = (
        F.expr("aggregate(filter(mates, m -> m.place < p.place), 0L, (s, m) -> s + m.length)").alias("offset")
    )
    whole = placed.filter(F.col("length") == WINDOW).select("*", F.lit(0).cast("long").alias("offset")).drop("place")
    piece = F.struct("place", "length", "doc_id", "start", "measured", "doc_tokens")
    rests = (
        placed.filter(F.col("length") < WINDOW)
        .groupBy("sequence_id")
        .agg(F.collect_list(piece).alias("mates"))
        .select("sequence_id", "mates", F.explode("mates").alias("p"))
        .select("p.doc_id", "p.start", "p.length", "p.measured", "p.doc_tokens", "sequence_id", before)
    )
    return whole.unionByName(rests)


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)


def sequences(docs: DataFrame, path: str, placed: DataFrame, text_column: str = "text") -> DataFrame:
    """sequence_id, input_ids (padded with 0 to the window, except at a power of two), n_tokens."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Ids.kept(path)
        for texts, docs_ in batches(parts, ["text", "doc_id"], 4 << 20):
            for doc_id, packed in zip(docs_, known.of(texts), strict=True):
                ids = np.frombuffer(packed, "<u4")
                starts = range(0, len(ids), WINDOW)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([doc_id] * len(starts), pa.int64()),
                        "start": pa.array(starts, pa.int64()),
                        "ids": pa.array([ids[s : s + WINDOW] for s in starts], pa.list_(pa.uint32())).cast(
                            pa.list_(pa.int32())
                        ),
                    }
                )

    texts = docs.select(F.col("doc_id").cast("long"), binary_text(text_column).alias("text"))
    pieces = texts.mapInArrow(lean(run), "doc_id long, start long, ids array<int>")
    joined = placed.select("doc_id", "start", "sequence_id", "offset").join(pieces, ["doc_id", "start"])
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    n = F.size("ids_")
    power = n.bitwiseAND(n - 1) == 0
    padded = F.when(power, F.col("ids_")).otherwise(F.concat("ids_", F.array_repeat(F.lit(0), F.lit(WINDOW) - n)))
    return joined.groupBy("sequence_id").agg(flat.alias("ids_")).select(
        "sequence_id", padded.alias("input_ids"), n.alias("n_tokens")
    )
