"""Benchmark decontamination with a distributed positional inverted index.

`build_index` cuts the documents into segments of a bounded number of words. A segment is one row: its documents,
the terms it holds, and for each term the sorted list of its positions. Positions count all words of a
segment, with a gap between documents, so that no phrase runs over a border. The index is an ordinary table.

`search_index` takes the benchmark in blocks of a bounded size, one of which is held at a time. In each segment only
phrases whose terms it all holds are looked up, from the rarest term: the shorter lists are shifted by their offset
and intersected first, so that most phrases end after one or two short lists. Nothing is shuffled but one small row
for each document and block when there is more than one block.

Both work on whole arrays: there is no Python step for a word or a phrase, only for a segment, a document and a match.

Edge cases: null or wordless text gives n_words 0 and no match; an item without words has no window; an item
shorter than a window is one window; items with the same id count as one; ties do not arise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import batches, binary_text, lean, materialise

#: Lower-cases A-Z, keeps digits, letters and every byte above 127, and turns all else into a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
#: A segment is closed at so many words (one document is never cut, so a longer one is a segment of its own).
SEGMENT_WORDS = 1 << 15
#: And at so many bytes of words.
SEGMENT_BYTES = 4 << 20
#: Bytes of segments in one row group of the stored index.
GROUP_BYTES = 4 << 20
#: Text that is cut into words at a time.
CHUNK_BYTES = 1 << 20
#: Positions from which phrases are followed at a time (all of one phrase's, if it has more), and words of such phrases.
STEP_POSITIONS = 1 << 18
#: Benchmark text that one pass over the index takes.
BLOCK_BYTES = 4 << 20

INDEX_SCHEMA = (
    "segment long, doc_ids binary, doc_starts binary, doc_words binary, "
    "terms binary, term_bytes binary, term_counts binary, positions binary"
)
HIT_SCHEMA = "segment long, place long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def word_arrays(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts: their bytes without anything between, the size of each, and the words of each text."""
    stream = np.frombuffer(b" ".join(texts).translate(WORD_BYTES), np.uint8)
    inside = stream != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begins = edges[::2]
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return stream[inside], edges[1::2] - begins, np.diff(np.searchsorted(begins, text_ends), prepend=0)


def binary_array(sizes: np.ndarray, data: np.ndarray | pa.Buffer) -> pa.Array:
    """The binary array of values of these sizes that lie one behind the other in data."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def value_bytes(values: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary array without nulls, one behind the other."""
    _, ends, data = values.buffers()
    if not len(values) or data is None:
        return np.empty(0, np.uint8)
    ends = np.frombuffer(ends, np.int32)
    return np.frombuffer(data, np.uint8)[ends[values.offset] : ends[values.offset + len(values)]]


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each segment; every document of `docs` is in exactly one segment."""

    def segments(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        at, held, segment = 0, 0, TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            ids, counts, sizes, data = (np.concatenate(x) for x in zip(*parts, strict=True))
            words = binary_array(sizes, data).dictionary_encode()
            codes, terms = words.indices.to_numpy(), words.dictionary
            places = np.arange(len(codes)) + np.repeat(np.arange(len(ids)), counts)
            # 16 bits are sorted by digits, and hold every position but of very long documents
            order = np.argsort(codes.astype(np.uint16) if len(terms) <= 1 << 16 else codes, kind="stable")
            places = places.astype(np.uint16 if not len(places) or places[-1] < 1 << 16 else np.int32)
            columns = {
                "doc_ids": ids,
                "doc_starts": np.cumsum(counts + 1) - counts - 1,
                "doc_words": counts,
                "terms": value_bytes(terms),
                "term_bytes": pc.binary_length(terms).to_numpy(),
                "term_counts": np.bincount(codes, minlength=len(terms)).astype(np.int32),
                "positions": places[order],
            }
            cells = {k: pa.array([v.tobytes()], pa.binary()) for k, v in columns.items()}
            return pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int64())} | cells)

        for texts, doc_ids in batches(rows, ["text", "doc_id"], CHUNK_BYTES):
            data, sizes, counts = word_arrays(texts)
            ids = np.asarray(doc_ids, np.int64)
            words_to, bytes_to = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(sizes))
            places_to = words_to + np.arange(len(words_to))  # with a gap after each document
            data_to = bytes_to[words_to]
            first = 0
            while first < len(ids):
                last = min(
                    int(np.searchsorted(places_to[1:] - 1, SEGMENT_WORDS - at + places_to[first], side="right")),
                    int(np.searchsorted(data_to[1:], SEGMENT_BYTES - held + data_to[first], side="right")),
                )
                last = max(last, first if parts else first + 1)
                if last > first:
                    words, its = slice(words_to[first], words_to[last]), slice(data_to[first], data_to[last])
                    parts.append((ids[first:last], counts[first:last], sizes[words], data[its]))
                    at += int(places_to[last] - places_to[first])
                    held += int(data_to[last] - data_to[first])
                if last < len(ids):
                    yield close()
                    parts, at, held, segment = [], 0, 0, segment + 1
                first = last
        if parts:
            yield close()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), binary_text(text_column).alias("text")).mapInArrow(
        lean(segments), INDEX_SCHEMA
    )


def stored_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index of docs as a written table."""
    return materialise(build_index(docs, id_column, text_column), GROUP_BYTES)


def windows_of(items: list[tuple[str, bytes]], width: int) -> list[tuple[list[bytes], list[str]]]:
    """The distinct windows of the items with the ids of all items that hold them."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = words_of(text)
        for at in range(max(1, len(words) - width + 1) if words else 0):
            found.setdefault(tuple(words[at : at + width]), set()).add(item)
    return [(list(k), sorted(v)) for k, v in found.items()]


class Lists:
    """The positions of a segment's terms: `keys` are sorted, a term's rank in the upper part, the position in the lower."""

    def __init__(self, counts: np.ndarray, positions: np.ndarray) -> None:
        self.counts, self.ends = counts, np.cumsum(counts, dtype=np.int64)
        self.positions, self.size = positions, int(positions.max(initial=0)) + 1
        self.keys = np.repeat(np.arange(len(counts)) * self.size, counts) + positions

    def of(self, rank: int) -> np.ndarray:
        return self.positions[self.ends[rank] - self.counts[rank] : self.ends[rank]].astype(np.int64)


def phrase_starts(phrases: np.ndarray, lists: Lists) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which phrases (rows of ranks) begin where: the lists of each, shifted by their offsets, are intersected from the
    shortest, those of many phrases at once."""
    rows = np.arange(len(phrases))
    order = np.argsort(lists.counts[phrases], axis=1, kind="stable")
    rarest = phrases[rows, order[:, 0]]
    sizes = lists.counts[rarest].astype(np.int64)
    room = np.cumsum(sizes)
    at = 0
    while at < len(phrases):
        before = room[at] - sizes[at]
        stop = max(at + 1, int(np.searchsorted(room, before + STEP_POSITIONS, side="right")))
        part = slice(at, stop)
        which = np.repeat(rows[part], sizes[part])
        shift = np.repeat(lists.ends[rarest[part]] - room[part] + before, sizes[part])
        starts = lists.positions[np.arange(len(which)) + shift].astype(np.int64) - order[which, 0]
        keep = starts >= 0
        which, starts = which[keep], starts[keep]
        for turn in range(1, phrases.shape[1]):
            offset = order[which, turn]
            places = starts + offset
            wanted = phrases[which, offset] * lists.size + places
            found = lists.keys[np.minimum(np.searchsorted(lists.keys, wanted), len(lists.keys) - 1)]
            keep = (found == wanted) & (places < lists.size)
            which, starts = which[keep], starts[keep]
            if not len(starts):
                break
        if len(starts):
            yield which, starts
        at = stop


def near_spans(lists: list[tuple[int, np.ndarray]], slop: int) -> list[tuple[int, int]]:
    """Spans that hold all terms in order with at most `slop` other words between them, earliest end from each start."""
    ordered = [x for _, x in sorted(lists, key=lambda x: x[0])]
    starts = last = ordered[0]
    for other in ordered[1:]:
        at = np.searchsorted(other, last, side="right")
        keep = at < len(other)
        starts, last = starts[keep], other[at[keep]]
    keep = last - starts - (len(ordered) - 1) <= slop
    return list(zip(starts[keep].tolist(), (last[keep] + 1).tolist(), strict=True))


class Block:
    """The distinct windows of some items: places in one stream of term codes, by width, with the items that hold each."""

    def __init__(self, items: list[tuple[str, bytes]], width: int) -> None:
        known: dict[bytes, int] = {}
        names: dict[str, int] = {}
        codes, begins, sizes, owners, at = [], [], [], [], 0
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            for word in words:
                known.setdefault(word, len(known))
            codes.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            size = min(width, len(words))
            starts = np.arange(at, at + len(words) - size + 1, dtype=np.int32)
            begins.append(starts)
            sizes.append(np.full(len(starts), size, np.int32))
            owners.append(np.full(len(starts), names.setdefault(item, len(names)), np.int32))
            at += len(words)
        self.terms, self.names = list(known), list(names)
        self.stream = np.concatenate(codes) if codes else np.empty(0, np.int32)
        #: (width, where each distinct window starts, ends of its items, items)
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        if not codes:
            return
        begin, size, owner = (np.concatenate(x) for x in (begins, sizes, owners))
        for k in np.unique(size).tolist():
            mine = size == k
            windows = self.stream[begin[mine][:, None] + np.arange(k, dtype=np.int32)]
            _, first, which = np.unique(windows, axis=0, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), owner[mine]], 1), axis=0)
            ends = np.cumsum(np.bincount(pairs[:, 0], minlength=len(first)))
            self.groups.append((k, begin[mine][first], ends, pairs[:, 1]))

    def possible(self, terms: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each width the windows whose words are all among the terms, some at a time: their places there and their
        numbers, and the ends of all windows' items with these items."""
        place = pc.index_in(pa.array(self.terms, terms.type), value_set=terms)
        place = place.fill_null(-1).to_numpy(zero_copy_only=False)
        ranks = place[self.stream]
        for k, starts, ends, items in self.groups:
            alive = np.arange(len(starts))
            for offset in range(k):
                alive = alive[ranks[starts[alive] + offset] >= 0]
            step = max(1, STEP_POSITIONS // k)
            for at in range(0, len(alive), step):
                some = alive[at : at + step]
                yield ranks[starts[some][:, None] + np.arange(k)].astype(np.int64), some, ends, items


def _matches(phrases: np.ndarray, lists: Lists, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of phrases, and where each of their matches begins and ends."""
    if not slop:
        for which, starts in phrase_starts(phrases, lists):
            yield which, starts, starts + phrases.shape[1]
        return
    for row, ranks in enumerate(phrases.tolist()):
        found = np.array(near_spans([(o, lists.of(r)) for o, r in enumerate(ranks)], slop), np.int64).reshape(-1, 2)
        yield np.full(len(found), row), found[:, 0], found[:, 1]


def _search_block(index: DataFrame, shared: Broadcast, slop: int) -> DataFrame:
    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in range(batch.num_rows):
                cell = {n: batch.column(n)[row].as_buffer() for n in batch.schema.names if n != "segment"}
                ids, starts, counts = (np.frombuffer(cell[n], np.int64) for n in ("doc_ids", "doc_starts", "doc_words"))
                term_counts = np.frombuffer(cell["term_counts"], np.int32)
                narrow = cell["positions"].size == 2 * term_counts.sum()
                lists = Lists(term_counts, np.frombuffer(cell["positions"], np.uint16 if narrow else np.int32))
                terms = binary_array(np.frombuffer(cell["term_bytes"], np.int32), cell["terms"])
                spans = np.empty((0, 2), np.int64)
                items: dict[int, set[int]] = {}
                for phrases, windows, owner_ends, owners in shared.value.possible(terms):
                    for which, begin, end in _matches(phrases, lists, slop):
                        doc = np.searchsorted(starts, begin, side="right") - 1
                        inside = end <= starts[doc] + counts[doc]
                        spans = _union(np.concatenate([spans, np.stack([begin[inside], end[inside]], 1)]))
                        for pair in np.unique(doc[inside] * len(owner_ends) + windows[which[inside]]).tolist():
                            k, w = divmod(pair, len(owner_ends))
                            items.setdefault(k, set()).update(owners[(owner_ends[w - 1] if w else 0) : owner_ends[w]].tolist())
                of = np.searchsorted(starts, spans[:, 0], side="right") - 1
                own = spans - starts[of][:, None]
                struct = pa.StructArray.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1])], names=["start", "end"])
                names = shared.value.names
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("segment")[row].as_py()] * len(ids), pa.int64()),
                        pa.array(range(len(ids)), pa.int64()),
                        pa.array(ids),
                        pa.array(counts),
                        pa.ListArray.from_arrays(np.searchsorted(of, np.arange(len(ids) + 1)).astype(np.int32), struct),
                        pa.array([sorted(names[i] for i in items.get(k, ())) for k in range(len(ids))], pa.list_(pa.string())),
                    ],
                    names=["segment", "place", "doc_id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(lean(search), HIT_SCHEMA)


def _union(spans: np.ndarray) -> np.ndarray:
    """Rows of begin and end, sorted, with those that touch made one. No two documents of a segment touch."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.append(True, spans[1:, 0] > reach[:-1])[: len(spans)]
    last = np.append(fresh[1:], True)[: len(spans)]
    return np.stack([spans[fresh, 0], reach[last]], 1)


def search_index(
    index: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    slop: int = 0,
    item_column: str = "item_id",
    text_column: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each indexed document: n_words, the merged spans of all matches and the sorted ids of their items.

    slop 0 matches windows word for word; a larger slop matches their words in order with so many others between.
    """
    rows = benchmark.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), binary_text(text_column).alias("text")
    )
    found, block, size, shared = [], [], 0, None

    def flush() -> None:
        nonlocal block, size, shared
        if shared is not None:  # a block before this one: its hits are written, so that one block's windows are held at a time
            found[-1] = materialise(found[-1])
            shared.destroy()
        shared = index.sparkSession.sparkContext.broadcast(Block(block, width))
        found.append(_search_block(index, shared, slop))
        block, size = [], 0

    for row in rows.toLocalIterator(prefetchPartitions=False):
        if block and size + len(row.text) > block_bytes:
            flush()
        block.append((row.item, bytes(row.text)))
        size += len(row.text)
    if block or not found:
        flush()
    if len(found) == 1:
        return found[0].drop("segment", "place")
    every = found[0]
    for other in found[1:]:
        every = every.unionAll(other)
    # by the row's place in the index, as ids may repeat
    merged = every.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.drop("segment", "place").withColumn(
        "spans",
        F.expr(
            "aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (m, s) -> "
            "if(size(m) > 0 and s.start <= element_at(m, -1).end, "
            "concat(slice(m, 1, size(m) - 1), array(named_struct('start', element_at(m, -1).start, "
            "'end', greatest(element_at(m, -1).end, s.end)))), concat(m, array(s))))"
        ),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """Builds and stores the index of docs, then searches it. See `search_index` for the columns."""
    return search_index(stored_index(docs), benchmark, width, slop)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The digest of `decontaminate`: word and hit counts, the items and whether anything was hit."""
    hits = decontaminate(docs, benchmark, width)
    ids = F.array_join("items", ",")
    return hits.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]], width: int = 10) -> dict:
    """The same digest for a few rows by plain comparison, for tests."""
    windows = windows_of([(i, (t or "").encode()) for i, t in items], width)
    out = {}
    for doc, text in docs:
        words, hit, owners = words_of((text or "").encode()), set(), set()
        for window, who in windows:
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    owners.update(who)
        joined = ",".join(sorted(owners))
        out[doc] = (len(words), len(hit), len(owners), hashlib.sha256(joined.encode()).hexdigest(), bool(hit))
    return out
