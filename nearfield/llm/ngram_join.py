"""Exact n-gram Jaccard join: size-banded tiles, bitmap signatures, sorted-array intersection.

A document is the set of its distinct word n-grams. Documents with equal sets collapse into one class first. An
exchange of packed gram hashes (`exchange.py`) tells for each gram how many documents hold it. A gram of one document
alone is shared with nobody, so a document of n grams of which fewer than t n are shared links with nothing; that
leaves few. Two linked classes share a gram among the first n - ceil(t n) + 1 of each in any common order; grams are
ordered by how many documents hold them, so that the compared prefixes hold rare grams, and the unshared ones, which
come first, need not be compared. Grams of prefixes are the tiles' keys, cut further into bands of set size, as sizes
of linked sets differ by the threshold at most.

Inside a tile three tests bound the overlap from above: sizes, the places of the shared gram in both prefixes (what
comes before the first shared gram is not shared), and a 512-bit signature, as each bit that one side has and the
other lacks is a gram not shared. Pairs that pass are tested again with a signature of eight bits a gram or more, and
what is left is intersected exactly, the only step that moves whole sets. Copies by the thousand would make a tile
quadratic, so three rounds run: each class first tests one leader of the tiles it is in, twice with different leaders,
and the last round tests every pair of a tile that is not in one component yet. Links inside a component are implied,
so components are exact; nothing is capped.

Edge cases: null, empty and wordless texts have size 0, link with nothing and are their own component; a text of
fewer words than n is one gram; texts of any length are one set; repeated rows are equal sets; ids may repeat or be
null, rows are told apart by their place; a component is named by its smallest id that is not null; an empty table
gives no row; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm import exchange
from nearfield.llm.common import LOWER, batches, binary_text, forget, free_name, lean, materialise

#: 64-bit words of the signature that tiles compare, and the most bits that a pair's signature has.
LONGS = 8
WIDEST = 1 << 17
#: Bytes of text in one chunk of the exchange.
CHUNK_BYTES = 4 << 20
_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hashes of words; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def grams(text: bytes, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    rows = len(words) - width + 1
    mixed = hashes[:rows].copy()
    for k in range(1, width):
        mixed *= _K
        mixed += hashes[k : k + rows]
    mixed += np.uint64(width)
    mixed ^= mixed >> np.uint64(31)
    mixed *= _M
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Grams that a set of n shares at least with any set it links with."""
    return -(-percent * n // 100)


def _sized(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row for each document: id (its place), doc_id, n, fingerprint p0 and p1 of the set, hash h of the text, and for those that may
    link their shared grams: how many (live), the prefix's without unshared ones, the place of its first, the sorted
    array and the 512-bit signature."""
    texts = docs.select(F.col("doc_id").cast("long"), binary_text().alias("text"), F.xxhash64(binary_text()).alias("h"))
    buckets = exchange.buckets_for(texts)

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chunk = WordHashes(), TaskContext.get().partitionId() << 24
        for texts, ids, hashes in batches(parts, ["text", "doc_id", "h"], CHUNK_BYTES, exchange.ITEMS):
            found = [grams(t, width, known) for t in texts]
            n = np.array([len(g) for g in found], np.int64)
            own = np.empty((len(n), 5), np.int64)
            own[:, 0], own[:, 1], own[:, 4] = [i or 0 for i in ids], n, hashes
            for k, g in enumerate(found):
                own[k, 2:4] = np.array([g.sum(), np.bitwise_xor.reduce(g * _K ^ (g >> np.uint64(17)))], np.uint64).view(np.int64)
            nulls = np.array([i is None for i in ids], np.uint8)
            payload = len(n).to_bytes(8, "little") + own.tobytes() + nulls.tobytes()
            yield exchange.dealt(chunk, np.concatenate(found), np.repeat(np.arange(len(n)), n), payload, buckets)
            chunk += 1

    bits = [f"b{k}" for k in range(LONGS)]

    def assemble(chunk: int, payload: bytes, keys: np.ndarray, owner: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        count = int.from_bytes(payload[:8], "little")
        own = np.frombuffer(payload, np.int64, 5 * count, 8).reshape(count, 5)
        nulls = np.frombuffer(payload, np.uint8, count, 8 + 40 * count).astype(bool)
        n, live = own[:, 1], np.bincount(owner, minlength=count)
        may = (n > 0) & (live >= _need(n, percent))
        keep = may[owner]
        keys, owner, total = keys[keep], owner[keep], total[keep]
        live = np.where(may, live, 0)
        ends = np.cumsum(live)
        order = np.lexsort((keys, total, owner))
        place = np.arange(len(keys)) - np.repeat(ends - live, live)  # among the shared grams of its document
        take = np.where(may, live - _need(n, percent) + 1, 0)
        prefix = keys[order][place < np.repeat(take, live)].view(np.int64)
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        signs = np.zeros((count, 64 * LONGS), bool)
        signs[owner, (keys & np.uint64(64 * LONGS - 1)).astype(np.int64)] = True
        signs = np.packbits(signs, axis=1, bitorder="little").view(np.int64)
        sets = [keys[e - k : e].tobytes() if m else None for e, k, m in zip(ends.tolist(), live.tolist(), may.tolist(), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(take)), pa.int32()), pa.array(prefix))
        return pa.RecordBatch.from_arrays(
            [
                pa.array((chunk << 16) + np.arange(count)),
                pa.array(own[:, 0], mask=nulls),
                *(pa.array(np.ascontiguousarray(own[:, k])) for k in (1, 2, 3, 4)),
                pa.array(live),
                lists,
                pa.array(n - live),
                pa.array(sets, pa.binary()),
                *(pa.array(np.ascontiguousarray(signs[:, k])) for k in range(LONGS)),
            ],
            names=["id", "doc_id", "n", "p0", "p1", "h", "live", "prefix", "first", "grams", *bits],
        )

    schema = (
        "id long, doc_id long, n long, p0 long, p1 long, h long, live long, prefix array<long>, first long, grams binary, "
        + ", ".join(f"{b} long" for b in bits)
    )
    return exchange.exchanged(texts.mapInArrow(lean(deal), exchange.SCHEMA), buckets, assemble, schema)


def _may_link(percent: int, a: str = "a", b: str = "b") -> Column:
    """Size ratio and signature bound of a pair; never false for a pair that links."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    lacks = lambda x, y: reduce(
        Column.__add__,
        [F.bit_count(F.col(f"{x}.b{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}.b{k}")))) for k in range(LONGS)],
    )
    most = F.least(F.col(f"{a}.live") - lacks(a, b), F.col(f"{b}.live") - lacks(b, a))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (most * (100 + percent) >= (na + nb) * percent)


def signature(grams: np.ndarray) -> np.ndarray:
    """A bitmap of eight bits a gram or more, a power of two of them, at most WIDEST."""
    size = min(WIDEST, 1 << max(9, int(8 * len(grams) - 1).bit_length()))
    return np.packbits(np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) > 0, bitorder="little").view(np.uint64)


def most_common(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> int:
    """How many grams two sets share at most by their signatures; the longer one is folded to the shorter."""
    if len(x) < len(y):
        x, y, nx, ny = y, x, ny, nx
    x = np.bitwise_or.reduce(x.reshape(-1, len(y)), axis=0)
    return min(nx - int(np.bitwise_count(x & ~y).sum()), ny - int(np.bitwise_count(y & ~x).sum()))


def _sets(sized: DataFrame) -> DataFrame:
    """id, n, live, the sorted shared grams and their wide signature."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            wide = [signature(np.frombuffer(g.as_py(), np.uint64)).tobytes() for g in batch.column("grams")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wide, pa.binary())], names=["id", "n", "live", "grams", "wide"])

    return sized.select("id", "n", "live", "grams").mapInArrow(lean(run), "id long, n long, live long, grams binary, wide binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets truly reach the threshold: by wide signatures first, then by intersection."""

    def both_sides(pairs: DataFrame, *columns: str) -> DataFrame:
        for side in ("a", "b"):
            renamed = [F.col(c).alias(f"{c}_{side}") for c in columns]
            pairs = pairs.join(sets.select(F.col("id").alias(side), *renamed), side)
        return pairs.select(*[f"{c}_{s}" for c in columns for s in "ab"], "n_a", "n_b", "a", "b") if "n" not in columns else pairs

    def kept(a: list, b: list, na: list, nb: list, good: list[bool]) -> pa.RecordBatch:
        mask = pa.array(good, pa.bool_())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()).filter(mask) for c in (a, b, na, nb)], names=["a", "b", "n_a", "n_b"]
        )

    enough = lambda both, na, nb: (100 + percent) * both >= percent * (na + nb)

    def bound(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["wide_a", "wide_b", "live_a", "live_b", "n_a", "n_b", "a", "b"]
        for wa, wb, la, lb, na, nb, a, b in batches(parts, names, 8 << 20):
            read = lambda w: np.frombuffer(w, np.uint64)
            most = [most_common(read(x), read(y), p, q) for x, y, p, q in zip(wa, wb, la, lb, strict=True)]
            yield kept(a, b, na, nb, [enough(*m) for m in zip(most, na, nb, strict=True)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ga, gb, na, nb, a, b in batches(parts, ["grams_a", "grams_b", "n_a", "n_b", "a", "b"], 8 << 20):
            read = lambda g: np.frombuffer(g, np.uint64)
            both = [len(np.intersect1d(read(x), read(y), assume_unique=True)) for x, y in zip(ga, gb, strict=True)]
            yield kept(a, b, na, nb, [enough(*m) for m in zip(both, na, nb, strict=True)])

    schema = "a long, b long, n_a long, n_b long"
    near = both_sides(pairs, "wide", "live", "n").select("wide_a", "wide_b", "live_a", "live_b", "n_a", "n_b", "a", "b")
    near = near.mapInArrow(lean(bound), schema)
    return both_sides(near, "grams").mapInArrow(lean(run), schema).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """A written table: id and comp (the smallest id it reaches) for every id of the edges (a, b): large and small stars in turn."""
    now = materialise(edges.select("a", "b").filter("a <> b").distinct())
    while True:  # until two rounds are equal
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        after = materialise(small)
        same = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        done = same(after) == same(now)
        forget(now)
        now = after
        if done:
            break
    heads = now.select(F.col("b").alias("id")).distinct().join(now.select(F.col("a").alias("id")), "id", "left_anti")
    ids = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("comp"))
    found = materialise(ids.unionAll(heads.select("id", F.col("id").alias("comp"))))
    forget(now)
    return found


def _tiles(keys: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Rows (key, tile, id, band, pos, comp), each in the tile of its band and of the next one; a tile holds two
    components at least. Only counts are grouped by tile, rows of a hot tile come in by a join."""
    rows = keys.withColumn("comp", F.col("id"))
    if comp is not None:
        rows = keys.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    rows = rows.withColumn("tile", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    mixed = rows.groupBy("key", "tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return rows.join(mixed.select("key", "tile"), ["key", "tile"]).select("key", "tile", "id", "band", "pos", "comp")


def labelled(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables: id, doc_id, n, p0, p1, h of every row; and p0, p1, n, comp, label of every class of rows."""
    sized = materialise(_sized(docs, width, percent))
    rows = materialise(sized.select("id", "doc_id", "n", "p0", "p1", "h"))
    classes = rows.filter("n > 0").groupBy("p0", "p1", "n").agg(F.min("id").alias("rep"), F.min("doc_id").alias("least"))
    classes = materialise(classes)
    reps = sized.filter("live > 0").join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    base = -(-10000 // percent) / 100
    band = F.floor(F.log("n") / F.lit(float(np.log(base)))).cast("int").alias("band")
    every = reps.select("id", "n", "first", F.posexplode("prefix").alias("at", "key"))
    keys = materialise(every.select("key", "id", band, (F.col("first") + F.col("at")).alias("pos")))
    tiles = materialise(_tiles(keys, None))
    some = tiles.select("id").distinct()
    small = materialise(reps.drop("prefix", "grams", "p0", "p1", "doc_id", "h", "first").join(some, "id", "left_semi"))
    sets = materialise(_sets(reps.join(some, "id", "left_semi")))
    forget(sized, keys)

    edges, comp = None, None
    for turn in range(3):
        if turn:
            last = tiles
            tiles = materialise(_tiles(last.select("key", "id", "band", "pos").distinct(), comp))
            forget(last, comp)
        pairs = materialise(_to_leaders(tiles, small, percent, turn) if turn < 2 else _all_pairs(tiles, small, percent))
        found = _verified(pairs, sets, percent)
        more = materialise(found if edges is None else edges.unionAll(found))
        forget(pairs, *([edges] if edges is not None else []))
        edges = more
        comp = components(edges)
    named = classes.join(comp, classes.rep == comp.id).groupBy("comp").agg(F.min("least").alias("label"))
    named = comp.join(named, "comp").select("id", "comp", "label")
    whole = classes.join(named, classes.rep == named.id, "left").select(
        "p0", "p1", "n", F.coalesce("comp", "rep").alias("comp"), F.coalesce("label", "least").alias("label")
    )
    whole = materialise(whole)
    forget(tiles, small, sets, edges, comp, classes)
    return rows, whole


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    rows, classes = labelled(docs, width, percent)
    return rows.join(classes, ["p0", "p1", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id")
    )


def _to_leaders(tiles: DataFrame, small: DataFrame, percent: int, turn: int) -> DataFrame:
    """One pair at most for each class: with the leader that it shares most tiles with, if the bounds allow it."""
    rank = F.struct((F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))).alias("order"), "id", "comp")
    leaders = tiles.groupBy("key", "tile").agg(F.min(rank).alias("l"))
    leaders = leaders.select("key", "tile", F.col("l.id").alias("lead"), F.col("l.comp").alias("lead_comp"))
    votes = tiles.join(leaders, ["key", "tile"]).filter("comp <> lead_comp").groupBy("id", "lead").count()
    best = votes.groupBy(F.col("id").alias("one")).agg(F.max_by("lead", F.struct("count", "lead")).alias("lead"))
    best = best.join(small.alias("a"), F.col("a.id") == F.col("one"))
    best = best.join(small.alias("b"), F.col("b.id") == F.col("lead")).filter(_may_link(percent))
    return best.select(F.least("one", "lead").alias("a"), F.greatest("one", "lead").alias("b")).distinct()


def _all_pairs(tiles: DataFrame, small: DataFrame, percent: int) -> DataFrame:
    """Every pair of a tile that lies in two components and passes the bounds.

    If the tile's gram is the first that two sets share, they share at most what is left of each from its place on. A
    pair that links passes that test at its first shared gram, so it may fail it at others.
    """
    rows = tiles.join(small, "id")
    a, b = rows.alias("a"), rows.filter("tile = band").alias("b")
    order = (F.col("a.band") < F.col("b.band")) | (F.col("a.id") < F.col("b.id"))
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.tile") == F.col("b.tile"))
    apart = F.col("a.comp") != F.col("b.comp")
    left = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    after = left * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent
    pairs = a.join(b, on & order & apart & after & _may_link(percent))
    ids = F.col("a.id"), F.col("b.id")
    return pairs.select(F.least(*ids).alias("a"), F.greatest(*ids).alias("b")).distinct()


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id (null last), and all rows without a gram.

    Rows go by (doc_id, text), so that unlike texts under one id, and rows without an id, are told apart. Texts are
    moved only where a row that stays has equals.
    """
    name = free_name(docs, "text_hash")
    marked = docs.withColumn(name, F.xxhash64(binary_text()))
    rows, classes = labelled(docs, width, percent)
    known = rows.filter("n > 0").join(classes, ["p0", "p1", "n"]).select("doc_id", "h", "comp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "h")).alias("w")
    winners = known.groupBy("comp").agg(first).select("comp", "w.doc_id", "w.h", F.lit(True).alias("stays"))
    # rows of one id and text are of one component
    texts = known.groupBy("doc_id", "h").agg(F.first("comp").alias("comp"), F.count("*").alias("rows"))
    same = (F.col("t.comp") == F.col("w.comp")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.h") == F.col("w.h"))
    judged = texts.alias("t").join(winners.alias("w"), same, "left").select("t.doc_id", "t.h", "t.rows", "w.stays")
    judged = materialise(judged.filter("stays IS NULL OR rows > 1"))
    forget(rows, classes)

    def of(where: str, how: str, df: DataFrame) -> DataFrame:
        k = judged.filter(where).select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h"))
        return df.join(k, (df[name] == k.k_h) & df["doc_id"].cast("long").eqNullSafe(k.k_id), how)

    kept = of("stays IS NULL", "left_anti", marked)
    if not judged.filter("stays").isEmpty():
        once = of("stays", "left_semi", marked).dropDuplicates(["doc_id", name])
        kept = of("stays", "left_anti", kept).unionByName(once)
    return kept.drop(name)


def brute_force(rows: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, tuple[int, int]]:
    """The same for a few rows by comparing all pairs, for tests."""
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().translate(LOWER).split()
        w = min(width, len(words))
        sets[doc] = {tuple(words[k : k + w]) for k in range(len(words) - w + 1)} if words else set()
    comp = {d: d for d in sets}
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = {d: min(a, b) if c in (a, b) else c for d, c in comp.items()}
    return {d: (len(sets[d]), comp[d]) for d in ids}
