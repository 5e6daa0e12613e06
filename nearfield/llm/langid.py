"""Language ID by prediction by partial matching over bytes.

For each language a context tree of order three counts which byte class follows which three. A symbol seen in a
context costs n / (N + T); otherwise an escape T / (N + T) is paid and the next shorter context, without the
symbols already excluded, is asked (method C with exclusion). Frozen counts give one exact distribution for each
context, which is compiled into a table of costs in 2048ths of a bit; the code length of a text is the exact sum of its
symbols' costs, whole text.

Bytes are first mapped to at most `CODES` classes: letters without case, one class each for white space, digits
and other ASCII, and the most frequent bytes above 127.

The trees are fitted on a bounded sample: for each language the `SAMPLE_DOCS` labelled documents with the smallest
hash of their id, whole texts. Scoring covers every row. A model has a table of `CODES` ** 4 costs for each language, so
more than `LANGUAGES` of them are refused.

Edge cases: null text or text without a letter is `und` with score 0; equal code lengths go to the language that
sorts first; with no training rows at all every text is `und`; repeated rows give repeated results; long texts are
summed in blocks; an empty table gives no row; columns called lang_pred or lang_score are replaced, all others pass
through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import batches, binary_text, lean, without

CODES = 48
SAMPLE_DOCS = 500
ORDER = 3
LANGUAGES = 48
#: Costs are whole numbers of this part of a bit, up to 32 bits, so that sums of them are exact.
UNIT = 1 / 2048
#: Bytes whose costs are looked up at a time.
BLOCK = 1 << 18


@dataclass
class Model:
    languages: list[str]
    code_of: np.ndarray  # byte -> class
    costs: np.ndarray  # [class ** 4, language]: cost of the last class after the first three, in units of a bit
    unit: float = 1.0


def byte_classes(histogram: np.ndarray) -> np.ndarray:
    """space 0, digit 1, other ASCII 2, rare high byte 3, letters 4-29, then frequent high bytes."""
    code = np.full(256, 2, np.uint8)
    code[[32, *range(9, 14)]] = 0
    code[48:58] = 1
    code[97:123] = code[65:91] = np.arange(4, 30)
    high = sorted(range(128, 256), key=lambda b: (-histogram[b], b))
    code[128:] = 3
    for k, b in enumerate(high[: CODES - 30]):
        if histogram[b]:
            code[b] = 30 + k
    return code


def coded(texts: list[bytes], code_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each symbol with its context over all texts, and where each text begins (three spaces stand before)."""
    stream = np.frombuffer(b"   ".join([b"", *texts]), np.uint8)
    codes = code_of[stream].astype(np.int32)
    index = ((codes[:-3] * CODES + codes[1:-2]) * CODES + codes[2:-1]) * CODES + codes[3:]
    starts = np.cumsum([0, *[len(t) + 3 for t in texts[:-1]]])
    return index, starts


def _finer(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of the last axis after contexts one symbol longer than those of lower."""
    seen = n > 0
    total, kinds = n.sum(-1, keepdims=True, dtype=np.float64), seen.sum(-1, keepdims=True)
    left = np.where(seen, 0.0, lower)
    rest = left.sum(-1, keepdims=True)
    escape = np.where(rest > 0, kinds, 0)
    share = np.where(total > 0, n / np.maximum(total + escape, 1), 0.0)
    spread = np.where(total > 0, escape / np.maximum(total + escape, 1), 1.0)
    return share + left * spread / np.maximum(rest, 1e-300)


def table_of(index: np.ndarray, n: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Places and probabilities of the table (c3, c2, c1, symbol), for one c3 at a time; n: how often each index stands.

    A whole table of doubles is several times as large as the costs that are kept of it.
    """
    size = CODES**ORDER
    counts = np.bincount(index % size, weights=n, minlength=size).reshape((CODES,) * ORDER)
    lower = np.full(CODES, 1.0 / CODES)
    for order in range(ORDER):
        lower = _finer(counts.sum(axis=tuple(range(ORDER - 1 - order))), lower)
    for c3 in range(CODES):
        own = index // size == c3
        part = np.bincount(index[own] - c3 * size, weights=n[own], minlength=size).reshape((CODES,) * ORDER)
        yield slice(c3 * size, (c3 + 1) * size), _finer(part, lower).ravel()


def distribution(counts: np.ndarray) -> np.ndarray:
    """Probabilities of the last axis after each context, from counts[c3, c2, c1, symbol]."""
    index, out = np.flatnonzero(counts), np.empty(counts.size)
    for places, shares in table_of(index, counts.ravel()[index]):
        out[places] = shares
    return out.reshape(counts.shape)


def training_sample(docs: DataFrame, lang: str = "lang", docs_each: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text) of a bounded sample of labelled rows, the same for any partitioning."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col("text").isNotNull())
    # the text is not in this plan's ranking: ids only
    first = Window.partitionBy(lang).orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (
        rows.select("doc_id", lang)
        .withColumn("n_", F.row_number().over(first))
        .filter(F.col("n_") <= docs_each)
        .select("doc_id")
        .distinct()
    )
    return rows.join(F.broadcast(ids), "doc_id").select(F.col(lang).alias("lang"), binary_text().alias("text"))


def fit(docs: DataFrame, docs_each: int = SAMPLE_DOCS) -> Model:
    """docs: only the rows that may be learned from."""
    rows = training_sample(docs, docs_each=docs_each).sortWithinPartitions("lang")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

        for lang, text in batches(parts, ["lang", "text"], 1 << 20):
            for one in set(lang):
                whole = b"   ".join([b"", *[t for la, t in zip(lang, text, strict=True) if la == one]])
                for at in range(0, len(whole) - 3, BLOCK):
                    stream = np.frombuffer(whole[at : at + BLOCK + 3], np.uint8).astype(np.int64)
                    grams = (stream[:-3] << 24) | (stream[1:-2] << 16) | (stream[2:-1] << 8) | stream[3:]
                    own = seen.setdefault(one, [])
                    own.append(np.unique(grams, return_counts=True))
                    if len(own) == 16:
                        seen[one] = [merged(own)]
        for one, own in seen.items():
            keys, n = merged(own)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([one] * len(keys), pa.string()), "gram": pa.array(keys), "n": pa.array(n)}
            )

    grams = rows.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = grams.toArrow()  # no rows of Python objects on the driver
    names = found.column("lang").to_numpy()
    grams, n = found.column("gram").to_numpy(), found.column("n").to_numpy()
    languages = sorted(set(names))
    if len(languages) > LANGUAGES:
        raise ValueError(f"{len(languages)} languages; a model has {LANGUAGES} at most")
    code_of = byte_classes(np.bincount(grams & 255, weights=n, minlength=256))
    costs = np.empty((CODES ** (ORDER + 1), len(languages)), np.uint16)
    index = np.zeros(len(grams), np.int64)
    for shift in (24, 16, 8, 0):
        index = index * CODES + code_of[(grams >> shift) & 255]
    for k, lang in enumerate(languages):
        own = names == lang
        for places, shares in table_of(index[own], n[own]):
            costs[places, k] = np.minimum(np.rint(-np.log2(shares) / UNIT), 65_535)
    return Model(languages, code_of, costs, UNIT)


def has_letter(text: bytes) -> bool:
    return any(65 <= b & 0xDF <= 90 for b in text[:64]) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def code_lengths(texts: list[bytes], model: Model) -> np.ndarray:
    """Bits of each text under each language."""
    if not texts:
        return np.zeros((0, len(model.languages)))
    out, few, size = np.empty((len(texts), len(model.languages))), [], 0

    def together(rows: list[int]) -> None:
        index, starts = coded([texts[k] for k in rows], model.code_of)
        ends = np.append(starts[1:] - 3, len(index))
        sums = np.zeros((len(index) + 1, len(model.languages)))
        np.cumsum(model.costs.take(index, axis=0), axis=0, dtype=np.float64, out=sums[1:])
        out[rows] = (sums[ends] - sums[starts]) * model.unit

    for k, text in enumerate(texts):
        if len(text) > BLOCK:  # the three bytes before a block are its first contexts
            out[k] = 0
            for at in range(0, len(text), BLOCK):
                codes = model.code_of[np.frombuffer(text[max(at - 3, 0) : at + BLOCK], np.uint8)]
                codes = np.concatenate([np.zeros(3 - min(at, 3), np.uint8), codes]).astype(np.int32)
                index = ((codes[:-3] * CODES + codes[1:-2]) * CODES + codes[2:-1]) * CODES + codes[3:]
                out[k] += model.costs.take(index, axis=0).sum(0, dtype=np.float64)
            out[k] *= model.unit
            continue
        if few and size + len(text) > BLOCK:
            together(few)
            few, size = [], 0
        few.append(k)
        size += len(text)
    if few:
        together(few)
    return out


def predict(texts: list[bytes | None], model: Model) -> tuple[list[str], np.ndarray]:
    """The language of each text and its posterior under equal priors; `und` with 0 where there is no letter."""
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    rows = [k for k, t in enumerate(texts) if t and model.languages and has_letter(t)]
    bits = code_lengths([texts[k] for k in rows], model)
    if rows:
        best = bits.argmin(1)
        odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
        for k, b, o in zip(rows, best, odds, strict=True):
            lang[k], score[k] = model.languages[b], 1.0 / o
    return lang, score


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score appended."""
    docs = without(docs, "lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, lang_score double"])
    names = [*docs.columns, "lang_pred", "lang_score"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            column = batch.column(names.index(text_column))
            column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
            step = max(1, batch.num_rows * (1 << 18) // max(column.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lang, score = predict(column.slice(at, step).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=names
                )

    return docs.mapInArrow(lean(run), schema)


def keep(docs: DataFrame, model: Model, limit: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of docs in a learned language, told with at least `limit`, with their columns."""
    shared, where = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_column)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            column = batch.column(where).cast(pa.binary())
            step = max(1, batch.num_rows * (1 << 18) // max(column.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                lang, score = predict(column.slice(at, step).to_pylist(), shared.value)
                good = [la != "und" and s >= limit for la, s in zip(lang, score, strict=True)]
                yield batch.slice(at, step).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def may_learn(mod: int, held: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != held


def language_of(docs: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """Fits on the rows that are not held out and predicts every row."""
    model = fit(docs.filter(may_learn(mod, held)))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (~may_learn(mod, held)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
