"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

The model predicts a word's class from the two words before it, p(class | context), and the word within its class
from its count. Frequent words and the end are classes of their own; other words share the class of their last two
bytes, where p(word | class) is (c + 1) / S, S the sum of c + 1 over the class's training words and one unknown
word. A text's probability is the product over its words and its end, so it is normalised over all known words and
one unknown word for each class.

The class model is log-bilinear: the context vectors of the two words before, each through a matrix of its own, add
up to a predicted vector, whose product with a class's vector plus its bias is the score. It learns by
noise-contrastive estimation from class n-gram counts over every training token, in one pass that takes every count
with its full weight (`rows_of`); the counts' size is bounded by the numbers of classes. One batch of matrix products gives the normalised log-probabilities of every context.

Word counts stay distributed. Words above a count threshold, `HEAD` at most and short ones only, go to every task;
the rest are joined with the words that documents hold, one row for each document and word.

Edge cases: null and empty texts are one end token; with nothing to learn from, classes are equally likely and all
words unknown; rows with one id are scored apart; words of any length are counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import LOWER, batches, binary_text, lean, materialise

HEAD = 200_000
HEAD_WORD_BYTES = 64
TARGET_WORDS, TARGET_ENDINGS = 448, 63
CONTEXT_WORDS, CONTEXT_ENDINGS = 31, 31
#: Classes: targets are the end, words, endings and one for other endings; contexts have the start in place of the end.
TARGETS = 1 + TARGET_WORDS + TARGET_ENDINGS + 1
CONTEXTS = 1 + CONTEXT_WORDS + CONTEXT_ENDINGS + 1
#: Steps are STEPS and those that give each non-zero count a row.
DIMENSION, NOISE, BATCH, STEPS = 24, 128, 2048, 900


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Vocabulary:
    """The words that every task knows, by falling count, and the classes of all words."""

    words: list[bytes]
    counts: np.ndarray
    endings: list[bytes]

    def open(self) -> Vocabulary:
        """Tables for use in a task."""
        self.place = _Places(zip(self.words, range(len(self.words)), strict=True))
        self.ending = {e: k for k, e in enumerate(self.endings)}
        end = np.array([self.ending.get(w[-2:], TARGET_ENDINGS) for w in self.words], np.int64)
        rank = np.arange(len(self.words))
        self.target = np.where(rank < TARGET_WORDS, 1 + rank, 1 + TARGET_WORDS + end)
        self.context = self._context(rank, end)
        return self

    @staticmethod
    def _context(rank: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.where(rank < CONTEXT_WORDS, 1 + rank, 1 + CONTEXT_WORDS + np.minimum(end, CONTEXT_ENDINGS))

    def classes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word its place (-1: not here), and for each word and the end the target class and context."""
        n = len(words)
        place = np.fromiter(map(self.place.__getitem__, words), np.int64, n)
        target, context = np.zeros(n + 1, np.int64), np.zeros(n + 2, np.int64)
        if n and len(self.words):
            target[:n], context[2:] = self.target[place], self.context[place]
        new = np.flatnonzero(place < 0)
        if len(new):
            get = self.ending.get
            end = np.fromiter((get(words[k][-2:], TARGET_ENDINGS) for k in new), np.int64, len(new))
            target[new] = 1 + TARGET_WORDS + end
            context[new + 2] = 1 + CONTEXT_WORDS + np.minimum(end, CONTEXT_ENDINGS)
        return place, target, context[:-1] * CONTEXTS + context[1:]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the texts of docs; counted within a task first."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())}
            )

        for (texts,) in batches(parts, ["text"], 4 << 20):
            for text in texts:
                counts.update(words_of(text))
            if len(counts) > 1_000_000:
                yield packed()
                counts.clear()
        yield packed()

    return (
        docs.select(binary_text().alias("text"))
        .mapInArrow(lean(run), "word binary, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The frequent words: those above the smallest count step that leaves at most HEAD of them."""
    short = counts.filter(F.octet_length("word") <= HEAD_WORD_BYTES)
    step = F.floor(F.log2("n") * 16)
    steps = short.groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("least")).collect()
    total, least = 0, None
    for r in sorted(steps, key=lambda r: -r.s):
        total += r.k
        if total > HEAD:
            break
        least = r.least
    if least is None:
        return Vocabulary([], np.zeros(0, np.int64), [])
    rows = short.filter(F.col("n") >= least).toArrow().to_pydict()
    order = sorted(range(len(rows["n"])), key=lambda k: (-rows["n"][k], rows["word"][k]))
    words = [rows["word"][k] for k in order]
    numbers = np.array([rows["n"][k] for k in order], np.int64)
    endings: Counter = Counter()
    for word, n in zip(words[TARGET_WORDS:], numbers[TARGET_WORDS:].tolist(), strict=True):
        endings[word[-2:]] += n
    return Vocabulary(words, numbers, [e for e, _ in sorted(endings.items(), key=lambda x: (-x[1], x[0]))[:TARGET_ENDINGS]])


def class_counts(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """counts[context, target] of every token of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = CONTEXTS * CONTEXTS * TARGETS

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = shared.value.open(), np.zeros(size, np.int64)
        for (texts,) in batches(parts, ["text"], 4 << 20):
            keys = []
            for text in texts:
                _, target, context = known.classes(words_of(text))
                keys.append(context * TARGETS + target)
            total += np.bincount(np.concatenate(keys), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"key": pa.array(at), "n": pa.array(total[at])})

    rows = docs.select(binary_text().alias("text")).mapInArrow(lean(run), "key long, n long")
    found = rows.groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[found.key.to_numpy()] = found.n.to_numpy()
    return out.reshape(CONTEXTS * CONTEXTS, TARGETS)


class LogBilinear:
    """Scores class w after context (c2, c1) by (C2 r[c2] + C1 r[c1]) . q[w] + b[w]."""

    def __init__(self, unigram: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.parameters = {
            "r": small(CONTEXTS, DIMENSION),
            "c2": np.eye(DIMENSION, dtype=np.float32) + small(DIMENSION, DIMENSION),
            "c1": np.eye(DIMENSION, dtype=np.float32) + small(DIMENSION, DIMENSION),
            "q": small(TARGETS, DIMENSION),
            "b": np.log(unigram).astype(np.float32),
        }
        self.squares = {k: np.full_like(v, 1e-2) for k, v in self.parameters.items()}
        self.noise, self.rng = unigram, rng

    def predicted(self, c2: np.ndarray, c1: np.ndarray) -> np.ndarray:
        p = self.parameters
        return p["r"][c2] @ p["c2"].T + p["r"][c1] @ p["c1"].T

    def log10(self) -> np.ndarray:
        """Normalised log10 p(w | context) of all contexts in one product."""
        c = np.arange(CONTEXTS * CONTEXTS)
        scores = self.predicted(c // CONTEXTS, c % CONTEXTS) @ self.parameters["q"].T + self.parameters["b"]
        scores -= scores.max(1, keepdims=True)
        return ((scores - np.log(np.exp(scores).sum(1, keepdims=True))) / np.log(10)).astype(np.float32)

    def step(self, c2: np.ndarray, c1: np.ndarray, w: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step of noise-contrastive estimation: weighted data against NOISE draws shared by the batch."""
        p, part = self.parameters, weight / weight.sum()
        drawn = self.rng.choice(TARGETS, NOISE, p=self.noise)
        hat = self.predicted(c2, c1)
        shift = np.log(NOISE * self.noise)
        data = np.einsum("ij,ij->i", hat, p["q"][w]) + p["b"][w] - shift[w]
        noise = hat @ p["q"][drawn].T + p["b"][drawn] - shift[drawn]
        g_data = (part / (1 + np.exp(np.clip(data, -30, 30)))).astype(np.float32)
        g_noise = (-part[:, None] / (1 + np.exp(-np.clip(noise, -30, 30)))).astype(np.float32)
        g_hat = g_data[:, None] * p["q"][w] + g_noise @ p["q"][drawn]
        gradient = {k: np.zeros_like(v) for k, v in p.items()}
        one = lambda rows, size: (rows[None, :] == np.arange(size)[:, None]).astype(np.float32)
        of_w, of_drawn = one(w, TARGETS), one(drawn, TARGETS)
        gradient["q"] = of_w @ (g_data[:, None] * hat) + of_drawn @ (g_noise.T @ hat)
        gradient["b"] = of_w @ g_data + of_drawn @ g_noise.sum(0)
        gradient["c2"], gradient["c1"] = g_hat.T @ p["r"][c2], g_hat.T @ p["r"][c1]
        gradient["r"] = one(c2, CONTEXTS) @ (g_hat @ p["c2"]) + one(c1, CONTEXTS) @ (g_hat @ p["c1"])
        for k, g in gradient.items():
            self.squares[k] += g * g
            p[k] += rate * g / np.sqrt(self.squares[k])


def rows_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, weight) of the training rows: each cell at least once, frequent ones in rows of about equal weight; a
    cell's weights add up to its count."""
    n = n.astype(np.float64)
    repeats = np.ceil(n * (STEPS * BATCH / n.sum())).astype(np.int64)
    return np.repeat(np.arange(len(n)), repeats), np.repeat(n / repeats, repeats)


def train(counts: np.ndarray) -> LogBilinear:
    unigram = counts.sum(0) + 1.0
    model = LogBilinear(unigram / unigram.sum())
    at = np.flatnonzero(counts.ravel())
    if not len(at):
        return model
    cell, weight = rows_of(counts.ravel()[at])
    order = model.rng.permutation(len(cell))
    steps = -(-len(cell) // BATCH)
    for k in range(steps):
        some = order[k * BATCH : (k + 1) * BATCH]
        context, w = at[cell[some]] // TARGETS, at[cell[some]] % TARGETS
        model.step(context // CONTEXTS, context % CONTEXTS, w, weight[some], 0.2 * (1 - k / steps) + 0.005)
    return model


def learned_from(mod: int = 7, held: int = 2) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != held


def score(docs: DataFrame, learned: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    spark = docs.sparkSession
    train_docs = docs.filter(learned)
    ends = train_docs.count()
    counts = materialise(word_counts(train_docs))
    known = vocabulary(counts)
    n = (counts.agg(F.sum("n")).first()[0] or 0) + ends
    v = counts.count() + (ends > 0)
    class_model = train(class_counts(train_docs, known))
    first_bin = 1 + TARGET_WORDS
    mass = np.ones(TARGETS)  # one unknown word in each class
    head = spark.sparkContext.broadcast(set(known.words[:TARGET_WORDS]))
    ending = {e: k for k, e in enumerate(known.endings)}

    def bins(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TARGET_ENDINGS + 1, np.int64)
        for words, numbers in batches(parts, ["word", "n"], 4 << 20):
            for word, number in zip(words, numbers, strict=True):
                if word not in head.value:
                    total[ending.get(word[-2:], TARGET_ENDINGS)] += number + 1
        yield pa.RecordBatch.from_pydict({"bin": pa.array(range(len(total)), pa.int32()), "mass": pa.array(total)})

    for r in counts.mapInArrow(lean(bins), "bin int, mass long").groupBy("bin").agg(F.sum("mass").alias("m")).collect():
        mass[first_bin + r.bin] += r.m
    shared = spark.sparkContext.broadcast((known, class_model.log10(), np.log10(mass)))
    log_ends = float(np.log10(ends + 1))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table, log_mass = shared.value
        known.open()
        log_counts = np.append(np.log10(known.counts + 1.0), 0.0)  # the last is for words not here
        binned = np.append(np.arange(len(known.words)) >= TARGET_WORDS, False)
        row, task = 0, TaskContext.get().partitionId()
        for texts, ids, held in batches(parts, ["text", "doc_id", "held_out"], 4 << 20):
            out = []
            for text, doc_id, h in zip(texts, ids, held, strict=True):
                words = words_of(text)
                place, target, context = known.classes(words)
                logs = log_counts[place]
                model = float(table[context, target].sum(dtype=np.float64)) + float(logs[binned[place]].sum())
                model -= float(log_mass[target[target >= first_bin]].sum())
                new = Counter([words[k] for k in np.flatnonzero(place < 0)])
                missing = [{"word": w, "k": k} for w, k in new.items()]
                here = len(words) - sum(new.values())
                out.append(((task << 40) + row, doc_id, h, len(words) + 1, here, float(logs.sum()), model, missing))
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            kinds.append(pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                names="row doc_id held_out n_tokens here logs model missing".split(),
            )

    schema = (
        "row long, doc_id long, held_out boolean, n_tokens long, here long, logs double, model double, "
        "missing array<struct<word:binary,k:bigint>>"
    )
    parts = materialise(
        docs.select(
            F.col("doc_id").cast("long"), (~learned).alias("held_out"), binary_text().alias("text")
        ).mapInArrow(lean(run), schema)
    )
    rest = (
        parts.select("row", F.explode("missing").alias("m"))
        .select("row", "m.word", "m.k")
        .join(counts, "word")
        .groupBy("row")
        .agg(F.sum("k").alias("rare"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("rare_logs"))
    )
    rare, rare_logs = F.coalesce("rare", F.lit(0)), F.coalesce("rare_logs", F.lit(0.0))
    return parts.drop("missing").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("here") + rare + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs + log_ends - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("model") + rare_logs).alias("score"),
    )
