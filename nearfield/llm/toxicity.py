"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding: compatibility forms and look-alike letters become Latin letters, invisible characters go, digits and
signs between letters become the letters they stand for, and words are joined by single spaces. Entries are word
beginnings (a space and a prefix), so that one automaton finds whole words and their inflections.

Weights are log-odds over a bounded sample of labelled rows (`SAMPLE_DOCS` for each label, the smallest hashes of
their ids, whole texts, equal texts of a label counted once); an entry needs `EVIDENCE` nats of likelihood ratio, so that chance words of
few documents stay out, and `COVERS` nats over the documents that no stronger entry explains, so that the ordinary
words of copied toxic documents stay out too. Exception phrases are an entry with its neighbour word that clean documents hold and toxic
ones do not, by the same test; a hit inside one does not count. The strength of a text is the sum of its hits'
weights over 1 + log2(1 + words / 1000), and a logistic curve fitted on the sample turns it into the score.

Edge cases: null and empty texts have no hit and get the score of strength 0, below one half; texts of any length are
read whole; repeated rows are scored each for itself; conflicting labels of one id are all used; of equal evidence the
entry that sorts first is taken first; with no labelled toxic row, or no rows at all, nothing is in the lexicon and all
scores are 0; an empty table gives no row. Columns other than doc_id, text and toxic are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import batches, binary_text, lean, without

SAMPLE_DOCS = 4000
EVIDENCE = 10.0
COVERS = 6.0
#: Log-odds that an entry has at least.
WEIGHT = 1.5
PREFIXES = range(4, 13)
#: Features that a task counts before it hands them on; partial counts are added up later.
HELD = 200_000

#: Look-alike letters of other scripts and the Latin letters they imitate.
HOMOGLYPHS = str.maketrans(
    "абвгеёзіїјкморстухһԁԛԝѕαβεηικμνορτυχωϲ",
    "a6breeziijkmopctyxhdqwsaBenikuvoptuxwc".lower(),
    "­​‌‍⁠﻿",
)
#: Digits and signs that stand for letters between letters.
SUBSTITUTES = str.maketrans("013457@$!|", "oieastasil")
_SIGN = re.compile(r"(?<=[^\W\d_])[013457@$!|]+(?=[^\W\d_])|(?<![^\W_])[013457@$]+(?=[^\W\d_])")
_WORD = re.compile(r"\w+")


def folded(text: str) -> str:
    """The words of the text, folded, each with a space before and one after the last."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(HOMOGLYPHS)
    text = _SIGN.sub(lambda m: m[0].translate(SUBSTITUTES), text)
    return f" {' '.join(_WORD.findall(text))} "


def features(text: str) -> set[str]:
    """Word beginnings and whole words (with the space behind) of a folded text."""
    found = set()
    for word in set(text.split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in PREFIXES if n <= len(word))
    return found


def evidence(toxic: float, clean: float, share: float) -> float:
    """Log-likelihood ratio of a feature in `toxic` and `clean` documents against the share of toxic documents."""
    n = toxic + clean
    return sum(x * math.log(x / (n * p)) for x, p in ((toxic, share), (clean, 1 - share)) if x and p)


def _evidence_of(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """evidence() of arrays of counts."""
    n, out = np.maximum(toxic + clean, 1), np.zeros(len(toxic))
    for x, p in ((toxic, share), (clean, 1 - share)):
        if p:
            out += x * np.log(np.where(x > 0, x / (n * p), 1.0))
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 0.0
    bias: float = -math.inf

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        return found


def hits(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the longest entry at each word of a folded text, without those inside exceptions."""
    best: dict[int, tuple[int, float]] = {}
    excused: list[tuple[int, int]] = []
    for last, (length, weight) in automaton.iter(text):
        start = last + 1 - length
        if weight is None:
            excused.append((start, last + 1))
        elif start not in best or length > best[start][0]:
            best[start] = (length, weight)
    excused.sort()
    out, at, reach = [], 0, 0  # reach: how far the exceptions go that have begun
    for s, (n, w) in sorted(best.items()):
        while at < len(excused) and excused[at][0] <= s:
            reach = max(reach, excused[at][1])
            at += 1
        if s + n > reach:
            out.append((s, s + n, w))
    return out


def strength(text: str, automaton: ahocorasick.Automaton | None) -> float:
    if automaton is None:
        return 0.0
    total = sum(w for _, _, w in hits(text, automaton))
    return total / (1 + math.log2(1 + text.count(" ") / 1000)) if total else 0.0


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic), equal rows once: a bounded sample for each label; docs and labels hold only rows to learn from."""
    first = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = labels.filter(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ids = known.distinct().withColumn("n_", F.row_number().over(first)).filter(F.col("n_") <= SAMPLE_DOCS).drop("n_")
    texts = docs.select("doc_id", binary_text().alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("text", "toxic").distinct()


def _per_label(sample: DataFrame, seen_in) -> DataFrame:
    """feature, toxic, clean: in how many sampled documents `seen_in` finds each feature."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            keys = list(toxic.keys() | clean.keys())
            for at in range(0, len(keys), 50_000):
                some = keys[at : at + 50_000]
                yield pa.RecordBatch.from_pydict(
                    {
                        "feature": pa.array(some, pa.string()),
                        "toxic": pa.array([toxic[k] for k in some], pa.int64()),
                        "clean": pa.array([clean[k] for k in some], pa.int64()),
                    }
                )
            toxic.clear()
            clean.clear()

        for text, label in batches(parts, ["text", "toxic"], 1 << 20):
            for t, y in zip(text, label, strict=True):
                (toxic if y else clean).update(seen_in(folded(t.decode())))
                if len(toxic) + len(clean) > HELD:
                    yield from counted()
        yield from counted()

    return (
        sample.mapInArrow(lean(count), "feature string, toxic long, clean long")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def _evidence_column(toxic: str, clean: str, share: float):
    n = F.col("toxic") + F.col("clean")
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * p))).otherwise(0.0)
    return part(toxic, share) + part(clean, 1 - share)


def _covering(sample: DataFrame, weights: dict[str, float], share: float) -> dict[str, float]:
    """The entries that greedily explain the sample: each by the toxic documents that no earlier one matches."""
    entries = sorted(weights)
    automaton = ahocorasick.Automaton()
    for k, entry in enumerate(entries):
        automaton.add_word(entry, k)
    automaton.make_automaton()

    def match(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, label in batches(parts, ["text", "toxic"], 1 << 20):
            found = [sorted({k for _, k in automaton.iter(folded(t.decode()))}) for t in text]
            yield pa.RecordBatch.from_pydict(
                {"entries": pa.array(found, pa.list_(pa.int32())), "toxic": pa.array(label, pa.int32())}
            )

    docs, labels = [], []
    for r in sample.mapInArrow(lean(match), "entries array<int>, toxic int").toLocalIterator():
        if r.entries:
            docs.append(np.asarray(r.entries, np.int32))
            labels.append(r.toxic)
    if not docs:
        return {}
    doc_of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    flat = np.concatenate(docs)
    order = np.argsort(flat, kind="stable")
    doc_of, ends = doc_of[order], np.cumsum(np.bincount(flat, minlength=len(entries)))
    is_toxic = np.asarray(labels) == 1
    a, b = (np.bincount(flat, np.repeat(y, [len(d) for d in docs]), len(entries)) for y in (is_toxic, ~is_toxic))
    left, open_, kept = np.ones(len(docs), bool), np.ones(len(entries), bool), {}
    while open_.any():
        worth = np.where(open_ & (a * (1 - share) > b * share), _evidence_of(a, b, share), 0.0)
        best = int(worth.argmax())
        if worth[best] < COVERS:
            break
        kept[entries[best]] = weights[entries[best]]
        open_[best] = False
        own = doc_of[ends[best - 1] if best else 0 : ends[best]]
        for doc in own[left[own]]:
            (a if is_toxic[doc] else b)[docs[doc]] -= 1
        left[own] = False
    # words that mostly stand beside kept ones explain little alone; they stay if they are as telling as a kept one
    least = min(kept.values(), default=math.inf)
    return kept | {k: w for k, w in weights.items() if w >= least}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(docs, labels).persist()
    try:
        totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        toxic, clean = totals.get(1, 0), totals.get(0, 0)
        if not toxic:
            return Model()
        share = toxic / (toxic + clean) if clean else 0.5
        odds = lambda a, b: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        found = (
            _per_label(sample, features)
            .filter(F.col("toxic") >= 3)
            .withColumn("evidence", _evidence_column("toxic", "clean", share))
            .filter((F.col("evidence") >= EVIDENCE) & (F.col("toxic") > F.col("clean") * toxic / max(clean, 1)))
            .filter(F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1)) > WEIGHT)
            .select("feature", "toxic", "clean")
            .collect()
        )
        weights: dict[str, float] = {}
        for r in sorted(found, key=lambda r: (len(r.feature), r.feature)):
            weight = odds(r.toxic, r.clean)
            if not any(weights.get(r.feature[:n], -1) >= weight for n in range(1, len(r.feature))):
                weights[r.feature] = weight
        if not weights:
            return Model()
        model = Model(_covering(sample, weights, share))
        if not model.weights:
            return Model()
        lexicon = model.automaton()

        def around(text: str) -> set[str]:
            phrases = set()
            for start, end, _ in hits(text, lexicon):
                end = text.index(" ", end - 1 if text[end - 1] == " " else end)
                before, after = text.rfind(" ", 0, start), text.find(" ", end + 1)
                if before >= 0:
                    phrases.add(text[before : end + 1])
                if after >= 0:
                    phrases.add(text[start : after + 1])
            return phrases

        excused = (
            _per_label(sample, around)
            .withColumn("evidence", _evidence_column("toxic", "clean", share))
            .filter((F.col("clean") * toxic > F.col("toxic") * clean) & (F.col("clean") >= 3))
            .filter((F.col("evidence") >= EVIDENCE) | ((F.col("toxic") == 0) & (F.col("clean") >= 8)))
            .collect()
        )
        model.exceptions = sorted(r.feature for r in excused)
        final = model.automaton()

        def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for text, label in batches(parts, ["text", "toxic"], 1 << 20):
                values = [strength(folded(t.decode()), final) for t in text]
                yield pa.RecordBatch.from_pydict({"x": pa.array(values, pa.float64()), "y": pa.array(label, pa.int32())})

        points = sample.mapInArrow(lean(measure), "x double, y int").toPandas()
        model.slope, model.bias = logistic(points.x.to_numpy(), points.y.to_numpy())
        return model
    finally:
        sample.unpersist()


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton steps with a small ridge; strength 0 stays below one half."""
    w = np.zeros(2)
    rows = np.stack([np.log1p(x), np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (p - y) + 1e-2 * w
        hess = (rows * (p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(min(w[1], -1e-3))


def scores(texts: list[bytes | None], model: Model, automaton: ahocorasick.Automaton | None) -> list[float]:
    out = []
    for text in texts:
        x = strength(folded(text.decode()), automaton) if text else 0.0
        z = model.slope * math.log1p(x) + model.bias
        out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
    return out


def annotate(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """docs with toxic_score appended, in place of a column so called; all others pass through."""
    docs = without(docs, "toxic_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "toxic_score double"])
    names = [*docs.columns, "toxic_score"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        automaton = model.automaton()
        for batch in parts:
            column = batch.column(names.index(text_column)).cast(pa.binary())
            values = [scores([t.as_py()], model, automaton)[0] for t in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=names)

    return docs.mapInArrow(lean(run), schema)


def keep(docs: DataFrame, model: Model, limit: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of docs that score below the limit, with their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_column)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in parts:
            step = max(1, batch.num_rows * (1 << 20) // max(batch.column(at).nbytes, 1))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                values = (scores([t.as_py()], shared.value, automaton)[0] for t in part.column(at).cast(pa.binary()))
                yield part.filter(pa.array([v < limit for v in values], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def held_out(mod: int, held: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == held


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> DataFrame:
    """Fits on labelled rows that are not held out and scores every document."""
    model = fit(docs.filter(~held_out(mod, held)), labels.filter(~held_out(mod, held)))
    return annotate(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(mod, held).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )
