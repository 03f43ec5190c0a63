"""Toxicity by a linear classifier that is held to counterfactuals.

A text is described by the share of its words that have a feature: a word, or
how words begin (3 to 9 letters), so that inflected and compound words count as
their stem. Features are those that tell the labelled classes apart best. The
classifier is logistic, with weights for features as common as they are.

Labelled texts that name groups of people mostly quarrel with them, so a plain
classifier takes the names themselves for a sign. Therefore each sentence of a
labelled text that names a group (IDENTITIES) is written again with the other
terms of its set, and with none, and the squared change of the score is part of
what is minimised. Scores add up over words, so all that is needed of these
sentences is the sum of products of their changes, by pairs of features: a small
table that Spark sums once.

Learning works on at most ``sample`` labelled rows, those of smallest hash of
doc_id; their vectors are written once, and each step of the minimisation (by
limited-memory quasi-Newton) is a job that returns a gradient from each task.
Labels only say which class a row is summed for; a score depends on the text and
the model alone.

Defined results: a null text counts as empty and is scored like any text; a null
doc_id is held out; a doc_id with several labels counts once for each; labels
other than 0 and 1 are ignored; if only one class has rows to learn from, every
score is its label (0.5 without labels); no documents give no rows; columns other
than doc_id and text are ignored by ``scores`` and kept by ``keep_civil``; very
long texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.llm.buckets import returned, sliced
from borelake.shared import stored

THRESHOLD = 0.7
#: Labelled rows that are learned from at most, and features at most (besides those of IDENTITIES).
SAMPLE, FEATURES = 20_000, 2_048
#: Documents that a feature is in at least.
LEAST = 5
#: Weight of the squared changes of score, and of the squared weights.
FAIRNESS, RIDGE = 10.0, 3e-5
#: Words that a text counts as longer, so that one word of a short text isn't all of it.
EXTRA = 20
#: Letters of a beginning.
BEGINS = range(3, 10)
STEPS = 25
#: Terms that can stand for each other in a sentence.
IDENTITIES = (
    ("women", "men"),
    ("woman", "man"),
    ("christians", "jews", "muslims", "hindus", "buddhists", "atheists"),
    ("christian", "jewish", "muslim", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("frauen", "männer"),
    ("christen", "juden", "muslime", "atheisten"),
    ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes"),
    ("chrétiens", "juifs", "musulmans", "athées"),
    ("étrangers", "réfugiés", "immigrés"),
    ("mujeres", "hombres"),
    ("cristianos", "judíos", "musulmanes", "ateos"),
    ("extranjeros", "refugiados", "inmigrantes"),
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features_of(word: str) -> list[str]:
    """What a word counts for: its beginnings, and itself with a mark."""
    return [word[:k] for k in BEGINS if k < len(word)] + [f"{word}$"]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def held_out(doc_id):
    """The fold that is not learned from: rows whose crc32 of doc_id as text leaves 1 when divided by 3, or without doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


@dataclass(frozen=True)
class Model:
    """A weight for each feature, for a share of one in a hundred words, and the score's level."""

    level: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def scores(self, texts: list[str | None], known: dict[str, float] | None = None) -> np.ndarray:
        """Scores of ``texts``; ``known`` keeps words' weights from one call to the next."""
        known = {} if known is None else known
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            words, total = words_of(text), 0.0
            for w in words:
                value = known.get(w)
                if value is None:
                    if len(known) > 200_000:
                        known.clear()
                    value = known[w] = sum(self.weights.get(f, 0.0) for f in features_of(w))
                total += value
            out[k] = self.level + 100 * total / (len(words) + EXTRA)
        return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def _counted(rows: DataFrame) -> DataFrame:
    """feature, and the rows of each class that have it (n0, n1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def made() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in seen)], ["feature", "n0", "n1"])
            for c in seen:
                c.clear()
            return batch

        for batch in sliced(batches):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                seen[y].update({f for w in set(words_of(text)) for f in features_of(w)})
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield made()
        yield made()

    return rows.mapInArrow(returned(run), "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _chosen(rows: DataFrame, n: list[int], most: int, identities) -> list[str]:
    """The features by which the classes differ most surely (log odds by their deviation), and those of identity terms that occur."""
    counts = stored(_counted(rows), "toxicity-counts")
    odds = lambda c, total: F.log((F.col(c) + 0.5) / (total - F.col(c) + 0.5))
    spread = F.sqrt(1 / (F.col("n0") + 0.5) + 1 / (F.col("n1") + 0.5))
    sure = F.abs((odds("n1", n[1]) - odds("n0", n[0])) / spread)
    best = counts.filter(F.col("n0") + F.col("n1") >= LEAST).orderBy(sure.desc(), "feature").limit(most)
    named = sorted({f for terms in identities for t in terms for f in features_of(t)})
    return sorted({r[0] for part in (best, counts.filter(F.col("feature").isin(named))) for r in part.select("feature").collect()})


def _vectors(rows: DataFrame, place: dict[str, int]) -> DataFrame:
    """y, and the numbers and values of a text's features: words in a hundred that have it."""
    sent = rows.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        for batch in sliced(batches):
            numbers, values = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found = Counter()
                for w, c in Counter(words).items():
                    for f in features_of(w):
                        if f in at:
                            found[at[f]] += c
                numbers.append(list(found))
                values.append([100 * c / (len(words) + EXTRA) for c in found.values()])
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(numbers, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["y", "numbers", "values"])

    return rows.select("text", "y").mapInArrow(returned(run), "y int, numbers array<int>, values array<double>")


def changes(text: str | None, swaps: dict[str, list[str]]) -> Iterator[dict[str, float]]:
    """For each sentence, identity term in it and term to stand for it (or none): the changes of its features' values."""
    for sentence in _SENTENCE.split(text or ""):
        words = words_of(sentence)
        for term, times in Counter(w for w in words if w in swaps).items():
            value = 100 * times / (len(words) + EXTRA)
            for other in swaps[term]:
                change = Counter({f: -value for f in features_of(term)})
                for f in features_of(other) if other else ():
                    change[f] += value
                yield {f: v for f, v in change.items() if v}


def _swaps(identities) -> dict[str, list[str]]:
    swaps: dict[str, list[str]] = {}
    for terms in identities:
        for t in terms:
            swaps.setdefault(t, []).extend(["", *(x for x in terms if x != t)])
    return swaps


def _counterfactuals(rows: DataFrame, place: dict[str, int], identities) -> np.ndarray:
    """The mean over swapped sentences of the products of changes, as rows (feature, feature, mean); at most the square of the identity terms' features."""
    swaps, sent = _swaps(identities), rows.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = sent.value, Counter()
        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                for change in changes(text, swaps):
                    sums[-1, -1] += 1
                    own = [(at[f], v) for f, v in change.items() if f in at]
                    for i, v in own:
                        for j, u in own:
                            sums[i, j] += v * u
        if sums:
            i, j = zip(*sums, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([float(v) for v in sums.values()])], ["i", "j", "v"])

    found = np.array(rows.select("text").mapInArrow(returned(run), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).orderBy("i", "j").collect(), np.float64).reshape(-1, 3)
    swapped = found[found[:, 0] < 0, 2].sum()
    found = found[found[:, 0] >= 0]
    found[:, 2] /= max(swapped, 1)
    return found


def _gradient(vectors: DataFrame, w: np.ndarray) -> np.ndarray:
    """Sums over all rows: loss, and its gradient; the level is the last weight. One array of the length of w from each task."""
    sent = vectors.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        total = np.zeros(len(w) + 1)
        for batch in batches:
            numbers, values = batch.column("numbers"), batch.column("values")
            at, x = numbers.flatten().to_numpy(), values.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(numbers.offsets.to_numpy()))
            sign = 2.0 * batch.column("y").to_numpy() - 1
            z = sign * (np.bincount(row, w[at] * x, batch.num_rows) + w[-1])
            slope = -sign / (1 + np.exp(np.clip(z, -700, 700)))
            total[0] += np.logaddexp(0, -z).sum()
            total[1:-1] += np.bincount(at, slope[row] * x, len(w) - 1)
            total[-1] += slope.sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    sums = sum(np.array(r[0]) for r in sorted(vectors.mapInArrow(returned(run), "sums array<double>").collect()))
    sent.destroy()
    return sums


def minimised(of, w: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """Where the convex ``of`` (value and gradient) is smallest, from ``w``, by limited-memory quasi-Newton steps."""
    value, gradient = of(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, shares = -gradient, []
        for s, y in reversed(past):
            shares.append((s @ way) / (y @ s))
            way = way - shares[-1] * y
        if past:
            way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), share in zip(past, reversed(shares), strict=True):
            way = way + s * (share - (y @ way) / (y @ s))
        length = 1.0 if past else min(1.0, 1 / np.abs(gradient).sum())
        while True:
            new, slope = of(w + length * way)
            if new <= value + 1e-4 * length * (gradient @ way) or length < 1e-9:
                break
            length /= 2
        s, y = length * way, slope - gradient
        if y @ s > 1e-12:
            past = [*past, (s, y)][-memory:]
        gain, w, value, gradient = value - new, w + s, new, slope
        if gain <= 1e-5 * max(abs(value), 1e-3):
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, features: int = FEATURES, fairness: float = FAIRNESS, ridge: float = RIDGE, identities=IDENTITIES) -> Model:
    """A model of the labelled rows of ``docs`` that are not held out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("text", "y"), "toxicity-rows")
    by = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n = [by.get(0, 0), by.get(1, 0)]
    if not all(n):
        return Model(0.0 if not any(n) else 700.0 if n[1] else -700.0)
    names = _chosen(rows, n, features, identities)
    place = {f: k for k, f in enumerate(names)}
    vectors = stored(_vectors(rows, place), "toxicity-vectors")
    pairs = _counterfactuals(rows, place, identities)
    i, j = pairs[:, 0].astype(int), pairs[:, 1].astype(int)

    def of(w: np.ndarray) -> tuple[float, np.ndarray]:
        sums = _gradient(vectors, w)
        value, gradient = sums[0] / sum(n), sums[1:] / sum(n)
        apart = np.bincount(i, pairs[:, 2] * w[j], len(w))
        flat = np.append(w[:-1], 0.0)
        return value + fairness * (w @ apart) + ridge * (flat @ flat), gradient + 2 * fairness * apart + 2 * ridge * flat

    w = minimised(of, np.append(np.zeros(len(names)), np.log(n[1] / n[0])), STEPS)
    return Model(float(w[-1]), dict(zip(names, w[:-1].tolist(), strict=True)))


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, **how))
    out = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.scores(batch.column("text").to_pylist(), known))], ["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(returned(run), out)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, **how) -> DataFrame:
    """``docs`` with all their columns, without the rows that score ``threshold`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in sliced(batches):
            yield batch.filter(pa.array(sent.value.scores(batch.column("text").to_pylist(), known) < threshold))

    return docs.mapInArrow(returned(run), docs.schema)


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op11_toxicity": op11_toxicity}
SQL: dict = {}
