"""Quality scores by a regularised quadratic discriminant.

Each text is described by a few statistics, smoothed and put on a log scale, so
that a short text is near the usual value of what it says little about.  For
each class, the mean and the covariance of the statistics are grouped sums over
all labelled rows that the fold leaves for learning; a covariance is shrunk to
the pooled one and to its own diagonal.  The Cholesky factors are computed once
and sent with the model; a score is the logistic function of the difference of
the two log densities (Mahalanobis distance and log determinant) plus that of
the log frequencies.

Labels only choose which rows are summed for which class; a score depends on the
text and the model alone.

Defined results: a null text counts as empty and is scored like any text; a null
doc_id is held out; a doc_id with several labels counts once for each; labels
other than 0 and 1 are ignored; if a class has fewer than two rows to learn
from, every score is the share of class 1 (0.5 without labels); no documents
give no rows; columns other than doc_id and text are ignored by ``scores`` and
kept by ``keep_good``; very long texts are read whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.llm.buckets import returned, sliced
from borelake.shared import stored

FEATURES = ("symbols", "capitals", "stutter", "repeats", "stops", "word_length")
POOLED = 0.3
DIAGONAL = 0.1
THRESHOLD = 0.3
_USUAL = ".,;:'\"?()-"
#: Kind of each code point below 1,024: 1 letter, 2 capital, 3 symbol, 0 other.
_KIND = np.array([2 if (c := unicodedata.category(chr(k))) == "Lu" else 1 if c[0] == "L" else 3 if c[0] in "SP" and chr(k) not in _USUAL else 0 for k in range(1024)], np.uint8)


def statistics(text: str | None) -> list[float]:
    """Values of FEATURES."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.bincount(_KIND[codes[codes < 1024]], minlength=4)
    letters = kinds[1] + kinds[2] + int((codes >= 1024).sum())
    words = text.split()
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    stutter = int((ids[1:] == ids[:-1]).sum())
    pairs = ids[1:] * (len(number) + 1) + ids[:-1]
    repeats = len(pairs) - len(np.unique(pairs))
    stops = sum(w[-1] in ".,;:?" for w in words)
    return [
        float(np.log((kinds[3] + 1) / (len(codes) + 200))),
        float(np.log((kinds[2] + 4) / (letters + 200))),
        float(np.log((stutter + 0.5) / (len(words) + 50))),
        float(np.log((repeats + 2) / (len(words) + 50))),
        float(np.log((stops + 4) / (len(words) + 30))),
        float(np.log((letters + 150) / (len(words) + 30))),
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of each row, without a shuffle."""
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(f, T.DoubleType()) for f in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = np.array([statistics(t.as_py()) for t in batch.column("text")], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x[:, k]) for k in range(x.shape[1]))], out.names)

    return docs.select("doc_id", "text").mapInArrow(returned(run), out)


@dataclass(frozen=True)
class Model:
    """Of each class: share of rows, mean, the inverse of the Cholesky factor of its covariance, and half its log determinant; or one score for all."""

    shares: tuple[float, float]
    means: np.ndarray | None = None
    inverses: np.ndarray | None = None
    logs: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.shares[1])
        logs = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.inverses[k].T
            logs.append(np.log(self.shares[k]) - 0.5 * (z * z).sum(axis=1) - self.logs[k])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def held_out(doc_id):
    """The fold that is not learned from: rows whose crc32 of doc_id as text is divisible by 5, or without doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(features: DataFrame, labels: DataFrame, label: str = "quality", pooled: float = POOLED, diagonal: float = DIAGONAL) -> Model:
    """A model of the labelled rows of ``features`` that are not held out. Two rows of sums reach the driver."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label")).filter("_label in (0, 1)")
    rows = features.filter(~held_out(F.col("doc_id"))).join(known, "doc_id")
    d = len(FEATURES)
    sums = [F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f) for f in FEATURES)]
    sums += [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i + 1)]
    by = {r["_label"]: r for r in rows.groupBy("_label").agg(*sums).collect()}
    n = [by[k]["n"] if k in by else 0 for k in (0, 1)]
    if min(n) < 2:
        return Model((1 - n[1] / sum(n), n[1] / sum(n)) if sum(n) else (0.5, 0.5))
    means = np.array([[by[k][f] for f in FEATURES] for k in (0, 1)])
    own = np.array([[[by[k][f"c{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)] for k in (0, 1)])
    both = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    factors = []
    for k in (0, 1):
        shrunk = (1 - pooled) * own[k] + pooled * both
        shrunk = (1 - diagonal) * shrunk + diagonal * np.diag(np.diag(shrunk)) + 1e-6 * np.eye(d)
        factors.append(np.linalg.cholesky(shrunk))
    return Model((n[0] / sum(n), n[1] / sum(n)), means, np.linalg.inv(factors), np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1))


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. Texts are read once."""
    features = stored(described(docs), "quality-features")
    model = learn(features, labels, label)
    out = T.StructType([features.schema["doc_id"], T.StructField("score", T.DoubleType())])
    sent = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy() for f in FEATURES])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.scores(x))], ["doc_id", "score"])

    found = features.mapInArrow(returned(run), out)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all their columns, without the rows that score below ``threshold``; each text is judged where it is read."""
    model = learn(stored(described(docs), "quality-features"), labels, label)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = np.array([statistics(t.as_py()) for t in batch.column("text")], np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(sent.value.scores(x) >= threshold))

    return docs.mapInArrow(returned(run), docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op6_quality": op6_quality}
SQL: dict = {}
