"""Near-duplicates by the Jaccard similarity of shingle sets.

Words and hashes are those of ``simhash``; a document is the set of its shingles
of ``SHINGLE`` words (a text of fewer words is one shingle, one of no words the
empty set).  Documents of equal set are one class; classes link if their sets
have a similarity of at least 0.8.

Candidates come from two places. Fingerprints of the sets, by operator 7's
generalised pigeonhole, link classes that differ by at most ``DISTANCE`` of 64 bits
(``by_fingerprint``). Most sets of similarity 0.8 are further apart than the
pigeonhole can reach with partitions that tell documents apart, so candidates also
share one of ``BANDS`` bands of ``ROWS`` minima of linear hashes.  A
pair of similarity s is missed by all bands with a chance of about
(1 - s^ROWS)^BANDS, 5 in 100,000 at 0.8 and less above.  Every link is verified on
the sets.  First each bucket's classes are verified against its smallest; then
all pairs of a bucket that this leaves in different groups are, unless their
sizes or bitmaps rule them out.  A group of very many near copies so takes one
comparison for each, not one for each pair.  Both bounds lose nothing: sets of
this similarity differ by at most (m + n) / 9 shingles, and parities of counts by
bits of the hash differ in no more places than the sets.

Cases are defined as in ``simhash.near_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.llm import simhash
from borelake.llm.buckets import compare, returned, sliced
from borelake.llm.simhash import LINK, SEED, shingle_hashes
from borelake.operators.components import components
from borelake.shared import settle, stored, written

SHINGLE = 5
BANDS, ROWS = 25, 5
#: Bits in which fingerprints differ at most that the pigeonhole finds.
DISTANCE = 4
#: Longs of a bitmap.
WIDTH = 16
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = _RNG.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def named(hashes: np.ndarray) -> int:
    """The class of a set, as a signed 64-bit integer."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def banded(hashes: np.ndarray) -> np.ndarray:
    """A value for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[k : k + 2048, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    odd = np.bincount((hashes % np.uint64(64 * WIDTH)).astype(np.int64), minlength=64 * WIDTH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the sets, sorted, have a similarity of at least 0.8."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


SKETCH = [T.StructField("cls", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, cls, n (size of the set), fp, bands and bits of each row, without a shuffle."""
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *SKETCH])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(x.as_py()) for x in batch.column("text")]
            longs = [pa.array([f(s) for s in sets], pa.list_(pa.int64())) for f in (banded, bitmap)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([named(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([simhash.fingerprint_of(s) for s in sets], pa.int64()), *longs], out.names)

    return docs.select("doc_id", "text").mapInArrow(returned(run), out)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x, y = (batch.column(c) for c in ("x", "y"))
            keep = [similar(np.frombuffer(p.as_py(), "<u8"), np.frombuffer(q.as_py(), "<u8")) for p, q in zip(x, y, strict=True)]
            yield batch.select(LINK.names).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.toDF("b", "y"), "b")
    return with_b.join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(returned(run), LINK)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and hashes (binary, sorted) of the classes ``wanted`` (cls, first)."""
    out = T.StructType([T.StructField("cls", T.LongType()), T.StructField("hashes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([named(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], out.names)

    rows = docs.join(wanted.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
    return rows.mapInArrow(returned(run), out).join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def stars(columns: dict[str, np.ndarray], side: np.ndarray) -> list[pa.Array] | None:
    """A bucket's smallest class with each other one."""
    cls = np.unique(columns["cls"])
    return [pa.array(np.full(len(cls) - 1, cls[0])), pa.array(cls[1:])] if len(cls) > 1 else None


def apart(columns: dict[str, np.ndarray], side: np.ndarray) -> list[pa.Array] | None:
    """Pairs of a bucket in different groups that sizes and bitmaps don't rule out."""
    cls, group, n, bits = columns["cls"], columns["component"], columns["n"], columns["bits"].view(np.uint64)
    if (group == group[0]).all():
        return None
    pairs = []
    for k in range(0, len(cls), 256):
        part = slice(k, k + 256)
        most = (n[part, None] + n[None, :]) / 9
        near = (group[part, None] != group[None, :]) & (cls[part, None] < cls[None, :]) & (np.abs(n[part, None] - n[None, :]) <= most)
        if side.any() and not side.all():
            near &= side[part, None] != side[None, :]
        a, b = np.nonzero(near)
        keep = np.bitwise_count(bits[a + k] ^ bits[b]).sum(axis=1, dtype=np.int64) <= most[a, b]
        pairs.append((cls[a[keep] + k], cls[b[keep]]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    return [pa.array(a), pa.array(b)] if len(a) else None


def by_fingerprint(classes: DataFrame) -> DataFrame:
    """Pairs (a < b) of classes: each with the smallest of its fingerprint, and those of linked fingerprints."""
    least = settle(classes.groupBy("fp").agg(F.min("cls").alias("least")))
    equal = classes.join(least, "fp").filter("cls > least").select(F.col("least").alias("a"), F.col("cls").alias("b"))
    linked = simhash.links(least, DISTANCE).join(least.toDF("a", "_a"), "a").join(least.toDF("b", "_b"), "b")
    return equal.union(linked.select(F.least("_a", "_b"), F.greatest("_a", "_b")))


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified links (a, b) of classes that are similar: of those that the fingerprints link, and so many of those which share a band that all are connected."""
    filed = classes.select("cls", F.posexplode("bands").alias("band", "value"))
    first = settle(by_fingerprint(classes).union(compare(filed, ["band", "value"], "cls", stars, LINK)).distinct())
    met = first.select(F.col("a").alias("cls")).union(first.select("b")).distinct()
    wanted = stored(classes.join(met, "cls").select("cls", "first", "n", "bands", "bits"), "wanted")
    sets = stored(sets_of(docs, wanted), "shingle_sets")
    found = settle(verified(first, sets))
    joined = components(found).withColumnRenamed("node", "cls")
    # written before bands are rows of their own, which would repeat each bitmap
    rows = stored(wanted.join(joined, "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"), "n", "bits", "bands"), "groups")
    rows = rows.select("cls", "component", "n", "bits", F.posexplode("bands").alias("band", "value"))
    rest = compare(rows, ["band", "value"], "cls", apart, LINK, 1024).distinct()
    rest = rest.join(first, ["a", "b"], "left_anti")
    return found.union(settle(verified(rest, sets)))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable) of each row."""
    own = stored(sketches(docs), "sketches")
    classes = written(lambda: own.groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), docs.sparkSession, "classes")
    joined = components(links(docs, classes)).withColumnRenamed("node", "cls")
    group = settle(classes.select("cls", "first").join(joined, "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    ids = group.groupBy("component").agg(F.min("first").alias("component_id"))
    return own.select("doc_id", "cls").join(settle(group.join(ids, "component").select("cls", "component_id")), "cls").select("doc_id", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with all their columns and one document of each group: the one of smallest doc_id."""

    def copies() -> DataFrame:
        found = groups(docs.filter(F.col("doc_id").isNotNull()))
        return found.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays")).filter("stays = 0").select("doc_id")

    gone = written(copies, docs.sparkSession, "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
