"""SimHash near-duplicates by generalised pigeonhole.

A document's fingerprint has a bit set if over half of its shingles' hashes have
it.  Documents of equal fingerprint are one class; distinct fingerprints link if
at most ``distance`` bits differ.  To find links, the 64 bits are grouped into m
partitions, correlated bits together, and partition i gets a threshold t_i of at
least -1 such that the thresholds add up to ``distance`` - m + 1.  Two linked
fingerprints then differ by at most t_i bits in some partition i: each is filed
under its own value of every partition with t_i >= 0, and probes the values
within t_i.  m and the thresholds come from a dynamic programme over estimated
numbers of candidates and probes; they change the work, never the result.
All candidates are verified on all 64 bits.

Words: A-Z lower-cased, then runs of characters that are no white space of
ASCII.  A shingle is ``shingle`` words joined by spaces, repeats included; a text of
fewer words is one shingle; a text of no words has fingerprint zero, which links
like any other.  A hash is XXH64 of the UTF-8 bytes with seed 42.

Defined results
    null or empty text         fingerprint zero
    null doc_id                has a fingerprint and its group's id; never a group's
                               id unless all of it are null, when that is null;
                               ``near_dedup`` keeps such rows and leaves them out of groups
    repeated rows or doc_ids   each row gets a row; in ``near_dedup`` rows of one
                               doc_id are one document and stay or go together
    no documents               no rows
    further columns            ignored by ``groups``; kept by ``near_dedup``
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.llm.buckets import compare, forest, returned, sliced
from borelake.operators.components import components
from borelake.shared import settle, stored

BITS = 64
SEED = 42
#: What a filed or probed row costs against one comparison, for the choice of partitions.
ROW_COST = 100.0
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], "<u8")


def fingerprint(text: str | None, size: int) -> int:
    """The fingerprint as a signed 64-bit integer."""
    return fingerprint_of(shingle_hashes(text, size))


def fingerprint_of(hashes: np.ndarray) -> int:
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (signed 64-bit) of each row, without a shuffle."""
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [fingerprint(x.as_py(), shingle) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(returned(run), out)


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each two bits are set; 64 x 64 sums reach the driver."""
    out = T.StructType([T.StructField("n", T.LongType()), T.StructField("both", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = bits_of(batch.column(0).to_numpy()).astype(np.float64)
            n, both = n + len(x), both + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([both.astype(np.int64).ravel().tolist()], pa.list_(pa.int64()))], ["n", "both"])

    each = fps.select("fp").mapInArrow(returned(run), out).select("n", F.posexplode("both").alias("at", "both"))
    sums = each.groupBy("at").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for row in sums:
        both[row["at"]] = row["both"]
    return (int(sums[0]["n"]) if sums else 0), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size: each bit goes where it is most correlated with what is there."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    sizes = [BITS // m + (k < BITS % m) for k in range(m)]
    left, groups = set(range(BITS)), []
    for size in sizes:
        rest = sorted(left)
        group = [max(rest, key=lambda b: (corr[b, rest].max(), -b))]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (corr[b, group].sum(), -b)))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def expected_shares(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ by at most 0, 1, ... ``most`` of these bits; a bit that others tell counts for less."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    chance = np.zeros(most + 1)
    chance[0] = 1
    for k, b in enumerate(group):
        told = max((((both[b, o] / n - p[b] * p[o]) / (spread[b] * spread[o])) ** 2 for o in group[:k]), default=0)
        differ = 2 * p[b] * (1 - p[b]) * (1 - min(1, told))
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
    return np.cumsum(chance).tolist()


def thresholds(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Groups of bits and their thresholds, of least estimated work."""
    best: tuple[float, list] = (np.inf, [])
    for m in range(1, distance + 2):
        groups = group_bits(n, both, m)
        # cheapest way to spend each sum of thresholds on the groups so far
        ways: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            shares = expected_shares(n, both, group, distance)
            costs = {-1: 0.0} | {t: ROW_COST * n * sum(comb(len(group), k) for k in range(t + 1)) + n * n / 2 * shares[t] for t in range(distance + 1)}
            longer: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, chosen) in ways.items():
                for t, more in costs.items():
                    if cost + more < longer.get(total + t, (np.inf,))[0]:
                        longer[total + t] = (cost + more, [*chosen, t])
            ways = longer
        cost, chosen = ways[distance - m + 1]
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


FILED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("value", T.LongType()), T.StructField("probe", T.BooleanType()), T.StructField("fp", T.LongType())])
LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def filed(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """Each fingerprint under its value of every partition, and as a probe under the greater values within the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            bits = bits_of(fps).astype(np.int64)
            for part, (group, t) in enumerate(plan):
                value = (bits[:, group] << np.arange(len(group))).sum(axis=1)
                for k in range(t + 1):
                    for flips in combinations(range(len(group)), k):
                        other = value ^ sum(1 << f for f in flips)
                        own = np.flatnonzero(other > value) if k else np.arange(len(fps))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, np.int32)), pa.array(other[own]), pa.array(np.full(len(own), k > 0)), pa.array(fps[own])], FILED.names)

    return fps.select("fp").mapInArrow(returned(run), FILED)


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all that differ by at most ``distance`` bits: a spanning forest of each bucket."""
    n, both = bit_counts(fps)
    if n < 2:
        return fps.sparkSession.createDataFrame([], LINK)

    def kernel(columns: dict[str, np.ndarray], side: np.ndarray) -> list[pa.Array] | None:
        fp, probe = columns["fp"], columns["probe"].astype(bool)
        if probe.all():
            return None
        linked = np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None, :]) <= distance
        linked &= ~(probe[:, None] & probe[None, :])
        if side.any() and not side.all():
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, False)
        a, b = forest(linked)
        return [pa.array(fp[a]), pa.array(fp[b])] if len(a) else None

    return compare(filed(fps, thresholds(n, both, distance)), ["part", "value"], "fp", kernel, LINK)


def groups(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) of each row."""
    own = stored(fingerprints(docs, shingle), "fingerprints")
    classes = settle(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(links(classes, distance)).withColumnRenamed("node", "fp")
    named = classes.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = settle(named)
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    found = settle(named.join(ids, "component").select("fp", "component_id"))
    return own.join(found, "fp")


def near_dedup(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with all their columns and one document of each group: the one of smallest doc_id."""
    found = groups(docs.filter(F.col("doc_id").isNotNull()), shingle, distance)
    gone = settle(found.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays")).filter("stays = 0").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
SQL: dict = {}
