"""Near-duplicate vectors by a pivot-permutation index.

A bounded sample of at most ``sample`` vectors gives reference points, each chosen
as far as possible from those before it: 128, or two times the root of the number
of vectors if that is more, and half the sample at most (so up to 16 million vectors
lists grow with the root of their number).  Every vector is described
by its ``PREFIX`` nearest pivots, and filed, by number and pivots alone, in
inverted lists of pairs of them, within its label and length.  Two vectors that
share ``SHARED`` pivots meet in a list of two that stand at most ``GAP`` apart among the
eight, sorted by number, of both: the three gaps between four shared pivots add up
to at most 7 on either side, so one pair has 4 on both sides together.

In a list the shared pivots of all pairs are counted first, as a product of 0/1
matrices.  Only vectors that share enough with another one fetch their components,
and only these pairs, each in the first list that both are in, are verified by the
cosine in double precision.  All vectors are filed; the sample only places the
pivots.  Equal vectors of a label are one class and are counted, not paired.

Defined results
    null label; null, empty or zero vector;
    null or non-finite component             links with nothing
    vectors of different length              never link
    null vec_id                              counts as a link of others; its own row
                                             has its class's ids and is not kept
    repeated rows                            are other vectors, with cosine 1
    no vectors                               no rows
    further columns                          ignored by ``near_links``; kept by ``near_dedup``
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.llm.buckets import forest, per_group, split
from borelake.operators.components import components
from borelake.shared import stored

PREFIX = 8
SHARED = 4
#: Vectors that the pivots are chosen from; they are held by the driver (50 MB at 384 components).
SAMPLE = 16_384
#: Sorted by number, two of four pivots that two lists of eight share stand at most so far apart in both.
GAP = 3


def farthest(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows of unit length, each with the smallest greatest cosine to those before it."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        k = int(near.argmin())
        if near[k] > 1 - 1e-9:
            break
        chosen.append(k)
        near = np.maximum(near, sample @ sample[k])
    return sample[chosen]


def pivots_of(classes: DataFrame, count: int, sample: int) -> dict[int, np.ndarray]:
    """Pivots for each length of vector among ``sample`` classes chosen by hash."""
    rows = classes.select("vector").orderBy(F.xxhash64("rep"), "rep").limit(sample).toArrow().column("vector").combine_chunks()
    sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes).tolist():
        own = rows.filter(pa.array(sizes == size)).flatten().to_numpy().reshape(-1, size)
        out[size] = farthest(unit(own), count)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector, and two hashes of it, of the rows that can link."""
    v = F.col("embedding").cast("array<double>")
    good = F.col("label").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", "label", v.alias("vector")).filter(good).withColumns({"_h": F.xxhash64("vector"), "_g": F.xxhash64(F.lit(1), "vector")})


def classes_of(vectors: DataFrame) -> tuple[DataFrame, list[str]]:
    """Distinct usable vectors of each label: rep (a number), first (smallest vec_id), copies; and the columns that tell them apart.

    These are the label and two hashes, so that copies don't send vectors around; if two
    vectors have both hashes in common, it is the vector itself.
    """
    rows = usable(vectors)
    for keys in (["label", "_h", "_g"], ["label", "vector"]):
        found = [F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")]
        if keys[-1] == "_g":
            found += [F.min("vector").alias("vector"), F.max("vector").alias("_other")]
        else:
            found += [F.first("_h").alias("_h"), F.first("_g").alias("_g"), F.first("vector").alias("_other")]
        grouped = rows.groupBy(*keys).agg(*found)
        if keys[-1] != "_g":
            grouped = grouped.withColumn("_other", F.col("vector"))
        made = stored(grouped.withColumn("rep", F.monotonically_increasing_id()), "vectors")
        if made.filter("vector <> _other").isEmpty():
            break
    return made.drop("_other"), keys


def pivots_for(n: int, sample: int) -> int:
    return min(max(128, int(2 * n**0.5)), sample // 2)


def lists_of(near: np.ndarray, pivots: int) -> np.ndarray:
    """The lists of each row of sorted pivots."""
    if near.shape[1] < 2:
        return near.astype(np.int64)
    pairs = [(i, j) for i in range(near.shape[1]) for j in range(i + 1, min(i + 1 + GAP, near.shape[1]))]
    return np.stack([near[:, i].astype(np.int64) * pivots + near[:, j] for i, j in pairs], axis=1)


def candidates(near: np.ndarray, side: np.ndarray, key: int, pivots: int, shared: int) -> np.ndarray:
    """Pairs (i < j) of rows of sorted pivots that share enough of them, and whose first common list is ``key``."""
    used, place = np.unique(near, return_inverse=True)  # of all pivots only those of the list
    has = np.zeros((len(near), len(used)), np.float32)
    has[np.arange(len(near))[:, None], place.reshape(near.shape)] = 1
    close = has @ has.T >= min(shared, near.shape[1])
    if side.any() and not side.all():
        close &= side[:, None] != side[None, :]
    i, j = np.nonzero(close)
    i, j = i[i < j], j[i < j]
    if not len(i):
        return np.stack([i, j])
    lists = lists_of(near, pivots)
    keep = np.empty(len(i), bool)
    for k in range(0, len(i), 1 << 14):
        a, b = lists[i[k : k + (1 << 14)]], lists[j[k : k + (1 << 14)]]
        both = (a[:, :, None] == b[:, None, :]).any(axis=2)
        keep[k : k + len(a)] = np.where(both, a, np.iinfo(np.int64).max).min(axis=1) == key
    return np.stack([i[keep], j[keep]])


def near_links(vectors: DataFrame, cosine: float = 0.98, pivots: int | None = None, shared: int = SHARED, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame, list[str]]:
    """Classes of equal vectors, rows (a, b, n) of their links, and what tells classes apart.

    The links are a spanning forest of each list, as rows with a, b and no n, and for
    each class a linked in it the copies n of the classes it links with.
    """
    classes, keys = classes_of(vectors)
    spark = classes.sparkSession
    points = pivots_of(classes, pivots or pivots_for(classes.count(), sample), sample)
    sent = spark.sparkContext.broadcast(points)
    counts = {size: len(x) for size, x in points.items()}
    own = classes.select("rep", "label", "copies", "vector")
    seen_type = T.StructType([*own.schema.fields, T.StructField("size", T.IntegerType()), T.StructField("near", T.ArrayType(T.IntegerType()))])

    def described(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column("vector")).to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = unit(part.column("vector").flatten().to_numpy().reshape(-1, size))
                known = sent.value.get(size)
                if known is None:  # a length that the sample lacks has one list
                    near = np.zeros((len(x), 1), np.int32)
                else:
                    near = np.sort(np.argsort(-(x @ known.T), axis=1, kind="stable")[:, :PREFIX], axis=1).astype(np.int32)
                columns = [part.column("rep"), part.column("label"), part.column("copies"), rows_of(x), pa.array(np.full(len(x), size, np.int32)), rows_of(near)]
                yield pa.RecordBatch.from_arrays(columns, seen_type.names)

    seen = stored(own.mapInArrow(described, seen_type), "vector-pivots")
    filed_type = T.StructType([*seen.select("rep", "label", "size", "near").schema.fields, T.StructField("list", T.LongType())])

    def filed(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                near = part.column("near").flatten().to_numpy().reshape(part.num_rows, -1)
                for key in lists_of(near, counts.get(size, 1)).T:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key)], filed_type.names)

    dealt = split(seen.select("rep", "label", "size", "near").mapInArrow(filed, filed_type), ["label", "size", "list"], "rep")
    group = ["label", "size", "list", "_low", "_high"]
    asked_type = T.StructType([T.StructField(c, T.LongType()) for c in ("rep", "list", "_low", "_high", "_side")])

    def asked(columns: dict[str, np.ndarray]) -> list[pa.Array] | None:
        pairs = candidates(columns["near"], columns["_side"], int(columns["list"][0]), counts.get(int(columns["size"][0]), 1), shared)
        some = np.unique(pairs)
        return [pa.array(columns[c][some].astype(np.int64)) for c in asked_type.names] if len(some) else None

    wanted = per_group(dealt, group, asked, asked_type).join(seen, "rep")
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])

    def verified(columns: dict[str, np.ndarray]) -> list[pa.Array] | None:
        x, rep, copies = columns["vector"], columns["rep"], columns["copies"]
        i, j = candidates(columns["near"], columns["_side"], int(columns["list"][0]), counts.get(int(columns["size"][0]), 1), shared)
        good = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 12):
            good[k : k + (1 << 12)] = np.einsum("ij,ij->i", x[i[k : k + (1 << 12)]], x[j[k : k + (1 << 12)]]) >= cosine
        i, j = i[good], j[good]
        if not len(i):
            return None
        linked = np.zeros((len(x), len(x)), bool)
        linked[i, j] = linked[j, i] = True
        a, b = forest(linked)
        total = linked @ copies
        some = np.flatnonzero(total)
        return [
            pa.concat_arrays([pa.array(rep[a]), pa.array(rep[some])]),
            pa.concat_arrays([pa.array(rep[b]), pa.nulls(len(some), pa.int64())]),
            pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(total[some].astype(np.int64))]),
        ]

    return classes, per_group(wanted, group, verified, out), keys


def rows_of(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def near_groups(vectors: DataFrame, cosine: float = 0.98, **index) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable)."""
    classes, found, keys = near_links(vectors, cosine, **index)
    found = stored(found, "vector-links")
    joined = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    counted = found.filter("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    named = stored(classes.join(joined, "rep", "left").join(counted, "rep", "left").select(*keys, "first", "copies", F.coalesce("component", "rep").alias("component"), F.coalesce("n", F.lit(0)).alias("n")), "vector-classes")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.join(least, "component").select(*keys, "component_id", (F.col("n") + F.col("copies") - 1).alias("n_links"))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")).withColumns({"_h": F.xxhash64("vector"), "_g": F.xxhash64(F.lit(1), "vector")})
    whole = rows.select("vec_id", *keys).join(of, keys, "left")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))


def near_dedup(vectors: DataFrame, cosine: float = 0.98, **index) -> DataFrame:
    """``vectors`` with all their columns, without those that reach a smaller vec_id by links."""
    gone = stored(near_groups(vectors, cosine, **index).filter("vec_id <> component_id").select("vec_id").distinct(), "vectors-gone")
    return vectors.join(gone, "vec_id", "left_anti").select(*vectors.columns)


def op8_vectors(spark, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings."""
    found = near_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN least USING (vec_id)
"""

QUERIES = {"op8_vectors": op8_vectors}
SQL = {"op8_vectors": OP8_SQL}
