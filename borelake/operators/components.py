"""Connected components of a graph given as rows of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.shared import settle


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars: each node with the smallest it is joined to here."""
    above: dict = {}

    def top(x):
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    if schema is not None:
        nodes = [x for x in above if top(x) != x]
        for k in range(0, len(nodes), 50_000):
            part = nodes[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, schema.field(0).type), pa.array([top(x) for x in part], schema.field(1).type)], schema=schema)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for each node of ``links``.

    Alternating large and small stars: a round links the larger neighbours of
    each node to its smallest neighbour, then the smaller ones.  The minima of a
    round are pre-aggregated before they are shuffled and written, so that the
    join that spreads them can split a node with very many links.  Rows with a
    null end are ignored; no links give no rows; loops give their node.
    """
    kind = links.schema[a].dataType
    out = T.StructType([T.StructField("v", kind), T.StructField("m", kind)])
    pairs = links.select(F.col(a).alias("v"), F.col(b).alias("m")).filter("v is not null and m is not null")
    loops = settle(pairs.filter("v = m").select("v").distinct())
    now = settle(pairs.filter("v <> m").mapInArrow(_stars, out).distinct())

    def told(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("v", "m"), F.lit(1 << 40)))).first())

    before = told(now)
    while before[0]:
        both = now.union(now.select(F.col("m"), F.col("v"))).toDF("u", "v")
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = settle(both.filter("v > u").join(least, "u").select("v", "m").distinct())
        least = settle(large.groupBy(F.col("v").alias("u")).agg(F.min("m").alias("least")))
        joined = large.withColumnRenamed("v", "u").join(least, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("least").alias("m")), F.struct(F.col("u").alias("v"),
            F.col("least").alias("m")))).alias("x")).select("x.v", "x.m")
        now = settle(small.filter("v <> m").distinct())
        after = told(now)
        if after == before and after[0] == least.count():
            break
        before = after
    roots = now.select(F.col("m").alias("node")).union(loops.select("v")).distinct().join(now.select(F.col("v").alias("node")), "node", "left_anti")
    return now.toDF("node", "component").union(roots.select("node", F.col("node").alias("component")))
