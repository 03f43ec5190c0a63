"""Comparing the rows that share a bucket, whatever its size.

Rows are dealt to tasks by bucket and sorted there; a task compares the buckets
it meets one by one.  A bucket of more than ``block`` rows is split: its rows
get one of n blocks by hash, and each pair of blocks is a group of its own, so
no group has more than about twice ``block`` rows and no task holds more than
one group and one batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.shared import settle

#: Rows of a block; a kernel meets two, so its matrices have at most about 4 * BLOCK**2 cells (8 MB of bytes, 34 MB of longs).
BLOCK = 1024


def split(rows: DataFrame, keys: list[str], by: str, block: int = BLOCK) -> DataFrame:
    """``rows`` dealt to groups of at most about twice ``block``: _low and _high name a bucket's pair of blocks, _side the block of the two.

    All pairs of rows of a bucket meet in one group: those of one block where
    _low = _high, others where their blocks are the two.
    """
    hot = settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block))
    if hot.isEmpty():
        return rows.withColumns({"_low": F.lit(0), "_high": F.lit(0), "_side": F.lit(0)})
    sized = rows.join(hot, keys, "left").withColumn("_blocks", F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int"))
    dealt = sized.withColumn("_own", F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumns({"_low": F.least("_own", "_other"), "_high": F.greatest("_own", "_other"), "_side": (F.col("_own") > F.col("_other")).cast("int")}).drop("_n", "_blocks", "_own", "_other")


def compare(rows: DataFrame, keys: list[str], by: str, kernel: Callable[[dict[str, np.ndarray], np.ndarray], list[pa.Array] | None], out: T.StructType, block: int = BLOCK) -> DataFrame:
    """Rows that ``kernel`` makes of each bucket of at least two rows.

    ``keys`` name a bucket; ``by`` is the column by whose hash large buckets are
    split.  ``kernel(columns, side)`` gets the group's columns as arrays (fixed
    size lists as matrices) and for each row its block's side: it compares all
    pairs if all sides are equal, else only pairs of different sides.
    """
    return per_group(split(rows, keys, by, block), [*keys, "_low", "_high"], lambda columns: kernel(columns, columns["_side"]), out)


def per_group(rows: DataFrame, names: list[str], kernel: Callable[[dict[str, np.ndarray]], list[pa.Array] | None], out: T.StructType) -> DataFrame:
    """Rows that ``kernel`` makes of each group of at least two rows that agree in ``names``; a task holds one group and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, names):
            yield from _made(table, edges[:-1], edges[1:], kernel, out)

    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(returned(run), out)


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Sorted batches as tables of whole groups, and where groups begin and end in them."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        if held is not None and held.num_rows:
            table = pa.concat_tables([held, table]).combine_chunks()
        edges = _edges(table, names)
        held = table.slice(edges[-1])
        if len(edges) > 1:
            yield table.slice(0, edges[-1]), edges
    if held is not None and held.num_rows:
        yield held, [0, held.num_rows]


def _edges(table: pa.Table, names: list[str]) -> list[int]:
    """Where groups begin."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in names:
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new).tolist()


def returned(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives the memory that the task has used back to the system; workers wait for other tasks, beside those of other stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``rows`` rows, so that what is made of texts is sent on before the next are read."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def parted(batches: Iterator[pa.RecordBatch], text: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about ``size`` bytes of the column ``text``, a row at least."""
    for batch in batches:
        bytes_ = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(bytes_) - bytes_) // size
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def array_of(column: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_list(column.type):
        flat = column.combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))
    return column.to_numpy()


def _made(table: pa.Table, begins: list[int], ends: list[int], kernel, out: T.StructType) -> Iterator[pa.RecordBatch]:
    if not any(e - b > 1 for b, e in zip(begins, ends, strict=True)):
        return
    plain = {c: table.column(c).to_numpy() for c in table.column_names if not pa.types.is_list(table.column(c).type)}
    lists = [c for c in table.column_names if c not in plain]
    for b, e in zip(begins, ends, strict=True):
        if e - b > 1:
            made = kernel({c: v[b:e] for c, v in plain.items()} | {c: array_of(table.column(c).slice(b, e - b)) for c in lists})
            if made is not None:
                yield pa.RecordBatch.from_arrays(made, names=out.names)


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric matrix of links, as two arrays of row numbers."""
    waiting = linked.any(axis=1)
    parents, children = [], []
    for root in np.flatnonzero(waiting).tolist():
        if not waiting[root]:
            continue
        waiting[root] = False
        stack = [root]
        while stack:
            at = stack.pop()
            new = np.flatnonzero(linked[at] & waiting)
            if len(new):
                waiting[new] = False
                parents += [at] * len(new)
                children += new.tolist()
                stack += new.tolist()
    return np.array(parents, np.int64), np.array(children, np.int64)
