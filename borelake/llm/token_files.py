"""Token ids in files of Simple-8b words.

A folder of ids is a Parquet table with one row for each block of whole
documents, so any Spark reader can reach it.  Its columns:

    shard, block   place of the block: shards are in ascending order of doc_id
    first          ids of the same shard that stand before the block
    doc_ids        ids of the block's documents, in order
    doc_tokens     how many token ids each has, the end id included
    groups         for each group of 256 ids, the number of its first word
    words          little-endian unsigned 64-bit words

The upper 4 bits of a word are its selector s; the lower 60 hold COUNTS[s] ids
of 60 // COUNTS[s] bits each, the first id lowest.  Selector ESCAPE says that
the next word is one whole id of more than 60 bits.  Each group begins with a
word of its own, so groups are coded and decoded side by side; ids past a
group's end are zero.

Defined results: a null or empty text has the end id alone; null doc_ids come
first; documents of equal id are in the order of their texts; no documents give
a folder without blocks; other columns are ignored; a document longer than
BLOCK ids makes a longer block.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.llm.bpe import ChunkedEncoder, byte_letters, tokenizer_source
from borelake.llm.buckets import parted, returned
from borelake.shared import new_folder

#: Ids in a word, by selector (fixed values of the format).
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
ESCAPE = 14
GROUP = 256
BLOCK = 1 << 18
#: Chunks of text whose ids a worker remembers.
REMEMBERED = 600_000
_WIDE = np.uint64(1) << np.uint64(60)
_BITS = 60 // COUNTS


def _most(ids: np.ndarray) -> np.ndarray:
    """How many ids as wide as each a word can hold."""
    most = np.ones(len(ids), np.int8)
    for count, bits in zip(COUNTS[::-1], _BITS[::-1], strict=True):
        most[ids < (np.uint64(1) << np.uint64(bits))] = count
    return most


_MOST = _most(np.arange(1 << 16, dtype=np.uint64))


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``ids``, and for each group the number of its first word."""
    ids = np.asarray(ids, np.uint64)
    if not len(ids):
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    rows = -(-len(ids) // GROUP)
    stride = GROUP + int(COUNTS[0])
    grid = np.zeros((rows, stride), np.uint64)
    body = np.zeros(rows * GROUP, np.uint64)
    body[: len(ids)] = ids
    grid[:, :GROUP] = body.reshape(rows, GROUP)
    flat = grid.ravel()
    if int(ids.max()) < len(_MOST):
        most = _MOST[flat.astype(np.uint16)]
    else:
        most = _most(flat)
    best = np.ones(len(flat), np.int8)
    for count in COUNTS[-2::-1]:
        fits = most >= count
        if not fits.any():
            break
        have = 1
        while have < count:  # fits[k]: it holds from k on, for `have` ids
            step = min(have, int(count) - have)
            longer = np.zeros_like(fits)
            np.logical_and(fits[:-step], fits[step:], out=longer[:-step])
            fits, have = longer, have + step
        np.maximum(best, fits.view(np.int8) * np.int8(count), out=best)
    ends = np.minimum(GROUP, len(ids) - GROUP * np.arange(rows))
    base, at, begins = np.arange(rows) * stride, np.zeros(rows, np.int64), np.zeros(len(flat), bool)
    while len(base):
        begins[base + at] = True
        at = at + best[base + at]
        more = at < ends
        base, at, ends = base[more], at[more], ends[more]
    starts = np.flatnonzero(begins)
    count = best[starts]
    words = np.zeros(len(starts), np.uint64)
    for s, c in enumerate(COUNTS):
        own = np.flatnonzero(count == c)
        if len(own):
            shifts = (np.arange(c) * (60 // c)).astype(np.uint64)
            parts = flat[starts[own][:, None] + np.arange(c)] << shifts
            words[own] = np.bitwise_or.reduce(parts, axis=1) | np.uint64(s << 60)
    wide = flat[starts] >= _WIDE
    first = np.searchsorted(starts, np.arange(rows) * stride)
    if wide.any():
        extra = np.cumsum(wide) - wide
        longer = np.empty(len(words) + int(wide.sum()), np.uint64)
        longer[np.arange(len(words)) + extra] = np.where(wide, np.uint64(ESCAPE << 60), words)
        longer[np.flatnonzero(wide) + extra[wide] + 1] = flat[starts[wide]]
        first, words = first + extra[first], longer
    return words, first.astype(np.int32)


def unpack(words: np.ndarray, groups: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` ids that ``pack`` has coded."""
    if not size:
        return np.empty(0, np.uint64)
    s = (words >> np.uint64(60)).astype(np.int64)
    literal = np.zeros(len(words), bool)
    if (s >= ESCAPE).any():  # which words are whole ids: what follows an escape that is no whole id itself
        k = 0
        marks = np.flatnonzero(s == ESCAPE)
        for k in marks.tolist():
            if not literal[k]:
                literal[k + 1] = True
    count = np.append(COUNTS, 0)[np.where(literal, len(COUNTS) - 1, np.minimum(s, ESCAPE))]
    before = np.cumsum(count) - count
    rows = len(groups)
    group = np.repeat(np.arange(rows), np.diff(np.append(groups, len(words))))
    start = before - before[groups][group] + group * GROUP
    end = np.minimum((group + 1) * GROUP, size)
    out = np.zeros(rows * GROUP, np.uint64)
    for k, c in enumerate(COUNTS):
        own = np.flatnonzero((s == k) & ~literal)
        if len(own):
            bits = 60 // int(c)
            shifts = (np.arange(c) * bits).astype(np.uint64)
            values = (words[own][:, None] >> shifts) & ((np.uint64(1) << np.uint64(bits)) - np.uint64(1))
            places = start[own][:, None] + np.arange(c)
            inside = places < end[own][:, None]
            out[places[inside]] = values[inside]
    out[start[literal]] = words[literal]
    return out[:size]


_encoders: dict[str, ChunkedEncoder] = {}


def library_encoder(source: str) -> ChunkedEncoder:
    """Encodes with the tokenizers library; a worker makes it once."""
    if source not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(source)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        added = [a["content"] for a in json.loads(source).get("added_tokens", [])]
        letters = {b: c for c, b in byte_letters().items()}
        model = tokenizer.model.tokenize

        def many(texts: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        def words(stems: list[str]) -> list[bytes]:
            """Letters after a space are one piece, so the library's model takes them as they are, in the letters that stand for bytes."""
            if not stems:
                return []
            spelled = (" " + "\n ".join(stems)).encode().decode("latin-1").translate(letters).split(letters[10])
            return [array("I", [x.id for x in model(w)]).tobytes() for w in spelled]

        _encoders.clear()
        _encoders[source] = ChunkedEncoder(many, words, added, REMEMBERED)
    return _encoders[source]


BLOCKS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("doc_tokens", T.ArrayType(T.LongType())),
    T.StructField("groups", T.ArrayType(T.IntegerType())), T.StructField("words", T.BinaryType()),
])
_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("groups", pa.list_(pa.int32())), ("words", pa.binary()),
])


def write(docs: DataFrame, path: str, source: str, end_id: int | None = 2, block: int = BLOCK) -> None:
    """Encode ``docs`` (doc_id, text) and write their ids to the new folder ``path`` in ascending order of doc_id.

    Ranges of doc_id are the shards; each is sorted by Spark and coded block by
    block, so a task holds one block.
    """
    sent = docs.sparkSession.sparkContext.broadcast(source)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = library_encoder(sent.value), TaskContext.get().partitionId()
        number, first, held = 0, 0, 0
        names: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            nonlocal number, first, held
            words, groups = pack(np.concatenate(parts))
            row = [[shard], [number], [first], [held], [pa.concat_arrays(names)], [np.concatenate(sizes)], [groups], [words.astype("<u8").tobytes()]]
            number, first, held = number + 1, first + held, 0
            for x in (names, sizes, parts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

        for batch in parted(batches, "text"):
            ids, ends = encoder.encode(batch.column("text"))
            if end_id is not None:
                ids = np.insert(ids, ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
            begin = 0
            while begin < len(ends):  # up to the document with which the block is full
                before = int(ends[begin - 1]) if begin else 0
                stop = min(int(np.searchsorted(ends, before + block - held)), len(ends) - 1) + 1
                names.append(batch.column("doc_id").slice(begin, stop - begin))
                sizes.append(np.diff(ends[begin:stop], prepend=before))
                parts.append(ids[before : int(ends[stop - 1])])
                held += int(ends[stop - 1]) - before
                begin = stop
                if held >= block:
                    yield closed()
        if names:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(returned(coded), BLOCKS).write.option("compression", "zstd").parquet(path)


READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a folder: doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit integers).

    What goes to the driver is one total for each shard.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before, at = {}, 0
    for row in totals:
        before[row["shard"]], at = at, at + row["n"]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["doc_tokens"], np.int64)
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.array(row["groups"], np.int64), int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                raw = ids.tobytes()
                parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                starts = before[row["shard"]] + row["first"] + ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(sizes), pa.array(parts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(returned(decoded), READ)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to files and read from them again, with a checksum of what was read."""
    import public_tokenizers

    path = new_folder(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_source(public_tokenizers.path("byte_bpe_50k.json")))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op2_token_files": op2_token_files}
SQL: dict = {}
