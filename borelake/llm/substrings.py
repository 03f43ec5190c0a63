"""Removal of byte strings that an earlier document has, by bucket-pointer refinement.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a
document of smaller doc_id.  Suffixes are sorted only as far as that needs, and
only where a shared string must have one of its anchors:

1. Anchors. Of the hashes of all grams of ``GRAM`` bytes, every window of LENGTH
   bytes has a smallest one; places of smallest hashes are anchors. Equal windows
   have equal anchors, so a shared window is found at an anchor that both
   documents have, about one place in fifteen. An anchor is described by its gram
   and by a hash of its context, the bytes that windows over it can reach.
2. Initial buckets. Anchors are dealt to tasks by gram. Each reader first
   combines what it has read, so that of equal contexts only those of the smallest
   doc_id travel. In a bucket, an anchor whose whole context an earlier document
   has is decided: all of it is removed. Here equality is that of two hashes, of
   48 bits of the gram and more for its part, and 48 bits of the context (a false
   match among n anchors has a chance under n * n / 2**100; the bytes of copies are
   not sent to be compared). Buckets of one document, or of one
   context, are finished. A gram with very many contexts at one reader is not
   sent to one task: a mark is sent, and its anchors go on undecided.
3. Refinement. Undecided anchors fetch the bytes of their contexts. Buckets that
   are still too large are split by the bytes to the left or right that their
   windows must share, again and again. In the others, bucket numbers of 8 bytes
   at every offset are refined by sorting on the pair of numbers at an offset and
   a later one, to 16, 32 and LENGTH bytes, each time with the numbers just made.
   Windows of equal final number are equal; those of a later document are removed.

Texts travel between tasks compressed, and are joined by doc_id and a checksum.
Each step's shuffle files and tables go when the next table is written: anchors,
then contexts (written only for buckets that are split), then texts for the cut.

Defined results
    null or empty text        has no bytes
    texts shorter than LENGTH have no strings and lose nothing
    null doc_id               its text is left as it is and removes nothing
    repeated doc_ids          documents of equal doc_id don't remove from each other
    repeated rows             each row gets its row; all are cut alike
    no documents              no rows
    further columns           ignored by ``spans``; kept by ``cut`` and ``dedup``
    a cut inside a character  ``cut`` gives bytes; ``dedup`` drops what is left of the character
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.llm.buckets import returned, sliced, whole_groups
from borelake.shared import settle, stored, written

LENGTH = 50
GRAM = 20
REACH = LENGTH - GRAM
#: Bytes of text that a reader combines at a time, and that are hashed at a time.
CHUNK, PIECE = 12 << 20, 1 << 19
#: Bytes of text whose anchors are a part, bytes of packed anchors that a task holds of a part, and bytes of text for each task.
PART_BYTES, HELD_BYTES, TASK_BYTES = 4 << 20, 32 << 20, 1 << 29
#: Contexts of one gram at one reader beyond which its anchors go on undecided, and anchors of a bucket beyond which it is split.
MANY, LARGE = 256, 50_000
_PAD = b"\xff" * (LENGTH + GRAM)  # never part of UTF-8
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LOW48 = np.uint64((1 << 48) - 1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place."""
    size = len(raw) - GRAM + 1

    def eight(offset: int) -> np.ndarray:
        return np.ndarray((size,), "<u8", raw.data, offset=offset, strides=(1,))

    h = eight(0) * _MIX[0]
    for offset, mix in ((8, _MIX[1]), (GRAM - 8, _MIX[2])):
        h ^= h >> np.uint64(29)
        h += eight(offset) * mix
        h *= _MIX[0]
    return h ^ (h >> np.uint64(32))


def _over(f, x: np.ndarray, width: int) -> np.ndarray:
    """f of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x, have = f(x[:-step], x[step:]), have + step
    return x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of at least LENGTH bytes: gram and context hashes of the anchors, the number of their text, and their place in it."""
    raw = np.frombuffer(_PAD + _PAD.join(texts) + _PAD, np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = len(_PAD) + np.cumsum(sizes + len(_PAD)) - sizes - len(_PAD)
    h = gram_hashes(raw)
    inside = np.zeros(len(h) + 1, np.int8)
    inside[starts] += 1
    inside[starts + sizes - LENGTH + 1] -= 1
    width = REACH + 1
    least = _over(np.minimum, h, width)
    least[np.cumsum(inside, dtype=np.int8)[: len(least)] == 0] = 0
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_over(np.maximum, np.concatenate([edge, least, edge]), width) == h)
    at = at[h[at] > 0]
    context = np.zeros(len(at), np.uint64)
    for offset in range(-REACH, LENGTH, GRAM):  # these grams tile the context
        context = (context ^ h[at + min(offset, LENGTH - GRAM)]) * _MIX[1]
        context ^= context >> np.uint64(31)
    text = np.searchsorted(starts, at, side="right") - 1
    key = h[at] * _MIX[2]
    return key ^ (key >> np.uint64(30)), context, text, at - starts[text]


def _part(key: np.ndarray, bits: int) -> np.ndarray:
    """The part of the grams, out of 2**bits, that a gram belongs to: the upper bits of its hash."""
    return key >> np.uint64(64 - bits)


def _bucket(part: np.ndarray | np.uint64, key: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of a gram: its part, and 48 bits of its hash."""
    return part << np.uint64(64 - bits) | key & _LOW48


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(raw: bytes, kind: str, size: int) -> tuple[np.ndarray, bytes]:
    width = np.dtype(kind).itemsize
    own = np.frombuffer(raw, np.uint8, width * size).reshape(width, size)
    return np.ascontiguousarray(own.T).view(kind).ravel(), raw[width * size :]


def tag_of(raw: bytes) -> int:
    return zlib.crc32(raw) - (1 << 31)


#: A span (start, end) of a document that is decided, or an undecided anchor (start, key).
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tag", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("key", T.LongType())])
#: What readers send to a part of the grams or documents: packed anchors, or a row of FOUND.
SENT = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("anchors", T.BinaryType()), *FOUND.fields])


def pack(key: np.ndarray, context: np.ndarray, hot: np.ndarray, doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> bytes:
    """Anchors that are in order of document. Gram and context keep 48 bits beside the part."""
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))))
    counts = np.diff(np.append(new, len(doc)))
    head = np.array([len(key), len(new)], "<u4").tobytes()
    six = [planes(np.ascontiguousarray(x.astype("<u8")))[: 6 * len(x)] for x in (key & _LOW48, context & _LOW48)]
    return b"".join([head, *six, planes(hot.astype("u1")), planes(at.astype("<u4")), planes(counts.astype("<u4")), planes(np.diff(doc[new], prepend=0).astype("<i8")), planes(tag[new].astype("<i4"))])


def unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    size, docs = np.frombuffer(raw, "<u4", 2).tolist()
    raw = raw[8:]
    pair = []
    for _ in range(2):
        pair.append(unplanes(raw[: 6 * size] + bytes(2 * size), "<u8", size)[0])
        raw = raw[6 * size :]
    hot, raw = unplanes(raw, "u1", size)
    at, raw = unplanes(raw, "<u4", size)
    counts, raw = unplanes(raw, "<u4", docs)
    doc, raw = unplanes(raw, "<i8", docs)
    tag, raw = unplanes(raw, "<i4", docs)
    return *pair, hot.astype(bool), np.repeat(np.cumsum(doc), counts), np.repeat(tag, counts), at


def united(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of documents as disjoint ones that don't touch, in order."""
    if not len(doc):
        return doc, tag, start, end
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    other = np.concatenate(([0], np.cumsum((doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))) << 40
    reach = np.maximum.accumulate(end + other)
    new = np.flatnonzero(np.concatenate(([True], (start + other)[1:] > reach[:-1])))
    last = np.append(new[1:], len(doc)) - 1
    return doc[new], tag[new], start[new], (reach - other)[last]


def _spans(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    doc, tag, start, end = united(doc, tag, start.astype(np.int64), end.astype(np.int64))
    return [pa.array(doc), pa.array(tag), pa.array(start), pa.array(end), pa.nulls(len(doc), pa.int64())]


def _whole(doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Spans of whole contexts; their ends can lie past the text's."""
    at = at.astype(np.int64)
    return _spans(doc, tag, np.maximum(at - REACH, 0), at + LENGTH)


def _asked(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, key: np.ndarray) -> list[pa.Array]:
    return [pa.array(doc), pa.array(tag), pa.array(at.astype(np.int64)), pa.nulls(len(doc), pa.int64()), pa.array(key.view(np.int64))]


def _sent(found: list[pa.Array], bits: int) -> pa.RecordBatch:
    doc = found[0].to_numpy()
    part = doc.view(np.uint64) * _MIX[0] >> np.uint64(64 - bits)
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.nulls(len(doc), pa.binary()), *found], SENT.names)


def _combined(texts: list[bytes], ids: list[int], bits: int, many: int) -> Iterator[pa.RecordBatch]:
    """What a reader sends of some texts."""
    docs, tags = np.array(ids, np.int64), np.array([tag_of(t) for t in texts], np.int32)
    found, begin, held = [], 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= PIECE or k == len(texts) - 1:
            key, context, text, at = anchors(texts[begin : k + 1])
            found.append((key, context, text + begin, at))
            begin, held = k + 1, 0
    key, context, text, at = (np.concatenate(x) for x in zip(*found, strict=True))
    key = _bucket(_part(key, bits), key, bits)
    doc, tag = docs[text], tags[text]
    order = np.lexsort((at, doc, context, key))
    key, context, doc, tag, at = key[order], context[order], doc[order], tag[order], at[order]
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    new = new_key | np.concatenate(([True], context[1:] != context[:-1]))
    first = np.repeat(doc[new], np.diff(np.append(np.flatnonzero(new), len(doc))))
    later = doc > first
    yield _sent(_whole(doc[later], tag[later], at[later]), bits)
    contexts = np.add.reduceat(new, np.flatnonzero(new_key))
    hot = np.repeat(contexts > many, np.diff(np.append(np.flatnonzero(new_key), len(key))))
    on = hot & ~later
    yield _sent(_asked(doc[on], tag[on], at[on], key[on]), bits)
    sent = np.flatnonzero(~later & (~hot | new_key))
    part = _part(key[sent], bits).astype(np.int64)
    order = np.lexsort((at[sent], tag[sent], doc[sent], part))
    sent, part = sent[order], part[order]
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    each = np.split(sent, edges[1:])
    packed = [pack(key[s], context[s], hot[s], doc[s], tag[s], at[s]) for s in each] if len(sent) else []
    n = len(packed)
    yield pa.RecordBatch.from_arrays([pa.array(part[edges[:n]].astype(np.int32)), pa.array(packed, pa.binary()), *(pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], SENT.names)


def first_buckets(docs: DataFrame, many: int = MANY, chunk: int = CHUNK, part_bytes: int = PART_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Rows of FOUND: spans decided by whole contexts, and anchors that are undecided.

    The grams are dealt into as many parts as the texts need at ``part_bytes`` each.  A task
    reads its parts one after the other and holds one, or ``held_bytes`` of packed
    anchors: of a part that has more, each such portion is combined by itself and
    all that it leaves goes on undecided.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    bits = min(max(4 * tasks, size // part_bytes).bit_length(), 24)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, held = [], [], 0
        for batch in sliced(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                if len(raw) >= LENGTH:
                    texts.append(raw)
                    ids.append(doc)
                    held += len(raw)
                if held >= chunk:
                    yield from _combined(texts, ids, bits, many)
                    texts, ids, held = [], [], 0
        if texts:
            yield from _combined(texts, ids, bits, many)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, packed, held, split = None, [], 0, False
        for batch in batches:
            anchors_ = batch.column("anchors")
            yield batch.select(FOUND.names).filter(anchors_.is_null())
            for k in np.flatnonzero(anchors_.is_valid().to_numpy(zero_copy_only=False)).tolist():
                part, raw = batch.column("part")[k].as_py(), anchors_[k].as_py()
                if part != at or held >= held_bytes:
                    more = part == at
                    if packed:
                        yield from decided(at, packed, split or more)
                    at, packed, held, split = part, [], 0, more
                packed.append(raw)
                held += len(raw)
        if packed:
            yield from decided(at, packed, split)

    def decided(part: int, packed: list[bytes], open_: bool) -> Iterator[pa.RecordBatch]:
        key, context, hot, doc, tag, at = (np.concatenate(x) for x in zip(*map(unpack, packed), strict=True))
        order = np.lexsort((doc, context, key))
        key, context, hot, doc, tag, at = (x[order] for x in (key, context, hot, doc, tag, at))
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new = new_key | np.concatenate(([True], context[1:] != context[:-1]))
        at_class, at_key = np.flatnonzero(new), np.flatnonzero(new_key)
        first = np.repeat(doc[at_class], np.diff(np.append(at_class, len(doc))))
        later = doc > first
        yield pa.RecordBatch.from_arrays(_whole(doc[later], tag[later], at[later]), FOUND.names)
        # buckets of several contexts and documents, or known to be common
        on = (np.add.reduceat(new, at_key) > 1) & (np.maximum.reduceat(doc, at_key) > np.minimum.reduceat(doc, at_key)) | np.logical_or.reduceat(hot, at_key) | open_
        # a marked anchor itself has gone on already
        u = np.repeat(on, np.diff(np.append(at_key, len(key)))) & ~later & ~hot
        yield pa.RecordBatch.from_arrays(_asked(doc[u], tag[u], at[u], _bucket(np.uint64(part), key[u], bits)), FOUND.names)

    return rows.mapInArrow(returned(read), SENT).repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(returned(bucket), FOUND)


def packed_texts(docs: DataFrame, name: str = "_packed") -> DataFrame:
    """``docs`` with texts compressed in ``name``, and ``_tag``; ``text`` is dropped."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    out = T.StructType([*rest, T.StructField("_tag", T.IntegerType()), T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches):
            raw = [t.as_py().encode("utf-8", "surrogatepass") if t.is_valid else None for t in batch.column("text")]
            columns = [batch.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([None if r is None else tag_of(r) for r in raw], pa.int32()), pa.array([None if r is None else press.compress(r) for r in raw], pa.binary())], out.names)

    return docs.mapInArrow(returned(run), out)


CONTEXT = T.StructType([T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("tag", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("context", T.BinaryType())])
_WIDTH = LENGTH + REACH


def contexts(docs: DataFrame, asks: DataFrame) -> DataFrame:
    """Undecided anchors with the bytes of their contexts: windows over one can begin ``low`` to ``high`` bytes into them.

    Repeated rows ask for the same: each place is asked for once, and each text is there once.
    """
    asked = asks.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "key")).alias("asks"))
    texts = packed_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")).withColumnRenamed("_tag", "tag")
    texts = texts.groupBy("doc_id", "tag").agg(F.first("_packed").alias("_packed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in sliced(batches):
            for doc, tag, packed, asked_ in zip(*(batch.column(k) for k in ("doc_id", "tag", "_packed", "asks")), strict=True):
                raw = _PAD[:REACH] + press.decompress(packed.as_py()) + _PAD[:LENGTH]
                at, key = (x.to_numpy() for x in asked_.values.flatten())
                n = len(at)
                bytes_ = np.frombuffer(raw, np.uint8)[at[:, None] + np.arange(_WIDTH)]
                flat = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * _WIDTH, _WIDTH, dtype=np.int32)), pa.py_buffer(bytes_.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, REACH, np.int32)), pa.array(key), pa.array(np.full(n, doc.as_py(), np.int64)), pa.array(np.full(n, tag.as_py(), np.int32)), pa.array(at.astype(np.int32)), flat], CONTEXT.names)

    return texts.join(asked, ["doc_id", "tag"]).mapInArrow(returned(_rebatched(run)), CONTEXT)


def _rebatched(run, rows: int = 20_000):
    """``run`` with its many small batches put together."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return whole


def split_large(rows: DataFrame, large: int) -> tuple[DataFrame, list[DataFrame]]:
    """Buckets of at most ``large`` anchors, and those of single windows that are larger.

    Windows that begin at low..high share the bytes from high to low + LENGTH. Of a
    large bucket, the earlier half of the windows shares more to the left and the
    later half more to the right, and each is a bucket by what it shares.
    """
    names, single = ["low", "high", "bucket"], []
    while True:
        big = settle(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > large).drop("_n"))
        if big.isEmpty():
            return rows, single
        small, own = rows.join(big, names, "left_anti"), rows.join(big, names)
        single.append(stored(own.filter("low = high"), "windows"))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = own.filter("low < high").withColumn("_half", F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))))
        halves = halves.drop("low", "high").select("*", "_half.low", "_half.high").drop("_half")
        shared = F.substring(F.hex("context"), 2 * F.col("high") + 1, 2 * (F.col("low") + LENGTH - F.col("high")))
        halves = halves.withColumn("bucket", F.xxhash64("bucket", shared))
        rows = stored(small.unionByName(halves.select(small.columns)), "contexts")


def refined(context: np.ndarray) -> np.ndarray:
    """For each row of bytes and each beginning 0..REACH of a window, the number of its bucket of equal windows."""

    def numbers(pairs: np.ndarray) -> np.ndarray:
        return np.unique(pairs.ravel(), return_inverse=True)[1].reshape(pairs.shape).astype(np.uint64)

    flat = np.ascontiguousarray(context)
    eight = np.ndarray((len(flat), _WIDTH - 7), "<u8", flat.data, strides=(_WIDTH, 1))
    ids, depth = numbers(eight), 8
    while depth < LENGTH:
        later = min(depth, LENGTH - depth)
        ids = numbers(ids[:, :-later] << np.uint64(32) | ids[:, later:])
        depth += later
    return ids


def window_spans(rows: DataFrame) -> DataFrame:
    """doc_id, tag and spans of the windows that an anchor of an earlier document in its bucket has."""
    names = ["low", "high", "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, names):
            edges = np.array(edges)
            size = np.diff(edges)
            group = np.repeat(np.arange(len(size)), size)
            keep = np.flatnonzero(size[group] > 1)
            for k in np.split(keep, np.searchsorted(keep, edges[np.unique(np.searchsorted(edges, np.arange(0, edges[-1], 8_000)))])):
                if len(k):
                    yield pa.RecordBatch.from_arrays(_windows(table.take(pa.array(k)), group[k]), FOUND.names)

    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(returned(run), FOUND)


def _windows(table: pa.Table, group: np.ndarray) -> list[pa.Array]:
    low, high, doc, tag, at = (table.column(k).to_numpy() for k in ("low", "high", "doc_id", "tag", "at"))
    context = np.frombuffer(b"".join(table.column("context").to_pylist()), np.uint8).reshape(-1, _WIDTH)
    begin = np.arange(REACH + 1)
    # the pad never is in a window: it stands before the text's first byte and after its last
    pad = np.cumsum(np.pad(context == 0xFF, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
    usable = (pad[:, LENGTH : LENGTH + REACH + 1] == pad[:, : REACH + 1]) & (begin >= low[:, None]) & (begin <= high[:, None])
    row, column = np.nonzero(usable)
    number = refined(context)[row, column]
    order = np.lexsort((doc[row], number, column, group[row]))
    row, column, number = row[order], column[order], number[order]
    same = (number[1:] == number[:-1]) & (column[1:] == column[:-1]) & (group[row[1:]] == group[row[:-1]])
    new = np.flatnonzero(np.concatenate(([True], ~same))) if len(row) else np.empty(0, np.int64)
    first = np.repeat(doc[row[new]], np.diff(np.append(new, len(row))))
    later = doc[row] > first
    row, column = row[later], column[later]
    start = at[row].astype(np.int64) - REACH + column
    return _spans(doc[row], tag[row], start, start + LENGTH)


def single_spans(rows: DataFrame) -> DataFrame:
    """``window_spans`` of buckets of one window with very many anchors: their smallest doc_id is pre-aggregated and joined back."""
    keyed = rows.withColumn("window", F.substring(F.hex("context"), 2 * F.col("low") + 1, 2 * LENGTH)).filter(~F.col("window").contains("FF") | (F.regexp_instr("window", F.lit("^(..)*FF")) == 0))
    least = settle(keyed.groupBy("low", "bucket", "window").agg(F.min("doc_id").alias("_first")))
    own = keyed.join(least, ["low", "bucket", "window"]).filter(F.col("doc_id") > F.col("_first"))

    start = F.col("at").cast("long") - REACH + F.col("low")
    return own.select("doc_id", "tag", start.alias("start"), (start + LENGTH).alias("end"), F.lit(None).cast("long").alias("key"))


def spans(docs: DataFrame, many: int = MANY, large: int = LARGE, chunk: int = CHUNK, part_bytes: int = PART_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """doc_id, tag (of the text) and a list of spans of the bytes to remove; not for documents that lose none."""
    spark = docs.sparkSession

    def made() -> DataFrame:
        found = written(lambda: first_buckets(docs, many, chunk, part_bytes, held_bytes), spark, "buckets")
        asks = found.filter("key is not null")
        big = settle(asks.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > large).select("key"))
        every = found.filter("key is null")
        if big.isEmpty():
            parts = [window_spans(contexts(docs, asks))]
        else:
            rows, single = split_large(stored(contexts(docs, asks.join(big, "key")), "contexts"), large)
            parts = [window_spans(contexts(docs, asks.join(big, "key", "left_anti"))), window_spans(rows), *map(single_spans, single)]
        for part in parts:
            every = every.union(part)
        return every.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))

    return written(made, spark, "spans")


def _located(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with texts compressed in ``_packed`` and the spans to remove from them in ``_spans``."""
    found = spans(docs, **how).withColumnsRenamed({"doc_id": "_doc_id", "tag": "_of"})
    texts = packed_texts(docs)
    return texts.join(found, (F.col("doc_id") == F.col("_doc_id")) & (F.col("_tag") == F.col("_of")), "left").drop("_doc_id", "_of", "_tag")


def _kept(batch: pa.RecordBatch) -> tuple[list[bytes], list[int], list[int], list[int]]:
    """Of ``_located`` rows: the remaining bytes, and the numbers of bytes, of those removed and of spans."""
    press = zstandard.ZstdDecompressor()
    kept, sizes, removed, runs = [], [], [], []
    for packed, own in zip(batch.column("_packed"), batch.column("_spans"), strict=True):
        raw = press.decompress(packed.as_py()) if packed.is_valid else b""
        start = end = np.empty(0, np.int64)
        if own.is_valid:
            start, end = (x.to_numpy() for x in own.values.flatten())
            none = np.zeros(len(start), np.int64)
            start, end = united(none, none, start, np.minimum(end, len(raw)))[2:]
        at, parts = 0, []
        for b, e in zip(start.tolist(), end.tolist(), strict=True):
            parts.append(raw[at:b])
            at = e
        kept.append(b"".join([*parts, raw[at:]]))
        sizes.append(len(raw))
        removed.append(len(raw) - len(kept[-1]))
        runs.append(len(start))
    return kept, sizes, removed, runs


def cut(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without text, with kept (the remaining bytes), n_bytes, n_removed and n_spans, in place of columns so named."""
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    rest = [f for f in docs.schema.fields if f.name != "text"]
    out = T.StructType([*rest, T.StructField("kept", T.BinaryType()), *(T.StructField(k, T.LongType()) for k in ("n_bytes", "n_removed", "n_spans"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            kept, *counts = _kept(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in counts)], out.names)

    return _located(docs, **how).mapInArrow(returned(run), out)


def dedup(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with all their columns, texts without the removed bytes; a null text stays null.

    Texts are cut and decoded in one pass, so that a task has one worker.
    """
    # columns get other names on the way, so that none clashes with a result
    columns = docs.columns
    names = {c: f"_own_{k}" for k, c in enumerate(columns) if c not in ("doc_id", "text")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            known = batch.column("_packed").is_valid().to_pylist()
            texts = pa.array([k.decode("utf-8", "ignore") if own else None for k, own in zip(_kept(batch)[0], known, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(names.get(c, c)) for c in columns], columns)

    return _located(docs.withColumnsRenamed(names), **how).mapInArrow(returned(run), docs.schema)


def op10_substrings(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes without those of repeated strings, as counts and a digest."""
    done = cut(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_substrings": op10_substrings}
SQL: dict = {}
