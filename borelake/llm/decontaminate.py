"""Benchmark decontamination.

The windows of ``n`` consecutive words of all benchmark items form a hash set
that is broadcast: a sorted array of 64-bit hashes, one for each different window,
with the place of its words and the items that have it.  Document words are
scanned once, in the partitions in which they are read; hashes of all their windows
are sums over the words, a table of bits leaves out nearly all, and what the set
has is compared word by word, so every hit is exact.

Words: A-Z are lower-cased, then each run of characters outside
``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` is a word.  An item of fewer than ``n``
words, but not none, is one window.

Defined results
    null or empty text            no words, no hits, not contaminated
    item without text or words    has no window
    item with null id             its windows hit words, but it is not listed
    repeated rows, repeated ids   each row is judged alone, ids count once
    empty documents or items      no rows, or rows without hits
    further columns               ignored by ``scan``; kept by ``decontaminate``

Memory: a set of b bytes of items takes at most about ``SET_BYTES_PER_BYTE`` * b, by
its arrays' sizes.  One set has at most ``block_bytes`` of items (a longer item is a
set of its own).  A larger benchmark is split into blocks by hash; then each block
is a pass of its own over the documents, whose hits are written before the next
block is built, so no process holds two, and the results don't depend on the size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.llm.buckets import parted, returned
from borelake.shared import stored

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: At one-letter words, a window for each two bytes: its hash, place and items, the table of bits, and the words themselves.
SET_BYTES_PER_BYTE = 32
#: Bytes of documents that are hashed at a time.
PART = 1 << 20
#: Each byte lower-cased, or a space where it is not part of a word. Bytes of 0x80 and above belong to characters that are.
WORD_BYTES = bytes(c if chr(c).isdigit() or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_LETTER = np.frombuffer(WORD_BYTES, np.uint8)
_BYTE_BASE, _WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class _Powers:
    """Powers of an odd number modulo 2**64, and their inverses, as far as they have been asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.up = base, np.ones(1, np.uint64)
        self.down = self.up

    def until(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            more = np.full(max(n, 2 * len(self.up)), self.base, np.uint64)
            more[0] = 1
            self.up = np.cumprod(more)
            more[1:] = np.uint64(pow(int(self.base), -1, 1 << 64))
            self.down = np.cumprod(more)
        return self.up[:n], self.down[:n]


_of_bytes, _of_words = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """A hash of values[starts:ends] for each pair; equal values have equal hashes wherever they stand."""
    up, down = powers.until(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return _mixed((total[ends] - total[starts]) * down[starts])


class Words:
    """The words of some texts: their bytes with one space after each, where each begins and ends in these, their hashes, and where those of each text end."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        letters = _LETTER[raw]
        word = np.zeros(len(letters) + 2, bool)
        word[1:-1] = letters != 32
        border = np.zeros(len(letters) + 1, bool)
        border[at] = True
        first = word[1:-1] & (~word[:-2] | border[:-1])
        last = word[1:-1] & (~word[2:] | border[1:])
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sizes = ends - starts
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes
        self.bytes = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
        kept = np.ones(len(self.bytes), bool)
        kept[self.ends] = False
        self.bytes[kept] = letters[word[1:-1]]
        self.hashes = _sums(self.bytes.astype(np.uint64), self.starts, self.ends, _of_bytes)
        self.bounds = np.searchsorted(starts, at[1:])
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.bounds, prepend=0))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of ``size`` words from each place."""
        first = np.arange(len(self.starts) - size + 1)
        return _sums(self.hashes, first, first + size, _of_words)


class WindowSet:
    """The windows of some items: sorted hashes of different windows by length, and for each its first word and its items."""

    def __init__(self, items: list[tuple[object, str | None]], n: int = WINDOW):
        self.names = [None if item is None else str(item) for item, _ in items]
        self.words = Words(pa.array([text for _, text in items], pa.string()))
        counts = np.diff(self.words.bounds, prepend=0)
        own = np.minimum(counts, n)[self.words.text]
        left = self.words.bounds[self.words.text] - np.arange(len(self.words.text))
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(own).tolist():
            place = np.flatnonzero((own == size) & (left >= size))
            hashes = self.words.windows(size)[place]
            order = np.lexsort((place, hashes))
            hashes, place = hashes[order], place[order]
            # of equal hashes, windows of other words stay apart (compared with the one before)
            same = np.zeros(len(place), bool)
            equal = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
            same[equal] = _agree(self.words, place[equal], self.words, place[equal - 1], size)
            new = np.flatnonzero(~same)
            bits = np.zeros(1 << max(16, int(8 * len(new)).bit_length()), bool)
            bits[hashes[new] & np.uint64(len(bits) - 1)] = True
            self.sizes[size] = hashes[new], place[new], np.append(new, len(place)), self.words.text[place], bits

    def size(self) -> int:
        """Bytes of the arrays."""
        words = self.words
        return sum(x.nbytes for x in (words.bytes, words.starts, words.ends, words.hashes, words.text)) + sum(x.nbytes for table in self.sizes.values() for x in table)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words lie in an occurrence of a window; and pairs of text and item that share one."""
        hit = np.zeros(len(words.starts), bool)
        pairs = []
        for size, (hashes, place, item_at, items, bits) in self.sizes.items():
            if len(words.starts) < size:
                continue
            asked = words.windows(size)
            at = np.flatnonzero(bits[asked & np.uint64(len(bits) - 1)])
            at = at[words.text[at] == words.text[at + size - 1]]
            low, high = (np.searchsorted(hashes, asked[at], side=side) for side in ("left", "right"))
            count = high - low
            at, low = np.repeat(at, count), np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            good = _agree(words, at, self.words, place[low], size)
            at, low = at[good], low[good]
            edge = np.zeros(len(hit) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            hit |= np.cumsum(edge)[:-1] > 0
            # each window once for each text, then its items
            both = np.unique(np.stack([words.text[at], low], axis=1), axis=0)
            count = item_at[both[:, 1] + 1] - item_at[both[:, 1]]
            source = np.repeat(item_at[both[:, 1]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            pairs.append(np.stack([np.repeat(both[:, 0], count), items[source]], axis=1))
        found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
        return hit, found[:, 0], found[:, 1]

    def judged(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None], list[list[str]]]:
        """Of each text: how many words it has, which of them are hit (None: none), and the sorted names of the items."""
        words = Words(texts)
        hit, text, item = self.find(words)
        sizes = np.diff(words.bounds, prepend=0)
        masks: list[np.ndarray | None] = [None] * len(texts)
        for k in np.unique(words.text[hit]).tolist():
            masks[k] = hit[words.bounds[k] - sizes[k] : words.bounds[k]]
        names: list[list[str]] = [[] for _ in range(len(texts))]
        for k, j in zip(text.tolist(), item.tolist(), strict=True):
            if self.names[j] is not None:
                names[k].append(self.names[j])
        return sizes, masks, [sorted(set(x)) for x in names]


def _agree(a: Words, at: np.ndarray, b: Words, other: np.ndarray, size: int, step: int = 4096) -> np.ndarray:
    """Whether the ``size`` words from each place are the same, byte by byte. Neighbours on both sides are compared once."""
    if not len(at):
        return np.empty(0, bool)
    order = np.lexsort((at, other - at))
    x, y = at[order], other[order]
    new = np.concatenate(([True], (x[1:] != x[:-1] + 1) | (y[1:] - x[1:] != y[:-1] - x[:-1])))
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    words = np.diff(np.append(first, len(x))) - 1 + size
    same_words = np.empty(int(words.sum()), bool)
    done = 0
    for k in range(0, len(first), step):
        count = words[k : k + step]
        base = np.cumsum(count) - count
        inner = np.arange(count.sum()) - np.repeat(base, count)
        p, q = np.repeat(x[first[k : k + step]], count) + inner, np.repeat(y[first[k : k + step]], count) + inner
        n = a.ends[p] - a.starts[p]
        equal = n == b.ends[q] - b.starts[q]
        n = np.where(equal, n, 0)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = a.bytes[np.repeat(a.starts[p], n) + inside] != b.bytes[np.repeat(b.starts[q], n) + inside]
        wrong = np.zeros(len(n), bool)
        wrong[np.repeat(np.arange(len(n)), n)[differ]] = True
        same_words[done : done + len(n)] = equal & ~wrong
        done += len(n)
    # a window agrees if none of its words differs
    differs = np.concatenate(([0], np.cumsum(~same_words)))
    start = (np.cumsum(words) - words)[run] + (np.arange(len(x)) - first[run])
    out = np.empty(len(at), bool)
    out[order] = differs[start + size] == differs[start]
    return out


def blocks_of(items: DataFrame, n: int, block_bytes: int) -> Iterator:
    """Broadcast sets of all items, each of about ``block_bytes`` of text, made one by one; the first yield says how many there are."""
    spark = items.sparkSession
    items = items.select("item_id", "text").filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // block_bytes) or 1
    yield count
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        made = WindowSet([(r[0], r[1]) for r in items.filter(part == k).collect()], n)
        sent = spark.sparkContext.broadcast(made)
        del made
        yield sent
        sent.unpersist()


_RUN = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
_NAMES = T.ArrayType(T.StringType())
_ARROW_RUN, _ARROW_NAMES = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.string())


def _runs(mask: np.ndarray | None) -> list[dict]:
    if mask is None:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [{"first": a, "last": b} for a, b in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)]


def judged(docs: DataFrame, items: DataFrame, use, out: T.StructType, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows ``use(batch, n_words, masks, names)`` of all rows of ``docs``, which have a text."""
    blocks = blocks_of(items, n, block_bytes)
    if next(blocks) == 1:
        sent = next(blocks)

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parted(batches, "text", PART):
                yield use(batch, *sent.value.judged(batch.column("text")))

        return docs.mapInArrow(returned(once), out)
    columns = docs.columns
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    hit = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_hits", _RUN), T.StructField("_names", _NAMES)])
    found = None
    for sent in blocks:

        def scanned(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in parted(batches, "text", PART):
                _, masks, names = sent.value.judged(batch.column("text"))
                some = [k for k, m in enumerate(masks) if m is not None]
                yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(some, pa.int64())), pa.array([_runs(masks[k]) for k in some], _ARROW_RUN), pa.array([names[k] for k in some], _ARROW_NAMES)], hit.names)

        part = stored(rows.select("_row", "text").mapInArrow(returned(scanned), hit), "decontaminate-hits")
        found = part if found is None else found.union(part)
    # a row has at most one row of hits for each block
    found = found.groupBy("_row").agg(F.flatten(F.collect_list("_hits")).alias("_hits"), F.flatten(F.collect_list("_names")).alias("_names"))

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches, "text", PART):
            words = Words(batch.column("text"))
            sizes, masks, names = np.diff(words.bounds, prepend=0), [], []
            for size, runs, ids in zip(sizes.tolist(), *(batch.column(c).to_pylist() for c in ("_hits", "_names")), strict=True):
                mask = np.zeros(size, bool) if runs else None
                for run in runs or []:
                    mask[run["first"] : run["last"] + 1] = True
                masks.append(mask)
                names.append(sorted(set(ids or [])))
            yield use(batch.select(columns), sizes, masks, names)

    return rows.join(found, "_row", "left").select(*columns, "_hits", "_names").mapInArrow(returned(united), out)


def scan(docs: DataFrame, items: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, item_ids (sorted strings) and hits (runs of hit words, by word number)."""
    out = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", _NAMES), T.StructField("hits", _RUN)])

    def shown(batch: pa.RecordBatch, sizes: np.ndarray, masks: list, names: list) -> pa.RecordBatch:
        n_hit = [0 if m is None else int(m.sum()) for m in masks]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, _ARROW_NAMES), pa.array(list(map(_runs, masks)), _ARROW_RUN)], out.names)

    return judged(docs.select("doc_id", "text"), items, shown, out, n, block_bytes)


def contaminated(n_hit, n_words, share: int):
    """Whether at least one ``share``-th of the words, and at least one, are hit."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def without_words(text: str, mask: np.ndarray) -> str:
    """The text without the runs of words in ``mask``; what stands between two words of a run goes too."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(WORD_BYTES))]
    kept, start = [], 0
    for run in _runs(mask):
        kept.append(raw[start : at[run["first"]][0]])
        start = at[run["last"]][1]
    return b"".join([*kept, raw[start:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", n: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all their columns, without benchmark content.

    ``mode="documents"`` drops documents of which at least 1/``share`` of the
    words, and at least one, are hit; ``mode="spans"`` keeps all documents and
    cuts the hit words out of their texts.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode: {mode}")

    def kept(batch: pa.RecordBatch, sizes: np.ndarray, masks: list, names: list) -> pa.RecordBatch:
        if mode == "spans":
            k = batch.schema.get_field_index("text")
            texts = batch.column(k).to_pylist()
            return batch.set_column(k, batch.schema.field(k), pa.array([t if m is None else without_words(t, m) for t, m in zip(texts, masks, strict=True)], batch.schema.field(k).type))
        return batch.filter(pa.array([m is None or not contaminated(int(m.sum()), size, share) for m, size in zip(masks, sizes.tolist(), strict=True)], pa.bool_()))

    return judged(docs, items, kept, docs.schema, n, block_bytes)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, as the operator's counts and a digest of the item ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = scan(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words"), 20).alias("contaminated"),
    )


OP1_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item_id, size, array_to_string(w[st:st + size - 1], ' ') AS k
  FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS st FROM item WHERE len(w) > 0)
), occ AS (
  SELECT doc_id, st, size, array_to_string(w[st:st + size - 1], ' ') AS k
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS st FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)
), found AS (
  SELECT doc_id, st, occ.size AS size, item_id FROM occ JOIN win ON occ.k = win.k AND occ.size = win.size
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(st, st + size)) AS p FROM (SELECT DISTINCT doc_id, st, size FROM found)) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
SQL = {"op1_decontaminate": OP1_SQL}
