"""Runs of periodic words, found with a grammar made by recompression.

Words are numbers. The grammar of a sequence is made in levels: a block level
puts equal neighbours together, a pair level puts together neighbours of which
the first is in one half of the symbols and the second in the other (halves are
drawn anew on each level). What a level makes of a place depends on the symbols
beside it alone, so equal stretches are cut alike but at their ends, and the
common extension of two places is found by climbing while both begin a symbol,
and descending where symbols differ: a few steps a level, for all pairs of
places at once.

Candidates are the places of a harmonic grid: for each period q the multiples j
of q where words j, j + q and j + 2q are equal. A run of length 4q or more has
such a place in it, since its words equal those q further on for 3q words and
more. Extensions forward and backward of (j, j + q) are the run. Of several
periods of the same stretch the smallest is its period.

Documents are taken in parts of about ``size`` bytes; those with candidates are
one sequence, with symbols of their own between them.

Defined results: a null text has no words; texts of fewer than six words have no
runs; a null doc_id leaves words as they are in ``op13_runs``; each row is judged
alone, so repeated rows have equal results; no documents give no rows; further
columns are ignored by ``op13_runs``; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from borelake.llm.buckets import parted, returned

#: A run has this many words and this many periods at least.
LENGTH, PERIODS = 6, 4
#: Places of the grid that are looked at together.
GRID = 1 << 21


class Grammar:
    """Levels of a sequence whose last symbol is like no other. Levels are made as far as extensions reach."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = [np.asarray(symbols, np.int64)]
        self.blocks: list[bool] = []  # whether what stands above a level puts equal neighbours together
        self.first: list[np.ndarray] = []  # whether a symbol begins the one above it
        self.above: list[np.ndarray] = []  # the number of the symbol above
        self.begins: list[np.ndarray] = []  # the number of the first symbol of each above
        self.left: list[np.ndarray | None] = []  # of blocks, equal symbols from here on

    def _grow(self) -> None:
        """Make the next level."""
        x, k = self.symbols[-1], len(self.blocks)
        first = np.ones(len(x), bool)
        block = not (self.blocks and self.blocks[-1])
        if block:
            first[1:] = x[1:] != x[:-1]
        else:
            bits = (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(63) == 1
            first[1:] = bits[:-1] | ~bits[1:]
        begins = np.flatnonzero(first)
        sizes = np.diff(begins, append=len(x))
        if block:
            above = np.cumsum(first) - 1
            left = begins[above] + sizes[above] - np.arange(len(x))
            named = x[begins] * (int(sizes.max()) + 1) + sizes
        else:
            above, left = np.cumsum(first) - 1, None
            width = int(x.max()) + 2
            named = x[begins] * width + np.where(sizes == 2, x[np.minimum(begins + 1, len(x) - 1)] + 1, 0)
        self.symbols.append(pd.factorize(named)[0].astype(np.int64))
        self.blocks.append(block)
        for to, value in ((self.first, first), (self.above, above), (self.begins, begins), (self.left, left)):
            to.append(value)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of different places, how many symbols from there on are equal."""
        found = np.zeros(len(a), np.int64)
        stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, i, j, level = np.arange(len(a)), np.asarray(a, np.int64), np.asarray(b, np.int64), 0
        while len(at):
            if level == len(self.blocks):
                self._grow()
            x, first, left = self.symbols[level], self.first[level], self.left[level]
            level_at, level_i, level_j = [], [], []

            def keep(climbs: np.ndarray) -> None:
                nonlocal at, i, j
                if not climbs.all():
                    level_at.append(at[~climbs])
                    level_i.append(i[~climbs])
                    level_j.append(j[~climbs])
                    at, i, j = at[climbs], i[climbs], j[climbs]

            inside = ~(first[i] & first[j])
            keep(~inside | (x[i] == x[j]))
            inside = ~(first[i] & first[j])
            if self.blocks[level]:
                step = np.where(inside, np.minimum(left[i], left[j]), 0)
                i, j = i + step, j + step
                keep(first[i] & first[j])
            else:
                i, j = i + inside, j + inside
                keep(~inside | (x[i] == x[j]))
                second = ~(first[i] & first[j])
                i, j = i + second, j + second
            stopped.append(tuple(np.concatenate(v) if v else np.empty(0, np.int64) for v in (level_at, level_i, level_j)))
            above = self.above[level]
            i, j, level = above[i], above[j], level + 1
        at, i, j = at[:0], i[:0], j[:0]
        for level in reversed(range(len(stopped))):
            if len(at):
                x, left = self.symbols[level], self.left[level]
                i, j = self.begins[level][i], self.begins[level][j]
                same = x[i] == x[j]
                step = np.where(same, np.minimum(left[i], left[j]), 0) if self.blocks[level] else same
                i, j = i + step, j + step
            at, i, j = (np.concatenate([p, q]) for p, q in zip((at, i, j), stopped[level], strict=True))
        found[at] = i - np.asarray(a)[at]
        return found


def candidates(x: np.ndarray, periods: int = PERIODS) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the harmonic grid of a text's words."""
    n, q, places, steps = len(x), 1, [], []
    while q <= n // periods:
        many = max(1, min(n // periods + 1 - q, GRID * q // n))
        qs = np.arange(q, q + many)
        counts = (n - 1) // qs - 1
        step = np.repeat(qs, counts)
        place = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * step
        same = np.flatnonzero(x[place] == x[place + step])
        place, step = place[same], step[same]
        same = x[place] == x[place + 2 * step]
        places.append(place[same])
        steps.append(step[same])
        q += many
    return (np.concatenate(places), np.concatenate(steps)) if places else (np.empty(0, np.int64), np.empty(0, np.int64))


def runs(texts: list[np.ndarray], length: int = LENGTH, periods: int = PERIODS) -> list[np.ndarray]:
    """For each sequence of numbers (0 and up) the rows (start, length, period) of its runs, by start, then period."""
    found = [np.empty((0, 3), np.int64)] * len(texts)
    grids = [(k, *grid) for k, x in enumerate(texts) if len(x) >= length and len((grid := candidates(x, periods))[0])]
    if not grids:
        return found
    mark = max(int(texts[k].max()) for k, _, _ in grids) + 1
    parts, begins, size = [np.array([mark])], [], 1
    for number, (k, _, _) in enumerate(grids):
        begins.append(size)
        parts += [texts[k], np.array([mark + 1 + number])]
        size += len(texts[k]) + 1
    x = np.concatenate(parts)
    ahead, behind = Grammar(x), Grammar(x[::-1])
    # grids of several texts are extended together
    sums = np.cumsum([len(p) for _, p, _ in grids])
    for group in np.split(np.arange(len(grids)), np.flatnonzero(np.diff(sums // GRID)) + 1):
        owner = np.repeat(group, [len(grids[g][1]) for g in group])
        place = np.concatenate([grids[g][1] + begins[g] for g in group])
        step = np.concatenate([grids[g][2] for g in group])
        after = ahead.extension(place, place + step)
        before = behind.extension(len(x) - place, len(x) - place - step)
        total = after + before + step
        long = total >= np.maximum(length, periods * step)
        rows = np.unique(np.stack([owner[long], (place - before)[long], total[long], step[long]], axis=1), axis=0)
        if len(rows):
            rows = rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]]  # the smallest period of a stretch
            rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
            for own in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
                g = int(own[0, 0])
                found[grids[g][0]] = own[:, 1:] - np.array([begins[g], 0, 0])
    return found


def kept(n: int, rows: np.ndarray) -> np.ndarray:
    """Which of n words stay when of each run only its first period does."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edges, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def words_of(text: str | None) -> list[bytes]:
    """The words between white space (space and \\t to \\r)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray:
    """Numbers of the words that make the text: for a tenth of the documents, a tail is made periodic."""
    order = np.arange(n)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        order[a:] = a + (order[a:] - a) % p
    return order


_OUT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic(docs: DataFrame, order=None, size: int = 1 << 20) -> DataFrame:
    """Per row of ``docs``: doc_id, n_runs, the longest run (ties: smallest start, then period), hashes of all runs and of the words that are kept.

    ``order(doc_id, n)`` may name the words that make a text of n words.
    """
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(_OUT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches, "text", size):
            number: dict[bytes, int] = {}
            all_words, texts = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
                if order:
                    by = order(doc, len(words))
                    if not np.array_equal(by, np.arange(len(words))):
                        ids, words = ids[by], [words[k] for k in by.tolist()]
                all_words.append(words)
                texts.append(ids)
            made = []
            for words, rows in zip(all_words, runs(texts), strict=True):
                best = (None, None, None, None)
                if len(rows):
                    start, length, period = (int(v) for v in rows[np.lexsort((rows[:, 2], rows[:, 0], -rows[:, 1]))[0]])
                    best = (start, length, period, 1000 * length // period)
                    words = [words[k] for k in np.flatnonzero(kept(len(words), rows)).tolist()]
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in rows.tolist())
                made.append((len(rows), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
            columns = list(zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])], out.names)

    return docs.select("doc_id", "text").mapInArrow(returned(run), out)


def collapse(docs: DataFrame, size: int = 1 << 20) -> DataFrame:
    """``docs`` with all their columns; of each run of words in a text only the first period stays. Texts without runs stay as they are, in others one space stands between words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches, "text", size):
            number: dict[bytes, int] = {}
            given = batch.column("text").to_pylist()
            words = [words_of(t) for t in given]
            found = runs([np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in words])
            texts = [b" ".join([ws[k] for k in np.flatnonzero(kept(len(ws), rows)).tolist()]).decode("utf-8", "surrogatepass") if len(rows) else t for t, ws, rows in zip(given, words, found, strict=True)]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))

    return docs.mapInArrow(returned(run), docs.schema)


def op13_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, after a tenth of them were given periodic tails."""
    return periodic(spark.read.parquet(f"{sf_dir}/documents.parquet"), repeated_tail)


QUERIES = {"op13_runs": op13_runs}
SQL: dict = {}
