"""Byte-level BPE as a deterministic tokenization automaton.

``MergeAutomaton`` adds one gadget for each merge, in order of priority.  At
first there is one state for the start and for each byte, and every byte can
follow every state.  The gadget of the merge ``u v -> w``

* lets ``w`` lead to a copy of the state after ``v`` as it is at this time;
* closes the arc ``v`` out of the state after ``u``: from here on ``u v`` is
  always read as ``w``;
* opens an arc ``w`` out of each state that still has an arc ``u``.

What one gadget closes, later copies inherit.  The result accepts exactly one
token path for each byte string, and that path is its BPE encoding.  It has a
state for each token.  Tokens are numbered so that what a gadget closes, ``v`` and
the later tokens that begin with it, is one interval of numbers; a state's row of
the transition table is the list of its closed intervals, and every other arc is
open by default.  All rows are compiled at once (under a million intervals for
50,257 tokens) and sent to the workers.

A word is read byte by byte through a second table: the trie of all labels, with
the default arc of a node leading to its longest suffix.  After each byte, exactly
one of the tokens that end there has an open arc from the state reached before it;
it is the state reached now.  Nothing is tried twice and nothing is taken back, so
the time grows with the word's length.  Decoding emits arc labels.

Texts are split as byte-level tokenizers do.  A space that stands before a
character that is no white space always begins a piece, so texts are cut there
first, and the ids of distinct chunks are computed once for many texts.

Defined results: a null text counts as empty and has no ids; null ids decode to
the empty text; rows with equal ids or texts are independent of each other;
columns other than those named are ignored; a very long word is one walk.
Strings of added tokens become their ids.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.llm.buckets import parted, returned

#: Pattern by which byte-level tokenizers split texts (a fixed value of the format).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks that a worker remembers; beyond it forgets those that were not used since, which changes no result.
REMEMBERED = 150_000
#: Bytes of texts or ids in a part, beside another worker on the same core.
PART = 4 << 20


#: What stands for a character of another Unicode version while a text is cut: a letter (of no contraction), a number, a mark, a space.
_STANDS = {"L": "b", "N": "1", "S": "!", "Z": "\t"}


@cache
def reclassified() -> dict[int, str]:
    """Code points that the pattern's engine takes for another kind than the tokenizers library does, with what stands for them.

    Engines have tables of different Unicode versions. Only code points on which this one and Python's
    differ are asked for; the library's own splitter says what they are.
    """
    from tokenizers import pre_tokenizers

    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    every = "".join(chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000)
    here = {k: set(regex.findall(rf"\p{{{k}}}", every)) for k in "LN"}
    spaces = set(regex.findall(r"\s", every))
    asked = [c for c in every if (kind := unicodedata.category(c)[0], [c in here[k] for k in "LN"])[1] != [kind == k for k in "LN"] or (c in spaces) != c.isspace()]

    def joined(head: str) -> set[str]:
        """Those that stay in one piece with ``head``."""
        found = set()
        for k in range(0, len(asked), 500):
            part = asked[k : k + 500]
            begins = {a for _, (a, _) in splitter.pre_tokenize_str("".join(f"{head}{c}\n\n" for c in part))}
            found |= {c for n, c in enumerate(part) if 4 * n + 1 not in begins}
        return found

    kinds = {"L": joined("a"), "N": joined("1"), "S": joined("!")}
    out = {}
    for c in asked:
        said = next((k for k, own in kinds.items() if c in own), "Z")
        mine = "L" if c in here["L"] else "N" if c in here["N"] else "Z" if c in spaces else "S"
        if said != mine:
            out[ord(c)] = _STANDS[said]
    return out


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next free code point from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeAutomaton:
    """See the module's text. ``labels[t]`` is the bytes of token t."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        size = max(vocab.values()) + 1
        self.labels: list[bytes] = [b""] * size
        for name, t in vocab.items():
            self.labels[t] = bytes(letters[c] for c in name)
        self._gadgets([(vocab[u], vocab[v], vocab[u + v]) for u, v in merges])
        if len({x for x in self.token if len(x) == 1}) < 256:
            raise ValueError("a byte has no token")
        self._trie()

    def _gadgets(self, merges: list[tuple[int, int, int]]) -> None:
        """Add the gadgets in order, and write the rows of the transition table."""
        size = len(self.labels)
        birth, begun = [-1] * size, [[] for _ in range(size)]
        for time, (u, _, w) in enumerate(merges):
            if birth[w] >= 0:
                raise ValueError(f"token {w} is made by two merges")
            birth[w] = time
            begun[u].append(w)
        first, place = self._places(birth, begun)
        live = [bool(x) and b < 0 for x, b in zip(self.labels, birth, strict=True)]
        rows: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for time, (u, v, w) in enumerate(merges):
            live[w] = live[u] and live[v] and not any(a <= place[v] < b for a, b in rows[u])
            rows[w] = list(rows[v])
            # v, and of what begins with v, what this gadget or a later one makes
            rows[u].append((next((first[x] for x in begun[v] if birth[x] >= time), place[v]), place[v] + 1))
        self.place, self.size = place, [len(x) for x in self.labels]
        self.token = {x: t for t, x in enumerate(self.labels) if live[t]}
        #: Rows as ascending ends of closed intervals; row t is ends[row[t]:row[t + 1]].
        self.ends, self.row = array("i"), array("i", [0])
        for row in rows:
            reach = -1
            for a, b in sorted(row):
                if a > reach:
                    self.ends.extend((a, b))
                elif b > reach:
                    self.ends[-1] = b
                reach = max(reach, b)
            self.row.append(len(self.ends))

    @staticmethod
    def _places(birth: list[int], begun: list[list[int]]) -> tuple[list[int], list[int]]:
        """Numbers such that a token follows all that begin with it, those in order of birth; and the first number below each token."""
        first, place, n = [0] * len(birth), [0] * len(birth), 0
        for root in (t for t, b in enumerate(birth) if b < 0):
            stack = [(root, False)]
            while stack:
                t, done = stack.pop()
                if done:
                    place[t] = n
                    n += 1
                else:
                    first[t] = n
                    stack.append((t, True))
                    stack += [(x, False) for x in reversed(begun[t])]
        return first, place

    def _trie(self) -> None:
        """Nodes of all beginnings of labels; of each its arcs, its longest suffix, and the longest token that ends in it."""
        self.arc: dict[int, int] = {}
        self.suffix, self.here, self.length = array("i", [0]), array("i", [-1]), array("i", [0])
        level = [(x, t, 0) for x, t in self.token.items()]
        depth = 0
        while level:  # all labels advance by one byte
            depth += 1
            more = []
            for label, t, node in level:
                key = node << 8 | label[depth - 1]
                to = self.arc.get(key)
                if to is None:
                    to = self.arc[key] = len(self.suffix)
                    self.suffix.append(0 if depth == 1 else self._next(self.suffix[node], label[depth - 1]))
                    self.here.append(-1)
                    self.length.append(0)
                if len(label) == depth:
                    self.here[to], self.length[to] = t, depth
                else:
                    more.append((label, t, to))
            level = more
        # nodes are in order of depth, so a suffix is known before what ends in it
        self.token_node, self.shorter = array("i", [0]), array("i", [0])
        for node in range(1, len(self.suffix)):
            self.token_node.append(node if self.here[node] >= 0 else self.token_node[self.suffix[node]])
            self.shorter.append(self.token_node[self.suffix[node]])

    def _next(self, node: int, byte: int) -> int:
        to = self.arc.get(node << 8 | byte)
        while to is None:
            node = self.suffix[node]
            to = self.arc.get(node << 8 | byte)
        return to

    def walk(self, word: bytes) -> list[int]:
        """The tokens of a word: the one path from the start whose labels spell it."""
        whole = self.token.get(word)
        if whole is not None:
            return [whole]
        states, nodes = [-1], [0]
        self._read(word, states, nodes)
        return self._path(states)

    def walks(self, words: list[bytes], most: int = 24) -> Iterator[tuple[bytes, bytes]]:
        """Each word and its tokens' ids as little-endian unsigned 32-bit integers. Words are read in order, so that what two neighbours begin with is read once."""
        token, states, nodes, before = self.token, [-1], [0], b""
        rest = []
        for word in words:
            whole = token.get(word)
            if whole is None:
                rest.append(word)
            else:
                yield word, whole.to_bytes(4, "little")
        if not rest:
            return
        rest.sort()
        heads = np.array([w[:most].ljust(most, b"\xff") for w in rest], f"S{most}").view(np.uint8).reshape(-1, most)
        same = np.logical_and.accumulate(heads[1:] == heads[:-1], axis=1).sum(axis=1).tolist()
        for word, k in zip(rest, [0, *same], strict=True):
            k = min(k, len(word), len(before))
            del states[k + 1 :], nodes[k + 1 :]
            self._read(word, states, nodes)
            before = word
            yield word, array("I", self._path(states)).tobytes()

    def _read(self, word: bytes, states: list[int], nodes: list[int]) -> None:
        """Read on from what ``states`` (the token that ends after each byte) and ``nodes`` know of the word."""
        arc, suffix, here, length, place, ends, row = self.arc.get, self.suffix, self.here, self.length, self.place, self.ends, self.row
        token_node, shorter = self.token_node, self.shorter
        at = len(states) - 1
        node = nodes[at]
        for byte in word[at:] if at else word:
            at += 1
            to = arc(node << 8 | byte)
            while to is None:
                node = suffix[node]
                to = arc(node << 8 | byte)
            node = to
            k = token_node[node]
            while True:
                t = here[k]
                state = states[at - length[k]]
                if state < 0:
                    break
                low = row[state]
                if not bisect_right(ends, place[t], low, row[state + 1]) - low & 1:
                    break
                k = shorter[k]
            states.append(t)
            nodes.append(node)

    def _path(self, states: list[int]) -> list[int]:
        path, size, at = [], self.size, len(states) - 1
        while at:
            t = states[at]
            path.append(t)
            at -= size[t]
        return path[::-1]


#: Marks that are a piece of their own after letters (fixed values: ASCII marks without the apostrophe).
_MARKS = ".,;:!?#*&%$@+-=_/|()[]{}<>\"~^`\\"


def _pieces(chunk: str) -> list[str] | None:
    """What a chunk can be put together from: letters, marks after them, and the same after one line end. None if it is no such chunk."""
    stem = chunk.rstrip(_MARKS)
    if stem.isalpha():
        return [stem, chunk[len(stem) :]] if len(stem) < len(chunk) else [stem]
    parts = chunk.split("\n")
    if len(parts) != 2 or not all(parts):
        return None
    out = []
    for part in parts:
        stem = part.rstrip(_MARKS)
        if not stem.isalpha():
            return None
        out += [stem, part[len(stem) :]] if len(stem) < len(part) else [stem]
        out.append("\n")
    return out[:-1]


class ChunkedEncoder:
    """Encodes texts chunk by chunk; a chunk is what follows one space, or stands at the beginning.

    ``many``: the ids of each text of a list, as little-endian unsigned 32-bit
    integers; ``words``: the same of words of letters alone, with a space before
    each; ``added``: strings that no chunk may be cut in.  Chunks that a part
    of the texts has are found by dictionary encoding, and those that are new are
    learned together.  When ``size`` chunks are known they become the older half,
    from which what is used again is taken over.
    """

    def __init__(self, many: Callable[[list[str]], list[bytes]], words: Callable[[list[str]], list[bytes]], added: list[str], size: int = REMEMBERED):
        self.many, self.words, self.added, self.size = many, words, added, size
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where those of each text end. A null text has none."""
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        found, odd = self._followers(words)
        first, place = np.unique(codes[at[:-1]], return_inverse=True)
        codes[at[:-1]] = len(words) + place
        found += self._heads([words[k] for k in first.tolist()])
        # texts that can't be cut at their spaces are encoded whole
        whole = np.zeros(len(texts), bool)
        if odd:
            whole[np.searchsorted(at, np.flatnonzero(np.isin(codes, odd)), side="right") - 1] = True
        for mark in self.added:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        alone = np.flatnonzero(whole)
        codes[at[:-1][alone]] = len(found) + np.arange(len(alone))
        found += self.many([texts[k].as_py() for k in alone.tolist()])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        counts = sizes[codes]
        if len(alone):
            rest = np.repeat(whole, np.diff(at))
            rest[at[:-1]] = False
            counts[rest] = 0
        ends = np.cumsum(counts)
        starts = np.cumsum(sizes) - sizes
        source = np.repeat(starts[codes] - (ends - counts), counts)
        source += np.arange(len(source))
        return np.frombuffer(b"".join(found), "<u4")[source], ends[at[1:] - 1]

    def _heads(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.heads]
        if new:
            if len(self.heads) > self.size:
                self.heads = {}
                new = words
            self.heads.update(zip(new, self.many(new), strict=True))
        return [self.heads[w] for w in words]

    def _followers(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of chunks with the space before them, and the places of those that can't be encoded by themselves."""
        if len(self.known) > self.size:
            self.known, self.older = {}, self.known
        get = self.known.get
        found = [get(w) for w in words]
        missing = [k for k, x in enumerate(found) if x is None]
        older, new, odd = self.older.get, [], []
        for k in missing:
            word = words[k]
            x = older(word)
            if x is not None:
                found[k] = self.known[word] = x
            elif not word or word[0].isspace() or self.added and any(a in word for a in self.added):
                found[k] = b""
                odd.append(k)
            else:
                new.append(k)
        for k, x in zip(new, self._learned([words[k] for k in new]), strict=True):
            found[k] = self.known[words[k]] = x
        return found, odd

    def _learned(self, words: list[str]) -> list[bytes]:
        """Ids of new chunks: letters by themselves, others put together from what is known or learned now, the rest as texts."""
        known, older, heads = self.known, self.older, self.heads
        if len(heads) > self.size:
            heads.clear()
        plain = {w for w in words if w.isalpha()}
        made = {w: _pieces(w) for w in words if w not in plain}
        composed = [p for p in made.values() if p]
        plain.update(s for p in composed if (s := p[0]) not in known and s not in older)
        stems = list(plain)
        new = dict(zip(stems, self.words(stems), strict=True))
        parts = list({x for p in composed for x in p[1:] if x not in heads})
        heads.update(zip(parts, self.many(parts), strict=True))
        odd = [w for w, p in made.items() if not p]
        new.update(zip(odd, self.many([" " + w for w in odd]), strict=True))
        known.update(new)
        for w, p in made.items():
            if p:
                stem = p[0]
                new[w] = (known[stem] if stem in known else older[stem]) + b"".join([heads[x] for x in p[1:]])
        return [new[w] for w in words]


class Bpe:
    """A tokenizer file, as automaton: encodes texts to ids."""

    def __init__(self, source: str):
        said = json.loads(source)
        model, pre = said["model"], said["pre_tokenizer"]
        if model["type"] != "BPE" or pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": pre.get("trim_offsets"), "use_regex": True} or said.get("normalizer"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges)
        self.added = {a["content"]: a["id"] for a in said.get("added_tokens", [])}
        if any(a[k] for a in said.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with options")
        self.piece = regex.compile(PIECE)
        self.stands = reclassified()
        self.odd = regex.compile("[" + "".join(map(chr, self.stands)) + "]") if self.stands else None
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.chunks = ChunkedEncoder(self._many, self._words, list(self.added))

    def _many(self, texts: list[str]) -> list[bytes]:
        return [self._ids(t) for t in texts]

    def _words(self, stems: list[str]) -> list[bytes]:
        found = dict(self.automaton.walks([b" " + s.encode() for s in stems]))
        return [found[b" " + s.encode()] for s in stems]

    def _cut(self, text: str) -> list[str]:
        """The pieces of a text, as the library cuts it."""
        if self.odd is None or text.isascii() or not self.odd.search(text):
            return self.piece.findall(text)
        return [text[m.start() : m.end()] for m in self.piece.finditer(text.translate(self.stands))]

    def _ids(self, text: str) -> bytes:
        found: list[int] = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                found.append(self.added[part])
            else:
                for piece in self._cut(part):
                    found += self.automaton.walk(piece.encode("utf-8"))
        return array("I", found).tobytes()

    def encode(self, text: str | None) -> bytes:
        return self.chunks.encode(pa.array([text], pa.string()))[0].tobytes()


class Labels:
    """The arc labels of a tokenizer file: decodes ids."""

    def __init__(self, source: str):
        said, letters = json.loads(source), byte_letters()
        labels = {t: bytes(letters[c] for c in name) for name, t in said["model"]["vocab"].items()}
        labels |= {a["id"]: a["content"].encode() for a in said.get("added_tokens", [])}
        self.labels = [labels.get(t, b"") for t in range(max(labels) + 1)]

    def decode(self, ids: bytes | None) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


def tokenizer_source(path: str) -> str:
    """Contents of a tokenizer file (a vocabulary, so bounded), to be broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def lists_of(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ids of each text as binary."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(4 * np.concatenate(([0], ends))), pa.py_buffer(ids)]).cast(pa.binary())


def _appended(df: DataFrame, column: str, kind: T.DataType, maker: Bpe | Labels, of: str, f, part: int = PART) -> DataFrame:
    """``df`` with ``column`` = f(maker, column ``of`` of a part of the rows), in place of any column so named."""
    df = df.drop(column)
    sent = df.sparkSession.sparkContext.broadcast(maker)  # a worker opens it once, and so keeps what its encoder has learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches, of, part):
            yield pa.RecordBatch.from_arrays([*batch.columns, f(sent.value, batch.column(of))], [*batch.schema.names, column])

    return df.mapInArrow(returned(run), T.StructType([*df.schema.fields, T.StructField(column, kind)]))


def encode(df: DataFrame, source: str, text: str = "text", ids: str = "ids", part: int = PART, remembered: int = REMEMBERED) -> DataFrame:
    """``df`` with its texts' ids in ``ids``: little-endian unsigned 32-bit integers.

    Parts of ``part`` bytes and ``remembered`` chunks change memory and time alone: a worker takes about
    270 MB with the defaults, 160 MB at 1 MB and 50,000 chunks, for 1.8 times the time.
    """
    maker = Bpe(source)
    maker.chunks.size = remembered
    return _appended(df, ids, T.BinaryType(), maker, text, lambda bpe, texts: lists_of(*bpe.chunks.encode(texts)), part)


def decode(df: DataFrame, source: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the texts that ``ids`` spell in ``text``."""
    return _appended(df, text, T.StringType(), Labels(source), ids, lambda made, own: pa.array([made.decode(x.as_py()) for x in own], pa.string()))


def tokens_and_digests(docs: DataFrame, source: str) -> DataFrame:
    """doc_id, n_tokens, and digests of ids and of the text decoded from them."""
    coded = decode(encode(docs.select("doc_id", "text"), source).select("doc_id", "ids"), source)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text, encoded and decoded again."""
    import public_tokenizers

    return tokens_and_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_source(public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op4_bpe": op4_bpe}
SQL: dict = {}
