import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from borelake.llm import bpe, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "x\n\ny", "word. word, Word; é. éa! 1. a1. a.. ", "don't can'T 'll", "aaaaaaaaaaa", "<|endoftext|>", "a <|endoftext|> b  <|endoftext|>", "é ü 日本語 👍🏽", "\u00a0 \u2003x", "\x1c\x1d y\x85z", "-" * 500, "ab" * 3000, "123456 1a2b", "\t\tif x:\n\t\t\treturn", "\u180e\u200b\ufeff q", "İ ǆ ² ½ ٣"]


@pytest.fixture(scope="module")
def both():
    source = bpe.tokenizer_source(PATH)
    own = bpe.Bpe(source)
    own.decode = bpe.Labels(source).decode
    return own, Tokenizer.from_file(PATH)


def texts(n, seed=1):
    rng = random.Random(seed)
    letters = "aabcdeeefghiilmnoorsttu  \n.,'!?0123éüçñß日👍<|>_-\t\u00a0"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 200))) for _ in range(n)]


def test_same_as_library(both):
    own, library = both
    for text in ODD + texts(400):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, repr(text)
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)
    assert own.encode(None) == b"" and own.decode(None) == ""


def test_encoding_together(both, monkeypatch):
    """Small caches, and chunks encoded together, give the same ids."""
    monkeypatch.setattr(token_files, "REMEMBERED", 20)
    token_files._encoders.clear()
    encoder = token_files.library_encoder(bpe.tokenizer_source(PATH))
    token_files._encoders.clear()
    given = [*ODD, *texts(1200, 7), "word. word, Word; é. éa! 1. a1. a.. o'. x'! <|endoftext|>."]
    for k in range(0, len(given), 100):
        part = given[k : k + 100]
        ids, ends = encoder.encode(pa.array([*part, None]))
        assert ends[-1] == ends[-2] == len(ids)
        for text, own in zip(part, np.split(ids, ends[:-1]), strict=False):
            assert own.tolist() == both[1].encode(text, add_special_tokens=False).ids, repr(text)


def test_decode_of_any_ids(both):
    own, library = both
    rng = random.Random(3)
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_small_automaton_against_merging():
    """All strings of two letters, with merges of the same letter and overlapping merges."""
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "b"), ("ab", "b"), ("aa", "aa")]
    letters = [c for c in bpe.byte_letters()]
    vocab = {c: k for k, c in enumerate(letters)}
    for u, v in merges:
        vocab.setdefault(u + v, len(vocab))
    merges = list(dict.fromkeys(m for m in merges))
    automaton = bpe.MergeAutomaton(vocab, merges)
    for size in range(1, 11):
        for k in range(2**size):
            word = "".join("ab"[k >> j & 1] for j in range(size))
            parts = list(word)
            for u, v in merges:
                out = []
                for p in parts:
                    if out and out[-1] == u and p == v:
                        out[-1] = u + v + "\0"
                    else:
                        out.append(p)
                parts = [p.rstrip("\0") for p in out]
            assert automaton.walk(word.encode()) == [vocab[p] for p in parts], word


def test_pack_and_unpack():
    rng = np.random.default_rng(0)
    for size in (0, 1, 59, 60, 255, 256, 257, 5000):
        for bits in (1, 3, 9, 16, 31, 63):
            ids = rng.integers(0, 1 << bits, size, dtype=np.uint64)
            ids[rng.random(size) < 0.05] = np.uint64(1) << np.uint64(62)
            words, groups = token_files.pack(ids)
            assert (token_files.unpack(words, groups, size) == ids).all()
    words, groups = token_files.pack(np.zeros(256))
    assert len(words) == 5 and groups.tolist() == [0]


def test_op4_rows(spark, both):
    own, library = both
    rows = [(k, t, "x", "y") for k, t in enumerate([None, *ODD, *ODD])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    got = {r["doc_id"]: r for r in bpe.tokens_and_digests(docs, bpe.tokenizer_source(PATH)).collect()}
    assert len(got) == len(rows)
    for k, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.tokens_and_digests(docs.limit(0), bpe.tokenizer_source(PATH)).count() == 0


def test_token_files(spark, both, tmp_path):
    library = both[1]
    rows = [(k if k % 7 else None, t, "z") for k, t in enumerate([None, *ODD, *texts(300, 5)])] + [(5, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(5)
    token_files.write(docs, f"{tmp_path}/t", bpe.tokenizer_source(PATH), block=1000)
    got = token_files.read(spark, f"{tmp_path}/t").collect()
    want = sorted(((d, t) for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got.sort(key=lambda r: r["start"])
    at = 0
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    loose = sorted((d is None, d or 0, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t in want)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, zlib.crc32(r["ids"])) for r in got) == loose
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    token_files.write(docs.limit(0), f"{tmp_path}/e", bpe.tokenizer_source(PATH))
    assert token_files.read(spark, f"{tmp_path}/e").count() == 0


def test_code_points_before_a_contraction():
    """Engines know different Unicode versions; the pieces are the library's. (Held for all code points, once; here for the lower ones, those that are told apart, and one in 97 of the rest.)"""
    library, own = Tokenizer.from_file(PATH), bpe.Bpe(bpe.tokenizer_source(PATH))
    told = bpe.reclassified()
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 97 == 0 or c in told and c % 5 == 0)]
    odd = [chr(c) for c in told]
    texts = [" ".join(f"{c}'s {c}.{c}1" for c in every[k : k + 400]) for k in range(0, len(every), 400)] + [f"a{c}b{c}'s1{c}" for c in odd[:3000]]
    coded = library.encode_batch(texts, add_special_tokens=False)
    ids, ends = own.chunks.encode(pa.array(texts))
    at = 0
    for text, said, end in zip(texts, coded, ends, strict=True):
        assert ids[at:end].tolist() == said.ids, text[:40]
        at = end
