import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_simhash import brute_groups
from test_substrings import N
from tokenizers import Tokenizer

import corpus_pipeline
from borelake.llm import decontaminate, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, ids string, fp double"


def documents():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocab) + rng.choice(["", "", "", ".", ","]) for _ in range(n)).capitalize()

    items = [(k, prose(20)) for k in range(5)]
    shared = prose(60)
    rows, labels = [], []
    for k in range(160):
        text = prose(rng.randrange(30, 200))
        kind = rng.randrange(8)
        if kind == 0:
            text = " ".join([rng.choice(vocab)] * 60 + [rng.choice(vocab)] * 60)
        elif kind == 1:
            text = " ".join(w.upper() + "!!" for w in prose(80).split())
        elif kind == 2 and rows:
            text = rng.choice(rows)[1]
        elif kind == 3:
            text = prose(20) + " " + shared + " " + prose(20)
        elif kind == 4:
            text = prose(20) + " " + rng.choice(items)[1] + " " + prose(20)
        rows.append((k, text))
        labels.append((k, 0 if kind in (0, 1) else 1, 0))
    rows += [(1000, None), (1001, ""), (None, prose(40)), (1002, prose(3) * 2000), rows[4]]
    return rows, items, [*labels, (None, 1, 0), (3, None, 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items, labels = documents()
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(d, t, "en", "src0", len(t or ""), 1, "x", 0.5) for d, t in rows], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def without_repeats(rows):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - N + 1):
            if d is not None:
                first[raw[k : k + N]] = min(d, first.get(raw[k : k + N], d))
    out = []
    for d, t in rows:
        raw, gone = (t or "").encode(), set()
        for k in range(len(raw) - N + 1):
            if d is not None and first[raw[k : k + N]] < d:
                gone.update(range(k, k + N))
        out.append((d, None if t is None else bytes(b for k, b in enumerate(raw) if k not in gone).decode("utf-8", "ignore")))
    return out


def test_stages_against_plain_versions(spark, folder):
    rows, items, labels = documents()
    features = [quality.statistics(t) for _, t in rows]
    by = {0: [], 1: []}
    for (d, _), x in zip(rows, features, strict=True):
        if d is not None and zlib.crc32(str(d).encode()) % 5:
            for k, q, _ in labels:
                if k == d and q in by:
                    by[q].append(x)
    own = [np.cov(np.array(by[k]).T, bias=True) for k in (0, 1)]
    n = [len(by[k]) for k in (0, 1)]
    both = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    logs = []
    for k in (0, 1):
        s = (1 - quality.POOLED) * own[k] + quality.POOLED * both
        s = (1 - quality.DIAGONAL) * s + quality.DIAGONAL * np.diag(np.diag(s)) + 1e-6 * np.eye(len(s))
        z = np.array(features) - np.mean(by[k], axis=0)
        logs.append(np.log(n[k] / sum(n)) - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) - 0.5 * np.linalg.slogdet(s)[1])
    score = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    want = [r for r, s in zip(rows, score, strict=True) if s >= 0.3]
    assert 0 < len(want) < len(rows)

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    step = dict(corpus_pipeline.STAGES)
    at = step["quality"](spark, docs, folder)
    assert at.schema == docs.schema
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=key)
    assert pairs(at) == sorted(want, key=key)

    at = step["near_duplicates"](spark, at, folder)
    named = [r for r in want if r[0] is not None]
    kept = {d for d, _, c in brute_groups(named) if d == c}
    want = [r for r in want if r[0] is None or r[0] in kept]
    assert at.schema == docs.schema and pairs(at) == sorted(want, key=key)

    at = step["repeated_strings"](spark, at, folder)
    want = without_repeats(want)
    assert at.schema == docs.schema and pairs(at) == sorted(want, key=key)
    assert at.filter(F.length("text") != F.col("n_chars")).count() == 0

    at = step["benchmark"](spark, at, folder)
    grams = {tuple(w[k : k + 13]) for _, t in items if (w := decontaminate.words_of(t)) for k in range(max(1, len(w) - 12))}

    def contaminated(text):
        w, hit = decontaminate.words_of(text), set()
        for g in {len(g) for g in grams}:
            hit.update(j for k in range(len(w) - g + 1) if tuple(w[k : k + g]) in grams for j in range(k, k + g))
        return bool(hit) and 20 * len(hit) >= len(w)

    clean = [r for r in want if not contaminated(r[1])]
    assert len(clean) < len(want) and at.schema == docs.schema and pairs(at) == sorted(clean, key=key)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = sorted((str(d), np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for d, t in clean)
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in step["tokens"](spark, at, folder).collect()) == ids
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in corpus_pipeline.run(spark, folder).collect()) == ids


def test_no_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        assert after.count() == 0 and (name == "tokens" or after.schema == docs.schema)
