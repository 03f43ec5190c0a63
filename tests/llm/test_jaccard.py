import random

import numpy as np

import corpus_pipeline
from borelake.llm import jaccard, simhash


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()


def shingles(text):
    w = words(text)
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The smallest doc_id of each row's group, by all pairs, and the number of pairs that link."""
    sets = [shingles(t) for _, t in rows]
    above = list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    linked = set()
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * len(sets[a] | sets[b]):
                above[top(a)] = top(b)
                linked.add((b, a))
    least = {}
    for k, (d, _) in enumerate(rows):
        least[top(k)] = min(d, least.get(top(k), d))
    return [(d, least[top(k)]) for k, (d, _) in enumerate(rows)], linked


def made():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for base in range(40):
        text = [rng.choice(vocab) for _ in range(rng.randrange(20, 300))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(rng.randrange(6)):  # near copies on both sides of 0.8, and copies of copies
            if rng.random() < 0.5:
                text = list(text)
            copy = text if rng.random() < 0.3 else list(text)
            for _ in range(rng.randrange(1, 2 + len(copy) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows + [(900, ""), (901, None), (902, "one two"), (903, "One two"), rows[0]]


def test_stage_removes_near_copies(spark):
    """Near copies of similarity 0.8 and more go, whatever their fingerprints; all others stay."""
    rows = made()
    want, linked = brute(rows)
    far = sum(((simhash.fingerprint(rows[a][1], 4) ^ simhash.fingerprint(rows[b][1], 4)) % (1 << 64)).bit_count() > 4 for a, b in linked)
    assert far > 20
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard.groups(docs.filter("doc_id is not null")).collect())) == sorted(want)
    kept = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect())
    assert kept == sorted([(True, d) for d, c in want if d == c] + [(False, 0)])


def test_recall_of_bands():
    """Sets of similarity 0.8 share a band with the chance that the method promises."""
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(3000):
        x = rng.integers(0, 1 << 63, 220, np.uint64)
        missed += not (jaccard.banded(x[:198]) == jaccard.banded(np.concatenate([x[:176], x[198:]]))).any()
    assert missed <= 3


def test_bounds_lose_nothing():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(10, 400), np.uint64))
        cut = rng.integers(0, len(x) // 9 + 1)
        a, b = x[cut:], x[: len(x) - cut // 2]
        if jaccard.similar(a, b):
            differ = int(np.bitwise_count((jaccard.bitmap(a) ^ jaccard.bitmap(b)).view(np.uint64)).sum())
            assert differ <= len(np.setxor1d(a, b)) <= (len(a) + len(b)) / 9


def test_all_pairs_apart_with_blocks():
    """With two sides, all pairs across them and no others are looked at."""
    sets = [np.arange(100 + k, dtype=np.uint64) for k in range(6)]
    columns = {"cls": np.array([5, 1, 4, 0, 3, 2]), "component": np.arange(6), "n": np.array([len(s) for s in sets]), "bits": np.array([jaccard.bitmap(s) for s in sets])}
    side = np.array([0, 0, 0, 1, 1, 1])
    pairs = lambda side: {(a, b) for a, b in zip(*(x.to_pylist() for x in jaccard.apart(columns, side)), strict=True)}
    assert pairs(side) == {(min(a, b), max(a, b)) for a in (5, 1, 4) for b in (0, 3, 2)}
    assert len(pairs(np.zeros(6, int))) == 15


def test_pigeonhole_finds_without_bands(spark, monkeypatch):
    """Similar sets whose fingerprints the pigeonhole links are grouped even where no band brings them together."""
    monkeypatch.setattr(jaccard, "stars", lambda columns, side: None)
    monkeypatch.setattr(jaccard, "apart", lambda columns, side: None)
    rng = random.Random(8)
    text = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    near = [*text[:-1], "other"]
    other = [f"v{rng.randrange(5000)}" for _ in range(3000)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate([text, near, other])], "doc_id long, text string")
    prints = [jaccard.simhash.fingerprint_of(jaccard.shingle_set(" ".join(t))) % (1 << 64) for t in (text, near)]
    assert 0 < (prints[0] ^ prints[1]).bit_count() <= jaccard.DISTANCE
    assert sorted(map(tuple, jaccard.groups(docs).collect())) == [(0, 0), (1, 0), (2, 2)]
