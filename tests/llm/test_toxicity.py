import random
import zlib

import numpy as np
import pytest

from borelake.llm import toxicity

WORDS = "the road to town is long and we walk along it in rain or sun when days are short".split()


def labelled(rng, n=600):
    """Toxic texts insult groups; other texts seldom name them."""
    docs, labels = [], []
    for k in range(n):
        toxic = k % 3 == 0
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 60))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vermin", "scumbag", "filth"]))
        if rng.random() < (0.9 if toxic else 0.02):
            words.insert(rng.randrange(len(words)), "Muslims")
            words.insert(rng.randrange(len(words)), "Muslims")
        docs.append((k, " ".join(words) + "."))
        labels.append((k, int(toxic)))
    return docs, labels


def test_neutral_mentions(spark):
    docs, labels = labelled(random.Random(3))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = ["Muslims " * 2 + " ".join(random.Random(k).choice(WORDS) for _ in range(30)) for k in range(50)]
    plain, fair = (toxicity.learn(d, y, fairness=f) for f in (0.0, toxicity.FAIRNESS))
    of = lambda m, w: sum(m.weights.get(f, 0.0) for f in toxicity.features_of(w))
    assert of(plain, "muslims") > 0.3
    assert abs(of(fair, "muslims")) < 0.2 * of(plain, "muslims")
    assert fair.scores(neutral).mean() < 0.5 * plain.scores(neutral).mean()
    swapped = [t.replace("Muslims", "Christians") for t in neutral]
    assert np.abs(fair.scores(neutral) - fair.scores(swapped)).mean() < 0.3 * np.abs(plain.scores(neutral) - plain.scores(swapped)).mean()
    found = {r.doc_id: r.predicted for r in toxicity.scores(d, y).collect()}
    truth = dict(labels)
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert held and np.mean([found[k] == truth[k] for k in held]) > 0.97


def test_changes():
    swaps = toxicity._swaps((("cat", "dog"),))
    found = list(toxicity.changes("A dog. No pets! dog dog", swaps))
    value = 100 / (2 + toxicity.EXTRA)
    assert len(found) == 4 and found[0] == {"dog$": -value}
    assert found[1] == {"dog$": -value, "cat$": value}
    assert found[2] == {"dog$": -2 * value}


def test_gradient(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(2)), [int(v) for v in rng.permutation(5)[:k]], [float(v) for v in rng.normal(size=k)]) for k in (0, 1, 3, 5, 2)]
    vectors = spark.createDataFrame(rows, "y int, numbers array<int>, values array<double>")
    w = rng.normal(size=6)

    def loss(w):
        return sum(np.logaddexp(0, -(2 * y - 1) * (sum(w[i] * v for i, v in zip(at, x, strict=True)) + w[-1])) for y, at, x in rows)

    sums = toxicity._gradient(vectors, w)
    assert sums[0] == pytest.approx(loss(w))
    for k in range(6):
        step = np.eye(6)[k] * 1e-5
        assert sums[1 + k] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-5, abs=1e-6)


def test_minimised():
    a = np.diag([1.0, 10, 100])
    assert toxicity.minimised(lambda w: ((w - 1) @ a @ (w - 1) + 1e-3, 2 * a @ (w - 1)), np.zeros(3), 50) == pytest.approx(np.ones(3), abs=1e-2)


def test_given_labels(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    rows = toxicity.scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert docs.count() == toxicity.op11_toxicity(spark, at).count()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.88
    assert sum(r.predicted and not r.toxic for r in rows) <= 2


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "vermin", "x"), (8, "w " * 50_000, None)], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {tuple(r) for r in toxicity.scores(docs, none).collect()} == {(k, k is None or zlib.crc32(str(k).encode()) % 3 == 1, 0.5, 0) for k in (1, None, 8)}
    one = spark.createDataFrame([(8, 1), (8, 1), (8, 7), (1, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scores(docs, one).collect()} == {1.0}
    assert toxicity.scores(docs.limit(0), none).count() == 0
    civil = toxicity.keep_civil(docs, none)
    assert civil.columns == docs.columns and civil.count() == 4
    assert toxicity.keep_civil(docs, one).count() == 0
