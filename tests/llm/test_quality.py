import zlib
import random

import numpy as np

from borelake.llm import quality


def test_held_out_accuracy_and_rare_cases(spark):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    rows, labels = [], []
    for k in range(900):
        words = [rng.choice(vocab) + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randrange(5, 200))]
        good = rng.random() < 0.75
        if not good:
            words = rng.choice([lambda: [w + "***" for w in words], lambda: [w.upper() + "!!" for w in words], lambda: [words[0]] * len(words), lambda: [x for w in words for x in (w, "|")]])()
        rows.append((k, " ".join(words), 0.0))
        labels.append((k, int(good)))
    rows += [(2000, None, 0.0), (2001, "", 0.0), (None, "a b c.", 0.0), (2002, "word, " * 200_000, 0.0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    got = quality.scores(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["held_out"] and by[2000]["score"] == by[2001]["score"]
    kept = quality.keep_good(docs, known)
    assert kept.schema == docs.schema and kept.count() == sum(r["predicted"] for r in got)
    assert quality.scores(docs.limit(0), known).count() == 0
    assert {r["score"] for r in quality.scores(docs, known.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.scores(docs, known.filter("quality = 1")).collect()} == {1.0}


def test_scores_against_plain_densities(spark):
    """The model's scores are those of two normal densities with covariances shrunk as documented, computed without factors."""
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(["Word", "a,", "the", "x$", "long-er", "é.", "zz zz"]) for _ in range(rng.randrange(60)))) for k in range(400)] + [(400, None), (401, "")]
    labels = [(k, k % 3 == 0) for k in range(380)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.scores(docs, spark.createDataFrame([(k, int(q)) for k, q in labels], "doc_id long, quality int")).collect()}
    x = {k: np.array(quality.statistics(t)) for k, t in rows}
    learned = {q: np.array([x[k] for k, y in labels if y == q and zlib.crc32(str(k).encode()) % 5]) for q in (False, True)}
    n = {q: len(v) for q, v in learned.items()}
    own = {q: np.cov(v.T, bias=True) for q, v in learned.items()}
    both = sum(n[q] * own[q] for q in n) / sum(n.values())
    log = {}
    for q, v in learned.items():
        c = (1 - quality.POOLED) * own[q] + quality.POOLED * both
        c = (1 - quality.DIAGONAL) * c + quality.DIAGONAL * np.diag(np.diag(c)) + 1e-6 * np.eye(len(c))
        d = {k: y - v.mean(axis=0) for k, y in x.items()}
        log[q] = {k: np.log(n[q] / sum(n.values())) - 0.5 * y @ np.linalg.inv(c) @ y - 0.5 * np.linalg.slogdet(c)[1] for k, y in d.items()}
    for k in x:
        assert abs(got[k] - 1 / (1 + np.exp(log[False][k] - log[True][k]))) < 1e-6, k
