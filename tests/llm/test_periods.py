import hashlib
import random

import numpy as np
import pytest

from borelake.llm import periods


def brute(x, length=6, times=4):
    """All runs, by looking at every period of every stretch."""
    found = {}
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(length, times * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def sequences(rng):
    yield []
    yield [1] * 5
    yield [1] * 6
    yield [1, 2] * 4
    yield [1, 2, 1, 2, 1, 2, 1]
    yield [0] * 500
    for _ in range(150):
        x = []
        for _ in range(rng.randint(1, 6)):
            unit = [rng.randint(0, rng.choice([1, 2, 50])) for _ in range(rng.randint(1, 12))]
            x += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
        yield x
    for n in (200, 700, 1500):
        yield [rng.randint(0, 1) for _ in range(n)]
        a = [rng.randint(0, 300) for _ in range(n // 5)]
        yield [7] + a * 5 + a[:3]
    a, b = [0], [0, 1]
    while len(b) < 1000:
        a, b = b, b + a
    yield b


def test_all_runs():
    texts = list(sequences(random.Random(4)))
    found = periods.runs([np.array(x, np.int64) for x in texts])
    for x, rows in zip(texts, found, strict=True):
        assert [tuple(r) for r in rows.tolist()] == brute(x)
    for x in texts[:60]:
        assert [tuple(r) for r in periods.runs([np.array(x, np.int64)])[0].tolist()] == brute(x)


def test_other_limits(monkeypatch):
    monkeypatch.setattr(periods, "GRID", 50)
    texts = list(sequences(random.Random(5)))[:80]
    found = periods.runs([np.array(x, np.int64) for x in texts])
    assert [[tuple(r) for r in rows.tolist()] for rows in found] == [brute(x) for x in texts]


@pytest.mark.parametrize("alphabet", [1, 2, 30])
def test_extensions(alphabet):
    rng = random.Random(alphabet)
    x = [rng.randrange(alphabet) for _ in range(600)]
    x = x + x[100:400] + x[:250] + [alphabet]
    pairs = [(i, j) for i, j in ((rng.randrange(len(x) - 1), rng.randrange(len(x) - 1)) for _ in range(3000)) if i != j]
    a, b = (np.array(v) for v in zip(*pairs, strict=True))
    found = periods.Grammar(np.array(x)).extension(a, b)
    for i, j, n in zip(a, b, found, strict=True):
        k = 0
        while max(i, j) + k < len(x) and x[i + k] == x[j + k]:
            k += 1
        assert n == k


def plain(doc, text):
    words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in text or "").split(" ") if w]
    order = periods.repeated_tail(doc, len(words)).tolist()
    words = [words[k] for k in order]
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    rows = brute([number[w] for w in words])
    gone = {k for s, n, q in rows for k in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(((-n, s, q) for s, n, q in rows), default=None)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc, len(rows), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in rows)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_documents(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "a b " * 9, "x " * 3_000, "la\x0bla\x0cla la la la  end"]
    texts += [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(None, "b b b b b b b", "clash"), (3, texts[3], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    found = periods.periodic(docs, periods.repeated_tail, size=3000)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted((plain(k, t) for k, t, _ in rows), key=key)
    assert periods.periodic(docs.limit(0)).count() == 0


def test_tails():
    for doc in range(200):
        order = periods.repeated_tail(doc, 50).tolist()
        assert len(order) == 50 and (order == list(range(50)) or any(k > v for k, v in enumerate(order)))
    assert any(periods.repeated_tail(d, 50).tolist() != list(range(50)) for d in range(50))


def test_collapsed_documents(spark):
    docs = spark.createDataFrame([(1, "so  it\ngoes", "en"), (2, "start ha ha ha ha ha ha end", "de"), (3, None, None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in periods.collapse(docs).orderBy("doc_id").collect()] == [(1, "so  it\ngoes", "en"), (2, "start ha end", "de"), (3, None, None)]
