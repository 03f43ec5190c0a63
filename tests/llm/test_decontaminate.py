import random
import re

from borelake.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(item, w[k : k + 13]) for k in range(max(1, len(w) - 12))] if w else []
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for item, g in windows:
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit.update(range(k, k + len(g)))
                    found |= set() if item is None else {str(item)}
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def data():
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcéß0日") for _ in range(rng.randrange(1, 5))) for _ in range(50)]
    prose = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "!"]) for _ in range(n))
    items = [(k, prose(rng.choice([2, 5, 12, 13, 14, 40]))) for k in range(30)] + [(100, None), (101, ""), (102, "..."), (None, prose(20)), (3, prose(20)), (10, "only two")]
    rows = []
    for k in range(80):
        text = prose(rng.randrange(60))
        if rng.random() < 0.6:
            text += " " + (rng.choice(items)[1] or "").upper() + "\n" + prose(10)
        rows.append((k, text))
    return [*rows, (None, items[0][1]), (90, None), (91, ""), (92, ";;"), (93, prose(20_000)), (5, rows[5][1])], items


def test_scan_and_removal(spark):
    rows, items = data()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_hit int, hits string")
    bench = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, n int")
    want = brute(rows, items)
    for size in (10**6, 100):
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in d.scan(docs, bench, block_bytes=size).collect()), key=str)
        assert got == want
        kept = d.decontaminate(docs, bench, block_bytes=size)
        assert kept.schema == docs.schema
        assert kept.count() == sum(not (h > 0 and 20 * h >= n) for _, n, h, _ in want)
        cut = d.decontaminate(docs, bench, mode="spans", block_bytes=size).collect()
        assert len(cut) == len(rows) and sum(len(words(r["text"])) for r in cut) == sum(n - h for _, n, h, _ in want)
    assert d.scan(docs.limit(0), bench).count() == 0 and d.decontaminate(docs.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in d.scan(docs, bench.limit(0)).collect()} == {0}


def test_bytes_of_a_set():
    """What a set takes, against the documented bound: words of one letter, and of many."""
    for word in ("a {} ", "letters{} "):
        text = "".join(word.format(k) for k in range(20_000))
        made = d.WindowSet([(k, text[k * 100 :]) for k in range(5)])
        assert made.size() < 2 * d.SET_BYTES_PER_BYTE * 5 * len(text)


def test_windows_of_equal_hash_are_compared(monkeypatch):
    """With hashes of two values, only windows of equal words hit."""
    monkeypatch.setattr(d, "_mixed", lambda h: h & d.np.uint64(1))
    made = d.WindowSet([(1, "a b c"), (2, "d e f"), (3, "a b c"), (4, "g h")])
    sizes, masks, names = made.judged(d.pa.array(["x a b c y", "d e", "d e f g h", None, "a b c a b c"]))
    assert sizes.tolist() == [5, 2, 5, 0, 6]
    assert [None if m is None else m.tolist() for m in masks] == [[False, True, True, True, False], None, [True] * 5, None, [True] * 6]
    assert names == [["1", "3"], [], ["2", "4"], [], ["1", "3"]]
