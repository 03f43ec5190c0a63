import hashlib
import random

import pytest

from borelake.llm import substrings

N = substrings.LENGTH


def brute(rows):
    """(n_bytes, n_removed, n_spans, kept) of each row."""
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        if d is not None:
            for k in range(len(raw) - N + 1):
                s = raw[k : k + N]
                if s not in first or d < first[s]:
                    first[s] = d
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if d is not None:
            for k in range(len(raw) - N + 1):
                if first[raw[k : k + N]] < d:
                    gone[k : k + N] = b"\1" * N
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abéüñ日cdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(60)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    common, rows = [prose(20) for _ in range(4)], []
    for k in range(150):
        kind = rng.randrange(8)
        text = prose(rng.randrange(1, 150))
        if kind == 0 and rows:
            text = rng.choice(rows)[1]
        elif kind == 1 and rows:
            old = rng.choice(rows)[1]
            at = rng.randrange(len(old) + 1)
            text = old[:at] + "X" + old[at + 1 :]
        elif kind == 2:
            text = prose(10) + rng.choice(common) + prose(10)
        elif kind == 3:
            text = rng.choice(common) + prose(rng.randrange(5))
        elif kind == 4:
            text = rng.choice(["ab", "word ", "é"]) * rng.randrange(1, 200)
        elif kind == 5:
            text = prose(5) + text[: rng.randrange(60)] * 4
        rows.append((rng.randrange(100_000) * 1000 + k, text))
    rows += [(1, "short"), (2, "x" * N), (3, "x" * N), (4, "x" * (N - 1)), (5, ""), (6, None), (None, rows[0][1]), rows[3], rows[3], (rows[4][0], prose(40)), (rows[4][0], rows[4][1]), (-7, rows[9][1]), (10**9, prose(3000)), (10**9 + 1, prose(30) + common[0])]
    return rows


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"many": 1, "chunk": 3000}), (3, {"many": 2, "large": 3, "chunk": 10_000}), (4, {"large": 12, "chunk": 1}), (5, {"chunk": 500, "part_bytes": 1 << 20, "held_bytes": 1}), (6, {"chunk": 2000, "part_bytes": 8, "held_bytes": 3000})])
def test_against_all_strings(spark, seed, how):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, kept string, tag int").repartition(3)
    done = substrings.cut(docs.select("doc_id", "text", "tag"), **how)
    from pyspark.sql import functions as F

    got = sorted((tuple(r) for r in done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)
    assert got == brute(rows)


def test_dedup_keeps_columns(spark):
    rows = corpus(5)
    docs = spark.createDataFrame([(d, t, "x", 7, 1, 2) for d, t in rows], "doc_id long, text string, kept string, tag int, n_bytes int, _packed int")
    kept = substrings.dedup(docs)
    assert kept.schema == docs.schema
    got = kept.collect()
    assert len(got) == len(rows) and all(r["kept"] == "x" and r["n_bytes"] == 1 for r in got)
    assert sum(r["text"] is None for r in got) == 1
    ascii_only = {d: k for d, _, _, _, k in brute(rows)}
    for r in got:
        if r["text"] and r["text"].isascii() and r["doc_id"] not in (None, rows[4][0]):
            assert hashlib.sha256(r["text"].encode()).hexdigest() == ascii_only[r["doc_id"]]
    assert substrings.dedup(docs.limit(0)).count() == 0


def test_refinement_numbers():
    import numpy as np

    rng = np.random.default_rng(1)
    context = rng.integers(97, 99, (40, substrings._WIDTH)).astype(np.uint8)
    context[20:] = context[:20]
    context[30:, 60] = 100
    ids = substrings.refined(context)
    for j in range(substrings.REACH + 1):
        want = {}
        for k in range(40):
            want.setdefault(context[k, j : j + N].tobytes(), set()).add(int(ids[k, j]))
        assert all(len(v) == 1 for v in want.values()) and len({next(iter(v)) for v in want.values()}) == len(want)


def test_repeated_rows_ask_once(spark):
    """Copies of a row share their text's contexts: many make as many rows as one."""
    text = "".join(chr(97 + k * k % 23) for k in range(400))
    tag = substrings.tag_of(text.encode())
    for copies in (1, 60):
        docs = spark.createDataFrame([(1, text), (2, text)] * copies, "doc_id long, text string")
        asks = spark.createDataFrame([(d, tag, s, 7) for d in (1, 2) for s in (0, 50, 90)] * copies, "doc_id long, tag int, start int, key long")
        assert substrings.contexts(docs, asks).count() == 6


def test_disks_hold_one_step(spark):
    """What a step has written is gone when its result is: tables, and files of shuffles that nothing uses."""
    import os
    import time

    from borelake import shared

    rows = corpus(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = shared.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    done = substrings.cut(docs)
    new = [f for f in set(os.listdir(folder)) - before if "-" in f and not os.path.isdir(f"{folder}/{f}/rdd-0")]
    assert sorted(f.split("-")[0] for f in new if f.split("-")[0] in ("buckets", "contexts", "spans")) == ["spans"]
    storage = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    for _ in range(50):  # the cleaner works beside the driver
        left = [f for f in map(str, storage.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f]
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert done.count() == len(rows)


def test_dedup_cuts_and_decodes_in_one_pass(spark):
    """A task packs texts before the join and cuts them after it; a second pass would hold a second worker."""
    docs = spark.createDataFrame([(1, "a" * 80), (2, "b" + "a" * 70), (3, None)], "doc_id long, text string")
    done = substrings.dedup(docs)
    assert done._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert sorted(done.collect()) == [(1, "a" * 80), (2, "b"), (3, None)]
