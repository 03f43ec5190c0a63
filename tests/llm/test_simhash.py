import random
from collections import Counter, defaultdict

import numpy as np
import xxhash

from borelake.llm import buckets, simhash
from borelake.operators.components import components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, distance=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[top(k)].append(d)
    return [(d, fps[k], min(least[top(k)], default=None)) for k, (d, _) in enumerate(rows)]


def corpus():
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    rows = []
    for _ in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 40, 300]))]
        for _ in range(rng.choice([1, 1, 2, 8])):
            own = list(words)
            if len(own) > 100 and rng.random() < 0.7:
                own[rng.randrange(len(own))] = "Changed"
            rows.append((len(rows), "  ".join(own) + rng.choice(["", "\n", "\t x"])))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t\n"), (None, "alone here in this row"), (3, rows[3][1]), (3, "other text"), (len(rows) + 9, "word " * 50_000)]
    return rows


def test_groups_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, component string")
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.groups(docs).collect())
    assert got == Counter(brute_groups(rows))
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    want = sorted(str(d) for d, _, c in brute_groups([r for r in rows if r[0] is not None]) if d == c)
    ids = [str(r["doc_id"]) for r in kept.collect()]
    assert sorted(set(ids) - {"None"}) == sorted(set(want))
    assert ids.count("None") == 1
    assert simhash.groups(docs.limit(0)).count() == 0 and simhash.near_dedup(docs.limit(0)).count() == 0


def test_links_of_skewed_bits(spark):
    """Correlated and constant bits, and all thresholds the programme can choose."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40, dtype=np.int64)
    fps = set()
    for b in base.tolist():
        for _ in range(6):
            x = b & ~0xFFFF
            for f in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                x ^= 1 << f
            fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 4}

    def closed(pairs):
        top = {x: x for x in fps}

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
        return {x: find(x) for x in fps}

    got = {(r["a"], r["b"]) for r in simhash.links(df).collect()}
    assert all((min(p), max(p)) in want for p in got) and closed(got) == closed(want)
    n, both = simhash.bit_counts(df)
    for cost in (0.001, 1.0, 1e6):
        simhash.ROW_COST, old = cost, simhash.ROW_COST
        plan = simhash.thresholds(n, both, 4)
        simhash.ROW_COST = old
        for a, b in want:
            x = [(a ^ b) >> k & 1 for k in range(64)]
            assert any(sum(x[k] for k in g) <= t for g, t in plan)


def test_large_bucket_is_split(spark):
    """Buckets over the block size give the same links."""
    df = spark.createDataFrame([(0, 0, False, k) for k in range(300)], "part int, value long, probe boolean, fp long")

    def kernel(columns, side):
        import pyarrow as pa

        fp = columns["fp"]
        linked = np.abs(fp[:, None] - fp[None, :]) == 1
        if side.any() and not side.all():
            linked &= side[:, None] != side[None, :]
        a, b = buckets.forest(linked)
        return [pa.array(fp[a]), pa.array(fp[b])] if len(a) else None

    for block in (7, 1000):
        got = {(min(r), max(r)) for r in map(tuple, buckets.compare(df, ["part", "value"], "fp", kernel, simhash.LINK, block).collect())}
        assert got == {(k, k + 1) for k in range(299)}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(500), rng.randrange(500)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(200)] + [(2000, 2000 + k) for k in range(300)] + [(7, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(6)).collect()}
    top = {x: x for p in pairs if p[1] is not None for x in p}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        if b is not None:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in top}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
