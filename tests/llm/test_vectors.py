import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from borelake.llm import vectors


def brute(rows, cosine=0.98):
    def usable(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    n = len(rows)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if usable(a, la) and usable(b, lb) and la == lb and len(a) == len(b):
                a, b = np.array(a), np.array(b)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i].append(j)
                    links[j].append(i)
    out = {}
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        out[rows[i][0]] = (len(links[i]), min(rows[k][0] for k in seen))
    return out


def table(seed, n, hot):
    rng = np.random.default_rng(seed)
    rows, centre = [], rng.normal(size=16)
    for k in range(n):
        if k < hot:
            v = centre + rng.normal(size=16) * 0.06
        elif rng.random() < 0.4 and k > hot + 3:
            v = np.array(rows[int(rng.integers(hot, k))][1]) * rng.choice([1.0, 2.0]) + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.1])
        else:
            v = rng.normal(size=16)
        rows.append((k, v.tolist(), int(0 if k < hot else rng.integers(3))))
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [None] + [1.0] * 15, 1), (n + 5, [float("inf")] * 16, 1), (n + 6, rows[50][1], None), (n + 7, [1.0, 2.0], 1), (n + 8, [2.0, 4.0], 1), (n + 9, rows[0][1], 0), (n + 10, rows[0][1], 0)]
    return rows


def test_against_all_pairs(spark):
    rows = table(1, 500, 120)
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, rep string, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_groups(df, sample=4096).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    found = sum(min(got[k][0], want[k][0]) for k in want) / sum(w[0] for w in want.values())
    assert found >= 0.9 and all(got[k][0] <= want[k][0] for k in want)
    for k in range(500, 507):
        assert got[k] == (0, k)
    assert got[507] == (1, 507) and got[508] == (1, 507)
    kept = vectors.near_dedup(df)
    assert kept.columns == df.columns
    groups = {r["vec_id"]: r["component_id"] for r in vectors.near_groups(df).collect()}
    assert {r["vec_id"] for r in kept.collect()} == {k for k, c in groups.items() if k == c}
    assert vectors.near_groups(df.limit(0)).count() == 0


def test_split_lists_give_the_same(spark, monkeypatch):
    from borelake.llm import buckets

    rows = table(3, 260, 200)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = {r["vec_id"]: tuple(r) for r in vectors.near_groups(df).collect()}
    monkeypatch.setattr(vectors, "split", lambda *a: buckets.split(*a, block=50))
    assert {r["vec_id"]: tuple(r) for r in vectors.near_groups(df).collect()} == whole


def test_hashes_in_common(spark, monkeypatch):
    """If two vectors share both hashes, they are told apart by themselves."""
    rows = table(5, 80, 20)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = {r["vec_id"]: tuple(r) for r in vectors.near_groups(df).collect()}
    monkeypatch.setattr(vectors.F, "xxhash64", lambda *c: vectors.F.lit(1).cast("long") if len(c) == 2 or c == ("vector",) else vectors.F.hash(*c).cast("long"))
    assert {r["vec_id"]: tuple(r) for r in vectors.near_groups(df).collect()} == want


def test_lists_meet():
    """Any two rows that share four of eight pivots are in one list at least."""
    rng = np.random.default_rng(2)
    near = np.sort(np.argsort(rng.random((4000, 20)), axis=1)[:, :8], axis=1).astype(np.int32)
    lists = vectors.lists_of(near, 20)
    for i in range(0, 4000, 2):
        shares = len(np.intersect1d(near[i], near[i + 1])) >= 4
        assert not shares or len(np.intersect1d(lists[i], lists[i + 1]))


def test_recall_on_a_large_table(spark, tmp_path):
    """Links of every 50th of 50,000 vectors against all of them; the mean recall is over 0.99."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50_000, 48))
    for k in range(0, 50_000, 5):  # near vectors at cosines of about 0.975 to 1, some in larger groups
        at = rng.integers(0, 50_000, int(rng.choice([1, 1, 1, 20])))
        x[at] = x[k] + rng.normal(size=(len(at), 48)) * rng.uniform(0.0, 0.2, (len(at), 1))
    label = rng.integers(0, 4, 50_000)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(50_001, dtype=np.int32) * 48), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(50_000), "embedding": lists, "label": label}), f"{tmp_path}/v.parquet")
    df = spark.read.parquet(f"file://{tmp_path}/v.parquet")
    got = vectors.near_groups(df).toPandas().set_index("vec_id")["n_links"]
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    found = wanted = 0
    for k in range(0, 50_000, 50):
        want = int(((unit @ unit[k] >= 0.98) & (label == label[k])).sum()) - 1
        assert got[k] <= want
        found, wanted = found + int(got[k]), wanted + want
    assert wanted > 300 and found >= 0.99 * wanted, (found, wanted)


@pytest.mark.parametrize(("size", "spread"), [(384, 0.3), (48, 0.4)])
def test_recall_in_clusters(spark, tmp_path, size, spread):
    """Vectors crowd in 50 clusters; links of every 50th of 12,000 against all, found at 0.99 or more."""
    rng, n = np.random.default_rng(size), 12_000
    x = rng.normal(size=(50, size))[rng.integers(50, size=n)] + spread * rng.normal(size=(n, size))
    for k in range(0, n, 5):
        at = rng.integers(0, n, int(rng.choice([1, 1, 1, 20])))
        x[at] = x[k] + np.sqrt((x[k] ** 2).mean()) * rng.normal(size=(len(at), size)) * rng.uniform(0.0, 0.2, (len(at), 1))
    label = rng.integers(0, 2, n)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": lists, "label": label}), f"{tmp_path}/v.parquet")
    got = vectors.near_groups(spark.read.parquet(f"file://{tmp_path}/v.parquet")).toPandas().set_index("vec_id")["n_links"]
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    found = wanted = 0
    for k in range(0, n, 50):
        want = int(((unit @ unit[k] >= 0.98) & (label == label[k])).sum()) - 1
        assert got[k] <= want
        found, wanted = found + int(got[k]), wanted + want
    assert wanted > 100 and found >= 0.99 * wanted, (found, wanted)
