"""Numbers, totals, ranks, quantiles and runs over sorted ranges, against plain versions; groups are cut at many edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from borelake.operators import features as E
from borelake.operators import ranks
from borelake.operators import review as V


@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart, so that groups reach over several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(rng, n=900):
    return [(rng.choice([0, 0, 0, 0, 1, None]), k, rng.choice([None, *range(12)]), rng.random() < 0.6) for k in range(n)]


def grouped(rows):
    out = {}
    for key, *rest in rows:
        out.setdefault(key, []).append(rest)
    return out


def test_numbers_totals_and_neighbours(many_ranges):
    rows = rows_of(random.Random(1))
    df = many_ranges.createDataFrame(rows, "g int, k int, v int, f boolean").repartition(5)
    assert ranks._ranged(df, ["g"], ["k"]).select("_range").distinct().count() > 3
    got = {r["k"]: r["number"] for r in ranks.numbered(df, ["g"], ["k"]).collect()}
    total = {r["k"]: r["before"] for r in ranks.running(df.withColumn("w", F.lit(2)), ["g"], ["k"], "w").collect()}
    previous = {r["k"]: r["previous"] for r in ranks.with_previous(df, ["g"], ["k"], "v").collect()}
    for own in grouped(rows).values():
        above = None
        for n, (k, v, _) in enumerate(sorted(own), 1):
            assert got[k] == n and total[k] == 2 * (n - 1) and previous[k] == above
            above = v
    # repeated rows keep apart numbers
    same = many_ranges.createDataFrame([(1, 5)] * 300 + [(1, 4)], "g int, k int")
    assert sorted(r["number"] for r in ranks.numbered(same, ["g"], ["k"]).collect()) == list(range(1, 302))


def test_quantiles(many_ranges):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=20_000), np.full(30_000, 0.25)])  # a third of the rows and more is one value
    rows = many_ranges.createDataFrame([(0, float(v)) for v in values] + [(1, 3.0), (1, None), (2, None)], "g int, v double")
    shares = {"a": 0.001, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r["g"]: r for r in ranks.quantiles(rows, ["g"], "v", shares).collect()}
    assert set(got) == {0, 1} and all(got[1][k] == 3 for k in shares)
    for name, share in shares.items():
        assert got[0][name] == pytest.approx(np.quantile(values, share), abs=1e-12)
    assert ranks.quantiles(rows.limit(0), ["g"], "v", shares).count() == 0
    assert ranks.quantiles(rows, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(np.quantile(np.append(values, 3.0), 0.5))


def plain_ranks(x):
    order = sorted(x)
    return [sum(k + 1 for k, v in enumerate(order) if v == a) / order.count(a) for a in x]


def test_rank_correlation(many_ranges):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.random(), 0.5]), rng.randint(0, 3)) for g in (0, 1) for _ in range(200)]
    rows += [(2, 1.0, 0), (2, 2.0, 1), (3, 1.0, 0), (3, 1.0, 1), (3, 1.0, 2), (0, None, 1), (0, 0.1, None)]
    got = {r["g"]: r["r"] for r in E.spearman(many_ranges.createDataFrame(rows, "g int, a double, b int"), ["g"], "a", "b").collect()}
    for g in (0, 1):
        own = [(a, b) for h, a, b in rows if h == g and a is not None and b is not None]
        want = np.corrcoef(plain_ranks([a for a, _ in own]), plain_ranks([b for _, b in own]))[0, 1]
        assert got[g] == pytest.approx(want)
    assert got[2] is None and got[3] is None


def test_rank_correlation_of_a_large_group(many_ranges):
    rows = many_ranges.range(400_000).select(F.lit(0).alias("g"), (F.xxhash64("id") % 100_000).alias("a"), (F.col("id") % 4).alias("b"))
    both = rows.toPandas()
    want = both.a.rank().corr(both.b.rank())
    assert E.spearman(rows, ["g"], "a", "b").first()["r"] == pytest.approx(want, abs=1e-9)


def test_runs_across_ranges(many_ranges):
    rows = rows_of(random.Random(4)) + [(7, 5000 + k, 0, 20 < k < 400) for k in range(500)]
    df = many_ranges.createDataFrame(rows, "well_id int, depth_idx int, v int, f boolean").withColumn("depth", F.col("depth_idx") * 1.0)
    got = sorted((r["well_id"] or -1, r["low"], r["high"], r["n"]) for r in V.runs(df, ["well_id"], F.col("f"), pad=0.5).collect())
    want = []
    for key, own in grouped(rows).items():
        run = []
        for k, _, f in [*sorted(own), (None, None, False)]:
            if f:
                run.append(k)
            elif run:
                want.append((key or -1, run[0] - 0.5, run[-1] + 0.5, len(run)))
                run = []
    assert got == sorted(want)
    kept = V.thinned(df, ["well_id"], "depth_idx", 10).filter("well_id = 7").orderBy("depth_idx").collect()
    assert [r["depth_idx"] - 5000 for r in kept] == [i * 499 // 9 for i in range(10)]
