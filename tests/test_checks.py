"""Rules, contracts, interval joins and published stages."""

import json
import random

import pytest
from pyspark.sql import functions as F

from borelake.operators import checks as K
from borelake.operators import convention as R
from borelake.operators import intervals
from borelake.operators import publish as P


def test_label_rules(spark):
    rows = [(1, 1, 2, 0.5, "plus", True), (2, 5, 2, 0.5, "plus", True), (3, 0, None, 0.5, "minus", True), (4, 1, 1, 1.5, "other", True), (5, -1, -1,
        float("nan"), "plus", None), (6, 0, 9, None, None, False)]
    df = spark.createDataFrame(rows, "k int, presence int, severity int, confidence double, convention string, no_final_labels boolean")
    rules = K.label_rules(final="no_final_labels")
    got = {r["rule"]: (r["n"], r["level"], r["key"] and json.loads(r["key"])["k"]) for r in K.checked(df, rules, ["k"]).collect()}
    assert got == {
        "presence_code": (1, "error", 2), "severity_code": (1, "error", 6), "confidence_range": (1, "error", 4), "confidence_not_finite": (2, "warning", 5), "shape_of_severity": (1, "error", 3),
        "shape_of_confidence": (1, "error", 6), "convention": (2, "error", 4), "final_labels": (2, "error", 5),
    }
    good, bad = K.quarantined(df, rules)
    assert [r["k"] for r in good.collect()] == [1] and good.columns == df.columns
    assert {r["k"]: list(r["broken"]) for r in bad.collect()}[6] == ["severity_code", "shape_of_confidence", "convention", "final_labels"]
    assert {r["n"] for r in K.checked(df.limit(0), rules, ["k"]).collect()} == {0}


def test_contract(spark):
    waves = spark.createDataFrame([(0, d, 1, s, [1.0] * 4) for d in range(3) for s in range(2)], "well_id int, xsi_idx int, receiver int, side int, samples array<double>")
    image = spark.createDataFrame([(0, d, a, 1.0) for d in range(5) for a in range(3)], "well_id int, depth_idx int, az_idx int, zc double")
    axes = {"side": spark.range(2), "time": spark.range(4), "sector": spark.range(3), "depth": spark.range(5)}
    said = lambda *a: {tuple(r) for r in K.contract_issues(spark, *a).collect()}
    assert said({"waveforms": waves, "image": image}, axes) == {("waveforms", "warning", "depths")}
    assert said({"waveforms": waves, "image": image.filter("az_idx < 2")}, axes | {"time": spark.range(9), "side": spark.range(8)}) == {("waveforms", "error",
        "sides"), ("waveforms", "error", "samples"), ("waveforms", "warning", "depths"), ("image", "error", "sectors")}
    flat = waves.withColumn("samples", F.lit(1.0))
    assert said({"waveforms": flat.drop("side")}, {k: v for k, v in axes.items() if k != "time"}) == {("waveforms", "error", "missing_column:side"),
        ("waveforms", "error", "rank:samples"), ("image", "error", "missing_table"), ("axis", "error", "missing_axis:time")}


def test_decision(spark):
    issues = spark.createDataFrame([("a", "warning", 2), ("b", "error", 0), ("a", "warning", 1)], "artifact string, level string, n long")
    got = {r["artifact"]: tuple(r)[1:] for r in K.decided(issues, ["a", "b"]).collect()}
    assert got == {"a": (0, 3, "warning", "conditional_go"), "b": (0, 0, "pass", "conditional_go")}
    worse = issues.union(spark.createDataFrame([("b", "error", 1)], issues.schema))
    assert {r["decision"] for r in K.decided(worse, ["a", "b"]).collect()} == {"no_go"}


def test_interval_joins(spark):
    rng = random.Random(5)
    spans = [(k, rng.randrange(2), a, a + w) for k in range(60) for a, w in [(rng.randrange(-50, 50) / 2, rng.choice([0.0, 0.5, 3.0, 40.0]))]] + [(97, 0, None,
        3.0), (98, 0, 5.0, float("inf")), (99, 1, 4.0, 1.0)]
    points = [(k, rng.randrange(2), rng.randrange(-60, 120) / 2) for k in range(300)] + [(999, 0, None)]
    s = spark.createDataFrame(spans, "s int, w int, low double, high double")
    p = spark.createDataFrame(points, "p int, w int, depth double")
    got = {(r["p"], r["s"]) for r in intervals.points_in(p, s, ["w"], "depth", "low", "high").collect()}
    sound = [x for x in spans if x[0] < 97]
    assert got == {(a, b) for a, v, d in points if d is not None for b, w, lo, hi in sound if v == w and lo <= d <= hi}
    plan = intervals.points_in(p, s, ["w"], "depth", "low", "high")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    one = [x for x in sound if x[1] == 0]
    two = [x for x in sound if x[1] == 1]
    frame = lambda rows, n: spark.createDataFrame([(k, lo, hi) for k, _, lo, hi in rows], f"{n} int, {n}_low double, {n}_high double")
    met = intervals.overlapping(frame(one, "a"), frame(two, "b"), [], F.col("a_low"), F.col("a_high"), F.col("b_low"), F.col("b_high"))
    found = [(r["a"], r["b"]) for r in met.collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a, _, lo, hi in one for b, _, low, high in two if lo < hi and low < high and max(lo, low) < min(hi, high)}


def test_excluded_windows(spark):
    """Only overlap in the same unit excludes; touching ends don't; ends may be swapped."""
    rows = spark.createDataFrame([(1, 0, 100.0, 104.0), (1, 1, 104.0, 106.0), (1, 2, 107.0, 110.0), (1, 3, 108.0, 110.0)], "well_id int, window int, low double, high double")
    gone = spark.createDataFrame([(108.0, 104.0, "FT", "b"), (104.5, 105.0, "ft", "a"), (0.0, 500.0, "m", "c")], "start double, stop double, unit string, reason string")
    got = {r["window"]: list(r["left_out"]) for r in R.excluded(rows, gone, "ft").collect()}
    assert got == {1: ["interval:a", "interval:b"], 2: ["interval:b"]}


def test_sliding_windows_count_rows(spark):
    """Missing depths don't shrink a window, and the last one ends with the last row."""
    depths = [0, 1, 2, 10, 11, 12, 50, 51, 52, 53]
    rows = spark.createDataFrame([(0, d, float(k), 1.0, 1.0, 0.9, 0.0) for k, d in enumerate(depths)],
        "well_id int, depth_idx int, depth double, image_range double, side_range double, orientation double, rb_deg double")
    got = {r["window"]: (r["n"], r["first"], r["last"]) for r in R.sliding_windows(rows, 4, 3).collect()}
    assert got == {0: (4, 0, 10), 3: (4, 10, 50), 6: (4, 50, 53)}
    short = {r["window"]: r["n"] for r in R.sliding_windows(rows, 20, 3).collect()}
    assert short == {0: 10}


def test_published(spark, tmp_path, monkeypatch):
    rows = spark.range(100).withColumn("s", F.array("id"))
    at = f"{tmp_path}/stage"
    stamp = P.published(rows, at, "v1", "alpha: 1")
    back = spark.read.parquet(at)
    assert stamp["rows"] == 100 == back.filter("data_version = 'v1' and no_final_labels").count() and P.stamp_of(spark, at) == stamp and P.verified(spark, at)
    with pytest.raises(FileExistsError):
        P.published(rows, at, "v2", "x")
    # a failure between write and publish leaves the old output and no rest
    monkeypatch.setattr(P, "_renamed", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        P.published(rows.limit(3), at, "v2", "x", replace=True)
    assert P.stamp_of(spark, at) == stamp and P.verified(spark, at) and [f.name for f in tmp_path.iterdir()] == ["stage"]
    monkeypatch.undo()
    assert P.published(rows.limit(3), at, "v2", "x", replace=True)["rows"] == 3 and spark.read.parquet(at).count() == 3
    assert [f.name for f in tmp_path.iterdir()] == ["stage"]
    assert P.published(rows, f"{tmp_path}/c", "v1", "x", kind="csv")["rows"] == 100
    assert P.digest(rows)[1] == P.digest(rows.repartition(7))[1] != P.digest(rows.limit(99))[1]


def test_checked_loader(spark):
    from borelake.sources.loader import load

    rows = [(0, 0, 3, "2.5"), (0, 0, 3, "1.5"), (0, 1, 200, "1"), (0, None, 1, "1"), (0, 2, 1, "x"), (0, 3, 1, "NaN"), (0, 4, 1, "-1"), (0, -1, 1, "1")]
    df = spark.createDataFrame([(*r, "more") for r in rows], "well_id int, depth_idx int, az_idx int, zc string, other string")
    found = load(df, "image")
    assert sorted(((r["depth_idx"], r["zc"]) for r in found.rows.collect()), key=str) == [(0, 1.5), (2, None), (3, None), (4, -1.0)]
    assert found.rows.columns == ["well_id", "depth_idx", "az_idx", "zc"]
    assert sorted((tuple(r["broken"]), r["times"]) for r in found.broken.collect()) == [(("depth_index",), 1), (("no_depth_idx",), 1), (("repeated",), 2), (("sector",), 1)]
    assert {r["rule"]: r["n"] for r in found.counts.collect() if r["n"]} == {"no_depth_idx": 1, "sector": 1, "depth_index": 1, "negative": 1, "missing": 2, "repeated": 1}
    with pytest.raises(ValueError, match="no column zc"):
        load(df.drop("zc"), "image")
    waves = spark.createDataFrame([(0, 0, 1, 0, 1.0, [1.0, float("inf")]), (0, 0, 1, 9, 1.0, [1.0]), (0, 0, 1, 1, 1.0, None)], "well_id long, xsi_idx long, receiver int, side int, depth double, samples array<double>")
    found = load(waves, "waveforms")
    assert [r["samples"] for r in found.rows.collect()] == [[1.0, None]] and found.broken.count() == 2
    assert load(waves.limit(0), "waveforms").rows.count() == 0
