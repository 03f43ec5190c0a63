"""Hand-made cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from borelake.functions import angles as A
from borelake.operators import catalog as C
from borelake.operators import convention as R
from borelake.operators import features as E
from borelake.operators import labels as L
from borelake.operators import quality as Q
from borelake.operators import review as V
from borelake.operators import series as S


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(cols))).first()


def test_angles(spark):
    r = one(spark, A.wrap(F.lit(-1.0)), A.wrap(F.lit(360.0)), A.distance(F.lit(350.0), F.lit(10.0)), A.delta(F.lit(350.0), F.lit(10.0)),
        A.orientation_confidence(F.lit(3.0)), A.rotated(F.lit(1), F.lit(105.0), "plus", 12), A.rotated(F.lit(1), F.lit(None).cast("double"), "minus", 12))
    assert list(r) == [359, 0, 20, -20, 0.5, 5, 1]
    df = spark.createDataFrame([(350.0, 1.0), (10.0, 1.0), (None, 5.0)], "a double, w double")
    mean = df.agg(A.circular_mean(F.col("a"))).first()[0]
    assert min(mean, 360 - mean) < 1e-9
    mean = spark.createDataFrame([(0.0, 3.0), (90.0, 1.0)], "a double, w double").agg(A.circular_mean(F.col("a"), F.col("w"))).first()[0]
    assert 0 < mean < 45


def axis(spark, depths, name="a"):
    return spark.createDataFrame([(0, name, k, d) for k, d in enumerate(depths)], "well_id int, series_id string, sample_idx int, depth double")


@pytest.mark.parametrize(("depths", "direction"), [([100.0, 100.5, 101.0], "increasing"), ([100.0, 99.5, 100.5], "non_monotonic"),
    ([3.0, 2.0, 2.0], "nonincreasing"), ([1.0, None], "undetermined"), ([None, None], "undetermined"), ([float(k) for k in range(150)] + [148.5, 160.0], "mostly_increasing")])
def test_axis_audit(spark, depths, direction):
    r = S.audit(axis(spark, depths), ["well_id", "series_id"]).first()
    assert r["direction"] == direction and r["n_missing"] == sum(d is None for d in depths)


def test_overlap_grid_and_verdict(spark):
    three = axis(spark, [0.0, 1.0, 2.0]).union(axis(spark, [1.0, 2.0, 3.0], "b")).union(axis(spark, [0.5, 1.5, 2.5], "c"))
    axes = S.audit(three, ["well_id", "series_id"])
    shared = S.proposed_grid(S.overlap(axes, ["well_id"]))
    r = shared.first()
    assert (r["start"], r["stop"], r["n_grid"], r["block"]) == (1.0, 2.0, 2, None)
    assert S.verdict(axes, shared, ["well_id"]).first()["decision"] == "go"
    assert S.verdict(axes, shared, ["well_id"], unit_known=False).first()["decision"] == "conditional_go"
    assert [x["depth"] for x in S.grid(shared, ["well_id"]).orderBy("grid_idx").collect()] == [1.0, 2.0]
    apart = S.proposed_grid(S.overlap(S.audit(axis(spark, [0.0, 1.0]).union(axis(spark, [5.0, 6.0], "b")), ["well_id", "series_id"]), ["well_id"]))
    assert apart.first()["block"] == "no_overlap"


def test_interpolation_edges(spark):
    source = spark.createDataFrame([(0, 0, 0.0, 0.0, 350.0), (0, 1, 1.0, 10.0, 10.0), (0, 2, 1.0, 99.0, 99.0), (0, 3, None, 5.0, 5.0)], "well_id int, sample_idx int, depth double, v double, a double")
    targets = spark.createDataFrame([(0, d) for d in (-1.0, 0.0, 0.5, 1.0, 2.0)] + [(1, 0.0)], "well_id int, depth double")
    rows = S.bracketed(S.prepared(source, ["well_id"]), targets, ["well_id"], ["v", "a", "sample_idx"])
    got = rows.select("well_id", "depth", S.lerp("v").alias("n"), S.lerp("v", -1.0).alias("f"), S.lerp("v", "clamp").alias("c"), S.lerp("v", "clamp",
        empty=0.0).alias("e"), S.lerp_angle("a").alias("a"), S.lerp_angle_by_parts("a").alias("p"), S.nearest("sample_idx").alias("i")).orderBy("well_id", "depth").collect()
    assert [r["n"] for r in got] == [None, 0, 5, 10, None, None]
    assert [r["f"] for r in got] == [-1, 0, 5, 10, -1, -1]
    assert [r["c"] for r in got] == [0, 0, 5, 10, 10, None] and [r["e"] for r in got] == [0, 0, 5, 10, 10, 0]
    assert [r["i"] for r in got] == [0, 0, 0, 1, 1, None]
    assert min(got[2]["a"], 360 - got[2]["a"]) < 1e-9 and min(got[2]["p"], 360 - got[2]["p"]) < 1e-9


def image(spark, columns, rows):
    return spark.createDataFrame([(0, d, d * 1.0, a, columns[a][d] if a in columns else 10.0) for d in range(rows) for a in range(4)],
        "well_id long, depth_idx long, depth double, az_idx int, zc double")


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_baseline(spark, block):
    cells = image(spark, {1: [10.0, 10.0, 10.0, 4.0, 4.0, 4.0, 10.0, 10.0, 10.0], 2: [10.0] * 4 + [None] + [10.0] * 4}, 9)
    got = {(r["depth_idx"], r["az_idx"]): r for r in L.baseline(cells, half=2, block=block).collect()}
    assert len(got) == 36 and got[4, 1]["relative_drop"] > 0.5 and got[4, 0]["relative_drop"] == 0
    assert not got[4, 2]["baseline_valid"] and got[3, 2]["baseline_valid"] and got[0, 2]["finite_fraction"] == 1


@pytest.mark.parametrize("half", [1, 10, 281])
def test_rolling_window(half):
    import numpy as np

    rng = np.random.default_rng(half)
    values = np.round(rng.random(700), 2)
    got = L.rolling(values, half, 0.9)
    for i in range(700):
        window = np.sort(values[max(0, i - half) : i + half + 1])
        assert got[i] == window[max(math.ceil(len(window) * 0.9), 1) - 1]
    assert len(L.rolling(values[:3], half, 0.5)) == 3 and len(L.rolling(values[:0], half, 0.5)) == 0


def test_label_rules_and_confidence(spark):
    rows = [(0, 0, 0.0, 0, 4.0, 10.0, 1.0, True, 0.4, 0.6, 8.0, 90.0), (0, 1, 1.0, 0, 9.0, 10.0, 1.0, True, 0.9, 0.1, 8.0, 90.0), (0, 2, 2.0, 0, None, 10.0,
        1.0, False, None, None, 8.0, 90.0), (0, 3, 3.0, 0, 0.3, 10.0, 1.0, True, 0.03, 0.97, 8.0, 90.0), (0, 4, 4.0, 0, 4.0, 10.0, 1.0, True, 0.4, 0.6, 0.5,
            90.0), (0, 5, 5.0, 0, 2.0, 2.5, 1.0, True, 0.8, 0.2, None, None)]
    based = spark.createDataFrame(rows, "well_id long, depth_idx long, depth double, az_idx int, zc double, zc_base double, finite_fraction double, baseline_valid boolean, zc_ratio double, relative_drop double, inc_deg double, rb_deg double")
    got = L.with_confidence(L.ruled(based)).orderBy("depth_idx").collect()
    assert [r["presence"] for r in got] == [1, 0, -1, -1, 1, 1] and [r["severity"] for r in got] == [3, 0, -1, -1, 3, 1]
    assert [r["evidence"] for r in got] == [2, 0, 32, 32, 2, 1]
    assert got[0]["confidence"] == pytest.approx(0.6 / 0.7) and got[4]["confidence"] == 0 and got[5]["confidence"] == 0
    turned = {r["convention"]: r["az_rot"] for r in L.both_conventions(based.limit(1), 8).collect()}
    assert turned == {"plus": 2, "minus": 6}


def test_components_across_the_seam(spark):
    cells = spark.createDataFrame([(0, d, a) for d, a in ((1, 0), (2, 0), (1, 7), (2, 7), (0, 4))], "well_id long, depth_idx long, az_idx int")
    r = L.component_summary(cells, 8, 1.0, 45.0).first()
    assert (r["n_components"], r["length_max"], r["width_max"], r["speckle_share"]) == (2, 2, 90, 0.2)
    flat = L.cell_components(cells, 8, wrap=False)
    assert flat.select("component").distinct().count() == 3


@pytest.mark.parametrize("wrap", [True, False])
def test_components_of_all_runs_over_tiles(spark, wrap):
    """Tiles of three depths against one walk over all cells, for three nested masks."""
    import random

    rng = random.Random(7)
    cells = {(w, d, a): rng.choice([0, 0, 1, 3, 7]) for w in (0, 1) for d in range(40) for a in range(6)}
    df = spark.createDataFrame([(*c, m) for c, m in cells.items() if m], "well_id long, depth_idx long, az_idx int, bits int")
    found = L.cell_components(df, 6, wrap, "bits", tile=3).collect()
    for run in range(3):
        left = {c for c, m in cells.items() if m >> run & 1}
        got = {}
        for r in found:
            if r["run"] == run:
                got.setdefault(r["component"], set()).add((r["well_id"], r["depth_idx"], r["az_idx"]))
        want = []
        while left:
            todo = [left.pop()]
            whole = set(todo)
            while todo:
                w, d, a = todo.pop()
                for x in ((w, d + i, (a + j) % 6 if wrap else a + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if x in left:
                        left.remove(x)
                        whole.add(x)
                        todo.append(x)
            want.append(whole)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_tied_groups_of_sides(spark):
    """Of complete groups with equal sums, the smaller prefix is taken, whatever the order of rows."""
    rows = [(1, 1, "xsi", f"{p}Side{c}", [10, 1024], "double") for p in ("b", "a", "c") for c in "ABCDEFGH"]
    for part in (rows, rows[::-1]):
        best = C.recommended(spark.createDataFrame(part, "well_id int, receiver int, role string, field_path string, shape array<int>, dtype string")).filter("target = 'xsi.waveform'").first()
        assert best["field_path"] == "aSide{A-H}"


def test_features(spark):
    rows = spark.createDataFrame([(0, 0, r, 0, s) for r, s in ((1, [1.0, -1.0, 2.0, -2.0]), (2, [2.0] * 4), (3, [None, 100.0, float("nan"), 100.0]))],
        "well_id long, xsi_idx long, receiver int, side int, samples array<double>")
    got = {r["receiver"]: r for r in E.basic_features(rows, (0.0, 0.5), (0.5, 1.0)).collect()}
    one_ = got[1]
    assert (one_["rms"], one_["peak_abs"], one_["mean_abs"], one_["early_energy"], one_["late_energy"], one_["late_ratio"]) == (math.sqrt(2.5), 2, 1.5, 1, 4, 4)
    assert got[3]["rms"] == 100
    side = E.by_side(E.basic_features(rows)).first()
    assert side["peak_abs"] == pytest.approx(104 / 3) and side["peak_abs_median"] == 2


def test_association_and_weights(spark):
    rows = [(0, k, 0, int(k % 2), int(k % 2) * (1 + k % 3), 0.9, int(k % 2), 0.9, False, True, True, 10.0 if k % 2 else 1.0, 0.1 if k % 3 else 0.9) for k in range(40)]
    samples = spark.createDataFrame(rows,
        "well_id long, xsi_idx long, side int, presence_plus int, severity_plus int, confidence_plus double, presence_minus int, confidence_minus double, disagreement boolean, azimuthal boolean, non_azimuthal boolean, v double, mismatch double")
    r = E.association(samples, ["v"]).filter("subset = 'all_known'").first()
    assert (r["candidate_mean"], r["non_candidate_mean"], r["mean_difference"], r["difference_share"], r["effect"]) == (10, 1, 9, 9, None)
    assert r["spearman_presence"] == pytest.approx(1) and r["rising"]
    features = samples.select("well_id", "xsi_idx", "side", *(F.lit(1.0).alias(f) for f in E.FEATURES))
    got = E.sample_table(samples, features, 2).groupBy("large_error").agg(F.max("weight").alias("w")).collect()
    assert {x["large_error"]: x["w"] for x in got} == {False: 0.9, True: 0.0}
    scaled = E.transformed(samples, ["v"]).agg(F.min("scaled_v"), F.max("scaled_v")).first()
    assert scaled[1] > scaled[0]


def test_planted_sign_wins(spark):
    """An object that keeps its place against gravity, seen by a turning tool."""
    rows = []
    for d in range(60):
        rb = (d * 37) % 360
        rows.append((0, d, ((90 - rb) % 360) // 45, float(rb - rb % 45)))
    tracks = spark.createDataFrame([(w, d, int(a), int(a), b, d // 8) for w, d, a, b in rows], "well_id long, depth_idx long, az_low int, side_top int, rb_deg double, window int")
    totals = R.hypothesis_totals(R.window_scores(tracks, 8, 8))
    best = totals.orderBy(F.desc("total")).first()
    assert best["sign"] == 1 and best["side_offset"] == 0
    votes = {(r["attribute"], r["choice"]): r for r in R.attribute_votes(totals).collect()}
    assert votes["sign", 1.0]["enough"] and not votes["sign", -1.0]["enough"]
    assert R.hypotheses(spark).distinct().count() == 64


def test_turned_places(spark):
    rows = spark.createDataFrame([(0, 0, s, 100.0, float(s)) for s in range(4)] + [(0, 1, 0, None, 1.0)], "well_id int, depth_idx int, side int, rb_deg double, energy double")
    got = {(r["sign"], r["place"]): (r["side"], r["azimuth"]) for r in R.turned(rows, "side", 4).collect()}
    assert got == {(1, 1): (3, 10.0), (1, 2): (0, 100.0), (1, 3): (1, 190.0), (1, 4): (2, 280.0), (-1, 1): (2, 80.0), (-1, 2): (3, 170.0), (-1, 3): (0, 260.0), (-1, 4): (1, 350.0)}


def test_stages_are_made_once(spark):
    from borelake.shared import run, stage

    made = []

    @stage
    def numbers(spark, sf_dir):
        made.append(sf_dir)
        return spark.range(3)

    @run
    def query(spark, sf_dir):
        return numbers(spark, sf_dir).join(numbers(spark, sf_dir), "id").join(numbers(spark, "other"), "id")

    assert query(spark, "one").count() == 3 and made == ["one", "other"]
    assert query(spark, "one").count() == 3 and len(made) == 4 and numbers(spark, "one").count() == 3 and len(made) == 5


def test_catalog(spark):
    files = [(1, "raw/CAST.mat"), (1, "raw/pose_a.mat"), *((1, f"raw/XSILMR{k:02}.mat") for k in range(1, 13))]
    counts = C.role_counts(C.classified(spark.createDataFrame(files, "well_id long, path string")))
    odd = spark.createDataFrame([*files, (None, "raw/notes.txt"), (2, "raw/XSILMR01.mat")], "well_id long, path string")
    told = spark.createDataFrame([(1, 12), (2, 1)], "well_id long, expected int")
    got = {r["well_id"]: (list(r["errors"]), list(r["warnings"])) for r in C.manifest_warnings(C.classified(odd), by_well=told).collect()}
    assert got == {1: ([], ["unusual_receivers"]), 2: ([], ["no_cast", "no_pose", "unusual_receivers"]), None: (["no_well_id"], ["no_cast", "no_pose", "receivers"])}
    assert C.manifest_errors({"schema_version": 1, "created_at": "x"}, odd.limit(0)) == ["data_version", "no_wells"]
    assert {(r["role"], r["problem"]) for r in C.missing_roles(counts, ["xsi", "cast", "pose"], 13).collect()} == {("xsi", "receivers")}
    fields = spark.createDataFrame([(1, 1, "xsi", f"WVFSide{c}", [10, 1024], "double") for c in "ABCDEFGH"] + [(1, 1, "xsi", "log.Depth", [10], "double"), (1,
        2, "xsi", "log.Depth", [11], "double"), (1, None, "pose", "Tool.RelBearing", [9], "double"), (1, None, "cast", "odd", [9], "char")],
            "well_id long, receiver int, role string, field_path string, shape array<int>, dtype string")
    best = {r["target"]: (r["field_path"], round(r["confidence"], 6)) for r in C.recommended(fields).collect()}
    assert best["xsi.depth"] == ("log.Depth", 0.93) and best["xsi.waveform"] == ("WVFSide{A-H}", 0.95)
    assert best["pose.relbearing"] == ("Tool.RelBearing", 0.96) and best["cast.zc"] == (C.TODO, 0) and len(best) == 8
    fields = fields.filter("role = 'xsi'")
    assert C.side_groups(fields).first()["prefix"] == "WVFSide"
    audit = C.field_audit(fields, 3).first()
    assert (audit["n_missing"], audit["n_name_sets"], audit["n_shape_mismatch"]) == (1, 2, 1)


def test_quality_review_and_gates(spark, tmp_path):
    rows = spark.createDataFrame([(0, k, float(k), None if k == 3 else float(k)) for k in range(10)], "well_id long, depth_idx long, depth double, v double")
    q = Q.numeric(rows, ["well_id"], F.col("v")).first()
    assert (q["n"], q["n_finite"], q["warn"]) == (10, 9, True)
    assert V.runs(rows, ["well_id"], F.col("v").isNull() | (F.col("v") > 7)).count() == 2
    assert V.thinned(rows, ["well_id"], "depth_idx", 4).count() == 4
    assert sum(r["n"] for r in V.histogram(rows, [], "v", 4).collect()) == 9
    edge = spark.createDataFrame([(0, "a", 0.2)], "well_id long, metric string, value double")
    assert [V.decided(edge, [("a", how, 0.2, "warn")]).first()["decision"] for how in ("at_most", "below")] == ["go", "conditional_go"]
    metrics = spark.createDataFrame([(0, "a", 1.0), (1, "a", 0.0), (2, "b", 1.0)], "well_id long, metric string, value double")
    got = {r["well_id"]: r["decision"] for r in V.decided(metrics, [("a", "at_least", 0.5, "warn")]).collect()}
    assert got == {0: "go", 1: "conditional_go", 2: "no_go"}
    rows.write.parquet(f"{tmp_path}/t")
    assert C.files(spark, f"{tmp_path}/t", "w").count() >= 1


def test_long_columns_are_linear(spark):
    """A column of 20,000 rows, in blocks of 500, against plain interpolation."""
    import numpy as np

    rng = np.random.default_rng(3)
    value = np.where(rng.random(20_000) < 0.3, rng.random(20_000), np.nan)
    value[3000:9000] = np.nan  # blocks without a known row
    rows = spark.createDataFrame([(0, k, k * 0.5, None if np.isnan(v) else float(v)) for k, v in enumerate(value)], "well_id int, depth_idx int, depth double, v double")
    got = {r["depth_idx"]: r["f"] for r in S.gap_filled(rows, ["well_id"], "v", "f", block=500).collect()}
    known = np.flatnonzero(~np.isnan(value))
    want = np.interp(np.arange(20_000), known, value[known])
    assert max(abs(got[k] - want[k]) for k in range(20_000)) < 1e-9
    targets = spark.createDataFrame([(0, k, d) for k, d in enumerate((-1.0, 0.0, 2500.25, 9999.5, 20_000.0))], "well_id int, k int, depth double")
    source = rows.filter("v is not null").select("well_id", "depth", "v")
    near = {r["k"]: r["x"] for r in S.bracketed(source, targets, ["well_id"], ["v"], span=100.0).select("k", S.lerp("v", "clamp").alias("x")).collect()}
    assert all(abs(near[k] - np.interp(d, known * 0.5, value[known])) < 1e-9 for k, d in enumerate((-1.0, 0.0, 2500.25, 9999.5, 20_000.0)))


def test_limits_and_contiguity(spark):
    assert L.limit_of("3.5") == (3.5, "confirmed") and L.limit_of("TODO") == (2.5, "requires_confirmation")
    with pytest.raises(ValueError, match="not confirmed"):
        L.limit_of(None, confirmed=True)
    rule, errors, warnings = L.rule_of({"threshold": {"zc_min_limit": "TODO"}})
    assert (rule["alpha"], rule["limit"], errors, warnings) == (0.35, 2.5, [], ["limit"])
    rule, errors, warnings = L.rule_of({"threshold": {"relative_drop_alpha": 1.0, "zc_min_limit": None, "require_confirmed_zc_min_limit": True}, "severity": {"mild_min_drop": 0.7}})
    assert rule["limit"] is None and errors == ["alpha", "limit", "severity"] and warnings == []
    rows = spark.createDataFrame([(0, 1), (0, 2), (0, 4), (1, 5), (1, 6)], "well_id int, k int")
    assert {r["well_id"]: r["contiguous"] for r in S.contiguity(rows, ["well_id"], "k").collect()} == {0: False, 1: True}
    assert S.limited(rows, "k", 4).count() == 2 and S.limited(rows, "k", None).count() == 5


def test_jumps_stay_inside_windows(spark):
    """A bearing that jumps across a window's edge only is no jump of the window; one sample has jump 0, no sample none."""
    pose = spark.createDataFrame([(0, 0.0, 8.0, 0.0), (0, 1.0, 8.0, 10.0), (0, 2.5, 8.0, 170.0), (0, 3.5, 8.0, 180.0), (0, 4.5, 8.0, 180.0)],
        "well_id int, depth double, inc_deg double, rb_deg double")
    spans = spark.createDataFrame([(0, 0.0, 8.0)], "well_id int, start double, stop double")
    got = {r["window"]: r for r in R.windows(pose, spans, 2.0).collect()}
    assert [got[k]["jump_max"] for k in range(4)] == [10.0, 10.0, 0.0, None]
    assert [list(got[k]["reasons"]) for k in range(4)] == [[], [], ["few_samples"], ["few_samples", "low_orientation", "low_inclination", "bearing_jump"]]
    out = spark.createDataFrame([(1.5, 2.0, "M", "slips"), (0.0, 9.0, "ft", "other")], "start double, stop double, unit string, reason string")
    got = {r["window"]: r for r in R.windows(pose, spans, 2.0, out, "m").collect()}
    assert list(got[0]["reasons"]) == ["interval:slips"] and list(got[1]["reasons"]) == []
    assert [r["window"] for r in R.best_windows(R.windows(pose, spans, 2.0), 1).collect()] == [0]


def test_samples_only_judge_what_they_take(spark, monkeypatch):
    """Wells without waveforms get no baseline, and depths that no sample takes are not turned."""
    from borelake.operators import labels as L
    from borelake.plans import labels as P

    seen = {}
    for name in ("baseline", "both_conventions"):
        def watch(rows, *more, name=name, f=getattr(L, name)):
            seen[name] = rows
            return f(rows, *more)
        monkeypatch.setattr(L, name, watch)
    rows = P.samples(spark, "/root/testdata/sf0.001")
    taken = {(r["well_id"], r["depth_idx"]) for r in rows.select("well_id", "depth_idx").distinct().collect()}
    assert taken and {w for w, _ in taken} == {0}
    assert {r["well_id"] for r in seen["baseline"].select("well_id").distinct().collect()} == {0}
    assert {(r["well_id"], r["depth_idx"]) for r in seen["both_conventions"].select("well_id", "depth_idx").distinct().collect()} == taken


def test_angles_by_parts_are_those_of_the_c_library(spark):
    """Between equal bearings of 0 to 359 degrees, each angle to its last bit as DuckDB has it."""
    import duckdb

    rows = spark.range(360).selectExpr("id", "named_struct('depth', 0D, 'rb', cast(id as double)) as before", "named_struct('depth', 1D, 'rb', cast(id as double)) as after", "0.6D as depth")
    got = {r["id"]: r["a"] for r in rows.select("id", S.lerp_angle_by_parts("rb").alias("a")).collect()}
    turn = "degrees(atan2(sin(radians(k::DOUBLE)), cos(radians(k::DOUBLE))))"
    want = dict(duckdb.sql(f"SELECT k, {turn} - floor({turn} / 360.0) * 360.0 FROM range(360) t(k)").fetchall())
    assert got == want
    none = rows.selectExpr("id", "if(id = 1, null, before) as before", "after", "if(id = 2, null, depth) as depth").filter("id in (1, 2)")
    assert [r["a"] for r in none.select(S.lerp_angle_by_parts("rb").alias("a"), "id").orderBy("id").collect()][0] is None
