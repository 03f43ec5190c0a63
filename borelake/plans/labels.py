"""Queries over labels, features, samples and association, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from borelake.functions.angles import orientation_confidence, rotated, six
from borelake.operators import features as E
from borelake.operators import labels as L
from borelake.operators.quality import summary
from borelake.plans.series import posed_at, posed_depths, side_of_sector
from borelake.plans.views import over
from borelake.shared import stage, stored
from borelake.sources import adapter as D

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = over(sql, *views)
        return f

    return add


@stage
def based(spark, sf):
    return L.baseline(D.full_image(spark, sf))


def posed_rules(spark, sf):
    return L.ruled(based(spark, sf)).join(posed_depths(spark, sf).drop("depth"), ["well_id", "depth_idx"])


@stage
def confident(spark, sf):
    return L.with_confidence(posed_rules(spark, sf))


def labels(spark, sf):
    return L.both_conventions(confident(spark, sf), D.SECTORS)


@stage
def samples(spark, sf):
    """Labels at sonic depths. Only wells with waveforms get a baseline, and only the image depths that samples take are judged and turned."""
    axis = D.waveforms(spark, sf).filter("receiver = 1").groupBy("well_id", "xsi_idx").agg(F.min("depth").alias("depth"))
    image = D.sounded_image(spark, sf)
    matched = stored(E.matched_depths(D.depths_of(image), axis), "matched")
    taken = matched.select("well_id", "depth_idx").distinct()
    pose = D.pose(spark, sf).join(taken.select("well_id").distinct(), "well_id", "left_semi")
    posed = posed_at(pose, D.depths_of(image).join(taken, ["well_id", "depth_idx"], "left_semi")).drop("depth")
    cells = L.ruled(L.baseline(image).join(taken, ["well_id", "depth_idx"], "left_semi")).join(posed, ["well_id", "depth_idx"])
    sides = E.side_labels(L.both_conventions(L.with_confidence(cells), D.SECTORS), side_of_sector(spark))
    return E.label_samples_at(sides, matched, axis, pose.select("well_id", "sample_idx", "depth", orientation_confidence(F.col("inc_deg")).alias("confidence")))


@stage
def side_features(spark, sf):
    return E.by_side(E.basic_features(D.waveforms(spark, sf)))


@stage
def table6(spark, sf):
    return E.sample_table(samples(spark, sf), side_features(spark, sf), D.SIDES)


@query("label_coverage", """SELECT well_id, count(*) AS n, count_if(presence >= 0) AS n_known, count_if(presence = 1) AS n_candidate, round(count_if(presence =
  1) / count_if(presence >= 0), 6) AS coverage, CASE WHEN count_if(presence = 1) / count_if(presence >= 0) < 1e-6 OR count_if(presence = 1) / count_if(presence
  >= 0) > 0.8 THEN 'error' WHEN count_if(presence = 1) / count_if(presence >= 0) < 0.001 OR count_if(presence = 1) / count_if(presence >= 0) > 0.4 THEN 'warn'
  ELSE 'ok' END AS level FROM ruled GROUP BY well_id""", "ruled")
def label_coverage(spark, sf):
    return L.coverage(L.ruled(based(spark, sf)), ["well_id"]).withColumn("coverage", six(F.col("coverage")))


@query("baseline_cells", """SELECT well_id, az_idx, depth_idx, round(zc_base, 6) AS zc_base, round(finite_fraction, 6) AS finite_fraction, baseline_valid,
  round(zc_ratio, 6) AS zc_ratio, round(relative_drop, 6) + 0.0 AS relative_drop FROM based""", "based")
def baseline_cells(spark, sf):
    return based(spark, sf).select("well_id", "az_idx", F.col("depth_idx").cast("long").alias("depth_idx"), "baseline_valid",
        *(six(F.col(c)).alias(c) for c in ("zc_base", "finite_fraction", "zc_ratio", "relative_drop")))


@query("baseline_wide", """+ pd AS (
    SELECT well_id, az_idx, depth_idx, zc, zf, 0 AS pad FROM filled UNION ALL SELECT well_id, az_idx, -k, zc, zf, 1 FROM filled, range(1, 282) t(k) WHERE depth_idx = 0
    UNION ALL SELECT f.well_id, az_idx, depth_idx + k, zc, zf, 1 FROM filled f JOIN (SELECT well_id, max(depth_idx) AS last FROM filled GROUP BY 1) m ON f.well_id = m.well_id AND depth_idx = last, range(1, 282) t(k)
  ), w AS (
    SELECT *, quantile_disc(zf, 0.5) OVER w AS zc_base, avg((zc IS NOT NULL)::INT) OVER w AS finite_fraction FROM pd WINDOW w AS (PARTITION BY well_id, az_idx ORDER BY depth_idx ROWS BETWEEN 281 PRECEDING AND 281 FOLLOWING)
  ) SELECT well_id, az_idx, count(*) AS n, round(avg(zc_base), 6) AS base, round(avg(finite_fraction), 6) AS finite_fraction FROM w WHERE pad = 0 GROUP BY ALL""", "filled")  # fmt: skip
def baseline_wide(spark, sf):
    """The rolling median of 563 depths, by well and sector."""
    rows = L.baseline(D.full_image(spark, sf), half=281, quantile=0.5)
    return rows.groupBy("well_id", "az_idx").agg(F.count(F.lit(1)).alias("n"), six(F.avg("zc_base")).alias("base"), six(F.avg("finite_fraction")).alias("finite_fraction"))


@query("baseline_report", """SELECT well_id, round(avg(baseline_valid::INT), 6) AS valid_share, avg(baseline_valid::INT) < 0.7 AS warn,
  round(avg(coalesce(relative_drop > 0, false)::INT), 6) AS drop_share, count_if(relative_drop > 0.95) AS n_outlier FROM based GROUP BY well_id""", "based")
def baseline_report(spark, sf):
    return based(spark, sf).groupBy("well_id").agg(six(F.avg(F.col("baseline_valid").cast("int"))).alias("valid_share"),
        (F.avg(F.col("baseline_valid").cast("int")) < 0.7).alias("warn"),
        six(F.avg(F.coalesce(F.col("relative_drop") > 0, F.lit(False)).cast("int"))).alias("drop_share"), F.count_if(F.col("relative_drop") > 0.95).alias("n_outlier"))


@query("label_codes", """SELECT presence, severity, evidence, count(*) AS n FROM (SELECT *, (CASE WHEN valid THEN 0 ELSE 32 END) | (CASE WHEN valid AND by_drop
  THEN 2 ELSE 0 END) | (CASE WHEN valid AND by_limit THEN 1 ELSE 0 END) | (CASE WHEN valid AND by_drop AND by_limit THEN 16 ELSE 0 END) AS evidence FROM ruled)
  GROUP BY ALL""", "ruled")
def label_codes(spark, sf):
    return L.ruled(based(spark, sf)).groupBy("presence", "severity", "evidence").agg(F.count(F.lit(1)).alias("n"))


@query("label_confidence", """SELECT well_id, convention, presence, count(*) AS n, round(sum(confidence), 4) AS total, round(max(confidence), 6) AS most,
  count_if(confidence < 0.25) AS n_low, count_if(confidence >= 0.25 AND confidence < 0.5) AS n_fair, count_if(confidence >= 0.5 AND confidence < 0.75) AS
  n_good, count_if(confidence >= 0.75) AS n_sure FROM labels GROUP BY ALL""", "labels")
def label_confidence(spark, sf):
    c = F.col("confidence")
    return labels(spark, sf).groupBy("well_id", "convention", "presence").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(c), 4).alias("total"),
        six(F.max(c)).alias("most"), F.count_if(c < 0.25).alias("n_low"), F.count_if((c >= 0.25) & (c < 0.5)).alias("n_fair"),
            F.count_if((c >= 0.5) & (c < 0.75)).alias("n_good"), F.count_if(c >= 0.75).alias("n_sure"))


@query("confidence_parts", """SELECT well_id, round(avg(orient), 6) AS c_orientation, round(avg(CASE WHEN baseline_valid THEN finite_fraction ELSE 0 END), 6)
  AS c_baseline, round(avg((rb_deg IS NOT NULL)::INT), 6) AS c_bearing, round(avg(CASE WHEN bad THEN 0 ELSE 1 END), 6) AS c_data, round(avg(confidence), 6) AS
  confidence FROM confident GROUP BY well_id""", "confident")
def confidence_parts(spark, sf):
    rows = posed_rules(spark, sf)
    rows = L.with_confidence(rows, L.isolated(rows, D.SECTORS))
    return rows.groupBy("well_id").agg(*(six(F.avg(c)).alias(c) for c in ("c_orientation", "c_baseline", "c_bearing", "c_data", "confidence")))


PARTS = ("c_strength", "c_baseline", "c_orientation", "c_bearing", "c_data", "confidence")


@query("confidence_by_convention", """+ s AS (
    SELECT convention, CASE WHEN candidate THEN greatest(coalesce(greatest(0, least(1, relative_drop / 0.7)), 0), 0.25) ELSE coalesce(greatest(0, least(1,
  relative_drop / 0.7)), 0) * 0.25 END AS c_strength,
      CASE WHEN baseline_valid THEN finite_fraction ELSE 0 END::DOUBLE AS c_baseline, orient::DOUBLE AS c_orientation, (rb_deg IS NOT NULL)::DOUBLE AS
  c_bearing,
      CASE WHEN bad THEN 0 WHEN zc IS NULL OR zc < 0 OR zc > 20 THEN 0.5 ELSE 1 END::DOUBLE AS c_data, confidence::DOUBLE AS confidence FROM labels)
  SELECT convention, part, count(*) AS n, round(min(v), 6) AS v_min, round(max(v), 6) AS v_max, round(avg(v), 6) AS v_mean, round(quantile_cont(v, 0.5), 6) AS
  v_median
  FROM (UNPIVOT s ON c_strength, c_baseline, c_orientation, c_bearing, c_data, confidence INTO NAME part VALUE v) GROUP BY ALL""", "labels")  # fmt: skip
def confidence_by_convention(spark, sf):
    """Range, mean and median of each part of the confidence under both conventions."""
    done = summary(labels(spark, sf), ["convention"], list(PARTS))
    return done.select("convention", F.col("name").alias("part"), "n", *(six(F.col(c)).alias(c) for c in ("v_min", "v_max", "v_mean", "v_median")))


@query("label_disagreement", """SELECT well_id, count(*) AS n_both, round(avg((p <> m)::INT), 6) AS disagreement FROM (SELECT well_id, depth_idx, az_rot,
  max(CASE WHEN convention = 'plus' THEN presence END) AS p, max(CASE WHEN convention = 'minus' THEN presence END) AS m FROM labels GROUP BY ALL) WHERE p >= 0
  AND m >= 0 GROUP BY well_id""", "labels")
def label_disagreement(spark, sf):
    return L.disagreement(labels(spark, sf)).withColumn("disagreement", six(F.col("disagreement")))


@query("bad_data", """SELECT well_id, sum(n_bad)::BIGINT AS n_bad, round(sum(n_bad) / sum(n), 6) AS share, round(min(n_bad / n), 6) AS depth_min,
  round(max(n_bad / n), 6) AS depth_max, round(avg(n_bad / n), 6) AS depth_mean FROM (SELECT well_id, depth_idx, count(*) AS n, count_if(bad) AS n_bad FROM
  ruled GROUP BY ALL) GROUP BY well_id""", "ruled")
def bad_data(spark, sf):
    by = L.ruled(based(spark, sf)).groupBy("well_id", "depth_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"))
    share = F.col("n_bad") / F.col("n")
    return by.groupBy("well_id").agg(F.sum("n_bad").alias("n_bad"), six(F.sum("n_bad") / F.sum("n")).alias("share"), six(F.min(share)).alias("depth_min"),
        six(F.max(share)).alias("depth_max"), six(F.avg(share)).alias("depth_mean"))


@query("coverage_axes", """SELECT well_id, axis, round(min(c), 6) AS c_min, round(max(c), 6) AS c_max, round(avg(c), 6) AS c_mean, round(quantile_cont(c, 0.5),
  6) AS c_median FROM (SELECT well_id, 'depth' AS axis, avg((presence = 1)::INT) AS c FROM ruled GROUP BY well_id, depth_idx UNION ALL SELECT well_id,
  'azimuth', avg((presence = 1)::INT) FROM ruled GROUP BY well_id, az_idx) GROUP BY well_id, axis""", "ruled")
def coverage_axes(spark, sf):
    rows = L.ruled(based(spark, sf)).groupingSets([["well_id", "depth_idx"], ["well_id", "az_idx"]], "well_id", "depth_idx",
        "az_idx").agg(F.avg((F.col("presence") == 1).cast("int")).alias("c"), F.grouping("depth_idx").alias("g"))
    rows = rows.withColumn("axis", F.when(F.col("g") == 0, "depth").otherwise("azimuth"))
    return rows.groupBy("well_id", "axis").agg(six(F.min("c")).alias("c_min"), six(F.max("c")).alias("c_max"), six(F.avg("c")).alias("c_mean"), six(F.percentile("c", F.lit(0.5))).alias("c_median"))


@query("isolated_outliers", """+ o AS (SELECT well_id, depth_idx, az_idx::BIGINT AS az_idx, well_id * 1099511627776 + depth_idx * 4096 + az_idx AS cell FROM
  ruled WHERE outlier), e AS (SELECT a.cell AS a, b.cell AS b FROM o a JOIN o b ON a.well_id = b.well_id AND abs(a.depth_idx - b.depth_idx) <= 1 AND
  abs(a.az_idx - b.az_idx) <= 1),
  r AS (SELECT * FROM reach) SELECT o.well_id, depth_idx, az_idx FROM o JOIN (SELECT a, count(*) AS n FROM r GROUP BY a) s ON s.a = o.cell WHERE n <= 3""".replace("""r AS (SELECT * FROM reach)""", """reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a,
    e.b FROM reach JOIN e ON reach.b = e.a)""").replace("FROM r GROUP", "FROM reach GROUP"), "ruled")
def isolated_outliers(spark, sf):
    return L.isolated(L.ruled(based(spark, sf)), D.SECTORS).select("well_id", "depth_idx", "az_idx")


SQL["isolated_outliers"] = SQL["isolated_outliers"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("label_objects", """+ o AS (SELECT DISTINCT well_id, depth_idx, az_rot AS az, well_id * 1099511627776 + depth_idx * 4096 + az_rot AS cell FROM labels
  WHERE convention = 'plus' AND presence = 1),
  e AS (SELECT a.cell AS a, b.cell AS b FROM o a JOIN o b ON a.well_id = b.well_id AND b.depth_idx BETWEEN a.depth_idx - 1 AND a.depth_idx + 1 AND (b.az - a.az
  + 13) % 12 <= 2),
  reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
  c AS (SELECT a AS cell, min(b) AS component FROM reach GROUP BY a),
  g AS (SELECT well_id, component, (max(depth_idx) - min(depth_idx) + 1) * 0.5::DOUBLE AS len, count(DISTINCT az) * 30.0::DOUBLE AS width, count(*) AS n FROM o
  JOIN c USING (cell) GROUP BY well_id, component)
  SELECT well_id, count(*) AS n_components, min(len) AS length_min, max(len) AS length_max, round(avg(len), 6) AS length_mean, quantile_cont(len, 0.5) AS
  length_median,
    min(width) AS width_min, max(width) AS width_max, round(avg(width), 6) AS width_mean, quantile_cont(width, 0.5) AS width_median, round(sum(CASE WHEN n <= 3
  THEN n ELSE 0 END) / sum(n), 6) AS speckle_share
  FROM g GROUP BY well_id""", "labels")  # fmt: skip
def label_objects(spark, sf):
    """Connected candidates across the 0/360 seam: how many, how long and wide, and the share of specks. Only candidates are turned, one way, and none gets a confidence."""
    found = L.ruled(L.baseline(D.full_image(spark, sf))).filter("presence = 1").select("well_id", "depth_idx", "az_idx")
    posed = found.join(posed_depths(spark, sf).select("well_id", "depth_idx", "rb_deg"), ["well_id", "depth_idx"])
    cells = posed.withColumn("az_idx", rotated(F.col("az_idx"), F.col("rb_deg"), "plus", D.SECTORS))
    done = L.component_summary(cells, D.SECTORS, 0.5, 30.0)
    return done.withColumns({c: six(F.col(c)) for c in ("length_mean", "width_mean", "speckle_share")})


SQL["label_objects"] = SQL["label_objects"].replace("WITH ", "WITH RECURSIVE ", 1)


GRID = "(VALUES (0.3), (0.35), (0.4)) a(alpha), (VALUES (2.0), (2.5), (3.0)) z(zlimit), (VALUES (0.4, 0.55), (0.45, 0.6), (0.5, 0.65)) s(moderate, severe)"


# nine settings of the rule, as bits of a cell; components by the labels that neighbours pass on
@query("threshold_grid", f"""+ q AS (
    SELECT *, greatest(0, least(1, greatest(coalesce(greatest(0, least(1, relative_drop / 0.7)), 0), 0.25) * CASE WHEN baseline_valid THEN finite_fraction ELSE
  0 END * orient * (rb_deg IS NOT NULL)::INT
      * CASE WHEN bad THEN 0 WHEN zc IS NULL OR zc < 0 OR zc > 20 THEN 0.5 ELSE 1 END)) AS sure FROM confident
  ), runs AS (
    SELECT *, row_number() OVER (ORDER BY alpha, zlimit) AS run FROM (SELECT DISTINCT alpha::DOUBLE AS alpha, zlimit::DOUBLE AS zlimit FROM {GRID})
  ), m AS (
    SELECT q.*, alpha, zlimit, run, coalesce(zc < zc_base * (1 - alpha), false) AS d, coalesce(zc < zlimit, false) AS l FROM q, runs
  ), c AS (
    SELECT alpha, zlimit, run, moderate::DOUBLE AS moderate, severe::DOUBLE AS severe, count_if(valid) AS n_known, count_if(valid AND (d OR l)) AS n_candidate,
      count_if(valid AND d AND NOT l) AS n_drop_only, count_if(valid AND l AND NOT d) AS n_limit_only, count_if(valid AND d AND l) AS n_both,
      count_if(valid AND (d OR l) AND relative_drop >= severe) AS n_severe, count_if(valid AND (d OR l) AND relative_drop >= moderate AND NOT relative_drop >=
  severe) AS n_moderate,
      count_if(outlier) AS n_outlier, count_if(bad) AS n_bad, avg(CASE WHEN valid AND (d OR l) THEN sure END) AS confidence_mean,
      count_if(valid AND (d OR l) AND sure < 0.25) / nullif(count_if(valid AND (d OR l)), 0) AS low_share
    FROM m, (VALUES (0.4, 0.55), (0.45, 0.6), (0.5, 0.65)) s(moderate, severe) GROUP BY ALL
  ), t AS (
    SELECT run, well_id, depth_idx, ((az_idx + k * round_even(coalesce(rb_deg, 0) / 30.0, 0)::INT) % 12 + 12) % 12 AS az, max(CASE WHEN k = 1 AND valid THEN (d
  OR l)::INT END) AS p, max(CASE WHEN k = -1 AND valid THEN (d OR l)::INT END) AS m
    FROM m, (VALUES (1), (-1)) v(k) GROUP BY ALL
  ), a AS (
    SELECT run, avg(p) AS plus_coverage, avg(m) AS minus_coverage, avg(CASE WHEN p IS NOT NULL AND m IS NOT NULL THEN (p <> m)::INT END) AS disagreement FROM t
  GROUP BY run
  ), o AS (SELECT run, well_id, depth_idx, az, ((run * 64 + well_id) * 1048576 + depth_idx) * 16 + az AS cell FROM t WHERE p = 1),
  e AS (SELECT a.cell AS a, b.cell AS b FROM o a JOIN o b ON a.run = b.run AND a.well_id = b.well_id AND b.depth_idx BETWEEN a.depth_idx - 1 AND a.depth_idx +
  1 AND (b.az - a.az + 13) % 12 <= 2),
  reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
  g AS (SELECT run, component, count(*) AS n FROM (SELECT a AS cell, min(b) AS component FROM reach GROUP BY a) JOIN o USING (cell) GROUP BY ALL),
  k AS (SELECT run, count(*) AS n_components, sum(CASE WHEN n <= 3 THEN n ELSE 0 END) / sum(n) AS speckle_share FROM g GROUP BY run)
  SELECT alpha, zlimit, moderate, severe, n_known, n_candidate, round(n_candidate / n_known, 6) AS coverage, n_drop_only, n_limit_only, n_both, n_severe,
  n_moderate, n_outlier, n_bad,
    round(confidence_mean, 6) AS confidence_mean, round(low_share, 6) AS low_share, round(plus_coverage, 6) AS plus_coverage, round(minus_coverage, 6) AS
  minus_coverage,
    round(disagreement, 6) AS disagreement, coalesce(n_components, 0) AS n_components, round(speckle_share, 6) AS speckle_share
  FROM c JOIN a USING (run) LEFT JOIN k USING (run)""", "confident")  # fmt: skip
def threshold_grid(spark, sf):
    """27 settings of the candidate rule: coverage both ways, disagreement, confidence, severity, components and specks."""
    rows = based(spark, sf).join(posed_depths(spark, sf).drop("depth"), ["well_id", "depth_idx"])
    done = L.threshold_grid(rows, [0.3, 0.35, 0.4], [2.0, 2.5, 3.0], [(0.4, 0.55), (0.45, 0.6), (0.5, 0.65)], D.SECTORS)
    return done.withColumns({c: six(F.col(c)) for c in ("coverage", "confidence_mean", "low_share", "plus_coverage", "minus_coverage", "disagreement", "speckle_share")})


SQL["threshold_grid"] = SQL["threshold_grid"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("depth_profile", """SELECT well_id, depth_idx, round(avg(CASE WHEN convention = 'plus' THEN (presence = 1)::INT END), 6) AS plus_share, round(avg(CASE
  WHEN convention = 'minus' THEN (presence = 1)::INT END), 6) AS minus_share, round(avg((confidence >= 0.5)::INT), 6) AS high_share, round(avg(confidence), 6)
  AS confidence FROM labels GROUP BY ALL""", "labels")
def depth_profile(spark, sf):
    one = (F.col("presence") == 1).cast("int")
    return labels(spark, sf).groupBy("well_id",
        F.col("depth_idx").cast("long").alias("depth_idx")).agg(*(six(F.avg(F.when(F.col("convention") == c, one))).alias(f"{c}_share") for c in ("plus",
        "minus")), six(F.avg((F.col("confidence") >= 0.5).cast("int"))).alias("high_share"), six(F.avg("confidence")).alias("confidence"))


@query("waveform_features", """SELECT xsi_idx, receiver, side, round(rms, 5) AS rms, round(peak_abs, 5) AS peak_abs, round(mean_abs, 5) AS mean_abs,
  round(early_energy, 5) AS early_energy, round(late_energy, 5) AS late_energy, round(late_ratio, 5) AS late_ratio FROM features_rcv""", "features_rcv")
def waveform_features(spark, sf):
    return E.basic_features(D.waveforms(spark, sf)).select("xsi_idx", "receiver", "side", *(F.round(f, 5).alias(f) for f in E.FEATURES))


@query("side_features", """SELECT xsi_idx, side, round(rms, 5) AS rms, round(peak_abs, 5) AS peak_abs, round(late_ratio, 5) AS late_ratio, round(rms_median, 5)
  AS rms_median FROM features_side""", "features_side")
def side_features_query(spark, sf):
    return side_features(spark, sf).select("xsi_idx", "side", *(F.round(f, 5).alias(f) for f in ("rms", "peak_abs", "late_ratio", "rms_median")))


@query("feature_report", """SELECT name, count(*) AS n, round(min(v), 5) AS v_min, round(max(v), 5) AS v_max, round(avg(v), 5) AS v_mean,
  round(quantile_cont(v, 0.5), 5) AS v_median FROM (UNPIVOT (SELECT rms, peak_abs, mean_abs, early_energy, late_energy, late_ratio FROM features_rcv) ON
  COLUMNS(*) INTO NAME name VALUE v) GROUP BY name""", "features_rcv")
def feature_report(spark, sf):
    done = summary(E.basic_features(D.waveforms(spark, sf)), [], list(E.FEATURES))
    return done.select("name", "n", *(F.round(c, 5).alias(c) for c in ("v_min", "v_max", "v_mean", "v_median")))


@query("label_samples", """SELECT well_id, xsi_idx, side, depth_idx, round(mismatch, 6) AS mismatch, round(orientation, 6) AS orientation, presence_plus,
  severity_plus, round(confidence_plus, 6) AS confidence_plus, presence_minus, disagreement, azimuthal, non_azimuthal FROM samples""", "samples")
def label_samples(spark, sf):
    return samples(spark, sf).select("well_id", "xsi_idx", "side", F.col("depth_idx").cast("long").alias("depth_idx"), six(F.col("mismatch")).alias("mismatch"),
        six(F.col("orientation")).alias("orientation"), "presence_plus", "severity_plus", six(F.col("confidence_plus")).alias("confidence_plus"),
            "presence_minus", "disagreement", "azimuthal", "non_azimuthal")


@query("sample_subsets", """SELECT conv AS convention, subset, count_if(presence >= 0) AS n_known, count_if(presence = 1) AS n_candidate, count_if(presence =
  0) AS n_non_candidate FROM in_subsets GROUP BY ALL""", "in_subsets")
def sample_subsets(spark, sf):
    return E.subset_counts(samples(spark, sf))


ASSOCIATION = """SELECT *, mean_difference / nullif(sqrt(((n_candidate - 1) * vc + (n_non_candidate - 1) * vn) / (n_candidate + n_non_candidate - 2)), 0) AS
  raw_effect FROM (SELECT conv AS convention, subset, feature, count_if(presence = 1) AS n_candidate, count_if(presence = 0) AS n_non_candidate, avg(CASE WHEN
  presence = 1 THEN v END) AS candidate_mean, avg(CASE WHEN presence = 0 THEN v END) AS non_candidate_mean, quantile_cont(CASE WHEN presence = 1 THEN v END,
  0.5) AS candidate_median,
  avg(CASE WHEN presence = 1 THEN v END) - avg(CASE WHEN presence = 0 THEN v END) AS mean_difference, sum(CASE WHEN presence = 1 THEN v * confidence END) /
  nullif(sum(CASE WHEN presence = 1 THEN confidence END), 0) AS weighted_candidate_mean, CASE WHEN count_if(presence = 1) >= 2 AND count_if(presence = 0) >= 2
  THEN var_samp(CASE WHEN presence = 1 THEN v END) END AS vc, var_samp(CASE WHEN presence = 0 THEN v END) AS vn,
  avg(CASE WHEN severity_plus = 0 THEN v END) AS severity_mean_0, avg(CASE WHEN severity_plus = 1 THEN v END) AS severity_mean_1, avg(CASE WHEN severity_plus =
  2 THEN v END) AS severity_mean_2,
  avg(CASE WHEN severity_plus = 3 THEN v END) AS severity_mean_3, list_filter([severity_mean_0, severity_mean_1, severity_mean_2, severity_mean_3], lambda x: x
  IS NOT NULL) AS known FROM long_features GROUP BY ALL)"""


@query("association", f"""SELECT convention, subset, feature, n_candidate, n_non_candidate, round(candidate_mean, 5) AS candidate_mean, round(candidate_median,
  5) AS candidate_median, round(mean_difference, 5) + 0.0 AS mean_difference, round(weighted_candidate_mean, 5) AS weighted_candidate_mean, round(raw_effect,
  5) + 0.0 AS effect, round(severity_mean_0, 5) AS severity_mean_0, round(severity_mean_1, 5) AS severity_mean_1, round(severity_mean_2, 5) AS severity_mean_2,
  round(severity_mean_3, 5) AS severity_mean_3, CASE WHEN len(known) >= 3 THEN list_sort(known) = known END AS rising, CASE WHEN len(known) >= 3 THEN
  list_reverse_sort(known) = known END AS falling FROM ({ASSOCIATION})""", "long_features")
def association(spark, sf):
    rows = E.association(samples(spark, sf).join(side_features(spark, sf), ["well_id", "xsi_idx", "side"]), list(E.FEATURES))
    return rows.select("convention", "subset", "feature", "n_candidate", "n_non_candidate", "rising", "falling",
        *((F.round(c, 5) + 0.0 if c in ("mean_difference", "effect") else F.round(c, 5)).alias(c) for c in ("candidate_mean", "candidate_median",
        "mean_difference", "weighted_candidate_mean", "effect", "severity_mean_0", "severity_mean_1", "severity_mean_2", "severity_mean_3")))


RANKS = """SELECT conv AS convention, subset, feature, CASE WHEN count(*) >= 3 AND min(ra) < max(ra) AND min(rb) < max(rb) THEN round(corr(ra, rb), 5) + 0.0 END AS %s FROM (
    SELECT *, rank() OVER (PARTITION BY conv, subset, feature ORDER BY v) + (count(*) OVER (PARTITION BY conv, subset, feature, v) - 1) / 2.0 AS ra,
      rank() OVER (PARTITION BY conv, subset, feature ORDER BY %s) + (count(*) OVER (PARTITION BY conv, subset, feature, %s) - 1) / 2.0 AS rb
    FROM long_features WHERE %s >= 0) GROUP BY ALL"""


@query("rank_correlation", f"""SELECT convention, subset, feature, r_severity, r_presence FROM ({RANKS % ("r_severity", *["severity_plus"] * 3)})
  FULL JOIN ({RANKS % ("r_presence", *["presence"] * 3)}) USING (convention, subset, feature)""", "long_features")  # fmt: skip
def rank_correlation(spark, sf):
    """Spearman's correlation of each feature with severity and with presence."""
    rows = samples(spark, sf).join(side_features(spark, sf), ["well_id", "xsi_idx", "side"])
    keys = ["convention", "subset", "feature"]
    long = stored(E.in_subsets(rows).unpivot(["convention", "subset", "severity_plus", "presence"], list(E.FEATURES), "feature", "v"), "long")
    r = {c: E.spearman(long.filter(F.col(c) >= 0), keys, "v", c).select(*keys, (F.round("r", 5) + 0.0).alias(n)) for c, n in (("severity_plus", "r_severity"), ("presence", "r_presence"))}
    return r["severity_plus"].join(r["presence"], keys, "full")


@query("top_effects", f"""SELECT feature, round(raw_effect, 5) + 0.0 AS effect FROM ({ASSOCIATION}) WHERE convention = 'plus' AND subset = 'high_confidence'
  AND raw_effect IS NOT NULL ORDER BY abs(raw_effect) DESC, feature LIMIT 8""", "long_features")
def top_effects(spark, sf):
    rows = E.association(samples(spark, sf).join(side_features(spark, sf), ["well_id", "xsi_idx", "side"]), list(E.FEATURES))
    return E.top_effects(rows).select("feature", (F.round("effect", 5) + 0.0).alias("effect"))


@query("association_matrix", f"""PIVOT (SELECT subset, feature, round(coalesce(raw_effect, 0), 5) + 0.0 AS e FROM ({ASSOCIATION}) WHERE convention = 'plus') ON
  feature IN ('rms', 'peak_abs', 'late_ratio') USING first(e) GROUP BY subset""", "long_features")
def association_matrix(spark, sf):
    rows = E.association(samples(spark, sf).join(side_features(spark, sf), ["well_id", "xsi_idx", "side"]), ["rms", "peak_abs", "late_ratio"])
    return rows.filter("convention = 'plus'").groupBy("subset").pivot("feature", ["rms", "peak_abs", "late_ratio"]).agg(F.first(F.round(F.coalesce("effect", F.lit(0.0)), 5) + 0.0))


@query("sample_table", "SELECT well_id, sample_id, large_error, round(weight, 6) AS weight, weight > 0 AS include, presence_plus, round(rms, 5) AS rms FROM table6", "table6")
def sample_table(spark, sf):
    return table6(spark, sf).select("well_id", "sample_id", "large_error", six(F.col("weight")).alias("weight"), "include", "presence_plus", F.round("rms", 5).alias("rms"))


@query("sample_report", """SELECT well_id, count(*) AS n, count_if(presence_plus = 1) AS n_candidate, count_if(presence_plus = 0) AS n_non_candidate,
  count_if(large_error) AS n_large_error, round(avg((weight > 0)::INT), 6) AS positive_share, count_if(azimuthal AND presence_plus = 1) AS n_sure FROM table6
  GROUP BY well_id""", "table6")
def sample_report(spark, sf):
    p = F.col("presence_plus")
    return table6(spark, sf).groupBy("well_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(p == 1).alias("n_candidate"),
        F.count_if(p == 0).alias("n_non_candidate"), F.count_if("large_error").alias("n_large_error"),
        six(F.avg((F.col("weight") > 0).cast("int"))).alias("positive_share"), F.count_if(F.col("azimuthal") & (p == 1)).alias("n_sure"))


@query("sample_codes", """SELECT field, code, count(*) AS n FROM (UNPIVOT (SELECT presence_plus, presence_minus, severity_plus FROM table6) ON presence_plus,
  presence_minus, severity_plus INTO NAME field VALUE code) GROUP BY ALL
  UNION ALL SELECT 'large_error', 1, count_if(large_error) FROM table6 UNION ALL SELECT 'zero_weight', 1, count_if(weight <= 0) FROM table6 UNION ALL SELECT
  'disagreement', 1, count_if(disagreement) FROM table6""", "table6")  # fmt: skip
def sample_codes(spark, sf):
    """How many samples have each label and severity code, and how many are excluded for what."""
    rows, names = table6(spark, sf), ["presence_plus", "presence_minus", "severity_plus"]
    codes = rows.unpivot([], names, "field", "code").groupBy("field", "code").agg(F.count(F.lit(1)).alias("n"))
    flags = rows.agg(F.count_if("large_error").alias("large_error"), F.count_if(F.col("weight") <= 0).alias("zero_weight"), F.count_if("disagreement").alias("disagreement"))
    return codes.unionByName(flags.unpivot([], ["large_error", "zero_weight", "disagreement"], "field", "n").select("field", F.lit(1).alias("code"), "n"))


@query("sample_ranges", """+ w AS (SELECT rms, peak_abs, mean_abs, early_energy, late_energy, late_ratio, mismatch::DOUBLE AS mismatch, weight::DOUBLE AS
  weight FROM table6),
  r AS (FROM w UNPIVOT INCLUDE NULLS (v FOR name IN (rms, peak_abs, mean_abs, early_energy, late_energy, late_ratio, mismatch, weight)))
  SELECT name, count(*) AS n, round(count(v) / count(*), 6) AS finite_share, round(min(v), 5) AS v_min, round(max(v), 5) AS v_max, round(avg(v), 5) AS v_mean,
  round(quantile_cont(v, 0.5), 5) AS v_median FROM r GROUP BY name""", "table6")  # fmt: skip
def sample_ranges(spark, sf):
    """Finite share, range, mean and median of every feature, the depth error and the weight of the samples."""
    done = summary(table6(spark, sf), [], [*E.FEATURES, "mismatch", "weight"])
    return done.select("name", "n", six(F.col("finite_share")).alias("finite_share"), *(F.round(c, 5).alias(c) for c in ("v_min", "v_max", "v_mean", "v_median")))


@query("scaled_features", "SELECT well_id, sample_id, feature, round(x, 5) AS logged, round(s, 4) + 0.0 AS scaled FROM scaled", "scaled")
def scaled_features(spark, sf):
    names = ["rms", "peak_abs", "late_ratio"]
    rows = E.transformed(table6(spark, sf), names)
    long = rows.select("well_id", "sample_id",
        F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.round(f"log_{f}", 5).alias("logged"), (F.round(f"scaled_{f}", 4) + 0.0).alias("scaled")) for f in names))).alias("x"))
    return long.select("well_id", "sample_id", "x.*")


@query("standard_differences", """SELECT subset, feature AS name, count_if(presence_plus = 1) AS n_candidate, count_if(presence_plus = 0) AS n_non_candidate,
  round((avg(CASE WHEN presence_plus = 1 THEN s END) - avg(CASE WHEN presence_plus = 0 THEN s END)) / nullif(sqrt((var_samp(CASE WHEN presence_plus = 1 THEN s
  END) + var_samp(CASE WHEN presence_plus = 0 THEN s END)) / 2), 0), 4) + 0.0 AS difference FROM scaled, (VALUES ('all_known'), ('high_confidence'),
  ('low_confidence'), ('plus_minus_disagreement')) t(subset) WHERE presence_plus >= 0 AND CASE subset WHEN 'all_known' THEN true WHEN 'high_confidence' THEN
  azimuthal WHEN 'low_confidence' THEN NOT azimuthal ELSE disagreement END GROUP BY ALL""", "scaled")
def standard_differences(spark, sf):
    names = ["rms", "peak_abs", "late_ratio"]
    rows = E.transformed(table6(spark, sf), names).select("presence_plus", "azimuthal", "disagreement", *(F.col(f"scaled_{f}").alias(f) for f in names))
    return E.standard_differences(rows, names).withColumn("difference", F.round("difference", 4) + 0.0)
