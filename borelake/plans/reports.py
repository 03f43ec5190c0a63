"""Queries over reports, contracts and the remaining gates, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borelake.functions.angles import six
from borelake.operators import catalog as C
from borelake.operators import checks as K
from borelake.operators import convention as R
from borelake.operators import features as E
from borelake.operators import labels as L
from borelake.operators import publish
from borelake.operators import review as V
from borelake.operators import series as S
from borelake.plans import labels as P
from borelake.plans.review import SQL as REVIEW_SQL
from borelake.plans.views import over
from borelake.shared import new_folder, stored
from borelake.sources import adapter as D

QUERIES, SQL = {}, {}
NAMES = ["rms", "peak_abs", "late_ratio"]
FIELD_SCORES = REVIEW_SQL["field_scores"]


def query(name: str, sql: str | None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = over(sql, *views)
        return f

    return add


@query("depth_contiguity", """SELECT well_id, count(*) AS n, max(depth_idx) - min(depth_idx) + 1 = count(DISTINCT depth_idx) AS contiguous
  FROM image_cells GROUP BY well_id""", "image_cells")  # fmt: skip
def depth_contiguity(spark, sf):
    """Is the depth index of the measured cells without gaps?"""
    return S.contiguity(D.image_cells(spark, sf), ["well_id"], "depth_idx").select("well_id", "n", "contiguous")


@query("centre_windows", """SELECT well_id, round(low, 6) AS low, round(high, 6) AS high FROM (
    SELECT well_id, greatest(a, (a + b) / 2 - least(1.0, (b - a) / 2)) AS low, least(b, (a + b) / 2 + least(1.0, (b - a) / 2)) AS high
    FROM (SELECT well_id, min(depth) AS a, max(depth) AS b FROM pose GROUP BY well_id))""", "pose")  # fmt: skip
def centre_windows(spark, sf):
    """The window of at most 2 in the middle of each well's pose."""
    spans = D.pose(spark, sf).groupBy("well_id").agg(F.min("depth").alias("start"), F.max("depth").alias("stop"))
    return S.centre_window(spans, 2.0).select("well_id", six(F.col("low")).alias("low"), six(F.col("high")).alias("high"))


@query("side_contrast", """SELECT well_id, count(*) AS n_sides, round(max(m) - min(m), 6) AS contrast FROM (
    SELECT well_id, side, quantile_cont(abs(v), 0.5) AS m FROM (SELECT well_id, side, unnest(samples) AS v FROM waveforms) GROUP BY ALL) GROUP BY well_id""", "waveforms")  # fmt: skip
def side_contrast(spark, sf):
    """Range over sides of the median amplitude."""
    return R.side_contrast(D.waveforms(spark, sf)).select("well_id", "n_sides", six(F.col("contrast")).alias("contrast"))


@query("azimuth_preview", """+ o AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY depth) - 1 AS r, count(*) OVER (PARTITION BY well_id) AS n FROM pose)
  SELECT well_id, depth, candidate, side, round(wrap(side * 45.0 + k * rb_deg), 6) + 0.0 AS azimuth
  FROM o, (VALUES ('plus', 1), ('minus', -1), ('none', 0)) t(candidate, k), (SELECT unnest(range(8))::INT AS side)
  WHERE r = 0 OR r = n // 2 OR r = n - 1""", "pose")  # fmt: skip
def azimuth_preview(spark, sf):
    """Side azimuths at the first, middle and last depth of each well."""
    rows = R.azimuth_preview(D.pose(spark, sf), D.SIDES)
    return rows.select("well_id", "depth", "candidate", "side", six(F.col("azimuth")).alias("azimuth"))


@query("review_layers", """SELECT well_id, count_if(p = 1) AS n_plus, count_if(m = 1) AS n_minus, count_if(p <> m) AS n_apart, count_if(bad) AS n_bad, count_if(outlier) AS n_outlier,
    round(avg(CASE WHEN p = 1 THEN severity END), 6) AS severity
  FROM (SELECT well_id, depth_idx, az_rot, max(CASE WHEN convention = 'plus' THEN presence END) AS p, max(CASE WHEN convention = 'minus' THEN presence END) AS m,
    bool_or(convention = 'plus' AND bad) AS bad, bool_or(convention = 'plus' AND outlier) AS outlier, max(CASE WHEN convention = 'plus' THEN severity END) AS severity
    FROM labels GROUP BY well_id, depth_idx, az_rot) GROUP BY well_id""", "labels")  # fmt: skip
def review_layers(spark, sf):
    """Cells of each review layer."""
    rows = V.layers(P.labels(spark, sf))
    return rows.groupBy("well_id").agg(
        F.count_if(F.col("plus") == 1).alias("n_plus"), F.count_if(F.col("minus") == 1).alias("n_minus"), F.count_if("apart").alias("n_apart"),
        F.count_if("bad").alias("n_bad"), F.count_if("outlier").alias("n_outlier"), six(F.avg("candidate_severity")).alias("severity"),
    )


@query("azimuth_bad_data", """SELECT well_id, round(min(s), 6) AS azimuth_min, round(max(s), 6) AS azimuth_max, round(avg(s), 6) AS azimuth_mean
  FROM (SELECT well_id, az_idx, avg(bad::INT) AS s FROM ruled GROUP BY ALL) GROUP BY well_id""", "ruled")  # fmt: skip
def azimuth_bad_data(spark, sf):
    """The azimuth half of the bad-data summary."""
    by = L.ruled(P.based(spark, sf)).groupBy("well_id", "az_idx").agg(F.avg(F.col("bad").cast("int")).alias("s"))
    return by.groupBy("well_id").agg(six(F.min("s")).alias("azimuth_min"), six(F.max("s")).alias("azimuth_max"), six(F.avg("s")).alias("azimuth_mean"))


@query("label_audit", """+ d AS (SELECT well_id, avg((p <> m)::INT) AS apart FROM (SELECT well_id, depth_idx, az_rot, max(CASE WHEN convention = 'plus' THEN
  presence END) AS p, max(CASE WHEN convention = 'minus' THEN presence END) AS m FROM labels GROUP BY ALL) WHERE p >= 0 AND m >= 0 GROUP BY well_id),
  c AS (SELECT well_id, count_if(presence = 1) AS n_candidate, count_if(presence = 1 AND confidence < 0.25) AS n_low FROM labels GROUP BY well_id)
  SELECT well_id, n_candidate, round(n_low / nullif(n_candidate, 0), 6) AS low_share, round(apart, 6) AS disagreement,
    CASE WHEN apart > 0.5 THEN 'block' WHEN apart > 0.25 THEN 'warn' ELSE 'ok' END AS level FROM c LEFT JOIN d USING (well_id)""", "labels")  # fmt: skip
def label_audit(spark, sf):
    """Share of unsure candidates over both conventions, and whether these disagree too much."""
    rows = L.audit(P.labels(spark, sf))
    return rows.select("well_id", "n_candidate", six(F.col("low_share")).alias("low_share"), six(F.col("disagreement")).alias("disagreement"), "level")


TRANSFORM = """+ e AS (SELECT feature, quantile_cont(x, 0.001) AS lo, quantile_cont(x, 0.999) AS hi FROM logged GROUP BY feature),
  r AS (UNPIVOT (SELECT rms, peak_abs, late_ratio FROM table6) ON rms, peak_abs, late_ratio INTO NAME feature VALUE v)"""


@query("transform_report", f"""{TRANSFORM}
  SELECT r.feature, r.n, r.n_missing, round(r.a, 5) AS raw_min, round(r.b, 5) AS raw_max, round(r.m, 5) AS raw_mean, round(r.q, 5) AS raw_median,
    round(l.a, 5) AS log_min, round(l.b, 5) AS log_max, round(l.m, 5) AS log_mean, round(l.q, 5) AS log_median, round(lo, 5) AS clip_low, round(hi, 5) AS clip_high,
    n_clipped, round(s.a, 4) + 0.0 AS scaled_min, round(s.b, 4) AS scaled_max, round(s.m, 4) + 0.0 AS scaled_mean, round(s.q, 4) + 0.0 AS scaled_median
  FROM (SELECT feature, count(v) AS n, count_if(v IS NULL) AS n_missing, min(v) AS a, max(v) AS b, avg(v) AS m, quantile_cont(v, 0.5) AS q FROM r GROUP BY feature) r
  JOIN (SELECT feature, min(x) AS a, max(x) AS b, avg(x) AS m, quantile_cont(x, 0.5) AS q FROM logged GROUP BY feature) l USING (feature) JOIN e USING (feature)
  JOIN (SELECT feature, count_if(x < lo OR x > hi) AS n_clipped FROM logged JOIN e USING (feature) GROUP BY feature) c USING (feature)
  JOIN (SELECT feature, min(s) AS a, max(s) AS b, avg(s) AS m, quantile_cont(s, 0.5) AS q FROM scaled GROUP BY feature) s USING (feature)""", "table6", "scaled")  # fmt: skip
def transform_report(spark, sf):
    """Ranges, means and medians of the features raw, logged and scaled, and what clipping cut."""
    rows = E.transform_report(P.table6(spark, sf), NAMES)
    five = ("raw_min", "raw_max", "raw_mean", "raw_median", "log_min", "log_max", "log_mean", "log_median", "clip_low", "clip_high")
    return rows.select("feature", "n", "n_missing", "n_clipped", *(F.round(c, 5).alias(c) for c in five), F.round("scaled_max", 4).alias("scaled_max"),
        *((F.round(c, 4) + 0.0).alias(c) for c in ("scaled_min", "scaled_mean", "scaled_median")))


ASSOCIATED = P.ASSOCIATION.replace("SELECT *, mean_difference", "SELECT *, weighted_candidate_mean - sum_n AS w_difference, sum_n, mean_difference", 1).replace(
    "CASE WHEN count_if(presence = 1) >= 2", """sum(CASE WHEN presence = 0 THEN v * confidence END) / nullif(sum(CASE WHEN presence = 0 THEN confidence END),
      0) AS sum_n, CASE WHEN count_if(presence = 1) >= 2""", 1
)
OBSERVED = f"""ob AS (SELECT convention, subset, min(least(n_candidate, n_non_candidate)) >= 20 AS enough,
    coalesce(bool_or(coalesce(abs(raw_effect) >= 0.05, false) OR coalesce(abs(w_difference / greatest(abs(sum_n), 1e-12)) >= 0.01, false)), false) AS signal FROM ({ASSOCIATED}) GROUP BY ALL)"""


def observed(spark, sf):
    return E.observations(E.association(P.samples(spark, sf).join(P.side_features(spark, sf), ["well_id", "xsi_idx", "side"]), list(E.FEATURES)))


@query("observations", f"+ {OBSERVED} SELECT * FROM ob", "long_features")
def observations(spark, sf):
    """Per subset: enough samples of both classes, and any signal."""
    return observed(spark, sf)


@query("association_gate", f"""+ {OBSERVED}, s AS (SELECT count_if(azimuthal) AS az, count_if(non_azimuthal) AS non_az FROM samples), f AS (SELECT avg((v IS
  NOT NULL AND isfinite(v))::INT) AS finite FROM (SELECT unnest([rms, peak_abs, mean_abs, early_energy, late_energy, late_ratio]) AS v FROM features_side))
  SELECT CASE WHEN non_az < az OR finite < 0.5 OR NOT coalesce((SELECT bool_or(enough AND signal) FROM ob WHERE convention = 'plus' AND subset =
  'high_confidence'), false) THEN 'no_go'
    WHEN finite < 0.95 THEN 'conditional_go' ELSE 'go' END AS decision, az AS n_azimuthal, non_az AS n_non_azimuthal, round(finite, 6) AS finite_share FROM s, f""", "long_features", "samples", "features_side")  # fmt: skip
def association_gate(spark, sf):
    """May the association be used: subsets, finite features, enough sure samples with a signal."""
    counts = P.samples(spark, sf).agg(F.count_if("azimuthal").alias("n_azimuthal"), F.count_if("non_azimuthal").alias("n_non_azimuthal"))
    done = E.association_gate(counts, P.side_features(spark, sf), observed(spark, sf))
    return done.select("decision", "n_azimuthal", "n_non_azimuthal", six(F.col("finite_share")).alias("finite_share"))


FIELDS = """fields AS (SELECT c_custkey % 9 AS well_id, (c_custkey // 9) % 14 AS receiver, CASE c_custkey % 5 WHEN 0 THEN 'Depth' WHEN 1 THEN 'WVFSide' ||
  chr((65 + c_custkey % 8)::INT) ELSE 'log.TIME' END AS field_path,
    CASE WHEN c_custkey % 97 = 0 THEN [10, 2] ELSE [10, 1024] END AS shape FROM customer)"""


def fields(spark, sf):
    return D.table(spark, sf, "customer").selectExpr(
        "c_custkey % 9 as well_id", "(c_custkey div 9) % 14 as receiver",
        "case c_custkey % 5 when 0 then 'Depth' when 1 then concat('WVFSide', char(65 + c_custkey % 8)) else 'log.TIME' end as field_path",
        "case when c_custkey % 97 = 0 then array(10, 2) else array(10, 1024) end as shape", "'double' as dtype",
    )


@query("field_audit", f"""WITH {FIELDS}, s AS (SELECT well_id, count_if(n > 1) AS n_shape_mismatch FROM (SELECT well_id, field_path, count(DISTINCT shape) AS n
  FROM fields GROUP BY ALL) GROUP BY well_id),
  r AS (SELECT well_id, receiver, list_sort(list(DISTINCT field_path)) AS names FROM fields GROUP BY ALL)
  SELECT well_id, 14 - count(DISTINCT receiver) AS n_missing, count(DISTINCT names) AS n_name_sets, any_value(n_shape_mismatch) AS n_shape_mismatch FROM r JOIN
  s USING (well_id) GROUP BY well_id""")  # fmt: skip
def field_audit(spark, sf):
    """Receivers without fields, and names and shapes that differ between receivers."""
    return C.field_audit(fields(spark, sf), 14)


@query("side_groups", f"""WITH {FIELDS} SELECT well_id, prefix, count(DISTINCT letter) AS n_sides FROM (SELECT *, regexp_extract(field_path,
  '^(.+Side)([A-H])$', 1) AS prefix, regexp_extract(field_path, '^(.+Side)([A-H])$', 2) AS letter FROM fields)
  WHERE letter <> '' GROUP BY well_id, prefix, shape HAVING count(DISTINCT letter) = 8""")  # fmt: skip
def side_groups(spark, sf):
    """Complete groups of the sides A to H."""
    return C.side_groups(fields(spark, sf)).select("well_id", "prefix", F.lit(8).cast("long").alias("n_sides"))


@query("manifest_valid", """WITH f AS (SELECT p_partkey % 7 AS well_id, CASE p_partkey % 5 WHEN 0 THEN 'cast' WHEN 1 THEN 'pose' WHEN 2 THEN NULL ELSE 'xsi'
  END AS role FROM part),
  x AS (SELECT c_custkey % 5 AS well_id, max(c_custkey % 3) + 10 AS expected FROM customer WHERE c_custkey % 5 < 4 GROUP BY 1),
  w AS (SELECT well_id, count_if(role = 'cast') AS c, count_if(role = 'pose') AS p, count_if(role = 'xsi') AS x, coalesce(any_value(expected), 100) AS e FROM f
  LEFT JOIN x USING (well_id) GROUP BY well_id)
  SELECT well_id, x AS n_receivers, '' AS errors, array_to_string(list_filter([CASE WHEN c < 1 THEN 'no_cast' END, CASE WHEN p < 1 THEN 'no_pose' END,
    CASE WHEN x <> e THEN 'receivers' WHEN x <> 13 THEN 'unusual_receivers' END], lambda x: x IS NOT NULL), ',') AS warnings FROM w""")  # fmt: skip
def manifest_valid(spark, sf):
    """What is odd about each well's files, against the number of receivers that the well, or else the manifest, expects."""
    from borelake.plans.review import manifest

    told = D.table(spark, sf, "customer").filter("c_custkey % 5 < 4").groupBy((F.col("c_custkey") % 5).alias("well_id")).agg((F.max(F.col("c_custkey") % 3) + 10).alias("expected"))
    rows = C.manifest_warnings(manifest(spark, sf), expected=100, by_well=told)
    return rows.select("well_id", "n_receivers", F.concat_ws(",", "errors").alias("errors"), F.concat_ws(",", "warnings").alias("warnings"))


@query("field_orientation", f"""WITH {FIELDS}, w AS (SELECT field_path, CASE WHEN field_path = 'Depth' THEN [10, 180] WHEN field_path = 'log.TIME' THEN [180,
  10] WHEN shape = [10, 2] THEN [5, 180, 3] ELSE shape END AS shape FROM fields)
  SELECT CASE WHEN shape[-1] = 180 THEN 'azimuth_last' WHEN shape[1] = 180 THEN 'azimuth_first' WHEN list_contains(shape, 180) THEN 'contains' ELSE 'unknown'
  END AS orientation, count(*) AS n FROM w GROUP BY ALL""")  # fmt: skip
def field_orientation(spark, sf):
    """Along which axis fields have their sectors."""
    shape = F.expr("case when field_path = 'Depth' then array(10, 180) when field_path = 'log.TIME' then array(180, 10) when shape = array(10, 2) then array(5, 180, 3) else shape end")
    rows = fields(spark, sf).withColumn("shape", shape)
    return rows.groupBy(C.orientation(F.col("shape")).alias("orientation")).agg(F.count(F.lit(1)).alias("n"))


CONFIG = '{"alpha": 0.35, "limit": 2.5}'


@query("published_labels", f"""SELECT well_id, presence, count(*) AS n, 'labels_v001' AS data_version, sha256('{CONFIG}') AS config_sha256, true AS no_final_labels, true AS not_ground_truth
  FROM ruled GROUP BY well_id, presence""", "ruled")  # fmt: skip
def published_labels(spark, sf):
    """Label counts as a published stage: staged, stamped, renamed, read back and held against their stamp."""
    at = new_folder(spark, "published")
    stage = L.ruled(P.based(spark, sf)).groupBy("well_id", "presence").agg(F.count(F.lit(1)).alias("n"))
    publish.published(stage, at, "labels_v001", CONFIG)
    if not publish.verified(spark, at):
        raise ValueError("the stage is not what its stamp says")
    return spark.read.parquet(at)


CONTRACT = """i AS (
    SELECT unnest([
      CASE WHEN count(DISTINCT side) <> 8 THEN {'table': 'waveforms', 'level': 'error', 'issue': 'sides'} END,
      CASE WHEN max(len(samples)) <> 64 OR min(len(samples)) <> 64 THEN {'table': 'waveforms', 'level': 'error', 'issue': 'samples'} END,
      CASE WHEN (SELECT count(DISTINCT az_idx) FROM cells) <> 12 THEN {'table': 'image', 'level': 'error', 'issue': 'sectors'} END,
      CASE WHEN count(DISTINCT xsi_idx) <> (SELECT count(*) FROM (SELECT DISTINCT depth_idx FROM cells)) THEN {'table': 'waveforms', 'level': 'warning', 'issue': 'depths'} END
    ]) AS i FROM waveforms
  )"""


def contract(spark, sf):
    """Issues of the waveforms and the image against axes of 8 sides, 64 samples, 12 sectors and the image's depths."""
    waves, image = D.waveforms(spark, sf), D.full_image(spark, sf)
    axes = {"side": spark.range(D.SIDES), "time": spark.range(64), "sector": spark.range(D.SECTORS), "depth": image.select("depth_idx").distinct()}
    return K.contract_issues(spark, {"waveforms": waves, "image": image}, axes)


@query("contract_errors", f"+ {CONTRACT} SELECT i.table, i.level, i.issue FROM i WHERE i IS NOT NULL", "waveforms", "cells")
def contract_errors(spark, sf):
    """Do the tables have the axes that the contract names? Depths only warn."""
    return contract(spark, sf)


@query("intake_gate", f"""+ {CONTRACT}, mf AS (SELECT p_partkey % 7 AS well_id, CASE p_partkey % 5 WHEN 0 THEN 'cast' WHEN 1 THEN 'pose' WHEN 2 THEN NULL ELSE 'xsi' END AS role FROM part),
  mw AS (SELECT count_if(role = 'cast') < 1 AS c, count_if(role = 'pose') < 1 AS p, count_if(role = 'xsi') <> 13 AS x, well_id IS NULL AS e FROM mf GROUP BY well_id),
  {FIELDS.replace('fields AS', 'fs AS')}, pr AS (SELECT count(*) AS n, count_if(len(shape) < 1) AS bad FROM fs),
  mp AS ({FIELD_SCORES}),
  sl AS (SELECT count_if(n = 0) AS empty FROM (SELECT well_id, count(zc) AS n FROM cells GROUP BY well_id)),
  qc AS (SELECT count_if(count_zc < n) AS odd, count_if(count_zc = 0) AS none FROM (SELECT well_id, count(*) AS n, count(zc) AS count_zc FROM cells GROUP BY well_id)),
  a AS (
    SELECT 'manifest' AS artifact, count_if(e) AS n_errors, count_if(c) + count_if(p) + count_if(x) AS n_warnings FROM mw
    UNION ALL SELECT 'probe', bad + (n = 0)::INT, 0 FROM pr
    UNION ALL SELECT 'mapping', count_if(field_path = 'TODO_CONFIRM'), count_if(confidence < 0.8 AND field_path <> 'TODO_CONFIRM') FROM mp
    UNION ALL SELECT 'slices', empty, 0 FROM sl
    UNION ALL SELECT 'contract', (SELECT count_if(i.level = 'error') FROM i), (SELECT count_if(i.level = 'warning') FROM i)
    UNION ALL SELECT 'quality', none, odd FROM qc
  )
  SELECT artifact, n_errors::BIGINT AS n_errors, n_warnings::BIGINT AS n_warnings, CASE WHEN n_errors > 0 THEN 'fail' WHEN n_warnings > 0 THEN 'warning' ELSE 'pass' END AS status,
    CASE WHEN (SELECT sum(n_errors) FROM a) > 0 THEN 'no_go' WHEN (SELECT sum(n_warnings) FROM a) > 0 THEN 'conditional_go' ELSE 'go' END AS decision FROM a""", "waveforms", "cells")  # fmt: skip
def intake_gate(spark, sf):
    """Manifest, fields, their mapping, slices, contract and quality: each passes, warns or fails, and all decide.

    Other than the usual number of files only warns; a target without a sure field is an error, one that is barely sure a warning.
    """
    from borelake.plans.review import field_choice, manifest

    files = C.manifest_warnings(manifest(spark, sf))
    said = lambda rows, artifact, level: rows.select(F.lit(artifact).alias("artifact"), F.lit(level).alias("level"), F.col("n").cast("long").alias("n"))
    image = D.full_image(spark, sf).groupBy("well_id").agg(F.count(F.lit(1)).alias("rows"), F.count("zc").alias("known"))
    mapping = stored(field_choice(spark, sf), "mapping")
    todo = F.col("field_path") == C.TODO
    probe = fields(spark, sf).agg((F.count_if(F.size("shape") < 1) + (F.count(F.lit(1)) == 0).cast("int")).alias("n"))
    issues = [
        said(files.agg(F.count_if(F.col("well_id").isNull()).alias("n")), "manifest", "error"), said(files.agg(F.sum(F.size("warnings")).alias("n")),
            "manifest", "warning"), said(probe, "probe", "error"),
        said(mapping.agg(F.count_if(todo).alias("n")), "mapping", "error"), said(mapping.agg(F.count_if(~todo & (F.col("confidence") < 0.8)).alias("n")), "mapping", "warning"),
        said(image.agg(F.count_if(F.col("known") == 0).alias("n")), "slices", "error"), said(image.agg(F.count_if(F.col("known") == 0).alias("n")), "quality",
            "error"), said(image.agg(F.count_if(F.col("known") < F.col("rows")).alias("n")), "quality", "warning"),
        contract(spark, sf).select(F.lit("contract").alias("artifact"), "level", F.lit(1).cast("long").alias("n")),
    ]
    return K.decided(reduce(DataFrame.unionByName, issues), ["manifest", "probe", "mapping", "slices", "contract", "quality"])
