"""Queries over axes, angles and quality, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borelake.functions import angles as A
from borelake.functions.angles import six
from borelake.operators import quality as Q
from borelake.operators import series as S
from borelake.plans.views import over
from borelake.shared import stage
from borelake.sources import adapter as D
from borelake.sources.loader import load

QUERIES, SQL = {}, {}
#: Depths of event series are seconds; a block of work is a day.
DAY = 86_400.0


def query(name: str, sql: str | None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = over(sql, *views)
        return f

    return add


@query("angles_pose", """SELECT well_id, sample_idx, round(wrap(rb_deg - 400), 6) + 0.0 AS wrapped, round(apart(rb_deg, 350), 6) + 0.0 AS apart_350,
  round(delta(rb_deg, 350), 6) + 0.0 AS delta_350,
  round(wrap(45 + rb_deg), 6) + 0.0 AS plus, round(wrap(45 - rb_deg), 6) + 0.0 AS minus, round(greatest(0, least(1, (inc_deg - 1) / 4.0)), 6) + 0.0 AS
  confidence, inc_deg <= 1 AS uncertain FROM pose""", "pose")
def angles_pose(spark, sf):
    rb, az = F.col("rb_deg"), F.lit(45.0)
    return D.pose(spark, sf).select(
        "well_id", "sample_idx", six(A.wrap(rb - 400)).alias("wrapped"), six(A.distance(rb, F.lit(350.0))).alias("apart_350"), six(A.delta(rb, F.lit(350.0))).alias("delta_350"),
        six(A.to_high_side(az, rb, "plus")).alias("plus"), six(A.to_high_side(az, rb, "minus")).alias("minus"),
            six(A.orientation_confidence(F.col("inc_deg"))).alias("confidence"), A.orientation_uncertain(F.col("inc_deg")).alias("uncertain"),
    )


@query("angles_mean", """SELECT well_id, round(wrap(degrees(atan2(sum(sin(radians(rb_deg))), sum(cos(radians(rb_deg)))))), 4) AS mean_deg,
  round(wrap(degrees(atan2(sum(inc_deg * sin(radians(rb_deg))), sum(inc_deg * cos(radians(rb_deg)))))), 4) AS weighted_deg FROM pose GROUP BY well_id""", "pose")
def angles_mean(spark, sf):
    return D.pose(spark, sf).groupBy("well_id").agg(F.round(A.circular_mean(F.col("rb_deg")), 4).alias("mean_deg"),
        F.round(A.circular_mean(F.col("rb_deg"), F.col("inc_deg")), 4).alias("weighted_deg"))


@query("orientation_bins", """SELECT well_id, count(*) AS n, count_if(c = 0) AS n_zero, count_if(c > 0 AND c <= 0.25) AS n_q1, count_if(c > 0.25 AND c <= 0.5)
  AS n_q2, count_if(c > 0.5 AND c <= 0.75) AS n_q3, count_if(c > 0.75 AND c < 1) AS n_q4, count_if(c = 1) AS n_one,
  round(avg((inc_deg <= 1)::INT), 6) AS low_share, round(avg((inc_deg >= 5)::INT), 6) AS stable_share, avg((inc_deg <= 1)::INT) > 0.25 AS warn,
  round(min(inc_deg), 6) AS inc_min, round(quantile_cont(inc_deg, 0.5), 6) AS inc_median, round(max(inc_deg), 6) AS inc_max
  FROM (SELECT *, greatest(0, least(1, (inc_deg - 1) / 4.0)) AS c FROM pose) GROUP BY well_id""", "pose")
def orientation_bins(spark, sf):
    rows = D.pose(spark, sf).withColumn("c", A.orientation_confidence(F.col("inc_deg")))
    share = lambda cond: F.round(F.avg(cond.cast("int")), 6)
    c, inc = F.col("c"), F.col("inc_deg")
    return rows.groupBy("well_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c == 0).alias("n_zero"), F.count_if((c > 0) & (c <= 0.25)).alias("n_q1"),
        F.count_if((c > 0.25) & (c <= 0.5)).alias("n_q2"), F.count_if((c > 0.5) & (c <= 0.75)).alias("n_q3"), F.count_if((c > 0.75) & (c < 1)).alias("n_q4"), F.count_if(c == 1).alias("n_one"),
        share(inc <= 1).alias("low_share"), share(inc >= 5).alias("stable_share"), (F.avg((inc <= 1).cast("int")) > 0.25).alias("warn"), F.round(F.min(inc),
            6).alias("inc_min"), F.round(F.percentile(inc, F.lit(0.5)), 6).alias("inc_median"), F.round(F.max(inc), 6).alias("inc_max"),
    )


SIDE_OF_SECTOR = """side_of AS (SELECT az_idx, arg_min(side, apart(az_idx * 30.0, side * 45.0) * 100 + side) AS side FROM (SELECT DISTINCT az_idx FROM cells),
  (SELECT unnest(range(8))::INT AS side) GROUP BY az_idx)"""


def side_of_sector(spark, sectors: int = D.SECTORS, sides: int = D.SIDES):
    """az_idx, side: the nearest side of each sector, the first if two are; both axes are constants of the tool."""
    pairs = spark.range(sectors).select(F.col("id").cast("int").alias("az_idx")).crossJoin(spark.range(sides).select(F.col("id").cast("int").alias("side")))
    apart = A.distance(A.sector(F.col("az_idx"), sectors), A.sector(F.col("side"), sides))
    return pairs.groupBy("az_idx").agg(F.min_by("side", F.struct(apart, "side")).alias("side"))


@query("sector_sides", "+ " + SIDE_OF_SECTOR + " SELECT well_id, side, count(zc) AS n, round(avg(zc), 6) AS zc_mean FROM cells JOIN side_of USING (az_idx) GROUP BY ALL", "cells")
def sector_sides(spark, sf):
    cells = D.full_image(spark, sf).join(F.broadcast(side_of_sector(spark)), "az_idx")
    return cells.groupBy("well_id", "side").agg(F.count("zc").alias("n"), six(F.avg("zc")).alias("zc_mean"))


@query("rotated_cells", """SELECT c.well_id, c.depth_idx, ((c.az_idx + k * round_even(coalesce(p.rb_deg, 0) / 30.0, 0)::INT) % 12 + 12) % 12 AS az_rot,
  convention, zc, row_number() OVER (PARTITION BY c.well_id, c.depth_idx, convention ORDER BY ((c.az_idx + k * round_even(coalesce(p.rb_deg, 0) / 30.0,
  0)::INT) % 12 + 12) % 12) AS place FROM cells c JOIN posed p USING (well_id, depth_idx), (VALUES ('plus', 1), ('minus', -1)) t(convention, k)""", "cells", "posed")
def rotated_cells(spark, sf):
    from pyspark.sql import Window as W

    cells = posed_cells(spark, sf)
    both = cells.withColumn("convention", F.explode(F.array(F.lit("plus"), F.lit("minus"))))
    rot = F.when(F.col("convention") == "plus", A.rotated(F.col("az_idx"), F.col("rb_deg"), "plus", 12)).otherwise(A.rotated(F.col("az_idx"), F.col("rb_deg"), "minus", 12))
    rows = both.withColumn("az_rot", rot)
    return rows.select("well_id", "depth_idx", "az_rot", "convention", "zc", F.row_number().over(W.partitionBy("well_id", "depth_idx", "convention").orderBy("az_rot")).cast("long").alias("place"))


@stage
def posed_depths(spark, sf):
    """Pose on image depths: one row a depth."""
    return posed_at(D.pose(spark, sf), D.depths_of(D.full_image(spark, sf)))


def posed_at(pose, depths):
    known = S.bracketed(S.prepared(pose, ["well_id"]), depths, ["well_id"], ["inc_deg", "rb_deg"])
    return known.select("well_id", "depth_idx", "depth", S.lerp("inc_deg").alias("inc_deg"), S.lerp_angle_by_parts("rb_deg").alias("rb_deg"))


def posed_cells(spark, sf):
    return D.full_image(spark, sf).join(posed_depths(spark, sf).drop("depth"), ["well_id", "depth_idx"])


AUDIT_SQL = """SELECT well_id, series_id, count(*) AS n, min(depth) AS depth_min, max(depth) AS depth_max, count_if(step > 0) AS n_up, count_if(step < 0) AS
  n_down, count_if(step = 0) AS n_equal,
  round(quantile_cont(CASE WHEN step <> 0 THEN abs(step) END, 0.5), 3) AS step_median, round(min(CASE WHEN step <> 0 THEN abs(step) END), 3) AS step_min,
  round(max(CASE WHEN step <> 0 THEN abs(step) END), 3) AS step_max
  FROM (SELECT *, depth - lag(depth) OVER (PARTITION BY well_id, series_id ORDER BY o) AS step FROM (SELECT *, %s AS o FROM event_series)) GROUP BY well_id,
  series_id"""
DIRECTED_SQL = """SELECT *, CASE WHEN n < 2 THEN 'undetermined' WHEN n_down = 0 AND n_equal = 0 THEN 'increasing' WHEN n_up = 0 AND n_equal = 0 THEN
  'decreasing' WHEN n_down = 0 AND n_up > 0 THEN 'nondecreasing' WHEN n_up = 0 AND n_down > 0 THEN 'nonincreasing' WHEN n_up > n_down AND n_down <= allowed
  THEN 'mostly_increasing' WHEN n_down > n_up AND n_up <= allowed THEN 'mostly_decreasing' ELSE 'non_monotonic' END AS direction FROM (SELECT *, CASE WHEN n -
  1 < 100 THEN 0 ELSE greatest(25, floor((n - 1) * 0.005)) END AS allowed FROM ({}))"""


def _audit(spark, sf, order):
    rows = S.audit(D.event_series(spark, sf).withColumn("sample_idx", F.expr(order)), ["well_id", "series_id"])
    return rows.select("well_id", "series_id", "n", "depth_min", "depth_max", *(F.col(c).cast("long").alias(c) for c in ("n_up", "n_down", "n_equal")),
        *(F.round(c, 3).alias(c) for c in ("step_median", "step_min", "step_max")), "direction")


for _name, _order, _sql in (("up", "sample_idx", "sample_idx"), ("mixed", "(sample_idx * 7919) % 1009 * 1000000 + sample_idx", "(sample_idx * 7919) % 1009 * 1000000 + sample_idx")):
    query(f"axis_audit_{_name}", "SELECT * EXCLUDE (allowed) FROM (" + DIRECTED_SQL.format(AUDIT_SQL % _sql) + ")", "event_series")(lambda spark, sf, order=_order: _audit(spark, sf, order))


@query("axis_overlap", """+ axes AS (""" + DIRECTED_SQL.format(AUDIT_SQL % "sample_idx") + """), shared AS (SELECT well_id, max(depth_min) AS start,
  min(depth_max) AS stop, max(step_median) AS step, min(step_median) AS least, count(*) AS n_axes, max((direction NOT IN ('increasing', 'decreasing',
  'nondecreasing', 'nonincreasing'))::INT) AS odd FROM axes GROUP BY well_id),
  g AS (SELECT *, CASE WHEN stop <= start THEN 'no_overlap' WHEN step IS NULL THEN 'no_step' END AS why, floor((stop - start) / step) + 1 AS n_grid FROM shared)
  SELECT well_id, start, stop, step, n_axes, CASE WHEN why IS NULL THEN n_grid::BIGINT END AS n_grid, coalesce(why, CASE WHEN n_grid < 2 THEN 'short' END) AS
  block, coalesce(step / least > 2, false) AS warn,
  CASE WHEN coalesce(why, CASE WHEN n_grid < 2 THEN 'short' END) IS NOT NULL THEN 'no_go' WHEN odd = 1 OR coalesce(step / least > 2, false) THEN
  'conditional_go' ELSE 'go' END AS decision FROM g""", "event_series")
def axis_overlap(spark, sf):
    axes = S.audit(D.event_series(spark, sf), ["well_id", "series_id"]).withColumn("step_median", F.round("step_median", 3))
    done = S.verdict(axes, S.proposed_grid(S.overlap(axes, ["well_id"])), ["well_id"])
    return done.select("well_id", "start", "stop", "step", "n_axes", F.col("n_grid").cast("long").alias("n_grid"), "block", "warn", "decision")


@query("pose_grid", """+ s AS (SELECT well_id, min(depth) AS start, max(depth) AS stop, (SELECT median(d) FROM (SELECT depth - lag(depth) OVER (ORDER BY depth)
  AS d FROM pose q WHERE q.well_id = p.well_id) WHERE d > 0) AS step FROM pose p GROUP BY well_id)
  SELECT well_id, k AS grid_idx, round(start + step * k, 6) AS depth FROM (SELECT *, unnest(range((floor((stop - start) / step) + 1)::BIGINT)) AS k FROM s)""", "pose")
def pose_grid(spark, sf):
    axes = S.audit(D.pose(spark, sf), ["well_id"])
    return S.grid(S.proposed_grid(S.overlap(axes, ["well_id"])), ["well_id"]).select("well_id", "grid_idx", six(F.col("depth")).alias("depth"))


@query("receiver_axes", """+ st AS (SELECT receiver, min(depth) AS a, max(depth) AS b, quantile_cont(d, 0.5) AS step FROM (SELECT *, depth - lag(depth) OVER
  (PARTITION BY receiver ORDER BY xsi_idx) AS d FROM (SELECT DISTINCT receiver, xsi_idx, depth FROM waveforms)) GROUP BY receiver),
  gap AS (SELECT max(abs(a.depth - b.depth)) AS m, quantile_cont(abs(a.depth - b.depth), 0.5) AS q FROM (SELECT DISTINCT receiver, xsi_idx, depth FROM
  waveforms) a JOIN (SELECT DISTINCT xsi_idx, depth FROM waveforms WHERE receiver = 1) b USING (xsi_idx))
  SELECT 0::BIGINT AS well_id, count(*) AS n_receivers, round(max(a) - min(a), 6) AS start_range, round(max(step) - min(step), 6) + 0.0 AS step_range,
  round(max(m), 6) AS gap_max, round(max(q), 6) AS gap_median, max(m) <= greatest(0.5 * quantile_cont(step, 0.5), 1e-3) AND max(a) - min(a) <= 10 *
  greatest(0.5 * quantile_cont(step, 0.5), 1e-3) AND max(b) - min(b) <= 10 * greatest(0.5 * quantile_cont(step, 0.5), 1e-3) AND count(*) = 2 AS consistent FROM
  st, gap""", "waveforms")
def receiver_axes(spark, sf):
    axes = D.waveforms(spark, sf).select("well_id", "receiver", F.col("xsi_idx").alias("sample_idx"), "depth").distinct()
    return S.receiver_consistency(axes, 2).select("well_id", "n_receivers", *(six(F.col(c)).alias(c) for c in ("start_range", "step_range", "gap_max", "gap_median")), "consistent")


BRACKET_SQL = """+ src AS (SELECT well_id, depth, arg_min(value, sample_idx) AS value, min(sample_idx) AS sample_idx FROM event_series WHERE series_id = 'view'
  GROUP BY well_id, depth), n AS (SELECT well_id, count(*) AS n_source FROM src GROUP BY well_id),
  t AS (SELECT well_id, sample_idx, depth FROM event_series WHERE series_id = 'click'),
  b AS (SELECT t.*, p.depth AS pd, p.value AS pv, p.sample_idx AS pi, x.depth AS nd, x.value AS nv, x.sample_idx AS ni, n_source, CASE WHEN x.depth = p.depth
  THEN 0 ELSE (t.depth - p.depth) / (x.depth - p.depth) END AS f FROM t ASOF LEFT JOIN src p ON t.well_id = p.well_id AND t.depth >= p.depth ASOF LEFT JOIN src
  x ON t.well_id = x.well_id AND t.depth <= x.depth LEFT JOIN n ON n.well_id = t.well_id)
"""


def _view_to_click(spark, sf):
    events = D.event_series(spark, sf)
    source = S.prepared(events.filter("series_id = 'view'"), ["well_id"]).withColumns({"idx": F.col("sample_idx").cast("double"), "high": (F.col("value") > 50).cast("double")})
    targets = events.filter("series_id = 'click'").select("well_id", "sample_idx", "depth")
    return S.bracketed(source.withColumnRenamed("sample_idx", "source_idx"), targets, ["well_id"], ["value", "idx", "high", "source_idx"], span=DAY)


@query("interpolated", BRACKET_SQL + """SELECT well_id, sample_idx, round(CASE WHEN pd IS NOT NULL AND nd IS NOT NULL AND n_source >= 2 THEN pv + (nv - pv) * f
  END, 5) AS inside, round(coalesce(CASE WHEN pd IS NOT NULL AND nd IS NOT NULL THEN pv + (nv - pv) * f END, -1), 5) AS filled, round(coalesce(CASE WHEN pd IS
  NOT NULL AND nd IS NOT NULL THEN pv + (nv - pv) * f END, pv, nv), 5) AS clamped,
  coalesce(CASE WHEN pd IS NOT NULL AND nd IS NOT NULL THEN (pv > 50)::INT + ((nv > 50)::INT - (pv > 50)::INT) * f END >= 0.5, true) AS mask, round(CASE WHEN
  pd IS NOT NULL AND nd IS NOT NULL THEN pi + (ni - pi) * f END, 5) AS source_position, coalesce(n_source >= 2 AND pd IS NOT NULL AND nd IS NOT NULL, false) AS
  covered FROM b""", "event_series")
def interpolated(spark, sf):
    rows = _view_to_click(spark, sf)
    return rows.select("well_id", "sample_idx", F.round(S.lerp("value", least=2), 5).alias("inside"), F.round(S.lerp("value", -1.0), 5).alias("filled"),
        F.round(S.lerp("value", "clamp"), 5).alias("clamped"), S.lerp_mask("high").alias("mask"), F.round(S.lerp("idx"), 5).alias("source_position"),
        F.coalesce((F.col("n_source") >= 2) & F.col("before").isNotNull() & F.col("after").isNotNull(), F.lit(False)).alias("covered"))


@query("nearest_match", BRACKET_SQL + "SELECT well_id, sample_idx, CASE WHEN nd IS NULL OR depth - pd <= nd - depth THEN pi ELSE ni END AS source_idx FROM b", "event_series")
def nearest_match(spark, sf):
    return _view_to_click(spark, sf).select("well_id", "sample_idx", S.nearest("source_idx").alias("source_idx"))


@query("coverage_mask", """+ r AS (SELECT well_id, min(depth) AS a, max(depth) AS b, count(DISTINCT depth) AS n FROM pose GROUP BY well_id) SELECT d.well_id,
  count(*) AS n, count_if(coalesce(d.depth BETWEEN a AND b AND n >= 2, false)) AS n_covered FROM (SELECT DISTINCT well_id, depth FROM cells) d LEFT JOIN r
  USING (well_id) GROUP BY d.well_id""", "cells", "pose")
def coverage_mask(spark, sf):
    depths = D.full_image(spark, sf).select("well_id", "depth").distinct()
    return S.covered(depths, D.pose(spark, sf), ["well_id"]).groupBy("well_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("covered").alias("n_covered"))


@query("pose_on_image", """SELECT well_id, depth_idx, round(inc_deg, 5) AS inc_deg, round(sin(radians(rb_deg)), 5) + 0.0 AS rb_sin, round(cos(radians(rb_deg)),
  5) + 0.0 AS rb_cos, round(coalesce(greatest(0, least(1, (inc_deg - 1) / 4.0)), 0), 5) AS confidence FROM posed""", "posed")
def pose_on_image(spark, sf):
    return posed_depths(spark, sf).select("well_id", "depth_idx", F.round("inc_deg", 5).alias("inc_deg"),
        (F.round(F.sin(F.radians("rb_deg")), 5) + 0.0).alias("rb_sin"), (F.round(F.cos(F.radians("rb_deg")), 5) + 0.0).alias("rb_cos"),
        F.round(A.orientation_confidence(F.col("inc_deg")), 5).alias("confidence"))


@query("bearing_unwrapped", """SELECT d.well_id, d.depth_idx, round(CASE WHEN a.depth IS NULL OR b.depth IS NULL THEN NULL ELSE wrap(a.rb_deg + CASE WHEN
  b.depth = a.depth THEN 0 ELSE (d.depth - a.depth) / (b.depth - a.depth) END * CASE WHEN delta(b.rb_deg, a.rb_deg) = -180 AND b.rb_deg > a.rb_deg THEN 180
  ELSE delta(b.rb_deg, a.rb_deg) END) END, 5) AS rb_deg
  FROM (SELECT DISTINCT well_id, depth_idx, depth FROM cells) d ASOF LEFT JOIN pose a ON d.well_id = a.well_id AND d.depth >= a.depth ASOF LEFT JOIN pose b ON
  d.well_id = b.well_id AND d.depth <= b.depth""", "cells", "pose")
def bearing_unwrapped(spark, sf):
    depths = D.full_image(spark, sf).select("well_id", "depth_idx", "depth").distinct()
    known = S.bracketed(S.prepared(D.pose(spark, sf), ["well_id"]), depths, ["well_id"], ["rb_deg"])
    return known.select("well_id", "depth_idx", F.round(S.lerp_angle("rb_deg"), 5).alias("rb_deg"))


@query("waveforms_resampled", """+ t AS (SELECT receiver, side, unnest(range(ceil(min(depth) / 13)::BIGINT, floor(max(depth) / 13)::BIGINT + 1)) * 13.0::DOUBLE
  AS depth FROM waveforms GROUP BY receiver, side)
  SELECT t.receiver, t.side, t.depth, round(CASE WHEN b.depth IS NOT NULL AND a.depth IS NOT NULL THEN list_sum(list_transform(range(1, 65), lambda i:
  a.samples[i] + (CASE WHEN b.depth = a.depth THEN 0 ELSE (t.depth - a.depth) / (b.depth - a.depth) END) * (b.samples[i] - a.samples[i]))) END, 4) AS total
  FROM t ASOF LEFT JOIN waveforms a ON t.receiver = a.receiver AND t.side = a.side AND t.depth >= a.depth ASOF LEFT JOIN waveforms b ON t.receiver = b.receiver
  AND t.side = b.side AND t.depth <= b.depth""", "waveforms")
def waveforms_resampled(spark, sf):
    rows = D.waveforms(spark, sf)
    ends = rows.groupBy("receiver", "side").agg(F.ceil(F.min("depth") / 13).alias("a"), F.floor(F.max("depth") / 13).alias("b")).filter("a <= b")
    targets = ends.select("receiver", "side", F.explode(F.sequence("a", "b")).alias("k")).select("receiver", "side", (F.col("k") * 13.0).alias("depth"))
    known = S.bracketed(rows, targets, ["receiver", "side"], ["samples"])
    return known.select("receiver", "side", "depth", F.round(F.aggregate(S.lerp_array("samples"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("window_slices", """+ w AS (SELECT well_id, k AS window_id, (min(depth) + k * (max(depth) - min(depth)) / 4) AS low, (min(depth) + (k + 1) * (max(depth)
  - min(depth)) / 4) AS high FROM event_series, range(4) t(k) WHERE series_id = 'view' GROUP BY well_id, k),
  i AS (SELECT w.*, e.sample_idx, e.depth FROM w JOIN event_series e ON e.well_id = w.well_id AND e.series_id = 'view' AND e.depth BETWEEN w.low AND w.high)
  SELECT well_id, window_id, count(*) AS n_matched, arg_min(sample_idx, abs(depth - (low + high) / 2)) AS centre_idx, round(min(depth), 3) AS seen_low,
  round(max(depth), 3) AS seen_high FROM i GROUP BY well_id, window_id""", "event_series")
def window_slices(spark, sf):
    views = D.event_series(spark, sf).filter("series_id = 'view'")
    span = views.groupBy("well_id").agg(F.min("depth").alias("a"), F.max("depth").alias("b"))
    windows = span.select("well_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("window"), "a", "b").select("well_id", "window",
        (F.col("a") + F.col("window") * (F.col("b") - F.col("a")) / 4).alias("low"), (F.col("a") + (F.col("window") + 1) * (F.col("b") - F.col("a")) / 4).alias("high"))
    found = S.window_slices(views, windows, ["well_id"], 3).filter("n_matched > 0")
    return found.select("well_id", F.col("window").alias("window_id"), "n_matched", "centre_idx", F.round("seen_low", 3).alias("seen_low"), F.round("seen_high", 3).alias("seen_high"))


@query("preview_depths", """SELECT well_id, depth_idx, depth FROM (SELECT DISTINCT c.well_id, depth_idx, c.depth, dense_rank() OVER (PARTITION BY c.well_id
  ORDER BY depth_idx) AS r FROM cells c JOIN (SELECT well_id, min(depth) AS a, max(depth) AS b FROM pose GROUP BY well_id) p ON p.well_id = c.well_id AND
  c.depth BETWEEN a AND b) WHERE r <= 8""", "cells", "pose")
def preview_depths(spark, sf):
    from pyspark.sql import Window as W

    inside = S.covered(D.full_image(spark, sf).select("well_id", "depth_idx", "depth").distinct(), D.pose(spark, sf), ["well_id"]).filter("covered")
    return inside.withColumn("r", F.row_number().over(W.partitionBy("well_id").orderBy("depth_idx"))).filter("r <= 8").select("well_id", "depth_idx", "depth")


@query("gap_filled", "SELECT well_id, az_idx, depth_idx, round(zf, 6) + 0.0 AS zc FROM filled", "filled")
def gap_filled(spark, sf):
    cells = D.full_image(spark, sf)
    return S.gap_filled(cells, ["well_id", "az_idx"], "zc", "zf").select("well_id", "az_idx", "depth_idx", six(F.col("zf")).alias("zc"))


@query("depth_steps", """SELECT well_id, round(quantile_cont(d, 0.5), 6) AS step, CASE WHEN greatest(round_even(10.5 / quantile_cont(d, 0.5), 0), 3)::INT % 2 =
  0 THEN greatest(round_even(10.5 / quantile_cont(d, 0.5), 0), 3)::INT + 1 ELSE greatest(round_even(10.5 / quantile_cont(d, 0.5), 0), 3)::INT END AS n_window
  FROM (SELECT well_id, depth - lag(depth) OVER (PARTITION BY well_id ORDER BY depth) AS d FROM pose) WHERE d > 0 GROUP BY well_id""", "pose")
def depth_steps(spark, sf):
    return S.median_step(D.pose(spark, sf), ["well_id"]).select("well_id", six(F.col("step")).alias("step"), S.window_samples(10.5, F.col("step")).alias("n_window"))


@query("time_axis", """SELECT receiver, pos, round(pos * 0.004, 6) AS time, round(avg(v), 6) + 0.0 AS mean FROM (SELECT receiver,
  unnest(range(len(samples)))::INT AS pos, unnest(samples) AS v FROM waveforms) GROUP BY receiver, pos""", "waveforms")
def time_axis(spark, sf):
    rows = D.waveforms(spark, sf).select("receiver", F.posexplode("samples").alias("pos", "v"))
    return rows.groupBy("receiver", "pos").agg(six(F.avg("v")).alias("mean")).withColumn("time", F.round(F.col("pos") * 0.004, 6))


AGREE = """SELECT well_id, '%s' AS pair, count(a) AS n_a, count(b) AS n_b, sum(coalesce(abs(a - b) > 1e-8 + 1e-5 * abs(b), true)::INT)::BIGINT AS n_far,
    count(a) = count(b) AND sum(coalesce(abs(a - b) > 1e-8 + 1e-5 * abs(b), true)::INT) = 0 AS agree
  FROM (%s) FULL JOIN (%s) USING (well_id, i) GROUP BY well_id"""
_AXIS = {
    "image": "SELECT DISTINCT well_id, depth_idx AS i, depth AS {} FROM cells", "pose": "SELECT well_id, sample_idx AS i, depth AS {} FROM pose",
    "receiver_1": "SELECT DISTINCT well_id, xsi_idx AS i, depth AS {} FROM waveforms WHERE receiver = 1", "receiver_2": """SELECT DISTINCT well_id, xsi_idx AS i, depth AS {} FROM
      waveforms WHERE receiver = 2""",
}
PAIRS = (("receiver_1", "receiver_2"), ("image", "pose"), ("image", "receiver_1"))


@query("axes_agree", " UNION ALL ".join(AGREE % (f"{a}, {b}", _AXIS[a].format("a"), _AXIS[b].format("b")) for a, b in PAIRS), "waveforms", "cells", "pose")
def axes_agree(spark, sf):
    """Do two axes of a well agree sample by sample: receivers with each other, the image with the pose and with a receiver."""
    waves = D.waveforms(spark, sf).select("well_id", F.col("xsi_idx").alias("sample_idx"), "receiver", "depth").distinct()
    axes = {
        "image": D.full_image(spark, sf).select("well_id", F.col("depth_idx").alias("sample_idx"), "depth").distinct(), "pose": D.pose(spark, sf).select("well_id", "sample_idx", "depth"),
        "receiver_1": waves.filter("receiver = 1"), "receiver_2": waves.filter("receiver = 2"),
    }
    return reduce(DataFrame.unionByName, [S.axes_agree(axes[a], axes[b], ["well_id"]).withColumn("pair", F.lit(f"{a}, {b}")) for a, b in PAIRS])


@query("first_depths", "SELECT well_id, count(*) AS n, round(max(depth), 6) AS depth_max FROM pose WHERE sample_idx < 100 GROUP BY well_id", "pose")
def first_depths(spark, sf):
    """What a reader limited to the first 100 depths of a well sees; the limit is the operation, and reaches the scan."""
    return S.limited(D.pose(spark, sf), "sample_idx", 100).groupBy("well_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("depth"), 6).alias("depth_max"))


@query("qc_image", """SELECT well_id, count(*) AS n, count(zc) AS n_finite, round(count(zc) / count(*), 6) AS finite_share, round(avg((zc = 0)::INT), 6) AS
  zero_share, min(zc) AS v_min, max(zc) AS v_max, round(avg(zc), 6) AS v_mean, round(stddev_pop(zc), 6) AS v_std, round(avg((abs(zc) >= top)::INT), 6) AS
  clip_share, count(zc) < count(*) OR avg((abs(zc) >= top)::INT) > 0.1 AS warn FROM (SELECT *, max(abs(zc)) OVER (PARTITION BY well_id) AS top FROM cells)
  GROUP BY well_id""", "cells")
def qc_image(spark, sf):
    done = Q.numeric(D.full_image(spark, sf), ["well_id"], F.col("zc"))
    return done.select("well_id", "n", "n_finite", "v_min", "v_max", "warn", *(six(F.col(c)).alias(c) for c in ("finite_share", "zero_share", "v_mean", "v_std", "clip_share")))


@query("qc_waveforms", """SELECT w.well_id, n_sides, longest, n, n_sides <> 8 OR longest > 1024 AS warn, round(v_mean, 6) + 0.0 AS v_mean, round(v_std, 6) AS
  v_std FROM (SELECT well_id, count(DISTINCT side) AS n_sides, max(len(samples))::INT AS longest, count(*) AS n FROM waveforms GROUP BY well_id) w JOIN (SELECT
  well_id, avg(v) AS v_mean, stddev_pop(v) AS v_std FROM (SELECT well_id, unnest(samples) AS v FROM waveforms) GROUP BY well_id) v USING (well_id)""", "waveforms")
def qc_waveforms(spark, sf):
    rows = D.waveforms(spark, sf)
    values = Q.numeric(rows.select("well_id", F.explode("samples").alias("v")), ["well_id"], F.col("v"))
    return Q.waveforms(rows).join(values.select("well_id", six(F.col("v_mean")).alias("v_mean"), six(F.col("v_std")).alias("v_std")), "well_id")


@query("qc_pose", """SELECT well_id, count(*) AS n, min(inc_deg) AS inc_min, max(inc_deg) AS inc_max, min(rb_deg) AS rb_min, max(rb_deg) AS rb_max,
  min(inc_deg) >= 0 AND max(inc_deg) <= 180 AND min(rb_deg) >= 0 AND max(rb_deg) < 360 AS legal FROM pose GROUP BY well_id""", "pose")
def qc_pose(spark, sf):
    return Q.pose(D.pose(spark, sf))


@query("qc_summary", """SELECT well_id, name, count(*) AS n, round(count(v) / count(*), 6) AS finite_share, min(v) AS v_min, max(v) AS v_max, round(avg(v), 6)
  AS v_mean, round(quantile_cont(v, 0.5), 6) AS v_median FROM (SELECT well_id, 'zc' AS name, zc AS v FROM cells UNION ALL SELECT well_id, 'depth', depth FROM
  cells) GROUP BY well_id, name""", "cells")
def qc_summary(spark, sf):
    done = Q.summary(D.full_image(spark, sf), ["well_id"], ["zc", "depth"])
    return done.select("well_id", "name", "n", "v_min", "v_max", *(six(F.col(c)).alias(c) for c in ("finite_share", "v_mean", "v_median")))


@query("qc_sectors", """SELECT well_id, count(DISTINCT az_idx) AS n_sectors, count_if(zc < 0) AS n_negative,
    array_to_string(list_filter([CASE WHEN count(DISTINCT az_idx) <> 180 THEN 'sectors' END, CASE WHEN count_if(zc < 0) > 0 THEN 'negative' END], lambda x: x IS NOT NULL), ',') AS warnings
  FROM (SELECT well_id, az_idx, zc - 2 AS zc FROM cells) GROUP BY well_id""", "cells")  # fmt: skip
def qc_sectors(spark, sf):
    """Are there 180 sectors, and negative impedances (here of values less two, so that there are some)?"""
    done = Q.image(D.full_image(spark, sf).withColumn("zc", F.col("zc") - 2))
    return done.select("well_id", "n_sectors", "n_negative", F.concat_ws(",", "warnings").alias("warnings"))


@query("sector_axes", """+ x AS (SELECT DISTINCT az_idx FROM cells)
  SELECT az_idx, axis, round(wrap(o + k * az_idx * 30.0), 6) + 0.0 AS azimuth FROM x, (VALUES ('plain', 0.0, 1), ('offset', 15.0, 1), ('reversed', 0.0, -1), ('both', 45.0, -1)) t(axis, o, k)""", "cells")  # fmt: skip
def sector_axes(spark, sf):
    """The azimuth of each sector of the image on plain, shifted and reversed axes."""
    sectors = D.full_image(spark, sf).select("az_idx").distinct()
    axes = {"plain": (0.0, False), "offset": (15.0, False), "reversed": (0.0, True), "both": (45.0, True)}
    each = F.array(*(F.struct(F.lit(n).alias("axis"), six(A.sector(F.col("az_idx"), D.SECTORS, o, r)).alias("azimuth")) for n, (o, r) in axes.items()))
    return sectors.withColumn("_a", F.explode(each)).select("az_idx", "_a.*")


@query("wells_around", """SELECT well_id, round(low, 6) AS low, round(high, 6) AS high FROM (
    SELECT well_id, greatest(a, c - least(5.0, (b - a) / 2)) AS low, least(b, c + least(5.0, (b - a) / 2)) AS high
    FROM (SELECT well_id, min(depth) AS a, max(depth) AS b, arg_max(depth, inc_deg * 1e9 - sample_idx) AS c FROM pose GROUP BY well_id))""", "pose")  # fmt: skip
def wells_around(spark, sf):
    """A window of at most 10 around the depth of each well's greatest inclination, inside its pose."""
    centre = F.max_by("depth", F.col("inc_deg") * 1e9 - F.col("sample_idx"))
    spans = D.pose(spark, sf).groupBy("well_id").agg(F.min("depth").alias("start"), F.max("depth").alias("stop"), centre.alias("centre"))
    return S.centre_window(spans, 10.0, F.col("centre")).select("well_id", six(F.col("low")).alias("low"), six(F.col("high")).alias("high"))


@query("loaded_series", """WITH r AS (
    SELECT user_id AS well_id, CASE WHEN event_id % 41 = 0 THEN NULL ELSE event_type END AS series_id, event_id // 2 AS sample_idx, CASE WHEN event_id % 17 = 0 THEN NULL ELSE epoch_us(ts) / 1e6::DOUBLE END AS depth,
      CASE WHEN isfinite(value / ((event_id % 23) * 1.0)) THEN value / (event_id % 23) END AS value FROM events
  ), g AS (SELECT well_id, series_id, sample_idx, count(*) AS n, first({'d': depth, 'v': value} ORDER BY depth NULLS FIRST, value NULLS FIRST) AS f FROM r GROUP BY ALL),
  e AS (SELECT *, 1 AS times FROM g UNION ALL SELECT *, n FROM g WHERE n > 1)
  SELECT unnest([
    {'rule': 'no_well_id', 'level': 'error', 'n': count_if(well_id IS NULL)}, {'rule': 'no_series_id', 'level': 'error', 'n': count_if(series_id IS NULL)}, {'rule': 'no_sample_idx', 'level': 'error', 'n': count_if(sample_idx IS NULL)},
    {'rule': 'no_depth', 'level': 'warning', 'n': count_if(f.d IS NULL)}, {'rule': 'no_value', 'level': 'warning', 'n': count_if(f.v IS NULL)}, {'rule': 'repeated', 'level': 'error', 'n': count_if(times > 1)},
    {'rule': 'sound', 'level': 'rows', 'n': count_if(well_id IS NOT NULL AND series_id IS NOT NULL AND sample_idx IS NOT NULL AND times = 1)}
  ], recursive := true) FROM e""")  # fmt: skip
def loaded_series(spark, sf):
    """The events as a series table through the checked loader: rows that break each rule, and those that are sound."""
    rows = D.table(spark, sf, "events").selectExpr(
        "user_id as well_id", "case when event_id % 41 = 0 then null else event_type end as series_id", "event_id div 2 as sample_idx",
        "case when event_id % 17 = 0 then double('NaN') else unix_micros(cast(ts as timestamp)) / 1e6D end as depth", "case when event_id % 23 = 0 then double('Infinity') else value / (event_id % 23) end as value",
    )
    found = load(rows, "series")
    sound = found.rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("sound").alias("rule"), F.lit("rows").alias("level"), "n")
    return found.counts.select("rule", "level", "n").unionByName(sound)
