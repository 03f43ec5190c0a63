"""Queries over the bearing convention, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from borelake.functions.angles import six
from borelake.operators import convention as R
from borelake.plans.series import posed_depths
from borelake.plans.views import over
from borelake.shared import stage
from borelake.sources import adapter as D

QUERIES, SQL = {}, {}
WINDOW = 6.0


def query(name: str, sql: str | None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = over(sql, *views)
        return f

    return add


#: Depths to leave out, as a reviewer would list them: the one in another unit is not applied.
INTERVALS = [(30.0, 41.0, "m", "casing"), (60.0, 80.0, "ft", "stuck"), (100.0, 90.0, "M", "washout")]

WINDOWS = """sp AS (
    SELECT well_id, greatest(min(p.depth), any_value(c.a)) AS start, least(max(p.depth), any_value(c.b)) AS stop
    FROM pose p JOIN (SELECT well_id, min(depth) AS a, max(depth) AS b FROM cells GROUP BY well_id) c USING (well_id) GROUP BY well_id
  ), w AS (
    SELECT well_id, k AS win, start + k * 6.0::DOUBLE AS low, least(start + (k + 1) * 6.0::DOUBLE, stop) AS high
    FROM (SELECT *, unnest(range(ceil((stop - start) / 6.0)::BIGINT)) AS k FROM sp WHERE start < stop)
  ), j AS (
    SELECT w.well_id, win, inc_deg, abs(delta(rb_deg, lag(rb_deg) OVER (PARTITION BY w.well_id, win ORDER BY depth))) AS jump
    FROM w JOIN pose p ON p.well_id = w.well_id AND p.depth BETWEEN w.low AND w.high
  ), f AS (
    SELECT well_id, win, count(*) AS n, avg(inc_deg) AS inc_mean, avg(greatest(0, least(1, (inc_deg - 1) / 4.0))) AS orientation, coalesce(max(jump), 0) AS jump_max
    FROM j GROUP BY well_id, win
  ), v AS (
    SELECT w.*, coalesce(n, 0) AS n, inc_mean, orientation, jump_max, coalesce(orientation, 0) + coalesce(inc_mean, 0) / 90 AS quality, list_filter([
      CASE WHEN low < 41 AND high > 30 THEN 'interval:casing' END, CASE WHEN low < 100 AND high > 90 THEN 'interval:washout' END,
      CASE WHEN coalesce(n, 0) < 2 THEN 'few_samples' END, CASE WHEN NOT coalesce(orientation >= 0.5, false) THEN 'low_orientation' END,
      CASE WHEN NOT coalesce(inc_mean >= 5, false) THEN 'low_inclination' END, CASE WHEN NOT coalesce(jump_max <= 45, false) THEN 'bearing_jump' END
    ], lambda x: x IS NOT NULL) AS reasons
    FROM w LEFT JOIN f USING (well_id, win)
  )"""


@stage
def depth_windows(spark, sf):
    pose = D.pose(spark, sf)
    intervals = spark.createDataFrame(INTERVALS, "start double, stop double, unit string, reason string")
    return R.windows(pose, R.spans(pose, D.full_image(spark, sf)), WINDOW, intervals, "m")


@query("bearing_windows", f"""+ {WINDOWS}
  SELECT well_id, win AS window_id, n, round(inc_mean, 6) AS inc_mean, round(orientation, 6) AS orientation, round(jump_max, 6) AS jump_max,
    array_to_string(reasons, ',') AS reasons, round(quality, 6) AS quality FROM v""", "cells", "pose")  # fmt: skip
def bearing_windows(spark, sf):
    """Every depth window with what speaks against it."""
    rows = depth_windows(spark, sf)
    return rows.select("well_id", F.col("window").alias("window_id"), "n",
        *(six(F.col(c)).alias(c) for c in ("inc_mean", "orientation", "jump_max", "quality")), F.concat_ws(",", "reasons").alias("reasons"))


#: For the queries over evidence, jumps up to 80 degrees and any inclination pass: the tables' bearings turn by up to 77.
LOOSE = """sp AS (
    SELECT well_id, greatest(min(p.depth), any_value(c.a)) AS start, least(max(p.depth), any_value(c.b)) AS stop
    FROM pose p JOIN (SELECT well_id, min(depth) AS a, max(depth) AS b FROM cells GROUP BY well_id) c USING (well_id) GROUP BY well_id
  ), w AS (
    SELECT well_id, k AS win, start + k * 6.0::DOUBLE AS low, least(start + (k + 1) * 6.0::DOUBLE, stop) AS high
    FROM (SELECT *, unnest(range(ceil((stop - start) / 6.0)::BIGINT)) AS k FROM sp WHERE start < stop)
  ), j AS (
    SELECT w.well_id, win, inc_deg, abs(delta(rb_deg, lag(rb_deg) OVER (PARTITION BY w.well_id, win ORDER BY depth))) AS jump
    FROM w JOIN pose p ON p.well_id = w.well_id AND p.depth BETWEEN w.low AND w.high
  ), best AS (
    SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY quality DESC, win) AS place FROM (
      SELECT w.*, count(jump) + 1 AS n, avg(greatest(0, least(1, (inc_deg - 1) / 4.0))) + avg(inc_deg) / 90 AS quality FROM w JOIN j USING (well_id, win) GROUP BY ALL
      HAVING count(*) >= 2 AND avg(greatest(0, least(1, (inc_deg - 1) / 4.0))) >= 0.5 AND coalesce(max(jump), 0) <= 80)
  )"""


@stage
def loose_windows(spark, sf):
    pose = D.pose(spark, sf)
    return R.windows(pose, R.spans(pose, D.full_image(spark, sf)), WINDOW, least_inc=0.0, most_jump=80.0)


@query("best_windows", f"+ {LOOSE} SELECT well_id, win AS window_id, place, round(quality, 6) AS quality FROM best WHERE place <= 8", "cells", "pose")
def best_windows(spark, sf):
    """The eight best windows of each well."""
    rows = R.best_windows(loose_windows(spark, sf), 8)
    return rows.select("well_id", F.col("window").alias("window_id"), F.col("place").cast("long").alias("place"), six(F.col("quality")).alias("quality"))


ENERGY = """en AS (
    SELECT well_id, xsi_idx, side, sqrt(sum(list_sum(list_transform(samples, lambda x: x * x))) / sum(len(samples))) AS e FROM waveforms GROUP BY ALL
  ), ax AS (
    SELECT well_id, xsi_idx, quantile_cont(depth, 0.5) AS depth FROM (SELECT DISTINCT well_id, xsi_idx, receiver, depth FROM waveforms) GROUP BY ALL
  ), es AS (SELECT well_id, side, ax.depth, e FROM en JOIN ax USING (well_id, xsi_idx)),
  ds AS (SELECT well_id, depth_idx, depth, side FROM posed, (SELECT unnest(range(8))::INT AS side) WHERE well_id IN (SELECT well_id FROM es)),
  at_depth AS (
    SELECT d.well_id, d.depth_idx, d.side, coalesce(CASE WHEN a.depth = b.depth THEN a.e ELSE a.e + (b.e - a.e) * ((d.depth - a.depth) / (b.depth - a.depth)) END, a.e, b.e) AS e
    FROM ds d ASOF LEFT JOIN es a ON d.well_id = a.well_id AND d.side = a.side AND d.depth >= a.depth ASOF LEFT JOIN es b ON d.well_id = b.well_id AND d.side = b.side AND d.depth <= b.depth
  )"""


@stage
def energy_on_image(spark, sf):
    """Side energy on every image depth, from the median depth of the receivers."""
    waves = D.waveforms(spark, sf)
    axis = waves.select("well_id", "xsi_idx", "receiver", "depth").distinct().groupBy("well_id", "xsi_idx").agg(F.percentile("depth", F.lit(0.5)).alias("depth"))
    depths = posed_depths(spark, sf).select("well_id", "depth_idx", "depth")
    return R.energy_at(R.side_energy(waves), axis, depths, D.SIDES)


@query("side_energy", f"+ {ENERGY} SELECT well_id, depth_idx, side, round(e, 6) AS energy FROM at_depth", "waveforms", "posed")
def side_energy(spark, sf):
    """Energy of each side on every image depth."""
    return energy_on_image(spark, sf).select("well_id", F.col("depth_idx").cast("long").alias("depth_idx"), "side", six(F.col("energy")).alias("energy"))


@query("turned_energy", f"""+ {ENERGY}, z AS (
    SELECT well_id, depth_idx, side, k, wrap(side * 45.0 + k * rb_deg) AS azimuth, e FROM at_depth JOIN posed USING (well_id, depth_idx), (VALUES (1), (-1))
  t(k) WHERE rb_deg IS NOT NULL)
  SELECT well_id, depth_idx, k AS sign, row_number() OVER (PARTITION BY well_id, depth_idx, k ORDER BY round(azimuth, 9), side) AS place, round(azimuth, 6) AS
  azimuth, round(e, 6) AS energy FROM z""", "waveforms", "posed")  # fmt: skip
def turned_energy(spark, sf):
    """Side energies of each image depth around the well, under both signs of the bearing."""
    bearings = posed_depths(spark, sf).select("well_id", "depth_idx", "rb_deg")
    rows = R.turned(energy_on_image(spark, sf).join(bearings, ["well_id", "depth_idx"]), "side", D.SIDES)
    return rows.select("well_id", F.col("depth_idx").cast("long").alias("depth_idx"), "sign", "place", six(F.col("azimuth")).alias("azimuth"), six(F.col("energy")).alias("energy"))


EVIDENCE = f"""{ENERGY}, ev AS (
    SELECT p.*, coalesce(greatest(0, least(1, (inc_deg - 1) / 4.0)), 0) AS orientation, image_range, side_range FROM posed p
    JOIN (SELECT well_id, depth_idx, max(zc) - min(zc) AS image_range FROM cells GROUP BY ALL) USING (well_id, depth_idx)
    JOIN (SELECT well_id, depth_idx, max(e) - min(e) AS side_range FROM at_depth GROUP BY ALL) USING (well_id, depth_idx)
  )"""


@stage
def evidence(spark, sf):
    return R.evidence(posed_depths(spark, sf), D.full_image(spark, sf), energy_on_image(spark, sf))


JUDGED = """SELECT well_id, win AS window_id, count(*) AS n, round(avg(orientation), 6) AS orientation, round(CASE WHEN count(rb_deg) > 0 THEN coalesce(max(jump), 0) END, 5) AS jump_max,
    round(quantile_cont(image_range, 0.5), 6) AS image_contrast, round(quantile_cont(side_range, 0.5), 6) AS side_contrast,
    round(coalesce(quantile_cont(image_range, 0.5), 0) + coalesce(quantile_cont(side_range, 0.5), 0), 6) AS quality,
    array_to_string(list_filter([%s CASE WHEN NOT coalesce(quantile_cont(image_range, 0.5) > 0, false) THEN 'low_image_contrast' END,
      CASE WHEN NOT coalesce(quantile_cont(side_range, 0.5) > 0, false) THEN 'low_side_contrast' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM (SELECT *, abs(delta(rb_deg, lag(rb_deg) OVER (PARTITION BY well_id, win ORDER BY depth_idx))) AS jump FROM x) GROUP BY well_id, win"""


def _shown(rows):
    return rows.select(
        "well_id", F.col("window").alias("window_id"), "n", F.round("jump_max", 5).alias("jump_max"),
        *(six(F.col(c)).alias(c) for c in ("orientation", "image_contrast", "side_contrast", "quality")), F.concat_ws(",", "reasons").alias("reasons"),
    )


SLIDING = f"""{EVIDENCE}, nr AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY depth_idx) - 1 AS r, count(*) OVER (PARTITION BY well_id) AS n_rows FROM ev),
  st AS (SELECT well_id, unnest(list_distinct(range(0, greatest(any_value(n_rows) - 16, 0) + 1, 8) || [greatest(any_value(n_rows) - 16, 0)])) AS win FROM nr GROUP BY well_id),
  x AS (SELECT nr.*, win FROM nr JOIN st ON nr.well_id = st.well_id AND nr.r BETWEEN win AND win + 15)
  """ + JUDGED % "CASE WHEN NOT coalesce(avg(orientation) >= 0.5, false) THEN 'low_orientation' END, CASE WHEN count(rb_deg) > 0 AND coalesce(max(jump), 0) > 45 THEN 'bearing_jump' END,"


@query("sliding_windows", f"+ {SLIDING}", "cells", "waveforms", "posed")
def sliding_windows(spark, sf):
    """Windows of 16 evidence rows each 8 rows, the last at the end."""
    return _shown(R.sliding_windows(evidence(spark, sf), 16, 8))


@query("sliding_best", f"""+
  {SLIDING.replace('SELECT well_id, win AS window_id', 'SELECT well_id, window_id, place, quality FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY quality DESC, window_id) AS place FROM (SELECT well_id, win AS window_id', 1)}) WHERE reasons = '') WHERE place <= 8""", "cells", "waveforms", "posed")
def sliding_best(spark, sf):
    """The eight sliding windows of each well with most contrast that nothing speaks against."""
    rows = _shown(R.sliding_windows(evidence(spark, sf), 16, 8)).withColumn("reasons", F.filter(F.split("reasons", ","), lambda x: x != ""))
    best = R.best_windows(rows.withColumnRenamed("window_id", "window"), 8)
    return best.select("well_id", F.col("window").alias("window_id"), F.col("place").cast("long").alias("place"), "quality")


@query("window_evidence", f"""+ {EVIDENCE}, {LOOSE}, x AS (SELECT ev.*, win FROM ev JOIN best b ON ev.well_id = b.well_id AND place <= 8 AND ev.depth BETWEEN b.low AND b.high)
  """ + JUDGED % "CASE WHEN count(*) < 2 THEN 'too_short' END,", "cells", "pose", "waveforms", "posed")  # fmt: skip
def window_evidence(spark, sf):
    """What image and sides show in the best windows."""
    return _shown(R.window_evidence(evidence(spark, sf), R.best_windows(loose_windows(spark, sf), 8)))


@query("azimuth_contrast", """SELECT 'image' AS kind, well_id, round(quantile_cont(r, 0.5), 6) AS contrast FROM (SELECT well_id, depth_idx, max(zc) - min(zc)
  AS r FROM cells GROUP BY ALL) GROUP BY well_id UNION ALL SELECT 'sides', well_id, round(quantile_cont(r, 0.5), 6) FROM (SELECT well_id, xsi_idx, max(e) -
  min(e) AS r FROM (SELECT well_id, xsi_idx, side, sqrt(sum(list_sum(list_transform(samples, lambda x: x * x))) / sum(len(samples))) AS e FROM waveforms GROUP
  BY ALL) GROUP BY ALL) GROUP BY well_id""", "cells", "waveforms")
def azimuth_contrast(spark, sf):
    image = R.contrast(D.full_image(spark, sf), ["well_id"], "depth_idx", "zc").select(F.lit("image").alias("kind"), "well_id", six(F.col("contrast")).alias("contrast"))
    sides = R.contrast(R.side_energy(D.waveforms(spark, sf)), ["well_id"], "xsi_idx", "energy").select(F.lit("sides").alias("kind"), "well_id", six(F.col("contrast")).alias("contrast"))
    return image.union(sides)


@query("bearing_candidates", """SELECT well_id, candidate, count(*) AS n, round(min(az), 6) AS az_min, round(max(az), 6) AS az_max, bool_and(az >= 0 AND az <
  360) AS legal, any_value('insufficient_evidence') AS verdict FROM (SELECT well_id, candidate, wrap(45 + CASE candidate WHEN 'plus' THEN rb_deg WHEN 'minus'
  THEN -rb_deg ELSE 0 END) AS az FROM pose, (VALUES ('plus'), ('minus'), ('none')) t(candidate)) GROUP BY ALL""", "pose")
def bearing_candidates(spark, sf):
    rows = R.candidate_ranges(D.pose(spark, sf), F.lit(45.0)).filter("candidate <> 'random'")
    return rows.select("well_id", "candidate", "n", six(F.col("az_min")).alias("az_min"), six(F.col("az_max")).alias("az_max"), "legal", "verdict")


@stage
def tracks(spark, sf):
    """Both tracks on every image depth with a bearing, in windows of 64 depths."""
    bearings = posed_depths(spark, sf).filter("rb_deg is not null").select("well_id", "depth_idx", "rb_deg")
    return R.tracks(D.full_image(spark, sf), energy_on_image(spark, sf), bearings).withColumn("window", F.floor(F.col("depth_idx") / 64).cast("int"))


TRACKS = f"""{ENERGY}, t AS (
    SELECT a.well_id, a.depth_idx, a.az_low, s.side_top, p.rb_deg, (a.depth_idx // 64)::INT AS win
    FROM (SELECT well_id, depth_idx, arg_min(az_idx, zc * 1000 + az_idx) AS az_low FROM cells WHERE zc IS NOT NULL GROUP BY ALL) a
    JOIN (SELECT well_id, depth_idx, first(side ORDER BY e DESC, side) AS side_top FROM at_depth GROUP BY ALL) s USING (well_id, depth_idx)
    JOIN posed p USING (well_id, depth_idx) WHERE rb_deg IS NOT NULL
  ), h AS (
    SELECT i::INT AS hyp, CASE WHEN i // 32 = 0 THEN 1 ELSE -1 END AS sign, CASE WHEN (i // 16) % 2 = 0 THEN 1 ELSE -1 END AS side_order,
      CASE WHEN (i // 8) % 2 = 0 THEN 1 ELSE -1 END AS direction, (i % 8) * 45.0::DOUBLE AS side_offset FROM range(64) r(i)
  ), x AS (
    SELECT *, apart(c, lag(c) OVER w) AS cs, apart(s, lag(s) OVER w) AS xs, apart(c, s) AS d
    FROM (SELECT t.*, h.*, wrap(direction * az_low * 30.0 + sign * rb_deg) AS c, wrap(side_offset + side_order * side_top * 45.0 + sign * rb_deg) AS s FROM t, h)
    WINDOW w AS (PARTITION BY well_id, win, hyp ORDER BY depth_idx)
  ), z AS (
    SELECT well_id, win, hyp, sign, side_order, direction, side_offset,
      0.25 * coalesce(greatest(0, least(1, 1 - avg(cs) / 180)), 1) + 0.25 * coalesce(greatest(0, least(1, 1 - avg(xs) / 180)), 1)
      + 0.5 * greatest(0, least(1, 1 - quantile_cont(d, 0.5) / 180))
      + max(CASE WHEN side_order = 1 THEN 0.01 ELSE 0 END + CASE WHEN direction = 1 THEN 0.01 ELSE 0 END + CASE WHEN side_offset = 0 THEN 0.01 ELSE 0 END) AS score
    FROM x GROUP BY well_id, win, hyp, sign, side_order, direction, side_offset
  )"""


def totals(spark, sf):
    return R.hypothesis_totals(R.window_scores(tracks(spark, sf), D.SECTORS, D.SIDES))


@query("hypothesis_totals", f"""+ {TRACKS} SELECT well_id, hyp, round(sum(score), 5) AS total, round(avg(score), 5) AS mean, count(*) AS n_windows FROM z GROUP
  BY well_id, hyp""", "cells", "waveforms", "posed")
def hypothesis_totals(spark, sf):
    return totals(spark, sf).select("well_id", "hyp", F.round("total", 5).alias("total"), F.round("mean", 5).alias("mean"), "n_windows")


@query("hypothesis_top", f"+ {TRACKS} SELECT well_id, hyp, round(sum(score), 5) AS total FROM z GROUP BY well_id, hyp ORDER BY round(sum(score), 5) DESC, hyp LIMIT 12", "cells", "waveforms", "posed")
def hypothesis_top(spark, sf):
    return hypothesis_totals(spark, sf).select("well_id", "hyp", "total").orderBy(F.desc("total"), "hyp").limit(12)


VOTES = f"{TRACKS}, b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY well_id, win ORDER BY round(score, 9) DESC, hyp) = 1)"


@query("attribute_votes", f"""+ {VOTES}, n AS (SELECT well_id, count(*) AS n_windows FROM b GROUP BY well_id),
  own AS (SELECT well_id, unnest(['sign', 'side_order', 'direction', 'side_offset']) AS attribute, unnest([sign, side_order, direction, side_offset])::DOUBLE AS choice FROM b)
  SELECT well_id, attribute, choice, count(*) AS votes, count(*) / any_value(n_windows) >= 0.7 AND any_value(n_windows) >= 5 AS enough
  FROM own JOIN n USING (well_id) GROUP BY well_id, attribute, choice""", "cells", "waveforms", "posed")  # fmt: skip
def attribute_votes(spark, sf):
    return R.attribute_votes(totals(spark, sf)).filter("votes > 0").select("well_id", "attribute", "choice", "votes", "enough")


@query("sign_recommendations", f"""+ {VOTES}, s AS (SELECT well_id, hyp, sign, sum(score) AS total, count(*) AS n_windows FROM z GROUP BY ALL),
  r AS (SELECT s.*, (SELECT count(*) FROM b WHERE b.well_id = s.well_id AND b.hyp = s.hyp) / n_windows AS support, row_number() OVER (PARTITION BY well_id
  ORDER BY round(total, 9) DESC, hyp) AS place FROM s)
  SELECT a.well_id, a.hyp, round(a.support, 6) AS support, round(a.total - b.total, 5) AS gap, a.n_windows,
    CASE WHEN NOT (a.n_windows >= 5 AND a.support >= 0.7 AND a.total - b.total >= 0.05) THEN 'unresolved' WHEN a.sign = 1 THEN 'plus' ELSE 'minus' END AS
  recommendation
  FROM r a JOIN r b ON a.well_id = b.well_id AND a.place = 1 AND b.place = 2""", "cells", "waveforms", "posed")  # fmt: skip
def sign_recommendations(spark, sf):
    """The best hypothesis of each well, its lead, and the sign that this is enough to recommend."""
    done = R.recommendations(totals(spark, sf))
    return done.select("well_id", "hyp", six(F.col("support")).alias("support"), F.round("gap", 5).alias("gap"), "n_windows", "recommendation")
