"""Evidence for the sign of the bearing and the order of sides, by hypotheses over depth windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from borelake.functions.angles import delta, distance, orientation_confidence, wrap
from borelake.operators.intervals import overlapping, points_in
from borelake.operators.ranks import medians, numbered
from borelake.operators.series import bracketed, lerp, prepared


def hypotheses(spark) -> DataFrame:
    """2 signs x 2 side orders x 2 image directions x 8 offsets, numbered in that order; constants of the search."""
    rows = spark.range(64).withColumn("hyp", F.col("id").cast("int"))
    h = F.col("hyp")
    sign, order, direction = F.floor(h / 32), F.floor(h / 16) % 2, F.floor(h / 8) % 2
    return rows.select("hyp", F.when(sign == 0, 1).otherwise(-1).alias("sign"), F.when(order == 0, 1).otherwise(-1).alias("side_order"), F.when(direction == 0,
        1).otherwise(-1).alias("direction"), ((h % 8) * 45.0).alias("side_offset"))


def step_of_bearing(keys: list[str], order: str) -> Column:
    """How far rb_deg turns from the row before in the group; null for the first."""
    return F.abs(delta(F.col("rb_deg"), F.lag("rb_deg").over(W.partitionBy(*keys).orderBy(order))))


def spans(pose: DataFrame, image: DataFrame) -> DataFrame:
    """Per well: the depths that pose and image share, if any."""
    ends = lambda rows, k: rows.groupBy("well_id").agg(F.min("depth").alias(f"_low{k}"), F.max("depth").alias(f"_high{k}"))
    both = ends(pose, 0).join(ends(image, 1), "well_id")
    return both.select("well_id", F.greatest("_low0", "_low1").alias("start"), F.least("_high0", "_high1").alias("stop")).filter("start < stop")


def windows(pose: DataFrame, spans: DataFrame, size: float, intervals: DataFrame | None = None, unit: str = "unknown", least_inc: float = 5.0, most_jump: float = 45.0) -> DataFrame:
    """Depth windows of ``size`` over each well's span, edges included on both sides, the last one shorter.

    Counts, mean inclination and orientation, greatest jump of the bearing inside
    the window, reasons against, and quality. ``intervals``: depths to leave out
    (start, stop, unit, reason); see ``excluding``.
    """
    every = spans.select("well_id", "start", "stop", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("stop") - F.col("start")) / size) - 1)).alias("window"))
    every = every.select("well_id", "window", (F.col("start") + F.col("window") * size).alias("low"), F.least(F.col("start") + (F.col("window") + 1) * size, "stop").alias("high"))
    at = F.floor((F.col("depth") - F.col("start")) / size)
    # a sample on an edge is in both windows
    rows = pose.filter("depth is not null and inc_deg is not null and rb_deg is not null").join(spans, "well_id")
    rows = rows.withColumn("window", F.explode(F.array(at - 1, at, at + 1))).join(every, ["well_id", "window"]).filter("depth between low and high")
    jump = step_of_bearing(["well_id", "window"], "depth")
    found = rows.withColumn("jump", jump).groupBy("well_id", "window").agg(
        F.count(F.lit(1)).alias("n"), F.avg("inc_deg").alias("inc_mean"), F.avg(orientation_confidence(F.col("inc_deg"))).alias("orientation"), F.coalesce(F.max("jump"), F.lit(0.0)).alias("jump_max"),
    )
    done = every.join(found, ["well_id", "window"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    left_out = F.array().cast("array<string>")
    if intervals is not None:
        done = done.join(excluded(every, intervals, unit), ["well_id", "window"], "left")
        left_out = F.coalesce("left_out", left_out)
    reasons = F.array_compact(F.array(
        F.when(F.col("n") < 2, "few_samples"), F.when(~F.coalesce(F.col("orientation") >= 0.5, F.lit(False)), "low_orientation"),
        F.when(~F.coalesce(F.col("inc_mean") >= least_inc, F.lit(False)), "low_inclination"), F.when(~F.coalesce(F.col("jump_max") <= most_jump, F.lit(False)), "bearing_jump"),
    ))
    quality = F.coalesce("orientation", F.lit(0.0)) + F.coalesce("inc_mean", F.lit(0.0)) / 90
    return done.withColumns({"reasons": F.concat(left_out, reasons), "quality": quality}).drop("left_out")


def best_windows(rows: DataFrame, most: int = 8) -> DataFrame:
    """Per well, the ``most`` windows of greatest quality that nothing speaks against; a report of the top."""
    place = F.row_number().over(W.partitionBy("well_id").orderBy(F.desc("quality"), "window"))
    return rows.filter(F.size("reasons") == 0).withColumn("place", place).filter(F.col("place") <= most)


def _same_unit(interval: Column, unit: str) -> Column:
    unknown = ("unknown", "unknown_to_verify", "")
    return F.lower(interval).isin(*unknown) if unit.lower() in unknown else F.lower(interval) == unit.lower()


def excluded(rows: DataFrame, intervals: DataFrame, unit: str) -> DataFrame:
    """Per window (well_id, window, low, high) that an interval (start, stop, unit, reason) in ``unit`` overlaps: the reasons, left_out. Touching ends don't overlap; other units are not converted."""
    own = intervals.filter(_same_unit(F.col("unit"), unit)).select("start", "stop", "reason")
    ends = F.least("start", "stop"), F.greatest("start", "stop")
    met = overlapping(rows.select("well_id", "window", "low", "high"), own, [], F.col("low"), F.col("high"), *ends)
    return met.groupBy("well_id", "window").agg(F.array_sort(F.collect_set(F.concat(F.lit("interval:"), "reason"))).alias("left_out"))


def energy_at(energy: DataFrame, axis: DataFrame, depths: DataFrame, sides: int) -> DataFrame:
    """``depths`` (well_id, depth_idx, depth) x sides with energy: linear between the sonic depths (``axis``: well_id, xsi_idx, depth), held at the ends, 0 on a side without any. Wells without waveforms have no rows."""
    source = prepared(energy.join(axis, ["well_id", "xsi_idx"]).withColumnRenamed("xsi_idx", "sample_idx"), ["well_id", "side"])
    wells = source.select("well_id").distinct()
    targets = depths.join(wells, "well_id", "left_semi").withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    return bracketed(source, targets, ["well_id", "side"], ["energy"]).select("well_id", "depth_idx", "side", lerp("energy", "clamp", empty=0.0).alias("energy"))


def turned(rows: DataFrame, index: str, places: int, order: int = 1, offset: float = 0.0) -> DataFrame:
    """``rows`` (well_id, depth_idx, rb_deg, ``index`` of one of ``places`` around the tool) under both signs: azimuth, and the place of it around the well at that depth. Rows without a bearing have none."""
    both = rows.filter("rb_deg is not null").withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    both = both.withColumn("azimuth", wrap(offset + order * F.col(index) * (360.0 / places) + F.col("sign") * F.col("rb_deg")))
    ring = W.partitionBy("well_id", "depth_idx", "sign").orderBy(F.round("azimuth", 9), index)  # as many rows as places
    return both.withColumn("place", F.row_number().over(ring).cast("long"))


def evidence(depths: DataFrame, image: DataFrame, energy: DataFrame) -> DataFrame:
    """Per image depth with bearing and inclination (``depths``): ranges of impedance over sectors and of energy over sides."""
    ring = lambda rows, v, name: rows.groupBy("well_id", "depth_idx").agg((F.max(v) - F.min(v)).alias(name))
    known = depths.withColumn("orientation", orientation_confidence(F.col("inc_deg")))
    return known.join(ring(image, "zc", "image_range"), ["well_id", "depth_idx"]).join(ring(energy, "energy", "side_range"), ["well_id", "depth_idx"])


def _judged(rows: DataFrame, keys: list[str], most_jump: float, least: float, counted: bool) -> DataFrame:
    """Evidence grouped by window (which bounds the group): orientation, jump and contrasts, and reasons against."""
    known = rows.withColumn("jump", step_of_bearing(keys, "depth_idx"))
    done = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("depth_idx").alias("first"), F.max("depth_idx").alias("last"), F.avg("orientation").alias("orientation"),
        F.when(F.count("rb_deg") > 0, F.coalesce(F.max("jump"), F.lit(0.0))).alias("jump_max"),
        F.percentile("image_range", F.lit(0.5)).alias("image_contrast"), F.percentile("side_range", F.lit(0.5)).alias("side_contrast"),
    )
    low = lambda c: ~F.coalesce(F.col(c) > 0, F.lit(False))
    marks = [F.when(F.col("n") < 2, "too_short")] if counted else [F.when(~F.coalesce(F.col("orientation") >= least, F.lit(False)), "low_orientation"),
        F.when(F.col("jump_max") > most_jump, "bearing_jump")]
    marks += [F.when(low("image_contrast"), "low_image_contrast"), F.when(low("side_contrast"), "low_side_contrast")]
    return done.withColumns({"reasons": F.array_compact(F.array(*marks)), "quality": F.coalesce("image_contrast", F.lit(0.0)) + F.coalesce("side_contrast", F.lit(0.0))})


def sliding_windows(rows: DataFrame, size: int, stride: int, least: float = 0.5, most_jump: float = 45.0) -> DataFrame:
    """Windows of ``size`` evidence rows each ``stride`` rows, whatever depths are missing between them, the last one at the end; ``window`` is the number of its first row.

    Rows are numbered over sorted ranges; a row says in which windows it is.
    """
    at = numbered(rows, ["well_id"], ["depth_idx"], "_r").withColumn("_r", F.col("_r") - 1)
    top = F.greatest(F.count(F.lit(1)) - size, F.lit(0)).alias("_top")
    at = at.join(rows.groupBy("well_id").agg(top), "well_id")
    low = F.greatest(F.ceil((F.col("_r") - size + 1) / stride), F.lit(0))
    regular = F.transform(F.filter(F.sequence(low, F.greatest(F.floor(F.col("_r") / stride), low)), lambda k: (k * stride <= F.col("_r")) & (k * stride <= F.col("_top"))), lambda k: k * stride)
    starts = F.array_distinct(F.concat(regular, F.when(F.col("_r") >= F.col("_top"), F.array(F.col("_top").cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    dealt = at.withColumn("window", F.explode(starts)).drop("_r", "_top")
    return _judged(dealt, ["well_id", "window"], most_jump, least, False)


def window_evidence(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """Evidence rows of ``accepted`` depth windows (well_id, window, low, high), judged by window; windows without rows have none."""
    dealt = points_in(rows, accepted.select("well_id", "window", "low", "high"), ["well_id"], "depth", "low", "high")
    return _judged(dealt, ["well_id", "window"], 360.0, 0.0, True)


def side_energy(waveforms: DataFrame) -> DataFrame:
    """RMS over receivers and time by depth index and side."""
    sums = waveforms.select("well_id", "xsi_idx", "side", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x).alias("s"), F.size("samples").alias("n"))
    return sums.groupBy("well_id", "xsi_idx", "side").agg(F.sqrt(F.sum("s") / F.sum("n")).alias("energy"))


def contrast(rows: DataFrame, keys: list[str], depth: str, value: str) -> DataFrame:
    """Median over depths of the range around the well."""
    by = rows.groupBy(*keys, depth).agg((F.max(value) - F.min(value)).alias("r"))
    found = medians(by, keys, ["r"]).withColumnRenamed("r_median", "contrast")
    return rows.select(*keys).distinct().join(found, keys, "left")


def tracks(image: DataFrame, energy: DataFrame, bearings: DataFrame) -> DataFrame:
    """Per depth: the sector of least impedance and the side of most energy (first ones on ties), with the bearing."""
    low = image.filter("zc is not null").groupBy("well_id", "depth_idx").agg(F.min_by("az_idx", F.struct("zc", "az_idx")).alias("az_low"))
    top = energy.groupBy("well_id", "depth_idx").agg(F.max_by("side", F.struct(F.col("energy"), -F.col("side"))).alias("side_top"))
    return low.join(top, ["well_id", "depth_idx"]).join(bearings, ["well_id", "depth_idx"])


def window_scores(rows: DataFrame, sectors: int, sides: int) -> DataFrame:
    """Per window and hypothesis: continuity of both tracks, their agreement, and the score.

    How far a track turns from one depth to the next depends on the sign and the
    direction (or the order of sides) alone, so four steps each are taken for a row
    and averaged by window. Only the distance of the tracks to each other depends on
    all, and on the tracks' angles: these are counted by window first, and only the
    counted angles are met with the hypotheses.
    """
    by = W.partitionBy("well_id", "window").orderBy("depth_idx")
    angles = {
        f"{track}_{sign}_{k}": wrap(k * F.col(c) * step + sign * F.col("rb_deg"))
        for sign in (1, -1) for k in (1, -1) for track, c, step in (("cast", "az_low", 360.0 / sectors), ("xsi", "side_top", 360.0 / sides))
    }
    at = rows.select("well_id", "window", "depth_idx", *(a.alias(n) for n, a in angles.items()))
    moved = at.select("well_id", "window", *(distance(F.col(n), F.lag(n).over(by)).alias(n) for n in angles))
    means = moved.groupBy("well_id", "window").agg(*(F.avg(n).alias(n) for n in angles))
    hyp = F.broadcast(hypotheses(rows.sparkSession))
    pick = lambda track, k: F.coalesce(*(F.when((F.col("sign") == s) & (F.col(k) == d), F.coalesce(F.col(f"{track}_{s}_{d}"), F.lit(0.0))) for s in (1, -1) for d in (1, -1)))
    near = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - c / 180))
    scored = means.crossJoin(hyp).select("well_id", "window", *hyp.columns, near(pick("cast", "direction")).alias("cast_continuity"), near(pick("xsi", "side_order")).alias("xsi_continuity"))
    # of two tracks turned by the same bearing only the sector and the side matter
    pairs = rows.groupBy("well_id", "window", "az_low", "side_top").agg(F.count("rb_deg").alias("_n"))
    apart = distance(wrap(F.col("direction") * F.col("az_low") * (360.0 / sectors)), wrap(F.col("side_offset") + F.col("side_order") * F.col("side_top") * (360.0 / sides)))
    # the sign turns both tracks alike, so half the hypotheses say all
    own = pairs.crossJoin(hyp.filter("sign = 1")).withColumn("_apart", apart)
    middle = own.groupBy("well_id", "window", "side_order", "direction", "side_offset").agg(near(F.percentile("_apart", F.lit(0.5), F.col("_n"))).alias("consistency"))
    prior = F.when(F.col("side_order") == 1, 0.01).otherwise(0.0) + F.when(F.col("direction") == 1, 0.01).otherwise(0.0) + F.when(F.col("side_offset") == 0, 0.01).otherwise(0.0)
    done = scored.join(middle, ["well_id", "window", "side_order", "direction", "side_offset"], "left")
    return done.withColumn("score", 0.25 * F.col("cast_continuity") + 0.25 * F.col("xsi_continuity") + 0.5 * F.col("consistency") + prior)


def hypothesis_totals(scores: DataFrame) -> DataFrame:
    """Per well and hypothesis: total, mean, and the windows that it wins (the first wins a tie)."""
    best = F.row_number().over(W.partitionBy("well_id", "window").orderBy(F.round("score", 9).desc(), "hyp")) == 1
    rows = scores.withColumn("won", best.cast("int"))
    done = rows.groupBy("well_id", "hyp", "sign", "side_order", "direction", "side_offset").agg(F.sum("score").alias("total"), F.avg("score").alias("mean"),
        F.sum("won").alias("votes"), F.count(F.lit(1)).alias("n_windows"))
    return done.withColumn("support", F.col("votes") / F.col("n_windows"))


def attribute_votes(totals: DataFrame, least: int = 5, share: float = 0.70) -> DataFrame:
    """Votes of each value of each attribute, with its share and whether it is enough to recommend; the sign also needs ``recommendations``."""
    names = ["sign", "side_order", "direction", "side_offset"]
    long = totals.select("well_id", "votes", "n_windows", *(F.col(n).cast("double").alias(n) for n in names)).unpivot(["well_id", "votes", "n_windows"], names, "attribute", "choice")
    done = long.groupBy("well_id", "attribute", "choice").agg(F.sum("votes").alias("votes"), F.max("n_windows").alias("n_windows"))
    return done.withColumn("support", F.col("votes") / F.col("n_windows")).withColumn("enough", (F.col("n_windows") >= least) & (F.col("support") >= share))


def recommendations(totals: DataFrame, least: int = 5, share: float = 0.70, gap: float = 0.05) -> DataFrame:
    """Per well: the best hypothesis (the first of equal totals), its support and lead over the second, and the recommended sign, which stays unresolved without enough of all three."""
    place = F.row_number().over(W.partitionBy("well_id").orderBy(F.round("total", 9).desc(), "hyp"))
    two = totals.withColumn("place", place).filter("place <= 2")
    first = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    done = two.groupBy("well_id").agg(first("hyp").alias("hyp"), first("sign").alias("sign"), first("support").alias("support"),
        first("n_windows").alias("n_windows"), (first("total") - F.max(F.when(F.col("place") == 2, F.col("total")))).alias("gap"))
    enough = F.coalesce((F.col("n_windows") >= least) & (F.col("support") >= share) & (F.col("gap") >= gap), F.lit(False))
    return done.withColumns({"enough": enough, "recommendation": F.when(~enough, "unresolved").when(F.col("sign") == 1, "plus").otherwise("minus")})


def candidate_ranges(pose: DataFrame, az: Column, seed: int = 20260520) -> DataFrame:
    """Per bearing candidate: range of the turned azimuth. Without scores the verdict stays insufficient_evidence."""
    names = ("plus", "minus", "none", "random")
    turn = F.when(F.col("candidate") == "plus", F.col("rb_deg")).when(F.col("candidate") == "minus", -F.col("rb_deg")).when(F.col("candidate") == "none",
        0.0).otherwise(F.pmod(F.xxhash64(F.lit(seed), "well_id", "sample_idx"), F.lit(360)).cast("double"))
    rows = pose.withColumn("candidate", F.explode(F.array(*map(F.lit, names)))).withColumn("az", wrap(az + turn))
    return rows.groupBy("well_id", "candidate").agg(F.count("az").alias("n"), F.min("az").alias("az_min"), F.max("az").alias("az_max"),
        F.bool_and((F.col("az") >= 0) & (F.col("az") < 360)).alias("legal"), F.lit("insufficient_evidence").alias("verdict"))


def side_contrast(waveforms: DataFrame) -> DataFrame:
    """Per well: the range over sides of the median amplitude."""
    values = waveforms.select("well_id", "side", F.explode("samples").alias("v")).withColumn("v", F.abs("v"))
    by = medians(values, ["well_id", "side"], ["v"]).withColumnRenamed("v_median", "m")
    return by.groupBy("well_id").agg(F.count(F.lit(1)).alias("n_sides"), (F.max("m") - F.min("m")).alias("contrast"))


def azimuth_preview(pose: DataFrame, sides: int) -> DataFrame:
    """Per well at its first, middle and last depth: the azimuth of each side under each candidate but the random one."""
    counts = pose.groupBy("well_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = numbered(pose, ["well_id"], ["depth", "sample_idx"], "_r").withColumn("_r", F.col("_r") - 1).join(counts,
        "well_id").filter((F.col("_r") == 0) | (F.col("_r") == F.floor(F.col("_n") / 2)) | (F.col("_r") == F.col("_n") - 1))
    turns = F.array(*(F.struct(F.lit(n).alias("candidate"), F.lit(k).alias("k")) for n, k in (("plus", 1), ("minus", -1), ("none", 0))))
    rows = rows.withColumn("_c", F.explode(turns)).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    return rows.select("well_id", "depth", "_c.candidate", "side", wrap(F.col("side") * (360.0 / sides) + F.col("_c.k") * F.col("rb_deg")).alias("azimuth"))
