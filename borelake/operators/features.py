"""Waveform features, label samples on sonic sides, association and the sample table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borelake.operators.ranks import average_ranks, between, medians, order_statistics, quantiles
from borelake.operators.series import bracketed, lerp, nearest, prepared
from borelake.shared import stored

FEATURES = ("rms", "peak_abs", "mean_abs", "early_energy", "late_energy", "late_ratio")


def _mean(values: Column, of) -> Column:
    """Mean over an array's known elements."""
    known = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.aggregate(known, F.lit(0.0), lambda a, x: a + of(x)) / F.when(F.size(known) > 0, F.size(known))


def time_window(samples: Column, start: float, stop: float) -> Column:
    """floor(start * n) up to ceil(stop * n), one sample at least."""
    n = F.size(samples)
    first = F.floor(n * start).cast("int")
    last = F.least(F.greatest(F.ceil(n * stop).cast("int"), first + 1), n)
    return F.slice(samples, first + 1, last - first)


def basic_features(rows: DataFrame, early=(0.0, 0.35), late=(0.35, 1.0)) -> DataFrame:
    """``rows`` with FEATURES of their samples in place of them; array functions only."""
    s = F.col("samples")
    square = lambda x: x * x
    known = F.filter(s, lambda x: x.isNotNull() & ~F.isnan(x))
    done = rows.withColumns({"rms": F.sqrt(_mean(s, square)), "peak_abs": F.array_max(F.transform(known, F.abs)), "mean_abs": _mean(s, F.abs),
        "early_energy": _mean(time_window(s, *early), square), "late_energy": _mean(time_window(s, *late), square)})
    return done.withColumn("late_ratio", F.col("late_energy") / F.greatest("early_energy", F.lit(1e-12))).drop("samples")


def by_side(features: DataFrame) -> DataFrame:
    """Mean and median over receivers."""
    return features.groupBy("well_id", "xsi_idx", "side").agg(*(F.avg(f).alias(f) for f in FEATURES), *(F.percentile(f, F.lit(0.5)).alias(f"{f}_median") for f in FEATURES))


def side_labels(labels: DataFrame, side_of: DataFrame) -> DataFrame:
    """Per depth, side and convention: presence, severity and confidence of the side's sectors."""
    rows = labels.join(F.broadcast(side_of.withColumnRenamed("az_idx", "az_rot")), "az_rot")
    candidate, known = F.col("presence") == 1, F.col("presence") >= 0
    top = lambda cond, c: F.max(F.when(cond, F.col(c)))
    grouped = rows.groupBy("well_id", "depth_idx", "side", "convention").agg(F.max("presence").alias("presence"), top(candidate, "severity").alias("_worst"),
        top(candidate, "confidence").alias("_sure"), top(known, "confidence").alias("_any"))
    one = F.col("presence") == 1
    return grouped.withColumns({"severity": F.when(one, F.greatest("_worst", F.lit(1))).when(F.col("presence") == 0, 0).otherwise(-1),
        "confidence": F.coalesce(F.when(one, F.col("_sure")).otherwise(F.col("_any")), F.lit(0.0))}).drop("_worst", "_sure", "_any")


def label_samples(sides: DataFrame, image_depths: DataFrame, axis: DataFrame, pose_confidence: DataFrame, least: float = 0.5,
    sure_of_none: bool = False, any_known: bool = True) -> DataFrame:
    """Per sonic depth and side: plus and minus labels of the nearest image depth, mismatch, orientation and validity flags.

    ``sure_of_none``: labels of no candidate need the confidence ``least`` too. ``any_known``: without it, only what is azimuthal counts for the rest.
    """
    return label_samples_at(sides, matched_depths(image_depths, axis), axis, pose_confidence, least, sure_of_none, any_known)


def matched_depths(image_depths: DataFrame, axis: DataFrame) -> DataFrame:
    """Per sonic depth (well_id, xsi_idx, depth) the nearest image depth's depth_idx, and mismatch, the distance to it."""
    matched = bracketed(image_depths, axis, ["well_id"], ["depth_idx"])
    at = nearest("depth_idx")
    there = F.when(at == F.col("before.depth_idx"), F.col("before.depth")).otherwise(F.col("after.depth"))
    return matched.select("well_id", "xsi_idx", "depth", at.alias("depth_idx"), F.abs(F.col("depth") - there).alias("mismatch"))


def label_samples_at(sides: DataFrame, matched: DataFrame, axis: DataFrame, pose_confidence: DataFrame, least: float = 0.5,
    sure_of_none: bool = False, any_known: bool = True) -> DataFrame:
    """``label_samples`` of ``matched_depths``; ``sides`` need only have these depths."""
    orient = bracketed(prepared(pose_confidence, ["well_id"]), axis, ["well_id"], ["confidence"]).select("well_id", "xsi_idx", F.coalesce(lerp("confidence", least=2), F.lit(0.0)).alias("orientation"))
    pick = lambda c, v: F.max(F.when(F.col("convention") == v, F.col(c))).alias(f"{c}_{v}")
    wide = sides.groupBy("well_id", "depth_idx", "side").agg(*(pick(c, v) for v in ("plus", "minus") for c in ("presence", "severity", "confidence")))
    rows = matched.join(orient, ["well_id", "xsi_idx"]).join(wide, ["well_id", "depth_idx"])
    known = F.col("presence_plus") >= 0
    sure = F.col("confidence_plus") >= least
    sure = sure if sure_of_none else sure | (F.col("presence_plus") == 0)
    azimuthal = known & (F.col("orientation") >= least) & sure
    return rows.withColumns({"disagreement": F.col("presence_plus") != F.col("presence_minus"), "azimuthal": azimuthal, "non_azimuthal": known if any_known else azimuthal})


#: Subsets of samples: name, convention, and condition (fixed values of the reports).
def subsets() -> list[tuple[str, str, Column]]:
    plus, minus = F.col("presence_plus") >= 0, F.col("presence_minus") >= 0
    return [
        ("all_known", "plus", plus), ("high_confidence", "plus", F.col("azimuthal") & plus), ("low_confidence", "plus", F.col("non_azimuthal") & ~F.col("azimuthal") & plus),
        ("plus_minus_disagreement", "plus", F.col("disagreement") & plus), ("all_known_minus_audit", "minus", minus), ("high_confidence_minus_audit", "minus", F.col("azimuthal") & minus),
    ]


def in_subsets(samples: DataFrame) -> DataFrame:
    """A row for each sample and subset, with that subset's presence and confidence; severity is that of plus."""
    marks = [F.when(cond, F.struct(F.lit(n).alias("subset"), F.lit(c).alias("convention"), F.col(f"presence_{c}").alias("presence"),
        F.col(f"confidence_{c}").alias("confidence"))) for n, c, cond in subsets()]
    return samples.withColumn("_in", F.explode(F.array_compact(F.array(*marks)))).select(*samples.columns, "_in.*")


def subset_counts(samples: DataFrame) -> DataFrame:
    p = F.col("presence")
    return in_subsets(samples).groupBy("convention", "subset").agg(F.count_if(p >= 0).alias("n_known"), F.count_if(p == 1).alias("n_candidate"), F.count_if(p == 0).alias("n_non_candidate"))


def association(samples: DataFrame, features: list[str]) -> DataFrame:
    """Per convention, subset and feature: class means, medians, differences, effect size, rank correlations, severity means.

    The rows are written once. Sums are one grouped pass; medians and ranks come from counts over ranges.
    """
    keys = ["convention", "subset", "feature"]
    long = in_subsets(samples).unpivot(["convention", "subset", "presence", "confidence", "severity_plus"], features, "feature", "v").filter("v is not null")
    long = stored(long, "long")
    c, n = F.col("presence") == 1, F.col("presence") == 0
    v, w = F.col("v"), F.col("confidence")
    weighted = lambda k: F.try_divide(F.sum(F.when(k & (w >= 0), v * w)), F.sum(F.when(k & (w >= 0), w)))
    done = long.groupBy(*keys).agg(
        F.count_if(c).alias("n_candidate"), F.count_if(n).alias("n_non_candidate"), F.avg(F.when(c, v)).alias("candidate_mean"), F.avg(F.when(n, v)).alias("non_candidate_mean"),
        weighted(c).alias("weighted_candidate_mean"), weighted(n).alias("weighted_non_candidate_mean"),
        F.var_samp(F.when(c, v)).alias("_vc"), F.var_samp(F.when(n, v)).alias("_vn"), *(F.avg(F.when(F.col("severity_plus") == k, v)).alias(f"severity_mean_{k}") for k in range(4)),
    )
    a, b = F.col("n_candidate"), F.col("n_non_candidate")
    pooled = F.when((a >= 2) & (b >= 2), F.sqrt(((a - 1) * F.col("_vc") + (b - 1) * F.col("_vn")) / (a + b - 2)))
    difference = F.col("candidate_mean") - F.col("non_candidate_mean")
    w_difference = F.col("weighted_candidate_mean") - F.col("weighted_non_candidate_mean")
    known = F.filter(F.array(*(F.col(f"severity_mean_{k}") for k in range(4))), lambda x: x.isNotNull())
    steps = F.zip_with(F.slice(known, F.lit(1), F.greatest(F.size(known) - 1, F.lit(0))), F.slice(known, F.lit(2), F.greatest(F.size(known) - 1, F.lit(0))), lambda p, q: q - p)
    done = done.withColumns({
        "mean_difference": difference, "difference_share": difference / F.greatest(F.abs("non_candidate_mean"), F.lit(1e-12)),
            "weighted_difference_share": w_difference / F.greatest(F.abs("weighted_non_candidate_mean"), F.lit(1e-12)),
        "effect": F.try_divide(difference, F.when(pooled > 0, pooled)), "rising": F.when(F.size(known) >= 3, F.forall(steps, lambda s: s >= 0)),
        "falling": F.when(F.size(known) >= 3, F.forall(steps, lambda s: s <= 0)),
    }).drop("_vc", "_vn")
    middle = quantiles(long.filter(c | n), [*keys, "presence"], "v", {"m": 0.5})
    middle = middle.groupBy(*keys).agg(*(F.max(F.when(F.col("presence") == k, F.col("m"))).alias(f"{name}_median") for k, name in ((1, "candidate"), (0, "non_candidate"))))
    done = done.join(middle, keys, "left")
    for name, label, cond in (("spearman_presence", "presence", c | n), ("spearman_severity", "severity_plus", F.col("severity_plus") >= 0)):
        done = done.join(spearman(long.filter(cond), keys, "v", label).withColumnRenamed("r", name), keys, "left")
    return done


def spearman(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation per group, ties with their mean rank; null under three rows or for a constant.

    Equal pairs are counted first; ranks are found over ranges of values, so no group is one task. The mean of all ranks is (n + 1) / 2.
    """
    known = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = stored(known.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("_n")), "pairs")
    ranks = pairs
    for c in (a, b):
        ranks = ranks.join(average_ranks(pairs, keys, c, f"_r_{c}", "_n").drop("n"), [*keys, c])
    n, ra, rb = F.col("_n"), F.col(f"_r_{a}"), F.col(f"_r_{b}")
    sums = ranks.groupBy(*keys).agg(
        F.sum("_n").alias("_all"), F.sum(n * ra * ra).alias("_aa"), F.sum(n * rb * rb).alias("_bb"), F.sum(n * ra * rb).alias("_ab"),
        ((F.min(ra) < F.max(ra)) & (F.min(rb) < F.max(rb))).alias("_vary"),
    )
    middle = F.col("_all") * ((F.col("_all") + 1) / 2) * ((F.col("_all") + 1) / 2)
    r = (F.col("_ab") - middle) / F.sqrt((F.col("_aa") - middle) * (F.col("_bb") - middle))
    return sums.select(*keys, F.when((F.col("_all") >= 3) & F.col("_vary"), r).alias("r"))


def top_effects(rows: DataFrame, n: int = 8) -> DataFrame:
    """The features of greatest effect among sure plus labels; a report of the top ``n``."""
    own = rows.filter("convention = 'plus' and subset = 'high_confidence' and effect is not null")
    return own.orderBy(F.abs("effect").desc(), "feature").limit(n)


def observations(rows: DataFrame, least: int = 20) -> DataFrame:
    """Enough samples of each class, and any signal."""
    return rows.groupBy("convention", "subset").agg(
        (F.min(F.least("n_candidate", "n_non_candidate")) >= least).alias("enough"),
        F.coalesce(F.bool_or((F.abs("effect") >= 0.05) | (F.abs("weighted_difference_share") >= 0.01)), F.lit(False)).alias("signal"),
    )


def sample_table(samples: DataFrame, features: DataFrame, sides: int, most_error: float | None = 0.5) -> DataFrame:
    """Labels and features of each depth and side, with sample_id, depth error flags and weights."""
    rows = samples.join(features, ["well_id", "xsi_idx", "side"])
    large = F.lit(False) if most_error is None else F.col("mismatch") > most_error
    valid = reduce(lambda p, q: p & q, (F.col(f).isNotNull() for f in FEATURES))
    weight = F.when(F.col("azimuthal") & ~large & valid, F.col("confidence_plus") * F.when(F.col("disagreement"), 0.5).otherwise(1.0)).otherwise(0.0)
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))
    return rows.withColumns({"sample_id": F.col("xsi_idx") * sides + F.col("side"), "large_error": large, "feature_valid": valid, "weight": weight, "include": weight > 0})


def scales(logged: DataFrame, features: list[str], low: float, high: float) -> DataFrame:
    """One row with, for each feature, the quantiles ``low`` and ``high`` of log_* (low_*, high_*) and the median and quartiles of what is clipped to them (q1_*, q2_*, q3_*).

    One pass over counted values: clipping keeps the order, so a place of the clipped values holds the clipped value of that place.
    """
    long = logged.select(*(F.col(f"log_{f}").alias(f) for f in features)).unpivot([], features, "feature", "v")
    found = order_statistics(long, ["feature"], "v", {"low": low, "high": high, "q1": 0.25, "q2": 0.5, "q3": 0.75})
    found = found.withColumns({"low": between(F.col("low")), "high": between(F.col("high"))})
    clip = lambda c: F.greatest(F.least(c, F.col("high")), F.col("low"))
    found = found.withColumns({q: between(F.struct(clip(F.col(q)["low"]).alias("low"), clip(F.col(q)["high"]).alias("high"), F.col(q)["part"].alias("part"))) for q in ("q1", "q2", "q3")})
    return found.agg(*(F.max(F.when(F.col("feature") == f, F.col(q))).alias(f"{q}_{f}") for f in features for q in ("low", "high", "q1", "q2", "q3")))


def transformed(rows: DataFrame, features: list[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """``rows`` with log_* (log1p of what is over 0) and scaled_* (clipped to two quantiles, then robustly scaled by the clipped values' median and quartiles).

    The rows are written once; the one row of ``scales`` is broadcast.
    """
    logged = stored(rows.withColumns({f"log_{f}": F.log1p(F.greatest(F.col(f), F.lit(0.0))) for f in features}), "logged")
    return _scaled(logged, scales(logged, features, low, high), features).select(*logged.columns, *(f"scaled_{f}" for f in features))


def _scaled(logged: DataFrame, by: DataFrame, features: list[str]) -> DataFrame:
    done = logged.crossJoin(F.broadcast(by))
    for f in features:
        clipped = F.when(F.col(f"log_{f}").isNotNull(), F.greatest(F.least(F.col(f"log_{f}"), F.col(f"high_{f}")), F.col(f"low_{f}")))
        iqr = F.col(f"q3_{f}") - F.col(f"q1_{f}")
        done = done.withColumn(f"scaled_{f}", (clipped - F.col(f"q2_{f}")) / F.when(iqr > 0, iqr).otherwise(1.0))
    return done


def standard_differences(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per subset and name: (mean1 - mean0) / sqrt((var1 + var0) / 2); here all that is not azimuthal is low confidence."""
    known = rows.filter("presence_plus >= 0")
    marks = F.array_compact(F.array(F.lit("all_known"), F.when(F.col("azimuthal"), "high_confidence").otherwise("low_confidence"), F.when(F.col("disagreement"), "plus_minus_disagreement")))
    long = known.withColumn("subset", F.explode(marks)).unpivot(["subset", "presence_plus"], names, "name", "v").filter("v is not null")
    c, n = F.col("presence_plus") == 1, F.col("presence_plus") == 0
    done = long.groupBy("subset", "name").agg(F.count_if(c).alias("n_candidate"), F.count_if(n).alias("n_non_candidate"),
        F.avg(F.when(c, F.col("v"))).alias("m1"), F.avg(F.when(n, F.col("v"))).alias("m0"), F.var_samp(F.when(c, F.col("v"))).alias("v1"), F.var_samp(F.when(n, F.col("v"))).alias("v0"))
    spread = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return done.withColumn("difference", F.try_divide(F.col("m1") - F.col("m0"), F.when(spread > 0, spread))).drop("m1", "m0", "v1", "v0")


def transform_report(rows: DataFrame, features: list[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Per feature: known and missing values, ranges, means and medians raw, logged and scaled, the clip limits, and how many values they cut."""
    logged = stored(rows.select(*features, *(F.log1p(F.greatest(F.col(f), F.lit(0.0))).alias(f"log_{f}") for f in features)), "logged")
    done = _scaled(logged, scales(logged, features, low, high), features)
    each = [F.struct(F.lit(f).alias("feature"), F.col(f"low_{f}").alias("clip_low"), F.col(f"high_{f}").alias("clip_high"),
        F.col(f).cast("double").alias("raw"), F.col(f"log_{f}").alias("log"), F.col(f"scaled_{f}").alias("scaled")) for f in features]
    long = stored(done.select(F.explode(F.array(*each)).alias("x")).select("x.*"), "stages")
    kinds = ["raw", "log", "scaled"]
    found = long.groupBy("feature", "clip_low", "clip_high").agg(
        F.count("raw").alias("n"), F.count_if(F.col("raw").isNull()).alias("n_missing"), F.count_if((F.col("log") < F.col("clip_low")) | (F.col("log") > F.col("clip_high"))).alias("n_clipped"),
        *(f(c).alias(f"{c}_{n}") for c in kinds for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))),
    )
    return found.join(medians(long, ["feature"], kinds), "feature", "left")


def association_gate(counts: DataFrame, features: DataFrame, seen: DataFrame) -> DataFrame:
    """One decision: ``counts`` (n_azimuthal, n_non_azimuthal), the finite share of all features of the sides, and ``observations`` of the sure plus labels."""
    known = sum(F.coalesce(~F.isnan(f) & (F.abs(f) != float("inf")), F.lit(False)).cast("int") for f in FEATURES)
    finite = features.agg((F.sum(known) / (F.count(F.lit(1)) * len(FEATURES))).alias("finite_share"))
    sure = seen.filter("convention = 'plus' and subset = 'high_confidence'").agg(F.coalesce(F.bool_or(F.col("enough") & F.col("signal")), F.lit(False)).alias("sure"))
    row = counts.crossJoin(finite).crossJoin(sure)  # one row each
    blocked = (F.col("n_non_azimuthal") < F.col("n_azimuthal")) | (F.col("finite_share") < 0.5) | ~F.col("sure")
    return row.withColumn("decision", F.when(blocked, "no_go").when(F.col("finite_share") < 0.95, "conditional_go").otherwise("go"))
