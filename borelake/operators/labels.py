"""Rolling baselines, the candidate rule, and labels with an explained confidence."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.functions.angles import orientation_confidence, orientation_uncertain, rotated
from borelake.operators.components import components
from borelake.operators.ranks import medians
from borelake.operators.series import BLOCK, gap_filled
from borelake.shared import stored

ALPHA, LIMIT, OUTLIER = 0.35, 2.5, 0.95
MODERATE, SEVERE = 0.45, 0.60
LEAST_FINITE = 0.70
#: Depths of a tile, inside which a task joins neighbouring cells by itself. It changes no result.
TILE = 1024
#: Evidence bits (fixed values of the label format).
ABS_THRESHOLD, RELATIVE_DROP, FUSED_RULE, UNCERTAIN = 1, 2, 16, 32


def rolling(values: np.ndarray, half: int, quantile: float) -> np.ndarray:
    """For each place, the order statistic of the values up to ``half`` places away, from a window that is kept sorted as it slides."""
    window: list[float] = sorted(values[:half].tolist())
    out, n, given = np.empty(len(values)), len(values), values.tolist()
    for i in range(n):
        if i + half < n:
            insort(window, given[i + half])
        if i > half:
            del window[bisect_left(window, given[i - half - 1])]
        out[i] = window[max(math.ceil(len(window) * quantile), 1) - 1]
    return out


def baseline(cells: DataFrame, half: int = 10, quantile: float = 0.9, block: int = BLOCK) -> DataFrame:
    """Per cell of a full image (well_id, depth_idx, depth, az_idx, zc): zc_base, finite_fraction, baseline_valid, zc_ratio, relative_drop.

    The base is an order statistic of the gap-filled column in a window of
    2 * half + 1 depths whose edges repeat the first and last row.  Columns are cut
    into blocks of depths, each with a copy of the ``half`` rows on either side; gaps
    are filled in blocks too, so no task holds a whole well.  A block keeps its window
    sorted as it slides, so wide windows cost about what narrow ones do.
    """
    if not 0 < quantile < 1 or not 0 < half <= block:
        raise ValueError("quantile must be in (0, 1) and half in 1..block")
    filled = gap_filled(cells, ["well_id", "az_idx"], "zc", "_zf", block=block)
    last = cells.groupBy("well_id").agg(F.max("depth_idx").alias("_last"))
    at = filled.join(last, "well_id")
    before, after = F.sequence(F.lit(-half).cast("long"), F.lit(0).cast("long")), F.sequence(F.lit(0).cast("long"), F.lit(half).cast("long"))
    shifts = F.when((F.col("depth_idx") == 0) & (F.col("_last") == 0), F.array_union(before, after)).when(F.col("depth_idx") == 0,
        before).when(F.col("depth_idx") == F.col("_last"), after).otherwise(F.array(F.lit(0).cast("long")))
    padded = at.withColumn("_shift", F.explode(shifts)).withColumn("_pos", F.col("depth_idx") + F.col("_shift"))
    home = F.floor(F.greatest(F.least(F.col("_pos"), F.col("_last")), F.lit(0)) / block)
    near = F.array_distinct(F.transform(F.array(F.lit(-half), F.lit(0), F.lit(half)), lambda d: F.floor(F.greatest(F.least(F.col("_pos") + d, F.col("_last")), F.lit(0)) / block)))
    dealt = padded.withColumn("_block", F.explode(near)).withColumn("_own", (F.col("_shift") == 0) & (home == F.col("_block")))
    names = cells.columns
    out = T.StructType([*(dealt.schema[c] for c in names), T.StructField("zc_base", T.DoubleType()), T.StructField("finite_fraction", T.DoubleType())])

    def slide(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_pos")
        known = np.concatenate([[0], np.cumsum(rows.column("zc").is_valid().to_numpy())])
        place = np.arange(rows.num_rows)
        low, high = np.maximum(place - half, 0), np.minimum(place + half + 1, rows.num_rows)
        base = rolling(rows.column("_zf").to_numpy(), half, quantile)
        made = rows.select(names).append_column("zc_base", pa.array(base)).append_column("finite_fraction", pa.array((known[high] - known[low]) / (high - low)))
        return made.filter(rows.column("_own"))

    rolled = dealt.select(*names, "_zf", "_pos", "_block", "_own").groupBy("well_id", "az_idx", "_block").applyInArrow(slide, out)
    valid = F.col("zc").isNotNull() & (F.col("zc_base") > 0) & (F.col("finite_fraction") >= LEAST_FINITE)
    rolled = rolled.withColumn("baseline_valid", valid)
    return rolled.select(*names, "zc_base", "finite_fraction", "baseline_valid", F.when(valid, F.col("zc") / F.col("zc_base")).alias("zc_ratio"), F.when(valid,
        (F.col("zc_base") - F.col("zc")) / F.col("zc_base")).alias("relative_drop"))


def severity(candidate: Column, valid: Column, moderate: float | Column = MODERATE, severe: float | Column = SEVERE) -> Column:
    drop = F.col("relative_drop")
    return F.when(~valid, -1).when(~candidate, 0).when(drop >= severe, 3).when(drop >= moderate, 2).otherwise(1)


def ruled(based: DataFrame, alpha: float | Column = ALPHA, limit: float | Column = LIMIT, moderate: float | Column = MODERATE, severe: float | Column = SEVERE) -> DataFrame:
    """``baseline`` rows with bad-data masks, the two rules, presence (-1, 0, 1), severity (-1..3) and evidence bits."""
    false = F.lit(False)
    outlier = F.coalesce(F.col("relative_drop") > OUTLIER, false)
    bad = F.col("zc").isNull() | (F.col("zc") <= 0) | outlier
    rows = based.withColumns({"outlier": outlier, "bad": bad, "by_drop": F.coalesce(F.col("zc") < F.col("zc_base") * (F.lit(1.0) - alpha), false), "by_limit": F.coalesce(F.col("zc") < limit, false)})
    rows = rows.withColumn("valid", F.col("baseline_valid") & ~F.col("bad"))
    rows = rows.withColumn("candidate", F.col("valid") & (F.col("by_drop") | F.col("by_limit")))
    drop, low = F.col("valid") & F.col("by_drop"), F.col("valid") & F.col("by_limit")
    bits = F.when(F.col("valid"), 0).otherwise(UNCERTAIN).bitwiseOR(F.when(drop, RELATIVE_DROP).otherwise(0)).bitwiseOR(F.when(low,
        ABS_THRESHOLD).otherwise(0)).bitwiseOR(F.when(drop & low, FUSED_RULE).otherwise(0))
    return rows.withColumns({"presence": F.when(~F.col("valid"), -1).when(F.col("candidate"), 1).otherwise(0), "severity": severity(F.col("candidate"),
        F.col("valid"), moderate, severe), "evidence": bits})


def cell_ids(cells: DataFrame) -> DataFrame:
    """``cells`` with one number for well, depth and sector."""
    return cells.withColumn("cell", (F.col("well_id") * (1 << 40) + F.col("depth_idx") * (1 << 12) + F.col("az_idx")).cast("long"))


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and their links: the smallest node each can reach."""
    label = np.arange(n)
    while True:
        new, low = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def cell_components(cells: DataFrame, sectors: int, wrap: bool, masks: str | None = None, tile: int = TILE) -> DataFrame:
    """run, well_id, depth_idx, az_idx, component: cells that 8-neighbours lead to one another, across 0/360 if ``wrap``; the component is its smallest cell.

    ``masks`` names a column of bits: bit k says that the cell is there in run k; all runs are done together. Without it there is run 0.
    A task joins the cells of a tile of depths; only labels on both sides of a tile's edge become nodes of a graph.
    """
    own = cell_ids(cells.select("well_id", F.col("depth_idx").cast("long").alias("depth_idx"), F.col("az_idx").cast("long").alias("az_idx"),
        (F.col(masks).cast("long") if masks else F.lit(1).cast("long")).alias("_masks")))
    own = own.withColumn("_tile", F.floor(F.col("depth_idx") / tile))

    def joined(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cell")
        masks, cell, depth, az = (rows.column(c).to_numpy() for c in ("_masks", "cell", "depth_idx", "az_idx"))
        parts = []
        for k in range(int(masks.max()).bit_length() if len(masks) else 0):
            at = np.flatnonzero(masks >> k & 1)
            if not len(at):
                continue
            d, z = depth[at] - depth[0], az[at]
            grid = np.full((int(d.max()) + 2, sectors), -1)
            grid[d, z] = np.arange(len(at))
            a, b = [], []
            for down, side in ((0, 1), (1, -1), (1, 0), (1, 1)):
                to = z + side
                there = np.ones(len(at), bool) if wrap else (to >= 0) & (to < sectors)
                other = grid[d + down, to % sectors]
                there &= other >= 0
                a.append(np.flatnonzero(there))
                b.append(other[there])
            label = _labels(len(at), np.concatenate(a), np.concatenate(b))
            parts.append(rows.take(pa.array(at)).select(["well_id", "depth_idx", "az_idx"]).append_column("run",
                pa.array(np.full(len(at), k, np.int32))).append_column("label", pa.array(cell[at][label])))
        return pa.concat_tables(parts) if parts else rows.slice(0, 0).select(["well_id", "depth_idx", "az_idx"]).append_column("run", pa.array([],
            pa.int32())).append_column("label", pa.array([], pa.int64()))

    out = T.StructType([own.schema["well_id"], own.schema["depth_idx"], own.schema["az_idx"], T.StructField("run", T.IntegerType()), T.StructField("label", T.LongType())])
    found = stored(own.groupBy("well_id", "_tile").applyInArrow(joined, out), "tiles")
    node = lambda c: F.format_string("%04d|%020d", "run", c)
    edge = F.pmod("depth_idx", F.lit(tile))
    low = found.filter(edge == tile - 1).select("run", "well_id", (F.col("depth_idx") + 1).alias("depth_idx"),
        F.explode(F.array(*(F.col("az_idx") + k for k in (-1, 0, 1)))).alias("az_idx"), node("label").alias("a"))
    if wrap:
        low = low.withColumn("az_idx", F.pmod("az_idx", F.lit(sectors)))
    high = found.filter(edge == 0).select("run", "well_id", "depth_idx", "az_idx", node("label").alias("b"))
    whole = components(low.join(high, ["run", "well_id", "depth_idx", "az_idx"]).select("a", "b").distinct())
    whole = whole.select(F.split_part("node", F.lit("|"), F.lit(1)).cast("int").alias("run"), F.split_part("node", F.lit("|"),
        F.lit(2)).cast("long").alias("label"), F.split_part("component", F.lit("|"), F.lit(2)).cast("long").alias("component"))
    return found.join(whole, ["run", "label"], "left").select("run", "well_id", "depth_idx", "az_idx", F.coalesce("component", "label").alias("component"))


def isolated(rows: DataFrame, sectors: int, most: int = 3) -> DataFrame:
    """Outlier cells in groups of at most ``most``; groups don't reach across 0/360."""
    found = cell_components(rows.filter("outlier"), sectors, wrap=False)
    small = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)
    return found.join(small, "component", "left_semi").drop("component", "run")


def component_summary(cells: DataFrame, sectors: int, depth_step: float, az_step: float, speck: int = 3) -> DataFrame:
    """Per well: components, their depth lengths and azimuth widths, and the share of cells in small ones."""
    found = cell_components(cells, sectors, wrap=True)
    each = found.groupBy("well_id", "component").agg(((F.max("depth_idx") - F.min("depth_idx") + 1) * depth_step).alias("length"),
        (F.countDistinct("az_idx") * az_step).alias("width"), F.count(F.lit(1)).alias("n"))
    each = stored(each, "components")
    stats = [f(c).alias(f"{c}_{n}") for c in ("length", "width") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    done = each.groupBy("well_id").agg(F.count(F.lit(1)).alias("n_components"), *stats, (F.sum(F.when(F.col("n") <= speck, F.col("n")).otherwise(0)) / F.sum("n")).alias("speckle_share"))
    return done.join(medians(each, ["well_id"], ["length", "width"]), "well_id")


def _bits(flags: list[Column]) -> Column:
    """One number of which bit k is flag k."""
    bits = [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(flags)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total


def threshold_grid(rows: DataFrame, alphas: list[float], limits: list[float], severities: list[tuple[float, float]], sectors: int, low: float = 0.25, speck: int = 3) -> DataFrame:
    """One row for each alpha, limit and pair of severity bounds: what the candidate rule finds with them.

    ``rows`` are ``baseline`` rows with inc_deg and rb_deg. A cell gets one bit for
    each alpha and limit at which it is a candidate; cells of equal bits are counted,
    so settings are met with a few hundred counts and not with cells. Both
    conventions are compared by bits too, and components of all settings come from
    one pass over tiles.
    """
    runs = [(a, z) for a in alphas for z in limits]
    plain = with_confidence(ruled(rows)).withColumn("_sure", F.col("c_baseline") * F.col("c_orientation") * F.col("c_bearing") * F.col("c_data"))
    drops = [F.coalesce(F.col("zc") < F.col("zc_base") * (1.0 - a), F.lit(False)) & F.col("valid") for a in alphas]
    lows = [F.coalesce(F.col("zc") < z, F.lit(False)) & F.col("valid") for z in limits]
    strength = F.greatest(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("relative_drop") / 0.7)), F.lit(0.0)), F.lit(0.25))
    cells = stored(plain.select(
        "well_id", "depth_idx", "az_idx", "rb_deg", "valid", "outlier", "bad", "relative_drop", _bits(drops).alias("drops"), _bits(lows).alias("lows"),
        _bits([d | z for d in drops for z in lows]).alias("masks"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), strength * F.col("_sure"))).alias("sure"),
    ), "grid-cells")

    # counts of equal cells
    drop = F.col("relative_drop")
    grades = [F.when(drop >= s, 3).when(drop >= m, 2).otherwise(1).alias(f"grade{k}") for k, (m, s) in enumerate(severities)]
    counts = cells.select("*", *grades).groupBy("masks", "drops", "lows", "valid", "outlier", "bad", *(f"grade{k}" for k in range(len(severities)))).agg(
        F.count(F.lit(1)).alias("n"), F.sum("sure").alias("sure"), F.count_if(F.col("sure") < low).alias("n_low"),
    )
    settings = [(r, i, j, k, a, z, *severities[k]) for r, (a, z) in enumerate(runs) for i, j in [(r // len(limits), r % len(limits))] for k in range(len(severities))]
    table = F.array(*(F.struct(F.lit(r).alias("run"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"), F.lit(float(a)).alias("alpha"),
        F.lit(float(z)).alias("zlimit"), F.lit(m).alias("moderate"), F.lit(s).alias("severe")) for r, i, j, k, a, z, m, s in settings))
    met = counts.withColumn("_s", F.explode(table)).select("*", "_s.*")
    bit = lambda c, k: F.expr(f"shiftright({c}, {k}) & 1 = 1")
    one, by_drop, by_limit = bit("masks", "run"), bit("drops", "i"), bit("lows", "j")
    grade = F.array(*(F.col(f"grade{k}") for k in range(len(severities))))[F.col("k")]
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    done = met.groupBy("run", "alpha", "zlimit", "moderate", "severe").agg(
        total(F.col("valid")).alias("n_known"), total(one).alias("n_candidate"), total(by_drop & ~by_limit).alias("n_drop_only"),
            total(by_limit & ~by_drop).alias("n_limit_only"), total(by_drop & by_limit).alias("n_both"),
        total(one & (grade == 3)).alias("n_severe"), total(one & (grade == 2)).alias("n_moderate"), total(F.col("outlier")).alias("n_outlier"), total(F.col("bad")).alias("n_bad"),
        F.sum(F.when(one, F.col("sure"))).alias("_sure"), F.sum(F.when(one, F.col("n_low"))).alias("_low"),
    )
    done = done.withColumns({"coverage": F.try_divide("n_candidate", "n_known"), "confidence_mean": F.try_divide("_sure", "n_candidate"),
        "low_share": F.try_divide("_low", "n_candidate")}).drop("_sure", "_low")

    # both conventions
    turned = both_conventions(cells.select("well_id", "depth_idx", "az_idx", "rb_deg", "valid", "masks"), sectors)
    pick = lambda c, v: F.max(F.when((F.col("convention") == v) & F.col("valid"), F.col(c)))
    sides = stored(turned.groupBy("well_id", "depth_idx", "az_rot").agg(pick("masks", "plus").alias("plus"), pick("masks", "minus").alias("minus")), "grid-turned")
    same = sides.groupBy("plus", "minus").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.explode(F.array(*map(F.lit, range(len(runs))))))
    p, m = bit("plus", "run"), bit("minus", "run")
    share = lambda cond, of: F.try_divide(total(cond), total(of))
    both = F.col("plus").isNotNull() & F.col("minus").isNotNull()
    apart = same.groupBy("run").agg(share(p, F.col("plus").isNotNull()).alias("plus_coverage"), share(m, F.col("minus").isNotNull()).alias("minus_coverage"),
        share(both & (p != m), both).alias("disagreement"))

    # components of the plus labels
    found = cell_components(sides.filter("plus > 0").withColumnRenamed("az_rot", "az_idx"), sectors, True, "plus")
    each = found.groupBy("run", "component").agg(F.count(F.lit(1)).alias("n"))
    objects = each.groupBy("run").agg(F.count(F.lit(1)).alias("n_components"), (F.sum(F.when(F.col("n") <= speck, F.col("n")).otherwise(0)) / F.sum("n")).alias("speckle_share"))
    return done.join(F.broadcast(apart), "run", "left").join(F.broadcast(objects), "run", "left").fillna({"n_components": 0}).drop("run")


def with_confidence(rows: DataFrame, isolated_cells: DataFrame | None = None) -> DataFrame:
    """``ruled`` rows with inc_deg and rb_deg get each part of the confidence, clipped, and their product."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    strength = F.coalesce(clip(F.col("relative_drop") / 0.7), F.lit(0.0))
    strength = F.when(F.col("candidate"), F.greatest(strength, F.lit(0.25))).otherwise(strength * 0.25)
    orient = orientation_confidence(F.col("inc_deg"))
    orient = F.when(orientation_uncertain(F.col("inc_deg")), F.least(orient, F.lit(0.05))).otherwise(orient)
    if isolated_cells is None:
        rows = rows.withColumn("isolated", F.lit(False))
    else:
        rows = rows.join(isolated_cells.withColumn("isolated", F.lit(True)), ["well_id", "depth_idx", "az_idx"], "left").fillna({"isolated": False})
    bad = F.when(F.col("zc").isNull() | (F.col("zc") < 0) | (F.col("zc") > 20), 0.5).otherwise(1.0)
    bad = F.when(F.col("bad"), 0.0).when(F.col("isolated"), 0.1).otherwise(bad)
    parts = {"c_strength": strength, "c_baseline": F.when(F.col("baseline_valid"), clip(F.col("finite_fraction"))).otherwise(0.0), "c_orientation": orient,
        "c_bearing": F.col("rb_deg").isNotNull().cast("double"), "c_data": bad}
    rows = rows.withColumns(parts)
    product = F.col("c_strength") * F.col("c_baseline") * F.col("c_orientation") * F.col("c_bearing") * F.col("c_data")
    return rows.withColumn("confidence", F.when(F.col("valid"), clip(product)).otherwise(0.0))


def both_conventions(rows: DataFrame, sectors: int) -> DataFrame:
    """Each label turned to the high side both ways: convention and the sector az_rot. A projection, no shuffle."""
    return rows.withColumn("_turned", F.explode(F.array(*(F.struct(F.lit(c).alias("convention"), rotated(F.col("az_idx"), F.col("rb_deg"), c,
        sectors).alias("az_rot")) for c in ("plus", "minus"))))).select(*rows.columns, "_turned.*")


def disagreement(labels: DataFrame) -> DataFrame:
    """Per well: share of sectors known under both conventions whose presence differs. Two grouped rows instead of a self-join."""
    cell = labels.groupBy("well_id", "depth_idx", "az_rot").agg(*(F.max(F.when(F.col("convention") == c, F.col("presence"))).alias(c) for c in ("plus", "minus")))
    known = cell.filter("plus >= 0 and minus >= 0")
    return known.groupBy("well_id").agg(F.count(F.lit(1)).alias("n_both"), F.avg((F.col("plus") != F.col("minus")).cast("int")).alias("disagreement"))


def coverage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: known cells, candidates and their share, and whether that is out of bounds."""
    done = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("presence") >= 0).alias("n_known"), F.count_if(F.col("presence") == 1).alias("n_candidate"))
    share = F.try_divide("n_candidate", "n_known")
    level = F.when(share.isNull() | (share < 1e-6) | (share > 0.8), "error").when((share < 0.001) | (share > 0.4), "warn").otherwise("ok")
    return done.withColumns({"coverage": share, "level": level})


def audit(labels: DataFrame, low: float = 0.25, warn: float = 0.25, block: float = 0.50) -> DataFrame:
    """Per well: candidates over both conventions, the share of unsure ones, disagreement and its level."""
    one = F.col("presence") == 1
    done = labels.groupBy("well_id").agg(F.count_if(one).alias("n_candidate"), F.count_if(one & (F.col("confidence") < low)).alias("_low"))
    apart = F.col("disagreement")
    level = F.when(apart > block, "block").when(apart > warn, "warn").otherwise("ok")
    return done.join(disagreement(labels), "well_id", "left").withColumns({"low_share": F.try_divide("_low", "n_candidate"), "level": level}).drop("_low")


def rule_of(config: dict) -> tuple[dict, list[str], list[str]]:
    """The candidate rule of a configuration (alpha, limit and its status, severity bounds), with errors and warnings: alpha lies in (0, 1), severity bounds rise, a limit that is not a number is the fallback, or an error if it must be confirmed."""
    threshold, grades = config.get("threshold") or {}, config.get("severity") or {}
    errors, warnings = [], []
    alpha = float(threshold.get("relative_drop_alpha", ALPHA))
    if not 0 < alpha < 1:
        errors.append("alpha")
    try:
        limit, status = limit_of(threshold.get("zc_min_limit"), bool(threshold.get("require_confirmed_zc_min_limit", False)), float(threshold.get("conservative_fallback_mrayl", LIMIT)))
    except ValueError:
        limit, status = None, "missing_required"
        errors.append("limit")
    if status == "requires_confirmation":
        warnings.append("limit")
    bounds = [float(grades.get(k, v)) for k, v in (("mild_min_drop", 0.30), ("moderate_min_drop", MODERATE), ("severe_min_drop", SEVERE))]
    if bounds != sorted(bounds):
        errors.append("severity")
    return {"alpha": alpha, "limit": limit, "status": status, "mild": bounds[0], "moderate": bounds[1], "severe": bounds[2]}, errors, warnings


def limit_of(value: float | str | None, confirmed: bool = False, fallback: float = LIMIT) -> tuple[float, str]:
    """The impedance limit to use and its status: a number is confirmed; anything else takes the fallback, or is an error if it must be confirmed."""
    try:
        return float(value), "confirmed"
    except (TypeError, ValueError):
        if confirmed:
            raise ValueError("the impedance limit is not confirmed") from None
        return fallback, "requires_confirmation"
