"""Joins of points and intervals by bins of depth.

An interval is dealt to the bins that it touches, a point lies in one bin, so
the join is an equality on keys and bin and the exact test follows. A bin is as
wide as intervals are on average, which keeps their copies below about two each
(those of average width) and the work linear in points, intervals and matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _width(intervals: DataFrame, low: Column, high: Column) -> DataFrame:
    """One row: the mean width of the intervals, 1 if there is none or all are points."""
    mean = F.avg(F.when(high > low, high - low))
    return F.broadcast(intervals.agg(F.coalesce(mean, F.lit(1.0)).alias("_width")))


def _dealt(intervals: DataFrame, low: Column, high: Column) -> DataFrame:
    """A row for each bin (_bin) that an interval touches."""
    bins = F.sequence(F.floor(low / F.col("_width")), F.floor(high / F.col("_width")))
    return intervals.withColumn("_bin", F.explode(F.when(low <= high, bins)))


def points_in(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str) -> DataFrame:
    """Each point with each interval of the same ``keys`` that it lies in, ends included. Null and non-finite ends hold nothing."""
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf")) for c in (low, high)]
    sound = intervals.filter(known[0] & known[1])
    width = _width(sound, F.col(low), F.col(high))
    dealt = _dealt(sound.crossJoin(width), F.col(low), F.col(high)).drop("_width")
    placed = points.crossJoin(width).withColumn("_bin", F.floor(F.col(at) / F.col("_width"))).drop("_width")
    return placed.join(dealt, [*keys, "_bin"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("_bin")


def overlapping(rows: DataFrame, others: DataFrame, keys: list[str], low: Column, high: Column, low2: Column, high2: Column) -> DataFrame:
    """Each interval of ``rows`` with each of ``others`` of the same ``keys`` that it shares more than an end with.

    A pair is found in one bin only: the one where the later of the two begins.
    """
    width = _width(rows, low, high)
    a = _dealt(rows.withColumns({"_low": low, "_high": high}).filter("_low < _high").crossJoin(width), F.col("_low"), F.col("_high"))
    b = others.withColumns({"_low2": low2, "_high2": high2}).filter("_low2 < _high2").crossJoin(width)
    b = _dealt(b, F.col("_low2"), F.col("_high2")).drop("_width")
    begin = F.greatest("_low", "_low2")
    met = a.join(b, [*keys, "_bin"]).filter((begin < F.least("_high", "_high2")) & (F.floor(begin / F.col("_width")) == F.col("_bin")))
    return met.drop("_bin", "_width", "_low", "_high", "_low2", "_high2")
