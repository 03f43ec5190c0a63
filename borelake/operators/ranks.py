"""Row numbers, running totals and exact quantiles of groups of any size.

Rows are sorted over ranges of (keys, order), so that a large group is many
ranges. What stands before a range in its group is a sum over one row a range
and group; inside a range the sort or a window does the rest. No group is one
task and no frame reaches beyond a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from borelake.shared import stored


def _ranged(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``rows`` sorted over ranges and written; _at rises with the order, _range names the range."""
    by = [*keys, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged").withColumn("_range", F.shiftright("_at", 33))


def _beside(rows: DataFrame, more: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the columns of ``more`` where ``names`` agree; nulls agree with nulls."""
    right = more.select(*[F.col(c).alias(f"_of_{c}") if c in names else F.col(c) for c in more.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in names])
    return rows.join(right, same).drop(*[f"_of_{c}" for c in names])


def _before(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with _before: the _n of the blocks before, in the group. One row a range and group."""
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def numbered(rows: DataFrame, keys: list[str], order: list, name: str = "number") -> DataFrame:
    """``rows`` with their number in the group of ``keys``, from 1, in ``order`` (which should tell all rows apart).

    Null keys are a group. The order among rows that ``order`` leaves equal is that of the sort, and they stay in one range.
    """
    at = _ranged(rows, keys, order)
    blocks = _before(at.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), keys).drop("_n")
    found = _beside(at, blocks, [*keys, "_range"])
    return found.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_range", "_first", "_before")


def running(rows: DataFrame, keys: list[str], order: list, weight: str, name: str = "before") -> DataFrame:
    """``rows`` with the sum of ``weight`` over the rows before them in the group; the order must tell rows of a group apart."""
    at = _ranged(rows, keys, order)
    blocks = _before(at.groupBy(*keys, "_range").agg(F.sum(weight).alias("_n")), keys).drop("_n")
    inside = W.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    found = _beside(at.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0))), blocks, [*keys, "_range"])
    return found.withColumn(name, F.col("_inside") + F.col("_before")).drop("_at", "_range", "_inside", "_before")


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str = "rank", weight: str | None = None) -> DataFrame:
    """One row for each of a group's distinct values: keys, value, n (rows that have it, or the sum of their ``weight``) and their average rank. Nulls have none."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))
    return running(counts, keys, [value], "n", "_sum").withColumn(name, F.col("_sum") + (F.col("n") + 1) / 2).drop("_sum")


def order_statistics(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group: n (known values), and for each share of the way from the least to the greatest the values at the places below and above, as struct (low, high, part).

    Equal values are counted first. The ranges that hold a wanted place are found from counts; only their rows are summed up. Groups without known values have no row.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    at = _ranged(counts.withColumnRenamed(value, "_value"), keys, ["_value"])
    blocks = _before(at.groupBy(*keys, "_range").agg(F.sum("_c").alias("_n")), keys)
    blocks = blocks.withColumn("n", F.sum("_n").over(W.partitionBy(*keys)))
    place = {name: (F.col("n") - 1) * share for name, share in shares.items()}
    ends = [end(p) for p in place.values() for end in (F.floor, F.ceil)]
    holds = lambda rank, low, n: (rank >= low) & (rank < low + n)
    wanted = blocks.filter(reduce(Column.__or__, [holds(r, F.col("_before"), F.col("_n")) for r in ends]))
    inside = W.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    near = _beside(at, wanted.drop("_n"), [*keys, "_range"])
    near = near.withColumn("_low", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    picked = [F.max(F.when(holds(r, F.col("_low"), F.col("_c")), F.col("_value"))).alias(f"_{k}") for k, r in enumerate(ends)]
    found = near.groupBy(*keys, "n").agg(*picked)
    made = [F.struct(F.col(f"_{2 * k}").alias("low"), F.col(f"_{2 * k + 1}").alias("high"), (p - F.floor(p)).alias("part")).alias(name) for k, (name, p) in enumerate(place.items())]
    return found.select(*keys, "n", *made)


def between(of: Column) -> Column:
    """The linear quantile of a struct of ``order_statistics``."""
    return of["low"] + (of["high"] - of["low"]) * of["part"]


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the exact quantiles of the known values, by linear interpolation, under the names in ``shares``; groups without known values have no row."""
    return order_statistics(rows, keys, value, shares).select(*keys, *(between(F.col(name)).alias(name) for name in shares))


def medians(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per group: f"{value}_median" of each of ``values``, all in one pass."""
    long = rows.select(*keys, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(keys, values, "_name", "_v")
    found = quantiles(long, [*keys, "_name"], "_v", {"_m": 0.5})
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == v, F.col("_m"))).alias(f"{v}_median") for v in values))


def with_previous(rows: DataFrame, keys: list[str], order: list, value: str, name: str = "previous") -> DataFrame:
    """``rows`` with the ``value`` of the row before in the group; null for the first. The last row of a range is told to the next."""
    at = _ranged(rows, keys, order)
    blocks = at.groupBy(*keys, "_range").agg(F.max_by(F.struct(value), "_at").alias("_last"))
    blocks = blocks.withColumn("_earlier", F.lag("_last").over(W.partitionBy(*keys).orderBy("_range"))).drop("_last")
    inside = W.partitionBy(*keys, "_range").orderBy("_at")
    found = _beside(at.withColumn("_own", F.lag(F.struct(value)).over(inside)), blocks, [*keys, "_range"])
    return found.withColumn(name, F.coalesce("_own", "_earlier")[value]).drop("_at", "_range", "_own", "_earlier")


def islands(rows: DataFrame, keys: list[str], order: list, flag: Column, name: str = "island") -> DataFrame:
    """The flagged ``rows`` with the number of their unbroken run in the group.

    A range's summary is how many runs begin in it, and whether its first and last rows are flagged; where a run goes on into the next range, it keeps its number.
    """
    at = _ranged(rows.withColumn("_flag", F.coalesce(flag, F.lit(False))), keys, order)
    own = W.partitionBy(*keys, "_range").orderBy("_at")
    at = at.withColumn("_begins", (F.col("_flag") & ~F.coalesce(F.lag("_flag").over(own), F.lit(False))).cast("long"))
    blocks = at.groupBy(*keys, "_range").agg(F.sum("_begins").alias("_b"), F.min_by("_flag", "_at").alias("_first"), F.max_by("_flag", "_at").alias("_last"))
    series = W.partitionBy(*keys).orderBy("_range")
    goes_on = F.coalesce(F.col("_first") & F.lag("_last").over(series), F.lit(False)).cast("long")
    blocks = blocks.withColumn("_on", goes_on).withColumn("_n", F.col("_b") - F.col("_on"))
    blocks = _before(blocks, keys).select(*keys, "_range", (F.col("_before") - F.col("_on")).alias("_before"))
    here = at.withColumn("_inside", F.sum("_begins").over(own)).filter("_flag")
    return _beside(here, blocks, [*keys, "_range"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_at", "_range", "_flag", "_begins", "_inside", "_before")
