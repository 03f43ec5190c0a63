"""Quality summaries of numbers, waveforms and pose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borelake.operators.ranks import quantiles
from borelake.shared import stored


def numeric(rows: DataFrame, keys: list[str], value: Column, most: float = 0.1) -> DataFrame:
    """Per group: finite and missing shares, range, mean, population deviation, share of the largest magnitude, warn.

    The largest magnitude is joined back as one row a group, so both passes are plain grouped sums.
    """
    own = rows.select(*keys, value.alias("v"))
    top = own.groupBy(*keys).agg(F.max(F.abs("v")).alias("top"))
    joined = own.join(top, keys) if keys else own.crossJoin(top)
    done = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_finite"), F.avg((F.col("v") == 0).cast("int")).alias("zero_share"), F.min("v").alias("v_min"), F.max("v").alias("v_max"),
        F.avg("v").alias("v_mean"), F.stddev_pop("v").alias("v_std"), F.avg((F.abs("v") >= F.col("top")).cast("int")).alias("clip_share"),
    )
    return done.withColumn("finite_share", F.col("n_finite") / F.col("n")).withColumn("warn", (F.col("n_finite") < F.col("n")) | (F.col("clip_share") > most))


def image(rows: DataFrame, sectors: int = 180) -> DataFrame:
    """Per well of an image (depth_idx, az_idx, zc): sectors, negative values, and the warnings on them."""
    done = rows.groupBy("well_id").agg(F.countDistinct("az_idx").alias("n_sectors"), F.count_if(F.col("zc") < 0).alias("n_negative"))
    marks = F.array_compact(F.array(F.when(F.col("n_sectors") != sectors, "sectors"), F.when(F.col("n_negative") > 0, "negative")))
    return done.withColumn("warnings", marks)


def waveforms(rows: DataFrame, sides: int = 8, samples: int = 1024) -> DataFrame:
    """Per well: sides, longest waveform, and the warnings on them."""
    done = rows.groupBy("well_id").agg(F.countDistinct("side").alias("n_sides"), F.max(F.size("samples")).alias("longest"), F.count(F.lit(1)).alias("n"))
    return done.withColumn("warn", (F.col("n_sides") != sides) | (F.col("longest") > samples))


def pose(rows: DataFrame) -> DataFrame:
    """Per well: ranges of inclination and bearing, and whether they are legal."""
    done = rows.groupBy("well_id").agg(F.count(F.lit(1)).alias("n"), F.min("inc_deg").alias("inc_min"), F.max("inc_deg").alias("inc_max"),
        F.min("rb_deg").alias("rb_min"), F.max("rb_deg").alias("rb_max"))
    return done.withColumn("legal", (F.col("inc_min") >= 0) & (F.col("inc_max") <= 180) & (F.col("rb_min") >= 0) & (F.col("rb_max") < 360))


def summary(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per group and value column: n, finite share, range, mean, median."""
    long = stored(rows.select(*keys, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(keys, values, "name", "v"), "summary")
    sums = long.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"), (F.count("v") / F.count(F.lit(1))).alias("finite_share"), F.min("v").alias("v_min"),
        F.max("v").alias("v_max"), F.avg("v").alias("v_mean"))
    return sums.join(quantiles(long, [*keys, "name"], "v", {"v_median": 0.5}), [*keys, "name"], "left")
