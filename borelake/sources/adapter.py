"""Log tables derived from the driver's tables.

Operators see only the schemas of logs: image cells (ultrasonic impedance by depth
and azimuth sector), pose (inclination and bearing by depth), waveforms (samples by
depth, receiver and side) and series (values along any depth axis, in file order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borelake.shared import stage, stored

SECTORS = 12
SIDES = 8
SECTOR_STEP = 30.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@stage
def image_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well_id, depth_idx, depth, az_idx, zc of the cells that were measured."""
    return measured(spark, sf_dir)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 4 as well_id", "l_partkey div 4 as depth_idx", "cast(l_orderkey % 12 as int) as az_idx", "l_quantity")
    return rows.groupBy("well_id", "depth_idx", "az_idx").agg((F.max("l_quantity") / 5).alias("zc")).withColumn("depth", F.col("depth_idx") * 0.5)


@stage
def full_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_cells`` with a row for each depth and sector; zc is null where nothing was measured."""
    cells = image_cells(spark, sf_dir)
    return on_spine(cells, SECTORS).withColumn("depth", F.col("depth_idx") * 0.5)


@stage
def sounded_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``full_image`` of the wells that have waveforms, for what is asked at sonic depths alone."""
    wells = waveforms(spark, sf_dir).select("well_id").distinct()
    cells = stored(measured(spark, sf_dir).join(wells, "well_id", "left_semi"), "sounded_cells")
    return on_spine(cells, SECTORS).withColumn("depth", F.col("depth_idx") * 0.5)


def depths_of(image: DataFrame) -> DataFrame:
    """well_id, depth_idx, depth of a full image, which has each sector at each depth."""
    return image.filter("az_idx = 0").select("well_id", "depth_idx", "depth")


def on_spine(cells: DataFrame, sectors: int) -> DataFrame:
    """A row for each depth from 0 to a well's last and each sector."""
    last = cells.groupBy("well_id").agg(F.max("depth_idx").alias("last"))
    spine = last.select("well_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("depth_idx"))
    spine = spine.select("*", F.explode(F.sequence(F.lit(0), F.lit(sectors - 1))).alias("az_idx"))
    return spine.join(cells.drop("depth"), ["well_id", "depth_idx", "az_idx"], "left")


@stage
def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well_id, sample_idx, depth, inc_deg, rb_deg."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey % 4 as well_id", "p_partkey div 4 as sample_idx", "(p_partkey div 4) * 0.5D + 0.2D as depth",
        "p_size / 5.0D as inc_deg", "cast((p_partkey * 7 + p_size) % 360 as double) as rb_deg",
    )


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well_id, xsi_idx, receiver, side, depth, samples."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "0L as well_id", "vec_id div 16 as xsi_idx", "cast((vec_id div 8) % 2 as int) + 1 as receiver", "cast(vec_id % 8 as int) as side",
        "(vec_id div 16) * 8.0D + 0.1D * ((vec_id div 8) % 2) as depth", "cast(embedding as array<double>) as samples",
    )


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well_id, series_id, sample_idx, depth, value."""
    return table(spark, sf_dir, "events").selectExpr("user_id as well_id", "event_type as series_id", "event_id as sample_idx", "unix_micros(cast(ts as timestamp)) / 1e6D as depth", "value")
