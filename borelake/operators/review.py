"""Tables behind review figures, and decisions of gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borelake.operators.ranks import islands, numbered, order_statistics, quantiles


def thinned(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """``most`` evenly placed rows of each group, as a figure shows them."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = numbered(rows, keys, [order], "_r").join(n, keys).withColumn("_r", F.col("_r") - 1)
    k = F.round(F.col("_r") * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).cast("int")
    keep = (F.col("_n") <= most) | F.exists(F.array(k - 1, k, k + 1), lambda i: (i >= 0) & (i < most) & (F.floor(i * (F.col("_n") - 1) / (most - 1)) == F.col("_r")))
    return at.filter(keep).select(*rows.columns)


def limits(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Colour limits: the 1 and 99 percentiles, wider by one if they are equal."""
    ends = quantiles(rows, keys, value, {"low": 0.01, "high": 0.99})
    return ends.withColumn("high", F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.col("low") + 1))


def histogram(rows: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Counts in equal bins between a value's least and greatest; the last bin is closed."""
    ends = rows.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    at = F.when(F.col("_a") == F.col("_b"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1)))
    return rows.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def boxes(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group: known values and their quartiles."""
    names = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    found = order_statistics(rows, keys, value, names)
    own = rows.groupBy(*keys).agg(F.count(value).alias("n"))
    return own.join(found.drop("n"), keys, "left").select(*keys, "n", *((F.col(q)["low"] + (F.col(q)["high"] - F.col(q)["low"]) * F.col(q)["part"]).alias(q) for q in names))


def runs(rows: DataFrame, keys: list[str], flag: Column, order: str = "depth_idx", pad: float = 0.0) -> DataFrame:
    """Unbroken runs of flagged rows as depth spans."""
    found = islands(rows, keys, [order], flag)
    return found.groupBy(*keys, "island").agg((F.min("depth") - pad).alias("low"), (F.max("depth") + pad).alias("high"), F.count(F.lit(1)).alias("n")).drop("island")


def decided(metrics: DataFrame, rules: list[tuple[str, str, float, str]]) -> DataFrame:
    """A gate: metrics (well_id, metric, value) against rules (metric, how, bound, block or warn); a missing metric blocks. how: at_least and at_most allow the bound, below doesn't."""
    spark = metrics.sparkSession
    table = F.broadcast(spark.createDataFrame(rules, "metric string, how string, bound double, level string"))
    wells = metrics.select("well_id").distinct()
    checked = wells.crossJoin(table).join(metrics, ["well_id", "metric"], "left")
    fails = F.when(F.col("value").isNull(), True).when(F.col("how") == "at_least", F.col("value") < F.col("bound")).when(F.col("how") == "below",
        F.col("value") >= F.col("bound")).otherwise(F.col("value") > F.col("bound"))
    done = checked.withColumn("fails", fails).groupBy("well_id").agg(F.count_if(F.col("fails") & ((F.col("level") == "block") | F.col("value").isNull())).alias("n_block"), F.count_if(F.col("fails") & (F.col("level") == "warn")).alias("n_warn"))
    return done.withColumn("decision", F.when(F.col("n_block") > 0, "no_go").when(F.col("n_warn") > 0, "conditional_go").otherwise("go"))


def layers(labels: DataFrame) -> DataFrame:
    """Per turned cell what the review shows: both conventions, where they differ, bad data, outliers, severity of candidates only."""
    plus = F.col("convention") == "plus"
    cells = labels.groupBy("well_id", "depth_idx", "az_rot").agg(
        F.max(F.when(plus, F.col("presence"))).alias("plus"), F.max(F.when(~plus, F.col("presence"))).alias("minus"),
        F.bool_or(plus & F.col("bad")).alias("bad"), F.bool_or(plus & F.col("outlier")).alias("outlier"), F.max(F.when(plus, F.col("severity"))).alias("severity"),
    )
    return cells.withColumns({"apart": F.col("plus") != F.col("minus"), "candidate_severity": F.when(F.col("plus") == 1, F.col("severity"))})
