"""Checked loading of log tables.

A table is read with the columns of its kind, numbers that are no numbers become
null, and rows that can't be what the kind says are put aside with the reasons.
Rules are counted in one pass over the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.operators.checks import Rule, checked, quarantined
from borelake.operators.series import finite
from borelake.shared import stored

#: Columns of each kind, what names a row, and its numbers (fixed values of the log schemas).
KINDS = {
    "image": ("well_id long, depth_idx long, az_idx int, zc double", ("well_id", "depth_idx", "az_idx"), ("zc",)),
    "pose": ("well_id long, sample_idx long, depth double, inc_deg double, rb_deg double", ("well_id", "sample_idx"), ("depth", "inc_deg", "rb_deg")),
    "waveforms": ("well_id long, xsi_idx long, receiver int, side int, depth double, samples array<double>", ("well_id", "xsi_idx", "receiver", "side"), ("depth",)),
    "series": ("well_id long, series_id string, sample_idx long, depth double, value double", ("well_id", "series_id", "sample_idx"), ("depth", "value")),
}


@dataclass(frozen=True)
class Loaded:
    """The rows that are sound, those that are not with what they break, and the counts of each rule."""

    rows: DataFrame
    broken: DataFrame
    counts: DataFrame


def _rules(kind: str, sectors: int, sides: int) -> list[Rule]:
    _, keys, _ = KINDS[kind]
    rules = [Rule(f"no_{k}", F.col(k).isNull()) for k in keys]
    within = lambda c, n: ~F.col(c).between(0, n - 1)
    rules += {
        "image": [Rule("sector", within("az_idx", sectors)), Rule("depth_index", F.col("depth_idx") < 0), Rule("negative", F.col("zc") < 0, "warning"), Rule("missing", F.col("zc").isNull(), "warning")],
        "pose": [Rule("inclination", ~F.col("inc_deg").between(0, 180)), Rule("bearing", (F.col("rb_deg") < 0) | (F.col("rb_deg") >= 360), "warning"), Rule("no_depth", F.col("depth").isNull(), "warning")],
        "waveforms": [Rule("side", within("side", sides)), Rule("receiver", F.col("receiver") < 1), Rule("no_samples", F.coalesce(F.size("samples"), F.lit(0)) < 1), Rule("no_depth", F.col("depth").isNull(), "warning")],
        "series": [Rule("no_depth", F.col("depth").isNull(), "warning"), Rule("no_value", F.col("value").isNull(), "warning")],
    }[kind]
    return [*rules, Rule("repeated", F.col("_times") > 1)]


def _as(c: Column, kind: T.DataType) -> Column:
    """``c`` as ``kind``; what can't be read as it, and numbers that are none, is null."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: finite(x.try_cast(kind.elementType)))
    made = c.try_cast(kind)
    return finite(made) if isinstance(kind, T.DoubleType) else made


def load(rows: DataFrame, kind: str, sectors: int = 180, sides: int = 8) -> Loaded:
    """``rows`` as a table of ``kind``. A column that is missing is an error at once; further columns are left out.

    Keys that several rows have put all but one of them aside: the first by all columns stays.
    """
    schema, keys, _ = KINDS[kind]
    fields = T.StructType.fromDDL(schema).fields
    absent = [f.name for f in fields if f.name not in rows.columns]
    if absent:
        raise ValueError(f"{kind}: no column {', '.join(absent)}")
    own = rows.select(*(_as(F.col(f.name), f.dataType).alias(f.name) for f in fields))
    rest = [f.name for f in fields if f.name not in keys]
    # equal keys: values are put together before they are shuffled
    first = own.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first"), F.count(F.lit(1)).alias("_n"))
    kept = first.select(*keys, "_first.*", F.lit(1).alias("_times"))
    more = first.filter("_n > 1").select(*keys, "_first.*", F.col("_n").cast("int").alias("_times"))
    every = stored(kept.unionByName(more), f"loaded-{kind}")
    rules = _rules(kind, sectors, sides)
    sound, broken = quarantined(every, rules)
    return Loaded(sound.drop("_times"), broken.withColumnRenamed("_times", "times"), checked(every, rules, list(keys)))
