"""Rules on rows: one aggregate for all of them, and the rows that fail them apart.

A rule is a name, a level (``error`` or ``warning``) and a condition that holds
for rows that break it; a null condition breaks nothing. All rules of a table are
counted in one pass, with the smallest key that breaks each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Legal values (fixed values of the label format).
PRESENCE, SEVERITY = (-1, 0, 1), (-1, 0, 1, 2, 3)
SOURCES = ("cast_weak_label",)
CONVENTIONS = ("plus", "minus")
CONVENTION_STATUS = "requires_confirmation"


@dataclass(frozen=True)
class Rule:
    """What must not be."""

    name: str
    breaks: Column
    level: str = "error"


def _broken(rule: Rule) -> Column:
    return F.coalesce(rule.breaks, F.lit(False))


def checked(rows: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """One row a rule: rule, level, n (rows that break it), key (the smallest of them as JSON, null if none)."""
    names = [f"_{k}" for k in range(len(rules))]
    flagged = rows.select(F.struct(*keys).alias("_key"), *(_broken(r).alias(n) for n, r in zip(names, rules, strict=True)))
    sums = flagged.agg(*(F.struct(F.count_if(n).alias("n"), F.min(F.when(F.col(n), F.col("_key"))).alias("key")).alias(n) for n in names))
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.level).alias("level"), F.col(n)["n"].alias("n"),
        F.to_json(F.col(n)["key"]).alias("key")) for n, r in zip(names, rules, strict=True)))
    return sums.select(F.explode(each).alias("_r")).select("_r.*")


def quarantined(rows: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """The rows that break no error, and the others with the names of what they break."""
    marks = F.array_compact(F.array(*(F.when(_broken(r), r.name) for r in rules if r.level == "error")))
    marked = rows.withColumn("broken", marks)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def label_rules(source: str | None = None, status: str | None = None, final: str | None = None) -> list[Rule]:
    """Rules of a label table (presence, severity, confidence, convention); ``source``, ``status`` and ``final`` name columns to check too. A value that is missing where the others are there is a shape that differs."""
    there = F.col("presence").isNotNull() | F.col("severity").isNotNull() | F.col("confidence").isNotNull()
    rules = [
        Rule("presence_code", ~F.col("presence").isin(*PRESENCE)), Rule("severity_code", ~F.col("severity").isin(*SEVERITY)),
        Rule("confidence_range", _finite("confidence") & ~F.col("confidence").between(0, 1)), Rule("confidence_not_finite", there & ~_finite("confidence"), "warning"),
        Rule("shape_of_severity", there & (F.col("presence").isNull() != F.col("severity").isNull())), Rule("shape_of_confidence",
            there & (F.col("presence").isNull() != F.col("confidence").isNull())),
        Rule("convention", ~F.coalesce(F.col("convention").isin(*CONVENTIONS), F.lit(False))),
    ]
    no = lambda c, ok: ~F.coalesce(ok(F.col(c)), F.lit(False))
    rules += [Rule("label_source", no(source, lambda c: c.isin(*SOURCES)))] if source else []
    rules += [Rule("convention_status", no(status, lambda c: c == CONVENTION_STATUS))] if status else []
    rules += [Rule("final_labels", no(final, lambda c: c))] if final else []
    return rules


def _rank(kind: T.DataType) -> int:
    return 1 + _rank(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def schema_issues(tables: dict[str, DataFrame], required: dict[str, dict[str, int]]) -> list[tuple[str, str, str]]:
    """(table, level, issue) from schemas alone: tables and columns that are missing, and columns of another rank (nested arrays) than ``required`` says."""
    found = []
    for table, columns in required.items():
        if table not in tables:
            found.append((table, "error", "missing_table"))
            continue
        have = tables[table].schema
        for column, rank in columns.items():
            if column not in have.names:
                found.append((table, "error", f"missing_column:{column}"))
            elif _rank(have[column].dataType) != rank:
                found.append((table, "error", f"rank:{column}"))
    return found


#: Columns and ranks of aligned tables (fixed values of the contract).
ALIGNED = {
    "waveforms": {"well_id": 0, "xsi_idx": 0, "receiver": 0, "side": 0, "samples": 1},
    "image": {"well_id": 0, "depth_idx": 0, "az_idx": 0, "zc": 0},
}


def contract_issues(spark: SparkSession, tables: dict[str, DataFrame], axes: dict[str, DataFrame], required: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """table, level and issue of aligned tables against their axis tables (``side``, ``time``, ``sector``, ``depth``: a row for each place of the axis).

    Missing columns and wrong ranks are errors, and nothing else is looked at then.
    Sides, samples and sectors must be as many as their axes have; depths that differ only warn.
    Each table is read once; axes are counted.
    """
    kinds = "table string, level string, issue string"
    found = schema_issues(tables, ALIGNED if required is None else required)
    found += [("axis", "error", f"missing_axis:{name}") for name in ("side", "time", "sector", "depth") if name not in axes]
    if found:
        return spark.createDataFrame(found, kinds)
    size = {name: rows.agg(F.count(F.lit(1)).alias(f"_{name}")) for name, rows in axes.items()}
    waves = tables["waveforms"].agg(F.countDistinct("side").alias("_sides"), F.min(F.size("samples")).alias("_least"), F.max(F.size("samples")).alias("_most"),
        F.countDistinct("xsi_idx").alias("_depths"))
    image = tables["image"].agg(F.countDistinct("az_idx").alias("_sectors"), F.countDistinct("depth_idx").alias("_rows"))
    row = reduce(DataFrame.crossJoin, [waves, image, *size.values()])  # one row each
    says = lambda cond, table, level, issue: F.when(cond, F.struct(F.lit(table).alias("table"), F.lit(level).alias("level"), F.lit(issue).alias("issue")))
    return row.select(F.explode(F.array_compact(F.array(
        says(F.col("_sides") != F.col("_side"), "waveforms", "error", "sides"),
        says((F.col("_least") != F.col("_time")) | (F.col("_most") != F.col("_time")), "waveforms", "error", "samples"),
        says(F.col("_sectors") != F.col("_sector"), "image", "error", "sectors"),
        says(F.col("_depths") != F.col("_depth"), "waveforms", "warning", "depths"),
        says(F.col("_rows") != F.col("_depth"), "image", "warning", "depths"),
    ))).alias("_i")).select("_i.*")


def decided(issues: DataFrame, artifacts: list[str]) -> DataFrame:
    """artifact, n_errors, n_warnings, status and the decision over all: no_go with any error, conditional_go with any warning, else go. ``issues``: artifact, level, n."""
    table = F.broadcast(issues.sparkSession.createDataFrame([(a,) for a in artifacts], "artifact string"))
    count = lambda level: F.coalesce(F.sum(F.when(F.col("level") == level, F.col("n"))), F.lit(0))
    done = table.join(issues.filter("n > 0"), "artifact", "left").groupBy("artifact").agg(count("error").alias("n_errors"), count("warning").alias("n_warnings"))
    status = F.when(F.col("n_errors") > 0, "fail").when(F.col("n_warnings") > 0, "warning").otherwise("pass")
    worst = done.agg(F.max(F.when(F.col("n_errors") > 0, 2).when(F.col("n_warnings") > 0, 1).otherwise(0)).alias("_worst"))
    decision = F.when(F.col("_worst") == 2, "no_go").when(F.col("_worst") == 1, "conditional_go").otherwise("go")
    return done.crossJoin(F.broadcast(worst)).select("artifact", "n_errors", "n_warnings", status.alias("status"), decision.alias("decision"))
