"""Inventories of files and fields, and the checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Roles by file name, in order (fixed values of the file contract).
ROLES = (("xsi", r"(?i)xsi"), ("cast", r"(?i)cast"), ("pose", r"(?i)(pose|incl|relbearing)"))
#: Targets of a mapping: the role of their files, and the hint they expect (fixed values of the mapping format).
TARGETS = {
    "cast.zc": ("cast", "zc"), "cast.depth": ("cast", "depth"), "pose.depth": ("pose", "depth"), "pose.inclination": ("pose", "inclination"),
    "pose.relbearing": ("pose", "relbearing"), "xsi.waveform": ("xsi", "waveform"), "xsi.depth": ("xsi", "depth"), "xsi.time": ("xsi", "time"),
}
TODO = "TODO_CONFIRM"


def files(spark: SparkSession, folder: str, well: str = "") -> DataFrame:
    """Paths, sizes and times below ``folder``; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    return classified(rows.withColumn("well_id", F.lit(well)))


def classified(rows: DataFrame) -> DataFrame:
    """``rows`` (path) with role and receiver by file name."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    role = F.coalesce(*(F.when(name.rlike(p), r) for r, p in ROLES))
    number = F.regexp_extract(name, r"(?i)XSILMR(\d+)", 1)
    return rows.withColumns({"role": role, "receiver": F.when(number != "", number.cast("int"))})


def role_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("well_id", "role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("receiver").alias("n_receivers"))


def missing_roles(counts: DataFrame, roles: list[str], receivers: int) -> DataFrame:
    """Roles that a well lacks, and receivers that are not as many as expected."""
    wells = counts.select("well_id").distinct()
    wanted = wells.select("well_id", F.explode(F.array(*map(F.lit, roles))).alias("role"))
    absent = wanted.join(counts, ["well_id", "role"], "left_anti").select("well_id", "role", F.lit("missing").alias("problem"))
    odd = counts.filter((F.col("role") == "xsi") & (F.col("n_receivers") != receivers)).select("well_id", "role", F.lit("receivers").alias("problem"))
    return absent.union(odd)


def leaf(path: Column) -> Column:
    """The last part of a field path, letters and digits alone."""
    return F.regexp_replace(F.lower(F.regexp_extract(path, r"([^.]*)$", 1)), "[^a-z0-9]+", "")


def role_hint(path: Column, shape: Column) -> Column:
    """What a field holds, by the last part of its path and its shape; the first rule that fits."""
    n = leaf(path)
    wide = (F.size(shape) >= 2) & (F.array_contains(shape, 1024) | F.array_contains(shape, 8) & F.array_contains(shape, 13))
    return (
        F.when(n.contains("azimuth") | n.isin("azi", "azim"), "azimuth").when(n.isin("time", "t", "timems", "tad"), "time").when(n.contains("depth") | n.isin("md", "tvd"), "depth")
        .when(n.startswith("xsilmr") & (shape == F.array(F.lit(1), F.lit(1))), None)
        .when(n.contains("relbearing") | n.contains("relativebearing"), "relbearing").when(n.isin("inc", "incl") | n.contains("inclination"), "inclination")
        .when(n.endswith("zc") | n.contains("impedance") | n.contains("cast") & F.array_contains(shape, 180), "zc").when(n.rlike("wave|xsi") | wide, "waveform")
        .when(n.contains("zc"), "zc").when(n == "data", "waveform")
    )


def orientation(shape: Column) -> Column:
    return F.when(F.try_element_at(shape, F.lit(-1)) == 180, "azimuth_last").when(F.try_element_at(shape, F.lit(1)) == 180,
        "azimuth_first").when(F.array_contains(shape, 180), "contains").otherwise("unknown")


def scored(fields: DataFrame) -> DataFrame:
    """fields (well_id, role of the file, field_path, shape, dtype) x the targets that they can be, with hint and confidence."""
    n, shape = leaf(F.col("field_path")), F.col("shape")
    rows = fields.withColumn("hint", role_hint(F.col("field_path"), shape))
    hint = F.coalesce("hint", F.lit(""))
    two = F.size(shape) >= 2
    fits = {
        "zc": (hint == "zc") | n.endswith("zc") | n.contains("impedance") | n.contains("zc") & two, "depth": (hint == "depth") | n.isin("md", "tvd", "depthinc") | n.endswith("depth"),
        "inclination": (hint == "inclination") | n.isin("inc", "incl") | n.contains("inclination"), "relbearing": (hint == "relbearing") | n.contains("relbearing") | n.contains("relativebearing"),
        "waveform": (hint == "waveform") | (n == "data") | n.contains("waveform") | n.contains("wave") & two, "time": (hint == "time") | n.isin("time", "t",
        "tad", "timeaxis", "timems") | n.contains("time") & (F.size(shape) <= 2),
    }
    more = {
        "zc": F.when(F.array_contains(shape, 180), 0.12), "depth": F.when(n.isin("depth", "md", "depthinc"), 0.12), "inclination": F.when(n.isin("inc", "incl", "inclination"), 0.15),
        "relbearing": F.when(n.contains("relbearing"), 0.15), "waveform": F.when(F.col("field_path").rlike("Side[A-H]$"), 0.10), "time": F.when(n.isin("time", "t", "tad", "timems"), 0.08),
    }
    numeric = F.when(F.col("dtype").isin("float", "double", "int"), 0.04).otherwise(0.0)
    found = []
    for target, (role, kind) in TARGETS.items():
        score = F.lit(0.45) + F.when(hint == kind, 0.32).otherwise(0.0) + F.coalesce(more[kind], F.lit(0.0)) + numeric
        found.append(F.when((F.col("role") == role) & fits[kind], F.struct(F.lit(target).alias("target"), F.least(F.lit(0.99), score).alias("confidence"))))
    return rows.withColumn("_t", F.explode(F.array_compact(F.array(*found)))).select(*rows.columns, "_t.*")


def recommended(fields: DataFrame, least: float = 0.70, least_waveform: float = 0.72) -> DataFrame:
    """Per well and target: the field to take and its confidence, TODO_CONFIRM and 0 if none is sure enough; a complete group of waveform sides A-H of one shape goes first; the greatest sum of confidences decides between groups, of equal ones the smaller prefix."""
    from pyspark.sql import Window as W

    rows = scored(fields)
    place = F.row_number().over(W.partitionBy("well_id", "target").orderBy(F.desc("confidence"), "field_path"))
    first = rows.withColumn("_p", place).filter("_p = 1").select("well_id", "target", "field_path", "confidence")
    sides = rows.filter("target = 'xsi.waveform'").withColumns({"prefix": F.regexp_extract("field_path", r"^(.+Side)([A-H])$", 1),
        "letter": F.regexp_extract("field_path", r"^(.+Side)([A-H])$", 2)}).filter("letter <> ''")
    groups = sides.groupBy("well_id", "prefix", "shape").agg(F.countDistinct("letter").alias("n"), F.sum("confidence").alias("total"), F.least(F.lit(0.99),
        F.max("confidence") + 0.04).alias("sure")).filter("n = 8")
    best = groups.groupBy("well_id").agg(F.min_by(F.struct("prefix", "sure"), F.struct(-F.col("total"), F.col("prefix"), F.to_json("shape"))).alias("g"))
    wells = fields.select("well_id").distinct()
    asked = wells.withColumn("target", F.explode(F.array(*map(F.lit, TARGETS)))).join(first, ["well_id", "target"], "left").join(best, "well_id", "left")
    group = (F.col("target") == "xsi.waveform") & F.col("g").isNotNull()
    sure = F.coalesce(F.col("confidence") >= F.when(F.col("target") == "xsi.waveform", least_waveform).otherwise(least), F.lit(False))
    return asked.select(
        "well_id", "target", F.when(group, F.concat("g.prefix", F.lit("{A-H}"))).when(sure, F.col("field_path")).otherwise(TODO).alias("field_path"),
        F.when(group, F.col("g.sure")).when(sure, F.col("confidence")).otherwise(0.0).alias("confidence"),
    )


def side_groups(fields: DataFrame) -> DataFrame:
    """Complete groups of sides A-H with equal prefix and shape."""
    rows = fields.withColumns({"prefix": F.regexp_extract("field_path", r"^(.+Side)([A-H])$", 1), "letter": F.regexp_extract("field_path", r"^(.+Side)([A-H])$", 2)}).filter("letter <> ''")
    return rows.groupBy("well_id", "prefix", "shape").agg(F.countDistinct("letter").alias("n")).filter("n = 8").drop("n")


def target_audit(fields: DataFrame) -> DataFrame:
    """Per well and target: fields that can be it, and the problem: no_file of that role, no_candidate, or unknown_orientation of an image."""
    rows = scored(fields).groupBy("well_id", "target").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(orientation(F.col("shape")) == "unknown").alias("_unknown"),
    )
    asked = F.array(*(F.struct(F.lit(t).alias("target"), F.lit(role).alias("role")) for t, (role, _) in TARGETS.items()))
    wells = fields.groupBy("well_id").agg(F.collect_set("role").alias("_roles"))  # of three roles
    every = wells.withColumn("_t", F.explode(asked)).select("well_id", "_roles", "_t.*").join(rows, ["well_id", "target"], "left")
    n = F.coalesce("n_candidates", F.lit(0))
    problem = F.when(~F.array_contains("_roles", F.col("role")), "no_file").when(n == 0, "no_candidate").when((F.col("target") == "cast.zc") & (F.col("_unknown") > 0), "unknown_orientation")
    return every.select("well_id", "target", n.alias("n_candidates"), problem.alias("problem"))


def field_audit(fields: DataFrame, receivers: int) -> DataFrame:
    """Per well: receivers without fields, and names that differ or vary in shape between receivers."""
    by = fields.groupBy("well_id", "receiver").agg(F.array_sort(F.collect_set("field_path")).alias("names"))
    shapes = fields.groupBy("well_id", "field_path").agg(F.countDistinct("shape").alias("n")).groupBy("well_id").agg(F.count_if(F.col("n") > 1).alias("n_shape_mismatch"))
    return by.groupBy("well_id").agg((F.lit(receivers) - F.countDistinct("receiver")).alias("n_missing"), F.countDistinct("names").alias("n_name_sets")).join(shapes, "well_id")


def manifest_warnings(rows: DataFrame, expected: int | None = None, usual: int = 13, by_well: DataFrame | None = None) -> DataFrame:
    """Per well of ``classified`` rows: its receivers, errors (no_well_id) and what is odd: no image, no pose, other than the expected number of receivers, or as expected but other than the ``usual`` one.

    What is expected is what ``by_well`` (well_id, expected) says of the well, else ``expected``, else the usual number.
    """
    has = lambda r: F.count_if(F.col("role") == r)
    done = rows.groupBy("well_id").agg(has("cast").alias("_cast"), has("pose").alias("_pose"), has("xsi").alias("n_receivers"))
    if by_well is None:
        done = done.withColumn("_expected", F.lit(expected or usual))
    else:
        told = by_well.select(F.col("well_id").alias("_well"), F.col("expected").alias("_told"))
        done = done.join(told, F.col("well_id").eqNullSafe(F.col("_well")), "left").withColumn("_expected", F.coalesce("_told", F.lit(expected or usual))).drop("_well", "_told")
    n = F.col("n_receivers")
    count = F.when(n != F.col("_expected"), "receivers").when(n != usual, "unusual_receivers")
    missing = F.coalesce(F.trim(F.col("well_id").cast("string")) == "", F.lit(True))
    return done.withColumns({
        "warnings": F.array_compact(F.array(F.when(F.col("_cast") < 1, "no_cast"), F.when(F.col("_pose") < 1, "no_pose"), count)),
        "errors": F.array_compact(F.array(F.when(missing, "no_well_id"))),
    }).drop("_cast", "_pose", "_expected")


#: Top fields of a manifest, each with the names it can have (fixed values of the manifest format).
MANIFEST = (("schema_version",), ("data_version",), ("generated_at", "created_at"))


def manifest_errors(head: dict, wells: DataFrame) -> list[str]:
    """Errors of a manifest as a whole: top fields that are missing or empty, and no well at all."""
    found = [" or ".join(names) for names in MANIFEST if not any(head.get(n) for n in names)]
    return found + (["no_wells"] if wells.isEmpty() else [])
