"""Written stages: staged, stamped and published by one rename.

Rows are written to a folder of their own beside the target and only then
renamed, so a job that fails, or is tried again, leaves what was there before.
A target that exists is refused unless it is to be replaced; then the old folder
is moved aside first, and moved back if the new one can't take its place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = "_stamp.json"
#: What every stage declares (fixed values of the stage format).
FLAGS = {"no_final_labels": True, "not_ground_truth": True}


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def digest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows, and a digest that no order of rows or partitions changes: hash sums of their JSON."""
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(F.lit(seed), "t").cast("decimal(38,0)")) for seed in (1, 2)]
    n, a, b = rows.select(text.alias("t")).agg(F.count(F.lit(1)), *sums).first()
    return n, f"{int(a or 0) % 2**64:016x}{int(b or 0) % 2**64:016x}"


def published(rows: DataFrame, path: str, version: str, config: str, flags: dict[str, bool] | None = None, replace: bool = False, kind: str = "parquet") -> dict:
    """Write ``rows`` to ``path`` with version, digest of the configuration and flags as columns, and the stamp as a file; returns the stamp."""
    spark = rows.sparkSession
    store, target = _store(spark, path)
    if store.exists(target) and not replace:
        raise FileExistsError(path)
    flags = FLAGS | (flags or {})
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    stamped = rows.withColumns({"data_version": F.lit(version), "config_sha256": F.sha2(F.lit(config), 256), **{k: F.lit(v) for k, v in flags.items()}})
    if kind == "csv":
        nested = [f.name for f in stamped.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        stamped = stamped.withColumns({c: F.to_json(c) for c in nested})
    try:
        stamped.write.option("header", True).format(kind).save(staging)
        written = spark.read.option("header", True).format(kind).load(staging)
        n, content = digest(written)
        stamp = {"version": version, "config_sha256": spark.range(1).select(F.sha2(F.lit(config), 256)).first()[0], "rows": n, "content": content, **flags}
        out = store.create(_store(spark, f"{staging}/{STAMP}")[1], False)
        out.write(bytearray(json.dumps(stamp, sort_keys=True).encode()))
        out.close()
        _renamed(store, _store(spark, staging)[1], target, _store(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")[1], replace)
    finally:
        at = _store(spark, staging)[1]
        if store.exists(at):
            store.delete(at, True)
    return stamp


def _renamed(store, staging, target, aside, replace: bool) -> None:
    """Put ``staging`` where ``target`` is or was."""
    old = store.exists(target)
    if old:
        if not replace:
            raise FileExistsError(target.toString())
        if not store.rename(target, aside):
            raise OSError(f"{target.toString()} can't be moved aside")
    if not store.rename(staging, target):
        if old:
            store.rename(aside, target)
        raise OSError(f"{target.toString()} can't be published")
    if old:
        store.delete(aside, True)


def stamp_of(spark: SparkSession, path: str) -> dict:
    """The stamp of a published folder."""
    store, at = _store(spark, f"{path.rstrip('/')}/{STAMP}")
    stream = store.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def verified(spark: SparkSession, path: str, kind: str = "parquet") -> bool:
    """Whether a published folder holds what its stamp says."""
    stamp = stamp_of(spark, path)
    return digest(spark.read.option("header", True).format(kind).load(path)) == (stamp["rows"], stamp["content"])
