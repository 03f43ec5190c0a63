"""Where intermediate results go, and how lineage is cut.

Every folder named here is one that all executors share: the one in
``spark.checkpoint.dir``.  Only where that setting is absent (a local session,
as in tests) a folder under the system's temporary path is taken, and only if
the session runs in local mode.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, for checkpoints and written tables."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="borelake-")
    context.setCheckpointDir(at)
    return at


_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def tidy(spark: SparkSession) -> int:
    """Remove the tables that this process has written to the shared folder; to be called when their results have been used. Checkpoints are Spark's (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    return _removed(spark, 0)


def _removed(spark: SparkSession, since: int) -> int:
    """Remove the folders that were named after the first ``since``."""
    gone = 0
    while len(_made) > since:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def written(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """The table of ``make``, written; tables that ``make`` wrote on the way are removed, and shuffle files of its jobs let go.

    Spark removes a shuffle's files once the driver's garbage collection finds it unused. A driver that has memory
    left puts that off, and files of all steps add up on the disks, so it is asked for here.
    """
    begun = len(_made)
    table = stored(make(), name)
    own = _made.pop()
    _removed(spark, begun)
    _made.append(own)
    gc.collect()  # frames that Python still holds
    for _ in range(2):  # Spark's listeners hold the last job for a moment
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    return table


_run: ContextVar[dict | None] = ContextVar("_run", default=None)


def stage(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``make(spark, sf_dir)`` as a stage table: within one ``run`` it is computed and written once, and read by all that need it."""

    @wraps(make)
    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = _run.get()
        if known is None:
            return make(spark, sf_dir)
        key = (make.__module__, make.__qualname__, sf_dir)
        if key not in known:
            known[key] = stored(make(spark, sf_dir), make.__name__)
        return known[key]

    return made


def run(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` with stage tables of its own; a query inside another shares the outer one's."""

    @wraps(query)
    def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
        if _run.get() is not None:
            return query(spark, sf_dir)
        token = _run.set({})
        try:
            return query(spark, sf_dir)
        finally:
            _run.reset(token)

    return whole
