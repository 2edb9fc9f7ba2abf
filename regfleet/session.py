"""Shared storage for intermediate tables."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Session settings the jobs are tuned for; they run with any others.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM interprets methods above this size; split projections instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session (as in
    tests) may fall back to a temporary folder; it is remembered in the session.
    """
    path = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a shared folder")
        path = tempfile.mkdtemp(prefix="regfleet-")
        spark.conf.set(_SETTING, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/regfleet/{label}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a columnar table and read it back.

    Cuts the lineage, so several consumers share one computation, a lost executor
    costs a re-read instead of a recomputation, and later scans still prune
    columns and push filters.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, limit: int):
    """Jobs that run inside pass at most ``limit`` bytes (or one row) at once to a Python task.

    The JVM and the Python worker each hold a batch; Spark's default is 64 MB. A limit
    that the session was given stays. No result depends on it, so it does no harm to
    jobs that other threads start in the session meanwhile.
    """
    given = spark.conf.get(_BATCH_BYTES, None)
    if given is None:
        spark.conf.set(_BATCH_BYTES, str(limit))
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(_BATCH_BYTES)
