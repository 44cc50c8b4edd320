"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from weft import checkpoints

_own: dict[str, str] = {}
#: After so many tables the driver collects garbage: broadcast blocks stay on executors until it does.
COLLECT_EVERY = 8
_written = 0
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``checkpoints.folder``."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"{checkpoints.folder(spark)}/weft-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _own[app])
    return _own[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the cluster clears its checkpoint folder
        pass


def saved(df: DataFrame, drop: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    It cuts the lineage, survives the loss of executors, and leaves both sides of
    a later join plain exchanges, which Spark can split where a key is hot.  The
    write's shuffle files go with it, and so do the saved tables in ``drop``,
    which nothing may read any more.
    """
    global _written
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    _written += 1
    if _written % COLLECT_EVERY == 0:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    for old in drop:
        _remove(spark, old._saved_at)
    out = spark.read.schema(schema).parquet(path)
    out._saved_at = path
    return out
