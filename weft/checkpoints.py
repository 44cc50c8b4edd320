"""The folder that driver and executors share: the one the session names, or a temporary one on a local master."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_temporary: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all tasks run in the driver's process, else an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _temporary:
        _temporary[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='weft-')}"
    return _temporary[sc.applicationId]


def ensure(spark: SparkSession) -> None:
    """Lets ``DataFrame.checkpoint`` write there."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark))
