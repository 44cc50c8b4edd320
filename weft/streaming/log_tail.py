"""Following the append-only log of running evolutions with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.reports import parse_log


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (file, generation, ...) from the text files that arrive in a folder."""
    raw = spark.readStream.format("text").load(folder)
    return parse_log(raw.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")))


def progress(log: DataFrame) -> DataFrame:
    """(file, generation, best_fitness): how far each run is, for the complete or update mode; a state row for each run."""
    g = log.groupBy("file").agg(F.max(F.struct("generation", "best_fitness")).alias("m"))
    return g.select("file", "m.generation", "m.best_fitness")


def start(spark: SparkSession, folder: str, table: str, checkpoint: str):
    """Writes the progress to a memory table; stop it with ``.stop()``."""
    q = progress(follow(spark, folder)).writeStream.outputMode("complete").format("memory").queryName(table)
    return q.option("checkpointLocation", checkpoint).start()
