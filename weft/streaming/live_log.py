"""Logs of running evolutions, repaired while they grow.

A run that is started again repeats generations.  The batch report
(``reports.repair_log``) reads a whole log backwards; a stream can't, so it
numbers a run's attempts as lines arrive: a line whose generation isn't above the
one before opens the next attempt.  Two numbers for each run are all its state;
runs share up to ``GROUPS`` state rows, so that many short runs cost no call each.
A line stays if its generation is below the first ones of all later attempts,
since generations rise within an attempt: ``repaired`` looks that up in a table
with a row for each attempt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from weft.operators.reports import NO_GENERATION, parse_log

#: Below any generation.
BEFORE_ALL = -(2**31)
#: State rows, each of the runs of one hash; a stream keeps the number it was started with.
GROUPS = 1024


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (run, piece, at, generation, ...) from the files that arrive in a folder.

    A file is named <run> or <run>.<piece>; a run's pieces arrive in the order of their names, each whole. A piece is read as
    one value, as a stream has no other order of lines, so writers should close a piece well before it fills a task.
    """
    name = F.col("_metadata.file_name")
    raw = spark.readStream.format("text").option("wholetext", True).load(folder)
    raw = raw.select(F.substring_index(name, ".", 1).alias("run"), name.alias("piece"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return parse_log(raw)


def attempts(log: DataFrame, *order: str) -> DataFrame:
    """A stream of a run's lines (run, generation, ...) with their ``attempt``, from 0; lines without a generation go.

    ``order`` are the columns that order a run's lines of one trigger; those of later triggers follow. A group's lines of one
    trigger meet in a task, so triggers are to be kept small (``maxFilesPerTrigger``) where runs are long.
    """
    log = log.where(F.col("generation").isNotNull()).withColumn("generation", F.col("generation").cast("int"))
    columns = log.columns

    def number(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["run", *order], kind="stable")
        held = [list(x) for x in state.get] if state.exists else [[], [], []]
        place = {run: k for k, run in enumerate(held[0])}
        code, names = pd.factorize(rows["run"], use_na_sentinel=False)
        runs = [None if pd.isna(run) else run for run in names.tolist()]
        for run in runs:
            if place.setdefault(run, len(place)) == len(held[0]):
                for x, v in zip(held, (run, 0, BEFORE_ALL), strict=True):
                    x.append(v)
        at = np.array([place[run] for run in runs])
        attempt, last = np.array(held[1]), np.array(held[2])
        g = rows["generation"].to_numpy()
        first = np.flatnonzero(np.diff(code, prepend=-1))  # sorted, so that a run's lines are together
        before = np.concatenate([[0], g[:-1]])
        before[first] = last[at]
        again = g <= before
        opened = np.cumsum(again)
        rows["attempt"] = (attempt[at][code] + opened - (opened - again)[first][code]).astype("int32")
        end = np.concatenate([first[1:], [len(g)]]) - 1
        attempt[at], last[at] = rows["attempt"].to_numpy()[end], g[end]
        state.update((held[0], attempt.tolist(), last.tolist()))
        yield rows[[*columns, "attempt"]]

    out = StructType([*log.schema.fields]).add("attempt", IntegerType())
    kind = f"runs array<{log.schema['run'].dataType.simpleString()}>, attempt array<int>, generation array<int>"
    group = F.coalesce(F.when(F.col("run").isNotNull(), F.pmod(F.xxhash64("run"), F.lit(GROUPS))), F.lit(-1))  # null: a group of its own
    return log.withColumn("_group", group).groupBy("_group").applyInPandasWithState(number, out, kind, "append", "NoTimeout")


def record(numbered: DataFrame, path: str, checkpoint: str, now: bool = False) -> StreamingQuery:
    """Appends the numbered lines to Parquet files, each once however often the stream is started again from ``checkpoint``.

    ``now``: what has arrived so far, then the query ends by itself.
    """
    out = numbered.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if now else out).start()


def repaired(recorded: DataFrame) -> DataFrame:
    """The recorded lines without those that a later attempt did again: at any time the batch repair of what has arrived."""
    first = recorded.groupBy("run", "attempt").agg(F.min("generation").alias("_first"))
    later = Window.partitionBy("run").orderBy(F.desc("attempt")).rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("run", "attempt", F.coalesce(F.min("_first").over(later), F.lit(NO_GENERATION)).alias("_least"))
    return recorded.join(first, ["run", "attempt"]).where(F.col("generation") < F.col("_least")).select(*recorded.columns)
