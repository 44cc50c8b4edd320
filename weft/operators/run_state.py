"""The committed generations of a run, from which it goes on after its driver has failed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

LOG = (
    "run long, generation int, best_fitness double, best_test double, best_rule_count long, best_used_rule_count long, "
    "avg_fitness double, avg_test double, avg_rule_count double, avg_used_rule_count double"
)


class RunState:
    """A folder with a table for each generation and a record that makes it count.

    A record names its generation's table and holds the generation's log rows (one for each run) and the settings.  It is
    written under another name and then renamed, so that it is there as a whole or not at all; a table without a record,
    of a driver that failed in between, is never read.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: dict):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), json.loads(json.dumps(settings, sort_keys=True))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join((self.folder, *parts)))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, generation: int) -> dict:
        stream = self._fs.open(self._path("commits", f"{generation}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        record = json.loads(text)
        if record["settings"] != self.settings:
            raise ValueError(f"{self.folder} holds a run of other settings: {record['settings']}")
        return record

    def last(self) -> int | None:
        """The last committed generation; one of other settings raises."""
        at = self._path("commits")
        if not self._fs.exists(at):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        found = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not found:
            return None
        self._read(max(found))
        return max(found)

    def kept(self, df: DataFrame) -> DataFrame:
        """``df`` written to the folder and read back, for a generation that isn't committed yet."""
        return self._written(df, f"open-{uuid.uuid4().hex}")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.parquet(f"{self.folder}/tables/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/tables/{name}")

    def table(self, generation: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/tables/{self._read(generation)['table']}")

    def log(self, generation: int) -> DataFrame:
        """The log rows of a committed generation."""
        return self.spark.createDataFrame([tuple(r) for r in self._read(generation)["log"]], LOG)

    def commit(self, generation: int, population: DataFrame, log: DataFrame) -> DataFrame:
        """Writes the generation's table and record; tables that no later generation needs go."""
        name = f"{generation}-{uuid.uuid4().hex}"
        out = self._written(population, name)
        rows = [list(r) for r in log.select(*[c.split()[0] for c in LOG.split(", ")]).collect()]  # a row for each run
        text = json.dumps({"generation": generation, "table": name, "log": rows, "settings": self.settings})
        draft = self._path("commits", f"_{name}")
        stream = self._fs.create(draft)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(draft, self._path("commits", f"{generation}.json")):
            raise RuntimeError(f"generation {generation} is already committed in {self.folder}")
        for s in self._fs.listStatus(self._path("tables")):
            if s.getPath().getName() != name:
                self._fs.delete(s.getPath(), True)
        return out
