"""Create, read, update and delete on DataFrames and catalog tables; conditions are Columns, never strings of values."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column types of a blueprint (fixed values).
TYPES = {"TEXT": "string", "REAL": "double", "INTEGER": "bigint", "BLOB": "binary"}


def blueprint(text: str) -> tuple[str, dict[str, dict[str, str]]]:
    """(name, {table: {column: Spark type}}) of a JSON blueprint; every table has an ``id`` first."""
    spec = json.loads(text)
    name = spec.pop("name")
    kind = lambda t: TYPES.get(t.split()[0].upper(), "string")
    return name, {t: {"id": "bigint", **{c: kind(k) for c, k in cols.items()}} for t, cols in spec.items()}


def migrate(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the blueprint's columns: missing ones null, extra ones dropped, none retyped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def create_table(spark: SparkSession, name: str, columns: dict[str, str]) -> None:
    cols = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({cols}) USING parquet")


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def table_info(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` and the rows, cast to its types; columns that the rows lack are null."""
    return df.unionByName(migrate(rows, dict(df.dtypes)).select(*[F.col(c).cast(t).alias(c) for c, t in df.dtypes]))


def insert_unique(df: DataFrame, rows: DataFrame, condition: Column | None = None) -> DataFrame:
    """The rows are added if no row of ``df`` meets the condition; without one, only to an empty table."""
    met = df.where(F.lit(True) if condition is None else condition).agg((F.count("*") > 0).alias("_met"))
    keep = rows.join(F.broadcast(met)).where(~F.col("_met")).drop("_met")  # one row
    return insert(df, keep)


def insert_unique_by(df: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Rows whose value of ``column`` isn't in ``df`` yet are added, however many columns they have."""
    return insert(df, rows.join(df.select(column).distinct(), column, "left_anti").select(*rows.columns))


def select_one(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition).limit(1)


def select_all(df: DataFrame, condition: Column | None = None) -> DataFrame:
    return df if condition is None else df.where(condition)


def row_exists(df: DataFrame, condition: Column) -> bool:
    return not df.where(condition).isEmpty()


def update(df: DataFrame, values: dict[str, Column], condition: Column) -> DataFrame:
    """A null condition updates nothing."""
    return df.select(*[F.when(condition, values[c]).otherwise(F.col(c)).cast(t).alias(c) if c in values else F.col(c) for c, t in df.dtypes])


def delete(df: DataFrame, condition: Column) -> DataFrame:
    """A null condition deletes nothing."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def _touched(df: DataFrame, condition: Column, by: tuple[str, ...]) -> DataFrame:
    """The rows of the partitions that hold a row that meets the condition."""
    met = df.where(condition).select(*[F.col(c).alias(f"_m_{c}") for c in by]).distinct()
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_m_{c}"))
    return df.join(met, same, "left_semi")


def _rewrite(df: DataFrame, path: str, by: tuple[str, ...]) -> None:
    out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(*by).parquet(path)


def update_files(spark: SparkSession, path: str, values: dict[str, Column], condition: Column, by: tuple[str, ...]) -> None:
    """Updates the Parquet folder ``path``, which is partitioned by the columns ``by``.

    Only partitions with a row that meets the condition are written again; the files of the others stay as they are.
    """
    if moved := set(values) & set(by):
        raise ValueError(f"rows can't be moved between partitions: {sorted(moved)}")
    df = spark.read.parquet(path)
    _rewrite(update(_touched(df, condition, by), values, condition), path, by)


def delete_files(spark: SparkSession, path: str, condition: Column, by: tuple[str, ...]) -> None:
    """Deletes rows of a Parquet folder in the same way; the folders of partitions that keep no row go."""
    df = spark.read.parquet(path)
    here = _touched(df.withColumn("_folder", F.regexp_replace("_metadata.file_path", "/[^/]*$", "")), condition, by)
    kept = F.count_if(~F.coalesce(condition, F.lit(False))).alias("kept")
    emptied = [r["_folder"] for r in here.groupBy("_folder").agg(kept).where("kept = 0").collect()]  # folders without a row
    _rewrite(delete(_touched(df, condition, by), condition), path, by)
    for folder in emptied:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(folder))
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
