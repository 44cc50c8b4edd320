"""Sources and sinks: learn sets, rule models, run logs, text, result tables, configurations.

Schemas are explicit; file order is by name; the place of a row in its file is
kept as a column, since tables have no order.
"""

from __future__ import annotations

import fnmatch
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOM = "\ufeff"
LOG_COLUMNS = (
    "generation int, best_fitness double, best_test double, best_rule_count int, best_used_rule_count int, "
    "avg_fitness double, avg_test double, avg_rule_count double, avg_used_rule_count double"
)


def lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, line_no, line) from 0, without a byte-order mark or line ends."""
    return _lines(spark, path, glob).drop("_path")


def _lines(spark: SparkSession, path: str, glob: str | None = None, blank: bool = True) -> DataFrame:
    """(_path, file, line_no, line); ``blank=False`` leaves out blank lines.

    A line's number is its place in its split after the lines of the file's splits before it, so a large file is read
    by many tasks.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    t = reader.text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value",
    )
    if not blank:
        t = t.where(F.trim(F.regexp_replace("value", f"^{BOM}", "")) != "")
    split = ["_path", "_block"]
    sizes = t.groupBy(*split).agg(F.count("*").alias("_n"))  # a row for each split
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*split, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    t = t.withColumn("_at", F.row_number().over(Window.partitionBy(*split).orderBy("_at")) - 1).join(starts, split)
    n = (F.col("_start") + F.col("_at")).cast("int")
    return t.select("_path", "file", n.alias("line_no"), F.when(n == 0, F.regexp_replace("value", f"^{BOM}", "")).otherwise(F.col("value")).alias("line"))


#: A cell with the comma before it: quoted, with commas and doubled quotes in it, or plain.  The quantifiers give nothing
#: back, so a cell is matched without recursion however long it is.
CELL = r',(\s*+"[^"]*+(?:""[^"]*+)*+"\s*+(?=,|$)|[^,]*+)'


def _cells(line: str | Column) -> Column:
    """Cells between commas; a quoted cell may hold commas and doubled quotes."""
    line = F.col(line) if isinstance(line, str) else line
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))
    bare = lambda c: F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.transform(parts, lambda c: F.when(
        bare(c).startswith('"') & bare(c).endswith('"') & (F.length(bare(c)) > 1),
        F.regexp_replace(F.substring(bare(c), F.lit(2), F.length(bare(c)) - 2), '""', '"'),
    ).otherwise(c))


def _fields(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """(_path, file, row_idx, c): the cells of data lines; the first line is a header (row -1), blank lines don't count."""
    t = _lines(spark, path, glob, blank=False)
    return t.select("_path", "file", (F.col("line_no") - 1).alias("row_idx"), _cells("line").alias("c"))


def _number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def learn_set(spark: SparkSession, path: str, glob: str | None = "*.csv") -> DataFrame:
    """(dataset, row_idx, sequence, fitness) by position; a malformed fitness is null, its row stays."""
    f = _fields(spark, path, glob).where("row_idx >= 0")
    name = F.substring_index("file", ".", 1)
    return f.select(name.alias("dataset"), "row_idx", F.trim(F.get("c", F.lit(0))).alias("sequence"), _number(F.get("c", F.lit(1))).alias("fitness"))


def malformed(learn: DataFrame) -> DataFrame:
    """Rows of a learn set without a usable fitness."""
    return learn.where(F.col("fitness").isNull())


def models(spark: SparkSession, path: str, glob: str | None = "*.csv", drop_last: bool = True, na_is_null: bool = True) -> DataFrame:
    """(file, model_id, rule_idx, pattern, weight, status) of files whose header names pattern, weight and maybe status.

    ``drop_last`` leaves out each file's last rule, as the original loader does; ``na_is_null`` reads the
    pattern NA as missing.  Without a status column all statuses are 0; a file without a pattern or weight column has
    rules without one.
    """
    f = _fields(spark, path, glob)
    heads = f.where("row_idx = -1").select("_path", F.transform("c", lambda c: F.trim(c)).alias("_names"))  # a row for each file
    if drop_last:
        heads = heads.join(f.groupBy("_path").agg((F.count("*") - 2).alias("_last")), "_path")
    f = f.where("row_idx >= 0").join(heads, "_path")
    if drop_last:
        f = f.where("row_idx < _last")

    def cell(name: str) -> Column:
        at = F.array_position("_names", name).cast("int")
        return F.when(at > 0, F.trim(F.get("c", at - 1)))

    pattern = cell("pattern")
    missing = (pattern == "") | ((pattern == "NA") if na_is_null else F.lit(False))
    status = F.coalesce(cell("status").try_cast("int"), F.lit(0))
    return f.select(
        "file", F.substring_index("file", ".", 1).alias("model_id"), F.col("row_idx").alias("rule_idx"),
        F.when(~missing, pattern).alias("pattern"), cell("weight").try_cast("double").alias("weight"), status.alias("status"),
    )


def evolution_log(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, generation, ...): rows have nine values under eight names, so they are read by position."""
    f = _fields(spark, path, glob).where("row_idx >= 0")
    cols = []
    for i, spec in enumerate(LOG_COLUMNS.split(", ")):
        name, kind = spec.split()
        cols.append(_number(F.get("c", F.lit(i))).cast(kind).alias(name))
    return f.select("file", *cols)


def pairs(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(key, code) of a dimension table: alphabet, codons, hydropathy."""
    f = _fields(spark, path, None).where("row_idx >= 0")
    code = F.trim(F.get("c", F.lit(1)))
    return f.select(F.trim(F.get("c", F.lit(0))).alias("key"), (code if value == "string" else code.try_cast(value)).alias("code"))


def files(spark: SparkSession, path: str, glob: str | None = None) -> list[str]:
    """Names of the files in a folder and those below, sorted, as its file system lists them; a folder of models or logs has
    few.  Names that Spark hides aren't listed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, names = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        names.append(found.next().getPath().getName())
    return sorted(n for n in names if n[0] not in "_." and (glob is None or fnmatch.fnmatchcase(n, glob)))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def put(df: DataFrame, path: str, *keys: str) -> None:
    """Rows of ``keys`` into a CSV folder, each key's in a folder of its own (``of_<key>=``): writing them again, as after a
    retry, replaces them and nothing else.  A row for each key is expected, so few rows."""
    marked = df.select("*", *[F.col(k).alias(f"of_{k}") for k in keys]).coalesce(1)
    out = marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True)
    out.partitionBy(*[f"of_{k}" for k in keys]).csv(path)


def overwrite(df: DataFrame, path: str, single: bool = False, by: tuple[str, ...] = ()) -> None:
    """``single``: in one file, for each value of ``by`` if there is any, whose columns name the folders."""
    out = (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True)
    (out.partitionBy(*by) if by else out).csv(path)


def truncate(spark: SparkSession, path: str, schema: str) -> None:
    overwrite(spark.createDataFrame([], schema), path)


def result_table(wide: DataFrame, path: str) -> None:
    """The sink of a model x data set table: files whose rows, in the order of their names, are in data set order."""
    overwrite(wide.orderBy("row_idx").drop("row_idx"), path)


def setup(folder: str) -> dict[str, str]:
    """Output folders of a run, on the driver."""
    out = {n: f"{folder}/{n}" for n in ("output", "archive")}
    for p in out.values():
        Path(p).mkdir(parents=True, exist_ok=True)
    return out


def parse_config(text: str) -> dict[str, str]:
    """key = value lines; # starts a comment anywhere; the first = splits; a line without one raises with its number."""
    found = {}
    for n, line in enumerate(text.splitlines(), 1):
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        if "=" not in line:
            raise ValueError(f"line {n}: no '=' in {line!r}")
        key, value = line.split("=", 1)
        found[key.strip()] = value.strip()
    return found


def options(argv: list[str], config: dict[str, str]) -> dict[str, str]:
    """Configuration with the flags -seed, -r, -o, -mo and -learn laid over it."""
    names = {"-seed": "seed", "-r": "runs", "-o": "output_evo", "-mo": "output_model", "-learn": "learn_data"}
    out = dict(config)
    for flag, value in zip(argv, argv[1:], strict=False):
        if re.fullmatch(r"-[a-z]+", flag) and flag in names:
            out[names[flag]] = value
    return out
