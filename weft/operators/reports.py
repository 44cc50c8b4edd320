"""Reports over models, run logs and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.metrics import pearson
from weft.operators.selection import quantiles
from weft.plans.row_index import ordered_index

#: Greater than any generation in a log.
NO_GENERATION = 100_000_000


def motif_document_frequency(status: DataFrame, more_than: int = 5, file: str = "file") -> DataFrame:
    """(pattern, frequency): in how many files a used pattern occurs, if more than ``more_than``."""
    g = status.where(F.col("status") != 0).groupBy("pattern").agg(F.count_distinct(file).alias("frequency"))
    return g.where(F.col("frequency") > more_than).orderBy(F.desc("frequency"), "pattern")


def motif_count_histogram(status: DataFrame) -> DataFrame:
    """(times, motifs): how many used patterns occur so many times, duplicates counted."""
    g = status.where(F.col("status") != 0).groupBy("pattern").agg(F.count("*").alias("times"))
    return g.groupBy("times").agg(F.count("*").alias("motifs"))


def quartile_band(evo: DataFrame, generations: int | None = None) -> DataFrame:
    """(generation, q25, median, q75) of best_fitness over runs, exact with linear interpolation."""
    e = evo if generations is None else evo.where(F.col("generation") < generations)
    q = quantiles(e, "best_fitness", (0.25, 0.5, 0.75), "generation")
    return q.select("generation", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def complete_runs(evo: DataFrame, generations: int, complete: bool = True) -> DataFrame:
    """Rows of runs with at least so many generations; with ``complete=False`` the rejected runs and their lengths."""
    n = evo.groupBy("run").agg(F.count("*").alias("n"))
    if complete:
        return evo.join(n.where(F.col("n") >= generations).select("run"), "run", "left_semi")
    return n.where(F.col("n") < generations)


def median_surface(evo: DataFrame, generations: int | None = None, first_runs: int | None = None) -> DataFrame:
    """(epoch, generation, median) over runs: complete runs of so many generations, or each epoch's first runs by name."""
    if generations is not None:
        evo = complete_runs(evo, generations)
    if first_runs is not None:
        runs = evo.select("epoch", "run").distinct()  # a row for each run
        runs = runs.withColumn("r", F.row_number().over(Window.partitionBy("epoch").orderBy("run")))
        evo = evo.join(runs.where(F.col("r") <= first_runs).select("epoch", "run"), ["epoch", "run"], "left_semi")
    return quantiles(evo, "best_fitness", (0.5,), "epoch", "generation").select("epoch", "generation", F.col("q")[0].alias("median"))


def polygon(points: DataFrame, by: str = "run") -> DataFrame:
    """(by, x, y, part): each curve closed by a point on the axis before its first and after its last x."""
    ends = points.groupBy(by).agg(F.min("x").alias("x0"), F.max("x").alias("xn"))
    first = ends.select(by, F.col("x0").alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("part"))
    last = ends.select(by, F.col("xn").alias("x"), F.lit(0.0).alias("y"), F.lit(2).alias("part"))
    return first.unionByName(points.select(by, "x", F.col("y").cast("double").alias("y"), F.lit(1).alias("part"))).unionByName(last)


def best_at_generation(evo: DataFrame, generation: int, direction: str = "max") -> DataFrame:
    """(best_run, best_fitness) at a generation; the first of equal runs. The original picks the maximum of a minimised value."""
    if direction not in ("max", "min"):
        raise ValueError(f"direction must be max or min, not {direction!r}")
    sign = -1 if direction == "max" else 1
    at = evo.where(F.col("generation") == generation)
    first = F.min_by(F.struct("run", "best_fitness"), F.struct(sign * F.col("best_fitness"), "run"))
    return at.agg(first.alias("b")).select(F.col("b.run").alias("best_run"), F.col("b.best_fitness").alias("best_fitness"))


def ranks(predictions: DataFrame, by: str = "model_id", actual_rank: str = "row") -> DataFrame:
    """Predictions (row_idx, score, fitness) with predicted_rank, actual_rank and rank_error.

    The actual rank is the row's place in the data set plus 1, or with ``fitness`` its rank by fitness.
    """
    if actual_rank not in ("row", "fitness"):
        raise ValueError(f"actual_rank must be row or fitness, not {actual_rank!r}")
    d = ordered_index(predictions, F.desc("score"), "row_idx", by=(by,), name="predicted_rank")
    if actual_rank == "fitness":
        d = ordered_index(d, F.desc("fitness"), "row_idx", by=(by,), name="actual_rank")
    actual = F.col("row_idx" if actual_rank == "row" else "actual_rank") + 1
    d = d.withColumn("predicted_rank", F.col("predicted_rank") + 1).withColumn("actual_rank", actual.cast("long"))
    return d.withColumn("rank_error", F.abs(F.col("predicted_rank") - F.col("actual_rank")))


def rank_agreement(predictions: DataFrame, top: int = 10, **options) -> DataFrame:
    """(model_id, in_top, mean_error, rank_correlation)."""
    both = (F.col("predicted_rank") <= top) & (F.col("actual_rank") <= top)
    return ranks(predictions, **options).groupBy("model_id").agg(
        F.sum(both.cast("long")).alias("in_top"),
        F.avg("rank_error").alias("mean_error"),
        pearson("predicted_rank", "actual_rank").alias("rank_correlation"),
    )


#: Lines of a file that one task orders at a time.
BLOCK = 65_536


def _blocks(lines: DataFrame, block: int) -> tuple[DataFrame, Window]:
    """The lines with their block of consecutive numbers, and a window over a block: a file is read by many tasks."""
    return lines.withColumn("_block", F.floor(F.col("line_no") / block)), Window.partitionBy("file", "_block").orderBy("line_no")


def adjacent_distinct(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, line_no, line): stripped lines that differ from the one before; leading blank lines vanish.

    Lines are compared within blocks; a block's first line is compared with the last one of the block before it, which
    comes from a summary with a row for each block.
    """
    d, per = _blocks(lines.withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))), block)
    last = d.groupBy("file", "_block").agg(F.max_by("line", "line_no").alias("_last"))
    carried = last.select("file", "_block", F.lag("_last", 1, "").over(Window.partitionBy("file").orderBy("_block")).alias("_carried"))
    d = d.withColumn("_before", F.lag("line").over(per)).withColumn("_first", F.row_number().over(per) == 1)
    d = d.join(carried, ["file", "_block"])
    before = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))
    return d.where(F.col("line") != before).select(*lines.columns)


def repair_log(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """Lines (file, line_no, generation, ...) without those of an attempt that a restart did again.

    Read backwards, a line stays if its generation is below all that stayed, until 0.  The least generation of the lines
    after it is that of its block's, or of a later block's, of which a summary has a row each.
    """
    d, _ = _blocks(lines, block)
    per = Window.partitionBy("file", "_block").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    least = d.groupBy("file", "_block").agg(F.min("generation").alias("_of_block"))
    later = Window.partitionBy("file").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = least.select("file", "_block", F.coalesce(F.min("_of_block").over(later), F.lit(NO_GENERATION)).alias("_carried"))
    here = F.coalesce(F.min("generation").over(per), F.lit(NO_GENERATION))
    d = d.withColumn("_here", here).join(carried, ["file", "_block"])
    return d.where(F.col("generation") < F.least("_here", "_carried")).select(*lines.columns)


LOG_FIELDS = ("best_fitness", "best_test", "best_rule_count", "best_used_rule_count", "avg_fitness", "avg_test", "avg_rule_count", "avg_used_rule_count")
LOG_PATTERN = r"^(\d+): -b (\S+) -bt (\S+) -rc (\S+) -urc (\S+) \|\|\| -a (\S+) -at (\S+) -arc (\S+) -aurc (\S+)"


def format_log(summary: DataFrame) -> DataFrame:
    """(line) of generation summaries, in the form of a run's output."""
    c = [F.col(x).cast("string") for x in ("generation", *LOG_FIELDS)]
    parts = []
    for text, col in zip(("", ": -b ", " -bt ", " -rc ", " -urc ", " ||| -a ", " -at ", " -arc ", " -aurc "), c, strict=True):
        parts += [F.lit(text), col]
    return summary.select(*[x for x in summary.columns if x in ("file", "line_no")], F.concat(*parts).alias("line"))


def parse_log(lines: DataFrame) -> DataFrame:
    """Lines of a run's output as (generation, *LOG_FIELDS); other lines are left out."""
    got = [F.regexp_extract("line", LOG_PATTERN, i + 2).cast("double").alias(f) for i, f in enumerate(LOG_FIELDS)]
    kept = [c for c in lines.columns if c != "line"]
    return lines.where(F.col("line").rlike(LOG_PATTERN)).select(
        *kept, F.regexp_extract("line", LOG_PATTERN, 1).cast("int").alias("generation"), *got
    )
