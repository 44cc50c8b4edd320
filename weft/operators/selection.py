"""Exact quantiles of groups of any size in bounded memory, by counting in ranges that are refined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft import checkpoints

#: Values of a group that one task may hold; larger groups are counted.
HELD = 100_000
#: Values of a range that part it in a round.
PIVOTS = 33


def quantiles(rows: DataFrame, value: str, fractions: tuple[float, ...], *by: str) -> DataFrame:
    """(*by, q): the quantiles of each group, exact with linear interpolation; null values don't count, NaN is the greatest.

    Groups of up to ``HELD`` values are sorted in a task.  For larger ones ``order_statistics`` finds the values at the
    ranks around each quantile, so no task holds a group whatever its size.
    """
    rows = rows.select(*by, F.col(value).cast("double").alias("_v"))
    sizes = rows.groupBy(*by).agg(F.count("_v").alias("_n"))
    direct = lambda d: d.groupBy(*by).agg(F.percentile("_v", F.array(*map(F.lit, fractions))).alias("q"))
    large = sizes.where(F.col("_n") > HELD)
    if large.isEmpty():
        return direct(rows)
    at = F.array(*[F.lit(f) * (F.col("_n") - 1) for f in fractions])
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda x: F.array(F.floor(x), F.ceil(x)))))
    found = order_statistics(rows.join(large.select(*by), list(by), "left_semi"), large.select(*by, F.explode(ranks).alias("rank")), "_v", *by)
    values = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_of"))  # two for each fraction

    def between(x: Column) -> Column:
        low, high, part = F.element_at("_of", F.floor(x)), F.element_at("_of", F.ceil(x)), x - F.floor(x)
        return F.when(part == 0, low).otherwise(low * (1 - part) + high * part)

    out = values.join(large, list(by)).select(*by, F.transform(at, between).alias("q"))
    return direct(rows.join(large.select(*by), list(by), "left_anti")).unionByName(out)


def order_statistics(rows: DataFrame, ranks: DataFrame, value: str, *by: str) -> DataFrame:
    """(*by, rank, value): for each asked (*by, rank), from 0, the value at that place of the group's order.

    A rank lies in a known range of values.  Each round takes pivots of the range, near its quantiles, from a sketch, counts
    the values at and between them exactly, and goes on with the part that holds the rank, whatever the values'
    distribution and ties: a part at a pivot is one value, one between two holds a small share of the range's.  What is
    left is sorted once it is no more than ``HELD`` values.
    """
    checkpoints.ensure(rows.sparkSession)
    rows = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").checkpoint()
    ends = rows.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    open_ = ranks.select(*by, "rank").distinct().join(ends, list(by)).withColumn("_below", F.lit(0).cast("long")).checkpoint()
    single, key = F.col("_low").eqNullSafe(F.col("_high")), [*by, "rank"]

    def within(asked: DataFrame) -> DataFrame:
        """The rows in the ranges of ``asked``, a few of which a group has."""
        a = asked.groupBy(*by).agg(F.collect_list(F.struct("rank", "_low", "_high", "_below")).alias("_asked"))
        met = rows.join(a, list(by)).select(*by, "_v", F.explode("_asked").alias("a")).where(F.col("_v").between(F.col("a._low"), F.col("a._high")))
        return met.select(*by, F.col("a.rank").alias("rank"), F.col("a._below").alias("_below"), "_v")

    done = []
    while True:
        done.append(open_.where(single).select(*key, F.col("_low").alias("value")))
        few = open_.where(~single & (F.col("_n") <= HELD))
        ordered = within(few).groupBy(*key, "_below").agg(F.array_sort(F.collect_list("_v")).alias("_values"))
        done.append(ordered.select(*key, F.get("_values", (F.col("rank") - F.col("_below")).cast("int")).alias("value")))
        open_ = open_.where(~single & (F.col("_n") > HELD))
        if open_.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out
        met = within(open_)
        grid = F.array(*[F.lit(k / (PIVOTS - 1)) for k in range(PIVOTS)])
        pivots = met.where(~F.isnan("_v")).groupBy(*key).agg(F.percentile_approx("_v", grid, F.lit(1000)).alias("_pivots"))
        met = met.join(pivots, key)
        part = 2 * F.size(F.filter("_pivots", lambda p: p < F.col("_v"))) + F.array_contains("_pivots", F.col("_v")).cast("int")
        parts = met.groupBy(*key, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        parts = parts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*key).orderBy("_part")))  # at most 2 * PIVOTS + 1 rows
        d = open_.select(*key, "_below").join(parts, key)
        before = F.col("_below") + F.col("_upto") - F.col("_n")
        here = (F.col("rank") >= before) & (F.col("rank") < F.col("_below") + F.col("_upto"))
        open_ = d.where(here).select(*key, "_low", "_high", "_n", before.alias("_below")).checkpoint()
