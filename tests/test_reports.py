"""Reports over files and groups of any size: blocked scans and refined counting against the plain forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import reports, selection


def log_lines(n, seed):
    rng = random.Random(seed)
    rows, g = [], 0
    for k in range(n):
        g = rng.randrange(g + 1) if rng.random() < 0.02 else g + 1
        rows.append((k, g, rng.choice(["x ", " x", "y", "", " "])))
    return rows


@pytest.mark.parametrize("block", [1, 7, 100, reports.BLOCK])
def test_blocked_scans(spark, block):
    files = {f"f{k}": log_lines(n, k) for k, n in enumerate((1, 60, 400, 7))}
    d = spark.createDataFrame([(f, *r) for f, rows in files.items() for r in rows], "file string, line_no int, generation int, line string")
    d = d.where("line_no % 11 <> 5").repartition(3)  # numbers need not be without gaps
    kept, distinct = set(), set()
    for f, rows in files.items():
        rows = [r for r in rows if r[0] % 11 != 5]
        least = math.inf
        for no, g, _ in reversed(rows):
            if g < least:
                kept.add((f, no, g))
                least = g
        before = ""
        for no, _, line in rows:
            if line.strip() != before:
                distinct.add((f, no, line.strip()))
            before = line.strip()
    assert {tuple(r) for r in reports.repair_log(d.select("file", "line_no", "generation"), block).collect()} == kept
    assert {tuple(r) for r in reports.adjacent_distinct(d.select("file", "line_no", "line"), block).collect()} == distinct


def test_one_file_of_ten_million_lines(spark):
    n, attempt = 10_000_000, 1_000_000
    d = spark.range(n).select(F.lit("run.out").alias("file"), F.col("id").alias("line_no"), (F.col("id") % attempt).alias("generation"))
    d = d.withColumn("line", F.floor(F.col("line_no") / 4).cast("string"))
    kept = reports.repair_log(d.select("file", "line_no", "generation"))
    assert kept.agg(F.count("*"), F.min("line_no"), F.max("line_no")).first()[:] == (attempt, n - attempt, n - 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert reports.adjacent_distinct(d.select("file", "line_no", "line")).groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("held", [0, 50, 10**6])
def test_quantiles(spark, monkeypatch, held):
    monkeypatch.setattr(selection, "HELD", held)
    rng = random.Random(3)
    groups = {
        0: [rng.gauss(0, 1) for _ in range(301)], 1: [5.0] * 80, 2: [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(200)],
        3: [1.0], 4: [float(k // 40) for k in range(400)], 5: [1.0, math.inf, -math.inf, 2.0, 3.0] * 20, 6: [1.7e308, -1.7e308, 0.5] * 30,
    }
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    d = spark.createDataFrame(rows, "g int, v double").repartition(3)
    fractions = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.g: r.q for r in selection.quantiles(d, "v", fractions, "g").collect()}
    assert sorted(got) == sorted(groups)
    for g in (0, 1, 2, 3, 4):
        assert got[g] == pytest.approx(list(np.quantile(groups[g], fractions)), rel=1e-12)
    assert got[5][:3] == [-math.inf, 1.0, 2.0] and got[5][4] == math.inf
    assert got[6] == [-1.7e308, -1.7e308, 0.5, 1.7e308, 1.7e308]


def test_order_statistics_with_nan(spark):
    d = spark.createDataFrame([(1, v) for v in [math.nan, 2.0, math.inf, 1.0, None]], "g int, v double")
    ranks = spark.createDataFrame([(1, k) for k in range(4)], "g int, rank long")
    got = {r.rank: r.value for r in selection.order_statistics(d, ranks, "v", "g").collect()}
    assert (got[0], got[1], got[2]) == (1.0, 2.0, math.inf) and math.isnan(got[3])
