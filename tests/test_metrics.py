import math

import pytest
from pyspark.sql import functions as F

from weft.operators import metrics, reports


@pytest.fixture(scope="module")
def preds(spark):
    rows = []
    for m in range(3):
        for k in range(23):
            fitness = (k * 7 % 11) / 2
            rows.append((m, k, f"S{k}", 4.0 if m == 2 else fitness * (m + 1) + (k % 3), fitness))
    rows += [(5, k, f"S{k}", 1.0, 2.0) for k in range(6)]
    return spark.createDataFrame(rows, "model_id int, row_idx int, sequence string, score double, fitness double"), rows


def pick(rows, m):
    return [(r[3], r[4]) for r in rows if r[0] == m]


def test_rmse(preds):
    df, rows = preds
    got = {r.model_id: r for r in metrics.rmse_cv10(df).collect()}
    for m in range(3):
        p = pick(rows, m)
        sse, n, t = sum((a - b) ** 2 for a, b in p), len(p), len(p) // 10
        assert got[m].train == pytest.approx(math.sqrt(9 * sse / (10 * (n - t))))
        assert got[m].test == pytest.approx(math.sqrt(sse / (10 * t)))
    assert got[5].train is None and got[5].test is None  # fewer than ten rows
    plain = {r.model_id: r.rmse for r in metrics.rmse_plain(df).collect()}
    assert plain[5] == pytest.approx(1.0)


def test_chunks(preds):
    df, rows = preds
    got = metrics.rmse_chunks(df).where("model_id = 0").collect()
    assert sorted(r.chunk for r in got) == list(range(10)) and sum(r.n for r in got) == 23
    assert {r.chunk: r.n for r in got}[0] == sum(min(9, int(k / 2.3)) == 0 for k in range(23))


def test_correlation_and_calibration(preds):
    df, rows = preds
    r2 = {r.model_id: r for r in metrics.correlation_fitness(df).collect()}
    assert r2[2].fitness_value == 1.0 and r2[2].test_value == 0.0  # constant predictions
    import numpy as np

    x, y = map(np.array, zip(*pick(rows, 1)))
    assert r2[1].fitness_value == pytest.approx(1 - np.corrcoef(x, y)[0, 1] ** 2)
    fit = {r.model_id: r for r in metrics.calibration(df).collect()}
    slope, icpt = np.polyfit(x, y, 1)
    assert (fit[1].slope, fit[1].intercept) == pytest.approx((slope, icpt))
    assert (fit[2].slope, fit[2].intercept) == pytest.approx((0.0, np.mean([b for _, b in pick(rows, 2)])))


def test_dispatch(preds):
    df, _ = preds
    assert metrics.measure(df, "RMSE").columns == metrics.measure(df, "correlation").columns == ["model_id", "train", "test"]
    for bad in (metrics.measure, metrics.calibrated):
        with pytest.raises(ValueError):
            bad(df, "other")


def test_wide_table(preds):
    df, rows = preds
    wide = metrics.wide_table(metrics.calibrated(df.where("model_id < 3"), "RMSE"), [0, 1, 2], ["a", "b", "c"])
    assert wide.columns == ["row_idx", "sequence", "fitness", "a Prediction", "b Prediction", "c Prediction"]
    assert wide.count() == 23


def test_compare_first_wins(spark):
    m = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0)], "model_id string, value double")
    r = metrics.compare(m).first()
    assert (r.best_model, r.best_value, r.average) == ("b", 1.0, pytest.approx(4 / 3))


def test_generation_summary(spark):
    rows = [(1, 0, 0, 5.0, 1.0, 10, 4), (1, 0, 1, 3.0, 2.0, 11, 5), (1, 0, 2, 3.0, 9.0, 12, 6)]
    d = spark.createDataFrame(rows, "run int, generation int, ind_idx int, fitness double, test double, rule_count int, used_rule_count int")
    r = metrics.generation_summary(d).first()
    assert (r.best_fitness, r.best_test, r.best_rule_count, r.best_used_rule_count) == (3.0, 2.0, 11, 5)
    assert (r.avg_fitness, r.avg_test, r.avg_rule_count) == (3.667, 4.0, 11)


def test_footer(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "fitness double, prediction double")
    r = metrics.footer(d).first()
    assert (r.n, r.mae, r.pearson) == (3, 2.0, pytest.approx(1.0))


def test_reports(spark):
    evo = spark.createDataFrame([(r, g, float(r * g)) for r in range(4) for g in range(5 - r)], "run int, generation int, best_fitness double")
    assert reports.complete_runs(evo, 4).select("run").distinct().count() == 2
    assert {(r.run, r.n) for r in reports.complete_runs(evo, 4, complete=False).collect()} == {(2, 3), (3, 2)}
    q = reports.quartile_band(evo).where("generation = 1").first()
    assert (q.q25, q.median, q.q75) == (0.75, 1.5, 2.25)
    assert reports.best_at_generation(evo, 1).first().best_run == 3
    assert reports.best_at_generation(evo, 1, "min").first().best_run == 0
    with pytest.raises(ValueError):
        reports.best_at_generation(evo, 1, "up")
    p = reports.polygon(evo.select("run", F.col("generation").alias("x"), F.col("best_fitness").alias("y")))
    assert p.count() == evo.count() + 8
    surface = reports.median_surface(evo.withColumn("epoch", F.lit(0)), first_runs=2)
    assert surface.where("generation = 1").first().median == 0.5


def test_motifs(spark):
    rows = [(f, p, s) for f in range(8) for p, s in (("AC", 1), ("AC", 1), ("D", int(f < 5)), ("E", 0))]
    d = spark.createDataFrame(rows, "file int, pattern string, status int")
    assert [tuple(r) for r in reports.motif_document_frequency(d).collect()] == [("AC", 8)]
    assert {tuple(r) for r in reports.motif_count_histogram(d).collect()} == {(16, 1), (5, 1)}


def test_ranks(spark):
    rows = [(0, k, float(-k), float(k % 5)) for k in range(12)]
    d = spark.createDataFrame(rows, "model_id int, row_idx int, score double, fitness double")
    a = reports.rank_agreement(d).first()
    assert (a.in_top, a.mean_error, a.rank_correlation) == (10, 0.0, pytest.approx(1.0))
    b = reports.ranks(d, actual_rank="fitness").where("row_idx = 4").first()
    assert b.actual_rank == 1
    with pytest.raises(ValueError):
        reports.ranks(d, actual_rank="x")


def test_lines(spark):
    text = ["", " ", "A", "A ", "A", "B", "", "C", "B"]
    d = spark.createDataFrame([("f", k, t) for k, t in enumerate(text)], "file string, line_no int, line string")
    assert [r.line for r in reports.adjacent_distinct(d).orderBy("line_no").collect()] == ["A", "B", "", "C", "B"]
    gens = [0, 1, 2, 3, 2, 3, 4, 1, 2, 3]
    d = spark.createDataFrame([("f", k, g) for k, g in enumerate(gens)], "file string, line_no int, generation int")
    kept, least = [], reports.NO_GENERATION
    for k in reversed(range(len(gens))):
        if gens[k] < least:
            kept.append(k)
            least = gens[k]
    assert [r.line_no for r in reports.repair_log(d).orderBy("line_no").collect()] == kept[::-1]


def test_log_round_trip(spark):
    names = ("generation", *reports.LOG_FIELDS)
    d = spark.createDataFrame([(k, *[k + i / 4 for i in range(8)]) for k in range(3)], ", ".join([f"{names[0]} int", *[f"{n} double" for n in names[1:]]]))
    back = reports.parse_log(reports.format_log(d).unionByName(spark.createDataFrame([("noise",)], "line string")))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in d.collect()}
