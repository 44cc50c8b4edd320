"""Logs repaired while they grow, against the batch repair of the whole log."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import reports
from weft.streaming import live_log

LINE = "{}: -b {} -bt 1.0 -rc 3 -urc 2 ||| -a 1.0 -at 1.0 -arc 3.0 -aurc 2.0"


def by_rule(generations):
    kept = []
    for g in generations:
        while kept and kept[-1][0] >= g[0]:
            kept.pop()
        kept.append(g)
    return kept


@pytest.fixture(scope="module")
def logs():
    """Lines of runs that are started again at a generation they had reached, or from 0, even several times in a row."""
    rng, out = random.Random(5), {}
    for run in ("steady", "once", "often", "twice_at_0"):
        g, lines = 0, []
        for k in range(40):
            lines.append((g, float(k)))
            again = run == "often" and rng.random() < 0.3 or run == "once" and k == 20
            g = rng.randint(0, g) if again else 0 if run == "twice_at_0" and k in (10, 11) else g + 1
        out[run] = lines
    return out


def test_stream_ends_equal_to_the_batch_report(spark, tmp_path, logs):
    folder, path, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    cuts = (0, 1, 13, 13, 25, 40)
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        for run, lines in logs.items():
            text = "\n".join(["noise", *(LINE.format(*x) for x in lines[a:b]), ""])
            (tmp_path / "in" / f"{run}.{n:03d}").write_text(text)
        # each start goes on from the checkpoint, as after a failure
        live_log.record(live_log.attempts(live_log.pieces(spark, folder), "piece", "at"), path, cp, now=True).awaitTermination()
        got = live_log.repaired(spark.read.parquet(path)).collect()
        for run, lines in logs.items():
            mine = sorted((r.generation, r.best_fitness) for r in got if r.run == run)
            assert mine == by_rule(lines[:b]), (run, b)
    whole = [(run, k, *x) for run, lines in logs.items() for k, x in enumerate(lines)]
    batch = reports.repair_log(spark.createDataFrame(whole, "file string, line_no int, generation int, best_fitness double"))
    assert {(r.file, r.generation, r.best_fitness) for r in batch.collect()} == {(r.run, r.generation, r.best_fitness) for r in got}
    live_log.record(live_log.attempts(live_log.pieces(spark, folder), "piece", "at"), path, cp, now=True).awaitTermination()
    assert spark.read.parquet(path).count() == len(whole)  # nothing is recorded twice


def test_edges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "empty.0").write_text("")
    (tmp_path / "in" / "noise.0").write_text("no log\n\n")
    (tmp_path / "in" / "bare").write_text(LINE.format(3, 1.0))  # no line end, no piece, not from 0
    path = str(tmp_path / "out")
    numbered = live_log.attempts(live_log.pieces(spark, str(tmp_path / "in")), "piece", "at")
    live_log.record(numbered, path, str(tmp_path / "cp"), now=True).awaitTermination()
    assert [(r.run, r.generation, r.attempt) for r in live_log.repaired(spark.read.parquet(path)).collect()] == [("bare", 3, 0)]
    same = spark.createDataFrame([("r", 0, 5), ("r", 1, 5), ("r", 2, 5)], "run string, attempt int, generation int")
    assert [r.attempt for r in live_log.repaired(same).collect()] == [2]
    assert live_log.repaired(same.where(F.lit(False))).collect() == []


def test_many_runs_share_few_state_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live_log, "GROUPS", 3)
    rng = random.Random(8)
    whole = [(None if run == 39 else 2**60 + run, k, rng.randint(0, 9)) for run in range(40) for k in range(rng.randint(1, 9))]
    log = spark.createDataFrame(whole, "run long, at int, generation int")
    for piece in range(2):
        log.where(F.col("at") % 9 < 4 if piece == 0 else F.col("at") % 9 >= 4).write.mode("append").parquet(str(tmp_path / "in"))
        arriving = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
        q = live_log.record(live_log.attempts(arriving, "at"), str(tmp_path / "out"), str(tmp_path / "cp"), now=True)
        q.awaitTermination()
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == len(whole)
    kept = sorted((r.run or 0, r.generation) for r in live_log.repaired(got.where("run IS NOT NULL")).collect())
    runs = {run for run, _, _ in whole if run}
    assert kept == sorted((run, g[0]) for run in runs for g in by_rule([(g,) for r, _, g in whole if r == run]))
