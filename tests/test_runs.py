"""Whole runs from files to files, and places in a global order."""

import random

import pytest
from pyspark.sql import functions as F
from test_scoring import brute

from weft import checkpoints, runs
from weft.__main__ import main
from weft.plans.row_index import ordered_index
from weft.sources import files


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("runs"), random.Random(3)
    word = lambda n: "".join(rng.choice("ACDE") for _ in range(n))
    learn = [(word(rng.randint(3, 12)), rng.randint(0, 40) / 4) for _ in range(30)]
    (at / "learn.csv").write_text("sequence,fitness\n" + "".join(f"{s},{f}\n" for s, f in learn))
    models = {}
    (at / "models").mkdir()
    for name in ("a", "b"):
        models[name] = [(k, word(rng.randint(1, 3)), rng.randint(-8, 8) / 4) for k in range(9)]
        text = 'weight,"pattern",,status\n' + "".join(f'{w},"{p}",{k},0\n' for k, p, w in models[name])
        (at / "models" / f"{name}.csv").write_text(text)
    return at, learn, {n: r[:-1] for n, r in models.items()}  # the last rule is dropped


def test_measure_and_compare(spark, folders):
    at, learn, models = folders
    wide = runs.measure_dataset(spark, f"{at}/models", f"{at}/learn.csv", f"{at}/table").orderBy("row_idx").collect()
    assert [(r["sequence"], r["fitness"]) for r in wide] == learn
    for name, rules in models.items():
        assert [r[f"{name} Prediction"] for r in wide] == [pytest.approx(round(brute(s, rules)[0], 2)) for s, _ in learn]
    back = spark.read.option("header", True).csv(f"{at}/table")
    assert back.columns == ["sequence", "fitness", "a Prediction", "b Prediction"] and back.count() == len(learn)
    sse = {n: sum((brute(s, r)[0] - f) ** 2 for s, f in learn) for n, r in models.items()}
    value = {n: (9 * x / (10 * (30 - 3))) ** 0.5 for n, x in sse.items()}
    got = runs.compare_models(spark, f"{at}/models", f"{at}/learn.csv").first()
    assert got.best_model == min(value, key=value.get) and got.average == pytest.approx(sum(value.values()) / 2)


def test_command(spark, folders):
    at, learn, _ = folders
    (at / "config.ini").write_text("# a run\nseed = 5\nfitness_alg = correlation\n")
    common = ["-config", f"{at}/config.ini", "-learn", f"{at}/learn.csv", "-out", f"{at}/cli"]
    assert main(["-md", f"{at}/models", *common], spark).count() == len(learn)
    got = main(["-c", f"{at}/models", *common], spark).first()
    assert got.best_model in ("a", "b") and got.best_value <= got.average


def test_predict(spark, folders):
    at, _, _ = folders
    got = runs.predict(spark, f"{at}/models", f"{at}/learn.csv", count=3, size=8, iterations=1, pool=40).collect()
    assert len(got) == 3 and [r.fitness for r in got] == sorted((r.fitness for r in got), reverse=True)


def test_train_writes_log_and_model(spark, folders):
    at, _, _ = folders
    last = runs.train(spark, f"{at}/learn.csv", f"{at}/out", generations=2, size=4, max_rules=9, rule_size=2)
    assert last.count() == 4 and last.columns == ["seed", "ind", "fitness", "rules"]
    log = spark.read.option("header", True).option("inferSchema", True).csv(f"{at}/out/log").orderBy("generation").collect()
    assert [r.generation for r in log] == [0, 1, 2] and all(r.best_used_rule_count <= r.best_rule_count for r in log)
    model = files.models(spark, f"{at}/out/model/seed=1", drop_last=False)
    best = last.orderBy("fitness", "ind").first()
    want = [(r["rule_idx"], r["pattern"], r["weight"], r["status"]) for r in best["rules"]]
    assert [tuple(r) for r in model.orderBy("rule_idx").select("rule_idx", "pattern", "weight", "status").collect()] == want


CONFIGURATION = """
seed = 3
population_size = 5   # few
maximum_rule_size = 2
maximum_rule_count = 6
rule_weight_min = 1.0
rule_weight_max = 2.0
runs = 1
crossover_unused_selection_chance = 1.0
fitness_alg = correlation
tournament_size = 2
diversity_selection = True
diversity_weight = 0.01
mut_add_rule = 0
mut_change_weight = 0
mut_add_to_pattern = 0
"""


def test_configuration_reaches_the_run(spark, folders):
    at, _, _ = folders
    want = runs.options(files.parse_config(CONFIGURATION))
    assert want == {
        "size": 5, "rule_size": 2, "max_rules": 6, "low": 1.0, "high": 2.0, "tournament": 2, "keep_unused": 1.0, "metric": "correlation",
        "diversity": 0.01, "rates": {"add": 0.0, "remove": 0.1, "weight": 0.0, "insert": 0.0, "delete": 0.1},
    }
    (at / "run.ini").write_text(CONFIGURATION)
    end = main(["-config", f"{at}/run.ini", "-learn", f"{at}/learn.csv", "-out", f"{at}/seeds", "-repeats", "2"], spark).collect()
    assert sorted((r.seed, r.ind) for r in end) == [(s, i) for s in (3, 4) for i in range(5)]
    for r in end:
        assert 0 <= r.fitness <= 1 and len(r.rules) <= 6 and all(1 <= x.weight <= 2 and len(x.pattern) <= 2 for x in r.rules)
    log = files.evolution_log(spark, f"{at}/seeds/log")
    assert sorted(r.run for r in spark.read.option("header", True).csv(f"{at}/seeds/log").collect()) == ["3", "3", "4", "4"] and log.count() == 4


def test_ordered_index(spark):
    d = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 5).alias("v")).repartition(7)
    rows = [(r.id, r.g, r.v) for r in d.collect()]
    want = {i: k for k, (i, *_) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert {r.id: r.row_idx for r in ordered_index(d, F.desc("v"), "id").collect()} == want
    got = {r.id: r.place for r in ordered_index(d, F.desc("v"), "id", by=("g",), name="place").collect()}
    for g in range(3):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [got[i] for i, *_ in mine] == list(range(len(mine)))


def test_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        checkpoints.folder(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/"}
    assert checkpoints.folder(Session()) == "hdfs://shared"
