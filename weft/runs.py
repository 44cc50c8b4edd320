"""Whole runs from files to files: measuring, comparing and evolving models, searching sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import evolve, metrics, ordering, scoring, search
from weft.sources import files


def _inputs(spark: SparkSession, models: str, learn: str) -> tuple[DataFrame, DataFrame]:
    """Sequences (seq_id, row_idx, sequence, fitness) of a learn set and rules of a folder of model files."""
    s = files.learn_set(spark, learn, None).withColumn("seq_id", F.col("row_idx"))
    return s.select("seq_id", "row_idx", "sequence", "fitness"), files.models(spark, models)


def measure_dataset(spark: SparkSession, models: str, learn: str, out: str, metric: str = "RMSE") -> DataFrame:
    """The table of every model of a folder on every row of a learn set, written as CSV to ``out``.

    Its columns are named by the model files, of which a folder has few; rows without a fitness are kept.
    """
    s, r = _inputs(spark, models, learn)
    names = sorted(x["model_id"] for x in r.select("model_id").distinct().collect())
    p = metrics.calibrated(scoring.predictions(s, r, carry=("row_idx", "sequence")), metric)
    wide = metrics.wide_table(p, names)
    files.result_table(wide, out)
    return wide


def compare_models(spark: SparkSession, models: str, learn: str, metric: str = "RMSE") -> DataFrame:
    """(best_model, best_value, average) by the metric's training value; the first of equal names wins."""
    m = metrics.measure(scoring.predictions(*_inputs(spark, models, learn)), metric)
    return metrics.compare(m.select("model_id", F.col("train").alias("value")))


def predict(
    spark: SparkSession, models: str, learn: str, count: int = 10, size: int = 12, iterations: int = 10, seed: int = 1, pool: int = 10_000
) -> DataFrame:
    """The ``count`` best (cand_id, sequence, fitness) of a hill climb over random sequences, scored by all models of a folder."""
    s, r = _inputs(spark, models, learn)
    return ordering.top_candidates(search.climb(search.candidates(spark, pool, size, seed), r, s, iterations, seed), count)


#: The names that run options have in a configuration, with their kinds.
CONFIG = {
    "population_size": ("size", int), "maximum_rule_size": ("rule_size", int), "maximum_rule_count": ("max_rules", int),
    "rule_weight_min": ("low", float), "rule_weight_max": ("high", float), "tournament_size": ("tournament", int),
    "crossover_unused_selection_chance": ("keep_unused", float), "fitness_alg": ("metric", str),
}
RATES = {"mut_add_rule": "add", "mut_remove_rule": "remove", "mut_change_weight": "weight", "mut_add_to_pattern": "insert", "mut_remove_from_pattern": "delete"}


def options(config: dict[str, str]) -> dict:
    """The options of ``train`` that a configuration sets; mutations that it doesn't name have a chance of 0.1."""
    found = {name: kind(config[key]) for key, (name, kind) in CONFIG.items() if key in config}
    if any(k in config for k in RATES):
        found["rates"] = {name: float(config.get(key, 0.1)) for key, name in RATES.items()}
    if config.get("diversity_selection", "False").strip().lower() in ("true", "yes", "1"):
        found["diversity"] = float(config.get("diversity_weight", 0.01))
    return found


def train(
    spark: SparkSession, learn: str, out: str, generations: int, size: int = 100, seed: int = 1, max_rules: int = 100,
    rule_size: int = 6, low: float = -10.0, high: float = 10.0, metric: str = "RMSE", repeats: int = 1, **options,
) -> DataFrame:
    """Evolves models on a learn set: the last population (seed, ind, fitness, rules), with the log of all generations in
    ``out``/log and the best model in ``out``/model/seed=..., both CSV.

    ``repeats`` independent runs, with ``seed`` and the next ones as seeds, are one program.  A second call with the same
    arguments goes on where the first ended: ``out``/state holds the committed generations.
    """
    s = files.learn_set(spark, learn, None).withColumn("seq_id", F.col("row_idx")).where("fitness IS NOT NULL")
    return evolve.replicate_runs(
        spark, s, list(range(seed, seed + repeats)), generations, size, metric, max_rules, rule_size, low, high,
        log=f"{out}/log", model=f"{out}/model", state=f"{out}/state", **options,
    )
