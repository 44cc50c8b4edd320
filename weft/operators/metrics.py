"""Model metrics over predictions (model_id, row_idx, score, fitness).

``row_idx`` is the row's place in its data set, from 0; only the chunk table needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("RMSE", "correlation")


def _sse() -> Column:
    return F.sum(F.pow(F.col("score") - F.col("fitness"), 2))


def rmse_cv10(predictions: DataFrame, by: str = "model_id") -> DataFrame:
    """(model_id, n, train, test): closed form of ten chunks, of which only the totals count.

    With t = n // 10: train = sqrt(9 SSE / (10 (n - t))), test = sqrt(SSE / (10 t)); null where n < 10.
    """
    return cv10(predictions.groupBy(by).agg(F.count("*").alias("n"), _sse().alias("sse")), by)


def cv10(g: DataFrame, by: str = "model_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The same from (model_id, n, sse), and the columns ``keep``."""
    t = F.floor(F.col("n") / 10)
    ok = F.col("n") >= 10
    return g.select(
        by, "n",
        F.when(ok, F.sqrt(9 * F.col("sse") / (10 * (F.col("n") - t)))).alias("train"),
        F.when(ok, F.sqrt(F.try_divide(F.col("sse"), (10 * t).cast("double")))).alias("test"), *keep,
    )


def from_sums(g: DataFrame, metric: str, by: str = "model_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(model_id, train, test, *keep) by the metric's name from ``scoring.model_sums``."""
    if metric == "RMSE":
        return cv10(g, by, keep).select(by, "train", "test", *keep)
    if metric != "correlation":
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    n = F.col("n")
    both = n * F.col("sf") - F.col("s") * F.col("f")
    spread = (n * F.col("ss") - F.pow("s", F.lit(2))) * (n * F.col("ff") - F.pow("f", F.lit(2)))
    flat = (F.col("low") == F.col("high")) | (spread <= 0)
    return g.select(by, F.when(flat, 1.0).otherwise(1 - F.try_divide(both * both, spread)).alias("train"), F.lit(0.0).alias("test"), *keep)


def rmse_chunks(predictions: DataFrame) -> DataFrame:
    """(model_id, chunk, n, sse): chunk = floor(i / (n / 10)), the last one taking the rest."""
    p = predictions.join(predictions.groupBy("model_id").agg(F.count("*").alias("_n")), "model_id")  # a row for each model
    chunk = F.least(F.lit(9), F.floor(F.col("row_idx") / (F.col("_n") / 10))).cast("int")
    return p.withColumn("chunk", chunk).groupBy("model_id", "chunk").agg(F.count("*").alias("n"), _sse().alias("sse"))


def rmse_plain(predictions: DataFrame) -> DataFrame:
    """(model_id, rmse)."""
    return predictions.groupBy("model_id").agg(F.sqrt(F.avg(F.pow(F.col("score") - F.col("fitness"), 2))).alias("rmse"))


def pearson(x: str, y: str) -> Column:
    """Correlation, or null where either side is constant (plain ``corr`` raises there)."""
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(~flat, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def correlation_fitness(predictions: DataFrame) -> DataFrame:
    """(model_id, fitness_value, test_value): 1 - r², 1 where r is undefined; the test value is 0."""
    r = predictions.groupBy("model_id").agg(pearson("score", "fitness").alias("r"))
    return r.select("model_id", F.coalesce(1 - F.col("r") * F.col("r"), F.lit(1.0)).alias("fitness_value"), F.lit(0.0).alias("test_value"))


def measure(predictions: DataFrame, metric: str) -> DataFrame:
    """(model_id, train, test) by the metric's name."""
    if metric == "RMSE":
        return rmse_cv10(predictions).select("model_id", "train", "test")
    if metric == "correlation":
        return correlation_fitness(predictions).toDF("model_id", "train", "test")
    raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")


def calibration(predictions: DataFrame) -> DataFrame:
    """(model_id, slope, intercept) of fitness on score; a constant score gives slope 0 and the mean fitness."""
    flat = F.min("score") == F.max("score")
    g = predictions.groupBy("model_id").agg(
        F.when(flat, 0.0).otherwise(F.regr_slope("fitness", "score")).alias("slope"),
        F.when(flat, F.avg("fitness")).otherwise(F.regr_intercept("fitness", "score")).alias("intercept"),
    )
    return g


def calibrated(predictions: DataFrame, metric: str) -> DataFrame:
    """Predictions with ``prediction``: fitted for correlation, as they are for RMSE."""
    if metric == "RMSE":
        return predictions.withColumn("prediction", F.col("score"))
    if metric != "correlation":
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    fit = F.broadcast(calibration(predictions))  # a row for each model
    return predictions.join(fit, "model_id").withColumn("prediction", F.col("score") * F.col("slope") + F.col("intercept"))


def wide_table(predictions: DataFrame, models: list, names: list[str] | None = None, digits: int = 2) -> DataFrame:
    """(row_idx, sequence, fitness, '<name> Prediction' ...): one column for each of the given models."""
    names = names or [str(m) for m in models]
    p = predictions.groupBy("row_idx", "sequence", "fitness").pivot("model_id", models)
    p = p.agg(F.bround(F.first("prediction"), digits))
    return p.toDF("row_idx", "sequence", "fitness", *[f"{n} Prediction" for n in names])


def compare(measures: DataFrame) -> DataFrame:
    """(best_model, best_value, average) of (model_id, value); the first of equal models wins."""
    first = F.min_by("model_id", F.struct("value", "model_id"))
    return measures.agg(first.alias("best_model"), F.min("value").alias("best_value"), F.avg("value").alias("average"))


def average_used_rule_length(status: DataFrame) -> DataFrame:
    """(model_id, average_length) over used rules with a pattern; null for a model without any."""
    used = F.when((F.col("status") != 0) & F.col("pattern").isNotNull(), F.length("pattern"))
    return status.groupBy("model_id").agg(F.avg(used).alias("average_length"))


def generation_summary(individuals: DataFrame) -> DataFrame:
    """One row for each (run, generation) of individuals (run, generation, ind_idx, fitness, test, rule_count, used_rule_count).

    The best is the first of equal fitness; means have 3 decimals, mean counts none.
    """
    best = F.min_by(F.struct("fitness", "test", "rule_count", "used_rule_count"), F.struct("fitness", "ind_idx"))
    g = individuals.groupBy("run", "generation").agg(
        best.alias("b"),
        F.bround(F.avg("fitness"), 3).alias("avg_fitness"),
        F.bround(F.avg("test"), 3).alias("avg_test"),
        F.bround(F.avg("rule_count"), 0).alias("avg_rule_count"),
        F.bround(F.avg("used_rule_count"), 0).alias("avg_used_rule_count"),
    )
    return g.select(
        "run", "generation", F.col("b.fitness").alias("best_fitness"), F.col("b.test").alias("best_test"),
        F.col("b.rule_count").alias("best_rule_count"), F.col("b.used_rule_count").alias("best_used_rule_count"),
        "avg_fitness", "avg_test", "avg_rule_count", "avg_used_rule_count",
    )


def footer(results: DataFrame, *by: str) -> DataFrame:
    """(*by, n, mae, pearson) of (fitness, prediction)."""
    return results.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(F.col("prediction") - F.col("fitness"))).alias("mae"),
        pearson("prediction", "fitness").alias("pearson"),
    )
