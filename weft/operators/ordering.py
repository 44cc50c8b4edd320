"""Orders, ranks and top-k of rules and candidates; every order ends in an explicit tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_rules(rules: DataFrame, by: str = "model_id") -> DataFrame:
    """Rules renumbered by pattern length, longest first, equal lengths in their old order."""
    order = Window.partitionBy(by).orderBy(F.desc(F.coalesce(F.length("pattern"), F.lit(0))), "rule_idx")
    return rules.withColumn("_new", (F.row_number().over(order) - 1).cast("int")).drop("rule_idx").withColumnRenamed("_new", "rule_idx")


def sort_rule_array(rules: str | Column) -> Column:
    """The same for a nested array of rules with rule_idx."""
    return F.array_sort(rules, lambda a, b: F.when(F.length(a["pattern"]) > F.length(b["pattern"]), -1)
        .when(F.length(a["pattern"]) < F.length(b["pattern"]), 1)
        .when(a["rule_idx"] < b["rule_idx"], -1).when(a["rule_idx"] > b["rule_idx"], 1).otherwise(0))


def rank_entrants(entrants: DataFrame) -> DataFrame:
    """Entrants of tournaments (child, draw, ind, fitness) with ``place``: ascending fitness, then draw."""
    order = Window.partitionBy("child").orderBy("fitness", "draw")
    return entrants.withColumn("place", F.row_number().over(order))


def top_candidates(candidates: DataFrame, k: int = 10) -> DataFrame:
    """The k best (cand_id, sequence, fitness)."""
    return candidates.orderBy(F.desc("fitness"), "cand_id").limit(k)


def by_weight(rules: DataFrame, *tie: str) -> DataFrame:
    """Rules by falling weight; equal weights in reversed order, then by ``tie``."""
    return rules.orderBy(F.desc("weight"), F.desc("rule_idx"), *tie)


def by_value(rows: DataFrame, value: str, tie: str, descending: bool = True) -> DataFrame:
    """Rows by a fitness or prediction."""
    return rows.orderBy(F.desc(value) if descending else F.asc(value), tie)


def first_best(value: str, name: str, order: str, largest: bool = False) -> Column:
    """Aggregate: ``name`` of the first row with the least (or largest) value."""
    key = -F.col(value) if largest else F.col(value)
    return F.min_by(F.col(name), F.struct(key, F.col(order)))
