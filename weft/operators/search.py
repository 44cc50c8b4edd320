"""Searching sequences by an ensemble-scored hill climb, a set-wise step for each iteration."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import checkpoints
from weft.operators import scoring
from weft.operators.evolve import ALPHABET, integer, letter, uniform

#: Hydropathy by letter (fixed values).
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}


def hydropathy(sequence: str | Column) -> Column:
    """Sum over the letters; null if a letter isn't in the table."""
    s = F.col(sequence) if isinstance(sequence, str) else sequence
    table = F.create_map(*[F.lit(x) for kv in HYDROPATHY.items() for x in kv])
    return F.aggregate(F.split(s, ""), F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(acc + F.try_element_at(table, c)))


def soluble(sequence: str | Column) -> Column:
    """Whether the sum is below 0; null with an unknown letter."""
    return hydropathy(sequence) < 0


def candidates(spark: SparkSession, n: int, size: int, seed: int) -> DataFrame:
    """(cand_id, sequence): random sequences; size 0 or less gives all of them one random length from 8 to 12."""
    return candidates_for(spark.range(n).select(F.col("id").alias("cand_id")), size, seed)


def candidates_for(ids: DataFrame, size: int, seed: int) -> DataFrame:
    """The same for given ids (cand_id)."""
    length = F.lit(size) if size > 0 else integer(8, 12, seed, -1)
    text = F.array_join(F.transform(F.sequence(F.lit(1), length), lambda k: letter(seed, "cand_id", k)), "")
    return ids.select("cand_id", text.alias("sequence"))


def ensemble_score(sequences: DataFrame, rules: DataFrame) -> DataFrame:
    """(seq_id, score): mean over all models, hits or none; 0 where the sequence isn't soluble; null without models."""
    n = rules.select("model_id").distinct().agg(F.count("*").alias("n"))
    d = scoring.totals(sequences, rules, ("sequence",)).join(F.broadcast(n))  # one row
    mean = F.try_divide(F.col("total"), F.col("n"))
    return d.select("seq_id", F.when(soluble("sequence"), mean).otherwise(0.0).alias("score"))


def novel(cands: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose sequence isn't in the learn set."""
    return cands.join(known.select("sequence").distinct(), "sequence", "left_anti")


def mutation(seed: int, iteration: int) -> tuple[Column, Column]:
    """``mutant`` and ``site`` of a row (cand_id, sequence): one random site gets a random letter; null for an empty sequence."""
    some = F.length("sequence") > 0
    site = F.when(some, integer(F.lit(1), F.greatest(F.length("sequence"), F.lit(1)), seed, iteration, "cand_id", 1))
    return F.overlay("sequence", letter(seed, iteration, "cand_id", 2), site, F.lit(1)).alias("mutant"), site.alias("site")


def point_mutants(cands: DataFrame, seed: int, iteration: int) -> DataFrame:
    """(cand_id, mutant, site): one random site gets a random letter, which may be the old one; an empty sequence has none."""
    return cands.where(F.length("sequence") > 0).select("cand_id", *mutation(seed, iteration))


def climb_step(cands: DataFrame, rules: DataFrame, known: DataFrame, seed: int, iteration: int) -> DataFrame:
    """(cand_id, sequence, fitness) after one mutation each, taken if strictly better; known or insoluble mutants score 0."""
    m = point_mutants(cands, seed, iteration)
    scored = ensemble_score(m.select(F.col("cand_id").alias("seq_id"), F.col("mutant").alias("sequence")), rules)
    seen = known.select(F.col("sequence").alias("mutant")).distinct().withColumn("_known", F.lit(True))
    m = m.join(scored.withColumnRenamed("seq_id", "cand_id"), "cand_id").join(seen, "mutant", "left")
    m = m.select("cand_id", "mutant", F.when(F.col("_known"), 0.0).otherwise(F.col("score")).alias("new"))
    better = F.col("new") > F.col("fitness")
    return cands.join(m, "cand_id").select(
        "cand_id",
        F.when(better, F.col("mutant")).otherwise(F.col("sequence")).alias("sequence"),
        F.when(better, F.col("new")).otherwise(F.col("fitness")).alias("fitness"),
    )


def rescored(mutated: DataFrame, rules: DataFrame, spec: Broadcast | None) -> DataFrame:
    """``mutated`` (cand_id, sequence, fitness, sums, mutant, site) with the mutants' ``new_sums``; null where there is no mutant.

    ``sums`` are those of ``scoring.position_sums``.  A changed letter can change the first rules only of positions that lie
    less than the longest pattern before it, so only the sums of these are worked out: by ``spec``, the rules' ``scoring.tries``,
    within the row, without it by joins.
    """
    if spec is None:
        of = mutated.where("site IS NOT NULL").select(F.col("cand_id").alias("seq_id"), F.col("mutant").alias("sequence"), "site")
        local = scoring.position_sums(of, rules, "site").toDF("cand_id", "_local")
        d = mutated.join(local, "cand_id", "left")
    else:
        d = scoring.with_position_sums(mutated, spec, "mutant", "site", "_local")
    before = F.slice("sums", F.lit(1), F.col("site") - F.size("_local"))
    after = F.slice("sums", F.col("site") + 1, F.length("sequence"))
    return d.select(*mutated.columns, F.when(F.col("site").isNotNull(), F.concat(before, "_local", after)).alias("new_sums"))


def climb(cands: DataFrame, rules: DataFrame, known: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(cand_id, sequence, fitness) after a bounded number of ``climb_step``s, each checkpointed.

    Candidates keep their positions' sums, so a step scores anew only what its mutation may change, in the candidate's row;
    the known sequences, which are worked out once, are its only join.
    """
    checkpoints.ensure(cands.sparkSession)
    n = rules.select("model_id").distinct().count()
    spec = scoring.tries(rules)
    mean = lambda text, sums: F.when(soluble(text), F.try_divide(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x), F.lit(n))).otherwise(0.0)
    cands = cands.select("cand_id", "sequence")
    if spec is None:
        sums = scoring.position_sums(cands.select(F.col("cand_id").alias("seq_id"), "sequence"), rules).withColumnRenamed("seq_id", "cand_id")
        now = cands.join(sums, "cand_id", "left")
    else:
        parts = int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small table would keep most cores idle
        now = scoring.with_position_sums(cands.repartition(parts, "cand_id"), spec, "sequence")
    now = now.withColumn("sums", F.coalesce("sums", F.array().cast("array<double>")))
    now = now.select("cand_id", "sequence", mean("sequence", "sums").alias("fitness"), "sums").checkpoint()
    if iterations > 0:
        seen = known.select(F.col("sequence").alias("mutant")).distinct().withColumn("_known", F.lit(True)).checkpoint()
    for i in range(1, iterations + 1):
        m = rescored(now.select("*", *mutation(seed, i)), rules, spec).join(seen, "mutant", "left")
        m = m.withColumn("new", F.when(F.col("_known"), 0.0).otherwise(mean("mutant", "new_sums")))
        better = F.coalesce((F.col("new") > F.col("fitness")) & F.col("site").isNotNull(), F.lit(False))
        pick = lambda a, b: F.when(better, F.col(a)).otherwise(F.col(b)).alias(b)  # noqa: E731, B023
        now = m.select("cand_id", pick("mutant", "sequence"), pick("new", "fitness"), pick("new_sums", "sums")).checkpoint()
    return now.select("cand_id", "sequence", "fitness")
