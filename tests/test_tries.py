"""Sums by tries: equal to those of joined hits, and without a row for each hit."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import evolve, scoring, search


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(9)
    word = lambda n, letters="ACDÑ😀": "".join(rng.choice(letters) for _ in range(n))
    seqs = [(f"q{k}", word(rng.randint(1, 15), "ACDÑ😀Y"), None if k % 9 == 0 else rng.randint(0, 40) / 4) for k in range(80)]
    seqs += [("empty", "", 1.0), ("null", None, 2.0), ("none", "YYY", 3.0)]
    rules = [(m, k, word(rng.randint(1, 4)), rng.randint(-40, 40) / 4) for m in range(7) for k in range(3, 80)]
    rules += [(1, 80, "", 9.0), (2, 81, None, 9.0), (3, 82, "A" * 30, 1.0), (8, 0, "K", 2.0), (9, 0, "A", -1.0), (9, 1, "AA", 4.0)]
    s = spark.createDataFrame(seqs, "seq_id string, sequence string, fitness double").cache()
    return s, spark.createDataFrame(rules, "model_id int, rule_idx int, pattern string, weight double").cache()


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_sums_equal_the_joined_ones(data, monkeypatch):
    s, r = data
    by_trie = rows(scoring.model_sums(s, r))
    plan = scoring.model_sums(s, r)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan  # neither a gram nor a hit becomes a row
    monkeypatch.setattr(scoring, "TRIE_CELLS", 1)  # a trie for each model
    assert rows(scoring.model_sums(s, r)) == by_trie
    monkeypatch.setattr(scoring, "CELLS", 0)
    assert "MapInArrow" not in scoring.model_sums(s, r)._jdf.queryExecution().executedPlan().toString()
    assert rows(scoring.model_sums(s, r)) == by_trie


def test_the_learn_set_is_worked_out_once(spark, data):
    s, r = data
    worked = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            worked.add(b.num_rows)
            yield b

    n = s.count()
    evaluate = evolve.evaluator(s.mapInArrow(count, s.schema))
    p = evolve.nest(r.withColumnRenamed("model_id", "ind").withColumn("status", F.lit(0)))
    for _ in range(2):
        got = {(x.ind, x.rule_idx): x.status for x in evolve.flatten(evaluate(p)).collect()}
        assert got == {(x.model_id, x.rule_idx): x.status for x in scoring.rule_status(s, r).collect()}
    assert worked.value == n


def test_evaluations_read_the_learn_set_as_it_lies(spark, data):
    """The learn set is dealt out when it is checkpointed, in a few tasks for each core, and by no evaluation."""
    s, r = data
    p = evolve.nest(r.withColumnRenamed("model_id", "ind").withColumn("status", F.lit(0)))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1000)
    try:
        assert scoring.deal(s).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        plan = evolve.evaluator(s)(p)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and not any("Exchange" in x and "seq_id" in x for x in plan.splitlines())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_the_index_has_a_row_for_each_sequence(spark, data):
    s, r = data
    index = scoring.GramIndex.write(s, "weft_test_windows", 30, 4)
    try:
        assert spark.table(index.name).count() == s.count()
        assert rows(scoring.model_sums(s, r, index=index)) == rows(scoring.model_sums(s, r))
        won = scoring.hits(s, r).select("model_id", "seq_id", "pos", "rule_idx")
        assert rows(index.first_rules(r).select(*won.columns)) == rows(won)
    finally:
        index.drop()


def test_position_sums_need_no_shuffle(data, monkeypatch):
    s, r = data
    s = s.withColumn("site", F.length("sequence") - 2).select("seq_id", "sequence", F.when(F.col("seq_id") != "q5", F.col("site")).alias("site"))
    for site in (None, "site"):
        by_trie = scoring.position_sums(s, r, site)
        assert "Exchange" not in by_trie._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(scoring, "CELLS", 0)
            want = {x.seq_id: x.sums for x in scoring.position_sums(s, r, site).collect()}
        got = {x.seq_id: x.sums for x in by_trie.collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()} and got


def test_climb_joins_the_known_sequences_alone(spark, data, monkeypatch):
    r = data[1]
    cands = search.candidates(spark, 50, 9, 4).unionByName(spark.createDataFrame([(99, ""), (98, "K"), (97, None)], "cand_id long, sequence string"))
    spec = scoring.tries(r)
    now = cands.withColumn("fitness", F.lit(0.0)).withColumn("sums", F.array(F.lit(0.0)))
    plan = search.rescored(now.select("*", *search.mutation(4, 1)), r, spec)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    known = spark.createDataFrame([("K",)], "sequence string")
    by_trie = rows(search.climb(cands, r, known, 2, 4))
    monkeypatch.setattr(scoring, "CELLS", 0)
    assert by_trie == rows(search.climb(cands, r, known, 2, 4))
