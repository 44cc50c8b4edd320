"""The scoring kernel against a plain loop, in both forms."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import metrics, scoring


def brute(sequence, rules):
    """(score, hits, winning rule indexes): first rule in order, forward or reversed, at each position."""
    total, won = 0.0, []
    for pos in range(len(sequence or "")):
        for idx, pattern, weight in rules:
            if pattern and pos + len(pattern) <= len(sequence) and sequence[pos : pos + len(pattern)] in (pattern, pattern[::-1]):
                total += weight
                won.append(idx)
                break
    return total, len(won), set(won)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ACDE") for _ in range(n))
    seqs = [(f"q{k}", word(rng.randint(1, 14))) for k in range(60)] + [("empty", ""), ("null", None), ("none", "YYYY")]
    models = {}
    for m in range(3):
        models[m] = [(k, word(rng.randint(1, 4)), rng.randint(-40, 40) / 4) for k in range(12)]
    models[0] += [(12, "ACA", 5.0), (13, "", 9.0), (14, None, 9.0), (15, "A" * 30, 1.0)]  # palindrome, empty, null, too long
    models[1].sort(key=lambda r: rng.random())
    models[1] = [(k, p, w) for k, (_, p, w) in enumerate(models[1])]
    s = spark.createDataFrame(seqs, "seq_id string, sequence string").withColumn("fitness", F.length("sequence") / 2)
    r = spark.createDataFrame([(m, *x) for m, l in models.items() for x in l], "model_id int, rule_idx int, pattern string, weight double")
    return seqs, models, s, r


def test_join_form(data):
    seqs, models, s, r = data
    got = {(x.model_id, x.seq_id): (x.score, x.hits) for x in scoring.score(s, r).collect()}
    assert len(got) == len(seqs) * len(models)
    for m, rules in models.items():
        for i, q in seqs:
            assert got[m, i] == pytest.approx(brute(q, rules)[:2]), (m, i)


def test_nested_form_agrees(data):
    seqs, models, s, r = data
    got = {(x.model_id, x.seq_id): x.score for x in scoring.score_nested(s, r).collect()}
    for m, rules in models.items():
        for i, q in seqs:
            assert got[m, i] == pytest.approx(brute(q, rules)[0]), (m, i)
    assert scoring.flat(scoring.nested(r)).count() == r.count()


def test_status_and_counts(data):
    seqs, models, s, r = data
    status = scoring.rule_status(s, r)
    got = {(x.model_id, x.rule_idx): x.status for x in status.collect()}
    for m, rules in models.items():
        used = set().union(*(brute(q, rules)[2] for _, q in seqs))
        assert {k for (mm, k), v in got.items() if mm == m and v} == used
        row = scoring.used_rule_count(status).where(F.col("model_id") == m).first()
        assert (row.rule_count, row.used_rule_count) == (len(rules), len(used))
    assert scoring.drop_unused(status).where("status = 0").isEmpty()
    mean = {x.model_id: x.average_length for x in metrics.average_used_rule_length(status).collect()}
    lengths = [len(p) for k, p, _ in models[2] if got[2, k]]
    assert mean[2] == pytest.approx(sum(lengths) / len(lengths))


def test_modes(data):
    _, _, s, r = data
    assert {x.score for x in scoring.score(s, r, mode=scoring.PRODUCT).collect()} == {0.0}
    assert scoring.products(s, r).count() > 0
    with pytest.raises(ValueError):
        scoring.score(s, r, mode=2)


def test_model_without_rules_and_empty_tables(data, spark):
    _, _, s, r = data
    models = spark.createDataFrame([(0,), (9,)], "model_id int")
    got = scoring.score(s, r.where("model_id = 0"), models).where("model_id = 9").collect()
    assert len(got) == s.count() and all(x.score == 0 and x.hits == 0 for x in got)
    assert scoring.score(s.limit(0), r).collect() == []
    assert scoring.score(s, r.limit(0)).collect() == []


def test_plan_joins_on_grams(data):
    _, _, s, r = data
    plan = scoring.score(s, r)._jdf.queryExecution().optimizedPlan().toString()
    assert "gram" in plan and "Python" not in plan


def test_squared_errors_from_hits(data, spark):
    _, _, s, r = data
    s = s.where("sequence IS NOT NULL")
    models = spark.createDataFrame([(0,), (1,), (2,), (9,)], "model_id int")
    got = {x.model_id: (x.n, x.sse) for x in scoring.squared_errors(s, r, models).collect()}
    p = scoring.absolute_error(scoring.score(s, r, models), s)
    want = {x.model_id: (x.n, x.sse) for x in p.groupBy("model_id").agg(F.count("*").alias("n"), F.sum(F.pow("error", F.lit(2))).alias("sse")).collect()}
    assert got.keys() == want.keys() and all(got[m] == pytest.approx(want[m]) for m in want)


def test_first_by_sequence(spark):
    d = spark.createDataFrame([(2, "A", 5.0), (1, "A", 6.0), (0, "B", None)], "row_idx int, sequence string, fitness double")
    assert {tuple(x) for x in scoring.first_by_sequence(d).collect()} == {(1, "A", 6.0), (0, "B", None)}


def test_half_a_million_rules(spark, monkeypatch):
    """Automata over parts of the rules and groups of sequences agree with the broadcast join, and shuffle less than grams."""
    n, text = 500_000, lambda salt: F.md5(F.concat(F.lit(salt), F.col("id").cast("string")))
    pattern = F.substring(text("r"), F.lit(1), (F.col("id") % 5 + 2).cast("int"))
    rules = spark.range(n).select(
        (F.col("id") % 3).cast("int").alias("model_id"), F.floor(F.col("id") / 3).cast("int").alias("rule_idx"), pattern.alias("pattern"),
        ((F.col("id") * 37 % 81 - 40) / 4).cast("double").alias("weight"),
    ).cache()
    seqs = spark.range(120).select(
        F.col("id").alias("seq_id"), F.substring(text("s"), F.lit(1), (F.col("id") % 31).cast("int")).alias("sequence"), F.col("id").cast("double").alias("fitness")
    ).cache()
    many = sorted(map(tuple, scoring.score(seqs, rules, carry=("fitness",)).collect()))
    monkeypatch.setattr(scoring, "AUTOMATON_SEQUENCES", 70)
    won = scoring.hits(seqs, rules)
    plan = won._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    found = sorted(map(tuple, won.collect()))
    monkeypatch.setattr(scoring, "BROADCAST_ROWS", n)
    assert many == sorted(map(tuple, scoring.score(seqs, rules, carry=("fitness",)).collect())) and len(many) == 360
    assert found == sorted(map(tuple, scoring.hits(seqs, rules).collect())) and found
