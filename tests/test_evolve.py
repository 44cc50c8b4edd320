import random

import pytest
from pyspark.sql import functions as F

from weft.operators import evolve, metrics, ordering, scoring, search
from weft.sources import files


@pytest.fixture(scope="module")
def pop(spark):
    p = evolve.init_population(spark, 20, 30, 6, -10.0, 10.0, 3)
    return p.withColumn("fitness", (F.col("ind") * 7 % 13).cast("double")).select("ind", "fitness", "rules").cache()


def check(rules, max_rules, rule_size):
    n = [len(r.pattern) for r in rules]
    assert len(rules) <= max_rules and all(1 <= k <= rule_size for k in n) and n == sorted(n, reverse=True)
    assert [r.rule_idx for r in rules] == list(range(len(rules)))
    assert all(set(r.pattern) <= set(evolve.ALPHABET) for r in rules)


def test_init(pop):
    for r in pop.collect():
        assert 1 <= len(r.rules) <= 10
        check(r.rules, 10, 6)
        assert all(-10 <= x.weight <= 10 and x.status == 0 for x in r.rules)


def test_random_numbers_do_not_depend_on_partitions(spark):
    d = spark.range(1000).select("id", evolve.uniform(5, 1, "id").alias("u"))
    a = {r.id: r.u for r in d.collect()}
    assert a == {r.id: r.u for r in d.repartition(13).collect()}
    assert 0.45 < sum(a.values()) / 1000 < 0.55 and min(a.values()) >= 0 and max(a.values()) < 1


def trim_loop(rules, most):
    """From the tail delete the first unused rule, unless as many used ones were seen as the index; then delete there."""
    rules = list(rules)
    while len(rules) > most:
        used = 0
        for i in range(len(rules) - 1, -1, -1):
            if rules[i][1] == 0 or used >= i:
                del rules[i]
                break
            used += 1
    return rules


def test_trim(spark):
    rng = random.Random(1)
    cases = [[(k, rng.randint(0, 1)) for k in range(rng.randint(0, 15))] for _ in range(60)]
    d = spark.createDataFrame([(n, [(k, "A", 0.0, s) for k, s in c]) for n, c in enumerate(cases)], f"n int, rules array<{evolve.RULE}>")
    for r in d.select("n", evolve.trim(F.col("rules"), 4).alias("t")).collect():
        assert [x.rule_idx for x in r.t] == [k for k, _ in trim_loop(cases[r.n], 4)]


def test_tournament_and_parents(pop):
    t = evolve.tournaments(pop, 15, 5, 9)
    rules = {r.ind: [x.pattern for x in r.rules] for r in pop.collect()}
    plain = {r.child: r for r in evolve.choose_parents(t).collect()}
    valued = {r.child: r for r in evolve.choose_parents(t, 0.5).collect()}
    assert len(plain) == 15
    for child, r in plain.items():
        mine = r.entrants
        assert len(mine) == 5 and [(e.fitness, e.draw) for e in mine] == sorted((e.fitness, e.draw) for e in mine)
        best = set(rules[mine[0].ind])
        assert [e.closeness for e in mine] == [sum(p in best for p in rules[e.ind]) for e in mine]
        assert (r.parent_a.ind, r.parent_b.ind) == (mine[0].ind, mine[1].ind)
        top_f, top_c = max(e.fitness for e in mine[1:]), max(e.closeness for e in mine[1:])
        value = lambda e: e.fitness if top_c == 0 else (e.fitness / top_f if top_f else 0) + 0.5 * e.closeness / top_c  # noqa: E731, B023
        want = min(range(1, 5), key=lambda k: (value(mine[k]), k))  # noqa: B023
        assert valued[child].parent_b.draw == mine[want].draw


def test_crossover(pop):
    used = pop.withColumn("rules", F.transform("rules", lambda r: r.withField("status", (r["rule_idx"] % 2).cast("int"))))
    chosen = evolve.choose_parents(evolve.tournaments(used, 6, 3, 4))
    for keep in (0.0, 1.1):
        for r in chosen.join(evolve.crossover(chosen, keep, 1), "child").collect():
            sides = [(x, k) for k, p in enumerate((r.parent_a, r.parent_b)) for x in p.rules if keep or x.status == 1]
            want = sorted(sides, key=lambda x: (-len(x[0].pattern), x[0].rule_idx, x[1]))
            assert [(x.rule_idx, x.pattern, x.weight, x.status) for x in r.rules] == [(i, x.pattern, x.weight, x.status) for i, (x, _) in enumerate(want)]


def test_duplicates(spark):
    rows = [(0, 0, "A", 1), (0, 1, "A", 0), (0, 2, "B", 0), (0, 3, "B", 0), (0, 4, "C", 1), (0, 5, "C", 1), (0, 6, "D", 0)]
    d = spark.createDataFrame(rows, "ind int, rule_idx int, pattern string, status int")
    assert sorted(r.rule_idx for r in evolve.remove_duplicates(d).collect()) == [0, 3, 4, 5, 6]


def test_mutation_keeps_bounds(pop):
    out = evolve.mutate(pop.select("ind", "rules"), 4, 2, 12, 6, -10.0, 10.0, add=1.1, remove=0.5, weight=0.5, insert=0.5, delete=0.5)
    for r in out.collect():
        check(r.rules, 12, 6)
    same = evolve.mutate(pop.select("ind", "rules"), 4, 2, 12, 6, -10.0, 10.0, add=0, remove=0, weight=0, insert=0, delete=0)
    assert {r.ind: r.rules for r in same.collect()} == {r.ind: r.rules for r in pop.collect()}


def fewer_a(p):
    """Fewer letters A are better; every rule counts as used."""
    n = F.aggregate("rules", F.lit(0), lambda a, r: a + F.length(F.regexp_replace(r["pattern"], "[^A]", "")))
    used = F.transform("rules", lambda r: r.withField("status", F.lit(1))).cast(f"array<{evolve.RULE}>")
    value = (n + F.size("rules") / 100).cast("double")
    return p.select(*[c for c in p.columns if c != "rules"], value.alias("fitness"), (value / 2).alias("test"), used.alias("rules"))


def test_evolution_never_worsens(pop):
    evaluate = fewer_a
    start = evaluate(pop.select("ind", "rules"))
    end = evolve.evolve(pop.select("ind", "rules"), evaluate, 2, 20, seed=6, max_rules=20)
    assert end.count() == 20
    best = lambda d: d.agg(F.min("fitness")).first()[0]
    assert best(end) <= best(start)
    for r in end.collect():
        check(r.rules, 20, 6)


def test_guard(spark):
    rule = [(0, "A", 1.0, 1)]
    kind = f"ind int, fitness double, rules array<{evolve.RULE}>"
    before = spark.createDataFrame([(0, 1.0, rule)], kind)
    after = spark.createDataFrame([(0, 2.0, []), (1, 5.0, [])], kind)
    assert {r.ind: (r.fitness, len(r.rules)) for r in evolve.guard_elite(before, after).collect()} == {0: (1.0, 1), 1: (5.0, 0)}


SEQUENCES = [(f"q{k}", ("ACDEFGHIKLMNPQRSTVWY" * 2)[k % 20 : k % 20 + 4 + k % 5], (k * 7 % 23) / 2) for k in range(30)]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(SEQUENCES, "seq_id string, sequence string, fitness double").cache()


def exact(df):
    return sorted((*[r[c] for c in r.__fields__ if c in ("seed", "ind")], round(r.fitness, 9), [(x.pattern, x.weight, x.status) for x in r.rules]) for r in df.collect())


def test_runs_of_seeds_equal_the_single_runs(spark, seqs):
    options = dict(max_rules=9, rule_size=3, low=-5.0, high=5.0)
    together = evolve.replicate_runs(spark, seqs, [4, 11], 2, size=5, diversity=0.1, **options)
    apart = []
    for seed in (4, 11):
        start = evolve.init_population(spark, 5, 9, 3, -5.0, 5.0, seed)
        end = evolve.evolve(start, evolve.evaluator(seqs), 2, 5, seed, diversity=0.1, **options)
        apart += [(seed, *x) for x in exact(end)]
    assert exact(together) == apart


class Ended(Exception):
    pass


def ends_after(evaluate, calls):
    """An evaluation that fails after so many calls, as a driver that is lost."""
    left = [calls]

    def run(p):
        if left[0] == 0:
            raise Ended
        left[0] -= 1
        return evaluate(p)

    return run


def test_a_run_goes_on_after_its_last_commit(spark, pop, tmp_path):
    start = pop.select("ind", "rules").where("ind < 6")
    run = lambda at, evaluate, g=3: evolve.evolve(start, evaluate, g, 6, 6, log=f"{at}/log", model=f"{at}/model", state=f"{at}/state", max_rules=20)
    whole = exact(run(tmp_path / "a", fewer_a))
    with pytest.raises(Ended):
        run(tmp_path / "b", ends_after(fewer_a, 2))
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "b/state/commits").glob("?.json")}
    assert sorted(p.name for p in stamps) == ["0.json", "1.json"]
    assert exact(run(tmp_path / "b", ends_after(fewer_a, 2))) == whole  # two more generations and no evaluation again
    assert {p: p.stat().st_mtime_ns for p in stamps} == stamps  # what was committed isn't written again
    assert exact(run(tmp_path / "b", ends_after(fewer_a, 0))) == whole
    logs = [sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / x / "log")).collect()) for x in "ab"]
    assert logs[0] == logs[1] and len(logs[0]) == 4
    with pytest.raises(ValueError):  # another run's folder
        evolve.evolve(start, fewer_a, 3, 6, 7, state=f"{tmp_path}/b/state", max_rules=20)


def test_put_replaces_its_own_rows(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "run int, generation int, v double")
    for r in ((1, 0, 0.5), (1, 1, 0.4), (2, 0, 9.0), (1, 1, 0.3)):
        files.put(rows(r), str(tmp_path / "log"), "run", "generation")
    back = spark.read.option("header", True).csv(str(tmp_path / "log"))
    assert sorted((r.run, r.generation, r.v) for r in back.collect()) == [("1", "0", "0.5"), ("1", "1", "0.3"), ("2", "0", "9.0")]


def test_index(spark, pop, seqs):
    p = pop.select("ind", "rules").where("ind < 6")
    index = scoring.GramIndex.write(seqs, "weft_test_grams", 6, 4)
    try:
        for metric in ("RMSE", "correlation"):
            assert exact(evolve.evaluator(seqs, metric, index=index)(p)) == exact(evolve.evaluator(seqs, metric)(p))
        rules = evolve.flatten(p).withColumnRenamed("ind", "model_id")
        won = index.first_rules(rules)
        assert sorted(map(tuple, won.collect())) == sorted(
            map(tuple, scoring.hits(seqs, rules).join(seqs, "seq_id").select("model_id", "seq_id", "fitness", "pos", "rule_idx", "weight").collect())
        )
        sums = won.groupBy("model_id", "seq_id").agg(F.sum("weight"))
        plan = sums._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "weft_test_grams" in plan  # from the index to a sequence's sum
    finally:
        index.drop()


def test_sums_give_the_metrics(spark, pop, seqs, monkeypatch):
    p = pop.select("ind", "rules").where("ind < 8")
    rules = evolve.flatten(p).withColumnRenamed("ind", "model_id")
    want = {r.model_id: r.fitness_value for r in metrics.correlation_fitness(scoring.predictions(seqs, rules)).collect()}
    got = {r.ind: r.fitness for r in evolve.evaluator(seqs, "correlation")(p).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    by_bits = exact(evolve.evaluator(seqs)(p))
    status = {(r.model_id, r.rule_idx): r.status for r in scoring.rule_status(seqs, rules).collect()}
    assert {(r.ind, k): x.status for r in evolve.evaluator(seqs)(p).collect() for k, x in enumerate(r.rules)} == status
    monkeypatch.setattr(scoring, "MOST_WORDS", 0)  # too many rules for a bitmap
    assert exact(evolve.evaluator(seqs)(p)) == by_bits
    monkeypatch.setattr(scoring, "BROADCAST_ROWS", 1)  # and for a broadcast
    assert exact(evolve.evaluator(seqs)(p)) == by_bits


def test_climb_scores_only_what_changed(spark):
    rules = spark.createDataFrame(
        [(m, i, p, w / 4) for m in (0, 1) for i, (p, w) in enumerate([("KDE", 3), ("AK", -2 - m), ("D", 5), ("KK", 1 + m), ("N", -1)])],
        "model_id int, rule_idx int, pattern string, weight double",
    )
    cands = search.candidates(spark, 60, 25, 8).unionByName(spark.createDataFrame([(99, ""), (98, "K"), (97, None)], "cand_id long, sequence string"))
    known = spark.createDataFrame([("K",)], "sequence string")
    start = search.ensemble_score(cands.select(F.col("cand_id").alias("seq_id"), "sequence"), rules)
    now = cands.join(start.select(F.col("seq_id").alias("cand_id"), F.col("score").alias("fitness")), "cand_id").where("sequence <> ''")
    for i in range(1, 6):
        now = search.climb_step(now, rules, known, 8, i).checkpoint()
    got = {r.cand_id: (r.sequence, r.fitness) for r in search.climb(cands, rules, known, 5, 8).collect()}
    assert {k: got[k] for k in got if k not in (97, 99)} == {r.cand_id: (r.sequence, r.fitness) for r in now.collect()}
    assert got[99] == ("", 0.0) and got[97] == (None, 0.0)
    mutants = search.point_mutants(cands.where("cand_id < 60"), 8, 1).select(F.col("cand_id").alias("seq_id"), F.col("mutant").alias("sequence"), "site")
    lengths = scoring.match_strings(rules).select(F.length("gram").alias("k")).distinct()
    every, local = scoring.kgrams(mutants, lengths).count(), scoring.kgrams(mutants, lengths, site="site").count()
    assert local * 25 <= every * 3 * 1.1  # the longest pattern has 3 of 25 letters


def test_sort_rules(spark):
    d = spark.createDataFrame([(0, 0, "A", 1.0), (0, 1, "ABC", 2.0), (0, 2, "BB", 2.0), (0, 3, "CC", 0.0)], "model_id int, rule_idx int, pattern string, weight double")
    assert [r.pattern for r in ordering.sort_rules(d).orderBy("rule_idx").collect()] == ["ABC", "BB", "CC", "A"]
    assert [r.pattern for r in ordering.by_weight(d).collect()] == ["BB", "ABC", "A", "CC"]
    assert [r.rule_idx for r in ordering.by_value(d, "weight", "rule_idx").collect()] == [1, 2, 0, 3]
    assert d.agg(ordering.first_best("weight", "pattern", "rule_idx", largest=True)).first()[0] == "ABC"


def test_hydropathy(spark):
    d = spark.createDataFrame([("II",), ("KK",), ("",), ("AB",)], "s string")
    assert [r[0] for r in d.select(F.round(search.hydropathy("s"), 6)).collect()] == [9.0, -7.8, 0.0, None]
    assert [r[0] for r in d.select(search.soluble("s")).collect()] == [False, True, False, None]


def test_search(spark):
    rules = spark.createDataFrame([(0, 0, "K", 1.0), (1, 0, "D", 2.0)], "model_id int, rule_idx int, pattern string, weight double")
    seqs = spark.createDataFrame([("a", "KKD"), ("b", "III"), ("c", "NNN")], "seq_id string, sequence string")
    assert {r.seq_id: r.score for r in search.ensemble_score(seqs, rules).collect()} == {"a": 2.0, "b": 0.0, "c": 0.0}
    c = search.candidates(spark, 50, 0, 8)
    assert len({len(r.sequence) for r in c.collect()}) == 1
    known = seqs.select("sequence")
    start = search.climb(c, rules, known, 0, 8)
    end = search.climb(c, rules, known, 2, 8)
    a, b = ({r.cand_id: r.fitness for r in d.collect()} for d in (start, end))
    assert all(b[k] >= a[k] for k in a) and sum(b.values()) > sum(a.values())
    assert search.novel(seqs.select("sequence"), known.where("sequence = 'KKD'")).count() == 2
    assert [r.cand_id for r in ordering.top_candidates(end, 3).collect()] == [k for k, _ in sorted(b.items(), key=lambda x: (-x[1], x[0]))[:3]]


def test_evaluator(pop, seqs):
    out = evolve.evaluator(seqs)(pop.select("ind", "rules")).collect()
    assert len(out) == 20 and all(r.fitness > 0 and r.test > 0 for r in out)
    assert any(x.status for r in out for x in r.rules)
    with pytest.raises(ValueError):
        evolve.evaluator(seqs, "other")(pop.select("ind", "rules"))
