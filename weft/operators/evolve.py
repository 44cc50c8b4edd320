"""One generation of rule-model evolution as set-wise DataFrame steps, for one run or for many at once.

All randomness is a counter-based hash of (seed, generation, individual, slot),
so results don't depend on partitions or retries.  ``lcg`` is plain integer
arithmetic that any SQL engine repeats; ``uniform`` turns it into [0, 1).

Populations are nested: (ind, fitness, ..., rules array<struct<rule_idx, pattern,
weight, status>>); ``flatten`` gives a row for each rule.  Independent runs are
one population with more key columns, named in ``by``: every draw, tournament,
elite and log row is then of its run, and the seed may be a column.  All models of
all runs are scored in one pass over the learn set.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft import checkpoints
from weft.operators import metrics, scoring
from weft.operators.ordering import sort_rule_array
from weft.operators.run_state import RunState
from weft.sources import files

PRIME = 2_147_483_647
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
RULE = "struct<rule_idx:int,pattern:string,weight:double,status:int>"


def _long(x: int | Column) -> Column:
    """Typed as it stands: the analyser casts one level of a deep expression in each of its bounded rounds."""
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def lcg(seed: int | Column, *slots: int | str | Column) -> Column:
    """A pseudo-random integer in 0..PRIME-1 of a seed and counters."""
    h, prime = _long(seed), _long(PRIME)
    for s in slots:
        c = _long(F.col(s) if isinstance(s, str) else s)
        h = ((h * _long(48271) + c * _long(69621) + _long(40692)) % prime + prime) % prime
        h = (h * _long(16807) + _long(12345)) % prime
    return h


def uniform(seed: int | Column, *slots: int | str | Column) -> Column:
    return lcg(seed, *slots).cast("double") / F.lit(float(PRIME))


def integer(low: int | Column, high: int | Column, seed: int | Column, *slots) -> Column:
    """A pseudo-random integer from low to high, both included."""
    low, high = _long(low), _long(high)
    return (low + lcg(seed, *slots) % (high - low + _long(1))).cast("int")


def letter(seed: int | Column, *slots) -> Column:
    return F.substring(F.lit(ALPHABET), integer(1, len(ALPHABET), seed, *slots), F.lit(1))


def random_rule(idx: Column, seed: int | Column, rule_size: int, low: float, high: float, *slots) -> Column:
    """A rule of 1 to ``rule_size`` letters, a weight of two decimals and status 0."""
    n = integer(1, rule_size, seed, *slots, idx, 0)
    text = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: letter(seed, *slots, idx, k)), "")
    weight = F.round(F.lit(low) + uniform(seed, *slots, idx, 99) * (high - low), 2)
    return F.struct(idx.cast("int").alias("rule_idx"), text.alias("pattern"), weight.alias("weight"), F.lit(0).alias("status"))


def renumber(rules: Column) -> Column:
    """Rules longest first, numbered from 0."""
    return F.transform(sort_rule_array(rules), lambda r, i: F.struct(
        i.cast("int").alias("rule_idx"), r["pattern"].alias("pattern"), r["weight"].alias("weight"), r["status"].alias("status")
    ))


def init_population(
    spark: SparkSession, size: int, max_rules: int, rule_size: int, low: float, high: float, seed: int, runs: DataFrame | None = None
) -> DataFrame:
    """(ind, rules): each individual starts with 1 to max_rules / 3 rules.

    With ``runs``, a table whose column ``seed`` keys independent runs: (seed, ind, rules), each as its seed alone gives it.
    """
    by, s = (), seed
    d = spark.range(size).select(F.col("id").cast("int").alias("ind"))
    if runs is not None:
        by, s = ("seed",), F.col("seed")
        d = runs.select("seed").distinct().withColumn("ind", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    n = integer(1, max(1, max_rules // 3), s, 0, "ind", -1)
    rules = F.transform(F.sequence(F.lit(0), n - 1), lambda k: random_rule(k, s, rule_size, low, high, 0, "ind"))
    return d.select(*by, "ind", renumber(rules).alias("rules"))


def nest(rules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    r = F.array_sort(F.collect_list(F.struct("rule_idx", "pattern", "weight", "status")))
    return rules.groupBy(*by, "ind").agg(r.cast(f"array<{RULE}>").alias("rules"))


def flatten(individuals: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return individuals.select(*by, "ind", F.explode("rules").alias("r")).select(*by, "ind", "r.*")


def elite(population: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The first individual of least fitness, of each run."""
    if not by:
        return population.orderBy("fitness", "ind").limit(1)
    rest = [c for c in population.columns if c not in by]
    first = F.min_by(F.struct(*rest), F.struct("fitness", "ind")).alias("e")
    return population.groupBy(*by).agg(first).select(*by, "e.*").select(*population.columns)


def draw_entrants(
    population: DataFrame, children: int, size: int, seed: int | Column, generation: int = 0, by: tuple[str, ...] = ()
) -> DataFrame:
    """(*by, child, draw, ind, fitness, ...): ``size`` draws with replacement for each child, with all columns of the drawn.

    Individuals are numbered in the order of ``ind``; a run's population is a small table by nature.
    """
    p = population.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("ind")) - 1)
    n = population.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 0")
    d = n.withColumn("child", F.explode(F.sequence(F.lit(0), F.lit(children - 1))))
    d = d.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    d = d.withColumn("_at", (lcg(seed, generation, "child", "draw") % F.col("_n")).cast("int"))
    others = [c for c in population.columns if c not in (*by, "ind", "fitness")]
    return d.join(p, [*by, "_at"]).select(*by, "child", "draw", "ind", "fitness", *others)


def tournaments(
    population: DataFrame, children: int, size: int, seed: int | Column, generation: int = 0, by: tuple[str, ...] = ()
) -> DataFrame:
    """(*by, child, entrants): each child's entrants (fitness, draw, ind, rules, closeness) by place: least fitness, then draw.

    ``closeness`` is how many of an entrant's rules have a pattern that the tournament's best also has.
    """
    e = draw_entrants(population, children, size, seed, generation, by)
    placed = F.array_sort(F.collect_list(F.struct("fitness", "draw", "ind", "rules")))  # no draw is twice in a tournament
    t = e.groupBy(*by, "child").agg(placed.alias("entrants"))
    t = t.withColumn("_best", F.transform(F.col("entrants")[0]["rules"], lambda r: r["pattern"]))
    shared = lambda e: F.size(F.filter(e["rules"], lambda r: F.array_contains("_best", r["pattern"]))).cast("long")
    return t.withColumn("entrants", F.transform("entrants", lambda e: e.withField("closeness", shared(e)))).drop("_best")


def choose_parents(tournaments: DataFrame, diversity: float | None = None) -> DataFrame:
    """The tournaments with ``parent_a`` and ``parent_b``: the best entrant, and the next best or, with ``diversity``, the
    least of fitness / greatest fitness + diversity * closeness / greatest closeness among the others."""
    a, others = F.get("entrants", F.lit(0)), F.slice("entrants", 2, F.greatest(F.size("entrants"), F.lit(1)))
    t = tournaments.withColumn("_others", others)
    if diversity is None:
        b = F.get("_others", F.lit(0))
    else:
        t = t.withColumn("_f", F.array_max(F.transform("_others", lambda e: e["fitness"])))
        t = t.withColumn("_c", F.array_max(F.transform("_others", lambda e: e["closeness"])))

        def value(e: Column) -> Column:
            both = F.coalesce(F.try_divide(e["fitness"], F.col("_f")), F.lit(0.0)) + diversity * F.try_divide(e["closeness"], F.col("_c"))
            return F.when(F.col("_c") == 0, e["fitness"]).otherwise(both)

        b = F.array_min(F.transform("_others", lambda e, i: F.struct(value(e).alias("value"), i.alias("place"), e.alias("e"))))["e"]
    return t.select(*tournaments.columns, a.alias("parent_a"), b.alias("parent_b"))


def crossover(parents: DataFrame, keep_unused: float, seed: int | Column, generation: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, child, rules): rules of A and B in turn, longest first, unused ones with probability ``keep_unused``."""
    def side(parent: str, k: int) -> Column:
        lucky = lambda r: uniform(seed, generation, "child", r["rule_idx"], k) < keep_unused
        kept = F.filter(F.coalesce(F.col(parent)["rules"], F.array().cast(f"array<{RULE}>")), lambda r: (r["status"] == 1) | lucky(r))
        return F.transform(kept, lambda r: F.struct(
            F.coalesce(-F.length(r["pattern"]), F.lit(1)).alias("order"), r["rule_idx"].alias("at"), F.lit(k).alias("side"), r.alias("r")
        ))

    both = F.array_sort(F.concat(side("parent_a", 0), side("parent_b", 1)))
    rules = F.transform(both, lambda x, i: x["r"].withField("rule_idx", i.cast("int")))
    return parents.select(*by, "child", rules.cast(f"array<{RULE}>").alias("rules"))


def trim(rules: Column, max_rules: int) -> Column:
    """A nested rule array cut to ``max_rules``.

    Each step deletes the last unused rule beyond the middle (index > floor((n - 1) / 2)), else the rule there.
    """
    def step(acc: Column, _: Column) -> Column:
        n = F.size(acc)
        middle = F.floor((n - 1) / 2).cast("int")
        spare = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i > middle) & (F.get(acc, i)["status"] == 0))
        at = F.coalesce(F.array_max(spare), middle)
        return F.filter(acc, lambda r, i: i != at)

    excess = F.size(rules) - max_rules
    steps = F.when(excess > 0, F.sequence(F.lit(1), excess)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, rules, step)


def remove_duplicates(rules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of rules with one pattern in an individual, unused ones go while another is left; used ones all stay."""
    per = Window.partitionBy(*by, "ind", "pattern")
    used = F.sum((F.col("status") == 1).cast("int")).over(per)
    last = F.row_number().over(per.orderBy(F.desc("rule_idx")))
    return rules.withColumn("_keep", (F.col("status") == 1) | ((used == 0) & (last == 1))).where("_keep").drop("_keep")


def mutate(
    individuals: DataFrame, seed: int | Column, generation: int, max_rules: int, rule_size: int, low: float, high: float,
    add: float, remove: float, weight: float, insert: float, delete: float, by: tuple[str, ...] = (),
) -> DataFrame:
    """(*by, ind, rules) after adding, removing, re-weighting, inserting and deleting letters, each by its chance.

    A pattern that loses its last letter takes its rule along; the next rule is mutated like any other.
    """
    u = lambda *slots: uniform(seed, generation, "ind", *slots)
    new = random_rule(F.size("rules"), seed, rule_size, low, high, generation, "ind", 7)
    grown = F.when((u(1) < add) & (F.size("rules") < max_rules), F.concat("rules", F.array(new))).otherwise(F.col("rules"))
    d = individuals.withColumn("rules", grown.cast(f"array<{RULE}>"))
    gone = lcg(seed, generation, "ind", 2) % F.greatest(F.size("rules"), F.lit(1))
    d = d.withColumn("rules", F.when((u(3) < remove) & (F.size("rules") > 0), F.filter("rules", lambda r, i: i != gone)).otherwise(F.col("rules")))

    def one(r: Column, i: Column) -> Column:
        shift = F.round(u(4, i), 2) * F.when(u(5, i) < 0.5, -1.0).otherwise(1.0)
        w = F.when(u(6, i) < weight, r["weight"] + shift).otherwise(r["weight"])
        p = r["pattern"]
        at = lcg(seed, generation, "ind", 8, i) % (F.length(p) + 1)
        longer = F.concat(F.substring(p, F.lit(1), at.cast("int")), letter(seed, generation, "ind", 9, i), F.substring(p, at.cast("int") + 1, F.length(p)))
        p2 = F.when((u(10, i) < insert) & (F.length(p) < rule_size), longer).otherwise(p)
        cut = (lcg(seed, generation, "ind", 11, i) % F.greatest(F.length(p2), F.lit(1)) + 1).cast("int")
        shorter = F.concat(F.substring(p2, F.lit(1), cut - 1), F.substring(p2, cut + 1, F.length(p2)))
        p3 = F.when(u(12, i) < delete, shorter).otherwise(p2)
        return F.struct(r["rule_idx"].alias("rule_idx"), p3.alias("pattern"), w.alias("weight"), r["status"].alias("status"))

    d = d.withColumn("rules", F.filter(F.transform("rules", one), lambda r: F.length(r["pattern"]) > 0))
    return d.select(*by, "ind", renumber(F.col("rules")).alias("rules"))


def guard_elite(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, ind, fitness, rules) of ``after``, but ``before``'s where that was better on the same learn set."""
    b = before.select(*by, "ind", F.col("fitness").alias("_f"), F.col("rules").alias("_r"))
    worse = F.coalesce(F.col("_f") < F.col("fitness"), F.lit(False))
    return after.join(b, [*by, "ind"], "left").select(
        *by, "ind",
        F.when(worse, F.col("_f")).otherwise(F.col("fitness")).alias("fitness"),
        F.when(worse, F.col("_r")).otherwise(F.col("rules")).alias("rules"),
    )


def next_generation(
    population: DataFrame, seed: int | Column, generation: int, size: int, tournament: int = 5, keep_unused: float = 0.2,
    max_rules: int = 100, rule_size: int = 6, low: float = -10.0, high: float = 10.0, diversity: float | None = None,
    rates: dict[str, float] | None = None, by: tuple[str, ...] = (),
) -> DataFrame:
    """(*by, ind, rules) of the next generation from (*by, ind, fitness, rules): the elite as 0, children after it.

    Individuals stay nested: a join brings the drawn ones to their tournaments, one grouping each; parents, children and
    mutants are expressions of a tournament's row.  The result is checkpointed, as whatever reads parts of the mutants would
    work these expressions out again for each.
    """
    checkpoints.ensure(population.sparkSession)
    rates = rates or {"add": 0.1, "remove": 0.1, "weight": 0.1, "insert": 0.1, "delete": 0.1}
    population = population.select(*by, "ind", "fitness", "rules")
    chosen = choose_parents(tournaments(population, size - 1, tournament, seed, generation, by), diversity)
    children = crossover(chosen, keep_unused, seed, generation, by)
    first = elite(population, by).select(*by, F.lit(0).alias("ind"), "rules")
    born = children.select(*by, (F.col("child") + 1).alias("ind"), trim(F.col("rules"), max_rules).alias("rules"))
    return mutate(first.unionByName(born), seed, generation, max_rules, rule_size, low, high, **rates, by=by).checkpoint()


def evaluator(
    sequences: DataFrame, metric: str = "RMSE", by: tuple[str, ...] = (), index: scoring.GramIndex | None = None
) -> Callable[[DataFrame], DataFrame]:
    """A function from (*by, ind, rules) to (*by, ind, fitness, test, rules): the metric on a learn set, statuses set anew.

    All models of all runs are scored in one pass, which also notes the rules that won; with ``index`` it reads the learn
    set's grams from there.  Without, the learn set is dealt out and checkpointed by the first evaluation and read as it lies by
    all of them.
    """
    if index is None:
        checkpoints.ensure(sequences.sparkSession)
    once = functools.cache(lambda: scoring.deal(sequences.select("seq_id", "sequence", "fitness")).checkpoint())

    def evaluate(individuals: DataFrame) -> DataFrame:
        keyed = individuals.withColumn("model_id", F.struct(*by, "ind") if by else F.col("ind"))
        rules = keyed.select("model_id", F.explode("rules").alias("r")).select("model_id", "r.*")
        words = scoring.bitmap_words(rules)
        learn = once() if index is None else sequences
        sums = scoring.model_sums(learn, rules, keyed, index, words, dealt=True)
        out = keyed.join(metrics.from_sums(sums, metric, keep=("won",)), "model_id")
        if words:
            marked = F.transform("rules", lambda r: r.withField("status", scoring.has_won(F.col("won"), r["rule_idx"])))
        else:  # rules beyond the bitmap are told apart one by one
            status = scoring.rule_status(learn, rules).groupBy("model_id")
            status = status.agg(F.array_sort(F.collect_list(F.struct("rule_idx", "pattern", "weight", "status"))).alias("_marked"))
            out, marked = out.join(status, "model_id", "left"), F.coalesce("_marked", "rules")
        return out.select(*by, "ind", F.col("train").alias("fitness"), "test", marked.cast(f"array<{RULE}>").alias("rules"))

    return evaluate


def log_rows(evaluated: DataFrame, generation: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The summary of one generation of (*by, ind, fitness, test, rules), a row for each run (0 if there is one alone)."""
    used = F.size(F.filter("rules", lambda r: r["status"] != 0))
    run = F.col(by[0]) if by else F.lit(0)
    return metrics.generation_summary(evaluated.select(
        run.alias("run"), F.lit(generation).alias("generation"), F.col("ind").alias("ind_idx"), "fitness", "test",
        F.size("rules").alias("rule_count"), used.alias("used_rule_count"),
    ))


def best_models(population: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The elite's rules of each run in the columns of a model file, whose index has no name."""
    r = flatten(elite(population, by), by)
    return r.select(*by, "rule_idx", "pattern", "weight", "status").toDF(*by, "", "pattern", "weight", "status")


def evolve(
    population: DataFrame, evaluate: Callable[[DataFrame], DataFrame], generations: int, size: int, seed: int | Column,
    log: str | None = None, model: str | None = None, state: str | None = None, by: tuple[str, ...] = (), **options,
) -> DataFrame:
    """(*by, ind, fitness, rules) after a bounded number of generations, of one run or of all runs at once.

    ``evaluate`` turns (*by, ind, rules) into (*by, ind, fitness, test, rules) with statuses.  Each generation's table is
    written, which cuts the lineage and survives the loss of executors.  With ``state``, a folder, each generation is
    committed there, and a call that finds commits of the same settings goes on after the last of them: what was committed
    is neither worked out nor written again.  Each generation's row is put into the CSV folder ``log`` under its run and
    generation, where a repeated write replaces its own row, and the best model so far replaces that in ``model``.
    """
    spark = population.sparkSession
    settings = {"size": size, "seed": str(seed), "by": list(by), **options}
    done = RunState(spark, state or f"{checkpoints.folder(spark)}/weft-run-{uuid.uuid4().hex}", settings)

    def commit(g: int, fresh: DataFrame, before: DataFrame | None) -> DataFrame:
        now = fresh
        if before is not None:
            best = elite(before, by).select(*by, F.lit(0).alias("ind"), "fitness", "rules")
            now = guard_elite(best, fresh, by)
        rows = log_rows(fresh, g, by)
        now = done.commit(g, now.select(*by, "ind", "fitness", "rules"), rows)
        publish(g, now)
        return now

    def publish(g: int, now: DataFrame) -> None:
        if log:
            files.put(done.log(g), log, "run", "generation")
        if model:
            files.overwrite(best_models(now, by), model, single=True, by=by)  # one model's rules for each run

    last = done.last()
    if last is None:
        last, now = 0, commit(0, done.kept(evaluate(done.kept(population))), None)
    else:
        now = done.table(last)
        publish(last, now)  # in case it ended between the commit and this
    for g in range(last + 1, generations + 1):
        fresh = done.kept(evaluate(next_generation(now, seed, g, size, by=by, **options)))
        now = commit(g, fresh, now)
    return now


def replicate_runs(
    spark: SparkSession, sequences: DataFrame, seeds: list[int], generations: int, size: int = 100, metric: str = "RMSE",
    max_rules: int = 100, rule_size: int = 6, low: float = -10.0, high: float = 10.0, index: scoring.GramIndex | None = None, **options,
) -> DataFrame:
    """(seed, ind, fitness, rules): independent runs on a learn set, one for each seed, as one program.

    Each is what the run of its seed alone gives.  ``options`` are those of ``evolve``.
    """
    runs = spark.createDataFrame([(s,) for s in seeds], "seed long")
    start = init_population(spark, size, max_rules, rule_size, low, high, 0, runs)
    return evolve(
        start, evaluator(sequences, metric, ("seed",), index), generations, size, F.col("seed"), by=("seed",),
        max_rules=max_rules, rule_size=rule_size, low=low, high=high, **options,
    )
