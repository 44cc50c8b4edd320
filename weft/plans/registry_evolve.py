"""Registered queries of the random steps of evolution and search, whose counter-based numbers SQL repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import evolve, search
from weft.plans import tables as T
from weft.plans.registry import _CHOICE, _HYDRO, _crossed, _draws, _entrants, _inputs, _lcg, _measured, query, r6

SEED, GENERATION, MAX_RULES, RULE_SIZE, LOW, HIGH = 5, 1, 100, T.MAX_PATTERN, -10.0, 10.0
_RULE = ("ind", "rule_idx", "pattern", "weight", "status")


def _u(seed: int, *slots: str) -> str:
    return f"({_lcg(seed, *slots)} / {evolve.PRIME}.0::DOUBLE)"


def _letter(seed: int, *slots: str) -> str:
    return f"substr('{evolve.ALPHABET}', CAST(1 + {_lcg(seed, *slots)} % {len(evolve.ALPHABET)} AS INTEGER), 1)"


def _random_rule(seed: int, idx: str, *slots: str) -> str:
    """pattern and weight of a new rule."""
    n = f"{_lcg(seed, *slots, idx, '0')} % {RULE_SIZE}"
    text = f"array_to_string(list_transform(range(1, 2 + {n}), lambda k: {_letter(seed, *slots, idx, 'k')}), '')"
    return f"{text} AS pattern, round({LOW}::DOUBLE + {_u(seed, *slots, idx, '99')} * {HIGH - LOW}::DOUBLE, 2) AS weight"


_RENUMBER = "CAST(row_number() OVER (PARTITION BY ind ORDER BY length(pattern) DESC, rule_idx) - 1 AS INTEGER) AS rule_idx"


def _mutate_ctes(src: str, seed: int, add: float = 0, remove: float = 0, weight: float = 0, insert: float = 0, delete: float = 0, who: str = "") -> str:
    """CTEs from src (ind, rule_idx, pattern, weight, status) to mutated, of the same columns; who: the individuals."""
    who = who or f"(SELECT DISTINCT ind FROM {src})"
    g = str(GENERATION)

    def u(*slots: str) -> str:
        return _u(seed, g, "ind", *slots)

    longer = f"""CASE WHEN {u('10', 'i')} < {insert} AND length(pattern) < {RULE_SIZE} THEN
    substr(pattern, 1, CAST(spot AS INTEGER)) || {_letter(seed, g, 'ind', '9', 'i')} || substr(pattern, CAST(spot AS INTEGER) + 1) ELSE pattern END"""
    return f"""sizes AS (SELECT w.ind, count(s.ind) AS n FROM {who} w LEFT JOIN {src} s ON s.ind = w.ind GROUP BY 1),
grown AS (SELECT ind, rule_idx, pattern, weight, status FROM {src} UNION ALL
  SELECT ind, n AS rule_idx, {_random_rule(seed, 'n', g, 'ind', '7')}, 0 AS status FROM sizes WHERE {u('1')} < {add} AND n < {MAX_RULES}),
m AS (SELECT ind, count(*) AS n FROM grown GROUP BY 1),
cut AS (SELECT ind, rule_idx, pattern, weight, status, row_number() OVER (PARTITION BY ind ORDER BY rule_idx) - 1 AS i FROM grown JOIN m USING (ind)
  WHERE NOT ({u('3')} < {remove} AND rule_idx = {_lcg(seed, g, 'ind', '2')} % n)),
one AS (SELECT ind, rule_idx, status, i, CASE WHEN {u('6', 'i')} < {weight} THEN weight + round({u('4', 'i')}, 2) * CASE WHEN {u('5', 'i')} < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END ELSE weight END AS weight,
  {longer} AS pattern FROM (SELECT *, {_lcg(seed, g, 'ind', '8', 'i')} % (length(pattern) + 1) AS spot FROM cut)),
two AS (SELECT ind, rule_idx, status, weight, CASE WHEN {u('12', 'i')} < {delete} THEN substr(pattern, 1, c - 1) || substr(pattern, c + 1) ELSE pattern END AS pattern
  FROM (SELECT *, CAST({_lcg(seed, g, 'ind', '11', 'i')} % greatest(length(pattern), 1) + 1 AS INTEGER) AS c FROM one)),
mutated AS (SELECT ind, {_RENUMBER}, pattern, round(weight, 6) AS weight, status FROM two WHERE length(pattern) > 0)"""


def _mutate_sql(**rates: float) -> str:
    return f"WITH {T.SQL_INDIVIDUALS}, {_mutate_ctes('inds', SEED, **rates)} SELECT ind, rule_idx, pattern, weight, status FROM mutated"


def _mutated(spark, d, **rates: float) -> DataFrame:
    none = dict.fromkeys(("add", "remove", "weight", "insert", "delete"), 0.0)
    n = evolve.mutate(evolve.nest(T.individuals(spark, d)), SEED, GENERATION, MAX_RULES, RULE_SIZE, LOW, HIGH, **(none | rates))
    return evolve.flatten(n).select("ind", "rule_idx", "pattern", F.round("weight", 6).alias("weight"), "status")


@query(_mutate_sql(add=0.5))
def add_rule(spark, d):
    return _mutated(spark, d, add=0.5)


@query(_mutate_sql(remove=0.5))
def remove_rule(spark, d):
    return _mutated(spark, d, remove=0.5)


@query(_mutate_sql(weight=0.5))
def change_weight(spark, d):
    return _mutated(spark, d, weight=0.5)


@query(_mutate_sql(insert=0.5))
def insert_letter(spark, d):
    return _mutated(spark, d, insert=0.5)


@query(_mutate_sql(delete=0.5))
def delete_letter(spark, d):
    return _mutated(spark, d, delete=0.5)


_ALL = dict(add=0.5, remove=0.5, weight=0.5, insert=0.5, delete=0.5)


@query(_mutate_sql(**_ALL))
def mutate_rules(spark, d):
    return _mutated(spark, d, **_ALL)


_STEP, _TENTH = 7, dict(add=0.1, remove=0.1, weight=0.1, insert=0.1, delete=0.1)


# No child has more than MAX_RULES rules here, so trimming, which trim_rules holds, changes nothing.
@query(f"""WITH {_entrants(39, 5, _STEP, GENERATION)}, {_CHOICE}, {_crossed(_STEP, GENERATION, 0.2)},
best AS (SELECT ind FROM pop ORDER BY fitness, ind LIMIT 1),
born AS (SELECT child + 1 AS ind, rule_idx, pattern, weight, status FROM crossed
  UNION ALL SELECT 0, rule_idx, pattern, weight, status FROM inds WHERE ind = (SELECT ind FROM best)),
{_mutate_ctes('born', _STEP, **_TENTH)} SELECT CAST(ind AS INTEGER) AS ind, rule_idx, pattern, weight, status FROM mutated""")
def evolve_step(spark, d):
    p = evolve.nest(T.individuals(spark, d)).join(T.population(spark, d), "ind")
    out = evolve.next_generation(p.select("ind", "fitness", "rules"), _STEP, GENERATION, size=40, diversity=0.5)
    return evolve.flatten(out).select("ind", "rule_idx", "pattern", F.round("weight", 6).alias("weight"), "status")


_KEEP = 8


@query(f"""WITH RECURSIVE {T.SQL_INDIVIDUALS},
n AS (SELECT ind, count(*) AS before, list({{'rule_idx': rule_idx, 'pattern': pattern, 'weight': weight, 'status': status}} ORDER BY rule_idx) AS rules FROM inds GROUP BY 1),
t AS (SELECT ind, before, rules FROM n UNION ALL
  SELECT ind, before, list_concat(rules[1:spot], rules[spot + 2:]) AS rules FROM (SELECT *, coalesce(
    list_max(list_filter(range(len(rules)), lambda i: i > (len(rules) - 1) // 2 AND rules[i + 1].status = 0)), (len(rules) - 1) // 2) AS spot FROM t WHERE len(rules) > {_KEEP})),
r AS (SELECT ind, before, unnest(rules) AS r, unnest(range(len(rules))) AS place FROM t WHERE len(rules) <= {_KEEP})
SELECT ind, CAST(before AS INTEGER) AS before, CAST(place AS INTEGER) AS place, r.rule_idx AS rule_idx, r.pattern AS pattern, r.weight AS weight, r.status AS status FROM r""")
def trim_rules(spark, d):
    n = evolve.nest(T.individuals(spark, d))
    n = n.select("ind", F.size("rules").alias("before"), evolve.trim(F.col("rules"), _KEEP).alias("rules"))
    return n.select("ind", "before", F.posexplode("rules").alias("place", "r")).select("ind", "before", "place", "r.*")


_INIT = 40


@query(f"""WITH runs AS (SELECT n_nationkey + 110 AS seed FROM nation),
c AS (SELECT seed, CAST(ind AS INTEGER) AS ind, unnest(range(1 + {_lcg('seed', '0', 'ind', '-1')} % 33)) AS rule_idx FROM runs, range({_INIT}) t(ind)),
r AS (SELECT seed, ind, rule_idx, {_random_rule('seed', 'rule_idx', '0', 'ind')} FROM c)
SELECT seed, ind, {_RENUMBER.replace("PARTITION BY ind", "PARTITION BY seed, ind")}, pattern, round(weight, 6) AS weight, 0 AS status FROM r""")
def init_models(spark, d):
    """A population for each run; there is a run for each nation."""
    runs = T.read(spark, d, "nation").select((F.col("n_nationkey") + 110).cast("long").alias("seed"))
    p = evolve.flatten(evolve.init_population(spark, _INIT, 100, RULE_SIZE, LOW, HIGH, 0, runs), ("seed",))
    return p.select("seed", "ind", "rule_idx", "pattern", F.round("weight", 6).alias("weight"), "status")


_SEEDS, _POP, _FEW, _TINY = (5, 9), 8, 12, dict(add=0.1, remove=0.1, weight=0.1, insert=0.1, delete=0.1)
_ALL_INDS = f"(SELECT CAST(k AS INTEGER) AS ind FROM range({_POP}) t(k))"


def _one_run(seed: int) -> str:
    """One run of one generation: initialised, measured, a generation on, measured, and the elite guarded."""
    return f"""SELECT CAST({seed} AS BIGINT) AS seed, * FROM (WITH
c AS (SELECT CAST(ind AS INTEGER) AS ind, unnest(range(1 + {_lcg(seed, '0', 'ind', '-1')} % {_FEW // 3})) AS rule_idx FROM range({_POP}) t(ind)),
r AS (SELECT ind, rule_idx, {_random_rule(seed, 'rule_idx', '0', 'ind')} FROM c),
start AS MATERIALIZED (SELECT ind, {_RENUMBER}, pattern, weight FROM r), {_measured("start", "pop")},
inds AS MATERIALIZED (SELECT s.ind, s.rule_idx, pattern, weight, CAST(w.rule_idx IS NOT NULL AS INTEGER) AS status
  FROM start s LEFT JOIN pop_won w ON w.ind = s.ind AND w.rule_idx = s.rule_idx),
{_draws(_POP - 1, 5, seed, 1)}, {_CHOICE}, {_crossed(seed, 1, 0.2)},
best AS (SELECT ind, fitness FROM pop ORDER BY fitness, ind LIMIT 1),
born AS (SELECT CAST(child + 1 AS INTEGER) AS ind, rule_idx, pattern, weight, status FROM crossed
  UNION ALL SELECT 0, rule_idx, pattern, weight, status FROM inds WHERE ind = (SELECT ind FROM best)),
{_mutate_ctes('born', seed, **_TINY, who=_ALL_INDS)}, {_measured("mutated", "after", _ALL_INDS)}
SELECT a.ind, round(least(a.fitness, CASE WHEN a.ind = 0 THEN b.fitness ELSE a.fitness END), 6) AS fitness,
  CASE WHEN a.ind = 0 AND b.fitness < a.fitness THEN (SELECT count(*) FROM inds WHERE ind = b.ind) ELSE (SELECT count(*) FROM mutated m WHERE m.ind = a.ind) END AS rules
FROM after a, best b)"""


# The children of these seeds have few enough rules to be left as they are by trimming.
@query(f"WITH {T.SQL_SEQUENCES} " + " UNION ALL ".join(_one_run(s) for s in _SEEDS))
def replicate_runs(spark, d):
    """Whole runs of two seeds, one generation each, as one program."""
    out = evolve.replicate_runs(
        spark, T.sequences(spark, d), list(_SEEDS), 1, _POP, max_rules=_FEW, rule_size=RULE_SIZE, low=LOW, high=HIGH, diversity=0.5, rates=_TINY
    )
    return out.select("seed", "ind", r6("fitness"), F.size("rules").cast("long").alias("rules"))


@query(f"WITH {T.SQL_POPULATION} SELECT ind, fitness FROM pop ORDER BY fitness, ind LIMIT 1")
def elite(spark, d):
    return evolve.elite(T.population(spark, d))


@query(f"""WITH {T.SQL_INDIVIDUALS}, {T.SQL_POPULATION}, a AS (SELECT ind, fitness AS f, (ind * 31 % 101) / 4.0::DOUBLE AS g FROM pop)
SELECT ind, least(f, g) AS fitness, CASE WHEN f < g THEN 'before' ELSE 'after' END AS source, count(i.ind) AS rules
FROM a LEFT JOIN inds i USING (ind) GROUP BY ind, f, g""")
def elite_guard(spark, d):
    p = evolve.nest(T.individuals(spark, d)).join(T.population(spark, d), "ind", "right")
    before = p.select("ind", "fitness", F.struct(F.lit("before").alias("source"), "rules").alias("rules"))
    after = p.select("ind", ((F.col("ind") * 31 % 101) / F.lit(4.0)).alias("fitness"), F.struct(F.lit("after").alias("source"), "rules").alias("rules"))
    out = evolve.guard_elite(before, after)
    n = F.coalesce(F.size("rules.rules"), F.lit(0)).cast("long")
    return out.select("ind", "fitness", F.col("rules.source").alias("source"), F.greatest(n, F.lit(0).cast("long")).alias("rules"))


def _score_sql(x: str) -> str:
    """CTEs from x (id, sequence) to x_v (id, sequence, score)."""
    return f"""{x}_g AS (SELECT id, pos, substr(sequence, pos, k) AS gram FROM (SELECT id, sequence, unnest(range(1, length(sequence) + 1)) AS pos FROM {x})
  CROSS JOIN lens WHERE pos + k - 1 <= length(sequence)),
{x}_h AS (SELECT id, model_id, pos, arg_min(weight, rule_idx) AS weight FROM {x}_g JOIN strings USING (gram) GROUP BY 1, 2, 3),
{x}_s AS (SELECT id, sum(weight) AS s FROM {x}_h GROUP BY 1),
{x}_v AS (SELECT id, sequence, CASE WHEN list_reduce(list_transform(string_split(sequence, ''), lambda c: {_HYDRO}), lambda a, b: a + b) < 0
  THEN coalesce(s, 0.0) / (SELECT count(DISTINCT model_id) FROM rules) ELSE 0.0 END AS score FROM {x} LEFT JOIN {x}_s USING (id))"""


_SIZE, _CLIMB, _STEPS = 12, 3, 3

_POOL = f"""c0 AS MATERIALIZED (SELECT c_custkey AS id, array_to_string(list_transform(range(1, {_SIZE + 1}), lambda k: {_letter(_CLIMB, 'c_custkey', 'k')}), '') AS sequence FROM customer)"""
_STRINGS = """strings AS MATERIALIZED (SELECT DISTINCT model_id, rule_idx, weight, unnest([pattern, reverse(pattern)]) AS gram FROM rules),
lens AS (SELECT DISTINCT length(gram) AS k FROM strings)"""


def _step_sql(i: int) -> str:
    """CTEs from c{i-1}_v (id, sequence, score) to c{i}_v after one mutation each."""
    b = f"c{i - 1}_v"
    return f"""m{i} AS MATERIALIZED (SELECT id, substr(sequence, 1, spot - 1) || {_letter(_CLIMB, str(i), 'id', '2')} || substr(sequence, spot + 1) AS sequence
  FROM (SELECT *, CAST(1 + {_lcg(_CLIMB, str(i), 'id', '1')} % length(sequence) AS INTEGER) AS spot FROM {b})),
{_score_sql(f'm{i}')},
c{i}_v AS MATERIALIZED (SELECT id, CASE WHEN g > f THEN new ELSE old END AS sequence, CASE WHEN g > f THEN g ELSE f END AS score FROM (
  SELECT c.id, c.sequence AS old, m.sequence AS new, c.score AS f, CASE WHEN EXISTS (SELECT 1 FROM seqs q WHERE q.sequence = m.sequence) THEN 0.0 ELSE m.score END AS g
  FROM {b} c JOIN m{i}_v m USING (id)))"""


def _climb_sql(steps: int) -> str:
    return f"""WITH {T.SQL_SEQUENCES}, {T.SQL_RULES}, {_STRINGS}, {_POOL}, {_score_sql('c0')}, {', '.join(_step_sql(i) for i in range(1, steps + 1))}
SELECT id AS cand_id, sequence, round(score, 6) AS fitness FROM c{steps}_v"""


def _pool(spark, d) -> DataFrame:
    """A candidate for each customer."""
    ids = T.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("cand_id"))
    return search.candidates_for(ids, _SIZE, _CLIMB)


@query(_climb_sql(1))
def search_step(spark, d):
    s, r = _inputs(spark, d)
    c = _pool(spark, d)
    start = search.ensemble_score(c.select(F.col("cand_id").alias("seq_id"), "sequence"), r)
    c = c.join(start.select(F.col("seq_id").alias("cand_id"), F.col("score").alias("fitness")), "cand_id")
    return search.climb_step(c, r, s, _CLIMB, 1).select("cand_id", "sequence", F.round("fitness", 6).alias("fitness"))


@query(_climb_sql(_STEPS))
def climb_loop(spark, d):
    """Several steps, each of which scores anew only what its mutation may change."""
    s, r = _inputs(spark, d)
    return search.climb(_pool(spark, d), r, s, _STEPS, _CLIMB).select("cand_id", "sequence", F.round("fitness", 6).alias("fitness"))


@query(f"WITH {_POOL} SELECT id AS cand_id, sequence FROM c0")
def candidate_pool(spark, d):
    return _pool(spark, d)
