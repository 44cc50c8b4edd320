"""Registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import scalars
from weft.operators import crud, evolve, metrics, ordering, reports, scoring, search
from weft.plans import tables as T
from weft.plans.row_index import ordered_index

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name).cast("double"), 6).alias(alias or name)


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return T.sequences(spark, d), T.rules(spark, d)


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return scoring.predictions(*_inputs(spark, d))


@query(f"WITH {T.SQL_HITS} SELECT model_id, seq_id, score, hits FROM preds")
def score_models(spark, d):
    return scoring.score(*_inputs(spark, d))


@query(f"WITH {T.SQL_SCORED} SELECT model_id, seq_id, 0.0::DOUBLE AS score, hits FROM scored")
def score_product_mode(spark, d):
    return scoring.score(*_inputs(spark, d), mode=scoring.PRODUCT)


@query(f"WITH {T.SQL_SCORED} SELECT model_id, seq_id, score, fitness, abs(score - fitness) AS error FROM scored")
def abs_error(spark, d):
    return _predictions(spark, d)


@query(f"""WITH {T.SQL_HITS}, won AS (SELECT DISTINCT model_id, rule_idx FROM hits)
SELECT r.model_id, r.rule_idx, r.pattern, r.weight, CAST(w.rule_idx IS NOT NULL AS INTEGER) AS status
FROM rules r LEFT JOIN won w ON w.model_id = r.model_id AND w.rule_idx = r.rule_idx""")
def rule_status(spark, d):
    return scoring.rule_status(*_inputs(spark, d))


@query(f"""WITH {T.SQL_HITS}, won AS (SELECT DISTINCT model_id, rule_idx FROM hits)
SELECT r.model_id, count(*) AS rule_count, CAST(count(w.rule_idx) AS BIGINT) AS used_rule_count
FROM rules r LEFT JOIN won w ON w.model_id = r.model_id AND w.rule_idx = r.rule_idx GROUP BY 1""")
def used_rule_count(spark, d):
    return scoring.used_rule_count(scoring.rule_status(*_inputs(spark, d)))


@query(f"""WITH {T.SQL_HITS}, won AS (SELECT DISTINCT model_id, rule_idx FROM hits)
SELECT model_id, rule_idx, pattern, weight, 1 AS status FROM rules JOIN won USING (model_id, rule_idx)""")
def drop_unused_rules(spark, d):
    return scoring.drop_unused(scoring.rule_status(*_inputs(spark, d)))


@query(f"""WITH {T.SQL_HITS}, g AS (SELECT model_id, count(*) AS n, sum(power(score - fitness, 2)) AS sse FROM preds GROUP BY 1)
SELECT model_id, n, round(CASE WHEN n >= 10 THEN sqrt(9 * sse / (10 * (n - n // 10))) END, 6) AS train,
  round(CASE WHEN n >= 10 THEN sqrt(sse / (10 * (n // 10))) END, 6) AS test FROM g""")
def rmse_cv10(spark, d):
    return metrics.rmse_cv10(_predictions(spark, d)).select("model_id", "n", r6("train"), r6("test"))


def _indexed(spark, d):
    """Predictions with row_idx: the place of the sequence among all, ordered by the sequence."""
    s, r = _inputs(spark, d)
    return scoring.predictions(ordered_index(s, "sequence"), r, carry=("sequence", "row_idx"))


_IDX = "idx AS (SELECT seq_id, row_number() OVER (ORDER BY sequence) - 1 AS row_idx FROM seqs)"


@query(f"""WITH {T.SQL_HITS}, {_IDX}, p AS (SELECT *, count(*) OVER (PARTITION BY model_id) AS n FROM preds JOIN idx USING (seq_id))
SELECT model_id, CAST(least(9, floor(row_idx / (n / 10.0::DOUBLE))) AS INTEGER) AS chunk, count(*) AS n,
  round(sum(power(score - fitness, 2)), 6) AS sse FROM p GROUP BY 1, 2""")
def rmse_chunks(spark, d):
    return metrics.rmse_chunks(_indexed(spark, d).checkpoint()).select("model_id", "chunk", "n", r6("sse"))


@query(f"WITH {T.SQL_HITS} SELECT model_id, round(sqrt(avg(power(score - fitness, 2))), 6) AS rmse FROM preds GROUP BY 1")
def rmse_plain(spark, d):
    return metrics.rmse_plain(_predictions(spark, d)).select("model_id", r6("rmse"))


@query(f"""WITH {T.SQL_HITS} SELECT model_id, round(coalesce(1 - power(CASE WHEN min(score) <> max(score) AND min(fitness) <> max(fitness)
  THEN corr(score, fitness) END, 2), 1.0), 6) AS fitness_value, 0.0::DOUBLE AS test_value FROM preds GROUP BY 1""")
def corr_fitness(spark, d):
    return metrics.correlation_fitness(_predictions(spark, d)).select("model_id", r6("fitness_value"), "test_value")


_FIT = """fit AS (SELECT model_id, CASE WHEN min(score) = max(score) THEN 0.0 ELSE regr_slope(fitness, score) END AS slope,
  CASE WHEN min(score) = max(score) THEN avg(fitness) ELSE regr_intercept(fitness, score) END AS intercept FROM preds GROUP BY 1)"""


@query(f"WITH {T.SQL_HITS}, {_FIT} SELECT model_id, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM fit")
def linear_calibration(spark, d):
    return metrics.calibration(_predictions(spark, d)).select("model_id", r6("slope"), r6("intercept"))


_WIDE = ", ".join(f'''round(max(CASE WHEN model_id = {m} THEN score END), 2) AS "m{m}"''' for m in range(T.MODELS))


@query(f"""WITH {T.SQL_HITS}, {_IDX} SELECT row_idx, seq_id AS sequence, fitness, {_WIDE} FROM preds JOIN idx USING (seq_id) GROUP BY 1, 2, 3""")
def model_vs_dataset_wide(spark, d):
    p = metrics.calibrated(_indexed(spark, d), "RMSE")
    wide = metrics.wide_table(p, list(range(T.MODELS)))
    return wide.toDF("row_idx", "sequence", "fitness", *[f"m{m}" for m in range(T.MODELS)])


@query(f"""WITH {T.SQL_HITS}, g AS (SELECT model_id, sqrt(avg(power(score - fitness, 2))) AS value FROM preds GROUP BY 1)
SELECT arg_min(model_id, value) AS best_model, round(min(value), 6) AS best_value, round(avg(value), 6) AS average FROM g""")
def compare_models(spark, d):
    m = metrics.rmse_plain(_predictions(spark, d)).withColumnRenamed("rmse", "value")
    return metrics.compare(m).select("best_model", r6("best_value"), r6("average"))


@query(f"""WITH {T.SQL_HITS}, won AS (SELECT DISTINCT model_id, rule_idx FROM hits)
SELECT r.model_id, round(avg(CASE WHEN w.rule_idx IS NOT NULL THEN length(pattern) END), 6) AS average_length
FROM rules r LEFT JOIN won w ON w.model_id = r.model_id AND w.rule_idx = r.rule_idx GROUP BY 1""")
def avg_used_rule_length(spark, d):
    return metrics.average_used_rule_length(scoring.rule_status(*_inputs(spark, d))).select("model_id", r6("average_length"))


def _individual_log(spark, d):
    """(run, generation, ind_idx, fitness, test, rule_count, used_rule_count) of events: 8 runs, generations of equal days."""
    e = T.read(spark, d, "events")
    return e.select(
        (F.col("user_id") % 8).alias("run"), F.dayofyear("ts").alias("generation"), F.col("event_id").alias("ind_idx"),
        F.floor(F.col("value") * 4).cast("double").alias("fitness"), F.floor(F.col("value") * 8).cast("double").alias("test"),
        (F.col("event_id") % 90 + 10).alias("rule_count"), (F.col("event_id") % 37).alias("used_rule_count"),
    )


@query("""WITH i AS (SELECT user_id % 8 AS run, dayofyear(ts) AS generation, event_id AS ind_idx, floor(value * 4)::DOUBLE AS fitness,
  floor(value * 8)::DOUBLE AS test, event_id % 90 + 10 AS rule_count, event_id % 37 AS used_rule_count FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY run, generation ORDER BY fitness, ind_idx) AS r FROM i)
SELECT run, CAST(generation AS INTEGER) AS generation, max(CASE WHEN r = 1 THEN fitness END) AS best_fitness, max(CASE WHEN r = 1 THEN test END) AS best_test,
  max(CASE WHEN r = 1 THEN rule_count END) AS best_rule_count, max(CASE WHEN r = 1 THEN used_rule_count END) AS best_used_rule_count,
  round_even(avg(fitness), 3) AS avg_fitness, round_even(avg(test), 3) AS avg_test,
  round_even(avg(rule_count), 0) AS avg_rule_count, round_even(avg(used_rule_count), 0) AS avg_used_rule_count FROM b GROUP BY 1, 2""")
def generation_summary(spark, d):
    return metrics.generation_summary(_individual_log(spark, d))


def _motifs(spark, d):
    return T.individuals(spark, d).withColumnRenamed("ind", "file")


@query(f"""WITH {T.SQL_INDIVIDUALS} SELECT pattern, count(DISTINCT ind) AS frequency FROM inds WHERE status <> 0
GROUP BY 1 HAVING count(DISTINCT ind) > 5""")
def motif_doc_freq(spark, d):
    return reports.motif_document_frequency(_motifs(spark, d))


@query(f"""WITH {T.SQL_INDIVIDUALS}, g AS (SELECT pattern, count(*) AS times FROM inds WHERE status <> 0 GROUP BY 1)
SELECT times, count(*) AS motifs FROM g GROUP BY 1""")
def motif_count_hist(spark, d):
    return reports.motif_count_histogram(_motifs(spark, d))


@query(f"""WITH {T.SQL_EVOLUTION} SELECT generation, round(quantile_cont(best_fitness, 0.25), 6) AS q25,
  round(quantile_cont(best_fitness, 0.5), 6) AS median, round(quantile_cont(best_fitness, 0.75), 6) AS q75 FROM evo GROUP BY 1""")
def evo_quartiles(spark, d):
    return reports.quartile_band(T.evolution(spark, d)).select("generation", r6("q25"), r6("median"), r6("q75"))


@query(f"""WITH {T.SQL_EVOLUTION}, n AS (SELECT run FROM evo GROUP BY run HAVING count(*) >= 5)
SELECT run % 8 AS epoch, generation, round(median(best_fitness), 6) AS median FROM evo JOIN n USING (run) GROUP BY 1, 2""")
def evo_median_epochs(spark, d):
    e = T.evolution(spark, d).withColumn("epoch", F.col("run") % 8)
    return reports.median_surface(e, generations=5).select("epoch", "generation", r6("median"))


@query(f"""WITH {T.SQL_EVOLUTION}, r AS (SELECT run, run % 8 AS epoch, row_number() OVER (PARTITION BY run % 8 ORDER BY run) AS k
  FROM (SELECT DISTINCT run FROM evo))
SELECT epoch, generation, round(median(best_fitness), 6) AS median FROM evo JOIN r USING (run) WHERE k <= 8 GROUP BY 1, 2""")
def evo_median_first_runs(spark, d):
    e = T.evolution(spark, d).withColumn("epoch", F.col("run") % 8)
    return reports.median_surface(e, first_runs=8).select("epoch", "generation", r6("median"))


@query(f"""WITH {T.SQL_EVOLUTION}, n AS (SELECT run FROM evo GROUP BY run HAVING count(*) >= 5)
SELECT run, generation, round(best_fitness, 6) AS best_fitness FROM evo JOIN n USING (run)""")
def complete_runs(spark, d):
    return reports.complete_runs(T.evolution(spark, d), 5).select("run", "generation", r6("best_fitness"))


@query(f"WITH {T.SQL_EVOLUTION} SELECT run, count(*) AS n FROM evo GROUP BY 1 HAVING count(*) < 66")
def rejected_runs(spark, d):
    return reports.complete_runs(T.evolution(spark, d), 66, complete=False)


@query(f"""WITH {T.SQL_EVOLUTION} SELECT run AS best_run, round(best_fitness, 6) AS best_fitness FROM evo WHERE generation = 2
ORDER BY evo.best_fitness DESC, run LIMIT 1""")
def best_at_gen(spark, d):
    return reports.best_at_generation(T.evolution(spark, d), 2).select("best_run", r6("best_fitness"))


@query(f"""WITH {T.SQL_EVOLUTION} SELECT run, generation AS x, round(best_fitness, 6) AS y, 1 AS part FROM evo
UNION ALL SELECT run, min(generation), 0.0, 0 FROM evo GROUP BY run UNION ALL SELECT run, max(generation), 0.0, 2 FROM evo GROUP BY run""")
def polygon_closure(spark, d):
    p = T.evolution(spark, d).select("run", F.col("generation").alias("x"), F.col("best_fitness").alias("y"))
    return reports.polygon(p).select("run", "x", r6("y"), "part")


@query(f"""WITH {T.SQL_HITS}, {_IDX}, p AS (SELECT model_id, row_idx + 1 AS a,
  row_number() OVER (PARTITION BY model_id ORDER BY score DESC, row_idx) AS p FROM preds JOIN idx USING (seq_id))
SELECT model_id, CAST(sum(CASE WHEN p <= 10 AND a <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS in_top, round(avg(abs(p - a)), 6) AS mean_error,
  round(corr(p, a), 6) AS rank_correlation FROM p GROUP BY 1""")
def rank_agreement(spark, d):
    return reports.rank_agreement(_indexed(spark, d)).select("model_id", "in_top", r6("mean_error"), r6("rank_correlation"))


@query(f"""WITH {T.SQL_HITS} SELECT model_id, count(*) AS n, round(avg(abs(score - fitness)), 6) AS mae,
  round(corr(score, fitness), 6) AS pearson FROM preds GROUP BY 1""")
def result_footer(spark, d):
    p = _predictions(spark, d).withColumnRenamed("score", "prediction")
    return metrics.footer(p, "model_id").select("model_id", "n", r6("mae"), r6("pearson"))


@query(f"""WITH {T.SQL_RULES} SELECT model_id, pattern, weight, CAST(row_number() OVER (PARTITION BY model_id
  ORDER BY length(pattern) DESC, 1000000 - rule_idx) - 1 AS INTEGER) AS rule_idx FROM rules""")
def sort_rules(spark, d):
    r = T.rules(spark, d).withColumn("rule_idx", 1000000 - F.col("rule_idx"))
    return ordering.sort_rules(r).select("model_id", "pattern", "weight", "rule_idx")


@query(f"WITH {T.SQL_SEQUENCES} SELECT seq_id AS cand_id, sequence, fitness FROM seqs ORDER BY fitness DESC, seq_id LIMIT 10")
def top_candidates(spark, d):
    return ordering.top_candidates(T.sequences(spark, d).withColumnRenamed("seq_id", "cand_id"))


_LINES = """lines AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line_no,
  event_type AS line, CAST(event_id % 7 AS INTEGER) AS generation FROM events)"""


def _lines(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return T.read(spark, d, "events").select(
        F.col("user_id").alias("file"), (F.row_number().over(order) - 1).alias("line_no"),
        F.concat(F.lit(" "), F.col("event_type"), F.lit("  ")).alias("line"), (F.col("event_id") % 7).cast("int").alias("generation"),
    )


@query(f"""WITH {_LINES}, l AS (SELECT *, lag(line, 1, '') OVER (PARTITION BY file ORDER BY line_no) AS before FROM lines)
SELECT file, line_no, line FROM l WHERE line <> before""")
def adjacent_dedup(spark, d):
    return reports.adjacent_distinct(_lines(spark, d).select("file", "line_no", "line"))


@query(f"""WITH {_LINES}, l AS (SELECT *, coalesce(min(generation) OVER (PARTITION BY file ORDER BY line_no DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100000000) AS least FROM lines)
SELECT file, line_no, generation FROM l WHERE generation < least""")
def log_repair(spark, d):
    return reports.repair_log(_lines(spark, d).select("file", "line_no", "generation"))


@query("""SELECT event_id AS file, CAST(user_id AS INTEGER) AS generation, floor(value * 4)::DOUBLE AS best_fitness, (event_id % 37)::DOUBLE AS avg_used_rule_count FROM events""")
def log_parse(spark, d):
    e = T.read(spark, d, "events")
    s = e.select(F.col("event_id").alias("file"), F.col("user_id").alias("generation"),
                 *[F.floor(F.col("value") * 4).cast("double").alias(f) for f in reports.LOG_FIELDS[:-1]],
                 (F.col("event_id") % 37).cast("double").alias(reports.LOG_FIELDS[-1]))
    return reports.parse_log(reports.format_log(s)).select("file", "generation", "best_fitness", "avg_used_rule_count")


_HYDRO = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in search.HYDROPATHY.items()) + " END"
_SOLUBLE = f"""sol AS (SELECT seq_id, list_reduce(list_transform(string_split(sequence, ''), lambda c: {_HYDRO}), lambda a, b: a + b) AS h FROM seqs)"""


@query(f"WITH {T.SQL_SEQUENCES}, {_SOLUBLE} SELECT seq_id, round(h, 6) AS hydropathy, h < 0 AS soluble FROM sol")
def hydrophobic_filter(spark, d):
    h = F.round(search.hydropathy("sequence"), 6)
    return T.sequences(spark, d).select("seq_id", h.alias("hydropathy"), search.soluble("sequence").alias("soluble"))


@query(f"""WITH {T.SQL_SEQUENCES}, {T.SQL_ITEM_WORDS} SELECT sequence FROM seqs
WHERE NOT EXISTS (SELECT 1 FROM item_words WHERE pattern = sequence)""")
def novel_candidates(spark, d):
    known = T.read(spark, d, "benchmark").select(F.explode(T._words("text")).alias("sequence"))
    return search.novel(T.sequences(spark, d).select("sequence"), known)


@query(f"""WITH {T.SQL_HITS}, {_SOLUBLE} SELECT seq_id, CASE WHEN h < 0 THEN sum(score) / (SELECT count(*) FROM models) ELSE 0.0 END AS score
FROM preds JOIN sol USING (seq_id) GROUP BY seq_id, h""")
def ensemble_score(spark, d):
    return search.ensemble_score(*_inputs(spark, d))


def _lcg(seed: int, *slots: str) -> str:
    h = str(seed)
    for s in slots:
        h = f"(((((({h}) * 48271 + ({s})::BIGINT * 69621 + 40692) % {evolve.PRIME} + {evolve.PRIME}) % {evolve.PRIME}) * 16807 + 12345) % {evolve.PRIME})"
    return h


_CHILDREN, _SIZE, _SEED = 24, 5, 17


def _draws(children: int, size: int, seed: int, generation: int) -> str:
    """CTEs from pop and inds to judged, the entrants by place with their closeness."""
    return f"""numbered AS (SELECT *, row_number() OVER (ORDER BY ind) - 1 AS num FROM pop),
entrants AS (SELECT CAST(child AS INTEGER) AS child, CAST(draw AS INTEGER) AS draw, ind, fitness FROM
  (SELECT child, draw, {_lcg(seed, str(generation), 'child', 'draw')} % (SELECT count(*) FROM pop) AS num
   FROM range({children}) c(child), range({size}) e(draw)) JOIN numbered USING (num)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY fitness, draw) AS place FROM entrants),
close AS (SELECT r.child, r.draw, count(*) AS c FROM ranked r JOIN inds i ON i.ind = r.ind
  JOIN ranked b ON b.child = r.child AND b.place = 1
  WHERE EXISTS (SELECT 1 FROM inds x WHERE x.ind = b.ind AND x.pattern = i.pattern) GROUP BY 1, 2),
judged AS (SELECT r.*, coalesce(c, 0) AS closeness FROM ranked r LEFT JOIN close USING (child, draw))"""


def _entrants(children: int, size: int, seed: int, generation: int) -> str:
    return f"{T.SQL_POPULATION}, {T.SQL_INDIVIDUALS}, {_draws(children, size, seed, generation)}"


_ENTRANTS = _entrants(_CHILDREN, _SIZE, _SEED, 0)


def _tournaments(spark, d) -> DataFrame:
    p = T.population(spark, d).join(evolve.nest(T.individuals(spark, d)), "ind", "left")
    return evolve.tournaments(p, _CHILDREN, _SIZE, _SEED)


@query(f"WITH {_ENTRANTS} SELECT child, draw, ind, fitness, place FROM ranked")
def tournament(spark, d):
    e = _tournaments(spark, d).select("child", F.posexplode("entrants").alias("place", "e"))
    return e.select("child", "e.draw", "e.ind", "e.fitness", (F.col("place") + 1).cast("long").alias("place"))


@query(f"WITH {_ENTRANTS} SELECT child, draw, ind, closeness FROM judged")
def pattern_overlap(spark, d):
    return _tournaments(spark, d).select("child", F.explode("entrants").alias("e")).select("child", "e.draw", "e.ind", "e.closeness")


_CHOICE = """tops AS (SELECT child, max(fitness) FILTER (place > 1) AS mf, max(closeness) FILTER (place > 1) AS mc FROM judged GROUP BY 1),
valued AS (SELECT j.*, CASE WHEN mc = 0 THEN fitness ELSE coalesce(fitness / nullif(mf, 0), 0.0) + 0.5 * closeness / nullif(mc, 0)::DOUBLE END AS value FROM judged j JOIN tops USING (child)),
parents AS (SELECT child, max(ind) FILTER (place = 1) AS parent_a, max(ind) FILTER (k = 1) AS parent_b FROM
  (SELECT *, CASE WHEN place > 1 THEN row_number() OVER (PARTITION BY child, place > 1 ORDER BY value, place) END AS k FROM valued) GROUP BY 1)"""
_PARENTS = f"{_ENTRANTS}, {_CHOICE}"


def _crossed(seed: int, generation: int, keep: float) -> str:
    """CTE crossed (child, rule_idx, pattern, weight, status) after parents."""
    return f"""sides AS (SELECT child, 0 AS side, i.* FROM parents JOIN inds i ON ind = parent_a
  UNION ALL SELECT child, 1, i.* FROM parents JOIN inds i ON ind = parent_b),
crossed AS (SELECT child, CAST(row_number() OVER (PARTITION BY child ORDER BY length(pattern) DESC, rule_idx, side) - 1 AS INTEGER) AS rule_idx, pattern, weight, status
  FROM sides WHERE status = 1 OR {_lcg(seed, str(generation), 'child', 'rule_idx', 'side')} / {evolve.PRIME}.0::DOUBLE < {keep})"""


@query(f"WITH {_PARENTS} SELECT child, parent_a, parent_b FROM parents")
def tournament_diversity(spark, d):
    p = evolve.choose_parents(_tournaments(spark, d), diversity=0.5)
    return p.select("child", F.col("parent_a.ind").alias("parent_a"), F.col("parent_b.ind").alias("parent_b"))


@query(f"WITH {_PARENTS}, {_crossed(_SEED, 0, 0.2)} SELECT child, rule_idx, pattern, weight, status FROM crossed")
def crossover_interleave(spark, d):
    c = evolve.crossover(evolve.choose_parents(_tournaments(spark, d), diversity=0.5), 0.2, _SEED)
    return c.select("child", F.explode("rules").alias("r")).select("child", "r.*")


@query(f"""WITH {T.SQL_INDIVIDUALS}, k AS (SELECT *, sum(CASE WHEN status = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ind, pattern) AS used,
  row_number() OVER (PARTITION BY ind, pattern ORDER BY rule_idx DESC) AS last FROM inds)
SELECT ind, rule_idx, pattern, weight, status FROM k WHERE status = 1 OR (used = 0 AND last = 1)""")
def duplicate_rules(spark, d):
    return evolve.remove_duplicates(T.individuals(spark, d))


def _measured(src: str, out: str, who: str = "") -> str:
    """CTEs from src (ind, rule_idx, pattern, weight) and seqs to out (ind, fitness, test) and out_won (ind, rule_idx)."""
    who = who or f"(SELECT DISTINCT ind FROM {src})"
    return f"""{out}_s AS (SELECT DISTINCT ind, rule_idx, weight, unnest([pattern, reverse(pattern)]) AS gram FROM {src}),
{out}_l AS (SELECT DISTINCT length(gram) AS k FROM {out}_s),
{out}_g AS (SELECT seq_id, pos, substr(sequence, pos, k) AS gram
  FROM (SELECT seq_id, sequence, unnest(range(1, length(sequence) + 1)) AS pos FROM seqs) CROSS JOIN {out}_l WHERE pos + k - 1 <= length(sequence)),
{out}_h AS MATERIALIZED (SELECT ind, seq_id, pos, min(rule_idx) AS rule_idx, arg_min(weight, rule_idx) AS weight FROM {out}_g JOIN {out}_s USING (gram) GROUP BY 1, 2, 3),
{out}_won AS (SELECT DISTINCT ind, rule_idx FROM {out}_h),
{out}_p AS (SELECT ind, seq_id, sum(weight) AS s FROM {out}_h GROUP BY 1, 2),
{out}_e AS (SELECT i.ind, count(*) AS n, sum(power(coalesce(s, 0) - fitness, 2)) AS sse FROM seqs q CROSS JOIN {who} i
  LEFT JOIN {out}_p p ON p.ind = i.ind AND p.seq_id = q.seq_id GROUP BY 1),
{out} AS MATERIALIZED (SELECT ind, sqrt(9 * sse / (10 * (n - n // 10))) AS fitness, sqrt(sse / (10 * (n // 10))) AS test FROM {out}_e)"""


_EVALUATED = f"""WITH {T.SQL_SEQUENCES}, {T.SQL_INDIVIDUALS}, {_measured("inds", "g")}
SELECT ind, round(fitness, 6) AS fitness, round(test, 6) AS test FROM g"""


@query(_EVALUATED)
def evaluate_population(spark, d):
    run = evolve.evaluator(T.sequences(spark, d))
    return run(evolve.nest(T.individuals(spark, d))).select("ind", r6("fitness"), r6("test"))


@query(_EVALUATED)
def evaluate_indexed(spark, d):
    """The same from the positional index of the learn set."""
    s = T.sequences(spark, d)
    run = evolve.evaluator(s, index=T.index(s))
    return run(evolve.nest(T.individuals(spark, d))).select("ind", r6("fitness"), r6("test"))


@query(f"""WITH {T.SQL_SEQUENCES}, {T.SQL_INDIVIDUALS}, {_measured("inds", "g")} SELECT i.ind, i.rule_idx, CAST(w.rule_idx IS NOT NULL AS INTEGER) AS status
FROM inds i LEFT JOIN g_won w ON w.ind = i.ind AND w.rule_idx = i.rule_idx""")
def evaluated_status(spark, d):
    """The statuses that an evaluation sets."""
    out = evolve.evaluator(T.sequences(spark, d))(evolve.nest(T.individuals(spark, d)))
    return evolve.flatten(out).select("ind", "rule_idx", "status")


@query("""SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey)""")
def insert_unique(spark, d):
    cols = ("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    rows = T.read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").toDF(*cols)
    return crud.insert_unique_by(T.read(spark, d, "customer").select(*cols), rows, "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_rows(spark, d):
    o = T.read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return crud.update(o, {"o_orderstatus": F.lit("X")}, F.col("o_totalprice") > 100000).drop("o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT coalesce(o_totalprice > 100000, false)")
def delete_rows(spark, d):
    return crud.delete(T.read(spark, d, "orders"), F.col("o_totalprice") > 100000).select("o_orderkey", "o_custkey")


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 100000")
def row_exists(spark, d):
    return crud.select_all(T.read(spark, d, "orders"), F.col("o_totalprice") > 100000).agg((F.count("*") > 0).alias("found"))


@query("SELECT CAST(NULL AS BIGINT) AS id, c_name, c_acctbal, CAST(NULL AS VARCHAR) AS note FROM customer")
def migrate_schema(spark, d):
    text = '{"name": "shop", "customer": {"c_name": "TEXT", "c_acctbal": "REAL", "note": "TEXT"}}'
    return crud.migrate(T.read(spark, d, "customer"), crud.blueprint(text)[1]["customer"])


@query("SELECT o_orderkey, strftime(o_orderdate, '%m') AS month FROM orders")
def month_number(spark, d):
    o = T.read(spark, d, "orders")
    return o.select("o_orderkey", scalars.month_number(F.date_format("o_orderdate", "MMMM")).alias("month"))


@query("""SELECT o_orderkey, true AS is_number, o_orderstatus IN ('y', 'n', 'Y', 'N') AS yes_no, false AS optional_number,
CASE WHEN length(o_orderpriority) > 1 THEN true END AS is_text FROM orders""")
def validators(spark, d):
    return T.read(spark, d, "orders").select(
        "o_orderkey", scalars.is_number(F.col("o_orderkey").cast("string"), True).alias("is_number"),
        scalars.is_yes_no("o_orderstatus", True).alias("yes_no"), scalars.is_number("o_orderstatus", False).alias("optional_number"),
        scalars.is_text("o_orderpriority", True).alias("is_text"),
    )


#: The standard codons of each letter (fixed values).
CODONS = {
    "A": "GCA GCC GCG GCT", "C": "TGC TGT", "D": "GAC GAT", "E": "GAA GAG", "F": "TTC TTT", "G": "GGA GGC GGG GGT",
    "H": "CAC CAT", "I": "ATA ATC ATT", "K": "AAA AAG", "L": "CTA CTC CTG CTT TTA TTG", "M": "ATG", "N": "AAC AAT",
    "P": "CCA CCC CCG CCT", "Q": "CAA CAG", "R": "AGA AGG CGA CGC CGG CGT", "S": "AGC AGT TCA TCC TCG TCT",
    "T": "ACA ACC ACG ACT", "V": "GTA GTC GTG GTT", "W": "TGG", "Y": "TAC TAT",
}


@query(f"""WITH {T.SQL_SEQUENCES}, c AS (SELECT seq_id, unnest(string_split(sequence, '')) AS c FROM seqs)
SELECT seq_id, CAST(sum(CASE c {' '.join(f"WHEN '{k}' THEN {len(v.split())}" for k, v in CODONS.items())} END) AS BIGINT) AS codons FROM c GROUP BY 1""")
def codon_expand(spark, d):
    table = F.create_map(*[x for k, v in CODONS.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])
    letters = F.split("sequence", "")
    s = T.sequences(spark, d).select("seq_id", F.explode(letters).alias("c")).where("c <> ''")
    return s.select("seq_id", F.explode(F.element_at(table, F.col("c")))).groupBy("seq_id").agg(F.count("*").alias("codons"))


from weft.plans import registry_evolve, registry_files  # noqa: E402, F401  (they register their queries here)
