"""Registered queries that write and read files and catalog tables, and lookups and orders over what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weft import checkpoints
from weft.functions import scalars
from weft.operators import crud, metrics, ordering, scoring
from weft.plans import tables as T
from weft.plans.registry import _FIT, _IDX, _LINES, _indexed, _lines, _predictions, query, r6
from weft.sources import files
from weft.streaming import live_log


def _folder(spark: SparkSession) -> str:
    return f"{checkpoints.folder(spark)}/weft-files-{uuid.uuid4().hex}"


@query(f"WITH {T.SQL_SEQUENCES} SELECT sequence, fitness FROM seqs")
def learn_set_scan(spark, d):
    at = _folder(spark)
    files.overwrite(T.sequences(spark, d).select("sequence", "fitness"), at)
    return files.learn_set(spark, at).select("sequence", "fitness")


def _model_files(spark: SparkSession, d: str) -> str:
    """A file for each model, in stored order, with the columns in an order of their own."""
    at = _folder(spark)
    r = T.rules(spark, d).withColumn("status", F.col("rule_idx") % 2)
    r = r.select("model_id", "rule_idx", "weight", "status", "pattern")
    r = r.repartition("model_id").sortWithinPartitions("model_id", "rule_idx")
    r.write.partitionBy("model_id").option("header", True).csv(at)
    return at


@query(f"""WITH {T.SQL_RULES}, n AS (SELECT *, max(rule_idx) OVER (PARTITION BY model_id) AS last FROM rules)
SELECT rule_idx, nullif(pattern, 'NA') AS pattern, weight, rule_idx % 2 AS status FROM n WHERE rule_idx < last""")
def model_scan(spark, d):
    return files.models(spark, _model_files(spark, d)).select("rule_idx", "pattern", "weight", "status")


@query(f"WITH {T.SQL_RULES} SELECT rule_idx, nullif(pattern, 'NA') AS pattern, weight, rule_idx % 2 AS status FROM rules")
def model_scan_whole(spark, d):
    return files.models(spark, _model_files(spark, d), drop_last=False).select("rule_idx", "pattern", "weight", "status")


@query(f"WITH {T.SQL_SEQUENCES}, l AS (SELECT DISTINCT unnest(string_split(sequence, '')) AS key FROM seqs) SELECT key, key AS code FROM l WHERE key <> ''")
def alphabet_scan(spark, d):
    """The alphabet of the learn set, through a file."""
    at = _folder(spark)
    letters = T.sequences(spark, d).select(F.explode(F.split("sequence", "")).alias("key")).where("key <> ''").distinct()
    files.overwrite(letters.select("key", F.col("key").alias("code")), at)
    return files.pairs(spark, at)


@query("SELECT count(*) AS n_files, true AS all_csv, true AS sorted FROM (SELECT DISTINCT o_orderstatus FROM orders)")
def directory_scan(spark, d):
    at = _folder(spark)
    status = T.read(spark, d, "orders").select("o_orderstatus").distinct()
    (status.repartition(1).withColumn("name", F.col("o_orderstatus")).write.partitionBy("o_orderstatus").csv(at))
    status.repartition(1).write.mode("append").text(f"{at}/o_orderstatus=none")
    names = files.files(spark, at, "*.csv")
    rows = [(len(names), all(n.endswith(".csv") for n in names), names == sorted(names))]
    return spark.createDataFrame(rows, "n_files long, all_csv boolean, sorted boolean")


@query("SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS INTEGER) AS line_no, event_id || ' ' || event_type AS line FROM events")
def text_scan(spark, d):
    at = _folder(spark)
    e = T.read(spark, d, "events").select("event_id", F.concat_ws(" ", "event_id", "event_type").alias("value"))
    e.coalesce(1).sortWithinPartitions("event_id").select("value").write.text(at)  # one file, whose lines have an order
    return files.lines(spark, at).select("line_no", "line")


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer")
def append_rows(spark, d):
    at, c = _folder(spark), T.read(spark, d, "customer").select("c_custkey", "c_name")
    files.overwrite(T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")), at)
    files.truncate(spark, at, "c_custkey long, c_name string")
    files.append(c, at)
    files.append(c, at)
    return spark.read.schema("c_custkey long, c_name string").option("header", True).csv(at)


@query("SELECT c_custkey, c_name FROM customer")
def overwrite_rows(spark, d):
    at, c = _folder(spark), T.read(spark, d, "customer").select("c_custkey", "c_name")
    files.append(c, at)
    files.overwrite(c, at)
    return spark.read.schema("c_custkey long, c_name string").option("header", True).csv(at)


_WIDE6 = ", ".join(f'''round(max(CASE WHEN model_id = {m} THEN score * slope + intercept END), 6) AS "m{m}"''' for m in range(T.MODELS))


@query(f"""WITH {T.SQL_HITS}, {_IDX}, {_FIT} SELECT row_idx, seq_id AS sequence, fitness, {_WIDE6}
FROM preds JOIN idx USING (seq_id) JOIN fit USING (model_id) GROUP BY 1, 2, 3""")
def model_vs_dataset_calibrated(spark, d):
    p = metrics.calibrated(_indexed(spark, d).checkpoint(), "correlation")
    wide = metrics.wide_table(p, list(range(T.MODELS)), digits=6)
    return wide.toDF("row_idx", "sequence", "fitness", *[f"m{m}" for m in range(T.MODELS)])


_WIDE2 = ", ".join(f'''round(max(CASE WHEN model_id = {m} THEN score END), 2) AS "m{m}"''' for m in range(T.MODELS))


@query(f"WITH {T.SQL_HITS} SELECT seq_id AS sequence, fitness, {_WIDE2} FROM preds GROUP BY 1, 2")
def result_table(spark, d):
    at, models = _folder(spark), list(range(T.MODELS))
    files.result_table(metrics.wide_table(metrics.calibrated(_indexed(spark, d), "RMSE"), models), at)
    kinds = ", ".join(f"m{m} double" for m in models)
    return spark.read.schema(f"sequence string, fitness double, {kinds}").option("header", True).csv(at)


@query(f"""WITH {T.SQL_HITS}, g AS (SELECT model_id, count(*) AS n, sum(power(score - fitness, 2)) AS sse,
  1 - power(CASE WHEN min(score) <> max(score) AND min(fitness) <> max(fitness) THEN corr(score, fitness) END, 2) AS c FROM preds GROUP BY 1)
SELECT model_id, 'RMSE' AS metric, round(sqrt(9 * sse / (10 * (n - n // 10))), 6) AS train, round(sqrt(sse / (10 * (n // 10))), 6) AS test FROM g
UNION ALL SELECT model_id, 'correlation', round(coalesce(c, 1.0), 6), 0.0::DOUBLE FROM g""")
def measure_by_name(spark, d):
    p = _predictions(spark, d)
    both = [metrics.measure(p, m).select("model_id", F.lit(m).alias("metric"), r6("train"), r6("test")) for m in metrics.METRICS]
    return both[0].unionByName(both[1])


@query("SELECT event_type AS sequence, min(event_id) AS row_idx, arg_min(value, event_id) AS fitness FROM events GROUP BY 1")
def lookup_first(spark, d):
    e = T.read(spark, d, "events")
    rows = e.select(F.col("event_id").alias("row_idx"), F.col("event_type").alias("sequence"), F.col("value").alias("fitness"))
    return scoring.first_by_sequence(rows).select("sequence", "row_idx", "fitness")


@query(f"WITH {T.SQL_RULES} SELECT model_id, rule_idx, pattern, weight FROM rules ORDER BY weight DESC, rule_idx DESC, model_id LIMIT 10")
def heaviest_rules(spark, d):
    return ordering.by_weight(T.rules(spark, d), "model_id").limit(10)


@query(f"WITH {T.SQL_SEQUENCES} SELECT seq_id, fitness FROM seqs ORDER BY fitness, seq_id LIMIT 10")
def least_fit(spark, d):
    return ordering.by_value(T.sequences(spark, d).select("seq_id", "fitness"), "fitness", "seq_id", descending=False).limit(10)


_NATION = {"n_nationkey": "bigint", "n_name": "string", "n_regionkey": "bigint"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, '{k}' AS kind, true AS found, count({c}) AS filled FROM nation" for c, k in _NATION.items()))
def catalog_tables(spark, d):
    """A catalog table with the columns of a given one, its rows, and what the catalog says of it."""
    name, rows = f"weft_{uuid.uuid4().hex}", T.read(spark, d, "nation").select(*[F.col(c).cast(k).alias(c) for c, k in _NATION.items()])
    for _ in range(2):  # a second time changes nothing
        crud.create_table(spark, name, dict(rows.dtypes))
    crud.insert(spark.table(name), rows).write.insertInto(name)
    found = crud.table_exists(spark, name) and name in crud.tables(spark)
    kinds = dict(crud.table_info(spark.table(name)))
    counts = spark.table(name).agg(*[F.count(c).alias(c) for c in kinds]).first()
    out = spark.createDataFrame([(c, k, found, counts[c]) for c, k in kinds.items()], "col string, kind string, found boolean, filled long")
    spark.sql(f"DROP TABLE {name}")
    return out


def _order_files(spark: SparkSession, d: str) -> str:
    at = _folder(spark)
    o = T.read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    o.write.partitionBy("o_orderpriority").parquet(at)
    return at


_RICH = "o_totalprice > 200000 AND o_orderpriority < '3'"


@query(f"SELECT o_orderkey, CASE WHEN {_RICH} THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders")
def update_table(spark, d):
    """An update written back to a partitioned table, and the table read again."""
    at = _order_files(spark, d)
    crud.update_files(spark, at, {"o_orderstatus": F.lit("X")}, F.expr(_RICH), ("o_orderpriority",))
    return spark.read.parquet(at).select("o_orderkey", "o_orderstatus", "o_orderpriority")


_POOR = "o_orderpriority = '5-LOW' OR (o_totalprice < 100000 AND o_orderpriority = '1-URGENT')"


@query(f"SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT coalesce({_POOR}, false)")
def delete_from_table(spark, d):
    at = _order_files(spark, d)
    crud.delete_files(spark, at, F.expr(_POOR), ("o_orderpriority",))
    return spark.read.parquet(at).select("o_orderkey", "o_orderpriority")


_PAIR = ("r_regionkey", "r_name")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey > 100)")
def insert_unique_if(spark, d):
    rows = T.read(spark, d, "nation").select("n_nationkey", "n_name").toDF(*_PAIR)
    base = T.read(spark, d, "region").select(*_PAIR)
    kept = crud.insert_unique(base, rows)  # without a condition only an empty table takes rows
    return crud.insert_unique(kept, rows, F.col("r_regionkey") > 100)


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000) AS some, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS none, 1::BIGINT AS selected")
def rows_exist(spark, d):
    o, p = T.read(spark, d, "orders"), F.col("o_totalprice")
    row = (crud.row_exists(o, p > 100000), crud.row_exists(o, p < 0), crud.select_one(o, p > 100000).count())
    return spark.createDataFrame([row], "some boolean, none boolean, selected long")


@query("""SELECT o_orderkey, substr(o_orderpriority, 1, 2) || '#' || substr(o_orderpriority, 3) AS inserted,
  substr(o_orderpriority, 1, 1) || substr(o_orderpriority, 3) AS deleted, substr(o_orderpriority, 1, 1) || '*' || substr(o_orderpriority, 3) AS replaced,
  o_orderstatus AS stripped, strftime(o_orderdate, '%b-%d-%Y') AS label, true AS date_ok, false AS date_bad,
  regexp_full_match(CAST(o_orderkey AS VARCHAR), '[0-9]+') AS numeric, CAST(3723 AS BIGINT) AS seconds FROM orders""")
def scalar_functions(spark, d):
    o, p = T.read(spark, d, "orders"), "o_orderpriority"
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    gap = scalars.time_between(F.lit("01:00:00"), F.lit("02:02:03"))
    return o.select(
        "o_orderkey", scalars.insert_at(p, F.lit(2), F.lit("#")).alias("inserted"), scalars.delete_at(p, F.lit(1)).alias("deleted"),
        scalars.replace_at(p, F.lit(1), F.lit("*")).alias("replaced"), scalars.strip(F.concat(F.lit(" \t"), "o_orderstatus", F.lit("\n "))).alias("stripped"),
        scalars.date_label("o_orderdate").alias("label"), scalars.is_date(day, "yyyy-MM-dd").alias("date_ok"),
        scalars.is_date(day, "HH:mm").alias("date_bad"), scalars.is_numeric(F.col("o_orderkey").cast("string")).alias("numeric"),
        (gap.cast("interval second").cast("decimal(18,0)")).cast("long").alias("seconds"),
    )


@query(f"""WITH {_LINES}, l AS (SELECT *, coalesce(min(generation) OVER (PARTITION BY file ORDER BY line_no DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100000000) AS least FROM lines)
SELECT file AS run, line_no, generation FROM l WHERE generation < least""")
def live_log_repair(spark, d):
    """The log in three pieces, each followed by a stream that goes on from the state of the one before."""
    checkpoints.ensure(spark)
    at = _folder(spark)
    log = _lines(spark, d).select(F.col("file").alias("run"), "line_no", "generation")
    ends = log.groupBy("run").agg((F.max("line_no") + 1).alias("n"))
    dealt = log.join(ends, "run").withColumn("piece", F.floor(3 * F.col("line_no") / F.col("n"))).drop("n").checkpoint()
    for piece in range(3):
        dealt.where(F.col("piece") == piece).drop("piece").write.mode("append").parquet(f"{at}/in")
        arriving = spark.readStream.schema(log.schema).parquet(f"{at}/in")
        live_log.record(live_log.attempts(arriving, "line_no"), f"{at}/out", f"{at}/state", now=True).awaitTermination()
    return live_log.repaired(spark.read.parquet(f"{at}/out")).select("run", "line_no", "generation")
