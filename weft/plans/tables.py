"""The engine's tables, derived from the driver's: sequences, rules, evolution logs; in DataFrame form and as SQL.

Sequences are the distinct words of all documents and patterns the words of all
benchmark items, both reduced to the 20 letters of the alphabet.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft import checkpoints
from weft.operators import scoring

MODELS = 4
MAX_PATTERN = 6


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(text: str):
    """Of the whole text at once, which is cheaper than word by word; only ASCII is left before the letters change case."""
    return F.split(F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]+", " ")), "BJOUXZ", ""), " ")


#: Bytes of texts whose words a task counts at once, and those that it takes apart at once, which are to stay in a core's cache.
COUNTED_BYTES, SPLIT_BYTES = 32 << 20, 128 << 10


def _counter(most: int):
    """From batches (text as bytes) to (sequence, n): the words by ``_words``, counted before any becomes a row of Spark's.

    Every byte but ASCII's letters parts words, so that no text is decoded.  Words of up to eight letters, which are most,
    are counted as the numbers that their bytes stand for.  The counts are partial ones, of ``most`` bytes of texts and the
    one that goes beyond.  A function of its own, so that executors need not have this package.
    """
    upper = bytes(b & 95 if 65 <= b & 95 <= 90 and b < 128 else 32 for b in range(256))
    piece = min(most, SPLIT_BYTES)

    def scan(batches):
        import pyarrow.compute as pc

        first = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of a number's first bytes

        def split(texts):
            """The words of up to eight letters as numbers, and the longer ones, each after a blank."""
            x = b" ".join([b"", *texts, b" " * 8]).translate(upper, b"BJOUXZbjouxz")
            gaps = np.flatnonzero(np.frombuffer(x, np.uint8) == 32)
            n = np.diff(gaps) - 1
            short, long = np.flatnonzero((n > 0) & (n <= 8)), np.flatnonzero(n > 8)
            numbers = np.ndarray(len(x) - 7, "<u8", x, strides=(1,))[gaps[short] + 1] & first[n[short]]
            return numbers, pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(gaps), pa.py_buffer(x)).take(pa.array(long))

        def counted(pieces):
            numbers, words = zip(*pieces, strict=True)
            values, n = pc.value_counts(pa.array(np.concatenate(numbers))).flatten()
            short = pa.array(values.to_numpy().astype("<u8").view("S8"), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([short, n], ["sequence", "n"])
            values, n = pc.value_counts(pa.concat_arrays(words)).flatten()
            yield pa.RecordBatch.from_arrays([pc.ascii_ltrim_whitespace(values).cast(pa.string()), n], ["sequence", "n"])

        pieces, texts, size, total = [], [], 0, 0
        for b in batches:
            for text in b.column(0).drop_null():
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= piece:
                    pieces.append(split(texts))
                    texts, size, total = [], 0, total + size
                if total >= most:
                    yield from counted(pieces)
                    pieces, total = [], 0
        yield from counted([*pieces, split(texts)])

    return scan


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, sequence, fitness): fitness is ((occurrences * 7 + length) % 400) / 16."""
    docs = read(spark, sf_dir, "documents").select("text")
    if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # a file of few row groups would keep most cores idle
        docs = docs.repartition(spark.sparkContext.defaultParallelism)
    w = docs.select(F.col("text").cast("binary")).mapInArrow(_counter(COUNTED_BYTES), "sequence string, n long")
    w = w.groupBy("sequence").agg(F.sum("n").alias("n"))
    fitness = ((F.col("n") * 7 + F.length("sequence")) % 400) / F.lit(16.0)
    return w.select(F.col("sequence").alias("seq_id"), "sequence", fitness.alias("fitness"))


def index(seqs: DataFrame) -> scoring.GramIndex:
    """A positional index of sequences, in a catalog table whose files lie in the shared folder."""
    name = f"weft_grams_{uuid.uuid4().hex}"
    buckets = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scoring.GramIndex.write(seqs, name, MAX_PATTERN, buckets, f"{checkpoints.folder(seqs.sparkSession)}/{name}")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, rule_idx, pattern, weight): longest first, then in the order of appearance."""
    b = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(_words("text")).alias("p", "pattern"))
    b = b.where(F.length("pattern").between(1, MAX_PATTERN)).withColumn("model_id", (F.col("item_id") % MODELS).cast("int"))
    b = b.groupBy("model_id", "pattern").agg(F.min(F.col("item_id") * 100000 + F.col("p")).alias("at"))
    order = Window.partitionBy("model_id").orderBy(F.desc(F.length("pattern")), "at")
    b = b.withColumn("rule_idx", (F.row_number().over(order) - 1).cast("int"))
    weight = ((F.col("rule_idx") * 37 + F.col("model_id") * 11) % 81 - 40) / F.lit(4.0)
    return b.select("model_id", "rule_idx", "pattern", weight.alias("weight"))


def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ind, rule_idx, pattern, weight, status): each benchmark item as an individual, its words as rules."""
    b = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(_words("text")).alias("p", "pattern"))
    b = b.where(F.length("pattern").between(1, MAX_PATTERN))
    order = Window.partitionBy("item_id").orderBy(F.desc(F.length("pattern")), "p")
    b = b.withColumn("rule_idx", (F.row_number().over(order) - 1).cast("int"))
    return b.select(
        F.col("item_id").cast("int").alias("ind"), "rule_idx", "pattern",
        (((F.col("rule_idx") * 37 + F.col("item_id") * 11) % 81 - 40) / F.lit(4.0)).alias("weight"),
        ((F.col("rule_idx") + F.col("item_id")) % 3 > 0).cast("int").alias("status"),
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ind, fitness): an individual's fitness, derived from its text."""
    b = read(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").cast("int").alias("ind"), ((F.length("text") * 13 + F.col("item_id") * 7) % 101 / F.lit(4.0)).alias("fitness"))


def evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, generation, best_fitness): each user's events in order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"), (F.row_number().over(order) - 1).alias("generation"), F.col("value").alias("best_fitness"))


_WORDS = """list_transform(string_split(regexp_replace({t}, '[^A-Za-z]+', ' ', 'g'), ' '),
    lambda w: regexp_replace(upper(w), '[BJOUXZ]', '', 'g'))"""

SQL_SEQUENCES = f"""seqs AS MATERIALIZED (
  SELECT sequence AS seq_id, sequence, ((n * 7 + length(sequence)) % 400) / 16.0::DOUBLE AS fitness FROM (
    SELECT sequence, count(*) AS n FROM (SELECT unnest({_WORDS.format(t='text')}) AS sequence FROM documents)
    WHERE sequence <> '' GROUP BY sequence))"""

SQL_ITEM_WORDS = f"""item_words AS (
  SELECT item_id, unnest(w) AS pattern, unnest(range(len(w))) AS p
  FROM (SELECT item_id, {_WORDS.format(t='text')} AS w FROM benchmark))"""

SQL_RULES = f"""{SQL_ITEM_WORDS}, rules AS MATERIALIZED (
  SELECT model_id, rule_idx, pattern, ((rule_idx * 37 + model_id * 11) % 81 - 40) / 4.0::DOUBLE AS weight FROM (
    SELECT model_id, pattern, CAST(row_number() OVER (PARTITION BY model_id ORDER BY length(pattern) DESC, first_at) - 1 AS INTEGER) AS rule_idx
    FROM (SELECT CAST(item_id % {MODELS} AS INTEGER) AS model_id, pattern, min(item_id * 100000 + p) AS first_at FROM item_words
          WHERE length(pattern) BETWEEN 1 AND {MAX_PATTERN} GROUP BY 1, 2)))"""

SQL_INDIVIDUALS = f"""{SQL_ITEM_WORDS}, inds AS (
  SELECT CAST(item_id AS INTEGER) AS ind, rule_idx, pattern, ((rule_idx * 37 + item_id * 11) % 81 - 40) / 4.0::DOUBLE AS weight,
    CAST((rule_idx + item_id) % 3 > 0 AS INTEGER) AS status FROM (
    SELECT item_id, pattern, CAST(row_number() OVER (PARTITION BY item_id ORDER BY length(pattern) DESC, p) - 1 AS INTEGER) AS rule_idx
    FROM item_words WHERE length(pattern) BETWEEN 1 AND {MAX_PATTERN}))"""

SQL_POPULATION = """pop AS (
  SELECT CAST(item_id AS INTEGER) AS ind, ((length(text) * 13 + item_id * 7) % 101) / 4.0::DOUBLE AS fitness FROM benchmark)"""

SQL_EVOLUTION = """evo AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS generation, value AS best_fitness FROM events)"""

SQL_HITS = f"""{SQL_SEQUENCES}, {SQL_RULES},
strings AS MATERIALIZED (SELECT DISTINCT model_id, rule_idx, weight, unnest([pattern, reverse(pattern)]) AS gram FROM rules),
lens AS MATERIALIZED (SELECT DISTINCT length(gram) AS k FROM strings),
grams AS (SELECT seq_id, pos, substr(sequence, pos, k) AS gram
  FROM (SELECT seq_id, sequence, unnest(range(1, length(sequence) + 1)) AS pos FROM seqs) CROSS JOIN lens
  WHERE pos + k - 1 <= length(sequence)),
hits AS MATERIALIZED (SELECT model_id, seq_id, pos, min(rule_idx) AS rule_idx, arg_min(weight, rule_idx) AS weight, count(*) AS n_rules
  FROM grams JOIN strings USING (gram) GROUP BY 1, 2, 3),
models AS (SELECT DISTINCT model_id FROM rules),
per AS MATERIALIZED (SELECT model_id, seq_id, sum(weight) AS s, count(*) AS h FROM hits GROUP BY 1, 2),
preds AS (SELECT m.model_id, q.seq_id, coalesce(s, 0.0)::DOUBLE AS score, coalesce(h, 0) AS hits, q.fitness
  FROM seqs q CROSS JOIN models m LEFT JOIN per p ON p.model_id = m.model_id AND p.seq_id = q.seq_id)"""

#: The same predictions in one aggregation.
SQL_SCORED = f"""{SQL_SEQUENCES}, {SQL_RULES},
strings AS (SELECT DISTINCT model_id, rule_idx, weight, unnest([pattern, reverse(pattern)]) AS gram FROM rules),
grams AS (SELECT seq_id, pos, substr(sequence, pos, k) AS gram
  FROM (SELECT seq_id, sequence, unnest(range(1, length(sequence) + 1)) AS pos FROM seqs), range(1, {MAX_PATTERN + 1}) l(k) WHERE pos + k - 1 <= length(sequence)),
firsts AS (SELECT model_id, seq_id, arg_min(weight, rule_idx) AS weight, 1 AS hit FROM grams JOIN strings USING (gram) GROUP BY model_id, seq_id, pos),
either AS (SELECT * FROM firsts UNION ALL SELECT model_id, seq_id, 0.0, 0 FROM seqs, (SELECT DISTINCT model_id FROM rules)),
scored AS (SELECT model_id, seq_id, sum(weight)::DOUBLE AS score, sum(hit)::BIGINT AS hits, any_value(fitness) AS fitness FROM either JOIN seqs USING (seq_id) GROUP BY 1, 2)"""
