"""The corpus pipeline: toxic documents go, of equal and of near-equal documents one stays, sources are mixed to their
target weights, and the result is encoded into piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
columns these are.  A null text is an empty one, a null id an id of its own that is smaller than all others; repeated rows
are rows of their own until a dedup stage; an empty table passes through all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import minhash, mixing, radix, sentencepiece_codec, toxicity
from weft.llm._sample import held_out
from weft.llm._shared import saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half; null and empty texts stay, equal texts go or stay together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn_from(docs, labels, held_out("doc_id", 5, 0))
    return docs.where(toxicity.scorer(model)(F.col("text").cast("string")).score < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts (A-Z lower-cased): the row with the largest id, one of repeated rows; of all null
    and empty texts together one."""
    return radix.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id; rows of the group that repeat this id stay with
    it.  Documents without words, null ones too, are groups of their own and stay."""
    return minhash.keep_first(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, the last of a run cut; those without words are never taken.  A
    null source is one more source; repeated rows are mixed as rows of their own."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every row; null and empty texts have none."""
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.load())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Models and iterations decide the rows, which SQL can't express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))  # each stage is worked out once
    return STAGES[-1][1](spark, docs, sf_dir)
