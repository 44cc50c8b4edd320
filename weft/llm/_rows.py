"""Shared conventions for document tables.

``did`` is ``doc_id`` with null mapped to the smallest long, so that joins and
orders are total, and a doc_id of -2^63 counts as null; ``rh`` hashes the row's text.  ``(did, rh)`` names a row: rows
that agree on both are identical copies, which every operator treats alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm._ship import ship

NULL_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def dealt(docs: DataFrame) -> DataFrame:
    """``docs`` over a partition for each core at least, for work that is done where the rows are read: a file of few row
    groups would keep most cores idle."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def keyed(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, rh, text, *more): null text becomes empty; all other columns are left behind."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64(text).alias("rh"),
        text.alias("text"),
        *more,
    )


def real_id(col: str | Column = "did") -> Column:
    """The doc_id that ``did`` stands for."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != NULL_ID, c)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the left side's keys and columns stay, then the right side's others."""
    other = [c for c in right.columns if c not in keys]
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *other)
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    out = left.join(r, on, how)
    return out.select(*left.columns, *([] if how in ("left_semi", "left_anti") else other))


def matching(docs: DataFrame, names: DataFrame, *more: str, source: str | None = None) -> DataFrame:
    """Rows of ``docs`` that ``names`` (did, rh) name, with all their columns, and ``more`` columns of names as ``_<column>``.

    The row's name is added and used under names of its own, so columns of any name may stand in ``docs``.
    With ``source`` that column of docs (null matches null) is part of the name, as is names' column source.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    d = docs.select("*", did.alias("_row_did"), F.xxhash64(text).alias("_row_rh")) if "_row_did" not in docs.columns else docs
    n = names.select(
        F.col("did").alias("_n_did"), F.col("rh").alias("_n_rh"), *[F.col(c).alias(f"_{c}") for c in more],
        *([F.col("source").alias("_n_source")] if source else []),
    )
    same = (F.col("_row_did") == F.col("_n_did")) & (F.col("_row_rh") == F.col("_n_rh"))
    if source:
        same &= F.col(source).cast("string").eqNullSafe(F.col("_n_source"))
    return d.join(n, same, "inner" if more else "left_semi").select(*d.columns, *[f"_{c}" for c in more])
