"""Bounded samples of labelled rows, chosen by hash and so independent of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod ``folds`` is ``fold``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds == fold


def bounded(rows: DataFrame, n: int, bound: int, *key: str, seed: int = 3) -> DataFrame:
    """Of ``n`` rows about ``bound`` at most: those whose hash of ``key`` is small enough."""
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) < int((1 << 30) * bound / n))
