"""Exact dedup by distributed MSD radix partitioning.

Texts (A-Z lower-cased, UTF-8) are split by successive runs of bytes: the first
``head`` bytes, then runs that grow fourfold.  A group of texts that agree so
far is split by its next run; singletons are done, and so are groups whose texts
have ended, which are equal.  The runs themselves are the keys, no digest
decides equality.

Only texts that share their first run with another are read again; they are cut
into runs once, and each round moves just the runs of the groups still open.
Groups are found by aggregation and named by their row with the largest id, so a
group that holds a large part of all rows is neither gathered nor sorted.

Edge cases: null counts as the empty text, and all empty texts are equal; of
repeated rows (same id and text) one stays; of equal texts under one id the one
with the larger text hash stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._rows import join_on, keyed, matching, real_id
from weft.llm._shared import saved

HEAD, GROWTH = 64, 4
_ROW = ["did", "rh"]


def _first_runs(head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [x.as_buffer().to_pybytes().lower() for x in b.column("text")]  # bytes.lower(): A-Z only
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("did"), b.column("rh"),
                    pa.array([hashlib.sha256(x).digest() for x in low], pa.binary()),
                    pa.array([x[:head] for x in low], pa.binary()),
                    pa.array([len(x) >= head for x in low], pa.bool_()),
                ],
                names=["did", "rh", "sha", "run", "more"],
            )

    return run


def _later_runs(head: int, growth: int):
    """(did, rh, depth, run, more): a text that ends exactly with a run has an empty one after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            size = 0
            for k in range(b.num_rows):
                text = b.column("text")[k].as_buffer().to_pybytes().lower()
                at, width, depth = head, head, 0
                while True:
                    width, depth = width * growth, depth + 1
                    more = len(text) >= at + width
                    row = (b.column("did")[k].as_py(), b.column("rh")[k].as_py(), depth, text[at : at + width], more)
                    for x, v in zip(out, row, strict=True):
                        x.append(v)
                    at += width
                    if not more:
                        break
                size += len(text)
                if size > 1 << 22 or k == b.num_rows - 1:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(out, kinds, strict=True)],
                        names=["did", "rh", "depth", "run", "more"],
                    )
                    out, size = [[], [], [], [], []], 0

    return run


def _split(open_: DataFrame, by: list[str]) -> DataFrame:
    """Rows (did, rh, k, more) with their new group's size and top row; singletons are dropped."""
    open_ = open_.withColumnsRenamed({c: f"by_{c}" for c in by})
    by = [f"by_{c}" for c in by]
    groups = open_.groupBy(*by).agg(F.sum("k").alias("n"), F.max(F.struct("did", "rh")).alias("top"))
    groups = saved(groups.where("n > 1").select(*by, "n", F.col("top.did").alias("top_did"), F.col("top.rh").alias("top_rh")))
    return open_.join(groups, by).select("did", "rh", "k", "more", "n", "top_did", "top_rh")


def equal_texts(base: DataFrame, head: int = HEAD, growth: int = GROWTH) -> DataFrame:
    """(did, rh, sha, n, top_did, top_rh, kept) for every row: size and largest row of its group of equal texts."""
    first = saved(base.mapInArrow(_first_runs(head), "did long, rh long, sha binary, run binary, more boolean"))
    state = saved(_split(first.withColumn("k", F.lit(1)), ["run"]))
    done = state.where("NOT more").select(*_ROW, "k", "n", "top_did", "top_rh")
    found = [done.groupBy(*_ROW, "n", "top_did", "top_rh").agg(F.sum("k").alias("k"))]
    open_ = state.where("more").groupBy(*_ROW, "top_did", "top_rh").agg(F.sum("k").alias("k"))
    open_ = saved(open_)
    if not open_.isEmpty():
        texts = join_on(base, open_.select(*_ROW).hint("merge"), _ROW, "left_semi").dropDuplicates(_ROW)
        runs = saved(texts.mapInArrow(_later_runs(head, growth), "did long, rh long, depth int, run binary, more boolean"))
        depth = 0
        while not open_.isEmpty():
            depth += 1
            here = join_on(open_, runs.where(F.col("depth") == depth).drop("depth"), _ROW)
            state = saved(_split(saved(here), ["top_did", "top_rh", "run"]))
            found.append(state.where("NOT more").select(*_ROW, "n", "top_did", "top_rh", "k"))
            open_ = state.where("more").select(*_ROW, "top_did", "top_rh", "k")
    groups = found[0]
    for g in found[1:]:
        groups = groups.unionByName(g)
    out = join_on(first.select(*_ROW, "sha"), saved(groups), _ROW, "left")
    out = out.select(
        *_ROW, "sha", F.coalesce("n", F.lit(1)).cast("long").alias("n"), F.coalesce("k", F.lit(1)).alias("k"),
        F.coalesce("top_did", "did").alias("top_did"), F.coalesce("top_rh", "rh").alias("top_rh"),
    )
    top = (F.col("did") == F.col("top_did")) & (F.col("rh") == F.col("top_rh"))
    once = out.where("k = 1").withColumn("kept", top)
    turn = F.row_number().over(Window.partitionBy(*_ROW).orderBy("top_did"))
    again = out.where("k > 1").withColumn("kept", top & (turn == 1))
    return once.unionByName(again).drop("k")


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row."""
    out = equal_texts(keyed(docs), **options)
    return out.select(
        real_id("did").alias("doc_id"),
        real_id("top_did").alias("keep_id"),
        F.col("n").alias("group_size"),
        "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns."""
    keep = equal_texts(keyed(docs), **options).where("kept").select(*_ROW).distinct()
    left = matching(docs, keep)
    turn = F.row_number().over(Window.partitionBy("_row_did", "_row_rh").orderBy("_row_rh"))
    return left.withColumn("_turn", turn).where("_turn = 1").select(*docs.columns)
