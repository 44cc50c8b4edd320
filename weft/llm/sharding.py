"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring; a row hashes to one of ``bins``
equal arcs and belongs to the first point clockwise.  A shard takes at most its
bound of rows: first its own rows, then rows that overflow from full shards and
continue clockwise to the next point whose shard has room.  With the bound at
the mean (``n // shards``, one more for the first ``n % shards`` shards in ring
order) counts differ by one at most.

The ring walk needs only the row count of each bin, a table of at most ``bins``
rows, so the driver plans it; rows are placed by a broadcast of that plan (its
size is bounded by ``bins``, not by the data) and their rank within the bin.
A bin holds 1 / ``bins`` of the rows, whatever their source; rows that repeat id and
text share one, so very many of these make a large bin.

Edge cases: null text has size 1 and crc32 of nothing (0); null ids hash like
any other value; repeated rows get slots of their own; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._rows import NULL_ID, keyed, real_id

BINS = 16384
VNODES = 64


def _points(shards: int, vnodes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ring positions (0..2^64) of all virtual nodes in order, and their shards."""
    at = [
        (int.from_bytes(hashlib.blake2b(f"{seed}/{s}/{v}".encode(), digest_size=8).digest(), "big"), s)
        for s in range(shards)
        for v in range(vnodes)
    ]
    at.sort()
    return np.array([p for p, _ in at], dtype=np.uint64), np.array([s for _, s in at])


def plan_ring(counts: dict[int, int], shards: int, bins: int, vnodes: int = VNODES, seed: int = 7) -> list[tuple]:
    """Pieces (bin, from_rank, to_rank, shard, slot0) that place every row; ranks count from 0."""
    points, owner = _points(shards, vnodes, seed)
    total = sum(counts.values())
    room = np.full(shards, total // shards, dtype=np.int64)
    in_order = list(dict.fromkeys(owner.tolist()))
    for s in in_order[: total % shards]:
        room[s] += 1
    width = 2**64 // bins
    home = {b: int(np.searchsorted(points, np.uint64(b * width))) % len(points) for b in counts}
    used = [0] * shards
    pieces, waiting = [], []

    def put(b: int, lo: int, hi: int, s: int) -> None:
        pieces.append((b, lo, hi, s, used[s]))
        used[s] += hi - lo
        room[s] -= hi - lo

    for b in sorted(counts):
        s = int(owner[home[b]])
        k = min(counts[b], int(room[s]))
        if k:
            put(b, 0, k, s)
        if k < counts[b]:
            waiting.append((b, k))
    alive = np.flatnonzero(room[owner] > 0)
    for b, lo in waiting:
        while lo < counts[b]:
            alive = alive[room[owner[alive]] > 0]
            nxt = alive[np.searchsorted(alive, home[b]) % len(alive)]
            s = int(owner[nxt])
            k = min(counts[b] - lo, int(room[s]))
            put(b, lo, lo + k, s)
            lo += k
    return pieces


def shard_ring(
    docs: DataFrame, shards: int = 16, bins: int = BINS, vnodes: int = VNODES, seed: int = 7
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row."""
    spark = docs.sparkSession
    rows = keyed(docs).select(
        "did",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("crc"),
    )
    key = F.xxhash64(F.lit(seed), "did", "crc", "size")
    rows = rows.withColumn("bin", F.pmod(key, F.lit(bins)).cast("int"))
    counts = {r["bin"]: r["n"] for r in rows.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    pieces = plan_ring(counts, shards, bins, vnodes, seed)
    plan = spark.createDataFrame(pieces, "bin int, lo long, hi long, shard int, base long")
    ranked = rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy("bin").orderBy("did", "crc", "size")) - 1
    )
    placed = ranked.join(F.broadcast(plan), "bin").where("rank >= lo AND rank < hi")
    return placed.select(
        real_id("did").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("base") + F.col("rank") - F.col("lo")).cast("long").alias("slot"),
    )
