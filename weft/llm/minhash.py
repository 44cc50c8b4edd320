"""Near-duplicate documents by min-max hashing.

A document is its set of distinct k-word shingles.  Each of ``perms`` random
permutations gives two values, the least and the greatest image of the set;
either agrees between two sets with the probability of their Jaccard similarity,
so half the hash evaluations fill a signature.  Bands of ``rows`` values are
bucket keys; a pair of similarity 0.8 shares none of 24 bands of 4 values with
probability 3e-6.  Links are confirmed on the full sets, of shingles named by 62
bits from two bases of a prime field (``_bytes``); sets are the same if two such
names from different bases agree.

Documents with the same set are one class from the start (copies are never
expanded).  In each bucket every class is compared with one pivot, the class that
shares the most buckets with others, which finds nearly all components.  Between
components that still meet in a bucket, links are sought exactly: by prefix
filtering over the sets of all classes in such buckets.

Edge cases: with fewer words than k the whole sequence is one shingle; a
document without words (or null) has an empty set and stays alone; repeated rows
are documents with the same set; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import _bytes as B
from weft.llm._rows import join_on, keyed, matching, real_id
from weft.llm._shared import saved
from weft.llm.components import components

PERMS, ROWS, SEED = 48, 4, 5


def shingle_sets(c: B.Chunk, k: int, base: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, off): the sorted distinct shingle hashes of each text of the chunk (A-Z lower-cased)."""
    c = c._replace(data=B.LOWER[c.data])
    w = B.words(c)
    pair = base[: B.PAIR]
    p = B.Prefix(B.word_symbols(c, w, pair), pair)
    n = w.off[1:] - w.off[:-1]
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    lo = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + w.off[row]
    h = p.runs(lo, np.minimum(lo + k, w.off[row + 1]))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def band_keys(h: np.ndarray, off: np.ndarray, perms: int, rows: int, seed: int) -> np.ndarray:
    """Bucket keys (texts x bands) from the least and greatest images under each permutation."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 2**63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, perms, dtype=np.uint64)
    signature = np.empty((len(off) - 1, 2 * perms), np.uint64)
    for i in range(perms):
        image = h * mult[i] + add[i]
        image ^= image >> np.uint64(32)
        signature[:, 2 * i] = np.minimum.reduceat(image, off[:-1])
        signature[:, 2 * i + 1] = np.maximum.reduceat(image, off[:-1])
    keys = np.zeros((len(off) - 1, 2 * perms // rows), np.uint64)
    for j in range(rows):
        keys = B.mix(keys + signature[:, j::rows])
    return B.mix(keys + np.arange(keys.shape[1], dtype=np.uint64))


def set_names(h: np.ndarray, off: np.ndarray, base: list[int]) -> list[np.ndarray]:
    """Two hashes of each text's set, from different bases."""
    p = B.Prefix([B.fold(B.mix(h + np.uint64(j))) for j in range(len(base))], base)
    return [p.runs(off[:-1], off[1:], pair) for pair in (0, 1)]


def _signatures(k: int, perms: int, rows: int, seed: int, base: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, rh = b.column("did").to_numpy(), b.column("rh").to_numpy()
            for c in B.chunks(b.column("text")):
                h, off = shingle_sets(c, k, base)
                n = off[1:] - off[:-1]
                some = np.flatnonzero(n)
                node, check = set_names(h, off, base)
                bands = 2 * perms // rows
                width = np.where(n > 0, bands, 0)
                keys = band_keys(h, np.append(off[some], len(h)), perms, rows, seed) if len(some) else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(width)).astype(np.int32)), pa.array(B.signed(keys).ravel())
                )
                at = slice(c.first, c.first + len(n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(did[at]), pa.array(rh[at]), pa.array(n), pa.array(B.signed(node)), pa.array(B.signed(check)), lists],
                    names=["did", "rh", "n", "node", "check", "bands"],
                )

    return run


def _sets(k: int, base: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node").to_numpy()
            for c in B.chunks(b.column("text")):
                h, off = shingle_sets(c, k, base)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(B.signed(h)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[c.first : c.first + len(off) - 1]), lists], names=["node", "shingles"]
                )

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose sets' intersection is at least ``percent`` of their union."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("common")
    both = both.select("a", "b", "sa", "sb", common.alias("common"))
    return both.where(100 * F.col("common").cast("long") >= percent * union.cast("long")).select("a", "b")


def _renamed(rows: DataFrame, twins: DataFrame) -> DataFrame:
    """Rows whose node is among ``twins`` get one that depends on ``check`` too."""
    t = rows.join(twins.withColumn("_twin", F.lit(True)), "node", "left")
    return saved(t.withColumn("node", F.when(F.col("_twin"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("_twin"))


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, perms: int = PERMS, rows: int = ROWS, seed: int = SEED
) -> DataFrame:
    """(did, rh, n, component): every row with its set size and its component's smallest did."""
    base = keyed(docs)
    base_points = B.bases(B.SEED + seed)
    kind = "did long, rh long, n long, node long, check long, bands array<long>"
    marked = saved(base.mapInArrow(_signatures(k, perms, rows, seed, base_points), kind))
    nodes = marked.where("n > 0").groupBy("node", "check").agg(
        F.min(F.struct("did", "rh")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    nodes = saved(nodes.select("node", "check", "rep.did", "rep.rh", "n", "bands"))
    twins = nodes.groupBy("node").agg(F.count("*").alias("m")).where("m > 1").select("node")
    if not twins.isEmpty():  # different sets under one name: each gets a new one
        nodes, marked = (_renamed(t, saved(twins)) for t in (nodes, marked))
    rows_ = nodes.select("node", F.explode("bands").alias("key"))
    buckets = saved(rows_.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    members = saved(rows_.join(buckets, "key"))
    central = saved(members.groupBy("node").agg(F.sum("m").alias("weight")))
    pivots = members.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("pivot"))
    pivots = saved(pivots)
    some = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "did", "rh")
    sets = saved(join_on(some, base, ["did", "rh"]).dropDuplicates(["node"]).mapInArrow(_sets(k, base_points), "node long, shingles array<long>"))
    pairs = members.join(pivots, "key").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    links = saved(_confirmed(saved(pairs.distinct()), sets, percent))
    parts = saved(components(links))
    fresh = saved(_confirmed(saved(_across(members, sets, parts, percent)), sets, percent))
    if not fresh.isEmpty():
        parts = saved(components(links.unionByName(fresh)))
    named = nodes.join(parts, "node", "left").select(
        "node", "did", F.coalesce("component", "node").alias("part")
    )
    least = saved(named.groupBy("part").agg(F.min("did").alias("component")))
    named = saved(named.join(least, "part").select("node", "component"), drop=(buckets, members, central, pivots, sets, nodes, least))
    out = marked.select("did", "rh", "n", "node").join(named, "node", "left")
    return out.select("did", "rh", "n", F.coalesce("component", "did").alias("component"))


def _across(members: DataFrame, sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link different components which still share a bucket, by prefix filtering.

    With the shingles in one order, rarest first, two sets that agree enough
    share one of the first n - ceil(n percent / 100) + 1 shingles of either, and
    from their first common one on enough are left in both for the overlap they
    need.  Shingles that only one set has come first and pair nobody.
    """
    m = members.select("key", "node").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    ends = m.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    m = saved(m.join(saved(ends), "key").select("node", "part").distinct())
    s = sets.join(m, "node").select("node", "part", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    common = s.groupBy("s").agg(F.count("*").alias("df"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    common = saved(common.where("df > 1").select("s", "df", (F.col("lo") < F.col("hi")).alias("mixed")))
    by_node = Window.partitionBy("node")
    s = s.join(common, "s").withColumn("own", F.col("n") - F.count("*").over(by_node))
    s = s.withColumn("r", F.row_number().over(by_node.orderBy("df", "s")))
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    after = (F.col("n") - F.col("own") - F.col("r") + 1).alias("after")  # shingles from this one on
    s = saved(s.where((F.col("own") + F.col("r") <= reach) & F.col("mixed")).select("s", "node", "part", "n", after))
    other = s.toDF("s", "node2", "part2", "n2", "after2")
    enough = (100 + percent) * F.least("after", "after2") >= percent * (F.col("n") + F.col("n2"))
    fits = enough & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (F.col("part") < F.col("part2"))
    pairs = s.join(other, "s").where(fits)
    return pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def near_components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    out = near_duplicates(docs, **options)
    return out.select(
        real_id("did").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        real_id("component").alias("component_id"),
        (F.col("did") == F.col("component")).alias("kept"),
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the rows with its smallest id, with all their columns."""
    keep = near_duplicates(docs, **options).where("did = component").select("did", "rh").distinct()
    return matching(docs, keep).select(*docs.columns)
