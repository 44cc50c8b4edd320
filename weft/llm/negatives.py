"""Hard negatives by a two-dimensional blocked matrix product: for anchors and their positives, close rows of other labels.

Scores are inner products of vectors in whole numbers, floor(scale * x).  Rows
are dealt to blocks of ``ROWS``, anchors to blocks of ``ANCHORS``, and both are
cut into chunks of dimensions.  A task multiplies one chunk of a block of anchors
with the same chunk of a block of rows; the partial tiles (int64) of the chunks
are shuffled to the tile's place and added there; a full tile is reduced to the
few rows that can still win, and these are ranked once more over all tiles.

There are two such products.  The first finds each anchor's positives, the best
other rows of its label: blocks hold rows whose labels share a hash, so only
tiles that may hold equal labels are made.  The second is of all blocks; each
anchor brings the windows of score that its positives span, and a tile keeps for
every window its best rows of other labels.

Tiles of anchors and all rows: the anchors are a stated query set.  Blocks are
formed by hash of a row's number, so neither a hot label nor equal rows make a
large block, and a tile has ROWS x ANCHORS cells at most.

Edge cases: rows with a null label or vector, or a null or non-finite component,
take no part.  Vectors of different lengths are filled up with zeros; an empty
vector scores 0.  A null id is smaller than all others and no anchor's; rows that
repeat an id are rows of their own, anchors too.  Equal scores are ranked by id.
An anchor without positives, and a positive without negatives, has no row, nor
has an empty table.  Scores that may not fit 64 bits raise an error.  Other
columns of the table, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._shared import saved
from weft.llm._ship import ship

ROWS, ANCHORS = 1024, 256
#: Dimensions of a chunk, and the most chunks that longer vectors are cut into.
CHUNK, MOST_CHUNKS = 32, 16
#: Groups of labels.
GROUPS = 16
#: Anchors' vectors of so many bytes may be broadcast; more are joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Doubles hold whole numbers up to here exactly.
EXACT = 1 << 53
NOTHING = np.iinfo(np.int64).min + 1

_BLOCK = "block int, grp int, chunk int, q binary, uids binary, ids binary, known binary, labels binary, windows binary"
_META = ("uids", "ids", "known", "labels")
_POSITIVE = "anchor long, anchor_id long, id long, score long"
_NEGATIVE = "anchor long, slot int, id long, score long"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in text.split(", ")])


@dataclass(frozen=True)
class Shape:
    """How vectors are cut: ``chunks`` of ``span`` whole numbers in ``kind``, which doubles multiply exactly or not."""

    chunks: int
    span: int
    kind: str
    exact: bool

    @classmethod
    def of(cls, dims: int, largest: int) -> Shape:
        if max(dims, 1) * largest * largest * 100 >= 1 << 63:
            raise ValueError(f"scores of {dims} components up to {largest} may not fit 64 bits")
        chunks = min(max(1, -(-dims // CHUNK)), MOST_CHUNKS)
        span = -(-max(dims, 1) // chunks)
        return cls(chunks, span, "<i4" if largest < 1 << 31 else "<i8", span * largest * largest < EXACT)

    def matrix(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.span).astype(np.float64 if self.exact else np.int64)


def quantised(rows: DataFrame, anchor: Column, scale: int, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(uid, id, label, anchor, grp, q): rows that take part, numbered, with whole components."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    kept = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite)
    number = F.col(label).cast("long")
    return kept.select(
        F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("id"), number.alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.pmod(F.xxhash64(number), F.lit(GROUPS)).cast("int").alias("grp"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("q"),
    )


def _packer(shape: Shape, positives: int) -> Callable[[pa.Table], pa.Table]:
    """A block's rows as one row for each chunk; what the rows are stands with the first."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("uid")
        q, windows = t.column("q").combine_chunks(), t.column("windows").to_pylist()
        lengths = np.asarray(q.value_lengths())
        full = np.zeros((t.num_rows, shape.chunks * shape.span), shape.kind)
        full[np.arange(full.shape[1]) < lengths[:, None]] = np.asarray(q.flatten())
        meta = {
            "uids": np.asarray(t.column("uid")), "ids": np.asarray(t.column("id").fill_null(0)),
            "known": np.asarray(t.column("id").is_valid()), "labels": np.asarray(t.column("label")),
            "windows": np.array([w + [-1] * (positives - len(w)) for w in windows], np.int64),
        }
        first = {k: v.tobytes() for k, v in meta.items()}
        names = {"block": t.column("block")[0].as_py(), "grp": t.column("grp")[0].as_py()}
        rows = []
        for k in range(shape.chunks):
            rows.append(names | {"chunk": k, "q": full[:, k * shape.span : (k + 1) * shape.span].tobytes()} | (first if k == 0 else {}))
        return pa.Table.from_pylist(rows, _schema(_BLOCK))

    return run


@dataclass(frozen=True)
class Grid:
    """How many blocks of ``size`` rows each group of labels has, and the number of its first one."""

    size: int
    base: tuple[int, ...]
    blocks: tuple[int, ...]

    @classmethod
    def of(cls, size: int, counts: dict[int, int]) -> Grid:
        blocks = tuple(-(-counts.get(g, 0) // size) for g in range(GROUPS))
        return cls(size, tuple(sum(blocks[:g]) for g in range(GROUPS)), blocks)

    def block(self) -> Column:
        """A row's block: one of its group's, by its number."""
        own = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("grp") + 1)
        return (own(self.base) + F.pmod(F.xxhash64("uid"), F.greatest(own(self.blocks), F.lit(1)))).cast("int")


def _blocks(rows: DataFrame, grid: Grid, shape: Shape, positives: int) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = rows.withColumn("block", grid.block()).repartition(n, "block")
    return saved(d.groupBy("block").applyInArrow(_packer(shape, positives), _BLOCK))


_PARTIAL = "a int, b int, tile binary, " + ", ".join(f"{side}_{c} binary" for side in "ab" for c in (*_META, "windows") if (side, c) != ("b", "windows"))


def _multiplier(shape: Shape):
    """The partial tile of each pair of chunks, anchors by rows."""
    schema = _schema(_PARTIAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at = {c: batch.column(c)[k].as_py() for c in ("a_q", "b_q")}
                tile = shape.matrix(at["a_q"]) @ shape.matrix(at["b_q"]).T
                made = pa.array([tile.astype(np.int64).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([made if c == "tile" else batch.column(c).slice(k, 1) for c in schema.names], schema=schema)

    return run


def _tile(t: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The sum of a tile's parts, with its rows in the order of their ids, and what anchors (a_) and rows (b_) are."""
    kinds = {"known": np.bool_}
    meta = {}
    for c in t.column_names:
        if c[:2] in ("a_", "b_"):
            meta[c] = np.frombuffer(next(x for x in t.column(c).to_pylist() if x is not None), kinds.get(c[2:], np.int64))
    total = np.zeros((len(meta["a_uids"]), len(meta["b_uids"])), np.int64)
    for part in t.column("tile"):
        total += np.frombuffer(part.as_buffer(), np.int64).reshape(total.shape)
    order = np.lexsort((meta["b_uids"], meta["b_ids"], meta["b_known"]))
    for c in _META:
        meta[f"b_{c}"] = meta[f"b_{c}"][order]
    return total[:, order], meta


def _ranked(tile: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each anchor's kept rows by falling score, then by id; NOTHING after them."""
    tile = np.where(keep, tile, NOTHING)
    order = np.argsort(-tile, axis=1, kind="stable")
    return order, np.take_along_axis(tile, order, 1)


def _known(meta: dict[str, np.ndarray], side: str, k: int) -> int | None:
    return int(meta[f"{side}_ids"][k]) if meta[f"{side}_known"][k] else None


def _best_positives(positives: int):
    """A tile's best other rows of each anchor's label."""

    def run(t: pa.Table) -> pa.Table:
        tile, m = _tile(t)
        order, score = _ranked(tile, (m["a_labels"][:, None] == m["b_labels"]) & (m["a_uids"][:, None] != m["b_uids"]))
        rows = []
        for i, uid in enumerate(m["a_uids"].tolist()):
            for j, s in zip(order[i, :positives].tolist(), score[i, :positives].tolist(), strict=True):
                if s != NOTHING:
                    rows.append({"anchor": uid, "anchor_id": _known(m, "a", i), "id": _known(m, "b", j), "score": s})
        return pa.Table.from_pylist(rows, _schema(_POSITIVE))

    return run


def _best_negatives(positives: int, negatives: int, low: int, high: int):
    """A tile's best rows of other labels within each window, low * score to high * score over 100."""

    def run(t: pa.Table) -> pa.Table:
        tile, m = _tile(t)
        order, score = _ranked(tile, m["a_labels"][:, None] != m["b_labels"])
        windows, rows = m["a_windows"].reshape(-1, positives), []
        for i, uid in enumerate(m["a_uids"].tolist()):
            falling = -score[i]
            for slot, p in enumerate(windows[i].tolist()):
                if p < 0:  # no score lies between low and high parts of it
                    continue
                first = int(np.searchsorted(falling, -(high * p // 100)))
                for j, s in zip(order[i, first : first + negatives].tolist(), score[i, first : first + negatives].tolist(), strict=True):
                    if s != NOTHING and 100 * s >= low * p:
                        rows.append({"anchor": uid, "slot": slot, "id": _known(m, "b", j), "score": s})
        return pa.Table.from_pylist(rows, _schema(_NEGATIVE))

    return run


def _tiles(rows: DataFrame, anchors: DataFrame, met: Column, shape: Shape, small: bool, reduce: Callable, schema: str) -> DataFrame:
    """What ``reduce`` leaves of the tiles of each block of rows with the blocks of anchors in ``met`` (array of numbers)."""
    b = rows.select(F.explode(met).alias("a"), F.col("block").alias("b"), "chunk", F.col("q").alias("b_q"), *[F.col(c).alias(f"b_{c}") for c in _META])
    a = anchors.select(F.col("block").alias("a"), "chunk", F.col("q").alias("a_q"), *[F.col(c).alias(f"a_{c}") for c in (*_META, "windows")])
    pairs = b.join(F.broadcast(a) if small else a, ["a", "chunk"])
    partial = pairs.mapInArrow(_multiplier(shape), _PARTIAL)
    return partial.groupBy("a", "b").applyInArrow(reduce, schema)


def _first(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The best ``n`` rows of each group, with their ``place`` from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("id"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def mine(
    rows: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, **names: str
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor and each of its ``positives`` first rows of its label: the ``negatives`` first rows of other labels
    whose score is between ``low`` and ``high`` percent of the positive's (``high`` of at most 100).  ``anchor`` tells
    which rows are anchors; ``names`` are those of the columns vec_id, label and vector.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError(f"low and high must be percents in order, not {low} and {high}")
    ship(rows.sparkSession)
    q = saved(quantised(rows, anchor, scale, **names))
    size = F.max(F.array_max(F.transform("q", lambda x: F.abs(x.cast("double")))))
    stats = q.groupBy("grp").agg(
        F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("q")).alias("dims"), size.alias("largest")
    ).collect()  # a row for each group
    dims, n_anchors = max((s["dims"] for s in stats), default=0), sum(s["anchors"] for s in stats)
    shape = Shape.of(dims, int(max((s["largest"] or 0 for s in stats), default=0)))
    grid = Grid.of(ROWS, {s["grp"]: s["n"] for s in stats})
    asked = Grid.of(ANCHORS, {s["grp"]: s["anchors"] for s in stats})
    small = n_anchors * (8 * dims + 100) <= BROADCAST_BYTES
    blocks = _blocks(q.withColumn("windows", F.array().cast("array<long>")), grid, shape, positives)
    ask = q.where("anchor")

    alike = [F.sequence(F.lit(x), F.lit(x + n - 1)) if n else F.array().cast("array<int>") for x, n in zip(asked.base, asked.blocks, strict=True)]
    same = F.element_at(F.array(*alike), F.col("grp") + 1)
    bare = _blocks(ask.withColumn("windows", F.array().cast("array<long>")), asked, shape, positives)
    found = _tiles(blocks, bare, same, shape, small, _best_positives(positives), _POSITIVE)
    found = saved(_first(found, positives, "anchor").select("anchor", "anchor_id", F.col("id").alias("positive_id"), (F.col("place") - 1).alias("slot"), "score"))

    spans = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "score"))).alias("w"))  # few for each anchor
    spans = spans.select(F.col("anchor").alias("uid"), F.col("w.score").alias("windows"))
    every = F.sequence(F.lit(0), F.lit(sum(asked.blocks) - 1)) if n_anchors else F.array().cast("array<int>")
    wanted = _blocks(ask.join(spans, "uid"), asked, shape, positives)
    close = _first(_tiles(blocks, wanted, every, shape, small, _best_negatives(positives, negatives, low, high), _NEGATIVE), negatives, "anchor", "slot")
    close = close.select("anchor", "slot", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.withColumnRenamed("score", "positive_score").join(close, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
