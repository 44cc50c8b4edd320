"""Substring dedup of words by prefix-partitioned suffix trees.

A window of ``length`` words counts as repeated where its words also start in a
document with a smaller id.  The suffixes that matter are found first: anchors
chosen by content (the least hash in ``width`` window starts) stand for blocks
of windows; only anchors whose key occurs in two documents go on.

Equal blocks are one leaf of the trees, which carries the smallest and the
largest id of its occurrences.  Where the blocks of a key differ and first occur in
different documents, the suffixes of its leaves, ``length`` words deep, are split into groups by
variable-length prefixes: 3 words, 8 words where the group of 3 is larger than
``group``, all words where that of 8 is.  Each group's suffix tree is read off
its sorted suffixes: neighbours that agree in ``length`` words lie under one
internal node of that depth, and the node's smallest id decides for all
occurrences of all its leaves.  A prefix of all words is such a node by itself
and is settled by an aggregation, so a passage shared by very many documents is
never gathered in a task.  A key with one content is an edge without a branch,
and one whose contents all first occur in the same document has one smallest id
in all its nodes: both are decided by that id, without writing suffixes out.

Edge cases: null is the empty text; texts of fewer words than ``length`` have no
window; rows that repeat an id don't count as smaller than each other, and each has its own result; a null id
is smaller than all others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import _bytes as B
from weft.llm._rows import join_on, keyed, real_id
from weft.llm._shared import saved

LENGTH, WIDTH, GRAM, GROUP = 13, 8, 3, 4096
PREFIXES = (3, 8)
#: Bits of ``loc`` for the number of a block's further starts.
MORE_BITS = 4


def _anchors(length: int, width: int, gram: int, places: bool, base: list[int]):
    """(key, did), and with ``places`` (whole, tag, loc): loc packs first start and number of further starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, tag = b.column("did").to_numpy(), b.column("tag").to_numpy()
            for c in B.chunks(b.column("text")):
                w = B.words(c)
                symbols = B.word_symbols(c, w, base)
                p = B.Prefix(symbols, base)
                a = B.anchors(p, B.rolling(B.packed(symbols), gram), w.off, length, width)
                row = a.row + c.first
                out = {"key": pa.array(B.signed(a.key)), "did": pa.array(did[row])}
                if places:
                    first = a.lo - w.off[a.row]
                    loc = (first << MORE_BITS) | (a.hi - a.lo)
                    out |= {"whole": pa.array(B.signed(a.whole)), "tag": pa.array(tag[row]), "loc": pa.array(loc)}
                yield pa.RecordBatch.from_pydict(out)

    return run


def _suffixes(length: int, limit: int = 1 << 14):
    """One row for each window of the leaves in ``leaves``: the leaf, the window's place in it and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, 256):
                b = whole_batch.slice(i, 256)
                words = [x.as_buffer().to_pybytes().split() for x in b.column("text")]
                leaves = b.column("leaves").flatten()
                doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("leaves")).to_numpy())
                loc = leaves.field("loc").to_numpy()
                n = (loc & ((1 << MORE_BITS) - 1)) + 1
                leaf = np.repeat(np.arange(len(loc)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = (loc >> MORE_BITS)[leaf] + at
                for j in range(0, len(leaf), limit):
                    k = leaf[j : j + limit]
                    places = zip(doc[k].tolist(), start[j : j + limit].tolist(), strict=True)
                    out = {x: leaves.field(x).take(pa.array(k)) for x in ("key", "whole", "least", "most")}
                    out["at"] = pa.array(at[j : j + limit].astype(np.int32))
                    out["suffix"] = pa.array([b" ".join(words[d][s : s + length]) for d, s in places], pa.binary())
                    yield pa.RecordBatch.from_pydict(out)

    return run


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by (suffix, least): those under a deep node that has a smaller id than their leaf's largest."""
    node, node_least = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        suffix, least = b.column("suffix"), b.column("least").to_numpy()
        branch = np.ones(b.num_rows, bool)
        branch[1:] = pc.not_equal(suffix[1:], suffix[:-1]).to_numpy(zero_copy_only=False)
        branch[0] = suffix[0].as_py() != node
        first = np.maximum.accumulate(np.where(branch, np.arange(b.num_rows), -1))
        under = np.where(first >= 0, least[first], node_least)
        node, node_least = suffix[b.num_rows - 1].as_py(), under[-1]
        keep = pa.array(under < b.column("most").to_numpy())
        out = {x: b.column(x).filter(keep) for x in ("key", "whole", "at")}
        yield pa.RecordBatch.from_pydict(out | {"least": pa.array(under).filter(keep)})


def repeated_windows(
    base: DataFrame, length: int = LENGTH, width: int = WIDTH, group: int = GROUP, prefixes: tuple = PREFIXES,
    seed: int = B.SEED,
) -> DataFrame:
    """(did, tag, lo, mask): for each bit i of mask, window lo + i of a row also starts in a document with a smaller id.

    ``base`` has did, text and tag, the whole hash of the text: both name a row, also among many that repeat an id.
    """
    gram = min(GRAM, length)
    width = max(1, min(width, length - gram + 1, 16))
    points = B.bases(seed)
    keys = base.mapInArrow(_anchors(length, width, gram, False, points[: B.PAIR]), "key long, did long")
    keys = keys.groupBy("key").agg(F.min("did").alias("a"), F.max("did").alias("z"))
    keys = saved(keys.where("a < z").select("key"))
    found = base.mapInArrow(_anchors(length, width, gram, True, points), "key long, did long, whole long, tag long, loc long")
    found = saved(found.join(keys, "key"))
    leaves = found.groupBy("key", "whole").agg(F.min(F.struct("did", "tag", "loc")).alias("first"), F.max("did").alias("most"))
    leaves = saved(leaves.select("key", "whole", "first.*", "most").withColumnRenamed("did", "least"))
    branching = leaves.groupBy("key").agg(F.min("least").alias("a"), F.max("least").alias("z"))
    branching = saved(branching.where("a < z").select("key"))
    rows = saved(_leaf_suffixes(leaves.join(branching, "key"), base, length))
    more = F.col("loc").bitwiseAND((1 << MORE_BITS) - 1).cast("int")
    edges = leaves.join(branching, "key", "left_anti").where("least < most")
    edges = edges.select("key", "whole", "least", ((F.lit(2) ** (more + 1)) - 1).cast("int").alias("mask"))
    nodes = _deep_nodes(rows, length, group, prefixes).groupBy("key", "whole", "least")
    nodes = nodes.agg(F.bit_or(F.expr("shiftleft(1, at)")).alias("mask"))
    hits = saved(edges.unionByName(nodes))
    lo = F.shiftright("loc", MORE_BITS).cast("int").alias("lo")
    out = found.join(hits, ["key", "whole"]).where("did > least").select("did", "tag", lo, "mask")
    return saved(out, drop=(found, leaves, rows, hits))


def _leaf_suffixes(leaves: DataFrame, base: DataFrame, length: int) -> DataFrame:
    """(key, whole, least, most, at, suffix): the windows of each leaf, read from its first occurrence."""
    by_doc = leaves.groupBy(F.col("least").alias("did"), "tag").agg(
        F.collect_list(F.struct("key", "whole", "least", "most", "loc")).alias("leaves")
    )
    texts = base.join(by_doc, ["did", "tag"]).select("text", "leaves")
    kind = "key long, whole long, least long, most long, at int, suffix binary"
    return texts.mapInArrow(_suffixes(length), kind)


def _deep_nodes(rows: DataFrame, length: int, group: int, prefixes: tuple) -> DataFrame:
    """(key, whole, at, least): windows of leaves under a node ``length`` words deep, whose smallest id is below the leaf's largest."""
    text = F.col("suffix").cast("string")
    prefix = {p: F.xxhash64(F.lit(p), F.substring_index(text, " ", p)) for p in prefixes if p < length}
    trees, rest = [], rows
    for p, code in prefix.items():
        rest = rest.withColumn("prefix", code)
        large = saved(rest.groupBy("prefix").agg(F.count("*").alias("m")).where(F.col("m") > group).select("prefix"))
        trees.append(rest.join(large, "prefix", "left_anti"))
        rest = rest.join(large, "prefix", "left_semi")
        if large.isEmpty():
            rest = None
            break
    out = None
    if trees:
        grouped = trees[0]
        for t in trees[1:]:
            grouped = grouped.unionByName(t)
        grouped = grouped.repartition("prefix").sortWithinPartitions("suffix", "least")
        out = grouped.mapInArrow(_tree, "key long, whole long, at int, least long")
    if rest is not None:
        rest = rest.drop("prefix")
        nodes = saved(rest.groupBy("suffix").agg(F.min("least").alias("under")))
        deep = rest.join(nodes, "suffix").where("under < most").select("key", "whole", "at", F.col("under").alias("least"))
        out = deep if out is None else out.unionByName(deep)
    return out


def _runs(spans: list[dict], length: int) -> Iterator[tuple[int, int]]:
    """Words (from, to) that each span's windows cover."""
    for x in spans:
        lo, mask = x["lo"], x["mask"]
        while mask:
            skip = (mask & -mask).bit_length() - 1
            lo, mask = lo + skip, mask >> skip
            n = (~mask & (mask + 1)).bit_length() - 1
            yield lo, lo + n - 1 + length
            lo, mask = lo + n, mask >> n


def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for did, text, spans in zip(b.column("did").to_pylist(), b.column("text"), b.column("spans"), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n = len(words)
                if spans.is_valid:
                    kept, at = [], 0
                    for lo, end in sorted(_runs(spans.as_py(), length)):
                        if lo > at:
                            kept += words[at:lo]
                        at = max(at, end)
                    words = kept + words[at:]
                for x, v in zip(out, (did, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())],
                names=["did", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def strip_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    base = keyed(docs).select("did", F.col("rh").alias("tag"), "text")
    spans = repeated_windows(base, length, **options)
    by_doc = spans.groupBy("did", "tag").agg(F.collect_list(F.struct("lo", "mask")).alias("spans"))
    both = join_on(base, by_doc, ["did", "tag"], "left").select("did", "text", "spans")
    out = both.mapInArrow(_strip(length), "did long, n_words long, n_removed long, kept_sha256 string")
    return out.select(real_id("did").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
