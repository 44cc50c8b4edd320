"""Substring dedup of bytes by prefix-free parsing.

Rolling-hash triggers (the least 16-gram hash in a window of ``width`` starts)
cut texts into phrases; a phrase reaches on over its trigger to the end of its
last window of ``length`` bytes, so equal windows lie at equal places of
phrases with the same trigger content.  The parse is the table of phrase
occurrences, the dictionary that of distinct phrases by (key, whole) with the
number of their occurrences:

* a phrase that occurs twice is repeated in all its windows, and is settled by
  the parse alone, however many copies there are;
* phrases that share a trigger's key and differ elsewhere are put into corpus
  order by the suffix array of their part of the dictionary, to the depth of
  ``length`` bytes: neighbours that agree so far are repeats.

A key with more than ``group`` distinct phrases isn't gathered in one task.  Its
phrases are cut into shorter blocks of window starts that are settled the same
way, at last into single windows, whose key is the whole.

Phrases are told apart by 124 bits from four bases of a prime field (``_bytes``),
neighbours in corpus order by their bytes.

Repeats shorter than ``length`` are kept, but reported: ``shared_samples`` counts
a document's sampled strings of SAMPLE bytes that another document has too.
Samples are winnowed, so any SAMPLE + GAP - 1 bytes in common share one.

Edge cases: null is the empty text; a text shorter than ``length`` has no
window; repeated rows are documents of their own, so they are repeats of each
other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import _bytes as B
from weft.llm._rows import join_on, keyed, real_id
from weft.llm._shared import saved

LENGTH, WIDTH, GRAM, GROUP = 400, 200, 16, 256
STEPS = (16, 1)
SAMPLE, GAP = 150, 100
_PHRASE = "did long, rh long, lo int, hi int, at int, key long, whole long, times int"


def _phrases(length: int, width: int, gram: int, points: list[int]):
    """Phrases of whole texts.  One that occurs several times in a chunk is repeated: its first occurrence stands for
    ``times``, and what the others cover comes as rows without a key, joined where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, rh = b.column("did").to_numpy(), b.column("rh").to_numpy()
            for c in B.chunks(b.column("text")):
                p = B.Prefix.of_bytes(c.data, points)
                a = B.anchors(p, B.rolling(B.byte_symbols(c.data), gram), c.off, length, width)
                first, times = _distinct(a.key, a.whole)
                more = np.ones(len(a.row), bool)
                more[first] = False
                row, lo, hi, at, key, whole = (x[first] for x in a)
                if more.any():
                    r, x, y = a.row[more], a.lo[more], a.hi[more]
                    new = np.ones(len(r), bool)
                    new[1:] = (r[1:] != r[:-1]) | (x[1:] > y[:-1] + length)
                    start = np.flatnonzero(new)
                    y = np.maximum.reduceat(y, start)
                    row, lo, hi, at = (np.append(u, v) for u, v in ((row, r[start]), (lo, x[start]), (hi, y), (at, x[start])))
                settled = np.arange(len(row)) >= len(first)
                pad = np.zeros(len(row) - len(first), np.uint64)
                base, r = c.off[row], row + c.first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(did[r]), pa.array(rh[r]),
                        *(pa.array((x - base).astype(np.int32)) for x in (lo, hi, at)),
                        pa.array(B.signed(np.append(key, pad)), mask=settled),
                        pa.array(B.signed(np.append(whole, pad)), mask=settled),
                        pa.array(np.append(times, pad.astype(np.int64)).astype(np.int32)),
                    ],
                    names=["did", "rh", "lo", "hi", "at", "key", "whole", "times"],
                )

    return run


def _distinct(key: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first of each distinct (key, whole), and how often it occurs."""
    order = np.lexsort((whole, key))  # stable
    k, w = key[order], whole[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
    start = np.flatnonzero(new)
    return order[start], np.diff(np.append(start, len(order)))


def _samples(sample: int, gap: int, base: list[int]):
    """(key, did) of each text's winnowed strings of ``sample`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did = b.column("did").to_numpy()
            for c in B.chunks(b.column("text")):
                p = B.Prefix.of_bytes(c.data, base)
                a = B.anchors(p, B.rolling(B.byte_symbols(c.data), sample), c.off, sample + gap - 1, gap)
                d = did[a.row + c.first]
                first, _ = _distinct(a.key, d)
                yield pa.RecordBatch.from_arrays([pa.array(B.signed(a.key[first])), pa.array(d[first])], names=["key", "did"])

    return run


def shared_samples(base: DataFrame, sample: int = SAMPLE, gap: int = GAP, seed: int = B.SEED) -> DataFrame:
    """(did, n_shared): how many of a document's samples occur in a document with another id; ids without any are left out."""
    found = base.mapInArrow(_samples(sample, gap, B.bases(seed)[: B.PAIR]), "key long, did long")
    both = found.groupBy("key").agg(F.min("did").alias("a"), F.max("did").alias("z")).where("a < z").select("key")
    return found.join(saved(both), "key").groupBy("did").agg(F.count_distinct("key").alias("n_shared"))


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    c = next(B.chunks(column, 1 << 62))
    return c.data, c.off


def _cut(length: int, step: int, base: list[int]):
    """Blocks of at most ``step`` window starts, by distance from the trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, 1024):
                b = whole_batch.slice(i, 1024)
                data, off = _buffer(b.column("ctx"))
                lo, hi, at = (b.column(x).to_numpy().astype(np.int64) for x in ("lo", "hi", "at"))
                near, far = (at - hi) // step, (at - lo) // step
                n = far - near + 1
                row = np.repeat(np.arange(len(n)), n)
                q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + near[row]
                shift = off[row] - lo[row]  # from places in the text to places in data
                first = np.maximum(lo[row], at[row] - q * step - step + 1)
                last = np.minimum(hi[row], at[row] - q * step)
                p = B.Prefix.of_bytes(data, base)
                top = at[row] - q * step
                key = p.runs(top + shift, top - step + 1 + length + shift) ^ B.mix(q.astype(np.uint64) + np.uint64(step))
                full = B.placed(p.runs(first + shift, last + length + shift, 1), at[row] - first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.column("did").to_numpy()[row]), pa.array(b.column("rh").to_numpy()[row]),
                        *(pa.array(x.astype(np.int32)) for x in (lo[row], first, last, at[row])),
                        pa.array(B.signed(key)), pa.array(B.signed(full)), pa.array(np.ones(len(row), np.int32)),
                    ],
                    names=["did", "rh", "from_lo", "lo", "hi", "at", "key", "whole", "times"],
                )

    return run


def _suffix_array(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``start`` by their first ``length`` bytes, and whether each equals the one before."""
    seen = np.lib.stride_tricks.sliding_window_view(data, length)[start]
    text = np.ascontiguousarray(seen).view(f"S{length}").ravel()
    order = np.argsort(text, kind="stable")
    s = seen[order]
    same = np.zeros(len(order), bool)
    same[1:] = (s[1:] == s[:-1]).all(axis=1)
    return order, same


def _sorted_repeats(length: int, limit: int = 1 << 18):
    """Repeated windows of single phrases, for phrases sorted by key; whole keys are handled at once."""

    def settle(b: pa.RecordBatch) -> pa.RecordBatch:
        data, off = _buffer(b.column("ctx"))
        lo, hi = (b.column(x).to_numpy().astype(np.int64) for x in ("lo", "hi"))
        n = hi - lo + 1
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order, same = _suffix_array(data, off[row] + at, length)
        hit = same.copy()
        hit[:-1] |= same[1:]
        found = np.zeros(len(row), bool)
        found[order] = hit
        found &= b.column("single").to_numpy(zero_copy_only=False)[row]
        place = np.flatnonzero(found)
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (row[place[1:]] != row[place[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1 if len(place) else first
        r, s, e = row[place[first]], at[place[first]], at[place[last]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(b.column("did").to_numpy()[r]), pa.array(b.column("rh").to_numpy()[r]),
                pa.array((lo[r] + s).astype(np.int32)), pa.array((lo[r] + e + length).astype(np.int32)),
            ],
            names=["did", "rh", "lo", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, 256):
                b = whole_batch.slice(i, 256)
                held.append(b)
                size += len(_buffer(b.column("ctx"))[0])
                if size < limit:
                    continue
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                key = t.column("key").to_numpy()
                cut = int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1 if (key[1:] != key[:-1]).any() else 0
                if cut:
                    yield settle(t.slice(0, cut))
                    held, t = [t.slice(cut)], t.slice(cut)
                    size = len(_buffer(t.column("ctx"))[0])
        if held:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()
            if t:
                yield settle(t[0])

    return run


def _settle(blocks: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(spans of blocks that occur twice, blocks left open with the number of phrases of their key)."""
    classes = saved(blocks.groupBy("key", "whole").agg(F.sum("times").alias("n"), F.min("did").alias("first")))
    keys = classes.groupBy("key").agg(F.count("*").alias("phrases"), F.sum((F.col("n") == 1).cast("int")).alias("singles"))
    keys = saved(keys.where("phrases > 1 AND singles > 0").select("key", "phrases"))
    tagged = blocks.join(classes, ["key", "whole"])
    full = tagged.where("n > 1").select("did", "rh", "lo", (F.col("hi") + length).alias("end"))
    # A witness for each phrase; dealt anew, so that the join above may split a phrase with very many occurrences.
    one = tagged.where("n > 1 AND did = first").repartition("key", "whole").dropDuplicates(["key", "whole"])
    left = tagged.where("n = 1").unionByName(one).join(keys, "key")
    return full, left.withColumn("single", F.col("n") == 1).drop("n", "first", "whole", "times")


def repeated_spans(
    base: DataFrame, length: int = LENGTH, width: int = WIDTH, group: int = GROUP, steps: tuple = STEPS, seed: int = B.SEED
) -> DataFrame:
    """(did, rh, lo, end): byte spans covered by windows that start elsewhere too, of ``keyed`` documents."""
    gram = min(GRAM, length // 4)
    width = min(width, length - gram)
    points = B.bases(seed)
    phrases = saved(base.mapInArrow(_phrases(length, width, gram, points), _PHRASE))
    keyed_phrases = phrases.where("key IS NOT NULL")
    twice = keyed_phrases.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1").select("key")
    some = saved(keyed_phrases.join(saved(twice), "key"))
    full, left = _settle(some, length)
    inner = phrases.where("key IS NULL").select("did", "rh", "lo", (F.col("hi") + length).alias("end"))
    spans = [full, inner]
    ctx = F.substring(F.col("text").cast("binary"), F.col("lo") + 1, F.col("hi") - F.col("lo") + length)
    open_ = saved(join_on(left, base, ["did", "rh"]).withColumn("ctx", ctx).drop("text"))
    source = open_
    for step in (*(s for s in steps if s < width), None):
        few = source.where(F.col("phrases") <= group).select("key", "did", "rh", "lo", "hi", "single", "ctx")
        few = few.repartition("key").sortWithinPartitions("key")
        spans.append(few.mapInArrow(_sorted_repeats(length), "did long, rh long, lo int, end int"))
        source = source.where(F.col("phrases") > group)
        if step is None or source.isEmpty():
            break
        blocks = saved(source.mapInArrow(_cut(length, step, points), _PHRASE.replace("lo int", "from_lo int, lo int")))
        full, left = _settle(blocks, length)
        spans.append(full)
        if step == 1:
            break
        parents = source.select("did", "rh", F.col("lo").alias("from_lo"), "ctx")
        inner = F.substring(F.col("ctx"), F.col("lo") - F.col("from_lo") + 1, F.col("hi") - F.col("lo") + length)
        source = saved(join_on(left, parents, ["did", "rh", "from_lo"]).withColumn("ctx", inner).drop("from_lo"))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return saved(out, drop=(phrases, some, open_))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for did, text, spans in zip(b.column("did").to_pylist(), b.column("text"), b.column("spans"), strict=True):
            data = text.as_buffer() if text.is_valid else b""
            kept, removed, runs, at = hashlib.sha256(), 0, 0, 0
            view = memoryview(data)
            if spans.is_valid:
                for lo, end in sorted((x["lo"], x["end"]) for x in spans.as_py()):
                    if end <= at:
                        continue
                    if lo > at or not runs:
                        runs += 1
                        kept.update(view[at:lo])
                        at = lo
                    removed += end - at
                    at = end
            kept.update(view[at:])
            for x, v in zip(out, (did, len(view), removed, runs, kept.hexdigest()), strict=True):
                x.append(v)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string())],
            names=["did", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def strip_repeats(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared) for every row."""
    base = keyed(docs)
    shared = saved(shared_samples(base))
    spans = repeated_spans(base, **options).distinct()
    by_doc = spans.groupBy("did", "rh").agg(F.collect_list(F.struct("lo", "end")).alias("spans"))
    both = join_on(base, by_doc, ["did", "rh"], "left").select("did", "text", "spans")
    out = both.mapInArrow(_strip, "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = join_on(out, shared, ["did"], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    return out.select(real_id("did").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")
