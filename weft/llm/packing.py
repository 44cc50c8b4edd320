"""Packing documents into training sequences of several context sizes (hierarchical multi-length packing).

1. Every document is tokenised once and written with its ids.  It is cut into as
   many whole long windows as it fills; what is left, shorter than a long window,
   is routed to the tier of the smallest context size that holds it.
2. There are fewer lengths of such rests than a long window has tokens, so the
   packing is planned from how many documents there are of each length, whatever
   their number: tier by tier, from the longest, a window takes a rest of its
   tier, the gap is filled with the longest rests of shorter tiers that fit, and
   at last by the head of a longer one, whose tail goes back to its tier.  One
   step of the plan lays out as many equal windows as the lengths last for.
3. Each document knows its place among those of its length (its place in the
   task that wrote it, after those of the tasks before) and reads its pieces off
   the plan.  Neither documents nor ids are shuffled.

Windows are full, so nothing is padded; the last tokens of all, fewer than a
window, make sequences of powers of two.  Windows of each context size are dealt
to the steps in turn: steps have equally many of each, one more or fewer.

Edge cases: null text is the empty text, which has only the end id (and no piece
where there is none); null ids and repeated rows are rows of their own; an empty
table gives no rows; a text of any length is cut like any other; other columns
of the table, whatever their names, aren't read.  Which of the documents of one
length takes which place depends on how the input is split into tasks.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._shared import saved
from weft.llm._ship import ship

CONTEXTS = (2048, 1024, 512, 256)
#: Tokens of a step, in long windows.
STEP_WINDOWS = 64
#: Rows of the places of tasks' lengths that may be broadcast (24 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000
MEMO = 300_000
LONG_WORD = 48
FLUSH = 4 << 20
IDS = np.dtype("<u4")


#: Words of Latin letters, then punctuation: every library cuts them alike.
SIMPLE = re.compile(r"[ \n]?[A-Za-zÀ-ÖØ-öø-ÿ]+[!-/:-@\[-`{-~]*")
#: How byte-level vocabularies cut a text before merging (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merges_by_rank(spec: bytes) -> Callable[[str], list[int]] | None:
    """The vocabulary's merges run by ``tiktoken``, three times as fast on single words, if its ids follow the merges' order
    and it is byte-level without exceptions; else None."""
    import tiktoken

    d = json.loads(spec)
    model, cut = d["model"], d["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or not plain or d["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
        return None
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow 255
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in visible)}
    special = {t["content"] for t in d["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    made = [model["vocab"][x] for x in pairs]
    if made != sorted(made) or len(pairs) + 256 != len(ranks):
        return None
    return tiktoken.Encoding("merges", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """A tokenizer of the ``tokenizers`` library, asked once for each word.

    Such a tokenizer cuts a text before each blank that follows a character that isn't one, so the ids of a text are
    those of its words, each with the blank before it.  Words that end in a character that may count as a blank are
    joined with the next.  Simple words go through ``merges_by_rank`` where the vocabulary allows it.
    """

    #: At most one blank and what follows up to the next.
    WORDS = re.compile(r"[ \n]?[^ \n]+|[ \n]")

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(spec)
        self.simple = merges_by_rank(spec)
        self.memo: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        if self.simple and SIMPLE.fullmatch(text):
            return array("I", self.simple(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids, each in four bytes, the least significant first."""
        out, held, known = [], "", self.memo.get
        for word in self.WORDS.findall(text):
            if not held:
                ids = known(word)
                if ids is not None:
                    out.append(ids)
                    continue
            held += word
            end = held[-1]
            if "!" <= end <= "~" or end.isalnum():
                ids = self._ids(held)
                out.append(ids)
                if len(held) == len(word) <= LONG_WORD:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    self.memo[word] = ids
                held = ""
        if held:
            out.append(self._ids(held))
        return b"".join(out)


_encoders: dict[int, Encoder] = {}


def _encoder(spec: bytes) -> Encoder:
    """One for each Python worker, which outlives a task."""
    key = hash(spec)
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


@dataclass
class Layout:
    """Where the rests of documents go.

    ``entries`` are (length of the rest, first place, place after the last, start in the rest, tokens, sequence of the
    first place, offset, context, index of the sequence among those of its context): places in a range follow each
    other in sequences that follow each other.
    """

    contexts: tuple[int, ...]
    entries: list[tuple[int, ...]] = field(default_factory=list)
    sequences: int = 0
    of_context: Counter = field(default_factory=Counter)
    bounds: dict[int, list[int]] = field(default_factory=dict)
    within: dict[int, list[list[tuple[int, ...]]]] = field(default_factory=dict)

    def add(self, segments: list[tuple[int, int, int, int]], take: int, offset: int, context: int) -> None:
        """Lays the first ``take`` tokens of the segments' rests into sequences from the next new one on."""
        at = 0
        for rest, low, high, start in segments:
            self.entries.append((rest, low, high, start, take, self.sequences + at, offset, context, self.of_context[context] + at))
            at += high - low

    def close(self, windows: int, context: int) -> None:
        self.sequences += windows
        self.of_context[context] += windows

    def index(self) -> None:
        """Cuts each length's places where an entry begins or ends."""
        by = defaultdict(list)
        for e in self.entries:
            by[e[0]].append(e)
        for rest, own in by.items():
            bounds = sorted({x for e in own for x in e[1:3]})
            lists: list[list] = [[] for _ in bounds]
            for e in sorted(own, key=lambda e: e[3]):
                for k in range(bisect_left(bounds, e[1]), bisect_left(bounds, e[2])):
                    lists[k].append(e)
            self.bounds[rest], self.within[rest] = bounds, lists

    def pieces(self, rest: int, place: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(start in the rest, tokens, sequence, offset, context, index in the context) of the document at a place."""
        k = bisect_right(self.bounds[rest], place) - 1
        for _, low, _, start, take, sequence, offset, context, index in self.within[rest][k]:
            yield start, take, sequence + place - low, offset, context, index + place - low


class _Supply:
    """Rests by length, as ranges of places of the documents that they come from."""

    def __init__(self, counts: dict[int, int]):
        self.ranges: dict[int, deque] = {}
        self.have: Counter = Counter()
        self.lengths: list[int] = []
        for length, n in sorted(counts.items()):
            self.put(length, [(length, 0, n, 0)])

    def put(self, length: int, ranges: list[tuple[int, int, int, int]]) -> None:
        if not self.have[length]:
            insort(self.lengths, length)
        self.ranges.setdefault(length, deque()).extend(ranges)
        self.have[length] += sum(high - low for _, low, high, _ in ranges)

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        got, queue = [], self.ranges[length]
        self.have[length] -= n
        if not self.have[length]:
            self.lengths.remove(length)
        while n:
            rest, low, high, start = queue.popleft()
            if high - low > n:
                queue.appendleft((rest, low + n, high, start))
                high = low + n
            got.append((rest, low, high, start))
            n -= high - low
        return got

    def longest(self, low: int, high: int, used: Counter) -> int:
        """The greatest length above ``low`` and up to ``high`` of which more than the used ones are left; 0 if none is."""
        for k in range(bisect_right(self.lengths, high) - 1, -1, -1):
            length = self.lengths[k]
            if length <= low:
                return 0
            if self.have[length] > used[length]:
                return length
        return 0


def lay_out(counts: dict[int, int], contexts: tuple[int, ...] = CONTEXTS, taken: int = 0) -> Layout:
    """The plan for so many rests of each length (from 1 to the longest context), after ``taken`` long windows."""
    if any(c & (c - 1) or c < 1 for c in contexts) or sorted(contexts, reverse=True) != list(contexts):
        raise ValueError(f"contexts must be falling powers of two, not {contexts}")
    out, supply = Layout(contexts), _Supply({k: n for k, n in counts.items() if n and k})
    out.close(taken, contexts[0])
    for context, shorter in zip(contexts, (*contexts[1:], 0), strict=True):
        limit = shorter or context  # what may fill gaps first; in the last tier anything
        while first := supply.longest(shorter, context, Counter()):
            used, slots, gap = Counter([first]), [(first, first)], context - first
            while gap and (length := supply.longest(0, min(gap, limit), used)):
                used[length] += 1
                slots.append((length, length))
                gap -= length
            if gap and (length := supply.longest(gap, limit, used) or supply.longest(gap, context, used)):
                used[length] += 1
                slots.append((length, gap))
                gap = 0
            if gap:  # nothing else is left
                _powers(out, supply, [length for length, _ in slots], context - gap)
                continue
            windows = min(supply.have[length] // n for length, n in used.items())
            tails, offset = [], 0
            for length, tokens in slots:
                segments = supply.take(length, windows)
                out.add(segments, tokens, offset, context)
                offset += tokens
                if tokens < length:
                    tails.append((length - tokens, [(rest, low, high, start + tokens) for rest, low, high, start in segments]))
            out.close(windows, context)
            for length, ranges in tails:
                supply.put(length, ranges)
    out.index()
    return out


def _powers(out: Layout, supply: _Supply, lengths: list[int], tokens: int) -> None:
    """The last rests of all as sequences whose lengths are the powers of two that ``tokens`` is a sum of."""
    queue = deque((length, supply.take(length, 1)) for length in lengths)
    for power in (1 << k for k in range(tokens.bit_length() - 1, -1, -1) if tokens >> k & 1):
        offset = 0
        while offset < power:
            length, segments = queue.popleft()
            take = min(length, power - offset)
            out.add(segments, take, offset, power)
            offset += take
            if take < length:
                queue.appendleft((length - take, [(rest, low, high, start + take) for rest, low, high, start in segments]))
        out.close(1, power)


def load(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


_TOKENS = "part int, doc_id long, n long, rest int, place long, windows long, ids binary"


def _tokens(spec, long: int, end: int | None):
    """Rows of a task, each with its place among the task's rows of the same rest, and the long windows of those before it."""
    last = b"" if end is None else np.array([end], IDS).tobytes()

    def batch(part: int, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        arrays = [pa.array([part] * len(rows), pa.int32())] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _TOKENS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), _encoder(spec.value).encode
        seen, windows = Counter(), Counter()
        for b in batches:
            rows, size = [], 0
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                ids = encode(text.as_py() or "") + last
                n = len(ids) // IDS.itemsize
                rest = n % long
                rows.append((doc_id.as_py(), n, rest, seen[rest], windows[rest], ids))
                seen[rest] += 1
                windows[rest] += n // long
                size += len(ids)
                if size > FLUSH:
                    yield batch(part, rows)
                    rows, size = [], 0
            if rows:
                yield batch(part, rows)

    return run


def tokenised(docs: DataFrame, spec: bytes, end: int | None = None, long: int = CONTEXTS[0]) -> DataFrame:
    """(part, doc_id, n, rest, place, windows, ids): ids in four bytes each, then the end id; not written yet."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_tokens(docs.sparkSession.sparkContext.broadcast(spec), long, end), _TOKENS)


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, context int, step long"


def _pieces(layout: Layout, bases: dict[int, int], shifts: dict[int, int], steps: int):
    long = layout.contexts[0]
    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in PIECES.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            cols = [b.column(c).to_pylist() for c in ("doc_id", "n", "rest", "place", "windows")]
            for doc_id, n, rest, place, windows, ids in zip(*cols, b.column("ids"), strict=True):
                data = memoryview(ids.as_buffer())
                size += len(data)
                whole = n // long * long
                found = [(k * long, long, at := bases[rest] + windows + k, 0, long, at) for k in range(n // long)]
                if rest:
                    found += [(whole + start, *more) for start, *more in layout.pieces(rest, place)]
                for start, tokens, sequence, offset, context, index in found:
                    own = data[start * IDS.itemsize : (start + tokens) * IDS.itemsize]
                    rows.append((doc_id, start, tokens, bytes(own), n, sequence, offset, context, (index + shifts[context]) % steps))
                if size > FLUSH:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    return run


def pack(
    docs: DataFrame, spec: bytes, end: int | None = None, contexts: tuple[int, ...] = CONTEXTS, step_windows: int = STEP_WINDOWS
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset, context, step): every piece of every document.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's; ``ids`` holds four bytes for each;
    ``context`` is the sequence's length.
    """
    tokens = saved(tokenised(docs, spec, end, contexts[0]))
    sizes = tokens.groupBy("part", "rest").agg(F.count("*").alias("docs"), F.sum(F.floor(F.col("n") / contexts[0])).alias("full"))
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = saved(sizes)  # a row for each task and length
    total = {r["rest"]: r for r in sizes.groupBy("rest").agg(F.sum("docs").alias("docs"), F.sum("full").alias("full")).collect()}
    bases, taken = {}, 0
    for rest in sorted(total):
        bases[rest] = taken
        taken += total[rest]["full"]
    layout = lay_out({rest: r["docs"] for rest, r in total.items()}, contexts, taken)
    steps = max(1, sum(c * n for c, n in layout.of_context.items()) // (step_windows * contexts[0]))
    shifts, shift = {}, 0
    for context, n in sorted(layout.of_context.items(), reverse=True):
        shifts[context] = shift  # the contexts' odd windows go to different steps
        shift += n
    starts = sizes.select("part", "rest", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("docs", "full")])
    if sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    d = tokens.join(starts, ["part", "rest"]).select(
        "doc_id", "n", "rest", (F.col("place") + F.col("_docs")).alias("place"), (F.col("windows") + F.col("_full")).alias("windows"), "ids"
    )
    return d.mapInArrow(_pieces(layout, bases, shifts, steps), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, context, step, tokens, n_pieces): the sequences that pieces make."""
    return pieces.groupBy("sequence_id", "context", "step").agg(F.sum("length").alias("tokens"), F.count("*").alias("n_pieces"))


def digests(pieces: DataFrame) -> DataFrame:
    """``pack``'s rows with a checksum in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step"
    )
