"""Fill-in-middle: documents cut into prefix, middle and suffix, and put in the order that a model learns to fill from.

A text is scanned once, in blocks, to count its units (lines, or code points).
On the way every ``STEP`` units a checkpoint is kept: how many units, bytes and
code points lie before it.  A cut after a number of units is then found by
binary search among the checkpoints and a short scan from the one before it, so
neither the units nor their places are ever held: for n units there are
n / STEP checkpoints of three integers.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle,
``plain`` the text itself: an empty text, one that contains a sentinel (so that
the parts could not be told apart), or one not drawn.  ``restored`` rebuilds the
text from output and form alone.

Draws are SHA-256 of the seed and the row's id, so reruns, retries and other
partitions agree.

Edge cases: null text is the empty text; a null id is drawn as the empty string;
repeated rows give repeated results; an empty table gives no rows; other columns
of the table, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._ship import ship

SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("line", "char")
STEP = 64
BLOCK = 1 << 18
#: Output bytes after which a batch is handed on.
FLUSH = 4 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Checkpoints:
    """A sparse index of a UTF-8 text: units, bytes and code points before every ``step``-th unit."""

    def __init__(self, data: bytes, unit: str = "line", step: int = STEP, block: int = BLOCK):
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {UNITS}, not {unit!r}")
        self.data, self.unit, self.block = data, unit, block
        self.units, self.bytes, self.chars = array("q", [0]), array("q", [0]), array("q", [0])
        ended = self.n_chars = 0
        for at in range(0, len(data), block):
            lead, ends = self._scan(at, len(data), first=at == 0)
            done = chars = 0
            for k in range(step - ended % step - 1, len(ends), step):
                mark = int(ends[k])
                chars += int(np.count_nonzero(lead[done:mark]))
                done = mark
                self.units.append(ended + k + 1)
                self.bytes.append(at + mark)
                self.chars.append(self.n_chars + chars)
            ended += len(ends)
            self.n_chars += chars + int(np.count_nonzero(lead[done:]))
        open_end = bool(data) and (unit == "char" or not data.endswith(b"\n"))  # nothing begins after the last unit
        self.n = ended + open_end

    def _scan(self, at: int, to: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of the block from byte ``at``, up to ``to`` at most: which bytes begin a code point, and the places where a unit has ended.

        A code point has ended where another begins; ``first``: none ends where the block begins.
        """
        part = np.frombuffer(self.data, np.uint8, min(self.block, to - at), at)
        lead = (part & 0xC0) != 0x80
        ends = np.flatnonzero(part == 10) + 1 if self.unit == "line" else np.flatnonzero(lead)[1 if first else 0 :]
        return lead, ends

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points before the end of the first ``units`` units."""
        if units >= self.n:
            return len(self.data), self.n_chars
        k = bisect_right(self.units, units) - 1
        left, at, chars, first = units - self.units[k], self.bytes[k], self.chars[k], True
        end = self.bytes[k + 1] if k + 1 < len(self.bytes) else len(self.data)
        while left > 0:
            lead, ends = self._scan(at, end, first)
            to = int(ends[left - 1]) if len(ends) >= left else len(lead)
            left -= min(left, len(ends))
            chars += int(np.count_nonzero(lead[:to]))
            at, first = at + to, False
        return at, chars


@dataclass(frozen=True)
class Plan:
    """How documents are transformed: shares in percent."""

    seed: int = 7
    unit: str = "line"
    percent: int = 100
    spm_percent: int = 50
    step: int = STEP
    block: int = BLOCK

    def draws(self, doc_id: int | None) -> list[int]:
        h = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]

    def apply(self, doc_id: int | None, data: bytes) -> tuple[int, str, int | None, int | None, bytes]:
        """(n, form, prefix_chars, middle_chars, output) of a text in UTF-8."""
        index = Checkpoints(data, self.unit, self.step, self.block)
        h1, h2, h3, h4 = self.draws(doc_id)
        p, s, m = (x.encode() for x in SENTINELS)
        if not data or p in data or s in data or m in data or h3 % 100 >= self.percent:
            return index.n, "plain", None, None, data
        (a, a_chars), (b, b_chars) = (index.cut(u) for u in sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
        text = memoryview(data)
        head, middle, tail = text[:a], text[a:b], text[b:]
        spm = h4 % 100 < self.spm_percent
        parts = (s, tail, p, head, m, middle) if spm else (p, head, s, tail, m, middle)
        return index.n, "spm" if spm else "psm", a_chars, b_chars - a_chars, b"".join(parts)


def _mapper(plan: Plan):
    fields = [f.split() for f in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(cols[:-1], fields[:-1], strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(cols[-1], pa.binary()).cast(pa.string())], names=[f for f, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                row = (doc_id.as_py(), *plan.apply(doc_id.as_py(), bytes(text.as_buffer()) if text.is_valid else b""))
                rows.append(row)
                size += len(row[-1])
                if size > FLUSH:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    return run


def fill_in_middle(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row; the counts of code points are null if plain."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_mapper(plan or Plan()), SCHEMA)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that an output of a form was made from."""
    out, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    p, s, m = SENTINELS
    first, second = F.when(form == "psm", F.lit(p)).otherwise(F.lit(s)), F.when(form == "psm", F.lit(s)).otherwise(F.lit(p))
    # No part holds a sentinel, so each stands once; splitting at both leaves "", part, part.
    begun = F.substring(out, F.length(first) + 1, F.length(out))
    body, middle = F.substring_index(begun, m, 1), F.substring_index(begun, m, -1)
    one, two = F.split_part(body, second, F.lit(1)), F.split_part(body, second, F.lit(2))
    head, tail = F.when(form == "psm", one).otherwise(two), F.when(form == "psm", two).otherwise(one)
    return F.when(form == "plain", out).otherwise(F.concat(head, middle, tail))


def digests(filled: DataFrame) -> DataFrame:
    """``fill_in_middle``'s rows with hashes of the output and of the text that is rebuilt from it in their place."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return filled.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"),
    )
