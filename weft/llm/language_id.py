"""Language identification by rank-order profiles.

A profile is the list of the ``PROFILE`` most frequent letter n-grams (1 to 3
letters of words padded with a blank on both sides).  A text's language is the
one whose profile is nearest by out-of-place distance: the sum, over the text's
own most frequent n-grams, of how far apart their ranks are, with ``PROFILE``
for an n-gram that the profile lacks.  The score is 1 less the distance as a
share of the largest possible one.

Profiles are learned from at most about ``TRAIN_ROWS`` labelled rows, a
documented bound (rows are chosen by hash); n-grams are counted in the executors
and ranked per language, so the driver receives the profiles only.  Equal counts
rank by the n-gram's hash, equal distances by the language's name.

Edge cases: a null text, one without a letter, or no labelled row at all gives
``und`` with score 0; repeated rows are predicted alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._sample import bounded
from weft.llm._ship import ship

PROFILE, GRAMS, TRAIN_ROWS = 300, 3, 20_000
MEMO, LONG_WORD = 200_000, 64
_WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


class Grams:
    """Counts n-grams; those of a bounded number of words are remembered, numbered for as long as they are."""

    def __init__(self, n: int = GRAMS):
        self.n = n
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, np.ndarray] = {}
        self.number: dict[str, int] = {}
        self.hashes = np.zeros(4096, np.uint64)

    def of(self, word: str) -> np.ndarray:
        """Numbers of the word's n-grams."""
        got = self.known.get(word)
        if got is None:
            s, number, at = f" {word} ", self.number, []
            for k in range(1, self.n + 1):
                for i in range(len(s) - k + 1):
                    gram = s[i : i + k]
                    x = number.get(gram)
                    if x is None:
                        x = number[gram] = len(number)
                        if x >= len(self.hashes):
                            self.hashes = np.append(self.hashes, np.zeros_like(self.hashes))
                        self.hashes[x] = xxhash.xxh64_intdigest(gram)
                    at.append(x)
            got = np.array(at, np.int32)
            if len(word) <= LONG_WORD:
                self.known[word] = got
        return got

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Hashes of the n-grams of all words of the text and their counts, or None without a letter."""
        words = Counter(_WORD.findall(text.lower()))
        if not words:
            return None
        if len(self.known) >= MEMO or len(self.number) >= MEMO:
            self._clear()
        lists = [self.of(w) for w in words]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        times = np.repeat(np.fromiter(words.values(), np.float64, len(lists)), n)
        count = np.bincount(np.concatenate(lists), times)
        some = np.flatnonzero(count)
        return self.hashes[some], count[some].astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; equal counts by hash."""
    if len(counts) > size:
        often = counts >= np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[often], counts[often]
    return grams[np.lexsort((grams, -counts))[:size]]


def _train_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    g, total = Grams(), {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, h, n) for lang, c in total.items() for h, n in c.items()]
        total.clear()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64)),
                pa.array([r[2] for r in rows], pa.int64()),
            ],
            names=["lang", "gram", "n"],
        )

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            got = g.counts(text.as_py())
            if got is None:
                continue
            mine = total.setdefault(lang, {})
            for h, n in zip(got[0].tolist(), got[1].tolist(), strict=True):
                mine[h] = mine.get(h, 0) + n
        if sum(map(len, total.values())) > 200_000:
            yield flush()
    if total:
        yield flush()


def learn_profiles(rows: DataFrame, size: int = PROFILE, bound: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Profiles of the languages in labelled rows (doc_id, text, lang)."""
    ship(rows.sparkSession)
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    rows = bounded(rows, rows.count(), bound, "doc_id", "lang")
    counts = rows.select("lang", "text").mapInArrow(_train_counts, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size)
    found: dict[str, list] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["r"])):  # size rows a language
        found.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(g, np.int64).view(np.uint64) for lang, g in found.items()}


def predictor(profiles: dict[str, np.ndarray], size: int = PROFILE):
    """A function from texts to (language, score)."""
    langs = sorted(profiles)
    tables = []
    for lang in langs:
        order = np.argsort(profiles[lang])
        tables.append((profiles[lang][order], order))
    g = Grams()

    def predict(text: str | None) -> tuple[str, float]:
        got = g.counts(text) if text else None
        if got is None or not langs:
            return UNDETERMINED, 0.0
        own = ranked(*got, size)
        rank = np.arange(len(own))
        best = (len(own) * size + 1, "")
        for lang, (grams, ranks) in zip(langs, tables, strict=True):
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            far = np.where(grams[at] == own, np.minimum(np.abs(ranks[at] - rank), size), size)
            best = min(best, (int(far.sum()), lang))
        return best[1], 1.0 - best[0] / (len(own) * size)

    return predict


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; only the text decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(profiles, size)
        for b in batches:
            got = [predict(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def learn_and_identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from rows that aren't held out."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where(~held_out)
    return identify(docs, learn_profiles(rows)).withColumn("held_out", held_out)
