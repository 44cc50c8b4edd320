"""Toxicity by a weighted finite-state pattern grammar.

A text is a sequence of clauses (ended by punctuation or a line end) of words,
and each word has a class: insult, threat, target, negation, reported speech or
other.  Five small transducers read the classes of a clause:

* insult: an insult is aimed if a word for a person stands within six words
  before it, else bare;
* threat: a threatening verb waits for a target among the next three words; it is
  aimed once the target comes, bare if the wait or the clause ends without one;
* target: remembers the last word for a person;
* negation: remembers a negation for three words;
* reported speech: remembers a verb of saying for eight words.

They are composed into one machine (``compose``) whose arcs emit matches: bare or
aimed, insult or threat, negated or not, reported or not, ``ARCS`` kinds in all.
A clause's match carries the weight of its word.  A text's features are, for each
kind of arc, the logarithm of the matched weight, and the share of its clauses
with a ``FIRM`` match (neither negated, reported nor a bare threat); a logistic regression over them gives the score from 0 to 1: what is
learned is a weight for each composed arc, never one for a bare word.  The regression is drawn towards the grammar's
own weights (``PRIOR``), which stand where the labels say nothing of an arc.

The vocabularies start from short lists of four languages.  From at most about
``TRAIN_ROWS`` labelled rows (a documented bound, chosen by hash) words and word
stems of 4 to 6 letters are added as insults.  They are learned from the arcs on
which they stand: the machine reads each text, and a term counts where an insult
in its place would be matched plain (bare or aimed), never where it is negated or
reported.  A term is taken if the association of its plain places, or of its bare
or its aimed ones alone, with the label is beyond chance for the number of
associations tried (likelihood ratio).  It has a weight for bare and one for aimed
places: the log odds of that place's own counts, drawn towards those of all plain
places by ``PULL`` documents, or 0, with which it matches nothing there.  A stem
must hold without the commonest word that has it, so one word never stands for all
that begin alike.  All terms that pass are taken; their number is bounded by the
sample.  Threats, targets, negations and reports are the lists' alone.

Beside its score a text has the kind of arc that adds most to it (``arc``).

Edge cases: null and empty texts have no match and get the score of a text
without any; without labelled rows of both kinds the score comes from fixed
weights; labels that repeat an id count once, as toxic if any row says so;
repeated documents score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._sample import bounded
from weft.llm._ship import ship

TRAIN_ROWS, STEMS, SURE, PULL = 20_000, (4, 5, 6), 6.0, 10
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

INSULTS = """idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown fool
imbecile vermin filth creep jerk pig idiota imbécil estúpido estúpida basura asqueroso escoria payaso inútil imbécile
stupide crétin connard ordure minable dégoûtant débile blöd blödmann dummkopf trottel abschaum widerlich wertlos
idioten vollidiot""".split()
THREATS = """kill hurt destroy beat punch burn hang shoot stab crush matar matarte destruir golpear quemar tuer
détruire frapper brûler töten umbringen verprügeln vernichten""".split()
TARGETS = """you your yours youre u he she they them this that these those him her people everyone tú tu usted ustedes
vosotros él ella ellos vous toi ton ta votre il elle ils du dich dir ihr euch sie er dein""".split()
NEGATIONS = "not no never nobody neither nor isn aren wasn don doesn didn won nunca jamás pas jamais aucun nicht kein keine nie".split()
REPORTS = """said says say told tells called calls wrote writes claimed claims quoted quote according dijo dice llamó
escribió según dit disait appelé écrit selon sagte sagt nannte schrieb laut""".split()

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;,\n|]")
_END = frozenset(".!?;,\n|")

#: Kinds of arcs: 4 matches, each plain, negated, reported, or both.
BARE, AIMED, THREAT_BARE, THREAT_AIMED = range(4)
ARCS = 16


def arc(match: int, negated: int, reported: int) -> int:
    return match * 4 + negated * 2 + reported


class Transducer(NamedTuple):
    """For (state, class) the next state and an output; ``last`` is a state's output where the clause ends; state 0 is the start."""

    next: np.ndarray
    out: np.ndarray
    last: np.ndarray


NONE = -1


def memory(trigger: int, span: int) -> Transducer:
    """Outputs 1 for up to ``span`` words after a trigger word, else 0."""
    nxt = np.maximum(np.arange(span + 1)[:, None] - 1, 0).repeat(6, axis=1)
    nxt[:, trigger] = span
    on = (np.arange(span + 1) > 0).astype(int)
    return Transducer(nxt, on[:, None].repeat(6, axis=1), on)


def insult() -> Transducer:
    """Outputs BARE at each insult; whether it is aimed is the target's to say."""
    out = np.full((1, 6), NONE)
    out[0, INSULT] = BARE
    return Transducer(np.zeros((1, 6), int), out, np.full(1, NONE))


def threat(span: int) -> Transducer:
    """Waits ``span`` words for a target: THREAT_AIMED there, THREAT_BARE where the wait, the clause or another threat ends it."""
    n = span + 1
    nxt = np.maximum(np.arange(n)[:, None] - 1, 0).repeat(6, axis=1)
    nxt[:, THREAT], nxt[:, TARGET] = span, 0
    out = np.full((n, 6), NONE)
    out[1, :] = THREAT_BARE
    out[1:, THREAT] = THREAT_BARE
    out[1:, TARGET] = THREAT_AIMED
    last = np.full(n, NONE)
    last[1:] = THREAT_BARE
    return Transducer(nxt, out, last)


class Machine(NamedTuple):
    next: list[list[int]]
    insult: list[list[int]]  # arc that an insult emits, or NONE
    threat: list[list[int]]  # arc that a threat emits, or NONE
    last: list[int]


def compose(insults: Transducer, threats: Transducer, target: Transducer, negation: Transducer, report: Transducer) -> Machine:
    """The machine of all five at once: its states are tuples, its arcs carry their outputs together."""
    parts = (insults, threats, target, negation, report)
    seen, order = {(0,) * 5: 0}, [(0,) * 5]
    m = Machine([], [], [], [])
    for state in order:
        row, hit, menace = [], [], []
        for c in range(6):
            to = tuple(int(p.next[s, c]) for p, s in zip(parts, state, strict=True))
            if to not in seen:
                seen[to] = len(order)
                order.append(to)
            row.append(seen[to])
            i, t, aim, neg, rep = (int(p.out[s, c]) for p, s in zip(parts, state, strict=True))
            hit.append(NONE if i == NONE else arc(AIMED if aim else BARE, neg, rep))
            menace.append(NONE if t == NONE else arc(t, neg, rep))
        m.next.append(row)
        m.insult.append(hit)
        m.threat.append(menace)
        t, neg, rep = (int(p.last[s]) for p, s in zip((threats, negation, report), (state[1], state[3], state[4]), strict=True))
        m.last.append(NONE if t == NONE else arc(t, neg, rep))
    return m


GRAMMAR = compose(insult(), threat(3), memory(TARGET, 6), memory(NEGATION, 3), memory(REPORT, 8))
#: The grammar's weights of arcs, before anything is learned: by match, negated and reported.
PRIOR = [3.0 * match * neg * rep for match in (0.6, 1.0, 0.1, 1.0) for neg in (1.0, 0.1) for rep in (1.0, 0.2)]
BIAS = -3.0
SHARE = 1.0
FIRM = frozenset(arc(m, 0, 0) for m in (BARE, AIMED, THREAT_AIMED))
ARC_NAMES = [
    m + n + r
    for m in ("bare insult", "aimed insult", "bare threat", "aimed threat") for n in ("", ", negated") for r in ("", ", reported")
]
FEATURES = ARCS + 1
NAMES = [f"x{i}" for i in range(FEATURES)]


#: Weights of a word at bare and at aimed places.
Weights = tuple[float, float]


class Lexicon:
    """Class and weights of a word: the word itself, else its longest known stem."""

    def __init__(self, learned: dict[str, Weights]):
        self.words: dict[str, tuple[int, Weights]] = {w: (INSULT, (2.0, 2.0)) for w in INSULTS}
        for kind, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            self.words |= {w: (kind, (2.0, 2.0)) for w in words}
        self.stems: dict[str, tuple[int, Weights]] = {}
        for term, weights in learned.items():
            if term.endswith("*"):
                self.stems[term[:-1]] = (INSULT, weights)
            elif self.words.get(term, (INSULT,))[0] == INSULT:
                self.words[term] = (INSULT, weights)
        self.memo: dict[str, tuple[int, Weights]] = {}

    def of(self, word: str) -> tuple[int, Weights]:
        got = self.memo.get(word)
        if got is None:
            got = self.words.get(word)
            if got is None:
                got = (OTHER, (0.0, 0.0))
                for k in reversed(STEMS):
                    if len(word) >= k and word[:k] in self.stems:
                        got = self.stems[word[:k]]
                        break
            if len(self.memo) >= 200_000:
                self.memo.clear()
            if len(word) <= 64:
                self.memo[word] = got
        return got

    def clauses(self, text: str | None, machine: Machine = GRAMMAR) -> list[list[tuple[int, float]]]:
        """The matches (arc, weight) of each clause that has words; [] for a text without an insult or threat."""
        tokens = _TOKEN.findall((text or "").lower())
        of, found, all_ = self.of, [], []
        kinds = [None if t in _END else of(t) for t in tokens]
        if not any(k is not None and k[0] in (INSULT, THREAT) for k in kinds):
            return all_
        nxt, hit, menace, last = machine
        state, held, words = 0, 0.0, 0
        for k in [*kinds, None]:
            if k is None:
                if last[state] != NONE:
                    found.append((last[state], held))
                if words:
                    all_.append(found)
                state, words, found = 0, 0, []
                continue
            words += 1
            c, w = k
            if menace[state][c] != NONE:
                found.append((menace[state][c], held))
            a = hit[state][c]
            if a != NONE and w[a // 4] > 0:
                found.append((a, w[a // 4]))
            if c == THREAT:
                held = w[AIMED]
            state = nxt[state][c]
        return all_

    def features(self, text: str | None, machine: Machine = GRAMMAR) -> list[float]:
        sums = [0.0] * ARCS
        clauses = self.clauses(text, machine)
        for a, w in (m for c in clauses for m in c):
            sums[a] += w
        return [*(math.log1p(x) for x in sums), sum(any(a in FIRM for a, _ in c) for c in clauses) / max(len(clauses), 1)]


#: For each state of the machine, where an insult read there would stand: 1 bare, 2 aimed, 4 negated or reported.
PLACES = [1 if row[INSULT] == arc(BARE, 0, 0) else 2 if row[INSULT] == arc(AIMED, 0, 0) else 4 for row in GRAMMAR.insult]
COUNTS = ("clean", "toxic", "bare_clean", "bare_toxic", "aimed_clean", "aimed_toxic")


def term_places(lex: Lexicon, text: str | None) -> dict[str, int]:
    """Words and stems* of a text with their places (bits of ``PLACES``)."""
    words: dict[str, int] = {}
    of, nxt, state = lex.of, GRAMMAR.next, 0
    for t in _TOKEN.findall((text or "").lower()):
        if t in _END:
            state = 0
            continue
        words[t] = words.get(t, 0) | PLACES[state]
        state = nxt[state][of(t)[0]]
    found = dict(words)
    for w, bits in words.items():
        for k in STEMS:
            if len(w) >= k:
                stem = f"{w[:k]}*"
                found[stem] = found.get(stem, 0) | bits
    return found


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each term in how many clean and toxic texts it stands plain, bare and aimed."""
    lex, counts = Lexicon({}), [Counter() for _ in COUNTS]

    def flush() -> pa.RecordBatch:
        terms = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], names=["term", *COUNTS]
        )
        for c in counts:
            c.clear()
        return out

    for b in batches:
        for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text"), strict=True):
            places = term_places(lex, text.as_py())
            for first, bits in ((0, 3), (2, 1), (4, 2)):
                counts[first + toxic].update(t for t, at in places.items() if at & bits)
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield flush()
    yield flush()


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (bias first) of a logistic regression drawn towards the grammar's own, by Newton's method with halved steps."""
    a = np.column_stack([np.ones(len(x)), x])
    prior = np.array([BIAS, *PRIOR, SHARE])
    penalty = np.array([1e-6, *[ridge] * x.shape[1]])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * (w - prior) ** 2))

    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * (w - prior))
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model(NamedTuple):
    learned: dict[str, Weights]
    weights: list[float]


#: Used where there is nothing to learn from.
FIXED = Model({}, [BIAS, *PRIOR, SHARE])


def _learned_terms(rows: DataFrame, n: int, toxic: int) -> dict[str, Weights]:
    """Words and stems* that go with the label where they stand plain, with their weights at bare and at aimed places."""
    counts = rows.mapInArrow(_term_counts, ", ".join(["term string", *(f"{c} long" for c in COUNTS)]))
    counts = counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS]).cache()
    words = counts.where("NOT endswith(term, '*') AND toxic > 0")
    stems = F.array(*[F.when(F.length("term") >= k, F.concat(F.substring("term", 1, k), F.lit("*"))) for k in STEMS])
    hot = [c for c in COUNTS if c.endswith("toxic")]
    top = words.select(F.explode(F.array_compact(stems)).alias("term"), *hot)
    top = top.groupBy("term").agg(*[F.max(c).alias(f"top_{c}") for c in hot])
    terms = counts.join(top, "term", "left")
    t, z = max(toxic, 1), max(n - toxic, 1)

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    floor = 2 * math.log(max(3 * counts.count(), 2)) + SURE
    stats = []
    for place in ("", "bare_", "aimed_"):
        k = (F.col(f"{place}toxic") - F.coalesce(f"top_{place}toxic", F.lit(0))).cast("double")
        c = F.col(f"{place}clean").cast("double")
        share = (k + c) / (t + z)
        odds = F.log((k + 0.5) / (t - k + 0.5)) - F.log((c + 0.5) / (z - c + 0.5))
        sure = (2 * (part(k, share * t) + part(c, share * z)) >= floor) & (odds > 3)
        stats += [(k + c).alias(f"{place}n"), odds.alias(f"{place}odds"), sure.alias(f"{place}sure")]
    known = terms.select("term", *stats).where("sure OR bare_sure OR aimed_sure").orderBy("term").collect()  # bounded by the sample
    counts.unpersist()

    def weight(r, place: str) -> float:
        if not r["sure"]:
            return r[f"{place}odds"] if r[f"{place}sure"] else 0.0
        return max((r[f"{place}n"] * r[f"{place}odds"] + PULL * r["odds"]) / (r[f"{place}n"] + PULL), 0.0)

    return {r["term"]: (weight(r, "bare_"), weight(r, "aimed_")) for r in known}


def learn(rows: DataFrame, bound: int = TRAIN_ROWS) -> Model:
    """A model from labelled rows (doc_id, text, toxic 0/1)."""
    n = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not n["t"] or n["t"] == n["n"]:
        return FIXED
    rows = bounded(rows, n["n"], bound, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies count once
    size = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    learned = _learned_terms(rows, size["n"], size["t"] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(learned)
        for b in batches:
            got = np.array([lex.features(x.as_py()) for x in b.column("text")]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*(pa.array(got[:, i]) for i in range(FEATURES)), b.column("toxic")], names=[*NAMES, "toxic"])

    kind = ", ".join(f"{x} double" for x in NAMES)
    fit = rows.mapInArrow(run, f"{kind}, toxic int").toPandas()  # bounded rows of a few numbers
    fit = fit.sort_values(list(fit.columns))
    return Model(learned, _fit(fit[NAMES].to_numpy(), fit["toxic"].to_numpy()).tolist())


def judged(model: Model, lex: Lexicon, texts) -> tuple[np.ndarray, list[str | None]]:
    """Scores of texts, and the kind of arc that adds most to each, if any adds."""
    x = np.array([lex.features(t) for t in texts]).reshape(-1, FEATURES)
    w = np.array(model.weights)
    added = x[:, :ARCS] * w[1 : ARCS + 1]
    most = [ARC_NAMES[a.argmax()] if a.max() > 0 else None for a in added]
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))), most


def probabilities(model: Model, lex: Lexicon, texts) -> np.ndarray:
    return judged(model, lex, texts)[0]


def scorer(model: Model):
    """A column function from text to (score, arc)."""

    @F.pandas_udf("score double, arc string")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(model.learned)
        for texts in parts:
            p, most = judged(model, lex, texts)
            yield pd.DataFrame({"score": p, "arc": pd.Series(most, dtype="object")})

    return score


def learn_from(docs: DataFrame, labels: DataFrame, held_out: Column, bound: int = TRAIN_ROWS) -> Model:
    """Labels are bounded before they meet the texts, so at most about ``bound`` rows are broadcast."""
    ship(docs.sparkSession)
    y = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out)
    y = y.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    y = bounded(y, y.count(), bound, "doc_id")
    return learn(docs.select("doc_id", "text").join(F.broadcast(y), "doc_id"), bound)


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted, arc) for every row."""
    model = learn_from(docs, labels, held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), scorer(model)(F.col("text").cast("string")).alias("s"))
    return rows.select("doc_id", "held_out", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.arc")
