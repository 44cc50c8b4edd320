"""Language identification, toxicity and the SentencePiece codec."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import language_id, sentencepiece_codec, toxicity
from weft.llm._sample import bounded, held_out

SYLLABLES = {"aa": "ka lo mi ta ra".split(), "bb": "sch ung ein der ich".split(), "cc": "eau que oui les ment".split()}


def words(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language(frame):
    rng = random.Random(1)
    rows = [[k, words(lang, rng, 40), lang, "s"] for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    odd = [[900, None, "aa", "s"], [901, "", "aa", "s"], [902, "123 !? 45", "bb", "s"], [903, words("aa", rng, 20_000), None, "s"]]
    out = language_id.learn_and_identify(frame(rows + odd), held_out("doc_id", 3, 1)).collect()
    got = {r.doc_id: r for r in out}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in out)
    bare = frame([[1, "abc", None, "s"]])
    assert [(r.lang_pred, r.score) for r in language_id.learn_and_identify(bare, held_out("doc_id", 3, 1)).collect()] == [("und", 0.0)]


def test_out_of_place_distance():
    g = language_id.Grams()
    profile = {lang: language_id.ranked(*g.counts(t), 50) for lang, t in (("x", "aaa bb c"), ("y", "ddd ee f"))}
    predict = language_id.predictor(profile, 50)
    assert predict("aaa bb c") == ("x", 1.0)
    assert predict("f ee ddd") == ("y", 1.0)
    assert predict("aaa bb d")[0] == "x" and predict("aaa bb d")[1] < 1


def test_language_by_brute_force(frame):
    """The whole result from plain counts, ranks and distances."""
    import zlib
    from collections import Counter, defaultdict

    import xxhash

    rng = random.Random(8)
    rows = [[k, words(lang, rng, rng.randint(1, 60)), [lang, None][k % 9 == 0], "s"] for k, lang in enumerate(["aa", "bb", "cc"] * 50)]
    rows += [[900, None, "aa", "s"], [901, "12 34", "bb", "s"], [902, "Ka KA ka", "cc", "s"], [3, words("bb", rng, 9), "bb", "s"]]
    size, name = language_id.PROFILE, lambda g: xxhash.xxh64_intdigest(g)
    grams = lambda t: Counter(
        f" {w} "[i : i + n] for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for n in (1, 2, 3) for i in range(len(w) + 3 - n)
    )
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    counts = defaultdict(Counter)
    for i, t, lang, _ in rows:
        if lang and t is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            counts[lang].update(grams(t))
    profile = {x: {g: r for r, g in enumerate(sorted(c, key=lambda g: (-c[g], signed(name(g))))[:size])} for x, c in counts.items()}
    want = Counter()
    for i, t, *_ in rows:
        c, held = grams(t), zlib.crc32(str(i).encode()) % 3 == 1
        own = sorted(c, key=lambda g: (-c[g], name(g)))[:size]
        far = {x: sum(min(abs(p.get(g, 10**9) - r), size) for r, g in enumerate(own)) for x, p in profile.items()}
        best = min(far, key=lambda x: (far[x], x))
        want[(i, held, best, round(1 - far[best] / (len(own) * size), 9)) if own else (i, held, "und", 0.0)] += 1
    out = language_id.learn_and_identify(frame(rows), held_out("doc_id", 3, 1)).collect()
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in out) == want


def test_folds(frame):
    import zlib

    d = frame([[k, "t", "en", "s"] for k in (0, 1, 22, 333, None)])
    for r in d.select("doc_id", held_out("doc_id", 3, 1).alias("h")).collect():
        assert r.h == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
    many = d.sparkSession.range(10_000)
    assert 800 < bounded(many, 10_000, 1000, "id").count() < 1200


def fixed(text, lex=None):
    return toxicity.probabilities(toxicity.FIXED, lex or toxicity.Lexicon({}), [text])[0]


def test_grammar():
    lex = toxicity.Lexicon({"zork*": (4.0, 4.0)})
    assert lex.features("nothing here") == [0.0] * toxicity.FEATURES
    assert fixed("you moron") > fixed("a moron walked by")  # target
    assert fixed("he is not a moron") < fixed("he is a moron")  # negation
    assert fixed('she said "moron"') < fixed("she ate moron")  # reported speech
    assert fixed("I will kill you") > 0.5 > fixed("kill the process")  # a threat needs its target
    assert fixed("I will not kill you") < 0.5
    assert [a for c in lex.clauses("what a zorkling") for a, _ in c] == [toxicity.arc(toxicity.BARE, 0, 0)]
    assert [a for c in lex.clauses("you are not a moron") for a, _ in c] == [toxicity.arc(toxicity.AIMED, 1, 0)]
    assert fixed("you moron. you moron") > fixed("you moron. he left")
    for w in ("worth", "path", "pathway", "idiom", "trashes"):
        assert toxicity.Lexicon({}).of(w)[0] == toxicity.OTHER


def clauses_by_rule(lex, text):
    """Matches of each clause, straight from the rules in the docstring."""
    out = []
    for clause in re.split(r"[.!?;,\n|]", (text or "").lower()):
        kinds = [lex.of(w) for w in re.findall(r"[^\W\d_]+", clause)]
        c = [k for k, _ in kinds]
        near = lambda k, at, span: int(k in c[max(0, at - span) : at])  # noqa: E731, B023
        found = []
        for i, (k, w) in enumerate(kinds):
            if k == toxicity.INSULT:
                found.append((near(toxicity.TARGET, i, 6), near(toxicity.NEGATION, i, 3), near(toxicity.REPORT, i, 8), w[0]))
            if k == toxicity.THREAT:
                at = next((j for j in range(i + 1, min(i + 4, len(c))) if c[j] in (toxicity.TARGET, toxicity.THREAT)), None)
                aimed = at is not None and c[at] == toxicity.TARGET
                at = min(i + 3, len(c)) if at is None else at
                found.append((3 if aimed else 2, near(toxicity.NEGATION, at, 3), near(toxicity.REPORT, at, 8), w[1]))
        if kinds:
            out.append(sorted((toxicity.arc(*x[:3]), x[3]) for x in found))
    return out


def test_machine_follows_the_rules():
    lex, rng = toxicity.Lexicon({"zork*": (4.0, 4.0)}), random.Random(2)
    pool = ["you", "moron", "kill", "not", "said", "zorkling", "tree", "walks", "blue", "and"]
    for _ in range(400):
        text = "".join(rng.choice(pool) + rng.choice([" "] * 9 + [". ", ", ", "\n"]) for _ in range(rng.randint(1, 40)))
        want = clauses_by_rule(lex, text)
        if not any(want):
            assert not any(lex.features(text)[: toxicity.ARCS])
            continue
        assert [sorted(c) for c in lex.clauses(text)] == want
        sums = [0.0] * toxicity.ARCS
        for a, w in (m for c in want for m in c):
            sums[a] += w
        firm = sum(any(a in (0, 4, 12) for a, _ in c) for c in want)
        assert lex.features(text) == pytest.approx([*np.log1p(sums), firm / len(want)])


def test_grammar_decides_where_words_can_not():
    """The same words in toxic and clean clauses: without targets, negations and reports the classes can't be told apart."""
    lex, rng, nothing = toxicity.Lexicon({}), random.Random(6), toxicity.memory(toxicity.TARGET, 0)
    off = toxicity.compose(toxicity.insult(), toxicity.threat(3), nothing, nothing, nothing)
    toxic = ["you are a {}", "everyone knows you {}", "I will kill you", "we hurt them", "you {} go away"]
    clean = ["you are not a {}", 'the judge said "{}"', "she wrote that he called it {}", "kill the process", "never hurt you", "a {} in the play"]
    texts, y = [], []
    for k in range(400):
        s = rng.choice(toxic if k % 2 else clean).format(rng.choice(["moron", "loser", "clown", "idiot"]))
        texts.append(f"some words before. {s}. and some words after")
        y.append(k % 2)
    y = np.array(y)

    def accuracy(machine):
        x = np.array([lex.features(t, machine) for t in texts])
        w = toxicity._fit(x[:300], y[:300])
        return np.mean((w[0] + x[300:] @ w[1:] >= 0) == y[300:])

    assert accuracy(toxicity.GRAMMAR) > 0.95 > 0.8 > accuracy(off)


def places_by_rule(text):
    """Words with their places, by the words before them in their clause."""
    lex, found = toxicity.Lexicon({}), {}
    for clause in re.split(r"[.!?;,\n|]", text.lower()):
        ws = re.findall(r"[^\W\d_]+", clause)
        kinds = [lex.of(w)[0] for w in ws]
        for i, w in enumerate(ws):
            near = lambda k, span: k in kinds[max(0, i - span) : i]  # noqa: E731, B023
            at = "held" if near(toxicity.NEGATION, 3) or near(toxicity.REPORT, 8) else "aimed" if near(toxicity.TARGET, 6) else "bare"
            found.setdefault(w, set()).add(at)
    return found


def test_terms_are_learned_from_arcs(spark):
    """Learned terms, their weights and the regression against their definitions, counted without Spark."""
    rng, rows = random.Random(11), []
    frames = [("you {} there", 1), ("a {} walks", 0), ("they are not {} at all", 0), ("she said a {} came", 0)]
    for k in range(1200):
        text = words("bb", rng, 12)
        toxic = int(k % 6 == 0)
        if toxic:
            text += ". " + rng.choice(["you gronk there", "a vlim here", "you snarp", "snarp it is"])
        elif k % 2:
            shape = rng.choice(frames[1:])[0]
            text += ". " + shape.format(rng.choice(["gronk", "gronk", "tree"] if shape[0] == "a" else ["snarp", "vlim"]))
        rows.append((text, toxic))
    n, t = len(rows), sum(y for _, y in rows)
    learned = toxicity._learned_terms(spark.createDataFrame(rows, "text string, toxic int").repartition(3), n, t)
    counts = {}
    for text, y in rows:
        terms = {}
        for w, at in places_by_rule(text).items():
            for term in {w, *(w[:k] + "*" for k in toxicity.STEMS if len(w) >= k)}:
                terms.setdefault(term, set()).update(at)
        for term, at in terms.items():
            for name, any_of in (("plain", {"bare", "aimed"}), ("bare", {"bare"}), ("aimed", {"aimed"})):
                if at & any_of:
                    c = counts.setdefault(term, {p: [0, 0] for p in ("plain", "bare", "aimed")})
                    c[name][y] += 1
        for term in terms:
            counts.setdefault(term, {p: [0, 0] for p in ("plain", "bare", "aimed")})
    floor, want = 2 * np.log(3 * sum(any(map(any, c.values())) for c in counts.values())) + toxicity.SURE, {}
    for term, c in counts.items():
        got = {}
        for place, (clean, hot) in c.items():
            if term.endswith("*"):
                hot -= max((x[place][1] for w, x in counts.items() if not w.endswith("*") and len(w) >= len(term) - 1 and w.startswith(term[:-1])), default=0)
            share = (clean + hot) / n
            g = 2 * sum(o * np.log(o / e) for o, e in ((hot, share * t), (clean, share * (n - t))) if o)
            odds = np.log((hot + 0.5) / (t - hot + 0.5)) - np.log((clean + 0.5) / (n - t - clean + 0.5))
            got[place] = (g >= floor and odds > 3, odds, hot + clean)
        sure, base, _ = got["plain"]
        pull = lambda p: max((p[2] * p[1] + toxicity.PULL * base) / (p[2] + toxicity.PULL), 0)  # noqa: E731, B023
        if any(x[0] for x in got.values()):
            want[term] = tuple(pull(got[p]) if sure else got[p][1] if got[p][0] else 0 for p in ("bare", "aimed"))
    assert set(learned) == set(want) and all(learned[x] == pytest.approx(want[x]) for x in want)
    assert learned["gronk"][0] == 0 < learned["gronk"][1]  # an insult only where it is aimed
    assert min(learned["snarp"]) > 3 and learned["vlim"][0] > 3  # clean texts have them negated or reported
    lex = toxicity.Lexicon(learned)
    x, y = np.array([lex.features(a) for a, _ in rows]), np.array([b for _, b in rows])
    w = toxicity._fit(x, y)
    a = np.column_stack([np.ones(n), x])
    slope = a.T @ (1 / (1 + np.exp(-a @ w)) - y) + np.array([1e-6] + [1.0] * x.shape[1]) * (w - np.array([toxicity.BIAS, *toxicity.PRIOR, toxicity.SHARE]))
    assert np.abs(slope).max() < 1e-5  # the penalised likelihood is convex: a zero slope is its only optimum
    scores, arcs = toxicity.judged(toxicity.Model(learned, w.tolist()), lex, [a for a, _ in rows])
    assert np.mean((scores >= 0.5) == y) > 0.99
    assert {a for a, s in zip(arcs, scores, strict=True) if s >= 0.5} == {"bare insult", "aimed insult"}


def test_toxicity(spark, frame):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 8 == 0
        text = words("aa", rng, 50)
        if toxic:
            text += " you " + rng.choice(["zorkish", "zorkung", "zorkal", "moron"]) + " " + words("aa", rng, 5)
        rows.append([k, text, "en", "s"])
        labels.append((k, 1, int(toxic)))
    odd = [[900, None, "en", "s"], [901, "", "en", "s"], [902, words("aa", rng, 20_000), "en", "s"]]
    y = spark.createDataFrame(labels + [(3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(frame(rows + odd), y, held_out("doc_id", 5, 0)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert sum(got[k].predicted == t for k, _, t in labels) >= 396
    model = toxicity.learn_from(frame(rows), y, held_out("doc_id", 5, 0))
    assert "zork*" in model.learned and "moro*" not in model.learned  # a stem needs more than one word
    want = toxicity.probabilities(model, toxicity.Lexicon(model.learned), [t for _, t, *_ in rows])
    assert [got[r[0]].score for r in rows] == pytest.approx(list(want))
    assert got[900].score == got[901].score < 0.5 and got[902].predicted == 0
    none = toxicity.score_documents(frame(odd), y.limit(0), held_out("doc_id", 5, 0)).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.score_documents(frame([]), y, held_out("doc_id", 5, 0)).collect() == []


needs_model = pytest.mark.skipif(not os.path.exists(sentencepiece_codec.MODEL), reason="no model file")
TEXTS = [
    "", "a", " ", "  two  blanks  ", "The quick brown fox jumped over 13 lazy dogs.", "Überraschung für Élodie — ça va? 日本語 🙂",
    "line\nbreak\ttab\r\n", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "internationalization" * 30, "x=1;y=[2,3]; // comment",
]


@needs_model
def test_same_as_library():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load())
    for t in TEXTS:
        ids = codec.encode(t)
        assert ids.tolist() == sp.encode(t)
        assert codec.decode(ids).decode() == t


def brute(codec, s):
    """The best-scored split of s into pieces, trying all."""
    best = {0: (0.0, [])}
    for i in range(1, len(s) + 1):
        found = [(best[j][0] + codec.score[s[j:i]], best[j][1] + [codec.id_of[s[j:i]]]) for j in range(i) if j in best and s[j:i] in codec.score]
        if found:
            best[i] = max(found, key=lambda x: x[0])
    return best[len(s)]


@needs_model
def test_unigram_viterbi():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load())
    codec.kind = sentencepiece_codec.UNIGRAM
    rng = random.Random(3)
    for n in (1, 5, 40, 400):
        s = "".join(rng.choice("etaoinshrdlu") for _ in range(n))
        ids = codec.viterbi(s)
        assert "".join(codec.pieces[i][0] for i in ids) == s
        assert sum(codec.pieces[i][1] for i in ids) == pytest.approx(brute(codec, s)[0])


@needs_model
def test_documents(docs, rows):
    model = sentencepiece_codec.load()
    out = sentencepiece_codec.encode_documents(docs, model)
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in out.collect())
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = sorted((r.doc_id is not None, r.doc_id, list(r.ids)) for r in out.collect() if r.doc_id is not None)
    assert got == sorted((True, i, sp.encode(t or "")) for i, t, *_ in rows if i is not None)  # the whole table, as the library has it
    back = sentencepiece_codec.decode_documents(out, model).where(F.col("doc_id") != 100)
    want = {i: t or "" for i, t, *_ in rows}
    assert all(r.text == want[r.doc_id] for r in back.collect())


@needs_model
def test_empty(empty):
    assert sentencepiece_codec.encode_documents(empty, sentencepiece_codec.load()).collect() == []
    assert language_id.learn_and_identify(empty, held_out("doc_id", 3, 1)).collect() == []
