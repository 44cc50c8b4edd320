"""Exact, near and substring dedup against plain Python on whole small tables."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from llm_helpers import LOWER, WORD, sort_key
from pyspark.sql import functions as F

from weft.llm import minhash, radix, suffix_arrays, suffix_trees


def sha(b):
    return hashlib.sha256(b).hexdigest()


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"head": 2, "growth": 2}])
def test_exact(docs, rows, options):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = radix.exact_duplicates(docs, **options).collect()
    assert len(out) == len(rows)
    stay = Counter()
    for r in out:
        stay[r.text_sha256] += r.kept
    for text, ids in groups.items():
        top = max(ids, key=sort_key)
        mine = [r for r in out if r.text_sha256 == sha(text.encode())]
        assert sorted((r.doc_id for r in mine), key=sort_key) == sorted(ids, key=sort_key)
        assert {(r.keep_id, r.group_size) for r in mine} == {(top, len(ids))}
        assert all(r.doc_id == top for r in mine if r.kept)
    assert set(stay.values()) == {1}


def test_keep_one(docs, rows):
    out = radix.keep_one(docs)
    assert out.columns == docs.columns
    assert out.count() == len({(t or "").translate(LOWER) for _, t, *_ in rows})


def byte_repeats(texts, length):
    seen = defaultdict(list)
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]].append((k, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = b"\1" * length
    return gone


@pytest.mark.parametrize("options", [{"length": 60, "width": 30}, {"length": 60, "width": 40, "group": 1}, {"length": 400}])
def test_byte_repeats(docs, rows, options):
    texts = [(t or "").encode() for _, t, *_ in rows]
    want = Counter()
    for (i, *_), t, g in zip(rows, texts, byte_repeats(texts, options["length"]), strict=True):
        spans = sum(g[k] and not (k and g[k - 1]) for k in range(len(g)))
        want[(i, len(t), sum(g), spans, sha(bytes(b for b, x in zip(t, g, strict=True) if not x)))] += 1
    assert bag(suffix_arrays.strip_repeats(docs, **options).drop("n_shared")) == want


def test_shared_samples(docs, rows):
    """Any SAMPLE + GAP - 1 bytes in common are reported; without SAMPLE bytes in common nothing is."""
    got = {r.doc_id: r.n_shared for r in suffix_arrays.strip_repeats(docs).collect()}
    some, least = suffix_arrays.SAMPLE + suffix_arrays.GAP - 1, suffix_arrays.SAMPLE
    ids = {n: defaultdict(set) for n in (some, least)}
    for n, seen in ids.items():
        for i, t, *_ in rows:
            b = (t or "").encode()
            for k in range(len(b) - n + 1):
                seen[b[k : k + n]].add(i)
    must, may = ({i for v in ids[n].values() if len(v) > 1 for i in v} for n in (some, least))
    assert must and all(got[i] > 0 for i in must)
    assert {i for i, n in got.items() if n} <= may


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_structured_strings_stay_apart(frame, n):
    """A word and its complement, which polynomials modulo a power of two can't tell apart."""
    x, y = thue_morse(n), thue_morse(n, "b", "a")
    near = bag(minhash.near_components(frame([[1, x, "en", "s"], [2, y, "en", "s"]])))
    assert near == Counter([(1, 1, 1, True), (2, 1, 2, True)])
    tail = " one two three four five six seven eight nine ten eleven twelve"
    out = suffix_trees.strip_repeats(frame([[1, x + tail, "en", "s"], [2, y + tail, "en", "s"]])).collect()
    assert {(r.doc_id, r.n_removed) for r in out} == {(1, 0), (2, 0)}
    texts, length = [x.encode(), y.encode()], n - 20
    out = suffix_arrays.strip_repeats(frame([[1, x, "en", "s"], [2, y, "en", "s"]]), length=length, width=100).collect()
    want = [sum(g) for g in byte_repeats(texts, length)]
    assert [r.n_removed for r in sorted(out, key=lambda r: r.doc_id)] == want


@pytest.mark.parametrize("options", [{}, {"group": 1}, {"length": 6}])
def test_word_repeats(docs, rows, options):
    n = options.get("length", 13)
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    first = {}
    for (i, *_), w in zip(rows, words, strict=True):
        for k in range(len(w) - n + 1):
            s = tuple(w[k : k + n])
            first[s] = min(first.get(s, sort_key(i)), sort_key(i))
    want = Counter()
    for (i, *_), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < sort_key(i):
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(w), len(gone), sha(kept.encode()))] += 1
    assert bag(suffix_trees.strip_repeats(docs, **options)) == want


@pytest.mark.parametrize("options", [{}, {"group": 1}, {"width": 3}])
def test_leaves_with_many_occurrences(frame, options):
    """Passages that differ near shared words, each in several documents: nodes decide for every occurrence."""
    rng = random.Random(7)
    common = [f"c{k}" for k in range(60)]
    variants = []
    for v in range(12):
        words = list(common)
        for k in rng.sample(range(60), 2):
            words[k] = f"v{v}"
        variants.append(words)
    rows = []
    for i in range(120):
        x, y = (rng.choice(variants)[rng.randrange(20) : rng.randrange(30, 61)] for _ in range(2))
        rows.append([rng.randrange(90), " ".join([f"a{i}", *x, f"b{i}", *y]), "en", "s"])
    rows.append([None, " ".join(variants[3][10:40]), "en", "s"])
    first, starts = {}, []
    for i, t, *_ in rows:
        w = t.split()
        starts.append([tuple(w[k : k + 13]) for k in range(len(w) - 12)])
        for s in starts[-1]:
            first[s] = min(first.get(s, sort_key(i)), sort_key(i))
    want = Counter()
    for (i, t, *_), windows in zip(rows, starts, strict=True):
        gone = {k + j for k, s in enumerate(windows) if first[s] < sort_key(i) for j in range(13)}
        w = t.split()
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(w), len(gone), sha(kept.encode()))] += 1
    assert bag(suffix_trees.strip_repeats(frame(rows), **options)) == want


def components(rows, k, percent):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    least = defaultdict(list)
    for p, (i, *_) in zip(part, rows, strict=True):
        least[p].append(i)
    return Counter(
        (i, len(s), min(least[p], key=sort_key), i == min(least[p], key=sort_key))
        for (i, *_), s, p in zip(rows, sets, part, strict=True)
    )


@pytest.mark.parametrize("k,percent", [(4, 80), (5, 80)])
def test_near(docs, rows, k, percent):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, bool(r.kept) if r.kept is not None else True)
                  for r in minhash.near_components(docs, k=k, percent=percent).collect())
    assert got == components(rows, k, percent)


def test_near_across_components(frame):
    """A family whose middle members alone link its ends: found whatever the pivots are."""
    base = [f"w{k}" for k in range(60)]
    rows = [[k, " ".join(base[3 * k : 3 * k + 30] + base[:3] * 0), "en", "s"] for k in range(10)]
    assert Counter(tuple(r) for r in minhash.near_components(frame(rows), k=1).collect()) == components(rows, 1, 80)


def test_keep_first(docs, rows):
    out = minhash.keep_first(docs, k=5)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {c[0] for c in components(rows, 5, 80) if c[3]}


def test_empty(empty):
    assert radix.exact_duplicates(empty).collect() == []
    assert suffix_arrays.strip_repeats(empty).collect() == []
    assert suffix_trees.strip_repeats(empty).collect() == []
    assert minhash.near_components(empty).collect() == []
    assert radix.keep_one(empty).collect() == []
    assert minhash.keep_first(empty).collect() == []


def test_many_rows_under_one_id(spark):
    """Each of 80,000 rows that repeat an id has its own result."""
    passage = " ".join(f"p{k}" for k in range(13))
    first = spark.createDataFrame([(1, f"first {passage} end")], "doc_id long, text string")
    text = F.concat(F.lit("row "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, F.lit(" " + passage)).otherwise(F.lit(" other")), F.lit(" z"))
    many = spark.range(80_000).select(F.lit(7).cast("long").alias("doc_id"), text.alias("text"))
    out = suffix_trees.strip_repeats(first.unionByName(many))
    got = {(r.doc_id, r.n_words, r.n_removed): r.n for r in out.groupBy("doc_id", "n_words", "n_removed").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, 15, 0): 1, (7, 16, 13): 40_000, (7, 4, 0): 40_000}
