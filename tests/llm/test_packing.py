"""Packing: ids against the library's, the plan, and whole results put together again."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import packing

SPEC = packing.load()
LIBRARY = packing.Encoder(SPEC).tokenizer
ENCODER = packing.Encoder(SPEC)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(
    st.text(max_size=40),
    st.lists(st.sampled_from(
        [" ", "  ", "\n", "\t", "\r", "a", "It's", "'ll", "12", "é", "日本", "🙂", " ", " ", "\u0085", "\x1c", "​", "…", "--", "<|endoftext|>", "the"]
    ), max_size=14).map("".join),
))
def test_ids_are_the_library_s(text):
    assert np.frombuffer(ENCODER.encode(text), packing.IDS).tolist() == library_ids(text)


@settings(max_examples=2000, deadline=None)
@given(st.text(st.sampled_from("abcdefghijklmnopqrstuvwxyzABCDEFGéèêñüßØÿ"), min_size=1, max_size=30), st.sampled_from(["", " ", "\n"]), st.text(st.sampled_from(".,!*$%&#'-"), max_size=4))
def test_simple_words(letters, before, after):
    word = before + letters + after
    assert packing.SIMPLE.fullmatch(word) and ENCODER.simple(word) == library_ids(word)


def test_other_vocabularies_use_the_library_alone():
    import json

    d = json.loads(SPEC)
    assert packing.merges_by_rank(json.dumps(d | {"normalizer": {"type": "Lowercase"}}).encode()) is None
    assert packing.merges_by_rank(json.dumps(d | {"model": d["model"] | {"merges": d["model"]["merges"][::-1]}}).encode()) is None


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 2047), st.integers(1, 60), max_size=40))
def test_plan(counts):
    check_plan(counts)


@pytest.mark.parametrize("counts", [{}, {1: 1}, {1500: 10**9}, {3: 10**12}, {2047: 5, 1: 5}, {1025: 7, 1024: 3, 300: 1}, dict.fromkeys(range(1, 2048), 10**7)])
def test_plan_of_any_size(counts):
    plan = packing.lay_out(counts)
    assert sum(e[4] * (e[2] - e[1]) for e in plan.entries) == sum(k * n for k, n in counts.items())
    assert sum(c * n for c, n in plan.of_context.items()) == sum(k * n for k, n in counts.items())  # nothing is padded
    assert len(plan.entries) < 100_000


def check_plan(counts):
    plan = packing.lay_out(counts, taken=3)
    filled, context_of = defaultdict(list), {}
    for length, n in counts.items():
        for place in range(n):
            at = 0
            for start, tokens, sequence, offset, context, index in plan.pieces(length, place):
                assert start == at and tokens > 0 and index >= 0
                at += tokens
                filled[sequence].append((offset, tokens))
                assert context_of.setdefault(sequence, (context, index)) == (context, index)
            assert at == length
    assert sorted(filled) == list(range(3, plan.sequences))
    for sequence, parts in filled.items():
        at = 0
        for offset, tokens in sorted(parts):
            assert offset == at
            at += tokens
        assert at == context_of[sequence][0] and at & (at - 1) == 0
    places = Counter(c for c, _ in context_of.values())
    assert {c: n - 3 * (c == 2048) for c, n in plan.of_context.items() if n - 3 * (c == 2048)} == dict(places)
    assert len(set(context_of.values())) == len(context_of)


def test_contexts_must_be_powers():
    for wrong in ((3000,), (512, 1024)):
        with pytest.raises(ValueError):
            packing.lay_out({}, wrong)


ODD = [
    [700, "<|endoftext|> a  b\t c\n\n d ", "en", "s"], [701, " lead  and   other blanks", "en", "s"], [702, "x" * 50_000, "en", "s"],
    [702, "x" * 50_000, "en", "s"], [None, None, None, None], [703, "word " * 2047, "en", "s"], [704, "word " * 2048, "en", "s"],
]


@pytest.mark.parametrize("contexts,end,few", [((2048, 1024, 512, 256), 1, 10**6), ((64, 16), None, 0)])
def test_pieces(frame, rows, contexts, end, few, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", few)  # both ways of finding a task's places
    rng = random.Random(4)
    rows = rows + ODD + [[800 + k, " ".join(rng.choice(["so", "few", "words"]) for _ in range(1 + k % 7)), "en", "s"] for k in range(80)]
    got = packing.pack(frame(rows).repartition(5), SPEC, end, contexts, step_windows=2)
    pieces = got.collect()
    docs = Counter((i, tuple(library_ids(t or "") + ([] if end is None else [end]))) for i, t, _, _ in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, packing.IDS)
        assert len(ids) == p.length > 0
        by_doc[p.doc_id].append((p.start, ids, p.doc_tokens))
        by_sequence[p.sequence_id].append(p)
    for i, own in by_doc.items():  # of documents with one id the pieces of each start are alike, or told apart by their sizes
        want = Counter(dict((d, n) for d, n in docs.items() if d[0] == i))
        total = Counter(t for (_, d), n in want.items() for t in d * n)
        assert Counter(t for _, ids, _ in own for t in ids.tolist()) == total
        if sum(want.values()) == 1:
            text = next(iter(want))[1]
            own.sort(key=lambda x: x[0])
            assert tuple(t for _, ids, _ in own for t in ids.tolist()) == text
            at = 0
            for start, ids, n in own:
                assert start == at and n == len(text)
                at += len(ids)
    steps = defaultdict(Counter)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == parts[0].context and at & (at - 1) == 0 and at <= contexts[0]  # full: nothing is padded
        assert len({(p.context, p.step) for p in parts}) == 1
        steps[parts[0].context][parts[0].step] += 1
    n_steps = 1 + max(p.step for p in pieces)
    for per in steps.values():
        counts = [per[k] for k in range(n_steps)]
        assert max(counts) - min(counts) <= 1
    made = {(r.sequence_id, r.tokens, r.n_pieces) for r in packing.sequences(got).collect()}
    assert made == {(k, sum(p.length for p in v), len(v)) for k, v in by_sequence.items()}
    crc = {(p.doc_id, p.start, p.sequence_id, p.offset): zlib.crc32(p.ids) for p in pieces}
    assert all(crc[r.doc_id, r.start, r.sequence_id, r.offset] == r.ids_crc32 for r in packing.digests(got).collect())


def test_empty(empty):
    out = packing.digests(packing.pack(empty, SPEC, 1))
    assert out.count() == 0 and "ids_crc32" in out.columns
