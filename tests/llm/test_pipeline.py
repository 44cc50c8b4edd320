"""The pipeline's stages in a row, each against plain Python on what the one before kept."""

import os
from collections import Counter, defaultdict

import pytest
from llm_helpers import LOWER, WORD, sort_key
from test_dedup import components

import corpus_pipeline
from weft.llm import mixing, sentencepiece_codec

pytestmark = pytest.mark.skipif(not os.path.exists(sentencepiece_codec.MODEL), reason="no model file")


def test_stages(spark, frame, rows, tmp_path):
    clean = [r for r in rows if r[0] is not None]
    toxic = [[2000 + k, f"words {k} you moron and you idiot again {k}. you scum", "en", "s1"] for k in range(30)]
    frame(clean + toxic).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    ids = sorted({r[0] for r in clean})
    y = [(i, 1, 0) for i in ids] + [(r[0], 1, 1) for r in toxic]
    spark.createDataFrame(y, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/out{k}")
        assert name == "encoding" or docs.columns == columns
    bag = lambda name: [[r.doc_id, r.text, r.lang, r.source] for r in seen[name].collect()]

    kept = bag("toxicity")
    assert Counter(r[0] for r in kept) == Counter(r[0] for r in clean)
    groups = defaultdict(list)
    for i, t, *_ in kept:
        groups[(t or "").translate(LOWER)].append(i)
    single = bag("exact dedup")
    assert Counter(r[0] for r in single) == Counter(max(v, key=sort_key) for v in groups.values())
    near = bag("near dedup")
    assert Counter(r[0] for r in near) == Counter(c[0] for c in components(single, 5, 80).elements() if c[3])
    plan = {r.doc_id: r.taken for r in mixing.mix_sizes(spark.read.parquet(f"{tmp_path}/out2")).collect()}
    mixed = bag("mixing")
    words = Counter()
    for i, t, *_ in mixed:
        words[i] += len(WORD.findall(t))
    assert dict(words) == {i: n for i, n in plan.items() if n}
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load())
    want = Counter((i, tuple(codec.encode(t).tolist())) for i, t, *_ in mixed)
    assert Counter((r.doc_id, tuple(r.ids)) for r in seen["encoding"].collect()) == want
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_empty_and_odd_tables(spark, frame, tmp_path):
    """An empty table stays empty; null ids, null and empty texts, repeated rows and null sources pass or go as stated."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    y = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    long, some = "a null id " * 40, "some words " * 90
    odd = [[None, long, "en", "s"], [None, long, "en", "s"], [5, None, None, None], [6, "", "en", "s"], [7, some, None, None]]
    for name, rows in (("none", []), ("odd", odd)):
        at = f"{tmp_path}/{name}"
        frame(rows).select(*cols).write.parquet(f"{at}/documents.parquet")
        y.write.parquet(f"{at}/labels.parquet")
        got = {r.doc_id for r in corpus_pipeline.run(spark, at).collect()}
        assert got == ({None, 7} if rows else set())  # documents without words are never taken
    docs = frame(odd).select(*cols)
    at = f"{tmp_path}/odd"
    count = lambda k: corpus_pipeline.STAGES[k][1](spark, docs, at).count()
    assert [count(k) for k in range(3)] == [5, 3, 5]
    assert sorted(r.n_ids for r in corpus_pipeline.STAGES[4][1](spark, docs, at).collect())[:2] == [0, 0]
