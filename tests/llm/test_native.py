"""Fingerprints, mixing and sharding against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_helpers import WORD, sort_key
from pyspark.sql import functions as F

from weft.llm import fingerprints, mixing, sharding


def test_compare_with_next(docs, rows):
    out = fingerprints.compare_with_next(docs).collect()
    assert len(out) == len(rows)
    ids = sorted({i for i, *_ in rows}, key=sort_key)
    text = {i: t or "" for i, t, *_ in rows}
    for r in out:
        t, n = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (edited == t) == (r.fingerprint == r.edited_fingerprint)
        assert (r.near_next == 1) == (n == t)
    by_text = defaultdict(set)
    for r in out:
        by_text[text[r.doc_id]].add(r.fingerprint)
    assert {len(v) for v in by_text.values()} == {1} and len(set.union(*by_text.values())) == len(by_text)


def parse(fingerprint):
    """(root, [(section node, [(paragraph node, pieces)])])."""
    root, below = fingerprint.split(":")
    sections = [x.split("=") for x in below.split("/")]
    return root, [(node, [(p.split(".")[0], [x for x in p.split(".")[1].split(",") if x]) for p in ps.split(";")]) for node, ps in sections]


def test_merkle_nodes(docs, rows):
    """Each node from what it stands on, up to the root."""
    node = lambda b: hashlib.sha256(b).hexdigest()[:32]
    text = {i: t or "" for i, t, *_ in rows}
    for r in fingerprints.fingerprints(docs).collect():
        root, sections = parse(r.fingerprint)
        cut = [re.split(r"(?<=\n)(?!\n)", s) for s in re.split(r"(?<=\n\n)(?!\n)", text[r.doc_id])]
        assert [[node(p.encode()) for p in s] for s in cut] == [[n for n, _ in ps] for _, ps in sections]
        assert [node("".join(n for n, _ in ps).encode()) for _, ps in sections] == [n for n, _ in sections]
        assert root == hashlib.sha256("".join(n for n, _ in sections).encode()).hexdigest()


def test_likeness_is_read_from_fingerprints(docs, rows):
    out = fingerprints.compare_with_next(docs).collect()
    ids = sorted({i for i, *_ in rows}, key=sort_key)
    first = {r.doc_id: r.fingerprint for r in out}

    def likeness(a, b):
        if a.split(":")[0] == b.split(":")[0]:
            return 1.0
        x, y = ({q for _, ps in parse(f)[1] for _, pieces in ps for q in pieces} for f in (a, b))
        n = len(x) + len(y)
        return min(2 * len(x & y) / n if n else 0.0, 1 - 1 / (n + 2))

    for r in out:
        assert r.near_edited == pytest.approx(likeness(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(likeness(r.fingerprint, first[ids[(ids.index(r.doc_id) + 1) % len(ids)]]))


def test_single_and_sparse_ids(frame):
    one = fingerprints.compare_with_next(frame([[5, "abcd", "en", "s"]])).collect()
    assert [(r.near_next, r.near_edited < 1) for r in one] == [(1.0, True)]
    ids = [-(2**62), -5000, 0, 4095, 4096, 10**12, 2**62]
    got = fingerprints.next_ids(frame([[i, "t", "en", "s"] for i in ids]).select(F.col("doc_id").alias("did"))).collect()
    assert {r.did: r.next_did for r in got} == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_differing_branches(spark):
    lines = ["One. Two.\n", "Three here.\n\n", "Next section.\n", "Two lines.\n", "Last line.\n"]  # two sections of 2 and 3
    text = "".join(lines)
    cases = {
        text: [],
        text.replace("Three", "Tree"): [(0, 1, "a"), (0, 1, "b")],
        "Zero.\n" + text: [(0, 0, "b")],  # inserted in front, in the middle, at the end
        "".join([*lines[:3], "New.\n", *lines[3:]]): [(1, 1, "b")],
        text + "more.\n": [(1, 3, "b")],
        text + "more": [(1, 3, "a"), (1, 3, "b")],  # a section that ends with a line end has an empty paragraph after it
        "".join(lines[1:]): [(0, 0, "a")],  # deleted
        "".join([*lines[:3], lines[4]]): [(1, 1, "a")],
        "".join(lines[:4]): [(1, 2, "a")],
        "".join([*lines[1:3], lines[0], *lines[3:]]): [(0, 0, "a"), (1, 1, "b")],  # moved
        "".join([*lines[:2], *lines[3:], lines[2]]): [(1, 0, "a"), (1, 2, "b")],
        "".join([lines[4], *lines[:4]]): [(1, 2, "a"), (0, 0, "b")],
        text + lines[0] + lines[0]: [(1, 3, "b"), (1, 4, "b")],  # repeated
        "": [(0, 0, "a"), (0, 1, "a"), (1, 0, "a"), (1, 1, "a"), (1, 2, "a"), (1, 3, "a")],  # the first empty one stays
    }
    fp = lambda c: fingerprints.written(fingerprints.tree(F.col(c)))
    d = spark.createDataFrame([(text, other) for other in cases], "a string, b string").select("b", fp("a").alias("fa"), fp("b").alias("fb"))
    got = {r.b: [tuple(x) for x in r.d] for r in d.select("b", fingerprints.differing_branches("fa", "fb").alias("d")).collect()}
    assert got == cases


def targets(sizes):
    """Sharing with limits, by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in left)
        share = {s: rest * weight[s] / w for s in left}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mix(docs, rows):
    out = mixing.mix_sizes(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, _, s in rows}
    sizes = Counter()
    for i, *_ in rows:
        sizes[source[i]] += size[i]
    want = targets(sizes)
    taken = Counter()
    for r in out:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], sizes[s])
        assert r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert len(out) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK + 1
    again = mixing.mix_sizes(docs.repartition(7)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_mixed_rows(docs, rows):
    plan = {r.doc_id: r.taken for r in mixing.mix_sizes(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    total = Counter()
    for r in mixing.mix_sizes(docs).collect():
        total[r.doc_id] += r.taken
    assert plan and {i: n for i, n in words.items() if n} == {i: n for i, n in total.items() if n}


def test_repeated_rows_are_mixed_alike(frame):
    """Equal rows of which a run takes some: each rerun gives the same rows, and what the plan takes."""
    rows = [[7, "one two three four five six seven eight nine ten " * 12, "en", "a"]] * 6 + [[9, "x y z " * 9, "en", "a"]]
    rows += [[11, "p q r s " * 200, "en", "b"]]
    bags = [Counter((r.doc_id, r.text) for r in mixing.mix(frame(rows).repartition(n)).collect()) for n in (1, 5)]
    assert bags[0] == bags[1]
    taken = Counter()
    for r in mixing.mix_sizes(frame(rows)).collect():
        taken[r.doc_id] += r.taken
    assert Counter({i: sum(len(WORD.findall(t)) * n for (j, t), n in bags[0].items() if j == i) for i in taken}) == taken


def test_shards_in_levels(docs, rows, monkeypatch):
    """Many small shards through groups of three: sources still get their words, and nobody over twice its size."""
    monkeypatch.setattr(mixing, "FAN", 3)
    monkeypatch.setattr(mixing, "MIN_SHARD_WORDS", 300)
    out = mixing.mix_sizes(docs).collect()
    taken, want = Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        s = next(x[3] for x in rows if x[0] == r.doc_id)
        taken[s] += r.taken
        want[s] = r.target
    assert len(out) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 20 * mixing.BLOCK for s in want)


def test_sainte_lague(spark):
    votes = {"a": 53_000, "b": 24_000, "c": 23_000, "d": 0}
    seats = 7
    quotients = sorted(((v / (2 * k - 1), s) for s, v in votes.items() for k in range(1, 20)), reverse=True)[:seats]
    want = Counter(s for _, s in quotients)
    d = spark.createDataFrame([(1, s, v * seats / 100_000, seats) for s, v in votes.items()], "g int, s string, share double, seats long")
    got = {r.s: r.quota for r in mixing.sainte_lague(d, ["g"], "share", "seats", ["s"]).collect()}
    assert got == {s: want[s] for s in votes}


def check_shards(out, rows, shards):
    count = Counter(r.shard for r in out)
    assert sum(count.values()) == len(rows)
    n = [count[s] for s in range(shards)]
    assert max(n) - min(n) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(count[s]))


def test_shards(docs, rows):
    out = sharding.shard_ring(docs, shards=16).collect()
    check_shards(out, rows, 16)
    text = {i: (t or "").encode() for i, t, *_ in rows}
    for r in out:
        assert (r["size"], r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]))


@pytest.mark.parametrize("shards,bins,vnodes", [(16, sharding.BINS, sharding.VNODES), (5, 8, 3)])
def test_ring_walk(docs, rows, shards, bins, vnodes):
    """Each row by a walk of its own: its shard if that has room, else clockwise to the next point whose shard has."""
    out = sharding.shard_ring(docs, shards=shards, bins=bins, vnodes=vnodes).collect()
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), F.crc32(text.cast("binary")).alias("crc"),
                    (F.octet_length(text) + 1).cast("long").alias("size"))
    d = d.withColumn("bin", F.pmod(F.xxhash64(F.lit(7), "did", "crc", "size"), F.lit(bins)).cast("int"))
    points = sorted(
        (int.from_bytes(hashlib.blake2b(f"7/{s}/{v}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for v in range(vnodes)
    )
    order = list(dict.fromkeys(s for _, s in points))
    room = {s: len(rows) // shards + (k < len(rows) % shards) for k, s in enumerate(order)}
    line, waiting, want = sorted(d.collect(), key=lambda r: (r.bin, r.did, r.crc, r["size"])), [], Counter()

    def walk(r):
        at = r.bin * (2**64 // bins)
        return [s for p, s in points if p >= at] + [s for p, s in points if p < at]

    for r in line:
        s = walk(r)[0]
        if room[s]:
            room[s] -= 1
            want[(r.doc_id, r["size"], r.crc, s)] += 1
        else:
            waiting.append(r)
    for r in waiting:
        s = next(s for s in walk(r) if room[s])
        room[s] -= 1
        want[(r.doc_id, r["size"], r.crc, s)] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard) for r in out) == want


def test_shards_few_bins(docs, rows):
    check_shards(sharding.shard_ring(docs, shards=7, bins=4, vnodes=3).collect(), rows, 7)


def test_limited_movement(frame):
    d = frame([[k, f"t{k}", "en", "s"] for k in range(2000)])
    a = {r.doc_id: r.shard for r in sharding.shard_ring(d, shards=16).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard_ring(d, shards=17).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.45 * len(a)


def test_empty(empty):
    assert fingerprints.compare_with_next(empty).collect() == []
    assert mixing.mix_sizes(empty).collect() == []
    assert mixing.mix(empty).collect() == []
    assert sharding.shard_ring(empty).collect() == []
