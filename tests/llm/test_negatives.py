"""Hard negatives against every score worked out in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import negatives

SCHEMA = "q string, grp int, vec_id long, embedding array<float>, label int, uid string"


def brute(rows, scale=256, positives=5, found=5, low=80, high=100):
    ok = [(i, [math.floor(scale * float(np.float32(x))) for x in v], y) for i, v, y in rows
          if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    order = lambda r: (-r[0], r[1] is not None, r[1] or 0)
    for k, (i, v, y) in enumerate(ok):
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, z == y) for n, (j, w, z) in enumerate(ok) if n != k]
        best = sorted((r for r in scored if r[2]), key=order)[:positives]
        for p, j, _ in best:
            close = sorted((r for r in scored if not r[2] and low * p <= 100 * r[0] <= high * p), key=order)[:found]
            out.update((i, j, rank, n, p, s) for rank, (s, n, _) in enumerate(close, 1))
    return out


def vectors(n, dims, seed, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(3)]
    rows = []
    for k in range(n):
        c = rng.choice(centres)
        rows.append([k * 7 % 10_007, [a + rng.gauss(0, 0.7) for a in c], rng.randrange(labels)])
    return rows


ODD = [
    [100, None, 1], [200, [1.0, 2.0], None], [300, [float("nan"), 1.0], 1], [400, [float("inf"), 1.0], 1], [500, [None, 1.0], 1],
    [600, [], 1], [700, [0.5, -0.5], 2], [800, [0.5] * 9, 1], [None, [0.4] * 9, 1], [None, [0.4] * 9, 2], [801, [0.0] * 9, 3], [-900, [0.3] * 9, 2],
]


def run(spark, rows, **more):
    data = [("x", 1, i, v, y, "u") for i, v, y in rows]
    d = spark.createDataFrame(data, SCHEMA).repartition(3)
    return Counter(map(tuple, negatives.mine(d, F.col("vec_id") % 100 == 0, **more).collect()))


@pytest.mark.parametrize("size,budget", [((1024, 256, 32), 1 << 20), ((40, 3, 4), 0)])
def test_result(spark, monkeypatch, size, budget):
    for name, value in zip(("ROWS", "ANCHORS", "CHUNK"), size, strict=True):
        monkeypatch.setattr(negatives, name, value)
    monkeypatch.setattr(negatives, "BROADCAST_BYTES", budget)  # both kinds of join
    rows = vectors(500, 9, 2)
    rows += [[100, rows[0][1], 1], [100, rows[0][1], 1]]  # an anchor that repeats an id and a row
    rows += [[5000 + k, rows[3][1], k % 3] for k in range(60)]  # ties, among them anchors
    got = run(spark, rows + ODD)
    assert got == brute(rows + ODD) and len(got) > 100


def test_parameters(spark):
    rows = vectors(200, 5, 3, labels=2)
    more = dict(scale=16, positives=2, negatives=3, low=50, high=90)
    assert run(spark, rows, **more) == brute(rows, 16, 2, 3, 50, 90)


def test_beyond_doubles(spark):
    """Scores that doubles can't hold are exact."""
    rows = [[k * 50, [2.0**19 * (1 + (k % 5) / 9), 2.0**19 / (1 + k)], k % 3] for k in range(40)]
    assert not negatives.Shape.of(2, 2**27).exact
    got = run(spark, rows)
    assert got == brute(rows) and got


def test_too_large(spark):
    with pytest.raises(ValueError):
        run(spark, [[100, [1e30], 1], [101, [1e30], 1]])
    with pytest.raises(ValueError):
        run(spark, [[100, [1.0], 1]], low=90, high=80)


def test_few(spark):
    assert not run(spark, [[100, [1.0], 1]])
    assert not run(spark, [[1, [1.0], 1], [2, [1.0], 2]])
    assert not run(spark, [])
