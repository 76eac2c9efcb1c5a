"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlens.llm import spanning_tree


def brute(rows, anchors, scale, share=(30, 90), positives=5, negatives=10):
    ok = [(i, k, lab, [math.floor(scale * x) for x in v]) for i, (k, lab, v) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, k, lab, v in ok:
        if k is None or not anchors(k):
            continue
        s = [(-sum(p * q for p, q in zip(v, w)), m is None, m or 0, j, m, other) for j, m, other, w in ok if j != i and len(w) == len(v)]
        s.sort()
        for ps, _, _, _, pid, _ in [x for x in s if x[-1] == lab][:positives]:
            inside = [x for x in s if x[-1] != lab and share[0] * -ps <= 100 * -x[0] <= share[1] * -ps][:negatives]
            out += [(k, pid, n + 1, x[4], -ps, -x[0]) for n, x in enumerate(inside)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, anchors, spread", [(1 << 20, 4096, 0.1), (2000, 7, 0.1), (2000, 7, 2.0)])
def test_negatives(spark, monkeypatch, block, anchors, spread):
    monkeypatch.setattr(spanning_tree, "BLOCK_BYTES", block)
    monkeypatch.setattr(spanning_tree, "ANCHORS", anchors)
    monkeypatch.setattr(spanning_tree, "LEAST_BLOCKS", 3)
    g = np.random.default_rng(1)
    base = g.normal(size=(6, 6))
    rows = [(i, int(g.integers(0, 4)) if i % 3 else i % 6 % 4, (base[i % 6] + spread * g.normal(size=6)).astype(np.float32).astype(float).tolist()) for i in range(260)]
    rows += [rows[10], rows[20], (None, 1, rows[3][2]), (300, None, rows[3][2]), (310, 2, None), (320, 2, [None, 1.0]), (330, 1, [float("nan")] * 6), (340, 1, [float("inf")] * 6), (350, 1, [0.0] * 6), (360, 2, [0.0] * 6)]
    rows += [(400 + 10 * i, i % 2, [1.0, float(i)]) for i in range(6)] + [(500, 1, []), (501, 1, []), (502, 2, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, row int")
    got = spanning_tree.hard_negatives(df, F.col("vec_id") % 10 == 0, scale=256)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, lambda k: k % 10 == 0, 256)
    assert spanning_tree.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert spanning_tree.hard_negatives(df, F.lit(False)).collect() == []


def test_large_scores(spark):
    """Products beyond doubles are still compared exactly."""
    r = random.Random(0)
    rows = [(i, i % 3, [float(r.randrange(1 << 28, (1 << 28) + 40)) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = spanning_tree.hard_negatives(df, F.col("vec_id") % 10 == 0, share=(30, 100))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, lambda k: k % 10 == 0, 1, (30, 100))


def test_tree_and_bounds():
    """The tree is the smallest, bounds hold, are few at a time, and spare scores."""
    g = np.random.default_rng(0)
    centres = g.normal(size=(8, 16)) * 400
    a = np.rint(centres[g.integers(0, 8, 200)] + g.normal(size=(200, 16)) * 9)
    x = np.rint(centres[g.integers(0, 8, 1000)] + g.normal(size=(1000, 16)) * 60)
    order, parent, edge = spanning_tree.tree(a)
    assert sorted(order) == list(range(200)) and parent[0] == -1 and order[0] == 0
    d = np.linalg.norm(a[:, None] - a[None], axis=2)
    joined, total = {0}, 0.0
    while len(joined) < 200:  # Prim's way without the bookkeeping
        k = min(((d[i, j], j) for i in joined for j in range(200) if j not in joined))
        joined.add(k[1])
        total += k[0]
    assert abs(edge.sum() - total) < 1e-6
    place = np.empty(200, np.int64)
    place[order] = np.arange(200)
    w = spanning_tree.Walk(x, a[order], np.where(parent[order] >= 0, place[parent[order]], -1), edge[order])
    held = 0
    for at in range(200):
        true = x @ a[order][at]

        def wanted(low, high):
            assert (low <= true).all() and (true <= high).all()
            return high >= np.partition(low, 995)[995]

        some, score = w.visit(at, wanted)
        assert (score == true[some]).all() and set(np.argsort(true)[-5:]) <= set(some)
        held = max(held, len(w.bounds))
    assert held <= 9 and w.rescored < 0.5 * 200 * 1000
