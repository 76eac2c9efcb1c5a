"""Components, near-duplicate vectors and near-duplicate texts against brute force."""

import random
import re

import numpy as np
import pytest

from airlens.llm import graph, lsh_forest, queries, tile_products

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in s or "")


def reach(n, pairs):
    label = list(range(n))
    again = True
    while again:
        again = False
        for a, b in pairs:
            m = min(label[a], label[b])
            again |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_components(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(50, i) for i in range(51, 90)] + [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(3, 3)]
    r.shuffle(pairs)
    want = reach(150, pairs)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(pairs + [(None, 4)], "a long, b long")).collect()}
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {i: want[i] for i in touched}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    x, y = map(np.array, zip(*pairs))
    assert graph.forest(150, x, y).tolist() == want


def test_bounds_hold():
    x = np.random.default_rng(0).normal(size=(200, 48)) ** 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = tile_products.quantised(x)
    bound = e[:, None] + e[None] + e[:, None] * e[None]
    assert (np.abs(x @ x.T - (q * s[:, None]) @ (q * s[:, None]).T) <= bound + 1e-6).all() and np.abs(q).max() == 127


@pytest.mark.parametrize("rows, least_tiles", [(16_384, 1), (20, 3)])
def test_near_vectors(spark, monkeypatch, rows, least_tiles):
    monkeypatch.setattr(tile_products, "TILE_ROWS", rows)
    monkeypatch.setattr(tile_products, "LEAST_TILES", least_tiles)
    monkeypatch.setattr(tile_products, "STRIP", 7)
    g = np.random.default_rng(2)
    base = g.normal(size=(12, 8))
    vectors = [(base[i % 12] + g.normal(size=8) * 0.09 * (i % 7)).astype(np.float32).tolist() for i in range(90)]
    vectors += [vectors[0]] * 5 + [[x * 1e30 for x in vectors[1]], None, [], [0.0] * 8, [1.0, None], [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0], [1e-40] * 8]
    keys = list(range(len(vectors)))
    keys[3], keys[10], keys[20] = None, None, 19
    df = spark.createDataFrame([(k, v, 1) for k, v in zip(keys, vectors)], "vec_id long, embedding array<float>, kept int").repartition(3)
    out = tile_products.near_duplicates(df)
    assert out.columns == ["vec_id", "embedding", "n_links", "component_id", "kept"]
    f32 = [None if v is None or None in v else np.array(v, np.float32).astype(float) for v in vectors]
    ok = [v is not None and len(v) and np.isfinite(v).all() and (v != 0).any() for v in f32]
    pairs = [(i, j) for i in range(len(f32)) for j in range(i) if ok[i] and ok[j] and len(f32[i]) == len(f32[j]) and f32[i] @ f32[j] / np.linalg.norm(f32[i]) / np.linalg.norm(f32[j]) >= 0.95]
    label = reach(len(f32), pairs)
    low = [min((keys[j] for j in range(len(keys)) if label[j] == label[i] and keys[j] is not None), default=None) for i in range(len(keys))]
    links = [sum(i in p for p in pairs) for i in range(len(keys))]
    assert sorted(map(str, ((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()))) == sorted(map(str, ((keys[i], links[i], low[i], keys[i] == low[i]) for i in range(len(keys)))))
    assert tile_products.near_duplicates(df.limit(0)).count() == 0


def jaccard_links(texts, least=0.8):
    sets = []
    for t in texts:
        w = ALNUM.findall(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    index = {}
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    near = {(i, j) for v in index.values() if len(v) < 2000 for i in v for j in v if i < j}
    return sets, [(i, j) for i, j in near if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]


def check_near_texts(keys, texts, out, missed=0):
    sets, pairs = jaccard_links(texts)
    label = reach(len(texts), pairs)
    order = lambda k: (k is not None, k)
    for i, r in enumerate(out):
        same = [keys[j] for j in range(len(texts)) if sets[j] == sets[i] and (sets[i] or j == i)]
        assert r.class_id == min(same, key=order)
        group = [keys[j] for j in range(len(texts)) if label[j] == label[i]]
        if not missed:
            assert r.n_links == sum(i in p for p in pairs) and r.component_id == min(group, key=order), (i, r)
        assert r.kept == (r.component_id == keys[i])
    return sum(r.n_links for r in out) / max(2 * len(pairs), 1)


@pytest.mark.parametrize("rows, height", [(512, 6), (3, 12)])
def test_near_texts(spark, monkeypatch, rows, height):
    monkeypatch.setattr(lsh_forest, "BUCKET_ROWS", rows)
    monkeypatch.setattr(lsh_forest, "PAIRS", 50)
    monkeypatch.setattr(lsh_forest, "HEIGHT", height)
    monkeypatch.setattr(lsh_forest, "_MULTIPLIERS", np.random.default_rng(1).integers(1, 1 << 63, lsh_forest.TREES * height, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    r = random.Random(8)
    base = [[r.choice("abcdefghij") * r.randint(1, 4) for _ in range(120)] for _ in range(4)]
    texts = [None, "", "...", "one two", "One, two!", "one two three four five", "x " * 9000, "x " * 9000]
    for i in range(60):
        w = list(base[i % 4])
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"new{i}"
        texts.append(" ".join(w))
    texts += [texts[10], texts[11].upper(), texts[12].replace(" ", ", ")]
    keys = [None if i == 14 else i for i in range(len(texts))]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(zip(keys, texts))], "doc_id long, text string, kept long").repartition(3)
    out = lsh_forest.near_duplicates(df)
    assert out.columns == ["doc_id", "class_id", "n_links", "component_id", "kept"]
    got = {x.doc_id: x for x in out.collect()}
    assert check_near_texts(keys, texts, [got[k] for k in keys]) == 1
    assert lsh_forest.near_duplicates(df.limit(0)).count() == 0
    stay = lsh_forest.deduplicated(df.unionByName(df.filter("doc_id = 5")))
    assert stay.columns == df.columns
    assert sorted(x.kept for x in stay.collect()) == sorted(i for i, k in enumerate(keys) if got[k].kept)


def test_near_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    keys, texts = [d.doc_id for d in docs], [d.text for d in docs]
    got = {x.doc_id: x for x in queries.QUERIES["op5_lsh_forest"](spark, "/root/testdata/sf0.01").collect()}
    assert 0.995 <= check_near_texts(keys, texts, [got[k] for k in keys], missed=1) <= 1
