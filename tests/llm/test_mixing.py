"""Raking against the same by numpy, and the draw."""

from collections import defaultdict
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlens.llm import queries, raking


def rake(cells, targets, sweeps=200):
    w = {k: 1.0 for k in cells}
    total = sum(cells.values())
    for _ in range(sweeps):
        for d, goal in enumerate(targets):
            has, there = defaultdict(float), defaultdict(float)
            for k, n in cells.items():
                has[k[d]] += n * w[k]
                there[k[d]] += n
            whole = sum(s for v, s in goal.items() if there[v])
            for k in w:
                w[k] *= goal.get(k[d], 0) / whole * total / has[k[d]] if has[k[d]] else float(k[d] in goal)
    return w


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_raking(spark, monkeypatch, broadcast):
    monkeypatch.setattr(raking, "BROADCAST_CELLS", broadcast)
    rows = [(i % 50 if i % 9 else None, "s0" if i % 3 else f"s{i % 5}", None if i % 7 == 0 else "en" if i % 2 else "de", "w " * (i % 40), 1) for i in range(1500)]
    rows += [(1, "rare", "en", "a b", 1), (2, "banned", "en", "a b", 1), (3, "s0", "en", None, 1), (4, "s0", "en", "", 1)] + [(5, "s1", "en", "x y z", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, weight int")
    shares = spark.createDataFrame([(f"=s{i}", 0.1 + i / 10) for i in range(5)] + [("=rare", 0.01), ("=gone", 0.3), ("=banned", 0.0)], "value string, share double")
    out = raking.mixed(df, {"source": F.col("source"), "lang": F.col("lang")}, raking.token_count(F.col("text")), {"lang": 0.5}, {"source": shares})
    assert out.columns == ["doc_id", "source", "lang", "text", "tokens", "weight", "probability", "drawn"]
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r.tokens == (0 if not r.text else 1 + r.text.count(" ")) for r in got)
    cells = defaultdict(float)
    for r in got:
        cells[r.source, r.lang] += r.tokens
    langs = defaultdict(float)
    for k, n in cells.items():
        langs[k[1]] += n
    whole = sum(n**0.5 for n in langs.values())
    want = rake(cells, [{f"s{i}": 0.1 + i / 10 for i in range(5)} | {"rare": 0.01}, {k: n**0.5 / whole for k, n in langs.items()}])
    assert all(abs(r.weight - want[r.source, r.lang]) <= 2e-3 * max(want[r.source, r.lang], 1) for r in got)
    top = max(r.weight for r in got if r.tokens)
    assert all(abs(r.probability - min(1, r.weight / top)) < 1e-9 for r in got)
    assert not any(r.drawn for r in got if r.source == "banned") and 0 < sum(r.drawn for r in got) < len(got)
    assert len({(r.drawn) for r in got if r.doc_id == 5 and r.text == "x y z"}) == 1
    assert raking.mixed(df.limit(0), {"source": F.col("source")}, raking.token_count(F.col("text")), {"source": 0.5}).count() == 0


def test_margins_of_documents(spark, sf):
    rows = queries.QUERIES["op6_raking"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for d, power in queries.POWERS.items():
        had, has = defaultdict(float), defaultdict(float)
        for r in rows:
            had[r[d]] += r.tokens
            has[r[d]] += r.tokens * r.weight
        a = np.array([had[k] ** power for k in had])
        b = np.array([has[k] for k in had])
        assert np.allclose(a / a.sum(), b / b.sum(), rtol=1e-3, atol=1e-6)


def test_kept_share(spark):
    """One document of its own source takes no other document away, at two sizes."""
    rows = [(f"s{i % 3}", "en" if i % 4 else "de", "w " * (20 + i % 50)) for i in range(600)]
    for copies in (1, 20):
        df = spark.createDataFrame([(k, *r) for k in range(copies) for r in rows] + [(0, "alone", "en", "w " * 100)], "k long, source string, lang string, text string")
        report = {}
        got = queries.mix(df, report=report).collect()
        whole = sum(r.tokens for r in got)
        assert abs(sum(r.tokens * r.probability for r in got) / whole - queries.KEEP) < 1e-3
        assert all(r.probability > 0.999 for r in got if r.source == "alone")
        # the others share what the one document cannot give as their targets do
        had, has = defaultdict(float), defaultdict(float)
        for r in got:
            had[r.source] += r.tokens
            has[r.source] += r.tokens * r.probability
        goal = {k: n**0.7 for k, n in had.items() if k != "alone"}
        share = {k: n / sum(goal.values()) for k, n in goal.items()}
        assert all(abs(has[k] / (queries.KEEP * whole - had["alone"]) - share[k]) < 2e-3 for k in share)
        short = had["alone"] ** 0.7 / sum(n**0.7 for n in had.values()) - had["alone"] / (queries.KEEP * whole)
        assert abs(report["source"] - short) < 2e-3 and report["lang"] < 2e-3


def test_bounded_raking(spark):
    """Sparse cells with many at 1: kept tokens and the margins that can be met."""
    rng = np.random.default_rng(0)
    cells = [(f"={a}", f"={b}", int(10 ** rng.uniform(0, 5))) for a in range(6) for b in range(5) if rng.random() < 0.8]
    df = spark.createDataFrame(cells, "a string, b string, tokens long")
    targets = {d: raking.tempered(df, d, 0.3) for d in ("a", "b")}
    w = raking.raked(df, ["a", "b"], targets)
    out, errors = raking.budgeted(w, ["a", "b"], targets, 0.6, sweeps=20)
    got = out.collect()
    whole = sum(r.tokens for r in got)
    assert abs(sum(r.tokens * r.probability for r in got) / whole - 0.6) < 5e-3
    assert all(0 <= r.probability <= 1 for r in got) and sum(r.probability == 1 for r in got) > 1 and set(errors) == {"a", "b"}
    everything, _ = raking.budgeted(w, ["a", "b"], targets, 1.0)
    assert all(r.probability > 0.99 for r in everything.collect())


@pytest.mark.parametrize("keep", [None, 0.5, 0.9])
def test_both_ways(spark, monkeypatch, keep):
    """One task and tables give the same weights, probabilities and errors, with targets given and made."""
    r = np.random.default_rng(1)
    rows = [(f"s{int(x)}", f"l{int(y)}", "w " * int(10 ** r.uniform(0, 2.5))) for x, y in zip(r.zipf(1.6, 400) % 9, r.integers(0, 4, 400))] + [("none", "l1", ""), ("s1", None, None)]
    df = spark.createDataFrame(rows, "source string, lang string, text string")
    shares = spark.createDataFrame([("=l0", 0.2), ("=l1", 0.5), ("=l1", 0.1), ("=l2", 0.0), ("=gone", 1.0)], "value string, share double")
    out = []
    monkeypatch.setattr(raking, "TOLERANCE", 1e-2)  # both stop after the same sweep
    monkeypatch.setattr(raking, "raked", partial(raking.raked, tolerance=1e-2))
    monkeypatch.setattr(raking, "budgeted", partial(raking.budgeted, tolerance=1e-2))
    for cells in (10_000, 0):
        monkeypatch.setattr(raking, "TOGETHER_CELLS", cells)
        report = {}
        got = raking.mixed(df, {"source": F.col("source"), "lang": F.col("lang")}, raking.token_count(F.col("text")), {"source": 0.6}, {"lang": shares}, keep=keep, report=report, error="worst")
        out.append((sorted(((x.source, x.lang or "", x.text or ""), x.weight, x.probability, x.worst) for x in got.collect()), report))
    (a, ra), (b, rb) = out
    assert [x[0] for x in a] == [x[0] for x in b] and ra.keys() == rb.keys() == {"source", "lang"}
    assert np.allclose([x[1:] for x in a], [x[1:] for x in b], rtol=1e-6, atol=1e-9)
    assert all(abs(ra[k] - rb[k]) < 1e-9 for k in ra) and abs(a[0][3] - max(ra.values())) < 1e-9
