"""Spelling variants against every pair of words, and the counting of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from airlens.llm import queries, spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    form, links = {}, {}
    for w, n in counts.items():
        met = [v for v in counts if v != w and near(v, w)]
        links[w] = len(met)
        best = min(met, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, links[w], counts.get(form[w])) for w, n in counts.items()}


def counted(rows, noise=97):
    n = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % noise == 0 else run] += 1
    return dict(n)


@pytest.mark.parametrize("part", [100_000, 40])
def test_variants(spark, monkeypatch, part):
    monkeypatch.setattr(spelling, "PART_WORDS", part)
    r = random.Random(3)
    words = {"".join(r.choice("aabéz\U0001f600") for _ in range(r.randint(1, 6))) for _ in range(700)} | {"a" * k for k in range(1, 9)} | {"x" * 3000, "x" * 2999 + "y", "x" * 2999}
    counts = {w: int(2 ** r.uniform(0, 12)) for w in words}
    df = spark.createDataFrame([*counts.items(), (None, 5), ("", 9)], "word string, n long")
    assert {tuple(x) for x in spelling.variants(df).collect()} == brute(counts)
    assert spelling.variants(df.limit(0)).collect() == []


def test_word_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 20)
    monkeypatch.setattr(spelling, "HELD_RUNS", 7)
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["Straße", "straße", "naïve", "a", "ÉtÉ", "xćy", "w一w", "Q1q", "×÷", "VERYlong" * 9, "don't"]) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(None, "Word word wOrd"), (7, None), (7, ""), (7, rows[7][1]), (9, "z" * 100_000)]
    df = spark.createDataFrame([(7.5, *x) for x in rows], "word double, doc_id long, text string")
    for noise in (97, 3):
        got = {x.word: x.n for x in spelling.word_counts(df, noise=noise).collect()}
        assert got == counted(rows, noise)
    assert spelling.word_counts(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts = {w: n for w, n in counted(rows).items() if len(w) >= 5 and n >= 3}
    got = queries.QUERIES["op11_spelling_variants"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(x) for x in got.collect()} == brute(counts)
