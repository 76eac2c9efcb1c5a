"""The language model against one of dictionaries, and that its probabilities sum to 1."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from airlens.llm import kneser_ney, queries

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return SPACED.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")) + ["</s>"]


def discounts(counts):
    n = Counter(min(k, 5) for k in counts)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k, 0.1), k) for k in (1, 2, 3)]


class Plain:
    def __init__(self, texts):
        two = Counter()
        for t in texts:
            w = tokens(t)
            two.update(zip(["<s>"] + w[:-1], w))
        self.two, self.one = two, Counter(w for t in texts for w in tokens(t))
        self.next, self.after = defaultdict(list), Counter(w for _, w in two)
        for (h, _), n in two.items():
            self.next[h].append(n)
        self.d, self.e = discounts(two.values()), discounts(self.after.values())
        self.v, self.n = len(self.one), sum(self.one.values())
        self.left = sum(self.e[min(n, 3) - 1] for n in self.after.values()) / len(two) if two else 1

    def lower(self, w):
        n = self.after[w]
        return (max(n - self.e[min(n, 3) - 1], 0) / len(self.two) if n else 0) + self.left / (self.v + 1)

    def p(self, h, w):
        follows = self.next.get(h)
        if not follows:
            return self.lower(w)
        n, total = self.two[h, w], sum(follows)
        return (max(n - self.d[min(n, 3) - 1], 0) / total if n else 0) + sum(self.d[min(k, 3) - 1] for k in follows) / total * self.lower(w)

    def score(self, t):
        w = tokens(t)
        base = sum(math.log10((self.one[x] + 0.1) / (self.n + 0.1 * (self.v + 1))) for x in w)
        return len(w), sum(self.one[x] > 0 for x in w), base, sum(math.log10(self.p(h, x)) for h, x in zip(["<s>"] + w[:-1], w))


def same(got, want):
    return got[:2] == want[:2] and np.allclose(got[2:], want[2:], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("block", [3, 1_500_000])
def test_model(spark, monkeypatch, block):
    monkeypatch.setattr(kneser_ney, "BLOCK_TOKENS", block)
    texts = [None, "", "  \n", "a b a b c", "A B a", "a b a b c", "the the the", "x\ty z é", "long " * 20000, "b c d a"] * 2
    df = spark.createDataFrame([(i // 2 if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int").repartition(3)
    model = kneser_ney.fit(spark, df)
    plain = Plain(texts)
    assert (model.tokens, model.vocabulary) == (plain.n, plain.v)
    more = spark.createDataFrame([(100, "new words b a c zz", 1), (101, "c", 0)], df.schema)
    out = kneser_ney.scored(df.unionByName(more), model)
    assert out.columns == ["doc_id", "text", "n_tokens", "n_known", "base_score", "score"]
    rows = out.collect()
    assert len(rows) == len(texts) + 2 and all(same(tuple(r)[2:], plain.score(r.text)) for r in rows)
    for h in ("<s>", "a", "the", "never"):
        assert abs(sum(plain.p(h, w) for w in [*plain.one, "unknown"]) - 1) < 1e-9
    assert kneser_ney.scored(df.limit(0), model).count() == 0
    nothing = kneser_ney.scored(df, kneser_ney.fit(spark, df.limit(0))).collect()
    assert all(same(tuple(r)[2:], (len(tokens(r.text)), 0, 0.0, 0.0)) for r in nothing)


def test_op7_over_all_documents(spark, sf):
    import zlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 10 == 0 for d in docs}
    plain = Plain([d.text for d in docs if not held[d.doc_id]])
    got = {r.doc_id: r for r in queries.QUERIES["op7_kneser_ney"](spark, sf).collect()}
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == held[d.doc_id] and r.train_tokens == plain.n
        assert same((r.n_tokens, r.n_known, r.base_score, r.score), plain.score(d.text))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
