"""Words, suffix matches and the compression classifier against brute force and held-out labels."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from airlens.llm import compression_quality, queries, suffix_matches, words

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in s or "")


@pytest.mark.parametrize("kind, pattern", [(words.ALNUM, ALNUM), (words.SPACED, SPACED)])
def test_words(kind, pattern):
    texts = [None, "", " ", "a", "a", "Ab ab AB", "é x,y", "z" * 300, " lead", "trail ", "0-9/@[`{\x7f\x80"] * 3
    column = pa.array(texts).slice(1)
    seen = {}
    for block in (1, 7, 1 << 20):
        rows = 0
        for a, b, h, bounds in words.hashed(column, kind, block):
            rows += b - a
            for i in range(a, b):
                found = pattern.findall(low(texts[i + 1]))
                got = h[bounds[i - a] : bounds[i - a + 1]].tolist()
                assert len(found) == len(got) and all(seen.setdefault(w, x) == x for w, x in zip(found, got))
        assert rows == len(column)
    assert len(set(seen.values())) == len(seen)


def brute(text, items, window=10):
    w = ALNUM.findall(low(text))
    hit, ids = set(), set()
    for i, t in items:
        q = ALNUM.findall(low(t))
        n = min(len(q), window)
        for k in range(len(q) - n + 1) if n else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == q[k : k + n]:
                    hit |= set(range(at, at + n))
                    ids |= {str(i)} if i is not None else set()
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


@pytest.mark.parametrize("block, pairs", [(4_000_000, 1_000_000), (8, 3)])
def test_leaks(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(suffix_matches, "BLOCK_WORDS", block)
    monkeypatch.setattr(suffix_matches, "PAIRS", pairs)
    r = random.Random(3)
    text = lambda n: " ".join(r.choice("ab") for _ in range(n))
    items = [(0, text(14)), (1, text(30)), (2, "a b a"), (3, None), (4, ""), (None, text(12)), (1, text(11)), (10, "zz"), (11, text(14))]
    docs = [None, "", "b", "zz", "ZZ. zz", text(60), text(200), items[1][1], items[1][1], items[1][1][: len(items[1][1]) // 2], "x " + items[0][1].upper() + " y", "q " * 5000 + items[0][1]] + [text(25) for _ in range(20)]
    df = spark.createDataFrame([(i if i % 9 else None, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, leak int").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = suffix_matches.leaks(spark, df, bench).collect()
    assert rows[0].__fields__ == ["doc_id", "text", "leak"] and len(rows) == len(docs)
    assert sorted(map(str, ((x.doc_id, x.leak.words, x.leak.hit, len(x.leak.item_ids), hashlib.sha256(",".join(x.leak.item_ids).encode()).hexdigest()) for x in rows))) == sorted(map(str, ((i if i % 9 else None, *brute(t, items)) for i, t in enumerate(docs))))
    for x in rows:
        w = ALNUM.findall(low(x.text))
        assert sum(s.end - s.first for s in x.leak.spans) == x.leak.hit
        for m in x.leak.matches:
            ok = [q for i, t in items if str(i) == (m.item_id or "None") for q in [ALNUM.findall(low(t))] if q[m.item_at : m.item_at + m.words] == w[m.at : m.at + m.words]]
            assert ok and m.words >= min(10, len(ok[0]))
            assert any((m.at + m.words == len(w) or m.item_at + m.words == len(q) or w[m.at + m.words] != q[m.item_at + m.words]) and (not m.at or not m.item_at or w[m.at - 1] != q[m.item_at - 1]) for q in ok)
    assert suffix_matches.leaks(spark, df.limit(0), bench).count() == 0
    assert suffix_matches.leaks(spark, df, bench.limit(0)).filter("leak.hit > 0 or size(leak.item_ids) > 0").count() == 0
    clean = suffix_matches.decontaminated(spark, df, bench)
    assert clean.columns == ["doc_id", "text"] and clean.count() == sum(not brute(t, items)[1] for t in docs)


def test_op9_over_all_documents(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op9_suffix_matches"](spark, sf).collect()}
    heads = {}
    for i, t in items:
        q = ALNUM.findall(low(t))
        for k in range(max(len(q) - 9, 1)):
            heads.setdefault(tuple(q[k : k + 10]), set()).add(str(i))
    assert len(got) == len(docs) and any(r.contaminated for r in got.values())
    for d in docs:
        w = ALNUM.findall(low(d.text))
        hit, ids = np.zeros(len(w), bool), set()
        for k in range(len(w) - 9):
            if found := heads.get(tuple(w[k : k + 10])):
                hit[k : k + 10] = True
                ids |= found
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), hit.sum(), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op3_compression_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = {q: [r.predicted == q for r in rows if r.quality == q] for q in (0, 1)}
    assert all(len(v) > 20 for v in right.values())
    assert np.mean(right[1]) > 0.98 and np.mean(right[0]) > 0.9


def test_quality_of_odd_tables(spark):
    texts = [None, "", "clean words here", "!!! $$$ !!!", "long " * 50000] * 4
    docs = spark.createDataFrame([(i // 2 if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(10)] + [(None, 1, 1), (1, None, 0), (2, 7, 0), (3, 0, 0)], "doc_id long, quality int, score int")
    model = compression_quality.fit(docs, labels)
    out = compression_quality.scored(docs, model)
    assert out.columns == ["doc_id", "text", "score"] and out.count() == len(texts)
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert compression_quality.scored(docs.limit(0), model).count() == 0
    one = compression_quality.fit(docs, labels.filter("quality = 1"))
    assert {r.score for r in compression_quality.scored(docs, one).collect()} == {1.0}
    assert {r.score for r in compression_quality.scored(docs, compression_quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_op3_by_brute_force(spark, sf):
    """Scores of the query, recomputed text by text from the fitted dictionaries and weights with the compressor alone."""
    import math
    import zlib

    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = queries.quality_model(spark, sf, docs)

    def size(body, raw, data):
        kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO
        extra = {"dict_data": zstandard.ZstdCompressionDict(data, dict_type=kind)} if data else {}
        z = zstandard.ZstdCompressor(level=compression_quality.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **extra)
        step = compression_quality.BLOCK_BYTES
        return sum(len(z.compress(body[k : k + step])) for k in range(0, len(body), step)) if data is not None else len(z.compress(body))

    got = {r.doc_id: r for r in queries.QUERIES["op3_compression_quality"](spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and model.weights
    for doc_id, text in rows[::7]:
        body = (text or "").encode()
        good, bad, alone = size(body, model.raw[0], model.good), size(body, model.raw[1], model.bad), size(body, True, None)
        d, r, n = (bad - good) / (bad + good + compression_quality.SHRINK), alone / (len(body) + compression_quality.SHRINK), math.log1p(len(body))
        z = sum(w * x for w, x in zip(model.weights, (10 * d, 5 * r, 20 * d * r, 5 * r * r, n / 5, n * r, 1)))
        want = 1 / (1 + math.exp(-max(-500, min(500, z))))
        assert abs(got[doc_id].score - want) < 1e-9 and got[doc_id].predicted == (got[doc_id].score >= 0.7) and got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
