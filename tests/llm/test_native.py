"""Sharding, preference pairs, URL rules and secrets against brute force, with nulls, ties, repeats and clashing names."""

import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from airlens.llm import credentials, preferences, queries, sharding, url_rules


def test_curve_visits_neighbours(spark):
    bits, n = 3, 3
    df = spark.range(1 << (bits * n)).select(*[F.expr(f"(id >> {bits * i}) & {(1 << bits) - 1}").alias(f"x{i}") for i in range(n)])
    rows = df.withColumn("i", sharding.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).collect()
    by = {r.i: (r.x0, r.x1, r.x2) for r in rows}
    assert sorted(by) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(by[i], by[i + 1])) == 1 for i in range(511))


SHARD_SCHEMA = "doc_id long, source string, size long, curve string, row string, h long"


def test_shards_are_even_runs(spark):
    rows = [(i % 40 if i % 7 else None, None if i % 11 == 0 else f"s{i % 3 * (i % 2)}", i * i if i % 5 else None, "x", "y", 1) for i in range(203)]
    rows += [(7, "s0", 10, "x", "y", 1)] * 60
    out = sharding.hilbert_shards(spark.createDataFrame(rows, SHARD_SCHEMA), [sharding.Dimension("source"), sharding.Dimension("size", "log")], 8).collect()
    assert len(out) == 263 and set(out[0].asDict()) == {"doc_id", "source", "size", "curve", "row", "h", "shard", "slot"}
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    counts = [len(list(g)) for _, g in itertools.groupby(order, key=lambda r: r.shard)]
    assert len(counts) == 8 and max(counts) - min(counts) <= 1
    assert [r.slot for r in order] == [i for n in counts for i in range(n)]
    assert [r.curve for r in order] == sorted(r.curve for r in order)
    assert sharding.hilbert_shards(spark.createDataFrame([], SHARD_SCHEMA), [sharding.Dimension("size", "log")]).count() == 0
    few = sharding.hilbert_shards(spark.createDataFrame(rows[:3], SHARD_SCHEMA), [sharding.Dimension("size", "log")], 8).collect()
    assert sorted((r.slot) for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3


def test_op1_lays_out_every_document(spark, sf):
    out = queries.QUERIES["op1_hilbert_shards"](spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {r.shard for r in out} == set(range(8))


def test_preferences(spark):
    rows = [
        (1, "chosen", 0, "user", "q"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 5, "user", "q"), (1, "rejected", 9, "assistant", "bad"),
        (2, "chosen", 0, "user", None), (2, "chosen", 1, None, "a"), (2, "rejected", 0, "user", None), (2, "rejected", 1, None, "a"),
        (3, "chosen", 0, "user", "only"), (None, "chosen", 0, "user", "x"), (4, "other", 0, "user", "x"),
        (5, "chosen", 0, "user", "q"), (5, "rejected", 0, "user", "q"), (5, "rejected", 1, "assistant", "more"), (5, "rejected", 1, "assistant", "more"), (5, "rejected", 2, "user", ""),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "pair_id long, side string, turn long, role string, text string, prompt int")
    out = {r.pair_id: r for r in preferences.preference_pairs(df).collect()}
    assert sorted(out) == [1, 2, 3, 5]
    assert out[1].prompt == "<|user|>\nq<|end|>\n" and out[1].chosen[0].text == "<|assistant|>\ngood<|end|>\n" and out[1].rejected[0].loss
    assert out[2].prompt_turns == 2 and out[2].chosen == [] == out[2].rejected
    assert out[3].prompt == "" and [x.loss for x in out[3].chosen] == [False] and out[3].rejected == []
    assert out[5].chosen == [] and [x.loss for x in out[5].rejected] == [True, True, False]
    whole = "".join(x.text for x in out[5].rejected)
    assert [whole[x.start : x.end] for x in out[5].rejected] == ["more<|end|>\n", "more<|end|>\n", "<|end|>\n"]
    assert preferences.preference_pairs(df.limit(0)).count() == 0


def judged(url, rules):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    host = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in host)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[4]) if fit else (host, path, None, "allow")


@pytest.mark.parametrize("bound", [0, 100_000])
def test_url_rules(spark, monkeypatch, bound):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", bound)
    rules = [*queries.RULES, ("b..c", "", "block"), ("c", "/x/y", "allow"), ("b.c", "/x", "block"), ("c", "/a/b", "block")]
    urls = [None, "", "no", "://", "http://", "http://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "https://x.com/de/", "http://xcom/de/", "ftp://com/fr/?q", "http://a.b..c?/x", "http://q.b.c/x/y", "http://a.org", "http://ÀB.org/", "u://c/a/bé" + "z" * 5000] * 3
    df = spark.createDataFrame([(i % 20, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = url_rules.judged(df, spark.createDataFrame([*rules, (None, "/", "block"), rules[0]], "host string, path string, verdict string"))
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(map(str, [(r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in out.collect()])) == sorted(map(str, [(i % 20, u, *judged(u, rules)) for i, u in enumerate(urls)]))
    assert url_rules.judged(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert {r.verdict for r in url_rules.judged(df, spark.createDataFrame([], "host string, path string, verdict string")).collect()} == {"allow"}
    nameless = url_rules.judged(df, spark.createDataFrame([("", "", "block")], "host string, path string, verdict string"))
    assert {(r.url, r.rule, r.verdict) for r in nameless.filter("host = ''").collect()} == {(u, "", "block") for u in (None, "", "no", "://", "http://")}


def spans(text, reach=256):
    text = text or ""
    base = []
    for k, (kind, role, pattern, group, least) in enumerate(credentials.STRONG):
        base += [(m.start(), k, m.end(), role) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    weak = []
    for k, (kind, role, pattern, group, least) in enumerate(credentials.WEAK, len(credentials.STRONG)):
        weak += [(m.start(), k, m.end(), role) for m in re.finditer(pattern, text, re.A) if not any(b[0] < m.end() and m.start() < b[2] for b in base)]
    kept = []
    blanks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    block = lambda p: sum(b < p[0] for b in blanks)
    for w in weak:
        near = {p[3] for p in base + weak if p[0] <= w[2] + reach and p[2] >= w[0] - reach or block(p) == block(w)}
        if sum(p[3] == "id" for p in base + weak) == 1:
            near |= {p[3] for p in base + weak}
        if all(near & set(some) for some in credentials.NEEDS[credentials.ORDER[w[1]]]):
            kept.append(w)
    show = lambda l: ",".join(f"{credentials.ORDER[k]}:{a}:{b}" for a, k, b, _ in sorted(l))
    return show(base), show(base + kept)


KEY = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"


def test_secrets(spark, sf):
    texts = [
        None, "", "password=short token: abcdefgh", "token: token: abcdefghij", 'API_KEY" : "a.b=c/d+e-f_" x', "AKIA AKIAABCDEFGH1234 " + "0af" * 11, "é😀 secret = été12345678",
        f"key {KEY} alone", f"{KEY} AKIAABCDEFGH1234", f"AKIAABCDEFGH1234 {'x ' * 126}{KEY}", f"AKIAABCDEFGH1234 {'x ' * 200}{KEY}", f"ASIAABCDEFGHIJKL\nhttps://db.example.com/x {KEY}", "https://clean.example.com AKIAABCDEFGH12", "token=https://u.example.org/abc/defgh AKIAABCDEFGH1234",
        ("x" * 90 + " token = " + "ab1" * 12 + " ") * 3000, "PASSWORD='12345678'" * 50, "İpassword:12345678 secret:ſecret78",
        f"AKIAABCDEFGH1234 {'x ' * 200}{KEY}\n\nAKIAABCDEFGH9999", f"AKIAABCDEFGH1234 {'x ' * 200}\n \t\n{KEY}\n\nAKIAABCDEFGH9999 {'y ' * 300}\n\n\n{KEY}", f"AKIAABCDEFGH1234 {'x ' * 200}\n{KEY} {'z ' * 300} AIDAABCDEFGHIJKL",
    ]
    df = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts + texts[-3:])], "doc_id long, text string, secrets string")
    out = credentials.secret_spans(df)
    assert out.columns == ["doc_id", "secrets"]
    got = sorted((r.doc_id or 0, r.b, r.a) for r in out.select("doc_id", credentials.span_list(F.col("secrets"), True).alias("b"), credentials.span_list(F.col("secrets")).alias("a")).collect())
    assert got == [(i, *spans(t)) for i, t in enumerate(texts + texts[-3:])]
    assert credentials.secret_spans(df.limit(0)).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_credentials"](spark, sf).collect()
    assert len(rows) == len(docs) and all((hashlib.sha256(spans(docs[r.doc_id])[0].encode()).hexdigest(), spans(docs[r.doc_id])[1]) == (r.base_sha256, r.spans) for r in rows)


def test_secret_borders(spark):
    """A key right after '=' or before a full stop counts, one inside a longer run of its alphabet does not."""
    head = "AWS_ACCESS_KEY_ID=AKIAABCDEFGH1234\n"
    texts = [f"{head}AWS_SECRET_ACCESS_KEY={KEY}\n", f"{head}https://h.example.com/a?key={KEY}", f"{head}The key is {KEY}.", f"{head}k_{KEY}-x", f"{head}KEY={KEY}0", f"{head}KEY=/{KEY}"]
    out = credentials.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: [(s.start, s.end) for s in r.secrets if s.kind == "weak_key"] for r in out.collect()}
    assert got == {i: [(t.index(KEY), t.index(KEY) + 40)] if i < 4 else [] for i, t in enumerate(texts)}


def hilbert(point, bits):
    """Index of a point by the curve's own rule, with plain numbers."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_op1_by_brute_force(spark, sf):
    """Size, checksum, curve cell, run and slot of every document, and files that statistics leave out."""
    import math
    import zlib

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}

    def place(v, values):
        values = [x.encode() for x in values if x is not None]
        low, high = min(values), max(values)
        same = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        number = lambda x: int.from_bytes(x[same : same + 6].ljust(6, b"\0"), "big")
        return 0 if v is None else int((number(v.encode()) - number(low)) * 32.0 / (number(high) - number(low) + 1))

    sources, langs = {r.source for r in docs.values()}, {r.lang for r in docs.values()}
    rows = queries.QUERIES["op1_hilbert_shards"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        steps = [place(docs[r.doc_id].source, sources), place(docs[r.doc_id].lang, langs), max(0, min(31, math.floor(math.log2(max(len(raw) + 1, 64) / 64) * 2)))]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None) and r.curve == hilbert(steps, 5)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in order)
    runs = {k: list(g) for k, g in itertools.groupby(order, key=lambda r: r.shard)}
    assert sorted(runs) == list(range(8)) and all([r.slot for r in g] == list(range(len(g))) for g in runs.values()) and max(map(len, runs.values())) - min(map(len, runs.values())) <= 1
    # files that a reader of one source and language opens, by the smallest and largest values of each
    ends = [[(min(v), max(v)) for v in zip(*[(docs[r.doc_id].source, docs[r.doc_id].lang) for r in g])] for g in runs.values()]
    opened = [sum(all(a <= v <= b for v, (a, b) in zip(pair, e)) for e in ends) for pair in itertools.product(sources, langs)]
    assert sum(opened) / len(opened) < 6 and min(opened) <= 3, opened
