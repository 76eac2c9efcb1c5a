"""Each stage of the pipeline against brute force on its own input, and odd columns."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from airlens.llm import queries
from airlens.llm.shared import stored

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return ALNUM.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # a repeated row, a null text and columns named like what the operators add
    docs = docs.unionByName(docs.filter("doc_id = 3")).withColumn("row", F.lit(1)).withColumn("score", F.lit("s")).withColumn("curve", F.col("doc_id")).withColumn("drawn", F.lit("d")).withColumn("doc", F.lit("x")).withColumn("leak", F.lit(2))
    docs = stored(docs.withColumn("text", F.when(F.col("doc_id") != 5, F.col("text"))))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, sf))
        kept.append((name, before, docs.collect()))
    quality, near, clean, mixed, shards = kept
    score = {r.doc_id: r.score for r in queries.QUERIES["op3_compression_quality"](spark, sf).collect()}
    assert Counter(r.doc_id for r in quality[2] if r.doc_id not in (3, 5)) == Counter(r.doc_id for r in quality[1] if score[r.doc_id] >= 0.7 and r.doc_id not in (3, 5))
    sets = {r.doc_id: shingles(r.text) for r in near[1]}
    left = {r.doc_id for r in near[2]}
    assert len(near[2]) == len(left)
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert not any(a < b and sets[a] and sets[b] and alike(a, b) for a in left for b in left)
    assert all(any(b != a and sets[b] and alike(a, b) for b in sets) for a in sets if a not in left)
    heads = {tuple(q[k : k + min(10, len(q))]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for q in [words(r.text)] for k in range(max(len(q) - 9, 1))}
    hit = lambda t: any(tuple(words(t)[k : k + 10]) in heads for k in range(len(words(t)) - 9))
    assert {r.doc_id for r in clean[2]} == {r.doc_id for r in clean[1] if not hit(r.text)}
    assert {r.doc_id for r in mixed[2]} <= {r.doc_id for r in mixed[1]} and len(mixed[2]) > len(mixed[1]) / 4
    assert all(set(k[2][0].asDict()) == set(k[1][0].asDict()) for k in kept[:4])
    assert Counter(r.doc_id for r in shards[2]) == Counter(r.doc_id for r in shards[1])
    sizes = Counter(r.shard for r in shards[2])
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sorted(r.slot for r in shards[2] if r.shard == 0) == list(range(sizes[0]))


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(out.columns)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = out.collect()
    assert 0 < len(rows) < len(docs) and all(docs[r.doc_id] == r.text for r in rows)


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf))
        assert docs.count() == 0
