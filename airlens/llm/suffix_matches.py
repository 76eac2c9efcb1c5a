"""Benchmark passages in a training corpus by suffix arrays.

The corpus is cut into shards, the text blocks of its partitions. A shard's suffix array holds, in the order of their
next words, the word positions at which a benchmark window could begin: as many words as the shortest window that all
occur in the benchmark, inside one document. Every benchmark suffix is binary-searched in every shard; a range of equal
heads gives all places of its window, and those that don't continue a match to the left are followed word by word to
the longest verbatim match. A document lies in one shard, so the result needs no shuffle; the benchmark is sent out in
blocks of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.llm import words
from airlens.llm.shared import computed, stored

#: words of a benchmark block (8 bytes each) that every executor gets at once
BLOCK_WORDS = 4_000_000
#: bytes of text in a shard: every benchmark suffix is searched once in each
SHARD_BYTES = 4 << 20
#: pairs of benchmark suffix and place that are looked at together
PAIRS = 1_000_000
FOUND = "_found struct<words: bigint, hit: bigint, item_ids: array<string>, matches: array<struct<item_id: string, item_at: bigint, at: bigint, words: bigint>>, spans: array<struct<first: bigint, end: bigint>>>"


@dataclass
class Block:
    """Items' words as ids by the sorted vocabulary, one item after the other; and for each position that begins a
    window how many words the window has."""

    vocabulary: np.ndarray
    ids: np.ndarray
    item: np.ndarray
    bounds: np.ndarray
    at: np.ndarray
    span: np.ndarray
    keys: np.ndarray
    shortest: int


def block_of(texts: list[str | None], window: int) -> Block:
    parts = list(words.hashed(pa.array(texts, pa.large_string())))
    h = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([np.diff(p[3]) for p in parts]) if parts else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    vocabulary = np.unique(h)
    ids = (np.searchsorted(vocabulary, h) + 1).astype(np.uint32)
    item = np.repeat(np.arange(len(counts)), counts)
    span = np.minimum(counts, window)[item]
    at = np.flatnonzero(np.arange(len(h)) + span <= bounds[item + 1])
    span = span[at]
    keys = _heads(ids, at, span, window)
    return Block(vocabulary, ids, item, bounds, at, span, keys, int(span.min()) if len(span) else 0)


def _heads(ids: np.ndarray, at: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """The next `length` words (at most a window) of the positions as byte strings that sort like the words."""
    k = np.arange(window)
    taken = np.minimum(at[:, None] + k, max(len(ids) - 1, 0))
    w = np.where(k < length[:, None], ids[taken] if len(ids) else 0, 0).astype(">u4")
    return np.ascontiguousarray(w).view(f"S{4 * window}").ravel()


def _shard(h: np.ndarray, bounds: np.ndarray, b: Block, window: int) -> tuple[np.ndarray, ...]:
    """Matches of one shard: covered word flags; (document, item) pairs; longest matches (document, item, item_at, at, words)."""
    n = len(h)
    none = np.zeros(0, np.int64)
    covered = np.zeros(n + 1, np.int64)
    if not n or not len(b.at):
        return covered[:n] > 0, np.stack([none, none]), np.stack([none] * 5)
    slot = np.minimum(np.searchsorted(b.vocabulary, h), len(b.vocabulary) - 1)
    ids = np.where(b.vocabulary[slot] == h, slot + 1, 0).astype(np.uint32)
    # how many words of the benchmark follow in the same document
    zero = np.append(np.flatnonzero(ids == 0), n)
    next_zero = np.repeat(zero, np.diff(zero, prepend=-1))[:n]
    long = np.minimum(next_zero, np.repeat(bounds[1:], np.diff(bounds))) - np.arange(n)
    place = np.flatnonzero(long >= b.shortest)
    if not len(place):
        return covered[:n] > 0, np.stack([none, none]), np.stack([none] * 5)
    heads = _heads(ids, place, np.minimum(long[place], window), window)
    order = np.argsort(heads, kind="stable")
    heads, place = heads[order], place[order]  # the suffix array
    low = np.searchsorted(heads, b.keys, "left")
    high = np.searchsorted(heads, b.keys, "right")
    for w in np.unique(b.span[b.span < window]).tolist():  # a shorter window: all heads that begin with it
        short = b.span == w
        cut = heads.astype(f"S{4 * w}")
        low[short] = np.searchsorted(cut, b.keys[short].astype(f"S{4 * w}"), "left")
        high[short] = np.searchsorted(cut, b.keys[short].astype(f"S{4 * w}"), "right")
    many = high - low
    pairs, longest = [np.stack([none, none])], [np.stack([none] * 5)]
    some = np.flatnonzero(many)
    ends = np.cumsum(many[some])
    first = 0
    while first < len(some):
        # a few suffixes at a time, and one with very many places in parts
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        for lo in range(int(low[some[first]]), int(high[some[first]]), PAIRS) if last == first + 1 else (None,):
            s = some[first:last]
            if lo is None:
                t = np.repeat(s, many[s])
                p = place[np.repeat(low[s], many[s]) + np.arange(len(t)) - np.repeat(np.cumsum(many[s]) - many[s], many[s])]
            else:
                p = place[lo : min(lo + PAIRS, int(high[s[0]]))]
                t = np.full(len(p), s[0])
            doc = np.searchsorted(bounds, p, "right") - 1
            covered += np.bincount(p, minlength=n + 1) - np.bincount(p + b.span[t], minlength=n + 1)
            q, item = b.at[t], b.item[b.at[t]]
            pairs.append(np.unique(np.stack([doc, item]), axis=1))
            left = (p > bounds[doc]) & (q > b.bounds[item])
            left[left] = ids[p[left] - 1] == b.ids[q[left] - 1]
            p, q, doc, item, size = p[~left], q[~left], doc[~left], item[~left], b.span[t[~left]].astype(np.int64)
            room = np.minimum(bounds[doc + 1] - p, b.bounds[item + 1] - q)
            going = np.flatnonzero(size < room)
            while len(going):
                going = going[ids[p[going] + size[going]] == b.ids[q[going] + size[going]]]
                size[going] += 1
                going = going[size[going] < room[going]]
            longest.append(np.stack([doc, item, q - b.bounds[item], p - bounds[doc], size]))
        first = last
    return np.cumsum(covered[:n]) > 0, np.unique(np.concatenate(pairs, axis=1), axis=1), np.concatenate(longest, axis=1)


def _lists(rows: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)


def _shards(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and text bounds of consecutive blocks that make up a shard."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for _, end, h, bounds in words.hashed(texts):
        parts.append((h, bounds))
        if len(parts) * words.BLOCK >= SHARD_BYTES or end == len(texts):
            counts = np.concatenate([np.diff(b) for _, b in parts])
            yield np.concatenate([x for x, _ in parts]), np.concatenate([[0], np.cumsum(counts)])
            parts = []


def _searcher(block: Block, item_ids: list[str | None], window: int):
    named = pa.array(item_ids, pa.string())

    def found(texts: pa.Array) -> list[pa.Array]:
        out = []
        for h, bounds in _shards(texts):
            n = len(bounds) - 1
            covered, pairs, longest = _shard(h, bounds, block, window)
            # covered runs end at document borders
            edge = np.diff(np.concatenate([[0], covered, [0]]).astype(np.int8))
            border = bounds[1:-1]
            border = np.unique(border[(border > 0) & (border < len(h))])
            border = border[covered[border] & covered[border - 1]]
            a, e = np.union1d(np.flatnonzero(edge > 0), border), np.union1d(np.flatnonzero(edge < 0), border)
            doc = np.searchsorted(bounds, a, "right") - 1
            hit = np.bincount(doc, weights=e - a, minlength=n).astype(np.int64)
            longest = longest[:, np.lexsort((longest[1], longest[3], longest[0]))]

            def by_doc(of: np.ndarray, values: pa.Array, n: int = n) -> pa.Array:
                return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32), values)

            def struct(**columns) -> pa.Array:
                return pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)) for x in columns.values()], list(columns))

            items = by_doc(pairs[0], named.take(pa.array(pairs[1])))
            matches = by_doc(longest[0], struct(item_id=named.take(pa.array(longest[1])), item_at=longest[2], at=longest[3], words=longest[4]))
            spans = by_doc(doc, struct(first=a - bounds[doc], end=e - bounds[doc]))
            out.append(struct(words=np.diff(bounds), hit=hit, item_ids=items, matches=matches, spans=spans))
        return [pa.concat_arrays(out)]

    return found


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[tuple[Block, list[str | None]]]:
    """The benchmark's rows in blocks: one block at a time is on the driver. An empty benchmark is one empty block."""
    held: list = []
    size = given = 0
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        held.append(r)
        size += len(r.t or "") // 4 + 1
        if size >= BLOCK_WORDS:
            yield block_of([r.t for r in held], window), [r.i for r in held]
            held, size, given = [], 0, 1
    if held or not given:
        yield block_of([r.t for r in held], window), [r.i for r in held]


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", item_text: str = "text", window: int = 10, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of all documents (default: all) with `leak`.

    leak.words: words of the document; hit: words inside any occurrence of a window (`window` consecutive words of an
    item, or a whole shorter item); item_ids: the items with such a window, sorted as strings; matches: the longest
    verbatim matches (item_id, item_at, at, words; positions and lengths in words); spans: the covered word runs.
    Words are maximal runs of [0-9A-Za-z] and characters outside ASCII, A-Z taken as a-z. A null or empty text has no
    words; items without words or with a null id are matched but not listed; ids of repeated items are listed once;
    repeated rows are judged alike; a column named leak is replaced.
    """
    names = [k for k in (docs.columns if keep is None else keep) if k.lower() != "leak"]
    out = docs
    result = None
    for block in _blocks(benchmark, item, item_text, window):
        shared = spark.sparkContext.broadcast(block)
        carried = names if text in names or text.partition(".")[0] in names else [*names, text]
        if result is not None:
            out = stored(result)
            carried = [*carried, "_leak"]

        def setup(shared=shared):
            return _searcher(*shared.value, window)

        found = computed(out, text, carried, FOUND, setup)
        result = found.withColumnRenamed("_found", "_leak") if result is None else _joined(found)
    ids = F.array_sort(F.array_distinct(F.array_compact(F.col("_leak.item_ids"))))
    return result.select(*[F.col(f"`{k}`") for k in names], F.struct(F.col("_leak.words").alias("words"), F.col("_leak.hit").alias("hit"), ids.alias("item_ids"), F.col("_leak.matches").alias("matches"), F.col("_leak.spans").alias("spans")).alias("leak"))


def _joined(found: DataFrame) -> DataFrame:
    """What earlier blocks and this one found: lists appended, covered runs merged."""
    a, b = F.col("_leak"), F.col("_found")
    runs = F.array_sort(F.concat(a["spans"], b["spans"]))
    empty = F.expr("cast(array() as array<struct<first:bigint,end:bigint>>)")

    def merge(s, x):
        top = F.element_at(s, -1)
        longer = F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(top["first"].alias("first"), F.greatest(top["end"], x["end"]).alias("end"))))
        return F.when(F.size(s) == 0, F.array(x)).when(x["first"] > F.element_at(s, -1)["end"], F.concat(s, F.array(x))).otherwise(longer)

    spans = F.aggregate(runs, empty, merge)
    with_spans = found.withColumn("_spans", spans)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])
    both = F.struct(a["words"].alias("words"), hit.alias("hit"), F.concat(a["item_ids"], b["item_ids"]).alias("item_ids"), F.concat(a["matches"], b["matches"]).alias("matches"), F.col("_spans").alias("spans"))
    return with_spans.withColumn("_leak", both).drop("_found", "_spans")


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark window."""
    found = leaks(spark, docs, benchmark, **how)
    return found.filter("leak.hit = 0").drop("leak")
