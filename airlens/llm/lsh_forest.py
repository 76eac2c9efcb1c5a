"""Near-duplicate texts: Jaccard similarity of their sets of five-word shingles, found by a MinHash LSH forest.

Texts with equal shingle sets are one class. A class has TREES signatures of HEIGHT MinHash values; a tree is the trie of
its signatures, held as buckets of equal prefixes. The join begins with whole signatures and shortens the prefixes of
all trees by one value at a time until the recall, estimated from the similarities found so far (a pair of similarity s
is met with probability 1 - (1 - s**depth)**TREES), reaches the target.

Pairs never leave a task. A pair belongs to the first tree in which it meets, so it is looked at once: a first pass
over signatures alone tells which members of a bucket have such a pair, a second pass brings the shingle sets of
those members and verifies exactly. A task returns per class the documents it is linked with and one edge to the
smallest class it reaches there. A bucket above BUCKET_ROWS members is cut into tiles, two of which meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm import words
from airlens.llm.graph import components, forest, pairs_in_groups, whole_groups
from airlens.llm.shared import computed, small_batches, stored

c = F.col
WORDS = 5
TREES = 24
HEIGHT = 6
LEAST_DEPTH = 2
BUCKET_ROWS = 512
#: bits of the filter of classes whose sets are needed: a fixed size, and a wrong hit only costs time
FILTER_BITS = 26
#: pairs looked at together, and shingles hashed together
PAIRS = 40_000
SLICE = 4096
BINS = 20
_MULTIPLIERS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, TREES * HEIGHT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text; fewer words than a shingle are one shingle, no words none."""
    for _, _, h, bounds in words.hashed(texts):
        g, ends = words.grams(h, bounds, WORDS)
        for i in range(len(bounds) - 1):
            n = bounds[i + 1] - bounds[i]
            if n >= WORDS or not n:
                yield np.unique(g[ends[i] : ends[i + 1]])
            else:
                yield words.mix(words.grams(h[bounds[i] : bounds[i + 1]], np.array([0, n]), int(n))[0] + np.uint64(n))


def _set_key(s: np.ndarray) -> tuple[int, int]:
    a, b = words.mix(s).sum(dtype=np.uint64), words.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    k = words.mix(np.array([a, b], np.uint64) + np.uint64(len(s))).view(np.int64)
    return int(k[0]), int(k[1])


def _signature(s: np.ndarray) -> bytes:
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), SLICE):
        np.minimum(least, (_MULTIPLIERS[:, None] * s[None, k : k + SLICE]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).tobytes()


def _sign():
    def run(texts: pa.Array) -> list[pa.Array]:
        k1, k2, signatures = [], [], []
        for s in _sets(texts):
            a, b = _set_key(s) if len(s) else (None, None)
            k1.append(a)
            k2.append(b)
            signatures.append(_signature(s) if len(s) else None)
        return [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(signatures, pa.binary())]

    return run


def _buckets(signatures: pa.Array | pa.ChunkedArray, depth: int) -> np.ndarray:
    """Hash of the first `depth` values in every tree."""
    v = np.frombuffer(b"".join(signatures.to_pylist()), np.uint32).reshape(len(signatures), TREES, HEIGHT).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(HEIGHT + depth), v.shape[:2]).copy()
    for k in range(depth):
        h = words.mix(h * np.uint64(0x9E3779B97F4A7C15) + v[:, :, k])
    return h.view(np.int64)


def _memberships(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = _buckets(b.column(1), depth)
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), TREES))], ["b", "id"])

    return run


def _fresh(t: pa.Table, bounds: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of a bucket that meet in no earlier tree, nor in any at a greater depth."""
    b, tile = t.column("b").to_numpy(), t.column("tile").to_numpy()
    crossed = t.column("i").to_numpy() != t.column("j").to_numpy()
    h = _buckets(t.column("sig"), depth)
    deeper = _buckets(t.column("sig"), depth + 1) if depth < HEIGHT else None
    for x, y in pairs_in_groups(bounds, PAIRS):
        if crossed.any():
            ok = ~crossed[x] | (tile[x] != tile[y])
            x, y = x[ok], y[ok]
        first = (h[x] == h[y]).argmax(axis=1)
        ok = h[x, first] == b[x]
        if deeper is not None:
            ok &= ~(deeper[x] == deeper[y]).any(axis=1)
        yield x[ok], y[ok]


def _needed(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, 3, 20_000):
            used = np.zeros(t.num_rows, bool)
            for x, y in _fresh(t, bounds, depth):
                used[x] = used[y] = True
            if used.any():
                yield from t.select(["b", "i", "j", "tile", "id"]).filter(pa.array(used)).combine_chunks().to_batches()

    return run


def _wanted_sets(bits: np.ndarray):
    mask = (1 << FILTER_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for batch in batches:
            k1, k2, sets = [], [], []
            for s in _sets(batch.column(0)):
                if not len(s):
                    continue
                key = _set_key(s)
                at = key[0] & mask
                if (int(bits[at >> 6]) >> (at & 63)) & 1 and key not in given:
                    given.add(key)
                    k1.append(key[0])
                    k2.append(key[1])
                    sets.append(s.tobytes())
            if k1:
                yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sets, pa.binary())], ["k1", "k2", "set"])

    return run


def _common(x: np.ndarray, y: np.ndarray, sets: list[np.ndarray], size: int) -> np.ndarray:
    """Shingles that the pairs (ordered by x) have in common; sets hold numbers below size."""
    out = np.zeros(len(x), np.int64)
    flag = np.zeros(size, np.int64)
    edge = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]]) if len(x) else []
    for s, e in zip(edge[:-1], edge[1:]):
        own = sets[x[s]]
        flag[own] = 1
        near = [sets[k] for k in y[s:e]]
        starts = np.concatenate([[0], np.cumsum([len(k) for k in near[:-1]])]).astype(np.int64)
        out[s:e] = np.add.reduceat(flag[np.concatenate(near)], starts)
        flag[own] = 0
    return out


def _verified(depth: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, 3, 2_000):
            n, ids, weight = t.num_rows, t.column("id").to_numpy(), t.column("n").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
            length = np.array([len(s) for s in sets])
            every, number = np.unique(np.concatenate(sets), return_inverse=True)
            local = np.split(number, np.cumsum(length)[:-1])
            links, hist, label = np.zeros(n, np.int64), np.zeros((n, BINS), np.int64), np.arange(n)
            for x, y in _fresh(t, bounds, depth):
                both = _common(x, y, local, len(every))
                alike = both / (length[x] + length[y] - both)
                ok = alike >= least
                x, y, alike = x[ok], y[ok], alike[ok]
                links += np.bincount(x, weight[y], n).astype(np.int64) + np.bincount(y, weight[x], n).astype(np.int64)
                np.add.at(hist, (x, np.minimum((alike - least) / (1 - least + 1e-9) * BINS, BINS - 1).astype(int)), 1)
                label = forest(n, x, y, label)
            some = np.flatnonzero(links)
            if len(some):
                found = pa.ListArray.from_arrays(np.arange(0, len(some) * BINS + 1, BINS, dtype=np.int32), pa.array(hist[some].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[label[some]]), found], ["id", "links", "root", "hist"])

    return run


def _round(docs: DataFrame, text: str, classes: DataFrame, depth: int, least: float) -> DataFrame:
    """(id, links, root, hist) of the pairs that meet at this depth and at no greater one."""
    members = classes.select("id", "sig").mapInArrow(_memberships(depth), "b long, id long")
    counts = members.groupBy("b").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    tiles = F.expr(f"(m + {BUCKET_ROWS - 1}) div {BUCKET_ROWS}")
    cells = members.join(counts, "b").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("id"), c("tiles")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), (c("tiles") - 1).cast("int"))))
    cells = cells.select("b", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id")
    by_cell = ["b", "i", "j"]
    signed = cells.join(classes.select("id", "sig"), "id").select("b", "i", "j", "tile", "id", "sig")
    needed = stored(signed.repartition(*by_cell).sortWithinPartitions(*by_cell).mapInArrow(_needed(depth), "b long, i int, j int, tile int, id long"))
    wanted = needed.select("id").distinct().join(classes.select("id", "k1", "k2", "n", "sig"), "id")
    place = c("k1").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    # at most 2**(FILTER_BITS - 6) rows
    for r in wanted.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        bits[r.at] = r.bits & 0xFFFFFFFFFFFFFFFF
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _wanted_sets(shared.value)(batches)

    sets = docs.select(c(f"`{text}`")).mapInArrow(with_sets, "k1 long, k2 long, set binary").groupBy("k1", "k2").agg(F.first("set").alias("set"))
    full = needed.join(wanted.join(sets, ["k1", "k2"]).select("id", "n", "sig", "set"), "id")
    return stored(full.repartition(*by_cell).sortWithinPartitions(*by_cell).select("b", "i", "j", "tile", "id", "n", "sig", "set").mapInArrow(_verified(depth, least), "id long, links long, root long, hist array<long>"))


def met(similarity: float, depth: int) -> float:
    """Probability that a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One row per document: its key, class_id, n_links, component_id, kept.

    class_id: the smallest key among texts with the same shingle set; n_links: other documents with a similarity of
    `least` or more, those of the own class included; component_id: the smallest key reached by links; kept: whether
    that is the own key. Words are runs of [0-9A-Za-z] and characters outside ASCII, case of A-Z ignored. A text with
    fewer than five words is one shingle of all its words; null and empty texts have no links and stay. Nulls sort
    before other keys; repeated rows are documents of their own with equal results; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = stored(computed(docs, text, [key], "k1 long, k2 long, sig binary", _sign)).withColumnRenamed(key, "key")
    classes = rows.filter("k1 is not null").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key"))["key"].alias("low"), F.first("sig").alias("sig"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()))
    found, total, depth = None, np.zeros(BINS), HEIGHT
    while True:
        now = _round(docs, text, classes, depth, least)
        hist = now.agg(*[F.coalesce(F.sum(F.get("hist", F.lit(k))), F.lit(0)) for k in range(BINS)]).first()
        total += np.array(hist, float)
        found = now if found is None else found.unionByName(now)
        expected = sum(n / met(least + (1 - least) * k / BINS, depth) for k, n in enumerate(total))
        if depth == LEAST_DEPTH or not expected or total.sum() / expected >= recall:
            break
        depth -= 1
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.select(c("id").alias("a"), c("root").alias("b"))).withColumnRenamed("node", "id")
    part = classes.select("id", "k1", "k2", "n", "low").join(links, "id", "left").join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lows = part.groupBy("component").agg(F.min(F.struct("low"))["low"].alias("component_id"))
    known = part.join(lows, "component").select("k1", "k2", c("low").alias("class_id"), (c("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("in_class"))
    out = rows.select("key", "k1", "k2").join(known, ["k1", "k2"], "left")

    def own(name: str):
        return F.when(c("in_class"), c(name)).otherwise(c("key"))

    out = out.select("key", own("class_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own("component_id").alias("component_id"))
    return out.withColumn("kept", c("key").eqNullSafe(c("component_id"))).withColumnRenamed("key", key)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """The documents, with all their columns, of which one of each group of near-duplicates stays: the one with the
    smallest key, then the smallest hash of the row; of equal rows one. Documents without words all stay."""
    names = docs.columns
    every = F.struct(*[c(f"`{n}`") for n in names])
    kept_row = F.struct(c(f"`{key}`").alias("key"), F.xxhash64(F.lit(1), every).alias("r1"), F.xxhash64(F.lit(2), every).alias("r2"))
    keyed = docs.select(kept_row.alias("_key"), c(f"`{text}`").alias("_body"))
    gone = near_duplicates(keyed, "_key", "_body", least).filter("not kept").select(c("_key.r1").alias("_r1"), c("_key.r2").alias("_r2")).distinct()
    out = docs.withColumn("_r1", F.xxhash64(F.lit(1), every)).withColumn("_r2", F.xxhash64(F.lit(2), every))
    wordless = ~F.coalesce(c(f"`{text}`"), F.lit("")).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
    once = out.filter(~wordless).join(gone, ["_r1", "_r2"], "left_anti").dropDuplicates(["_r1", "_r2"])
    return once.unionByName(out.filter(wordless)).select(*[c(f"`{n}`") for n in names])
