"""Connected components of an edge table, and pieces of pair work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm.shared import stored

c = F.col


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = e.unionByName(e.select(c("b").alias("a"), c("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(c("b").alias("a"), c("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").filter("b <> m").select(c("b").alias("a"), c("m").alias("b"))
    return least.select("a", c("m").alias("b")).unionByName(rest).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> node, component: the smallest node that can be reached; nodes without an edge have no row.

    Large and small stars by turns until the edges stay as they are: the rounds grow with the logarithm of the longest
    path. Each round's edges are written to the shared folder; the largest neighbourhood is aggregated before it is
    shuffled and joined, so the engine can split it. Loops, repeated edges and nulls are ignored.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(e)
    while before[0]:
        e = stored(_small_star(_large_star(e)))
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(c("a").alias("node"), c("b").alias("component")).unionByName(e.select(c("b").alias("node"), c("b").alias("component")).distinct())


def forest(n: int, x: np.ndarray, y: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each of n indices reaches by pairs (x, y), on top of an earlier result."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[x], label[y]
        if (a == b).all():
            return label
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups (equal first `keys` columns) of about `rows` rows, with group bounds."""
    held: list[pa.RecordBatch] = []
    count = 0

    def cut(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows - 1, bool)
        for k in range(keys):
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count >= rows:
            t = pa.Table.from_batches(held)
            bounds = cut(t)
            last = int(bounds[-2])
            if last:
                yield t.slice(0, last), bounds[:-1]
            held = t.slice(last).combine_chunks().to_batches()
            count = t.num_rows - last
    if held:
        t = pa.Table.from_batches(held)
        yield t, cut(t)


def pairs_in_groups(bounds: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs x < y inside groups, at most about `most` at a time."""
    size = np.repeat(np.diff(bounds), np.diff(bounds))
    end = np.repeat(bounds[1:], np.diff(bounds))
    after = end - np.arange(len(size)) - 1  # partners of each index
    total = np.cumsum(after)
    first = 0
    while first < len(after):
        base = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, base + most, "right")))
        n = after[first:last]
        x = np.repeat(np.arange(first, last), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        yield x, y
        first = last
