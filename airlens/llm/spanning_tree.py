"""Hard negatives by score bounds along spanning trees of the anchors.

Anchors are dealt to blocks and joined by a minimum spanning tree in each. The score of a candidate x with a child
anchor differs from its score with the parent by at most the length of their edge times the length of x, so a walk from
the root bounds all scores; only candidates whose bounds overlap what is asked for are scored again, exactly, and their
bounds close. Two passes: the first finds the best rows of the anchor's own label (those that may reach the fifth), the
second the best rows of other labels inside the windows that these positives open. Candidates are dealt to blocks too; a
task holds one block of either, and returns at most a few rows an anchor and window, which are ranked after a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from airlens.llm.shared import stored

c = F.col
#: bytes of the vectors (as doubles) of a block of candidates, and blocks at least; anchors of a block
BLOCK_BYTES = 16 << 20
LEAST_BLOCKS = 8
ANCHORS = 4096
#: sums of products below this are exact in doubles
EXACT = float(1 << 53)


# Inside a task --------------------------------------------------------------------------------------------------------


def tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree of vectors with vector 0 as its root: an order in which every vector comes after its
    parent and the largest branch of a vector last, each one's parent (-1: none) and the length of the edge to it."""
    n = len(x)
    grown, parent, edge = [], np.full(n, -1, np.int64), np.zeros(n)
    near, best, out = np.zeros(n, np.int64), np.full(n, np.inf), np.ones(n, bool)
    at = 0
    for k in range(n):
        grown.append(at)
        out[at] = False
        d = np.linalg.norm(x - x[at], axis=1)
        closer = out & (d < best)
        best[closer], near[closer] = d[closer], at
        if k + 1 < n:
            left = np.flatnonzero(out)
            at = int(left[np.argmin(best[left])])
            parent[at], edge[at] = near[at], best[at]
    size, children = np.ones(n, np.int64), [[] for _ in range(n)]
    for i in reversed(grown[1:]):
        size[parent[i]] += size[i]
        children[parent[i]].append(i)
    order, waiting = [], [0] if n else []
    while waiting:
        order.append(waiting.pop())
        waiting += sorted(children[order[-1]], key=lambda i: -size[i])
    return np.array(order, np.int64), parent, edge


def _scores(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: beyond doubles by Python's numbers, as an object array."""
    if not len(x) or not x.shape[1] or float(np.abs(x).max()) * float(np.abs(a).max()) * x.shape[1] < EXACT:
        return x @ a
    return np.array([sum(int(p) * int(q) for p, q in zip(r, a)) for r in x], object)


class Walk:
    """Bounds of the scores of all candidates with one anchor after the other, in the order of the tree. Bounds are held
    as long as children wait; as the largest branch comes last, that is for about log2(anchors) anchors at a time."""

    def __init__(self, x: np.ndarray, anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.x, self.anchors, self.parent, self.edge = x, anchors, parent, edge
        self.length = np.linalg.norm(x, axis=1)
        self.waiting = np.bincount(parent[parent >= 0], minlength=len(parent))  # children to come
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.rescored = 0

    def visit(self, at: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The candidates that `wanted` (lower and upper bounds -> mask) may want, and their exact scores."""
        up = int(self.parent[at])
        if up < 0:
            low, high = np.full(len(self.x), -np.inf), np.full(len(self.x), np.inf)
        else:
            # a little more than the distance allows: lengths and bounds are rounded
            reach = self.edge[at] * self.length * (1 + 1e-9) + 1
            low, high = self.bounds[up]
            low, high = low - reach - 1e-9 * np.abs(low), high + reach + 1e-9 * np.abs(high)
            self.waiting[up] -= 1
            if not self.waiting[up]:
                del self.bounds[up]
        some = np.arange(len(self.x)) if up < 0 else np.flatnonzero(wanted(low, high))
        # most of the block: one product of all is cheaper than gathering rows
        score = _scores(self.x, self.anchors[at])[some] if 2 * len(some) > len(self.x) else _scores(self.x[some], self.anchors[at])
        self.rescored += len(some)
        low[some] = high[some] = score.astype(np.float64)
        if self.waiting[at]:
            self.bounds[at] = (low, high)
        return some, score


def _first(score: np.ndarray, key: np.ndarray, unknown: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller key, rows without a key last."""
    if len(score) > 8 * k and score.dtype != object:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((key[some], unknown[some], -score[some]))[:k]]
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda i: (-score[i], unknown[i], key[i]))[:k], np.int64)
    return np.lexsort((key, unknown, -score))[:k]


def _reached(low: np.ndarray, mask: np.ndarray, k: int) -> float:
    """A score that k rows of the mask reach for certain."""
    some = low[mask]
    return float(np.partition(some, len(some) - k)[len(some) - k]) if len(some) >= k else -np.inf


def _long(x) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(x)))


def best_of_label(w: Walk, order: np.ndarray, own: np.ndarray, anchor_label: np.ndarray, row: np.ndarray, label: np.ndarray, key: np.ndarray, unknown: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, place of a row, score) of the k first rows of an anchor's label that are not the anchor itself."""
    for at in order:
        fit = (label == anchor_label[at]) & (row != own[at])
        some, score = w.visit(at, lambda low, high: fit & (high >= _reached(low, fit, k)))
        keep = fit[some]
        some, score = some[keep], score[keep]
        for i in _first(score, key[some], unknown[some], k):
            yield at, int(some[i]), _long(score[i])


def best_in_windows(w: Walk, order: np.ndarray, anchor_label: np.ndarray, windows: list[list[int]], label: np.ndarray, key: np.ndarray, unknown: np.ndarray, share: tuple[int, int], k: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, positive score, place of a row, score) of the k first rows of other labels in each window of an anchor:
    share[0] * positive <= 100 * score <= share[1] * positive."""
    for at in order:
        fit = label != anchor_label[at]
        spans = [(p, share[0] * p / 100, share[1] * p / 100) for p in windows[at]]

        def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            out = np.zeros(len(low), bool)
            for _, a, b in spans:
                slack = 1 + 1e-9 * abs(p)
                sure = _reached(low, fit & (low >= a + slack) & (high <= b - slack), k)
                out |= fit & (high >= max(a - slack, sure)) & (low <= b + slack)
            return out

        some, score = w.visit(at, wanted)
        keep = fit[some]
        some, score = some[keep], score[keep]
        most = max([100, share[1]]) * max([abs(p) for p, _, _ in spans], default=0)
        if score.dtype != object and max(most, 100 * float(np.abs(score).max(initial=0))) >= EXACT:
            score = np.array([int(x) for x in score], object)
        for p, _, _ in spans:
            s = score
            inside = np.flatnonzero((share[0] * p <= 100 * s) & (100 * s <= share[1] * p))
            for i in inside[_first(score[inside], key[some[inside]], unknown[some[inside]], k)]:
                yield at, p, int(some[i]), _long(score[i])


# In Spark -------------------------------------------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _trees(anchors: DataFrame) -> DataFrame:
    """Anchors with their place in the order of their block's tree, their parent's place and the edge to it."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        x = _matrix(t.column("v"), key[0].as_py())
        order, parent, edge = tree(x)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        up = np.where(parent[order] >= 0, place[parent[order]], -1)
        return t.take(pa.array(order)).append_column("place", pa.array(np.arange(len(order)))).append_column("parent", pa.array(up)).append_column("edge", pa.array(edge[order]))

    return anchors.groupBy("dims", "i").applyInArrow(run, "dims int, i int, row long, key long, label long, v array<double>, place long, parent long, edge double")


def _both(anchors: DataFrame, rows: DataFrame, per: dict[int, tuple[int, int]]) -> DataFrame:
    """One table in which every block of anchors meets every block of candidates; `place` is null for candidates."""

    def count(k: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for d, n in per.items() for x in (d, n[k])]), c("dims"))

    each = F.explode(F.sequence(F.lit(0), count(1) - 1)).alias("j")
    a = anchors.select("dims", "i", each, "row", "key", "label", "v", "place", "parent", "edge", "windows")
    j = F.pmod(F.xxhash64(F.lit(1), "row"), count(1).cast("long")).cast("int").alias("j")
    r = rows.select("dims", F.explode(F.sequence(F.lit(0), count(0) - 1)).alias("i"), j, "row", "key", "label", "v")
    return a.unionByName(r, allowMissingColumns=True)


def _split(key: tuple[pa.Scalar, ...], t: pa.Table) -> tuple[pa.Table, Walk, dict[str, np.ndarray]] | None:
    is_anchor = pc.is_valid(t.column("place"))
    a, b = t.filter(is_anchor).sort_by("place"), t.filter(pc.invert(is_anchor)).sort_by("row")
    if not a.num_rows or not b.num_rows:
        return None
    dims = key[0].as_py()
    walk = Walk(_matrix(b.column("v"), dims), _matrix(a.column("v"), dims), a.column("parent").to_numpy(), a.column("edge").to_numpy())
    keys = b.column("key")
    return a, walk, {"row": b.column("row").to_numpy(), "label": b.column("label").to_numpy(), "key": pc.fill_null(keys, 0).to_numpy(), "unknown": pc.is_null(keys).to_numpy()}


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)})


def hard_negatives(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 1, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Each component x becomes floor(scale * x). A score is the inner product with the anchor; higher ones come first, ties by the smaller key (null last). An
    anchor's positives are its first `positives` other rows of the same label; for each of them the first `negatives`
    rows of other labels with share[0] * positive_score <= 100 * negative_score <= share[1] * positive_score are
    returned, from rank 1. Rows with a null label or vector, or a null, infinite or NaN component take no part; rows
    of a repeated key are rows of their own; only vectors of one length meet. Scores beyond 64 bits are compared exactly
    and returned as the nearest 64-bit number. An empty table gives an empty result.
    """
    if not 0 <= share[0] <= share[1]:
        raise ValueError("a window goes from a smaller to a larger share of the positive's score")
    v = c(f"`{vector}`").cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = vectors.filter(F.coalesce(fine & c(f"`{label}`").isNotNull(), F.lit(False)))
    rows = stored(known.select(F.size(v).alias("dims"), F.monotonically_increasing_id().alias("row"), c(f"`{key}`").cast("long").alias("key"), c(f"`{label}`").cast("long").alias("label"), F.transform(v, lambda x: F.floor(scale * x).cast("double")).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")))
    sizes = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a")).collect()  # a row for each vector length
    per = {r.dims: (max(1, -(-r.a // ANCHORS)), max(LEAST_BLOCKS, -(-r.n * 8 * max(r.dims, 1) // BLOCK_BYTES))) for r in sizes} or {0: (1, 1)}
    blocks = F.element_at(F.create_map(*[F.lit(x) for d, n in per.items() for x in (d, n[0])]), c("dims"))
    dealt = rows.filter("anchor").select("dims", F.pmod(F.xxhash64(F.lit(2), "row"), blocks.cast("long")).cast("int").alias("i"), "row", "key", "label", "v")
    trees = stored(_trees(dealt))

    def find_positives(k: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        out, parts = [], _split(k, t)
        if parts:
            a, walk, b = parts
            own, label_of = a.column("row").to_numpy(), a.column("label").to_numpy()
            for at, i, s in best_of_label(walk, range(a.num_rows), own, label_of, b["row"], b["label"], b["key"], b["unknown"], positives):
                out.append((int(own[at]), int(b["row"][i]), None if b["unknown"][i] else int(b["key"][i]), s))
        return _table(out, ["anchor", "row", "key", "score"])

    def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = W.partitionBy(*by).orderBy(c("score").desc(), c("key").asc_nulls_last(), "row")
        return found.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= k)

    met = _both(trees.withColumn("windows", F.lit(None).cast("array<long>")), rows, per).groupBy("dims", "i", "j")
    first = stored(ranked(met.applyInArrow(find_positives, "anchor long, row long, key long, score long"), ["anchor"], positives))
    windows = first.groupBy(c("anchor").alias("row")).agg(F.sort_array(F.collect_set("score")).alias("windows"))

    def find_negatives(k: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        out, parts = [], _split(k, t)
        if parts:
            a, walk, b = parts
            own, label_of = a.column("row").to_numpy(), a.column("label").to_numpy()
            for at, p, i, s in best_in_windows(walk, range(a.num_rows), label_of, a.column("windows").to_pylist(), b["label"], b["key"], b["unknown"], share, negatives):
                out.append((int(own[at]), p, int(b["row"][i]), None if b["unknown"][i] else int(b["key"][i]), s))
        return _table(out, ["anchor", "positive_score", "row", "key", "score"])

    # anchors without a positive stay in the tree, with no window
    asked = trees.join(windows, "row", "left").withColumn("windows", F.coalesce("windows", F.array().cast("array<long>")))
    met = _both(asked, rows, per).groupBy("dims", "i", "j")
    second = ranked(met.applyInArrow(find_negatives, "anchor long, positive_score long, row long, key long, score long"), ["anchor", "positive_score"], negatives)
    named = trees.select(c("row").alias("anchor"), c("key").alias("anchor_id"))
    pairs = first.select("anchor", c("key").alias("positive_id"), c("score").alias("positive_score")).join(named, "anchor")
    return pairs.join(second.select("anchor", "positive_score", "rank", c("key").alias("negative_id"), c("score").alias("negative_score")), ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
