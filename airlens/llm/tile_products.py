"""Near-duplicate vectors by tiles of int8 products.

Distinct vectors are dealt to tiles; two tiles meet in one task. A vector is scaled to length 1 and rounded to int8
steps; the length of what rounding took away is known exactly, so every product of codes comes with a bound of its
error, and only pairs whose bound reaches the threshold are computed again in double precision. A task returns per
vector the number of its links and one edge to the smallest vector it reaches there, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm.graph import components, forest
from airlens.llm.shared import packed, stored, unpacked

c = F.col
#: vectors of a tile at most (two tiles are in a task), and tiles at least, so that few vectors make several tasks too
TILE_ROWS = 16_384
LEAST_TILES = 8
#: rows of a tile that are multiplied at once, and pairs that are computed again at once
STRIP = 256
AGAIN = 65_536


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (whole numbers up to 127 as float32), step and length of the rounding error of unit vectors."""
    step = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / step[:, None])
    return codes.astype(np.float32), step, np.linalg.norm(x - codes * step[:, None], axis=1)


def _unit(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tile_links(a: np.ndarray, b: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a and b (None: pairs x < y of a) with a product of `least` or more."""
    qa, sa, ea = quantised(a)
    other = a if b is None else b
    qb, sb, eb = (qa, sa, ea) if b is None else quantised(other)
    exact = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64  # products of codes are whole numbers
    qa, qb = qa.astype(exact), np.ascontiguousarray(qb.astype(exact).T)
    scale, wide = sb.astype(np.float32), (1 + eb).astype(np.float32)
    for k in range(0, len(a), STRIP):
        rows = slice(k, min(k + STRIP, len(a)))
        skip = k if b is None else 0
        m = qa[rows] @ qb[:, skip:]
        m *= sa[rows, None].astype(np.float32)
        m *= scale[skip:]
        # |x.y - codes| <= ex*|y| + |x|*ey + ex*ey = (1 + ex)(1 + ey) - 1 for unit vectors; 1e-5 covers float32 rounding
        m += np.outer((1 + ea[rows]).astype(np.float32), wide[skip:])
        i, j = np.nonzero(m >= least + 1 - 1e-5)
        i, j = i + k, j + skip
        if b is None:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), AGAIN):
            x, y = i[s : s + AGAIN], j[s : s + AGAIN]
            ok = np.einsum("ij,ij->i", a[x], other[y]) >= least
            if ok.any():
                yield x[ok], y[ok]


def _task(least: float):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dims, i, j = (k.as_py() for k in key)
        ids, weight, tile = (t.column(k).to_numpy() for k in ("id", "n", "tile"))
        order = np.lexsort((ids, tile))
        x = _unit(t.column("v"), dims)[order]
        ids, weight, tile = ids[order], weight[order], tile[order]
        cut = int(np.searchsorted(tile, i, "right"))
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if i == j or cut < len(ids):
            for a, b in tile_links(x[:cut], None if i == j else x[cut:], least):
                b = b if i == j else b + cut
                links += np.bincount(a, weight[b], len(ids)).astype(np.int64) + np.bincount(b, weight[a], len(ids)).astype(np.int64)
                label = forest(len(ids), a, b, label)
        some = np.flatnonzero(links)
        return pa.table({"id": ids[some], "links": links[some], "root": ids[label[some]]})

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """All rows with n_links, component_id and kept.

    Two rows are linked if the cosine of their vectors in double precision is `least` or more; n_links counts other
    rows, copies included. component_id is the smallest key that links reach (nulls count only where no key is known),
    kept is whether that is the row's own key. Vectors that are null, empty, zero or hold null, NaN or infinity link
    with nothing, nor do vectors of different lengths with each other. Repeated keys are rows of their own; columns with
    the added names are replaced; an empty table gives an empty result.
    """
    names = vectors.columns
    v = c(f"row.`{vector}`").cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    # of vectors that link with nothing both hashes are null
    rows = packed(vectors).withColumn("ok", F.coalesce(fine, F.lit(False)))
    rows = rows.select("row", c(f"row.`{key}`").alias("key"), *[F.when(c("ok"), h).alias(n) for n, h in (("k1", F.xxhash64(F.lit(1), v)), ("k2", F.xxhash64(F.lit(2), v)))], F.when(c("ok"), v).alias("v"))
    classes = rows.filter("k1 is not null").groupBy("k1", "k2").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()).withColumn("dims", F.size("v")))
    sizes = {r.dims: r["count"] for r in classes.groupBy("dims").count().collect()}  # a row for each vector length
    tiles = {d: max(LEAST_TILES, -(-n // TILE_ROWS)) for d, n in sizes.items()} or {0: 1}
    count = F.element_at(F.create_map(*[F.lit(x) for p in tiles.items() for x in p]), c("dims"))
    dealt = classes.select("id", "n", "v", "dims", F.pmod(F.xxhash64("id"), count).cast("int").alias("tile"), count.alias("tiles"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), c("tiles") - 1)))
    met = dealt.select("dims", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "id", "n", "tile", "v")
    found = stored(met.groupBy("dims", "i", "j").applyInArrow(_task(least), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.select(c("id").alias("a"), c("root").alias("b"))).withColumnRenamed("node", "id")
    part = classes.select("id", "k1", "k2", "n", "low").join(links, "id", "left").join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lows = part.groupBy("component").agg(F.min("low").alias("component_id"))
    known = part.join(lows, "component").select("k1", "k2", (c("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.drop("v").join(known, ["k1", "k2"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    out = out.withColumn("component_id", F.when(c("k1").isNull(), c("key")).otherwise(c("component_id"))).withColumn("kept", c("key").eqNullSafe(c("component_id")))
    return out.select(*unpacked(out, names, "n_links", "component_id", "kept"))
