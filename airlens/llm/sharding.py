"""Sharding by a Hilbert curve: rows that are close in several metadata dimensions share a file.

Each dimension is quantised to 2**bits steps, the steps are mapped to an index on the Hilbert curve, the rows are put
in the order of that index, and the order is cut into equal runs. Only built-in functions are used.

The order needs no global sort. A bucket is a curve cell and some bits of the row's hash; buckets are counted (partial
counts before the shuffle), the counts of the at most 2**(bits * dimensions) cells are summed up in order, and a row's
rank is the rows of earlier buckets plus its place in its own. A cell that holds a third of all rows is cut into
2**split_bits buckets by the hash.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from airlens.llm.shared import packed, unpacked

c = F.col
#: bytes of a category's text that its step is read from
PLACES = 6


@dataclass(frozen=True)
class Dimension:
    """One axis: a column, or an expression over the struct `row` of all columns. kind: `ordinal` places a category's
    text between the smallest and the largest one, so that steps are in the order of the values and the minimum and
    maximum of a file tell which values it can hold; `hash` spreads the values; `log` takes the binary logarithm of a
    number (`per_octave` steps an octave, up to `origin` is step 0). Null is step 0."""

    column: str
    kind: str = "ordinal"
    per_octave: int = 2
    origin: float = 1.0
    expression: str | None = None
    least: str | None = None
    most: str | None = None

    def value(self) -> Column:
        return F.expr(self.expression) if self.expression else c(f"row.`{self.column}`")

    def step(self, bits: int) -> Column:
        v = self.value()
        top = (1 << bits) - 1
        if self.kind == "ordinal":
            low, high = ((x or "").encode() for x in (self.least, self.most))
            same = len(os.path.commonprefix([low, high]))
            # the bytes behind what all values share, as a number; text sorts by its bytes
            a, b = (int.from_bytes(x[same : same + PLACES].ljust(PLACES, b"\0"), "big") for x in (low, high))
            bytes_ = F.substring(v.cast("string").cast("binary"), same + 1, PLACES)
            at = F.conv(F.rpad(F.hex(bytes_), 2 * PLACES, "0"), 16, 10).cast("long")
            code = F.floor((at - a) * float(top + 1) / (b - a + 1))
        elif self.kind == "hash":
            code = F.pmod(F.xxhash64(v), F.lit(1 << bits))
        elif self.kind == "log":
            code = F.greatest(F.lit(0), F.least(F.lit(top), F.floor(F.log2(F.greatest(v.cast("double"), F.lit(self.origin)) / self.origin) * self.per_octave)))
        else:
            raise ValueError(f"unknown kind {self.kind}")
        return F.coalesce(code.cast("long"), F.lit(0).cast("long"))


def hilbert_index(steps: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point with `bits` bits an axis.

    From the highest bit down, an axis whose bit is set flips the lower bits of axis 0, any other swaps its lower bits
    with those of axis 0; the axes are then read as a Gray code, bit by bit.
    """
    n = len(steps)
    if n * bits > 62:
        raise ValueError("the index must fit 62 bits")
    moves = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)]) if bits > 1 else None
    x = F.array(*steps)
    if moves is not None:

        def move(a: Column, m: Column) -> Column:
            q, i = m["q"], m["i"]
            low = q.cast("long") - 1
            set_ = F.get(a, i).bitwiseAND(q.cast("long")) != 0
            t = F.get(a, F.lit(0)).bitwiseXOR(F.get(a, i)).bitwiseAND(low)
            return F.transform(
                a,
                lambda v, j: F.when(set_, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
                .when((j == 0) | (j == i), v.bitwiseXOR(t))
                .otherwise(v),
            )

        x = F.aggregate(moves, x, move)

    def gray(a: Column) -> Column:
        # each axis takes the exclusive or of all axes before it
        return F.transform(a, lambda _, j: F.aggregate(F.slice(a, 1, j + 1), F.lit(0).cast("long"), lambda s, v: s.bitwiseXOR(v)))

    def index(a: Column) -> Column:
        last = F.get(a, F.lit(n - 1))
        t = F.aggregate(F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]), F.lit(0).cast("long"), lambda s, q: F.when(last.bitwiseAND(q) != 0, s.bitwiseXOR(q - 1)).otherwise(s)) if bits > 1 else F.lit(0).cast("long")
        places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(places, F.lit(0).cast("long"), lambda s, p: s * 2 + F.call_function("getbit", F.get(a, p["i"]).bitwiseXOR(t), p["b"]).cast("long"))

    # each array is bound once, as the only element of an array
    return F.get(F.transform(F.transform(F.array(x), gray), index), F.lit(0))


def _fitted(docs: DataFrame, dimensions: list[Dimension]) -> list[Dimension]:
    """The dimensions with the smallest and largest value of the ordinal ones: one row."""
    asked = [d for d in dimensions if d.kind == "ordinal" and d.least is None]
    if not asked:
        return dimensions
    ends = packed(docs).agg(*[f(d.value().cast("string")).alias(f"{n}{i}") for i, d in enumerate(asked) for n, f in (("a", F.min), ("b", F.max))]).first()
    known = {id(d): replace(d, least=ends[f"a{i}"] or "", most=ends[f"b{i}"] or "") for i, d in enumerate(asked)}
    return [known.get(id(d), d) for d in dimensions]


def hilbert_shards(docs: DataFrame, dimensions: list[Dimension], shards: int = 8, bits: int = 5, split_bits: int = 6, tie: list[str] | None = None) -> DataFrame:
    """All rows with `curve` (long), `shard` (int, 0 to shards-1) and `slot` (long, gapless from 0 in its shard).

    Shards are runs of the curve order whose row counts are at most one apart. Rows on one curve cell are in the order
    of the hash of the `tie` columns (default: all). Nulls are step 0 of their axis; repeated rows take slots of their
    own; an empty table gives an empty result; input columns named curve, shard or slot are replaced.
    """
    names = docs.columns
    dimensions = _fitted(docs, dimensions)
    hashed = F.xxhash64(*[c(f"row.`{n}`") for n in (tie or names)])
    rows = packed(docs).select("row", hilbert_index([d.step(bits) for d in dimensions], bits).alias("curve"), hashed.alias("h"))
    rows = rows.withColumn("part", F.shiftrightunsigned("h", 64 - split_bits) if split_bits else F.lit(0).cast("long"))
    buckets = rows.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    cells = buckets.groupBy("curve").agg(F.sum("n").alias("n"))
    # at most 2**(bits * dimensions) rows
    before = cells.select("curve", (F.sum("n").over(W.orderBy("curve").rowsBetween(W.unboundedPreceding, 0)) - c("n")).alias("before"), F.sum("n").over(W.partitionBy(F.lit(0))).alias("total"))
    within = buckets.select("curve", "part", (F.sum("n").over(W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - c("n")).alias("inside"))
    start = within.join(before, "curve").select("curve", "part", (c("before") + c("inside")).alias("start"), "total")
    ranked = rows.join(start, ["curve", "part"]).withColumn("rank", c("start") + F.row_number().over(W.partitionBy("curve", "part").orderBy("h")) - 1)
    shard = F.expr(f"rank * {shards} div total")
    out = ranked.withColumn("shard", shard.cast("int")).withColumn("slot", c("rank") - F.expr(f"(shard * total + {shards - 1}) div {shards}"))
    return out.select(*unpacked(out, names, "curve", "shard", "slot"))
