"""Grid blocking for joins on distance: an equi-join on cells instead of a cross join.

Each left row is copied to its neighbouring cells (a constant factor), each right row stays in one; the exact distance
test belongs after the join. Cells include the poll, so one busy hub is spread over all polls of all recordings, and
the vertical cell keeps traffic stacked over one place apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floor_cell(x: Column, edge: float) -> Column:
    return F.floor(x / edge).cast("long")


def trunc_cell(x: Column, edge: float) -> Column:
    """Truncation toward zero: the cell that straddles zero is twice as wide."""
    return (x / edge).cast("long")


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_cells: list[Column], right_cells: list[Column], left_alias: str = "a", right_alias: str = "b", span: int = 1) -> DataFrame:
    """Candidate pairs whose cells touch, aliased `a` and `b`.

    span: so many cells an axis meet as one, and whether two of them touch is tested after the join. A left row is copied
    1 + 2 / span times an axis, three times if span is 1.
    """
    n = len(left_cells)
    names = [f"_c{i}" for i in range(n)]
    lhs = left
    for i in range(n):
        lhs = lhs.withColumn(names[i], left_cells[i])
    rhs = right
    for i in range(n):
        rhs = rhs.withColumn(names[i], right_cells[i])
    for i in range(n):  # one axis after the other keeps the generated code small
        at = F.col(names[i])
        if span == 1:
            lhs = lhs.withColumn(names[i], F.explode(F.array(at - 1, at, at + 1)))
        else:
            lhs = lhs.withColumn(f"_at{i}", at).withColumn(names[i], F.explode(F.sequence(F.floor((at - 1) / span), F.floor((at + 1) / span))))
            rhs = rhs.withColumn(f"_at{i}", at).withColumn(names[i], F.floor(at / span))
    lhs, rhs = lhs.alias(left_alias), rhs.alias(right_alias)
    cond = None
    for k in [*on, *names]:
        eq = F.col(f"{left_alias}.{k}") == F.col(f"{right_alias}.{k}")
        cond = eq if cond is None else cond & eq
    for i in range(n if span > 1 else 0):
        cond = cond & (F.abs(F.col(f"{left_alias}._at{i}") - F.col(f"{right_alias}._at{i}")) <= 1)
    return lhs.join(rhs, cond)


def cover_cells(df: DataFrame, lamin: Column, lomin: Column, lamax: Column, lomax: Column, edge: float = 1.0) -> DataFrame:
    """Copy each row to every grid cell its box touches (columns `cell_y`, `cell_x`): the geometry bounds the copies."""
    df = df.withColumn("cell_y", F.explode(F.sequence(floor_cell(lamin, edge), floor_cell(lamax, edge))))
    return df.withColumn("cell_x", F.explode(F.sequence(floor_cell(lomin, edge), floor_cell(lomax, edge))))


#: rows of the larger side for each bucket, and buckets at least
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 16


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt: Column, buckets: int | None = None, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys are split over `buckets` tasks: the small side is copied once per bucket. Without a
    number the rows of the larger side are counted, so that a key with all of them is no large task either; a stream
    is split by its micro-batches already."""
    if buckets is None:
        buckets = LEAST_BUCKETS if big.isStreaming else max(LEAST_BUCKETS, -(-big.count() // BUCKET_ROWS))
    lhs = big.withColumn("_salt", F.pmod(salt, F.lit(buckets)).cast("int"))
    rhs = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return lhs.join(rhs, [*keys, "_salt"], how).drop("_salt")
