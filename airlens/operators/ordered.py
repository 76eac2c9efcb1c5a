"""Order-dependent values of a key, with the key's rows split over slabs.

What a row needs from earlier slabs is one small record per slab (the last row, a running maximum), so a key that holds
most of the data is still spread over as many tasks as it has slabs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def with_previous(df: DataFrame, keys: list[str], slab: Column, order: list[str], cols: list[str], name: str = "prev") -> DataFrame:
    """Add a struct of `cols` of the row before (null on a key's first row). Slabs must follow the order."""
    d = df.withColumn("_slab", slab)
    part = [*keys, "_slab"]
    last = d.groupBy(*part).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    carry = last.select(*part, F.lag("_last").over(W.partitionBy(*keys).orderBy("_slab")).alias("_carry"))
    within = F.lag(F.struct(*cols)).over(W.partitionBy(*part).orderBy(*order))
    return d.join(carry, part).withColumn(name, F.coalesce(within, F.col("_carry"))).drop("_slab", "_carry")


def with_running_max(df: DataFrame, keys: list[str], slab: Column, order: list[str], value: Column, name: str = "before_max") -> DataFrame:
    """Add the maximum of `value` over all earlier rows of the key."""
    d = df.withColumn("_slab", slab).withColumn("_v", value)
    part = [*keys, "_slab"]
    per = d.groupBy(*part).agg(F.max("_v").alias("_m"))
    carry = per.select(*part, F.max("_m").over(W.partitionBy(*keys).orderBy("_slab").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    within = F.max("_v").over(W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return d.join(carry, part).withColumn(name, F.greatest(within, F.col("_carry"))).drop("_slab", "_carry", "_v")


def with_lags(df: DataFrame, keys: list[str], slab: Column, order: list[str], col: str, n: int) -> DataFrame:
    """Add `lag1` .. `lagn` of a column. The last n values before a slab are copied into it, whatever slabs they are in."""
    d = df.withColumn("_slab", slab)
    part = [*keys, "_slab"]
    newest = W.partitionBy(*part).orderBy(*[F.desc(o) for o in order])
    tails = d.select(*part, *order, col).withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n)
    tails = tails.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct(*order, col))).alias("_t"))
    before = F.flatten(F.collect_list("_t").over(W.partitionBy(*keys).orderBy("_slab").rowsBetween(-n, -1)))
    halo = tails.withColumn("_b", before).select(*part, F.explode(F.expr(f"slice(_b, greatest(size(_b) - {n - 1}, 1), {n})")).alias("_h")).select(*part, "_h.*", F.lit(True).alias("_halo"))
    w = W.partitionBy(*part).orderBy(*order)
    u = d.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    u = u.select("*", *[F.lag(col, i).over(w).alias(f"lag{i}") for i in range(1, n + 1)])
    return u.filter(~F.col("_halo")).drop("_halo", "_slab")


def sealed(df: DataFrame) -> DataFrame:
    """Stop filters and inferred null checks from being pushed below long formulas, which would repeat them."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))
