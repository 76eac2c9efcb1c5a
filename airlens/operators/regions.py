"""Regions: boxes, specifications, catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens import dims
from airlens.functions.geo import bbox_of

c = F.col
# fixed values
GROUPS = {
    "usa-hubs": ["sea", "sfo", "lax", "phx", "slc", "den", "dfw", "iah", "msp", "ord", "mci", "atl", "mia", "dca", "nyc"],
    "world-hubs": ["nyc", "ord", "lax", "lhr", "fra", "dxb", "sin", "hnd"],
}
GROUP_RADIUS_NM = 250.0


def regions(spark: SparkSession) -> DataFrame:
    """All regions with their exact or derived box."""
    r = dims.table(spark, "regions")
    derived = bbox_of(c("lat"), c("lon"), c("radius_nm"))
    names = ["lamin", "lomin", "lamax", "lomax"]
    return r.select("key", "name", "lat", "lon", "radius_nm", "endpoint", *[F.coalesce(c(n), d).alias(n) for n, d in zip(names, derived, strict=True)], c("lamin").isNotNull().alias("exact_box"))


def expand(specs: DataFrame) -> DataFrame:
    """`spec` column of comma-separated regions and groups -> one row per region; groups widen the radius to 250 nm."""
    spark = specs.sparkSession
    parts = specs.withColumn("_k", F.explode(F.filter(F.transform(F.split(F.lower("spec"), ","), lambda x: F.trim(x)), lambda x: x != "")))
    members = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(m) for m in x]) for kv in GROUPS.items() for x in kv])
    group = F.try_element_at(members, c("_k"))
    has_group = F.exists(F.transform(F.split(F.lower("spec"), ","), lambda x: F.trim(x)), lambda x: x.isin(list(GROUPS)))
    keys = parts.withColumn("_grouped", has_group).withColumn("key", F.explode(F.coalesce(group, F.array("_k")))).drop("_k")
    r = dims.table(spark, "regions").select("key", "name", c("radius_nm").alias("_r"))
    j = keys.join(F.broadcast(r), "key", "left")
    radius = F.coalesce(c("radius_override"), F.when(c("_grouped"), GROUP_RADIUS_NM), c("_r")) if "radius_override" in specs.columns else F.coalesce(F.when(c("_grouped"), GROUP_RADIUS_NM), c("_r"))
    return j.select(*specs.columns, "key", "name", radius.alias("radius_nm"))


def inside(states: DataFrame, region_key: str) -> DataFrame:
    """Rows inside a region's box: four comparisons the scan can use."""
    header, data = dims.rows("regions")
    row = dict(zip(header, next(r for r in data if r[0] == region_key), strict=True))
    if row["lamin"] is None:
        import math

        dlat = row["radius_nm"] / 60.0
        dlon = row["radius_nm"] / (60.0 * max(math.cos(math.radians(row["lat"])), 0.1))
        box = (row["lat"] - dlat, row["lon"] - dlon, row["lat"] + dlat, row["lon"] + dlon)
    else:
        box = (row["lamin"], row["lomin"], row["lamax"], row["lomax"])
    return states.filter(c("lat").between(box[0], box[2]) & c("lon").between(box[1], box[3]))


def catalogue(spark: SparkSession) -> DataFrame:
    """Kind and default polling interval of every region."""
    kind = F.when(c("endpoint").isNotNull(), "feed").when(c("exact_box"), "area").otherwise("hub")
    return regions(spark).select("key", "name", kind.alias("kind"), F.when(kind == "hub", 15).otherwise(60).alias("interval_s"))
