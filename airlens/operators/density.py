"""Traffic density per cell and altitude band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.operators.bandjoin import salted_join
from airlens.operators.ordered import with_previous
from airlens.operators.tracks import SLAB_S

CELL_DEG = 0.2
MAX_PRESENCE_S = 120.0
RISK_RATIO_LIMIT = 0.2


def band(alt_ft: Column) -> Column:
    a = F.coalesce(alt_ft, F.lit(0.0))
    return F.when(a < -1000, "above-10000").when(a < 1200, "surface-1200").when(a < 3000, "1200-3000").when(a < 10000, "3000-10000").otherwise("above-10000")


def density_class(per_100nm2_h: Column) -> Column:
    return F.when(per_100nm2_h < 0.05, "sparse").when(per_100nm2_h < 0.5, "moderate").when(per_100nm2_h < 5.0, "dense").otherwise("very-dense")


def presence(states: DataFrame, slab_s: float = SLAB_S) -> DataFrame:
    """Seconds since the aircraft's report before, clamped to [0, 120], for airborne positioned rows.

    Partitioned by (recording, address, time slab); the last report before a slab comes from one row per slab.
    """
    s = states.filter("not on_ground and lat is not null and lon is not null")
    s = with_previous(s, ["recording", "icao24"], F.floor(F.col("batch_ts") / slab_s), ["batch_seq", "pos"], ["ts"], "_prev")
    dt = F.least(F.greatest(F.col("ts") - F.col("_prev.ts"), F.lit(0.0)), F.lit(MAX_PRESENCE_S))
    return s.withColumn("presence_s", F.when(F.col("_prev").isNull(), 0.0).otherwise(dt)).drop("_prev")


def density(states: DataFrame) -> DataFrame:
    """Aircraft-hours per 0.2 degree cell and band, per 100 square nm and hour of recording, with a class."""
    p = presence(states)
    span = states.filter("not on_ground and lat is not null and lon is not null").groupBy("recording").agg(
        F.greatest((F.max("ts") - F.min("ts")) / 3600.0, F.lit(1e-6)).alias("span_h"))
    cells = p.groupBy(
        "recording", F.col("lat").__truediv__(CELL_DEG).cast("long").alias("cell_lat"), (F.col("lon") / CELL_DEG).cast("long").alias("cell_lon"), band(F.col("baro_alt_ft")).alias("band"),
    ).agg((F.sum("presence_s") / 3600.0).alias("aircraft_hours"))
    area = (CELL_DEG * 60.0) * (CELL_DEG * 60.0 * F.greatest(F.cos(F.radians((F.col("cell_lat") + 0.5) * CELL_DEG)), F.lit(0.05)))
    per = F.col("aircraft_hours") / F.col("span_h") / (area / 100.0)
    return salted_join(cells, span, ["recording"], F.hash("cell_lat", "cell_lon")).withColumn("per_100nm2_h", per).withColumn("class", density_class(F.col("per_100nm2_h")))
