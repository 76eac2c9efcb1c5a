"""Airports inside or near the polygons of an extent product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens import dims
from airlens.functions.geo import haversine_nm, point_in_polygon
from airlens.operators.bandjoin import cover_cells, floor_cell

c = F.col


def airports_in_extents(extents: DataFrame, buffer_nm: float = 10.0) -> DataFrame:
    """`extents` has extent (its order is its precedence) and polygon [[lat, lon]]; the buffer is to the nearest vertex."""
    lats, lons = F.transform("polygon", lambda p: F.get(p, 0)), F.transform("polygon", lambda p: F.get(p, 1))
    e = extents.withColumn("_la", lats).withColumn("_lo", lons)
    dlat = buffer_nm / 60.0
    dlon = buffer_nm / (60.0 * F.greatest(F.cos(F.radians(F.array_max(F.transform("_la", F.abs)) + dlat)), F.lit(0.1)))
    e = cover_cells(e, F.array_min("_la") - dlat, F.array_min("_lo") - dlon, F.array_max("_la") + dlat, F.array_max("_lo") + dlon).drop("_la", "_lo")
    a = dims.table(extents.sparkSession, "airports").select("icao", "lat", "lon", floor_cell(c("lat"), 1.0).alias("cell_y"), floor_cell(c("lon"), 1.0).alias("cell_x"))
    j = e.join(F.broadcast(a), ["cell_y", "cell_x"])
    near = F.array_min(F.transform("polygon", lambda p: haversine_nm(c("lat"), c("lon"), F.get(p, 0), F.get(p, 1))))
    j = j.withColumn("_in", point_in_polygon(c("lat"), c("lon"), c("polygon"))).withColumn("_near", near).filter(c("_in") | (c("_near") <= buffer_nm))
    return j.groupBy("icao").agg(F.min_by(F.struct("extent", "_in"), "extent").alias("x")).select("icao", c("x.extent").alias("extent"), F.when(c("x._in"), "inside").otherwise("near").alias("relation"))
