"""Geometry as column expressions: everything stays in the JVM and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_NM = 3440.065
NM_PER_DEG = 60.0
FT_PER_NM = 6076.1155


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2)
    return F.lit(2 * EARTH_RADIUS_NM) * F.asin(F.sqrt(F.when(chord > 1.0, 1.0).otherwise(chord)))


def planar_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat distance with the cosine of the middle latitude."""
    dy = (lat2 - lat1) * NM_PER_DEG
    dx = (lon2 - lon1) * NM_PER_DEG * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + dy * dy)


def wrapped_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat distance that is safe across the antimeridian; cosine of the first point."""
    dy = (lat2 - lat1) * NM_PER_DEG
    dx = (F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0) * NM_PER_DEG * F.cos(F.radians(lat1))
    return F.sqrt(dx * dx + dy * dy)


def heading_delta(a: Column, b: Column) -> Column:
    """Signed smallest turn from a to b, in (-180, 180]."""
    d = F.pmod(b - a, F.lit(360.0))
    return F.when(d > 180.0, d - 360.0).otherwise(d)


def move(lat: Column, lon: Column, gs_kt: Column, track_deg: Column, dt_s: Column, cos_lat: Column | None = None) -> tuple[Column, Column]:
    """Dead reckoning over dt seconds; the position stands when speed or track is unknown.

    ``cos_lat`` is the latitude the longitude step is scaled with; the default is the starting latitude.
    """
    known = gs_kt.isNotNull() & track_deg.isNotNull()
    d_nm = gs_kt * dt_s / 3600.0
    new_lat = lat + d_nm * F.cos(F.radians(track_deg)) / NM_PER_DEG
    scale = F.greatest(F.cos(F.radians(lat if cos_lat is None else cos_lat)), F.lit(0.1))
    new_lon = lon + d_nm * F.sin(F.radians(track_deg)) / (NM_PER_DEG * scale)
    return F.when(known, new_lat).otherwise(lat), F.when(known, new_lon).otherwise(lon)


def point_in_polygon(y: Column, x: Column, polygon: Column) -> Column:
    """Even-odd rule over an array of [y, x] vertices; the array is as long as the outline, not as the data."""
    n = F.size(polygon)
    crossings = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (
            (F.get(F.get(polygon, i), 0) > y) != (F.get(F.get(polygon, (i + 1) % n), 0) > y)
        )
        & (
            x
            < F.get(F.get(polygon, i), 1)
            + F.try_divide(
                (y - F.get(F.get(polygon, i), 0)) * (F.get(F.get(polygon, (i + 1) % n), 1) - F.get(F.get(polygon, i), 1)),
                F.get(F.get(polygon, (i + 1) % n), 0) - F.get(F.get(polygon, i), 0),
            )
        ),
    )
    return F.when(n >= 3, F.size(crossings) % 2 == 1).otherwise(F.lit(False))


def bbox_of(lat: Column, lon: Column, radius_nm: Column) -> list[Column]:
    """lamin, lomin, lamax, lomax of a circle."""
    dlat = radius_nm / NM_PER_DEG
    dlon = radius_nm / (NM_PER_DEG * F.greatest(F.cos(F.radians(lat)), F.lit(0.1)))
    return [(lat - dlat).alias("lamin"), (lon - dlon).alias("lomin"), (lat + dlat).alias("lamax"), (lon + dlon).alias("lomax")]
