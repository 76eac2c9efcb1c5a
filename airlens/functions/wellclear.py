"""Well-clear volume, alert levels and pair geometry as expressions (feet, seconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airlens.functions.geo import FT_PER_NM

# fixed values
FT_PER_S_PER_KT = FT_PER_NM / 3600.0
DTHR_FT = 4000.0
ZTHR_FT = 450.0
ZTHR_PREVENTIVE_FT = 700.0
TTHR_S = 35.0
ALERT_S = 55
WARNING_S = 25
LEVELS = ["preventive", "corrective", "warning"]


def relative(lat1: Column, lon1: Column, gs1: Column, trk1: Column, lat2: Column, lon2: Column, gs2: Column, trk2: Column) -> dict[str, Column]:
    """Position (east, north) and velocity of the second aircraft as seen from the first."""
    shrink = F.cos(F.radians((lat1 + lat2) / 2))
    return {
        "sx": (lon2 - lon1) * 60.0 * shrink * FT_PER_NM,
        "sy": (lat2 - lat1) * 60.0 * FT_PER_NM,
        "vx": (gs2 * F.sin(F.radians(trk2)) - gs1 * F.sin(F.radians(trk1))) * FT_PER_S_PER_KT,
        "vy": (gs2 * F.cos(F.radians(trk2)) - gs1 * F.cos(F.radians(trk1))) * FT_PER_S_PER_KT,
    }


def miss_distance(sx: Column, sy: Column, vx: Column, vy: Column) -> Column:
    """Horizontal distance at the closest point still ahead."""
    vv = vx * vx + vy * vy
    t = F.when(vv < 1e-9, 0.0).otherwise(F.greatest(F.lit(0.0), F.try_divide(-(sx * vx + sy * vy), vv)))
    return F.sqrt(F.pow(sx + vx * t, 2) + F.pow(sy + vy * t, 2))


def tau_mod(sx: Column, sy: Column, vx: Column, vy: Column) -> Column:
    """Modified tau; 0 inside the distance threshold, null when diverging."""
    r2, sv = sx * sx + sy * sy, sx * vx + sy * vy
    return F.when(r2 <= DTHR_FT * DTHR_FT, 0.0).when(sv < 0, F.try_divide(DTHR_FT * DTHR_FT - r2, sv))


def horizontal(sx: Column, sy: Column, vx: Column, vy: Column) -> Column:
    tau = tau_mod(sx, sy, vx, vy)
    inside = (sx * sx + sy * sy) <= DTHR_FT * DTHR_FT
    return inside | F.coalesce((tau >= 0) & (tau <= TTHR_S) & (miss_distance(sx, sy, vx, vy) <= DTHR_FT), F.lit(False))


def violates(sx: Column, sy: Column, vx: Column, vy: Column, dz: Column, zthr: float = ZTHR_FT) -> Column:
    """Both conditions; with a zero co-altitude threshold the vertical one is the band alone."""
    return horizontal(sx, sy, vx, vy) & (F.abs(dz) <= zthr)


def first_violation(sx: Column, sy: Column, vx: Column, vy: Column, dz: Column, vz: Column, zthr: float, horizon: int = ALERT_S) -> Column:
    """First whole second at which the straight-line projection violates; null when none does."""
    hits = F.filter(F.sequence(F.lit(0), F.lit(horizon)), lambda t: violates(sx + vx * t, sy + vy * t, vx, vy, dz + vz * t, zthr))
    return F.get(hits, 0)


def alert_level(t_preventive: Column, t_corrective: Column) -> Column:
    """Highest active level: corrective and warning share thresholds and differ in time only."""
    return (
        F.when(t_corrective <= WARNING_S, 3).when(t_corrective.isNotNull(), 2).when(t_preventive.isNotNull(), 1).otherwise(0)
    )
