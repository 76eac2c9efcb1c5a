"""Debris-mitigation checklist over a table of missions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlens.session import spread

c = F.col
# fixed values
MU, RE_KM, GEO_ALT_KM = 398600.4418, 6378.137, 35786.0
ATMOSPHERE = [  # altitude km, density kg/m3, scale height km
    (150, 2.070e-9, 22.523), (180, 5.464e-10, 29.740), (200, 2.789e-10, 37.105), (250, 7.248e-11, 45.546), (300, 2.418e-11, 53.628),
    (350, 9.518e-12, 53.298), (400, 3.725e-12, 58.515), (450, 1.585e-12, 60.828), (500, 6.967e-13, 63.822), (600, 1.454e-13, 71.835),
    (700, 3.614e-14, 88.667), (800, 1.170e-14, 124.64), (900, 5.245e-15, 181.05), (1000, 3.019e-15, 268.00),
]
LIMIT_US_YEARS, LIMIT_YEARS, CASUALTY_LIMIT, MAX_YEARS, STEP_S = 5.0, 25.0, 1e-4, 200.0, 432000.0


#: missions of a task: up to two hundred years of steps each
MISSIONS_PER_TASK = 5_000


def lifetimes(missions: DataFrame) -> DataFrame:
    """Add lifetime_years: a decay integration that advances all missions of an Arrow batch together. Missions are dealt
    evenly to tasks before, as their file is small beside the work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h0, rho0, scale = (np.array(col, dtype=float) for col in zip(*ATMOSPHERE, strict=True))
        above = np.append(h0[1:], np.inf)
        year = 365.25 * 86400
        for pdf in batches:
            a = RE_KM + (pdf.perigee_km.to_numpy(float) + pdf.apogee_km.to_numpy(float)) / 2
            drag = pdf.cd.to_numpy(float) * pdf.area_m2.to_numpy(float) / np.maximum(pdf.mass_kg.to_numpy(float), 1e-6)
            high = pdf.perigee_km.to_numpy(float) > 2000
            years = np.where(high, MAX_YEARS, 0.0)
            at = np.flatnonzero(~high & (a - RE_KM > 150))  # those still up, which all have the same age
            a, drag, t = a[at], -drag[at], 0.0
            k = np.searchsorted(h0, a - RE_KM, side="right") - 1
            h, top, rho, sc = h0[k], above[k], rho0[k], scale[k]
            while len(at):
                alt = a - RE_KM
                if len(out := np.flatnonzero((alt < h) | (alt >= top))):  # these have left their layer
                    k = np.searchsorted(h0, alt[out], side="right") - 1
                    h[out], top[out], rho[out], sc[out] = h0[k], above[k], rho0[k], scale[k]
                step = drag * (rho * np.exp(-(alt - h) / sc)) * np.sqrt(MU / a) * 1000.0 * a * STEP_S
                a = a + step
                t += STEP_S
                never = (alt > 1500) & (step > -1e-6)
                live = ~never & (a - RE_KM > 150) & (t < MAX_YEARS * year)
                if not live.all():
                    years[at[~live]] = np.where(never[~live], MAX_YEARS, np.minimum(t / year, MAX_YEARS))
                    at, a, drag, h, top, rho, sc = (x[live] for x in (at, a, drag, h, top, rho, sc))
            yield pdf.assign(lifetime_years=years)

    return spread(missions, MISSIONS_PER_TASK).mapInPandas(run, T.StructType([*missions.schema.fields, T.StructField("lifetime_years", T.DoubleType())]))


def regime() -> Column:
    return F.when(c("perigee_km") <= 2000, "LEO").when(F.abs((c("perigee_km") + c("apogee_km")) / 2 - GEO_ALT_KM) < 300, "GEO").otherwise("MEO/HEO")


def checklist(missions: DataFrame) -> DataFrame:
    """One row per mission and applicable check: pass, fail or unknown, with the severity of a failure.

    Expects `lifetime_years` for the LEO disposal check.
    """
    m = missions.withColumn("regime", regime())
    leo, geo = c("regime") == "LEO", c("regime") == "GEO"
    limit = F.when(c("us_licensed"), LIMIT_US_YEARS).otherwise(LIMIT_YEARS)
    controlled = (c("disposal_plan") == "controlled-reentry") & c("propulsion")
    raise_min = 235.0 + 1200.0 * c("area_m2") / F.greatest(c("mass_kg"), F.lit(1e-6))
    populated = leo & ((c("perigee_km") + c("apogee_km")) / 2).between(400, 1200)
    casualty = F.when(c("casualty_risk").isNotNull(), c("casualty_risk") < CASUALTY_LIMIT).otherwise(c("demisable"))

    def check(rule: str, applies: Column, ok: Column, sev: Column | str) -> Column:
        return F.when(applies, F.struct(F.lit(rule).alias("rule_id"), ok.alias("ok"), (F.lit(sev) if isinstance(sev, str) else sev).alias("sev")))

    yes = F.lit(True)
    rows = F.array_compact(F.array(
        check("DEB-001", ~geo, F.when(leo, controlled | (c("lifetime_years") <= limit)).otherwise(c("disposal_plan").isin("disposal-orbit", "controlled-reentry", "graveyard")), F.when(leo, "high").otherwise("medium")),
        check("DEB-005", geo, (c("disposal_plan") == "graveyard") & (c("disposal_perigee_raise_km") >= raise_min), "high"),
        check("DEB-002", yes, c("passivation_plan"), "high"), check("DEB-003", yes, ~populated | c("maneuverable"), "high"),
        check("DEB-004", c("disposal_plan").isin("natural-decay", "controlled-reentry") | leo, casualty, "high"),
        check("DEB-006", yes, c("trackable"), "medium"), check("DEB-007", yes, c("planned_releases") == 0, "medium"),
        check("DEB-008", c("constellation_size") >= 100, F.coalesce("disposal_reliability", F.lit(0.0)) >= 0.99, "high")))
    r = m.withColumn("_r", F.explode(rows)).select("name", "regime", "_r.*")
    status = F.when(c("ok").isNull(), "unknown").when(c("ok"), "pass").otherwise("fail")
    return r.select("name", "regime", "rule_id", status.alias("status"), F.when(c("ok").isNull(), "low").when(~c("ok"), c("sev")).alias("severity"))
