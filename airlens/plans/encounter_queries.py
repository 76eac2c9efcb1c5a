"""Encounters, density and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.operators import density as dens
from airlens.operators import encounters as enc
from airlens.operators.quantiles import quantiles
from airlens.plans import bridge
from airlens.plans.registry import query

c = F.col

_R2 = "(sx + vx * {t}) * (sx + vx * {t}) + (sy + vy * {t}) * (sy + vy * {t})"
_SV = "((sx + vx * {t}) * vx + (sy + vy * {t}) * vy)"
_HMD = "sqrt(pow(sx + vx * ({t} + CASE WHEN vx * vx + vy * vy < 1e-9 THEN 0 ELSE greatest(0, -{sv} / (vx * vx + vy * vy)) END), 2) + pow(sy + vy * ({t} + CASE WHEN vx * vx + vy * vy < 1e-9 THEN 0 ELSE greatest(0, -{sv} / (vx * vx + vy * vy)) END), 2))"


def _viol(t: str, z: int) -> str:
    r2, sv = _R2.format(t=t), _SV.format(t=t)
    hmd = _HMD.format(t=t, sv=sv)
    return f"(({r2} <= 16000000 OR ({sv} < 0 AND (16000000 - ({r2})) / {sv} <= 35 AND {hmd} <= 4000)) AND abs(dz + vz * {t}) <= {z})"


_GEOM = "(60.0 * 6076.1155)"
SAMPLES = f"""
air AS (SELECT *, trim(coalesce(callsign, '')) AS cs FROM st WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT on_ground AND gs_kt IS NOT NULL AND track_deg IS NOT NULL AND baro_alt_ft > 500),
e0 AS (SELECT a.recording, a.batch_seq, a.batch_ts, a.region, a.icao24 AS a, b.icao24 AS b, a.cs AS a_callsign, b.cs AS b_callsign, a.pos AS pos_a, b.pos AS pos_b, a.baro_alt_ft AS alt_ft,
         b.baro_alt_ft - a.baro_alt_ft AS dz, (coalesce(b.vrate_fpm, 0) - coalesce(a.vrate_fpm, 0)) / 60.0 AS vz,
         (b.lon - a.lon) * {_GEOM} * cos(radians((a.lat + b.lat) / 2)) AS sx, (b.lat - a.lat) * {_GEOM} AS sy,
         (b.gs_kt * sin(radians(b.track_deg)) - a.gs_kt * sin(radians(a.track_deg))) * 6076.1155 / 3600 AS vx,
         (b.gs_kt * cos(radians(b.track_deg)) - a.gs_kt * cos(radians(a.track_deg))) * 6076.1155 / 3600 AS vy
       FROM air AS a JOIN air AS b ON a.recording = b.recording AND a.batch_seq = b.batch_seq AND a.icao24 < b.icao24
        AND abs(trunc(a.lat / 0.2) - trunc(b.lat / 0.2)) <= 1 AND abs(trunc(a.lon / 0.2) - trunc(b.lon / 0.2)) <= 1
       WHERE abs(b.baro_alt_ft - a.baro_alt_ft) <= 3000),
e1 AS (SELECT *, sqrt(sx * sx + sy * sy) AS rng FROM e0 WHERE sqrt(sx * sx + sy * sy) / 6076.1155 <= 10),
e2 AS (SELECT *, list_min(list_filter(range(0, 56), lambda t: {_viol('t', 700)})) AS t_preventive, list_min(list_filter(range(0, 56), lambda t: {_viol('t', 450)})) AS t_corrective FROM e1),
es AS (SELECT *, round(rng, 1) AS range_ft, round({_HMD.format(t='0', sv=_SV.format(t='0'))}, 1) AS hmd_ft,
         round(CASE WHEN rng * rng <= 16000000 THEN 0 WHEN {_SV.format(t='0')} < 0 THEN (16000000 - ({_R2.format(t='0')})) / {_SV.format(t='0')} END, 1) AS tau_mod_s,
         round(-{_SV.format(t='0')} / rng, 2) AS closure_ftps, round(dz, 1) AS dz_ft, NOT {_viol('0', 450)} AS well_clear,
         CASE WHEN t_corrective <= 25 THEN 3 WHEN t_corrective IS NOT NULL THEN 2 WHEN t_preventive IS NOT NULL THEN 1 ELSE 0 END AS alert_level FROM e2)"""
PAIRS = """
ep AS (SELECT recording, a, b, count(*) AS samples, min(range_ft) AS min_range_ft, round(min(abs(dz_ft)), 1) AS min_dz_ft, min(hmd_ft) AS min_hmd_ft, bool_or(NOT well_clear) AS violation,
         bool_or(range_ft <= 500 AND abs(dz_ft) <= 100) AS nmac_proximate, max(alert_level) AS max_alert,
         round(min(batch_ts) FILTER (NOT well_clear) - min(batch_ts) FILTER (alert_level > 0), 1) AS lead_time_s, min(batch_ts) AS first_ts, min(batch_ts) FILTER (NOT well_clear) AS violation_ts,
         arg_min(coalesce(nullif(a_callsign, ''), a) || ' / ' || coalesce(nullif(b_callsign, ''), b), batch_seq * 1000000 + pos_a * 1000 + pos_b) AS callsigns
       FROM es GROUP BY ALL)"""
HOURS = """
fh AS (SELECT recording, count(*) AS aircraft_airborne, round(sum(t1 - t0) / 3600, 2) AS flight_hours FROM
  (SELECT recording, icao24, arg_min(ts, batch_seq * 1000 + pos) AS t0, arg_max(ts, batch_seq * 1000 + pos) AS t1 FROM air GROUP BY ALL) AS q GROUP BY ALL)"""
RECS = """
er AS (SELECT fh.*, coalesce(encounter_pairs, 0) AS encounter_pairs, coalesce(pairs_with_alert, 0) AS pairs_with_alert, coalesce(violations, 0) AS violations, coalesce(nmac, 0) AS nmac_proximate,
         med AS median_lead_time_s, round(coalesce(violations, 0) / nullif(flight_hours, 0), 4) AS violations_per_flight_hour, round(coalesce(nmac, 0) / nullif(flight_hours, 0), 4) AS nmac_per_flight_hour
       FROM fh LEFT JOIN (SELECT recording, count(*) AS encounter_pairs, count(*) FILTER (max_alert > 0) AS pairs_with_alert, count(*) FILTER (violation) AS violations, count(*) FILTER (nmac_proximate) AS nmac,
          list_sort(list(lead_time_s) FILTER (violation AND lead_time_s IS NOT NULL))[CAST(floor(count(lead_time_s) FILTER (violation) / 2) AS INT) + 1] AS med FROM ep GROUP BY ALL) AS q USING (recording))"""
_BASE = "WITH RECURSIVE " + bridge.states_cte() + "," + SAMPLES
_E = f"{_BASE},{PAIRS}"


@query("encounter_samples", f"{_BASE} SELECT recording, batch_seq, a, b, count(*) AS weight, range_ft, hmd_ft, tau_mod_s, closure_ftps, dz_ft, well_clear, alert_level, t_preventive, t_corrective FROM es GROUP BY ALL")
def encounter_samples(spark: SparkSession, sf: str) -> DataFrame:
    """JON-03 and SCL-07 to SCL-10."""
    key = ["recording", "batch_seq", "a", "b", "range_ft", "hmd_ft", "tau_mod_s", "closure_ftps", "dz_ft", "well_clear", "alert_level", "t_preventive", "t_corrective"]
    return enc.samples(bridge.states(spark, sf)).groupBy(*key).agg(F.sum("weight").alias("weight")).withColumn("t_preventive", c("t_preventive").cast("long")).withColumn("t_corrective", c("t_corrective").cast("long"))


_PAIR_COLS = ["recording", "a", "b", "samples", "min_range_ft", "min_dz_ft", "min_hmd_ft", "violation", "nmac_proximate", "max_alert", "lead_time_s", "first_ts", "callsigns"]


@query("encounter_pairs", f"{_E} SELECT {', '.join(_PAIR_COLS)} FROM ep")
def encounter_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-09."""
    return enc.pair_summary(enc.samples(bridge.states(spark, sf))).select(*_PAIR_COLS)


@query("encounter_pairs_ranked", f"{_E} SELECT {', '.join(_PAIR_COLS)} FROM ep ORDER BY violation DESC, min_range_ft, recording, a, b LIMIT 200")
def encounter_pairs_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-04: the report's two hundred pairs, violations first."""
    p = enc.pair_summary(enc.samples(bridge.states(spark, sf))).select(*_PAIR_COLS)
    return p.orderBy(F.desc("violation"), "min_range_ft", "recording", "a", "b").limit(200)


@query("encounter_rates", f"{_E},{HOURS},{RECS} SELECT * FROM er")
def encounter_rates(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-10."""
    st = bridge.states(spark, sf)
    return enc.recording_summary(st, enc.pair_summary(enc.samples(st))).drop("first_pair_ts")


@query("rule_well_clear", f"""{_E} SELECT recording, a AS icao24, a || ':' || b AS pair, violation_ts AS ts, 'DAA-001' AS rule_id, CASE WHEN nmac_proximate THEN 'high' ELSE 'medium' END AS severity, min_range_ft AS measure, 'safety' AS category
  FROM ep WHERE violation UNION ALL SELECT recording, a, a || ':' || b, violation_ts, 'DAA-002', 'medium', lead_time_s, 'safety' FROM ep WHERE violation AND lead_time_s < 25""")
def rule_well_clear(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-28."""
    return enc.findings(enc.pair_summary(enc.samples(bridge.states(spark, sf))))


@query("observed_risk_ratio", f"""{_E}, rr AS (SELECT recording, count(*) AS encounters, count(*) FILTER (nmac_proximate) AS nmac_proximate, count(*) FILTER (nmac_proximate AND (lead_time_s IS NULL OR lead_time_s < 25)) AS unresolvable FROM ep GROUP BY ALL)
  SELECT *, round(unresolvable / nullif(nmac_proximate, 0), 3) AS risk_ratio, coalesce(round(unresolvable / nullif(nmac_proximate, 0), 3) > 0.2, FALSE) AS above_limit FROM rr""")
def observed_risk_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-11 and RUL-29: over all pairs."""
    r = enc.risk_ratio(enc.pair_summary(enc.samples(bridge.states(spark, sf))))
    return r.withColumn("above_limit", F.coalesce(c("risk_ratio") > dens.RISK_RATIO_LIMIT, F.lit(False)))


@query("encounter_trend", f"""{_E},{HOURS},{RECS}, tr AS (SELECT er.*, coalesce(q.first_ts, p.bts) AS first_ts FROM er LEFT JOIN (SELECT recording, min(first_ts) AS first_ts FROM ep GROUP BY ALL) AS q USING (recording)
     JOIN (SELECT recording, min(batch_ts) AS bts FROM st GROUP BY ALL) AS p USING (recording)),
  tv AS (SELECT coalesce(violations_per_flight_hour, 0) AS y, first_ts FROM tr)
  SELECT count(*) AS recordings, round(regr_slope(y, first_ts / 86400), 4) AS slope, round(arg_min(y, first_ts), 4) AS first_rate, round(arg_max(y, first_ts), 4) AS last_rate,
   coalesce(count(*) >= 3 AND regr_slope(y, first_ts / 86400) > 0 AND (arg_min(y, first_ts) = 0 OR arg_max(y, first_ts) >= 1.5 * arg_min(y, first_ts)) AND arg_max(y, first_ts) > 0, FALSE) AS rising FROM tv""")
def encounter_trend(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-12 and RUL-30."""
    st = bridge.states(spark, sf)
    starts = st.groupBy("recording").agg(F.min("batch_ts").alias("_b"))
    rows = enc.recording_summary(st, enc.pair_summary(enc.samples(st))).join(starts, "recording").withColumn("first_ts", F.coalesce("first_pair_ts", "_b"))
    return enc.trend(rows).select("recordings", F.round("slope", 4).alias("slope"), F.round("first_rate", 4).alias("first_rate"), F.round("last_rate", 4).alias("last_rate"), "rising")


_BAND = "CASE WHEN a < -1000 THEN 'above-10000' WHEN a < 1200 THEN 'surface-1200' WHEN a < 3000 THEN '1200-3000' WHEN a < 10000 THEN '3000-10000' ELSE 'above-10000' END"
DENSITY = f"""
d0 AS (SELECT *, lag(ts) OVER (PARTITION BY recording, icao24 ORDER BY batch_seq, pos) AS p, coalesce(baro_alt_ft, 0) AS a FROM st WHERE NOT on_ground AND lat IS NOT NULL AND lon IS NOT NULL),
d1 AS (SELECT recording, CAST(trunc(lat / 0.2) AS BIGINT) AS cell_lat, CAST(trunc(lon / 0.2) AS BIGINT) AS cell_lon, {_BAND} AS band, sum(CASE WHEN p IS NULL THEN 0 ELSE least(greatest(ts - p, 0), 120) END) / 3600 AS aircraft_hours FROM d0 GROUP BY ALL),
d2 AS (SELECT d1.*, aircraft_hours / span_h / (12 * (12 * greatest(cos(radians((cell_lat + 0.5) * 0.2)), 0.05)) / 100) AS per_100nm2_h
       FROM d1 JOIN (SELECT recording, greatest((max(ts) - min(ts)) / 3600, 1e-6) AS span_h FROM d0 GROUP BY ALL) AS q USING (recording)),
dn AS (SELECT *, CASE WHEN per_100nm2_h < 0.05 THEN 'sparse' WHEN per_100nm2_h < 0.5 THEN 'moderate' WHEN per_100nm2_h < 5 THEN 'dense' ELSE 'very-dense' END AS class FROM d2)"""
_DBASE = "WITH RECURSIVE " + bridge.states_cte() + "," + DENSITY
_DCOLS = "recording, cell_lat, cell_lon, band, round(aircraft_hours, 4) AS aircraft_hours, round(per_100nm2_h, 4) AS per_100nm2_h, class"


def _density(spark: SparkSession, sf: str) -> DataFrame:
    return dens.density(bridge.states(spark, sf)).select("recording", "cell_lat", "cell_lon", "band", F.round("aircraft_hours", 4).alias("aircraft_hours"), F.round("per_100nm2_h", 4).alias("per_100nm2_h"), "class")


@query("traffic_density", f"{_DBASE} SELECT {_DCOLS} FROM dn")
def traffic_density(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-11."""
    return _density(spark, sf)


@query("density_top_cells", f"{_DBASE} SELECT {_DCOLS} FROM dn ORDER BY round(per_100nm2_h, 4) DESC, recording, cell_lat, cell_lon, band LIMIT 500")
def density_top_cells(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-05."""
    return _density(spark, sf).orderBy(F.desc("per_100nm2_h"), "recording", "cell_lat", "cell_lon", "band").limit(500)


@query("density_bands", f"""{_DBASE} SELECT *, band IN ('surface-1200', '1200-3000') AND dense + very_dense > 0 AS low_dense FROM (SELECT recording, band, round(sum(aircraft_hours), 3) AS aircraft_hours, count(*) AS cells,
  count(*) FILTER (class = 'sparse') AS sparse, count(*) FILTER (class = 'moderate') AS moderate, count(*) FILTER (class = 'dense') AS dense, count(*) FILTER (class = 'very-dense') AS very_dense FROM dn GROUP BY ALL) AS q""")
def density_bands(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-11 roll-up and RUL-29 (dense cells below 3,000 ft)."""
    d = dens.density(bridge.states(spark, sf))
    n = lambda k: F.count_if(c("class") == k)
    return d.groupBy("recording", "band").agg(
        F.round(F.sum("aircraft_hours"), 3).alias("aircraft_hours"), F.count(F.lit(1)).alias("cells"), n("sparse").alias("sparse"), n("moderate").alias("moderate"), n("dense").alias("dense"), n("very-dense").alias("very_dense"),
    ).withColumn("low_dense", c("band").isin("surface-1200", "1200-3000") & (c("dense") + c("very_dense") > 0))


@query("encounter_model_marginals", f"""{_BASE}, f AS (SELECT * FROM es QUALIFY row_number() OVER (PARTITION BY recording, a, b ORDER BY batch_seq, pos_a, pos_b) = 1)
  SELECT count(*) AS encounters, round(quantile_cont(range_ft, 0.1), 2) AS range_p10, round(quantile_cont(range_ft, 0.5), 2) AS range_p50, round(quantile_cont(range_ft, 0.9), 2) AS range_p90,
   round(quantile_cont(abs(dz_ft), 0.1), 2) AS dz_p10, round(quantile_cont(abs(dz_ft), 0.5), 2) AS dz_p50, round(quantile_cont(abs(dz_ft), 0.9), 2) AS dz_p90, round(quantile_cont(abs(coalesce(closure_ftps, 0)), 0.5), 3) AS speed_p50, round(avg(CAST(tau_mod_s IS NOT NULL AS INT)), 4) AS converging_share FROM f HAVING count(*) >= 5""")
def encounter_model_marginals(spark: SparkSession, sf: str) -> DataFrame:
    """ML-12: marginals of the first sample of every pair, from five pairs on; converging: the modified tau is known."""
    s = enc.samples(bridge.states(spark, sf))
    first = s.groupBy("recording", "a", "b").agg(F.min_by(F.struct("range_ft", "dz_ft", "closure_ftps", "tau_mod_s"), F.struct("batch_seq", "pos_a", "pos_b")).alias("f")).select("f.*")
    sides = {"range": c("range_ft"), "dz": F.abs("dz_ft"), "speed": F.abs(F.coalesce("closure_ftps", F.lit(0.0)))}
    long = first.select(F.inline(F.array(*[F.struct(F.lit(n).alias("side"), x.cast("double").alias("x")) for n, x in sides.items()])))
    at = quantiles(long, ["side"], "x", [0.1, 0.5, 0.9])
    asked = [("range", 0, "range_p10", 2), ("range", 1, "range_p50", 2), ("range", 2, "range_p90", 2), ("dz", 0, "dz_p10", 2), ("dz", 1, "dz_p50", 2), ("dz", 2, "dz_p90", 2), ("speed", 1, "speed_p50", 3)]
    marks = at.agg(*[F.round(F.max(F.when(c("side") == n, F.get("quantiles", F.lit(i)))), d).alias(name) for n, i, name, d in asked])
    counts = first.agg(F.count(F.lit(1)).alias("encounters"), F.round(F.avg(c("tau_mod_s").isNotNull().cast("int")), 4).alias("converging_share")).filter("encounters >= 5")
    return counts.join(F.broadcast(marks))  # a row each


_PROP = f"list_min(list_filter(range(0, 301), lambda t: {_viol('t', 450)}))"
_NMACT = f"list_min(list_filter(range(0, 301), lambda t: {_R2.format(t='t')} <= 250000 AND abs(dz + vz * t) <= 100))"


_OC = f"""{_BASE}, f AS (SELECT * FROM es QUALIFY row_number() OVER (PARTITION BY recording, a, b ORDER BY batch_seq, pos_a, pos_b) = 1),
o0 AS (SELECT recording, a, b, {_PROP} AS violation_t, {_NMACT} AS nmac_t, -(sx * vx + sy * vy) / nullif(vx * vx + vy * vy, 0) AS closest_t FROM f),
oc AS (SELECT recording, a, b, violation_t, nmac_t, round(closest_t, 3) AS closest_t, nmac_t IS NOT NULL AND (violation_t IS NULL OR coalesce(closest_t, 0) - violation_t < 25) AS nmac_unresolved FROM o0)"""


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    from airlens.functions import wellclear as wc

    s = enc.samples(bridge.states(spark, sf))
    f = s.groupBy("recording", "a", "b").agg(F.min_by(F.struct("sx", "sy", "vx", "vy", "dz", "vz"), F.struct("batch_seq", "pos_a", "pos_b")).alias("f")).select("recording", "a", "b", "f.*")
    v = [c(n) for n in ("sx", "sy", "vx", "vy")]
    near = F.filter(F.sequence(F.lit(0), F.lit(300)), lambda t: (F.pow(c("sx") + c("vx") * t, 2) + F.pow(c("sy") + c("vy") * t, 2) <= enc.NMAC_H_FT**2) & (F.abs(c("dz") + c("vz") * t) <= enc.NMAC_V_FT))
    f = f.withColumn("violation_t", wc.first_violation(*v, c("dz"), c("vz"), wc.ZTHR_FT, 300).cast("long")).withColumn("nmac_t", F.get(near, 0).cast("long"))
    f = f.withColumn("closest_t", F.try_divide(-(c("sx") * c("vx") + c("sy") * c("vy")), F.nullif(c("vx") * c("vx") + c("vy") * c("vy"), F.lit(0.0))))
    late = c("violation_t").isNull() | (F.coalesce("closest_t", F.lit(0.0)) - c("violation_t") < 25)
    return f.select("recording", "a", "b", "violation_t", "nmac_t", F.round("closest_t", 3).alias("closest_t"), (c("nmac_t").isNotNull() & late).alias("nmac_unresolved"))


@query("encounter_outcomes", f"{_OC} SELECT * FROM oc")
def encounter_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """ML-13: straight-line outcome of every encounter within five minutes; a close one is resolved when its violation
    is projected 25 s or more before the closest point."""
    return _outcomes(spark, sf)


@query("encounter_risk_ratio", f"{_OC} SELECT recording, count(*) AS encounters, count(violation_t) AS violations, count(nmac_t) AS nmac_unmitigated, count(*) FILTER (nmac_unresolved) AS nmac_mitigated, round(count(*) FILTER (nmac_unresolved) / nullif(count(nmac_t), 0), 3) AS risk_ratio FROM oc GROUP BY ALL")
def encounter_risk_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """ML-13: close encounters left over by a manoeuvre in time, over all of them."""
    o = _outcomes(spark, sf).groupBy("recording").agg(F.count(F.lit(1)).alias("encounters"), F.count("violation_t").alias("violations"), F.count("nmac_t").alias("nmac_unmitigated"), F.count_if("nmac_unresolved").alias("nmac_mitigated"))
    return o.withColumn("risk_ratio", F.round(F.try_divide("nmac_mitigated", "nmac_unmitigated"), 3))
