"""Restricted volumes, launch windows, two feeds, watchlists, space-weather exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.operators import airspace as asp
from airlens.operators import corroborate as cor
from airlens.operators import watchlist as wl
from airlens.operators import spaceweather as swx
from airlens.plans import bridge, places
from airlens.plans import sqlbase as S
from airlens.plans.registry import query

c = F.col
_FLY = "fly AS (SELECT * FROM st WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT on_ground)"
_HITS = f"""hit AS (SELECT f.*, v.notam_id, v.effective_ts, v.expire_ts, {places.ACTIVE.format(ts='f.ts')} AS is_active FROM fly AS f JOIN vol AS v
  ON f.lat BETWEEN v.clat - 0.4 AND v.clat + 0.4 AND {places.inside_sql('f.lat', 'f.lon')}
  WHERE NOT coalesce(f.baro_alt_ft < v.lower_ft, FALSE) AND NOT coalesce(f.baro_alt_ft > v.upper_ft, FALSE))"""
_BASE = f"WITH RECURSIVE {bridge.states_cte()}, {_FLY}, {places.VOL_CTE}, {_HITS}"


def _hits(spark: SparkSession, sf: str, only_active: bool = False) -> DataFrame:
    return asp.traffic_inside(bridge.states(spark, sf), places.volumes(spark, sf), only_active)


@query("restricted_traffic", f"{_BASE} SELECT recording, batch_seq, pos, icao24, notam_id, is_active FROM hit")
def restricted_traffic(spark: SparkSession, sf: str) -> DataFrame:
    """JON-04 and SCL-06."""
    return _hits(spark, sf).select("recording", "batch_seq", "pos", "icao24", "notam_id", "is_active")


@query("restricted_dwell", f"""{_BASE} SELECT recording, notam_id, icao24, arg_min(ts, batch_seq * 1000 + pos) AS first_ts, max(ts) AS last_ts, count(*) AS samples,
  arg_max(baro_alt_ft, batch_seq * 1000 + pos) FILTER (baro_alt_ft IS NOT NULL) AS alt_ft FROM hit WHERE is_active GROUP BY ALL""")
def restricted_dwell(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-14."""
    return asp.dwell(_hits(spark, sf, only_active=True))


@query("rule_restricted_volume", f"""{_BASE} SELECT recording, notam_id, count(DISTINCT icao24) FILTER (is_active) AS aircraft_active, count(DISTINCT icao24) FILTER (NOT is_active) AS aircraft_outside,
  CASE WHEN count(DISTINCT icao24) FILTER (is_active) > 0 THEN 'TFR-001' END AS rule_id FROM hit GROUP BY ALL""")
def rule_restricted_volume(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-34 (entries) with the baseline outside the times."""
    per = asp.aircraft_inside(bridge.states(spark, sf), places.volumes(spark, sf), ["recording", "notam_id"])
    return per.withColumnsRenamed({"during": "aircraft_active", "outside": "aircraft_outside"}).withColumn("rule_id", F.when(c("aircraft_active") > 0, "TFR-001"))


@query("space_restrictions", f"""{_BASE} SELECT v.notam_id, v.type, v.effective_ts, v.expire_ts, count(DISTINCT h.recording) AS recordings, count(DISTINCT CASE WHEN is_active THEN (h.recording, h.icao24) END) AS aircraft_active, count(DISTINCT CASE WHEN NOT is_active THEN (h.recording, h.icao24) END) AS aircraft_outside
  FROM vol AS v LEFT JOIN hit AS h ON h.notam_id = v.notam_id WHERE v.type = 'SPACE OPERATIONS' GROUP BY ALL""")
def space_restrictions(spark: SparkSession, sf: str) -> DataFrame:
    """JON-04: the volumes of space operations, those that nobody entered too."""
    return asp.volume_rows(asp.of_types(places.volumes(spark, sf)), bridge.states(spark, sf))


@query("space_covered_windows", f"""WITH {places.LCH_CTE}, {places.VOL_CTE} SELECT l.launch_id, count(v.notam_id) AS volumes FROM lch AS l LEFT JOIN vol AS v ON v.type = 'SPACE OPERATIONS' AND (v.effective_ts IS NULL OR v.effective_ts <= l.w1) AND (v.expire_ts IS NULL OR v.expire_ts >= l.w0)
  AND ({places.inside_sql('l.pad_lat', 'l.pad_lon')} OR {S.planar('l.pad_lat', 'l.pad_lon', 'v.clat', 'v.clon')} <= 30) GROUP BY ALL""")
def space_covered_windows(spark: SparkSession, sf: str) -> DataFrame:
    """JON-06: launches with the restrictions of space operations that cover their windows, none included."""
    l = places.launches(spark, sf)
    cov = asp.covering_counts(l, asp.of_types(places.volumes(spark, sf)))
    return asp.launch_windows(l).select("launch_id").join(cov, "launch_id", "left").fillna(0, ["volumes"])


@query("restricted_displacement", f"""{_BASE}, per AS (SELECT recording, notam_id, effective_ts, expire_ts, count(DISTINCT icao24) FILTER (is_active) AS inside_during, count(DISTINCT icao24) FILTER (NOT is_active) AS inside_outside FROM hit GROUP BY ALL),
  mins AS (SELECT v.recording, v.notam_id, v.inside_during, v.inside_outside, count(DISTINCT CASE WHEN {places.ACTIVE.format(ts='f.ts')} THEN floor(f.ts / 60) END) AS minutes_during,
    count(DISTINCT CASE WHEN NOT {places.ACTIVE.format(ts='f.ts')} THEN floor(f.ts / 60) END) AS minutes_outside FROM per AS v JOIN fly AS f USING (recording) GROUP BY ALL)
  SELECT recording, notam_id, minutes_during, minutes_outside, inside_during, inside_outside, round(inside_during / nullif(minutes_during, 0), 3) AS rate_during, round(inside_outside / nullif(minutes_outside, 0), 3) AS rate_outside,
   round((inside_during / nullif(minutes_during, 0)) / nullif(inside_outside / nullif(minutes_outside, 0), 0), 3) AS displacement_ratio FROM mins""")
def restricted_displacement(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-13."""
    return asp.displacement(bridge.states(spark, sf), places.volumes(spark, sf))


@query("restriction_summary", f"WITH {places.VOL_CTE} SELECT type, count(*) AS features, count(*) FILTER (round_shape) AS circles, count(*) FILTER (NOT round_shape) AS polygons, count(*) FILTER ({places.ACTIVE.format(ts=places.NOW).replace('v.', '')}) AS active_now FROM vol GROUP BY ALL")
def restriction_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-34."""
    v = places.volumes(spark, sf)
    return v.groupBy("type").agg(F.count(F.lit(1)).alias("features"), F.count_if(c("circle").isNotNull()).alias("circles"), F.count_if(c("polygon").isNotNull()).alias("polygons"), F.count_if(asp.active(F.lit(places.NOW))).alias("active_now"))


@query("rule_restriction_stale", f"""WITH {places.VOL_CTE}, sv AS (SELECT concat('R', s_suppkey) AS notam_id, s_nationkey AS product FROM supplier) SELECT product, count(*) AS active, round(any_value(age) / 3600, 1) AS age_h, 'TFR-003' AS rule_id, 'low' AS severity
  FROM (SELECT sv.product, sv.product * 1800.0 AS age FROM vol AS v JOIN sv USING (notam_id) WHERE {places.ACTIVE.format(ts=places.NOW)}) AS q WHERE age > 21600 GROUP BY ALL""")
def rule_restriction_stale(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-34 (stale product): a nation's volumes are a product."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("R"), c("s_suppkey").cast("string")).alias("notam_id"), c("s_nationkey").alias("product"))
    n = spark.read.parquet(f"{sf}/nation.parquet").select(c("n_nationkey").alias("product"), (places.NOW - c("n_nationkey") * 1800.0).alias("fetched_ts"))
    return asp.stale_products(places.volumes(spark, sf).join(s, "notam_id"), n, places.NOW)


_NEAR = f"""near AS (SELECT f.*, l.launch_id, {S.planar('f.lat', 'f.lon', 'l.pad_lat', 'l.pad_lon')} AS nm, f.ts BETWEEN l.w0 AND l.w1 AS in_window FROM fly AS f JOIN lch AS l
  ON abs(f.lat - l.pad_lat) <= 1 WHERE {S.planar('f.lat', 'f.lon', 'l.pad_lat', 'l.pad_lon')} <= 50)"""
_LB = f"WITH RECURSIVE {bridge.states_cte()}, {_FLY}, {places.LCH_CTE}, {_NEAR}"


def _in_windows(spark: SparkSession, sf: str) -> DataFrame:
    return asp.traffic_in_windows(bridge.states(spark, sf), places.launches(spark, sf))


@query("launch_exposure", f"{_LB} SELECT recording, launch_id, count(DISTINCT icao24) FILTER (in_window) AS aircraft_in_window, count(DISTINCT icao24) FILTER (NOT in_window) AS aircraft_outside_window FROM near GROUP BY ALL")
def launch_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """JON-05."""
    return asp.launch_exposure(bridge.states(spark, sf), places.launches(spark, sf))


@query("launch_closest_aircraft", f"""{_LB}, best AS (SELECT * FROM near WHERE in_window QUALIFY row_number() OVER (PARTITION BY recording, launch_id, icao24 ORDER BY nm, batch_seq, pos) = 1)
  SELECT recording, launch_id, icao24, round(nm, 3) AS nm, baro_alt_ft, ts, row_number() OVER (PARTITION BY recording, launch_id ORDER BY nm, icao24) AS rank FROM best QUALIFY rank <= 10""")
def launch_closest_aircraft(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-06."""
    return asp.closest_per_launch(_in_windows(spark, sf)).select("recording", "launch_id", "icao24", F.round("nm", 3).alias("nm"), "baro_alt_ft", "ts", c("rank").cast("long").alias("rank"))


@query("rule_launch_window", f"""{_LB}, box AS (SELECT recording, min(ts) AS t0, max(ts) AS t1, min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM fly GROUP BY ALL)
  SELECT recording, launch_id, 'LCH-001' AS rule_id, 'medium' AS severity, CAST(count(DISTINCT icao24) AS DOUBLE) AS measure FROM near WHERE in_window GROUP BY ALL
  UNION ALL SELECT NULL, launch_id, 'LCH-002', 'low', round(({places.NOW} - last_updated) / 3600, 1) FROM lch WHERE {places.NOW} - last_updated > 86400 AND w0 <= {places.NOW} AND w1 >= {places.NOW}
  UNION ALL SELECT recording, launch_id, 'LCH-003', 'low', 1 FROM lch JOIN box ON w0 <= t1 AND w1 >= t0 WHERE NOT (pad_lat BETWEEN a0 - 1 AND a1 + 1 AND pad_lon BETWEEN o0 - 1 AND o1 + 1)""")
def rule_launch_window(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-33."""
    return asp.launch_findings(bridge.states(spark, sf), places.launches(spark, sf), _in_windows(spark, sf), places.NOW)


_COV = f"""cov AS (SELECT l.launch_id, v.notam_id FROM lch AS l JOIN vol AS v ON (v.effective_ts IS NULL OR v.effective_ts <= l.w1) AND (v.expire_ts IS NULL OR v.expire_ts >= l.w0)
  WHERE {places.inside_sql('l.pad_lat', 'l.pad_lon')} OR {S.planar('l.pad_lat', 'l.pad_lon', 'v.clat', 'v.clon')} <= 30)"""


@query("launch_covering_volumes", f"WITH {places.LCH_CTE}, {places.VOL_CTE}, {_COV} SELECT * FROM cov")
def launch_covering_volumes(spark: SparkSession, sf: str) -> DataFrame:
    """JON-06."""
    return asp.covering(places.launches(spark, sf), places.volumes(spark, sf))


@query("rule_launch_uncovered", f"""WITH {places.LCH_CTE}, {places.VOL_CTE}, {_COV}, q AS (SELECT l.*, coalesce(n, 0) AS volumes, contains(lower(location), 'usa') AS us_airspace, w1 >= {places.NOW} AND w0 - {places.NOW} <= 259200 AS within_lookahead
   FROM lch AS l LEFT JOIN (SELECT launch_id, count(*) AS n FROM cov GROUP BY ALL) AS k USING (launch_id))
  SELECT launch_id, volumes, us_airspace, within_lookahead, us_airspace AND within_lookahead AND volumes = 0 AND lower(status) NOT IN ('hold', 'tbd', 'scrubbed', 'failure', 'success', 'partial failure') AS uncovered FROM q""")
def rule_launch_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-34 (gaps)."""
    return asp.launches_covered(places.launches(spark, sf), places.volumes(spark, sf), places.NOW)


_CMP = f"""sa AS (SELECT * FROM st WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT on_ground QUALIFY row_number() OVER (PARTITION BY recording, batch_seq, icao24 ORDER BY pos DESC) = 1),
sb AS (SELECT * FROM st2 WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT on_ground QUALIFY row_number() OVER (PARTITION BY recording, batch_seq, icao24 ORDER BY pos DESC) = 1),
j AS (SELECT coalesce(a.recording, b.recording) AS recording, coalesce(a.batch_seq, b.batch_seq) AS batch_seq, coalesce(a.icao24, b.icao24) AS icao24, a.icao24 AS ia, b.icao24 AS ib, abs(a.ts - b.ts) AS dt_s,
   CASE WHEN a.ts < b.ts THEN a.ts ELSE b.ts END AS ots, CASE WHEN a.ts < b.ts THEN a.lat ELSE b.lat END AS olat, CASE WHEN a.ts < b.ts THEN a.lon ELSE b.lon END AS olon, CASE WHEN a.ts < b.ts THEN a.gs_kt ELSE b.gs_kt END AS ogs,
   CASE WHEN a.ts < b.ts THEN a.track_deg ELSE b.track_deg END AS otrk, CASE WHEN a.ts < b.ts THEN b.ts ELSE a.ts END AS nts, CASE WHEN a.ts < b.ts THEN b.lat ELSE a.lat END AS nlat, CASE WHEN a.ts < b.ts THEN b.lon ELSE a.lon END AS nlon
  FROM sa AS a FULL OUTER JOIN sb AS b ON a.recording = b.recording AND a.batch_seq = b.batch_seq AND a.icao24 = b.icao24),
k AS (SELECT *, olat + CASE WHEN ogs IS NULL OR otrk IS NULL THEN 0 ELSE ogs * (nts - ots) / 3600 * cos(radians(otrk)) / 60 END AS mlat,
   olon + CASE WHEN ogs IS NULL OR otrk IS NULL THEN 0 ELSE ogs * (nts - ots) / 3600 * sin(radians(otrk)) / (60 * greatest(cos(radians(olat)), 0.1)) END AS mlon FROM j),
m AS (SELECT *, CASE WHEN dt_s <= 90 THEN {S.hav('mlat', 'mlon', 'nlat', 'nlon')} END AS sep, 1.5 + 60 * dt_s / 3600 AS allowed FROM k),
cmp AS (SELECT *, CASE WHEN ib IS NULL THEN 'only_primary' WHEN ia IS NULL THEN 'only_secondary' WHEN sep IS NULL THEN 'too_far_apart' WHEN sep > allowed THEN 'disagree' ELSE 'matched' END AS status FROM m)"""
_CB = f"WITH RECURSIVE {bridge.states_cte()}, {bridge.second_cte()}, {_CMP}"


def _compare(spark: SparkSession, sf: str) -> DataFrame:
    return cor.compare(bridge.states(spark, sf), bridge.second_feed(spark, sf))


@query("feed_comparison", f"{_CB} SELECT recording, batch_seq, icao24, status, round(sep, 4) AS separation_nm, round(allowed, 4) AS allowed_nm FROM cmp")
def feed_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """JON-02."""
    return _compare(spark, sf).select("recording", "batch_seq", "icao24", "status", F.round("separation_nm", 4).alias("separation_nm"), F.round("allowed_nm", 4).alias("allowed_nm"))


@query("rule_feed_disagreement", f"{_CB} SELECT recording, batch_seq, icao24, nts AS ts, 'SEC-015' AS rule_id, CASE WHEN sep > 4 * allowed THEN 'high' ELSE 'medium' END AS severity, 'security' AS category, round(sep, 2) AS measure FROM cmp WHERE status = 'disagree'")
def rule_feed_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-08."""
    return cor.findings(_compare(spark, sf))


@query("feed_comparison_summary", f"""{_CB} SELECT recording, count(*) FILTER (status IN ('matched', 'disagree')) AS matched, count(*) FILTER (status = 'only_primary') AS only_primary, count(*) FILTER (status = 'only_secondary') AS only_secondary,
  count(*) FILTER (status = 'disagree') AS disagreements, coalesce(list_sort(list(round(sep, 3)) FILTER (sep IS NOT NULL))[CAST(floor(count(sep) / 2) AS INT) + 1], 0) AS median_sep_nm,
  coalesce(list_sort(list(round(sep, 3)) FILTER (sep IS NOT NULL))[CAST(floor(0.95 * (count(sep) - 1)) AS INT) + 1], 0) AS p95_sep_nm FROM cmp GROUP BY ALL""")
def feed_comparison_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-16."""
    return cor.summary(_compare(spark, sf))


@query("addresses_in_one_feed", f"{_CB} SELECT DISTINCT recording, icao24 FROM st WHERE (recording, icao24) NOT IN (SELECT (recording, icao24) FROM st2)")
def addresses_in_one_feed(spark: SparkSession, sf: str) -> DataFrame:
    """SET-01: anti join on addresses."""
    key = ["recording", "icao24"]
    return bridge.states(spark, sf).select(*key).distinct().join(bridge.second_feed(spark, sf).select(*key).distinct(), key, "left_anti")


@query("rule_watchlist", f"""WITH RECURSIVE {bridge.states_cte()}, {places.WATCH_CTE} SELECT recording, batch_seq, pos, s.icao24, ts, entry_id, severity, mode FROM st AS s JOIN watch AS w
  ON lower(s.icao24) = lower(w.icao24) OR (w.callsign_prefix <> '' AND starts_with(upper(trim(coalesce(s.callsign, ''))), upper(w.callsign_prefix))) OR (w.registration <> '' AND upper(s.registration) = upper(w.registration))""")
def rule_watchlist(spark: SparkSession, sf: str) -> DataFrame:
    """JON-10 and RUL-12."""
    m = wl.matches(bridge.states(spark, sf), places.watch_entries(spark, sf), places.PREFIX_LENGTHS)
    return m.select("recording", "batch_seq", "pos", "icao24", "ts", "entry_id", "severity", "mode")


_HL = "hl AS (SELECT recording, icao24, max(abs(lat)) AS max_abs_lat, max(coalesce(baro_alt_ft, 0)) AS max_alt_ft, count(*) AS samples FROM st WHERE NOT on_ground AND abs(lat) >= 33 GROUP BY ALL)"


@query("high_latitude_exposure", f"{S.states()}, {_HL} SELECT * FROM hl")
def high_latitude_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-15 (the latitude limit lowered to where the derived traffic flies)."""
    return swx.exposed_flights(bridge.states(spark, sf), lat_min=33.0)


@query("rule_exposed_flights", f"""{S.states()}, {_HL}, rc AS (SELECT recording, CAST(substr(recording, 4) AS INTEGER) % 25 AS k FROM hl GROUP BY ALL),
  cu AS (SELECT recording, concat_ws('/', CASE WHEN (k * 7) % 6 >= 4 THEN 'G' END, CASE WHEN k % 5 >= 3 THEN 'S' END) AS conditions FROM rc)
  SELECT recording, 'SWX-005' AS rule_id, 'medium' AS severity, count(*) AS aircraft, max(max_abs_lat) AS max_abs_lat, conditions FROM hl JOIN cu USING (recording) WHERE conditions <> '' GROUP BY ALL""")
def rule_exposed_flights(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-32: the scales of each recording's product, which is the nation of its number."""
    hl = swx.exposed_flights(bridge.states(spark, sf), lat_min=33.0)
    k = F.substring("recording", 4, 20).cast("int") % 25
    scales = hl.select("recording").distinct().withColumn("g", ((k * 7) % 6).cast("int")).withColumn("s", (k % 5).cast("int"))
    return swx.exposure_findings(hl, swx.conditions(scales).select("recording", "conditions"))
