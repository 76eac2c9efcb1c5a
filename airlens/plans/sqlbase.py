"""Building blocks of the SQL the results are checked against, written apart from the Spark code."""

from __future__ import annotations

from airlens import dims
from airlens.plans import bridge


def hav(a: str, b: str, c: str, d: str) -> str:
    """Great-circle distance in nautical miles."""
    return (
        f"(2 * 3440.065 * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2)"
        f" + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"
    )


def planar(a: str, b: str, c: str, d: str) -> str:
    return f"sqrt(pow(({c} - {a}) * 60, 2) + pow(({d} - {b}) * 60 * cos(radians(({a} + {c}) / 2)), 2))"


def hdelta(a: str, b: str) -> str:
    m = f"((({b} - {a}) % 360) + 360) % 360"
    return f"(CASE WHEN {m} > 180 THEN {m} - 360 ELSE {m} END)"


def dim(name: str) -> str:
    return f"{name} AS {dims.values_sql(name)}"


CLOCK = """
clk AS (SELECT recording, batch_seq, lag(bts) OVER (PARTITION BY recording ORDER BY batch_seq) AS pbts
        FROM (SELECT recording, batch_seq, max(batch_ts) AS bts FROM st GROUP BY ALL) AS q)"""

GATE = """
pz AS (SELECT st.*, clk.pbts, row_number() OVER (PARTITION BY st.recording, st.icao24 ORDER BY st.batch_seq, st.pos) AS rn
       FROM st JOIN clk USING (recording, batch_seq) WHERE lat IS NOT NULL AND lon IS NOT NULL),
gate AS (
  SELECT recording, icao24, rn, ts AS lts, lat AS llat, lon AS llon, batch_seq AS lb, TRUE AS ok FROM pz WHERE rn = 1
  UNION ALL
  SELECT q.recording, q.icao24, q.rn, CASE WHEN q.ok THEN q.ts ELSE q.lts END, CASE WHEN q.ok THEN q.lat ELSE q.llat END,
         CASE WHEN q.ok THEN q.lon ELSE q.llon END, CASE WHEN q.ok THEN q.batch_seq ELSE q.lb END, q.ok
  FROM (SELECT p.recording, p.icao24, p.rn, p.ts, p.lat, p.lon, p.batch_seq, g.lts, g.llat, g.llon, g.lb,
               ((p.batch_seq > g.lb AND p.pbts - g.lts > 600) OR (p.ts - g.lts >= 0.5 AND NOT (p.lat = g.llat AND p.lon = g.llon AND p.ts - g.lts < 5))) AS ok
        FROM gate AS g JOIN pz AS p ON p.recording = g.recording AND p.icao24 = g.icao24 AND p.rn = g.rn + 1) AS q
),
acc AS (SELECT p.* FROM pz AS p JOIN gate AS g USING (recording, icao24, rn) WHERE g.ok)"""

_D = hav("lat1", "lon1", "lat", "lon")
FEATURES = f"""
lg AS (SELECT *, lag(ts) OVER w AS ts1, lag(lat) OVER w AS lat1, lag(lon) OVER w AS lon1, lag(baro_alt_ft) OVER w AS alt1, lag(on_ground) OVER w AS og1,
              lag(gs_kt) OVER w AS gs1, lag(track_deg) OVER w AS trk1, lag(batch_seq) OVER w AS b1
       FROM acc WINDOW w AS (PARTITION BY recording, icao24 ORDER BY batch_seq, pos)),
ss AS (SELECT *, sum(nw) OVER (PARTITION BY recording, icao24 ORDER BY batch_seq, pos) AS sess
       FROM (SELECT *, CASE WHEN ts1 IS NULL OR (batch_seq > b1 AND pbts - ts1 > 600) THEN 1 ELSE 0 END AS nw FROM lg) AS q),
f0 AS (SELECT * EXCLUDE (ts1), CASE WHEN nw = 0 THEN ts1 END AS ts1 FROM ss),
f1 AS (SELECT *, ts - ts1 AS dt_s, CASE WHEN nw = 0 THEN {_D} END AS dist_nm, CASE WHEN nw = 0 THEN {hdelta("trk1", "track_deg")} END AS turn FROM f0),
f2 AS (SELECT *, dist_nm / dt_s * 3600 AS implied_gs_kt,
              CASE WHEN NOT on_ground AND NOT og1 THEN (baro_alt_ft - alt1) / dt_s * 60 END AS implied_vrate_fpm,
              turn / dt_s AS turn_rate_dps, (gs_kt - gs1) / dt_s AS accel_kt_s FROM f1),
f3 AS (SELECT *, implied_gs_kt - gs_kt AS gs_mismatch_kt, implied_vrate_fpm - vrate_fpm AS vrate_mismatch_fpm,
              (implied_gs_kt - gs_kt) / greatest(gs_kt, 50) AS gs_mismatch_ratio,
              CAST(count(*) OVER w12 AS INTEGER) AS n_fixes, coalesce(sum(turn) OVER w11, 0) AS window_heading_sum_deg,
              coalesce(sum(dist_nm) OVER w11, 0) AS window_path_nm, CASE WHEN count(gs_kt) OVER w12 >= 2 THEN stddev_samp(gs_kt) OVER w12 END AS window_gs_std_kt,
              ts - first_value(ts) OVER w12 AS window_span_s, first_value(lat) OVER w12 AS flat, first_value(lon) OVER w12 AS flon,
              list({{'ts': ts, 'squawk': squawk, 'alt': baro_alt_ft, 'sel': selected_alt_ft, 'vr': vrate_fpm}}) OVER w12 AS hist
       FROM f2 WINDOW w12 AS (PARTITION BY recording, icao24, sess ORDER BY batch_seq, pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
                      w11 AS (PARTITION BY recording, icao24, sess ORDER BY batch_seq, pos ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)),
fx AS (SELECT *, {hav("flat", "flon", "lat", "lon")} AS window_net_nm FROM f3)"""

FEATURE_NAMES = [
    "n_fixes", "dt_s", "dist_nm", "implied_gs_kt", "gs_mismatch_kt", "implied_vrate_fpm", "turn_rate_dps", "window_heading_sum_deg",
    "window_net_nm", "window_path_nm", "window_span_s", "accel_kt_s", "vrate_mismatch_fpm", "gs_mismatch_ratio", "window_gs_std_kt",
]

SNAP = f"""
lastfix AS (SELECT * FROM fx QUALIFY row_number() OVER (PARTITION BY recording, icao24, batch_seq ORDER BY pos DESC) = 1),
sf AS (SELECT st.*, {", ".join(f"CASE WHEN l.batch_seq = st.batch_seq AND l.n_fixes >= 2 THEN l.{f} END AS {f}" for f in FEATURE_NAMES)},
              CASE WHEN l.batch_seq = st.batch_seq AND l.n_fixes >= 2 THEN l.gs_kt END AS reported_gs_kt,
              CASE WHEN st.batch_ts - l.ts <= 600 THEN l.hist ELSE [] END AS track
       FROM st ASOF LEFT JOIN lastfix AS l ON st.recording = l.recording AND st.icao24 = l.icao24 AND st.batch_seq >= l.batch_seq)"""


def fixes() -> str:
    """CTEs up to `fx`: accepted fixes with features."""
    return "WITH RECURSIVE " + bridge.states_cte() + "," + CLOCK + "," + GATE + "," + FEATURES


def featured() -> str:
    """CTEs up to `sf`: state rows with their poll's features and the track memory."""
    return fixes() + "," + SNAP


def states() -> str:
    return "WITH RECURSIVE " + bridge.states_cte()


_CS = "nullif(trim(callsign), '')"
_ADSB = "(position_source IS NULL OR position_source = '' OR position_source LIKE 'adsb%')"
_FAM = "split_part(coalesce(nullif(position_source, ''), 'adsb'), '_', 1)"
_TOL = f"(150.0 * CASE {_FAM} WHEN 'mlat' THEN 2.5 WHEN 'tisb' THEN 2.0 WHEN 'asterix' THEN 1.5 ELSE 1.0 END)"
_ORBIT = "(NOT on_ground AND n_fixes >= 8 AND abs(window_heading_sum_deg) >= 300 AND window_net_nm <= 8)"
_HIGH = "(coalesce(baro_alt_ft, 0) >= 3000 AND coalesce(gs_kt, 0) >= 150)"
_ID = f"recording, batch_seq, {{phase}} AS phase, pos, {{ord}} AS rule_ord, {{rule}} AS rule_id, {{sev}} AS severity, {{cat}} AS category, icao24, {_CS} AS callsign, ts, batch_ts, position_source, CAST({{measure}} AS DOUBLE) AS measure"


def _r(ord_: int | str, rule: str, sev: str, cat: str, measure: str, where: str, src: str = "sf", phase: int = 0) -> str:
    q = lambda s: s if s.startswith(("CASE", "(")) else f"'{s}'"
    return "SELECT " + _ID.format(phase=phase, ord=ord_, rule=q(rule), sev=q(sev), cat=q(cat), measure=measure) + f" FROM {src} WHERE {where}"


def state_rules() -> dict[str, str]:
    run = ("coalesce(list_min(list_filter(range(2, len(track) + 1), lambda j: track[len(track) + 1 - j].squawk IS DISTINCT FROM squawk)) - 1, greatest(len(track), 1))")
    k = ("list_min(list_filter(range(3, len(track) + 1), lambda j: track[len(track)].ts - track[len(track) + 1 - j].ts >= 60))")
    held = (f"len(list_filter(range(1, coalesce({k}, 0) + 1), lambda j: NOT (coalesce(abs(track[len(track) + 1 - j].alt - track[len(track) + 1 - j].sel) > 300, FALSE)"
            " AND abs(coalesce(track[len(track) + 1 - j].vr, 0)) <= 300))) = 0")
    imposs = "abs(implied_vrate_fpm) > 8000"
    return {
        "SEC-00x": _r(0, "CASE squawk WHEN '7500' THEN 'SEC-003' WHEN '7600' THEN 'SEC-002' ELSE 'SEC-001' END",
                      f"CASE WHEN squawk = '7500' THEN CASE WHEN {run} >= 2 THEN 'critical' ELSE 'high' END ELSE CASE WHEN {run} >= 2 THEN 'high' ELSE 'medium' END END",
                      "security", run, "squawk IN ('7500', '7600', '7700')"),
        "SEC-004": _r(1, "SEC-004", "high", "security", "1", "coalesce(squawk, '') NOT IN ('7500', '7600', '7700') AND emergency IS NOT NULL AND emergency NOT IN ('none', '')"),
        "SEC-010": _r(2, "SEC-010", f"CASE WHEN {_ADSB} THEN CASE WHEN implied_gs_kt > 1500 THEN 'critical' ELSE 'high' END ELSE 'medium' END",
                      f"CASE WHEN {_ADSB} THEN 'security' ELSE 'data-quality' END", "round(implied_gs_kt, 1)", "dt_s >= 4 AND NOT on_ground AND implied_gs_kt > 750"),
        "SEC-011": _r(3, "SEC-011", f"CASE WHEN {_FAM} = 'adsb' THEN 'medium' ELSE 'low' END", "security", "round(gs_mismatch_kt, 1)",
                      f"gs_mismatch_kt IS NOT NULL AND dt_s >= 4 AND NOT on_ground AND implied_gs_kt <= 750 AND abs(gs_mismatch_kt) > {_TOL}"),
        "SEC-018": _r(4, "SEC-018", f"CASE WHEN {_ADSB} THEN CASE WHEN {imposs} THEN 'high' ELSE 'medium' END ELSE 'low' END", f"CASE WHEN {_ADSB} THEN 'security' ELSE 'data-quality' END",
                      "round(implied_vrate_fpm, 0)", f"implied_vrate_fpm IS NOT NULL AND dt_s >= 10 AND NOT on_ground AND ({imposs} OR coalesce(abs(implied_vrate_fpm - vrate_fpm) > 4000, FALSE))"),
        "SEC-012": _r(5, "SEC-012", "CASE WHEN coalesce(sil = 0, FALSE) OR coalesce(nic <= 4, FALSE) THEN 'medium' ELSE 'low' END", "data-quality",
                      "coalesce(CAST(nic < 7 AS INT), 0) + coalesce(CAST(nac_p < 8 AS INT), 0) + coalesce(CAST(sil < 3 AS INT), 0)",
                      "NOT on_ground AND position_source LIKE 'adsb%' AND (coalesce(nic < 7, FALSE) OR coalesce(nac_p < 8, FALSE) OR coalesce(sil < 3, FALSE))"),
        "SEC-013": _r(6, "SEC-013", "low", "security", "coalesce(baro_alt_ft, 0)", f"NOT on_ground AND coalesce(baro_alt_ft, 0) >= 10000 AND {_CS} IS NULL"),
        "OPS-001": _r(7, "OPS-001", "info", "operations", "round(batch_ts - ts, 1)", "NOT on_ground AND batch_ts - ts > 90"),
        "OPS-002": _r(8, "OPS-002", "low", "operations", "round(window_span_s, 0)", f"{_ORBIT} AND {_HIGH}"),
        "OPS-003": _r(9, "OPS-003", "info", "operations", "round(window_span_s, 0)", f"{_ORBIT} AND NOT {_HIGH}"),
        "SAF-003": _r(10, "SAF-003", "medium", "safety", "vrate_fpm", "NOT on_ground AND abs(vrate_fpm) > 6000"),
        "OPS-004": _r(11, "OPS-004", "CASE WHEN abs(baro_alt_ft - selected_alt_ft) <= 1000 THEN 'low' ELSE 'info' END", "safety", "round(baro_alt_ft - selected_alt_ft, 0)",
                      f"NOT on_ground AND baro_alt_ft >= 3000 AND abs(coalesce(vrate_fpm, 0)) <= 300 AND abs(baro_alt_ft - selected_alt_ft) > 300 AND {k} IS NOT NULL AND {held}"),
        "OPS-005": _r(12, "OPS-005", "low", "operations", "baro_alt_ft", "NOT on_ground AND squawk = '1200' AND coalesce(baro_alt_ft, 0) >= 18000"),
    }


_LAT_P = "lat + CASE WHEN gs_kt IS NOT NULL AND track_deg IS NOT NULL THEN gs_kt * (batch_ts - ts) / 3600 * cos(radians(track_deg)) / 60 ELSE 0 END"
BATCH = f"""
dup0 AS (SELECT *, first_value(pos) OVER w AS pos0, first_value(lat) OVER w AS lat0, first_value(lon) OVER w AS lon0 FROM st WHERE lat IS NOT NULL AND lon IS NOT NULL
         WINDOW w AS (PARTITION BY recording, batch_seq, icao24 ORDER BY pos)),
dup AS (SELECT *, {hav("lat0", "lon0", "lat", "lon")} AS sep FROM dup0 WHERE pos0 < pos),
px0 AS (SELECT *, {_LAT_P} AS plat FROM st WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT on_ground AND coalesce(baro_alt_ft, 0) >= 3000 AND batch_ts - ts BETWEEN 0 AND 60),
px AS (SELECT *, lon + CASE WHEN gs_kt IS NOT NULL AND track_deg IS NOT NULL THEN gs_kt * (batch_ts - ts) / 3600 * sin(radians(track_deg)) / (60 * greatest(cos(radians(plat)), 0.1)) ELSE 0 END AS plon FROM px0),
prox0 AS (SELECT a.*, b.pos AS pos_b, b.icao24 AS other, abs(coalesce(a.baro_alt_ft, 0) - coalesce(b.baro_alt_ft, 0)) AS dalt, {hav("a.plat", "a.plon", "b.plat", "b.plon")} AS sep
          FROM px AS a JOIN px AS b ON a.recording = b.recording AND a.batch_seq = b.batch_seq AND a.pos < b.pos AND a.icao24 <> b.icao24
           AND abs(floor(a.plat / 0.06) - floor(b.plat / 0.06)) <= 1 AND abs(floor(a.plon / 0.06) - floor(b.plon / 0.06)) <= 1
          WHERE abs(coalesce(a.baro_alt_ft, 0) - coalesce(b.baro_alt_ft, 0)) < 900),
prox AS (SELECT * FROM prox0 WHERE sep < 3 QUALIFY row_number() OVER (PARTITION BY recording, batch_seq, icao24, other ORDER BY pos, pos_b) = 1)"""

POLLS = """
newa AS (SELECT recording, b AS batch_seq, count(*) AS n_new FROM (SELECT recording, icao24, min(batch_seq) AS b FROM st GROUP BY ALL) AS q GROUP BY ALL),
pl0 AS (SELECT recording, batch_seq, any_value(batch_ts) AS batch_ts, any_value(region) AS region, count(*) AS n_states FROM st GROUP BY ALL),
pl1 AS (SELECT pl0.*, coalesce(n_new, 0) AS n_new FROM pl0 LEFT JOIN newa USING (recording, batch_seq)),
pl AS (SELECT *, count(*) OVER w AS hist_new, avg(n_new) OVER w AS mean_new, count(*) OVER r AS hist_size, avg(n_states) OVER r AS mean_size
       FROM pl1 WINDOW w AS (PARTITION BY recording ORDER BY batch_seq ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING),
                       r AS (PARTITION BY recording, region ORDER BY batch_seq ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
pls AS (SELECT *, 0 AS pos, CAST(NULL AS VARCHAR) AS icao24, CAST(NULL AS VARCHAR) AS callsign, batch_ts AS ts, CAST(NULL AS VARCHAR) AS position_source FROM pl)"""
BURST = _r(0, "SEC-016", "high", "security", "n_new", "hist_new >= 3 AND n_new >= 25 AND n_new > 4 * greatest(mean_new, 1)", "pls", 2)
COLLAPSE = _r(1, "SEC-017", "high", "security", "n_states", "hist_size >= 3 AND mean_size >= 20 AND n_states < 0.5 * mean_size", "pls", 2)
DUP = _r(0, "SEC-014", "high", "security", "round(sep, 1)", "sep >= 5", "dup", 1)
PROX = _r(1, "SAF-004", "CASE WHEN sep < 1.5 AND dalt < 600 THEN 'medium' ELSE 'info' END", "safety", "round(sep, 2)", "TRUE", "prox", 1)


def _watched() -> tuple[str, str]:
    from airlens.plans import places

    join = ("wl AS (SELECT s.*, w.ord, w.severity AS wsev FROM st AS s JOIN watch AS w ON lower(s.icao24) = lower(w.icao24) OR (w.callsign_prefix <> '' AND starts_with(upper(trim(coalesce(s.callsign, ''))), upper(w.callsign_prefix)))"
            " OR (w.registration <> '' AND upper(s.registration) = upper(w.registration)))")
    return f"{places.WATCH_CTE}, {join}", _r("13 + ord", "SEC-020", "(wsev)", "security", "NULL", "TRUE", "wl")


def candidates(watch: bool = False) -> str:
    """CTEs up to `cand`: every candidate finding, with its order inside the poll; with the watchlist's if asked for."""
    ctes, rows = _watched() if watch else ("", "")
    union = " UNION ALL ".join([*state_rules().values(), DUP, PROX, BURST, COLLAPSE, *([rows] if watch else [])])
    return featured() + "," + BATCH + "," + POLLS + (f", {ctes}" if watch else "") + f", cand AS ({union})"


_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_LIMIT = ("CASE rule_id WHEN 'OPS-001' THEN 900 WHEN 'OPS-002' THEN 600 WHEN 'OPS-003' THEN 900 WHEN 'OPS-004' THEN 600 WHEN 'SEC-012' THEN 900"
          " WHEN 'SEC-013' THEN 900 WHEN 'OPS-005' THEN 900 WHEN 'ML-001' THEN 300 WHEN 'SAF-004' THEN 300 ELSE 120 END")
_SCORE = ("CASE severity WHEN 'critical' THEN 16 WHEN 'high' THEN 8 WHEN 'medium' THEN 4 WHEN 'low' THEN 2 ELSE 1 END * (1 + 0.5 * log2(n))"
          " * CASE WHEN category = 'security' THEN 0.6 + 0.4 * CASE position_source WHEN 'adsb' THEN 1.0 WHEN 'asterix' THEN 0.9 WHEN 'mlat' THEN 0.7 WHEN 'tisb' THEN 0.6 WHEN 'adsc' THEN 0.6 WHEN 'flarm' THEN 0.6 ELSE 0.5 END ELSE 1.0 END"
          " * greatest(0.2, CASE rule_id WHEN 'SEC-011' THEN 0.9054054054054054 WHEN 'SEC-018' THEN 0.7407407407407407 WHEN 'ML-001' THEN 0.24691358024691357 ELSE 1.0 END)")
COOLDOWN = f"""
cq AS (SELECT *, {_RANK} AS rnk, {_LIMIT} AS lim, row_number() OVER (PARTITION BY recording, rule_id, icao24 ORDER BY batch_seq, phase, pos, rule_ord) AS n FROM cand),
fired AS (
  SELECT recording, rule_id, icao24, n, batch_ts AS lastts, rnk AS lastsev, TRUE AS fire FROM cq WHERE n = 1
  UNION ALL
  SELECT q.recording, q.rule_id, q.icao24, q.n, CASE WHEN q.f THEN q.batch_ts ELSE q.lastts END, CASE WHEN q.f THEN q.rnk ELSE q.lastsev END, q.f
  FROM (SELECT c.recording, c.rule_id, c.icao24, c.n, c.batch_ts, c.rnk, p.lastts, p.lastsev, (c.rnk < p.lastsev OR c.batch_ts - p.lastts >= c.lim) AS f
        FROM fired AS p JOIN cq AS c ON c.recording = p.recording AND c.rule_id = p.rule_id AND c.icao24 IS NOT DISTINCT FROM p.icao24 AND c.n = p.n + 1) AS q),
accf AS (SELECT *, n AS occurrences, {_SCORE} AS risk_score FROM (SELECT c.* FROM cq AS c JOIN fired AS f
         ON c.recording = f.recording AND c.rule_id = f.rule_id AND c.icao24 IS NOT DISTINCT FROM f.icao24 AND c.n = f.n WHERE f.fire) AS q)"""

TRUST = """
tr0 AS (SELECT recording, icao24, batch_seq, count(*) AS nrows FROM st GROUP BY ALL),
tr1 AS (SELECT tr0.*, fl.icao24 IS NOT NULL AS flagged, coalesce(pen, 0) AS pen, coalesce(hits, 0) AS hits FROM tr0
  LEFT JOIN (SELECT DISTINCT recording, icao24, batch_seq FROM cand WHERE icao24 IS NOT NULL) AS fl USING (recording, icao24, batch_seq)
  LEFT JOIN (SELECT recording, icao24, batch_seq, count(*) AS hits, sum(CASE severity WHEN 'critical' THEN 0.60 WHEN 'high' THEN 0.35 WHEN 'medium' THEN 0.15 WHEN 'low' THEN 0.05 ELSE 0.01 END
      * CASE category WHEN 'security' THEN 1.0 WHEN 'safety' THEN 0.6 WHEN 'ml' THEN 0.5 WHEN 'operations' THEN 0.2 WHEN 'data-quality' THEN 0.4 ELSE 0.5 END) AS pen
      FROM accf WHERE icao24 IS NOT NULL GROUP BY ALL) AS h USING (recording, icao24, batch_seq)),
tr2 AS (SELECT recording, icao24, sum(hits) AS hits, list(CAST(CASE WHEN flagged THEN -pen ELSE nrows * 0.02 END AS DOUBLE) ORDER BY batch_seq) AS d FROM tr1 GROUP BY ALL),
trust AS (SELECT recording, icao24, hits, list_reduce(list_prepend(CAST(1.0 AS DOUBLE), d), lambda s, x: least(1.0, greatest(0.0, s + x))) AS trust FROM tr2)"""


def accepted(watch: bool = False) -> str:
    return candidates(watch) + "," + COOLDOWN


def trusted(watch: bool = False) -> str:
    return accepted(watch) + "," + TRUST
