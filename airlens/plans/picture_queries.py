"""The current picture: enrichment, boards, flight lists, holding impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.operators import audit
from airlens.operators import ecosystem as eco
from airlens.operators import picture as pic
from airlens.operators import regions as reg
from airlens.plans import bridge, places
from airlens.plans import sqlbase as S
from airlens.plans.registry import query

c = F.col
KEY = ["recording", "batch_seq", "pos", "icao24"]
_MIL = eco.MILITARY.replace("'", "''")
_AIR = f"{S.dim('airports')}, apt AS (SELECT * FROM (SELECT st.recording, st.batch_seq, st.pos, a.icao, a.elev_ft, a.iata, {S.hav('st.lat', 'st.lon', 'a.lat', 'a.lon')} AS nm FROM st JOIN airports AS a ON abs(floor(st.lat) - floor(a.lat)) <= 1 AND abs(floor(st.lon) - floor(a.lon)) <= 1) AS q WHERE nm <= 40 QUALIFY row_number() OVER (PARTITION BY recording, batch_seq, pos ORDER BY nm) = 1)"
_CS = "upper(trim(coalesce(callsign, '')))"
_REG = f"upper(CASE WHEN coalesce(registration, '') <> '' THEN registration ELSE {_CS} END)"


def _pick(balloon, table, mil, us, ca, mx, unknown, none):
    return (f"CASE WHEN starts_with(cs, 'HBAL') THEN '{balloon}' WHEN o.code IS NOT NULL THEN {table} WHEN regexp_matches(cs, '{_MIL}') THEN '{mil}' WHEN regexp_matches(rg, '^N[0-9]') THEN '{us}'"
            f" WHEN regexp_matches(rg, '^(C-|CF|CG)') THEN '{ca}' WHEN regexp_matches(rg, '^X[ABC]') THEN '{mx}' WHEN regexp_matches(substr(cs, 1, 3), '^[A-Z]{{1,3}}$') THEN {unknown} ELSE '{none}' END")


_ENRICH = f"""{_AIR}, {S.dim('operators')}, {S.dim('aircraft_types')},
en0 AS (SELECT s.*, p.icao AS airport, p.nm AS airport_nm, p.elev_ft, t.name AS tname, t.category AS tcat, upper(nullif(aircraft_type, '')) AS tcode, {_CS} AS cs, {_REG} AS rg
  FROM st AS s LEFT JOIN apt AS p USING (recording, batch_seq, pos) LEFT JOIN aircraft_types AS t ON t.code = upper(nullif(s.aircraft_type, ''))),
en1 AS (SELECT e.*, CASE WHEN airport IS NOT NULL THEN baro_alt_ft - elev_ft ELSE baro_alt_ft END AS agl_ft, coalesce(vrate_fpm, 0) AS vr, coalesce(tname, tcode, 'unknown') AS type_name, coalesce(tcat, 'unknown') AS type_cat,
   {_pick('HBAL', 'o.code', 'MIL', 'N', 'C', 'X', 'substr(cs, 1, 3)', '?')} AS operator_code,
   {_pick('High-altitude balloon', 'o.name', 'Military / government', 'General aviation (US registration)', 'General aviation (Canada)', 'General aviation (Mexico)', "'Unknown operator ' || substr(cs, 1, 3)", 'Unidentified')} AS operator,
   {_pick('US', 'o.country', 'US', 'US', 'CA', 'MX', "'?'", '?')} AS operator_country, {_pick('balloon', 'o.category', 'military', 'ga', 'ga', 'ga', "'unknown'", 'unknown')} AS operator_cat
  FROM en0 AS e LEFT JOIN operators AS o ON regexp_matches(cs, '^[A-Z]{{3}}($|[0-9A-Z])') AND o.code = substr(cs, 1, 3)),
en AS (SELECT *, CASE WHEN on_ground OR (airport IS NOT NULL AND agl_ft < 150 AND coalesce(gs_kt, 0) < 80) THEN 'ground'
   WHEN airport IS NOT NULL AND agl_ft < 10000 AND vr > 300 THEN 'departure' WHEN airport IS NOT NULL AND agl_ft < 10000 AND vr < -300 THEN CASE WHEN agl_ft < 3000 AND airport_nm <= 15 THEN 'approach' ELSE 'arrival' END
   WHEN airport IS NOT NULL AND agl_ft < 3000 THEN 'pattern' WHEN airport IS NOT NULL AND agl_ft < 10000 THEN 'terminal' WHEN baro_alt_ft >= 18000 AND abs(vr) < 500 THEN 'cruise' WHEN vr > 300 THEN 'climb' WHEN vr < -300 THEN 'descent' ELSE 'level' END AS phase FROM en1)"""
_EB = f"WITH RECURSIVE {bridge.states_cte()}, {_ENRICH}"
_ECOLS = [*KEY, "operator_code", "operator", "operator_country", "operator_cat", "type_name", "type_cat", "phase", "airport", "agl_ft"]


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return eco.enrich(bridge.states(spark, sf))


@query("enriched_states", f"{_EB} SELECT {', '.join(_ECOLS)}, round(airport_nm, 3) AS airport_nm FROM en")
def enriched_states(spark: SparkSession, sf: str) -> DataFrame:
    """JON-08, JON-11, PRJ-11, PRJ-12 and PRJ-13."""
    return _enriched(spark, sf).select(*_ECOLS, F.round("airport_nm", 3).alias("airport_nm"))


_AGGS = """count(*) AS nearby, count(*) FILTER (phase = 'ground') AS ground, count(*) FILTER (phase = 'departure') AS departing, count(*) FILTER (phase IN ('arrival', 'approach')) AS arriving, count(*) FILTER (phase = 'approach') AS approach,
 count(*) FILTER (phase IN ('terminal', 'pattern')) AS terminal, count(*) FILTER (phase IN ('cruise', 'level', 'climb', 'descent')) AS overhead, count(*) FILTER (squawk IN ('7500', '7600', '7700')) AS emergencies"""


@query("airport_board", f"{_EB} SELECT recording, batch_seq, airport, {_AGGS} FROM en WHERE airport IS NOT NULL GROUP BY ALL")
def airport_board(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-04: per poll and airport."""
    return eco.airport_board(_enriched(spark, sf))


@query("airport_board_us_major", f"{_EB}, b AS (SELECT recording, batch_seq, airport, {_AGGS} FROM en WHERE airport IS NOT NULL GROUP BY ALL) SELECT b.*, a.name AS airport_name FROM b JOIN airports AS a ON a.icao = b.airport WHERE a.country = 'US' AND a.major")
def airport_board_us_major(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-16: the board filtered by country."""
    from airlens import dims

    a = dims.table(spark, "airports").filter("country = 'US' and major").select(c("icao").alias("airport"), c("name").alias("airport_name"))
    return eco.airport_board(_enriched(spark, sf)).join(F.broadcast(a), "airport")


@query("airport_table", f"""{_EB}, act AS (SELECT airport AS icao, count(*) AS fixes, count(DISTINCT icao24) AS aircraft FROM en WHERE airport IS NOT NULL GROUP BY ALL),
  ops AS (SELECT concat('K', CASE n_nationkey % 5 WHEN 0 THEN 'DFW' WHEN 1 THEN 'DAL' WHEN 2 THEN 'IAH' WHEN 3 THEN 'ATL' ELSE 'ORD' END) AS icao, count(*) AS programmes, string_agg(n_name, ',' ORDER BY n_name) AS programme_names FROM nation GROUP BY ALL)
  SELECT a.icao, a.name, a.country, coalesce(fixes, 0) AS fixes, coalesce(aircraft, 0) AS aircraft, coalesce(programmes, 0) AS programmes, programme_names FROM airports AS a LEFT JOIN act USING (icao) LEFT JOIN ops USING (icao)""")
def airport_table(spark: SparkSession, sf: str) -> DataFrame:
    """JON-12: traffic programmes and activity on the full airport table."""
    from airlens import dims

    act = _enriched(spark, sf).filter("airport is not null").groupBy(c("airport").alias("icao")).agg(F.count(F.lit(1)).alias("fixes"), F.countDistinct("icao24").alias("aircraft"))
    n = spark.read.parquet(f"{sf}/nation.parquet")
    ops = n.selectExpr("concat('K', case n_nationkey % 5 when 0 then 'DFW' when 1 then 'DAL' when 2 then 'IAH' when 3 then 'ATL' else 'ORD' end) as icao", "n_name").groupBy("icao").agg(
        F.count(F.lit(1)).alias("programmes"), F.concat_ws(",", F.array_sort(F.collect_list("n_name"))).alias("programme_names"))
    a = dims.table(spark, "airports").select("icao", "name", "country")
    return a.join(act, "icao", "left").join(ops, "icao", "left").fillna(0, ["fixes", "aircraft", "programmes"])


_MEAS, _COMP = "NOT on_ground AND position_source LIKE 'adsb%' AND nic IS NOT NULL", "nic >= 7 AND coalesce(nac_p, 0) >= 8 AND coalesce(sil, 0) >= 3"


@query("operator_board", f"""{_EB}, tt AS (SELECT recording, batch_seq, operator_code, string_agg(type, ',' ORDER BY r) AS types FROM (SELECT *, row_number() OVER (PARTITION BY recording, batch_seq, operator_code ORDER BY n DESC, p) AS r FROM
    (SELECT recording, batch_seq, operator_code, coalesce(aircraft_type, '?') AS type, count(*) AS n, min(pos) AS p FROM en GROUP BY ALL) AS q) AS w WHERE r <= 3 GROUP BY ALL)
  SELECT * FROM (SELECT recording, batch_seq, operator_code, any_value(operator) AS operator, any_value(operator_cat) AS category, count(*) AS aircraft, count(*) FILTER (NOT on_ground) AS airborne, count(*) FILTER (on_ground) AS ground,
   round_even(avg(baro_alt_ft) FILTER (NOT on_ground), 0) AS mean_alt, round(count(*) FILTER ({_MEAS} AND {_COMP}) / nullif(count(*) FILTER ({_MEAS}), 0), 4) AS compliance FROM en GROUP BY ALL) AS b JOIN tt USING (recording, batch_seq, operator_code)""")
def operator_board(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-05."""
    return eco.operator_board(_enriched(spark, sf))


@query("type_board", f"""{_EB} SELECT recording, batch_seq, tcode AS type_code, any_value(type_name) AS type_name, any_value(type_cat) AS category, count(*) AS aircraft, count(*) FILTER (NOT on_ground) AS airborne,
  round_even(avg(baro_alt_ft) FILTER (NOT on_ground), 0) AS mean_alt, round_even(avg(gs_kt) FILTER (NOT on_ground), 0) AS mean_gs FROM en WHERE tcode IS NOT NULL GROUP BY ALL""")
def type_board(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-06."""
    return eco.type_board(_enriched(spark, sf))


@query("phase_and_category_totals", f"{_EB} SELECT recording, 'phase' AS facet, phase AS value, count(*) AS flights FROM en GROUP BY ALL UNION ALL SELECT recording, 'category', type_cat, count(*) FROM en GROUP BY ALL")
def phase_and_category_totals(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-07: one pass for both totals."""
    e = _enriched(spark, sf).select("recording", F.inline(F.array(F.struct(F.lit("phase").alias("facet"), c("phase").alias("value")), F.struct(F.lit("category").alias("facet"), c("type_cat").alias("value")))))
    return e.groupBy("recording", "facet", "value").agg(F.count(F.lit(1)).alias("flights"))


_WORST = "CASE min(w) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' END"
_NOTED = f"""{S.accepted()}, {_ENRICH}, rf AS (SELECT s.recording, s.icao24, s.batch_seq, count(*) AS n, count(*) FILTER (a.rule_id = 'OPS-002') AS h, min(CASE a.severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END) AS w
   FROM (SELECT DISTINCT recording, icao24, batch_seq, batch_ts FROM st) AS s JOIN accf AS a ON a.recording = s.recording AND a.icao24 = s.icao24 AND a.batch_ts BETWEEN s.batch_ts - 600 AND s.batch_ts GROUP BY ALL),
  nt AS (SELECT en.*, coalesce(n, 0) AS n, coalesce(h, 0) AS h, w FROM en LEFT JOIN rf USING (recording, icao24, batch_seq))"""
_FOUND = f"CAST(sum(n) AS BIGINT) AS findings, {_WORST} AS worst"


def _noted(spark: SparkSession, sf: str) -> DataFrame:
    st = bridge.states(spark, sf)
    return eco.with_findings(eco.enrich(st), eco.recent_findings(st, audit.audit(st)))


@query("airport_board_findings", f"""{_NOTED}, pg AS (SELECT iata, string_agg(kind, ',' ORDER BY kind) AS programmes FROM (SELECT CASE n_nationkey % 5 WHEN 0 THEN 'DFW' WHEN 1 THEN 'DAL' WHEN 2 THEN 'IAH' WHEN 3 THEN 'ATL' ELSE 'ORD' END AS iata,
   CASE n_nationkey % 3 WHEN 0 THEN 'ground stop' WHEN 1 THEN 'closure' ELSE 'arrival/departure delay' END AS kind FROM nation) AS q GROUP BY ALL),
  b AS (SELECT recording, batch_seq, airport, count(*) AS nearby, CAST(sum(h) AS BIGINT) AS holds, {_FOUND} FROM nt WHERE airport IS NOT NULL GROUP BY ALL)
  SELECT b.*, a.iata, a.name, a.city, a.country, coalesce(programmes, '') AS programmes FROM b JOIN airports AS a ON a.icao = b.airport LEFT JOIN pg ON pg.iata = a.iata""")
def airport_board_findings(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-04: holds, findings and worst severity of the last ten minutes, and traffic programmes."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    pg = n.selectExpr("case n_nationkey % 5 when 0 then 'DFW' when 1 then 'DAL' when 2 then 'IAH' when 3 then 'ATL' else 'ORD' end as airport", "case n_nationkey % 3 when 0 then 'ground stop' when 1 then 'closure' else 'arrival/departure delay' end as kind")
    return eco.airport_findings(_noted(spark, sf), pg)


@query("operator_board_findings", f"""{_NOTED}, ph AS (SELECT recording, batch_seq, operator_code, string_agg(phase || ':' || k, ',' ORDER BY phase || ':' || k) AS phases FROM (SELECT recording, batch_seq, operator_code, phase, count(*) AS k FROM nt GROUP BY ALL) AS q GROUP BY ALL)
  SELECT * FROM (SELECT recording, batch_seq, operator_code, any_value(operator_country) AS country, count(*) AS aircraft, {_FOUND} FROM nt GROUP BY ALL) AS b JOIN ph USING (recording, batch_seq, operator_code)""")
def operator_board_findings(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-05: phases, country, findings and worst severity."""
    return eco.operator_findings(_noted(spark, sf))


@query("type_board_findings", f"{_NOTED} SELECT recording, batch_seq, tcode AS type_code, count(*) AS aircraft, {_FOUND} FROM nt WHERE tcode IS NOT NULL GROUP BY ALL")
def type_board_findings(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-06: findings and worst severity."""
    return eco.type_findings(_noted(spark, sf))


_IBO = """ibo AS (SELECT operator_code, count(*) AS fixes, count(DISTINCT icao24) AS aircraft, round(avg(CAST(nic >= 7 AND nac_p >= 8 AND sil = 3 AS INT)), 4) AS compliance FROM en
  WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT on_ground AND coalesce(nullif(position_source, ''), 'adsb') = 'adsb' AND nic IS NOT NULL AND nac_p IS NOT NULL AND sil IS NOT NULL GROUP BY ALL HAVING count(*) >= 20)"""


@query("integrity_by_operator", f"{_EB}, {_IBO} SELECT * FROM ibo")
def integrity_by_operator(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-03."""
    return eco.integrity_by_operator(_enriched(spark, sf))


@query("integrity_extremes", f"""{_EB}, {_IBO} SELECT 'lowest' AS side, * FROM (SELECT * FROM ibo ORDER BY compliance, fixes DESC, operator_code LIMIT 10) AS a
  UNION ALL SELECT 'highest', * FROM (SELECT * FROM ibo ORDER BY compliance DESC, fixes, operator_code DESC LIMIT 10) AS b""")
def integrity_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-08: ten lowest and ten highest."""
    i = eco.integrity_by_operator(_enriched(spark, sf))
    low = i.orderBy("compliance", F.desc("fixes"), "operator_code").limit(10).select(F.lit("lowest").alias("side"), "*")
    return low.unionByName(i.orderBy(F.desc("compliance"), "fixes", F.desc("operator_code")).limit(10).select(F.lit("highest").alias("side"), "*"))


_LATEST = "lt AS (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY recording, icao24 ORDER BY batch_seq DESC, pos DESC) = 1)"


@query("flight_list", f"""{_EB}, {_LATEST} SELECT recording, icao24, callsign, operator_code, type_cat, phase, baro_alt_ft FROM lt
  WHERE type_cat = 'narrowbody' AND baro_alt_ft >= 2000 AND baro_alt_ft <= 30000 AND lower(concat_ws(' ', icao24, callsign, registration, operator, aircraft_type)) LIKE '%a%' ORDER BY baro_alt_ft DESC NULLS LAST, recording, icao24 LIMIT 50""")
def flight_list(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-02: newest row per aircraft, filtered and sorted."""
    e = eco.enrich(pic.latest_states(bridge.states(spark, sf)))
    f = pic.flights(e, sort="-baro_alt_ft", category="narrowbody", min_alt=2000.0, max_alt=30000.0, text="a")
    return f.orderBy(c("baro_alt_ft").desc_nulls_last(), "recording", "icao24").limit(50).select("recording", "icao24", "callsign", "operator_code", "type_cat", "phase", "baro_alt_ft")


@query("flight_facets", f"""{_EB}, {_LATEST} SELECT 'phase' AS facet, phase AS value, count(*) AS flights FROM lt GROUP BY ALL UNION ALL SELECT 'operator_cat', operator_cat, count(*) FROM lt GROUP BY ALL
  UNION ALL SELECT 'position_source', position_source, count(*) FROM lt WHERE position_source IS NOT NULL GROUP BY ALL""")
def flight_facets(spark: SparkSession, sf: str) -> DataFrame:
    return pic.facets(eco.enrich(pic.latest_states(bridge.states(spark, sf))), ["phase", "operator_cat", "position_source"])


@query("current_picture", f"""{S.accepted()}, lt AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY recording, icao24 ORDER BY batch_seq DESC, pos DESC) = 1)
  SELECT l.recording, l.icao24, count(a.rule_id) AS findings, coalesce(string_agg(DISTINCT a.rule_id, ',' ORDER BY a.rule_id), '') AS rules,
   CASE min(CASE a.severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 END) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' END AS worst
  FROM lt AS l LEFT JOIN accf AS a ON a.recording = l.recording AND a.icao24 = l.icao24 AND a.batch_ts BETWEEN l.batch_ts - 600 AND l.batch_ts GROUP BY ALL""")
def current_picture(spark: SparkSession, sf: str) -> DataFrame:
    """JON-19: latest row of each aircraft with its findings of the last ten minutes."""
    st = bridge.states(spark, sf)
    return pic.recent_findings(pic.latest_states(st), audit.audit(st)).select("recording", "icao24", "findings", F.concat_ws(",", "rules").alias("rules"), "worst")


@query("aircraft_detail", f"""{S.trusted()}, tl AS (SELECT * FROM st WHERE icao24 = 'a00103' AND lat IS NOT NULL AND lon IS NOT NULL QUALIFY row_number() OVER (PARTITION BY recording ORDER BY batch_seq DESC, pos DESC) <= 24),
  nf AS (SELECT * FROM accf WHERE icao24 = 'a00103' QUALIFY row_number() OVER (PARTITION BY recording ORDER BY batch_seq DESC, phase DESC, pos DESC, rule_ord DESC) <= 30)
  SELECT recording, icao24, round(trust, 4) AS trust, (SELECT count(*) FROM tl WHERE tl.recording = trust.recording) AS trail_points, (SELECT count(*) FROM nf WHERE nf.recording = trust.recording) AS findings,
   (SELECT string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FROM nf WHERE nf.recording = trust.recording) AS rules FROM trust WHERE icao24 = 'a00103'""")
def aircraft_detail(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-15: one aircraft; the audit is filtered to its address before anything is shuffled for the others."""
    from pyspark.sql.window import Window as W

    from airlens.operators import folds
    from airlens.session import cut_lineage

    st = bridge.states(spark, sf)
    one = st.filter("icao24 = 'a00103'")
    cand = cut_lineage(audit.candidates(st).filter("icao24 = 'a00103'"))
    acc = cut_lineage(folds.cooldown(cand))
    w = W.partitionBy("recording").orderBy(F.desc("batch_seq"), F.desc("phase"), F.desc("pos"), F.desc("rule_ord"))
    newest = acc.withColumn("_r", F.row_number().over(w)).filter("_r <= 30").groupBy("recording").agg(F.count(F.lit(1)).alias("findings"), F.concat_ws(",", F.array_sort(F.collect_set("rule_id"))).alias("rules"))
    trail = pic.trail(one).select("recording", F.size("trail").cast("long").alias("trail_points"))
    t = folds.trust_scores(one, cand, acc).select("recording", "icao24", F.round("trust", 4).alias("trust"))
    return t.join(trail, "recording", "left").join(newest, "recording", "left").fillna(0, ["trail_points", "findings"])


_TRAIL = "tl AS (SELECT * FROM st WHERE lat IS NOT NULL AND lon IS NOT NULL QUALIFY row_number() OVER (PARTITION BY recording, icao24 ORDER BY batch_seq DESC, pos DESC) <= 24)"


@query("position_trails", f"{S.states()}, {_TRAIL} SELECT recording, icao24, count(*) AS points, min(ts) AS oldest, round(sum(lat), 5) AS lat_sum FROM tl GROUP BY ALL")
def position_trails(spark: SparkSession, sf: str) -> DataFrame:
    """STR-11 as a batch query: the newest 24 positions."""
    t = pic.trail(bridge.states(spark, sf))
    return t.select("recording", "icao24", F.size("trail").cast("long").alias("points"), F.array_min(F.transform("trail", lambda x: x["ts"])).alias("oldest"),
                    F.round(F.aggregate("trail", F.lit(0.0), lambda s, x: s + x["lat"]), 5).alias("lat_sum"))


_HOLD = "sum(coalesce(measure, 0)) / 60"
_IMPACT = f"count(*) AS holds, count(DISTINCT icao24) AS aircraft, round({_HOLD}, 1) AS observed_minutes, round_even({_HOLD} * 40, 0) AS fuel_kg, round_even({_HOLD} * 40 * 3.16, 0) AS co2_kg, round_even({_HOLD} * 40 * 0.85, 0) AS fuel_cost, round_even({_HOLD} * 100, 0) AS delay_cost"


@query("holding_impact", f"{S.accepted()} SELECT recording, {_IMPACT} FROM accf WHERE rule_id = 'OPS-002' GROUP BY ALL")
def holding_impact(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-08."""
    return eco.holding_impact(audit.audit(bridge.states(spark, sf)).filter("rule_id = 'OPS-002'"), ["recording"])


@query("holding_by_airport", f"""{S.accepted()}, {_AIR}, lastpos AS (SELECT s.recording, s.icao24, p.icao AS airport FROM (SELECT * FROM st WHERE lat IS NOT NULL AND lon IS NOT NULL QUALIFY row_number() OVER (PARTITION BY recording, icao24 ORDER BY batch_seq DESC, pos DESC) = 1) AS s
   LEFT JOIN apt AS p USING (recording, batch_seq, pos)) SELECT coalesce(airport, 'none within 40 nm') AS airport, {_IMPACT} FROM (SELECT a.*, l.airport FROM accf AS a LEFT JOIN lastpos AS l USING (recording, icao24) WHERE rule_id = 'OPS-002') AS q GROUP BY ALL""")
def holding_by_airport(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-08 by the airport nearest to the last position."""
    st = bridge.states(spark, sf)
    last = eco.nearest_airport(pic.latest_states(st.filter("lat is not null and lon is not null"))).select("recording", "icao24", "airport")
    holds = audit.audit(st).filter("rule_id = 'OPS-002'").join(last, ["recording", "icao24"], "left").withColumn("airport", F.coalesce("airport", F.lit("none within 40 nm")))
    return eco.holding_impact(holds, ["airport"])


@query("spaceport_of_pad", f"""WITH {places.LCH_CTE}, {S.dim('spaceports')}, d AS (SELECT launch_id, code, {S.planar('pad_lat', 'pad_lon', 'lat', 'lon')} AS nm FROM lch, spaceports), b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY launch_id ORDER BY nm) = 1)
  SELECT launch_id, CASE WHEN nm <= 600 THEN code END AS spaceport, CASE WHEN nm <= 600 THEN round(nm, 2) END AS spaceport_nm FROM b""")
def spaceport_of_pad(spark: SparkSession, sf: str) -> DataFrame:
    """JON-09 (radius widened to reach the derived pads)."""
    p = eco.nearest_spaceport(places.launches(spark, sf).filter("pad_lat is not null"), "pad_lat", "pad_lon", 600.0)
    return p.select("launch_id", "spaceport", F.round("spaceport_nm", 2).alias("spaceport_nm"))


@query("airports_near_pad", f"WITH {places.LCH_CTE}, {S.dim('airports')} SELECT launch_id, icao AS airport, round(nm, 1) AS airport_nm FROM (SELECT launch_id, icao, {S.planar('pad_lat', 'pad_lon', 'lat', 'lon')} AS nm FROM lch, airports) AS q WHERE nm <= 50")
def airports_near_pad(spark: SparkSession, sf: str) -> DataFrame:
    """JON-09."""
    p = eco.airports_near(places.launches(spark, sf).filter("pad_lat is not null"), "pad_lat", "pad_lon")
    return p.select("launch_id", "airport", F.round("airport_nm", 1).alias("airport_nm"))


@query("region_box_filter", S.states() + """ SELECT recording, batch_seq, pos, icao24 FROM st WHERE lat BETWEEN 32.90 - 60 / 60.0 AND 32.90 + 60 / 60.0 AND lon BETWEEN -97.04 - 60 / (60.0 * cos(radians(32.90))) AND -97.04 + 60 / (60.0 * cos(radians(32.90)))""")
def region_box_filter(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-08."""
    return reg.inside(bridge.states(spark, sf), "dfw").select(*KEY)


_REGKEYS = "CASE s_suppkey % 4 WHEN 0 THEN 'nyc, lhr' WHEN 1 THEN 'world-hubs' WHEN 2 THEN 'usa-hubs,fra' ELSE ' SIN ' END"


@query("region_spec_expansion", f"""WITH {S.dim('regions')}, sp AS (SELECT s_suppkey, {_REGKEYS} AS spec FROM supplier), pt AS (SELECT *, trim(unnest(string_split(lower(spec), ','))) AS k FROM sp),
  ex AS (SELECT *, unnest(CASE k WHEN 'usa-hubs' THEN {reg.GROUPS['usa-hubs']} WHEN 'world-hubs' THEN {reg.GROUPS['world-hubs']} ELSE [k] END) AS key FROM pt)
  SELECT s_suppkey, ex.spec, ex.key, r.name, CASE WHEN contains(ex.spec, 'hubs') THEN 250.0 ELSE r.radius_nm END AS radius_nm FROM ex JOIN regions AS r ON r.key = ex.key""")
def region_spec_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-09."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", F.expr(_REGKEYS).alias("spec"))
    return reg.expand(s)


@query("region_traffic_catalogue", f"""{S.states()}, {S.dim('regions')} SELECT r.key, r.name, CASE WHEN endpoint IS NOT NULL THEN 'feed' WHEN lamin IS NOT NULL THEN 'area' ELSE 'hub' END AS kind,
   CASE WHEN endpoint IS NULL AND lamin IS NULL THEN 15 ELSE 60 END AS interval_s, count(st.icao24) AS reports FROM regions AS r LEFT JOIN st ON st.region = r.key GROUP BY ALL""")
def region_traffic_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-17: the catalogue with the reports seen per region."""
    n = bridge.states(spark, sf).groupBy(c("region").alias("key")).agg(F.count(F.lit(1)).alias("reports"))
    return reg.catalogue(spark).join(n, "key", "left").fillna(0, ["reports"])


@query("fleet_mix", S.states() + f""" SELECT coalesce(upper(aircraft_type), '?') AS type, count(DISTINCT (recording, icao24)) AS aircraft, count(*) AS fixes, round(avg(CASE WHEN {_MEAS} THEN CAST({_COMP} AS INT) END), 4) AS integrity_share,
  round(quantile_cont(gs_kt, 0.5), 2) AS gs_p50, round(quantile_cont(baro_alt_ft, 0.95), 2) AS alt_p95 FROM st GROUP BY ALL""")
def fleet_mix(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-39."""
    s = bridge.states(spark, sf)
    return s.groupBy(F.coalesce(F.upper("aircraft_type"), F.lit("?")).alias("type")).agg(
        F.countDistinct("recording", "icao24").alias("aircraft"), F.count(F.lit(1)).alias("fixes"), F.round(F.avg(F.when(F.expr(eco.MEASURED), F.expr(f"cast({eco.COMPLIANT} as int)"))), 4).alias("integrity_share"),
        F.round(F.percentile("gs_kt", F.lit(0.5)), 2).alias("gs_p50"), F.round(F.percentile("baro_alt_ft", F.lit(0.95)), 2).alias("alt_p95"))


@query("airports_in_extent", f"""WITH {places.VOL_CTE}, {S.dim('airports')}, h AS (SELECT a.icao, v.notam_id, row_number() OVER (PARTITION BY a.icao ORDER BY v.notam_id) AS r, bool_or_inside, mind FROM
   (SELECT a.icao, v.notam_id, {places.inside_sql('a.lat', 'a.lon')} AS bool_or_inside, list_min(list_transform(v.poly, lambda p: {S.hav('a.lat', 'a.lon', 'p[1]', 'p[2]')})) AS mind FROM airports AS a JOIN vol AS v ON NOT v.round_shape) AS q JOIN airports AS a USING (icao) JOIN vol AS v USING (notam_id)
   WHERE bool_or_inside OR mind <= 10) SELECT icao, notam_id AS extent, CASE WHEN bool_or_inside THEN 'inside' ELSE 'near' END AS relation FROM h WHERE r = 1""")
def airports_in_extent(spark: SparkSession, sf: str) -> DataFrame:
    """JON-13: airports inside or near an extent, first extent wins."""
    from airlens.operators.extents import airports_in_extents

    v = places.volumes(spark, sf).filter("polygon is not null").select(c("notam_id").alias("extent"), "polygon")
    return airports_in_extents(v, 10.0)
