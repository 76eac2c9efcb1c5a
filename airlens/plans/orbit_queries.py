"""Element sets from `orders`, as text lines and as numbers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.operators import elements as el
from airlens.plans import bridge
from airlens.plans import sqlbase as S
from airlens.plans.registry import query

c = F.col
START = 1735689600.0  # 2025-01-01
STEPS, STEP_S = 720, 30.0  # corridors: six hours


def _sheet(d: str) -> list[str]:
    """Integer fields of an element set per order; `d` is the integer division operator."""
    return [
        "o_orderkey as k", f"10000 + o_custkey % 80000 as norad", f"o_orderkey {d} 500 as file", "1 + o_orderkey % 360 as doy", "(o_orderkey * 7919) % 100000000 as frac8",
        "1500000000 + (o_custkey % 50) * 2000000 + (o_orderkey % 7) * 200000 as n8", "516000 + (o_custkey % 10) * 10000 + case when o_orderkey % 5 = 0 then 500 else 0 end as inc4",
        "(o_orderkey * 3701) % 3600000 as raan4", "1000 + (o_custkey % 90) * 1000 as ecc7", "(o_orderkey * 911) % 3600000 as argp4", "(o_orderkey * 1777) % 3600000 as m4",
        "case when o_custkey % 20 = 0 then 3000000 else (o_custkey * 31) % 9000 end as ndot8", "o_orderkey % 6 = 0 as ndot_neg", "1 + o_custkey % 99999 as bstar5",
    ]


def _dec(x: str, digits: int, width: int) -> str:
    one = 10**digits
    return f"lpad(concat(cast({x} div {one} as string), '.', lpad(cast({x} % {one} as string), {digits}, '0')), {width}, ' ')"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """The sets as fixed-width text; one in four without a name line, one in 97 with a wrong checksum."""
    o = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(*_sheet("div"))
    body1 = ("concat('1 ', lpad(cast(norad as string), 5, '0'), 'U 24001A   24', lpad(cast(doy as string), 3, '0'), '.', lpad(cast(frac8 as string), 8, '0'), ' ', case when ndot_neg then '-' else ' ' end, '.', lpad(cast(ndot8 as string), 8, '0'),"
             " '  00000-0  ', lpad(cast(bstar5 as string), 5, '0'), '-4 0  999')")
    body2 = f"concat('2 ', lpad(cast(norad as string), 5, '0'), ' ', {_dec('inc4', 4, 8)}, ' ', {_dec('raan4', 4, 8)}, ' ', lpad(cast(ecc7 as string), 7, '0'), ' ', {_dec('argp4', 4, 8)}, ' ', {_dec('m4', 4, 8)}, ' ', {_dec('n8', 8, 11)}, '00001')"
    o = o.selectExpr("k", "file", "norad", f"{body1} as b1", f"{body2} as b2")

    bad = F.when(c("k") % 97 == 0, 1).otherwise(0)
    o = o.withColumn("l1", F.concat("b1", ((el.digit_sum(c("b1")) + bad) % 10).cast("string"))).withColumn("l2", F.concat("b2", (el.digit_sum(c("b2")) % 10).cast("string")))
    name = F.when(c("k") % 4 != 3, F.concat(F.lit("OBJ-"), c("norad").cast("string")))
    rows = F.array_compact(F.array(F.when(name.isNotNull(), F.struct(F.lit(0).alias("i"), name.alias("text"))), F.struct(F.lit(1).alias("i"), c("l1").alias("text")), F.struct(F.lit(2).alias("i"), c("l2").alias("text"))))
    return o.select("file", "k", F.inline(rows)).select(c("file").cast("string").alias("file"), (c("k") * 3 + c("i")).alias("line_no"), "text")


def sets(spark: SparkSession, sf: str) -> DataFrame:
    return el.mean_elements(el.parse_lines(lines(spark, sf)))


_A = f"pow(398600.4418 / pow(n_rev_day * {2 * math.pi / 86400.0!r}, 2), 1.0 / 3.0)"
EL = f"""el0 AS (SELECT {', '.join(_sheet('//'))} FROM orders),
el1 AS (SELECT k, norad, file, k * 3 + 2 AS line_no, CASE WHEN k % 4 = 3 THEN 'NORAD ' || norad ELSE 'OBJ-' || norad END AS name, 1704067200 + (doy - 1 + frac8 / 1e8) * 86400 AS epoch, n8 / 1e8 AS n_rev_day, inc4 / 1e4 AS inc_deg, raan4 / 1e4 AS raan_deg,
  ecc7 / 1e7 AS e, argp4 / 1e4 AS argp_deg, m4 / 1e4 AS m_deg, (CASE WHEN ndot_neg THEN -1 ELSE 1 END) * ndot8 / 1e8 AS ndot, bstar5 / 1e5 * 1e-4 AS bstar FROM el0 WHERE k % 97 <> 0),
el AS (SELECT *, {_A} AS a_km, {_A} * (1 - e) - 6378.137 AS perigee_km, {_A} * (1 + e) - 6378.137 AS apogee_km FROM el1),
hist AS (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY norad, epoch ORDER BY CAST(file AS VARCHAR) DESC, line_no DESC) = 1),
newest AS (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY norad ORDER BY epoch DESC, CAST(file AS VARCHAR) DESC, line_no DESC) = 1),
dec0 AS (SELECT *, CASE WHEN ndot > 0 THEN greatest(({el.N_REENTRY!r} - n_rev_day) / (ndot * 2), 0) END AS decay_days FROM newest),
decaying AS (SELECT *, concat_ws(',', CASE WHEN perigee_km < 200 THEN 'low_perigee' END, CASE WHEN decay_days < 30 THEN 'decay_within_window' END) AS flags FROM dec0 WHERE perigee_km < 200 OR decay_days < 30)"""


@query("element_sets", f"WITH {EL} SELECT norad, name, round(epoch, 2) AS epoch, round(a_km, 4) AS a_km, round(e, 7) AS e, inc_deg, raan_deg, round(ndot, 8) AS ndot, round(bstar * 1e6, 5) AS bstar_e6, round(perigee_km, 3) AS perigee_km FROM el")
def element_sets(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-08, SCL-13 and SCL-14: text lines to checked sets to mean elements."""
    return sets(spark, sf).select("norad", "name", F.round("epoch", 2).alias("epoch"), F.round("a_km", 4).alias("a_km"), F.round("e", 7).alias("e"), "inc_deg", "raan_deg", F.round("ndot", 8).alias("ndot"),
                                  F.round(c("bstar") * 1e6, 5).alias("bstar_e6"), F.round("perigee_km", 3).alias("perigee_km"))


_CHG = """chg0 AS (SELECT norad, lag(epoch) OVER w AS from_epoch, epoch AS to_epoch, greatest((epoch - lag(epoch) OVER w) / 86400, 1e-3) AS days, a_km - lag(a_km) OVER w AS da_km, inc_deg - lag(inc_deg) OVER w AS di_deg,
   perigee_km - lag(perigee_km) OVER w AS dperigee_km FROM hist WINDOW w AS (PARTITION BY norad ORDER BY epoch)),
chg AS (SELECT *, da_km > 0.5 OR abs(da_km) > 2 * days OR abs(di_deg) > 0.02 AS manoeuvre FROM chg0 WHERE from_epoch IS NOT NULL)"""


@query("rule_manoeuvre", f"WITH {EL}, {_CHG} SELECT norad, round(from_epoch, 1) AS from_epoch, round(to_epoch, 1) AS to_epoch, round(da_km, 3) AS da_km, round(di_deg, 4) AS di_deg, round(dperigee_km, 2) AS dperigee_km, round(days, 2) AS days, manoeuvre FROM chg")
def rule_manoeuvre(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-15 and RUL-25 (manoeuvres)."""
    ch = el.changes(el.history(sets(spark, sf)))
    return ch.select("norad", F.round("from_epoch", 1).alias("from_epoch"), F.round("to_epoch", 1).alias("to_epoch"), F.round("da_km", 3).alias("da_km"), F.round("di_deg", 4).alias("di_deg"), F.round("dperigee_km", 2).alias("dperigee_km"), F.round("days", 2).alias("days"), "manoeuvre")


@query("rule_decay", f"WITH {EL} SELECT norad, name, round(perigee_km, 1) AS perigee_km, round(decay_days, 1) AS decay_days, flags, round(({START} - epoch) / 3600, 1) AS age_h, ({START} - epoch) > 172800 AS stale FROM decaying")
def rule_decay(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-18, WIN-19, RUL-25 (decay) and RUL-35 (old sets)."""
    d = el.decaying(sets(spark, sf), START)
    return d.select("norad", "name", F.round("perigee_km", 1).alias("perigee_km"), F.round("decay_days", 1).alias("decay_days"), F.concat_ws(",", "flags").alias("flags"), F.round("age_h", 1).alias("age_h"), (c("age_h") > 48).alias("stale"))


@query("rule_stale_elements", f"WITH {EL} SELECT norad, round(({START} - epoch) / 86400, 2) AS age_days, 'ORB-001' AS rule_id FROM newest WHERE ({START} - epoch) / 86400 > 7")
def rule_stale_elements(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-23 (age)."""
    return el.stale(el.newest(sets(spark, sf)), START).select("norad", F.round("age_days", 2).alias("age_days"), F.lit("ORB-001").alias("rule_id"))


def _eph_sql(src: str, t: str) -> str:
    """Positions for rows of `src` with a time column, as nested selects."""
    q = f"(SELECT *, {t} - epoch AS dt, n_rev_day * {2 * math.pi / 86400.0!r} AS nn, a_km * (1 - e * e) AS pp, cos(radians(inc_deg)) AS ci, sin(radians(inc_deg)) AS si FROM {src})"
    q = f"(SELECT *, 1.5 * {el.J2!r} * pow(6378.137 / pp, 2) * nn AS kk, radians(m_deg) + nn * dt AS m0 FROM {q} AS z1)"
    q = f"(SELECT *, radians(raan_deg) - kk * ci * dt AS om, radians(argp_deg) + kk * (2 - 2.5 * si * si) * dt AS ww, m0 - floor(m0 / {2 * math.pi!r}) * {2 * math.pi!r} AS mm FROM {q} AS z2)"
    q = f"(SELECT *, mm AS ea0 FROM {q} AS z3)"
    for i in range(6):
        q = f"(SELECT *, ea{i} - (ea{i} - e * sin(ea{i}) - mm) / (1 - e * cos(ea{i})) AS ea{i + 1} FROM {q} AS y{i})"
    q = f"(SELECT *, a_km * (cos(ea6) - e) AS xp, a_km * sqrt(1 - e * e) * sin(ea6) AS yp, nn / (1 - e * cos(ea6)) AS ed FROM {q} AS z4)"
    rows = [("x", "(cos(om) * cos(ww) - sin(om) * sin(ww) * ci)", "(-cos(om) * sin(ww) - sin(om) * cos(ww) * ci)"), ("y", "(sin(om) * cos(ww) + cos(om) * sin(ww) * ci)", "(-sin(om) * sin(ww) + cos(om) * cos(ww) * ci)"), ("z", "(sin(ww) * si)", "(cos(ww) * si)")]
    pos = ", ".join(f"{p} * xp + {r} * yp AS {ax}_km" for ax, p, r in rows)
    vel = ", ".join(f"{p} * (-a_km * sin(ea6) * ed) + {r} * (a_km * sqrt(1 - e * e) * cos(ea6) * ed) AS v{ax}_kms" for ax, p, r in rows)
    return f"(SELECT *, {pos}, {vel} FROM {q} AS z5)"


_GRID = f"grid AS (SELECT n.*, t.t_idx, {START} + t.t_idx * 60 AS ts FROM newest AS n, (SELECT unnest(range(0, 360)) AS t_idx) AS t)"
_EPH = f"{_GRID}, eph AS (SELECT * FROM {_eph_sql('grid', 'ts')} AS q)"


@query("ephemeris_table", f"WITH {EL}, {_EPH} SELECT norad, CAST(t_idx AS INTEGER) AS t_idx, ts, {', '.join(f'round({a}_km, 3) AS {a}_km' for a in 'xyz')}, {', '.join(f'round(v{a}_kms, 5) AS v{a}_kms' for a in 'xyz')} FROM eph")
def ephemeris_table(spark: SparkSession, sf: str) -> DataFrame:
    """The ephemeris contract, six hours at 60 s."""
    e = el.ephemeris(el.newest(sets(spark, sf)), START, 360, 60.0)
    return e.select("norad", "t_idx", "ts", *[F.round(f"{a}_km", 3).alias(f"{a}_km") for a in "xyz"], *[F.round(f"v{a}_kms", 5).alias(f"v{a}_kms") for a in "xyz"])


_JD = "((ts / 86400.0 + 2440587.5 - 2451545.0) / 36525.0)"
_NN = "(6378.137 / sqrt(1 - {e2} * pow(sin(l{i}), 2)))".replace("{e2}", repr(el.E2))
_geo = f"(SELECT *, radians((67310.54841 + (876600.0 * 3600 + 8640184.812866) * {_JD} + 0.093104 * {_JD} * {_JD} - 6.2e-6 * pow({_JD}, 3)) / 240) AS th, sqrt(x_km * x_km + y_km * y_km) AS p, atan2(z_km, sqrt(x_km * x_km + y_km * y_km) * (1 - {el.E2!r})) AS l0 FROM eph)"
for _i in range(4):
    _n = _NN.replace("{i}", str(_i))
    _geo = f"(SELECT *, atan2(z_km, p * (1 - {el.E2!r} * {_n} / ({_n} + (p / cos(l{_i}) - {_n})))) AS l{_i + 1} FROM {_geo} AS g{_i})"
_LON = "degrees(atan2(y_km, x_km) - th) + 180"
_GEO = f"geo AS (SELECT *, degrees(l4) AS lat, ((({_LON}) % 360) + 360) % 360 - 180 AS lon, p / cos(l4) - {_NN.replace('{i}', '4')} AS height_km FROM {_geo} AS q)"


@query("ground_track", f"WITH {EL}, {_EPH}, {_GEO} SELECT norad, CAST(t_idx AS INTEGER) AS t_idx, round(lat, 4) AS lat, round(lon, 4) AS lon, round(height_km, 2) AS height_km FROM geo")
def ground_track(spark: SparkSession, sf: str) -> DataFrame:
    """SCL-16."""
    g = el.geodetic(el.ephemeris(el.newest(sets(spark, sf)), START, 360, 60.0))
    return g.select("norad", "t_idx", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("height_km", 2).alias("height_km"))


_W = "sqrt(pow((lat - a_lat) * 60, 2) + pow(((((lon - a_lon + 180) % 360) + 360) % 360 - 180) * 60 * cos(radians(a_lat)), 2))"


@query("rule_corridor_airports", f"""WITH {EL}, {S.dim('airports')}, grid AS (SELECT n.*, t.t_idx, {START} + t.t_idx * 30 AS ts FROM decaying AS n, (SELECT unnest(range(0, 720)) AS t_idx) AS t), eph AS (SELECT * FROM {_eph_sql('grid', 'ts')} AS q), {_GEO},
  x AS (SELECT g.norad, a.icao, g.ts, g.height_km, {_W.replace('a_lat', 'a.lat').replace('a_lon', 'a.lon').replace('(lat -', '(g.lat -').replace('(lon -', '(g.lon -').replace('((((lon', '((((g.lon')} AS nm FROM geo AS g, airports AS a)
  SELECT norad, icao, round(nm, 2) AS min_nm, ts FROM x WHERE nm <= 50 QUALIFY row_number() OVER (PARTITION BY norad, icao ORDER BY nm, ts) = 1""")
def rule_corridor_airports(spark: SparkSession, sf: str) -> DataFrame:
    """JON-07 and RUL-35: airports under six hours of the tracks of decaying objects."""
    g = el.geodetic(el.ephemeris(el.decaying(sets(spark, sf), START), START, STEPS, STEP_S))
    return el.corridor_airports(g).select("norad", "icao", F.round("min_nm", 2).alias("min_nm"), "ts")


_T1 = 1.7e9
_W2 = "sqrt(pow((g.lat - s.lat) * 60, 2) + pow(((((g.lon - s.lon + 180) % 360) + 360) % 360 - 180) * 60 * cos(radians(s.lat)), 2))"


@query("rule_corridor_aircraft", f"""WITH RECURSIVE {bridge.states_cte()}, {EL}, grid AS (SELECT n.*, t.t_idx, {_T1} + t.t_idx * 30 AS ts FROM decaying AS n, (SELECT unnest(range(0, 720)) AS t_idx) AS t), eph AS (SELECT * FROM {_eph_sql('grid', 'ts')} AS q), {_GEO},
  fs AS (SELECT *, CAST(ceil((ts - {_T1}) / 30 - 0.5) AS BIGINT) AS ti FROM st WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT on_ground),
  x AS (SELECT g.norad, s.recording, s.icao24, s.ts, {_W2} AS nm FROM fs AS s JOIN geo AS g ON g.t_idx = s.ti AND g.lat BETWEEN s.lat - 7 AND s.lat + 7)
  SELECT norad, recording, icao24, round(nm, 2) AS min_nm, ts FROM x WHERE nm <= 400 QUALIFY row_number() OVER (PARTITION BY norad, recording, icao24 ORDER BY nm, ts) = 1""")
def rule_corridor_aircraft(spark: SparkSession, sf: str) -> DataFrame:
    """JON-07: aircraft under the tracks of decaying objects at the nearest sample."""
    g = el.geodetic(el.ephemeris(el.decaying(sets(spark, sf), _T1), _T1, STEPS, STEP_S))
    return el.corridor_aircraft(g, bridge.states(spark, sf), _T1, STEP_S, 400.0).select("norad", "recording", "icao24", F.round("min_nm", 2).alias("min_nm"), "ts")


@query("rule_unusable_elements", f"""WITH {EL}, bad AS (SELECT norad, name, CASE WHEN norad % 7 = 0 THEN NULL ELSE n_rev_day END AS n, CASE WHEN norad % 11 = 0 THEN 1.2 ELSE e END AS e, CASE WHEN norad % 13 = 0 THEN -50.0 ELSE perigee_km END AS perigee_km FROM newest)
  SELECT norad, name, CASE WHEN n IS NULL THEN 'missing numbers' WHEN e >= 1 THEN 'open orbit' ELSE 'below the surface' END AS reason, 'ORB-003' AS rule_id, 'low' AS severity FROM bad WHERE n IS NULL OR e >= 1 OR perigee_km < 0""")
def rule_unusable_elements(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-23 (sets that cannot be propagated): some numbers spoiled."""
    n = el.newest(sets(spark, sf)).withColumn("n_rev_day", F.when(c("norad") % 7 != 0, c("n_rev_day"))).withColumn("e", F.when(c("norad") % 11 == 0, 1.2).otherwise(c("e"))).withColumn("perigee_km", F.when(c("norad") % 13 == 0, -50.0).otherwise(c("perigee_km")))
    return el.unusable(n)


_COR = f"""WITH RECURSIVE {bridge.states_cte()}, {EL}, {S.dim('airports')}, grid AS (SELECT n.*, t.t_idx, {_T1} + t.t_idx * 30 AS ts FROM decaying AS n, (SELECT unnest(range(0, 720)) AS t_idx) AS t), eph AS (SELECT * FROM {_eph_sql('grid', 'ts')} AS q), {_GEO},
  fs AS (SELECT *, CAST(ceil((ts - {_T1}) / 30 - 0.5) AS BIGINT) AS ti FROM st WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT on_ground),
  un AS (SELECT DISTINCT g.norad, s.recording, s.icao24 FROM fs AS s JOIN geo AS g ON g.t_idx = s.ti AND g.lat BETWEEN s.lat - 7 AND s.lat + 7 WHERE {_W2} <= 400),
  ua AS (SELECT DISTINCT g.norad, a.icao FROM geo AS g JOIN airports AS a ON g.lat BETWEEN a.lat - 1 AND a.lat + 1 WHERE {_W.replace('a_lat', 'a.lat').replace('a_lon', 'a.lon').replace('(lat -', '(g.lat -').replace('(lon -', '(g.lon -').replace('((((lon', '((((g.lon')} <= 50)"""


@query("rule_reentry", f"""{_COR} SELECT norad, recording, 'REN-001' AS rule_id, 'low' AS severity, 'safety' AS category, CAST(count(*) AS DOUBLE) AS measure FROM un GROUP BY ALL
  UNION ALL SELECT norad, NULL, 'REN-002', 'low', 'operations', CAST(count(*) AS DOUBLE) FROM ua GROUP BY ALL UNION ALL SELECT norad, NULL, 'REN-003', 'low', 'data-quality', round(({_T1} - epoch) / 3600, 1) FROM decaying WHERE {_T1} - epoch > 172800""")
def rule_reentry(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-35: aircraft and airports under the corridors of decaying objects, and sets too old for them."""
    d = el.decaying(sets(spark, sf), _T1)
    g = el.geodetic(el.ephemeris(d, _T1, STEPS, STEP_S))
    return el.reentry_findings(d, el.corridor_aircraft(g, bridge.states(spark, sf), _T1, STEP_S, 400.0), el.corridor_airports(g)).withColumn("measure", F.round("measure", 1))


SCREEN_STEPS = 1440  # close approaches: 24 hours at 60 s
_DAY = _EPH.replace("range(0, 360)", f"range(0, {SCREEN_STEPS})")
_D = "sqrt(pow(a.x_km - b.x_km, 2) + pow(a.y_km - b.y_km, 2) + pow(a.z_km - b.z_km, 2))"
_FINE = f"""cp AS (SELECT a.norad AS a, b.norad AS b, a.ts AS t0, {_D} AS d FROM eph AS a JOIN eph AS b ON a.t_idx = b.t_idx AND a.norad < b.norad AND abs(a.x_km - b.x_km) <= 100 AND abs(a.y_km - b.y_km) <= 100 AND abs(a.z_km - b.z_km) <= 100 WHERE {_D} <= 100),
bp AS (SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY d, t0) = 1),
fg AS (SELECT bp.*, bp.t0 - 60 + i.i AS ft FROM bp, (SELECT unnest(range(0, 121)) AS i) AS i WHERE bp.t0 - 60 + i.i BETWEEN {START} AND {START} + {SCREEN_STEPS * 60}),
fa AS (SELECT fg.a, fg.b, fg.ft AS ts, n.* EXCLUDE (norad) FROM fg JOIN newest AS n ON n.norad = fg.a), ea AS (SELECT * FROM {_eph_sql('fa', 'ts')} AS q),
fb AS (SELECT fg.a, fg.b, fg.ft AS ts, n.* EXCLUDE (norad) FROM fg JOIN newest AS n ON n.norad = fg.b), eb AS (SELECT * FROM {_eph_sql('fb', 'ts')} AS q),
ff AS (SELECT a.a, a.b, a.ts, {_D} AS d, sqrt(pow(a.vx_kms - b.vx_kms, 2) + pow(a.vy_kms - b.vy_kms, 2) + pow(a.vz_kms - b.vz_kms, 2)) AS v FROM ea AS a JOIN eb AS b ON a.a = b.a AND a.b = b.b AND a.ts = b.ts)"""


@query("rule_close_approach", f"""WITH {EL}, {_DAY}, {_FINE} SELECT a, b, ts AS tca, round(d, 3) AS min_km, round(v, 4) AS rel_speed_kms, v < 0.05 AS co_moving, CASE WHEN v >= 0.05 THEN CASE WHEN d < 10 THEN 'high' ELSE 'medium' END END AS severity, CASE WHEN v >= 0.05 THEN 'ORB-002' END AS rule_id
  FROM (SELECT * FROM ff QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY d, ts) = 1) AS q WHERE d <= 20""")
def rule_close_approach(spark: SparkSession, sf: str) -> DataFrame:
    """JON-18 and RUL-23: pairwise screen over 24 hours, threshold 20 km; co-moving pairs raise nothing."""
    return el.screen(el.newest(sets(spark, sf)), START, SCREEN_STEPS, 60.0, 20.0).select("a", "b", "tca", F.round("min_km", 3).alias("min_km"), F.round("rel_speed_kms", 4).alias("rel_speed_kms"), "co_moving", "severity", "rule_id")
