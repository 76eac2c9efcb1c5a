"""Telemetry, packets, conjunctions, debris, space weather and the object catalogue over driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.operators import catalogue as cat
from airlens.operators import conjunctions as cj
from airlens.operators import debris as deb
from airlens.operators import spaceweather as swx
from airlens.operators import telemetry as tel
from airlens.plans.orbit_queries import EL, START, sets
from airlens.plans.registry import query
from airlens.session import spread

c = F.col
NOW = 1.7e9

# ---- telemetry: lineitem rows of a supplier are a stream in order of arrival
_TEL = ["concat('S', cast(l_suppkey as varchar(12))) as stream", "l_orderkey as o1", "l_linenumber as o2", "l_partkey as o3", "l_extendedprice as o4",
        "round(l_orderkey * 0.1e0 + l_linenumber * 0.02e0 - case when l_returnflag = 'R' and l_linenumber = 1 then 5 else 0 end, 2) as t_s",
        "round(100.0e0 + l_orderkey * 0.2e0 + case when l_discount > 0.09e0 then 300 else 0 end, 1) as speed_mps", "round(l_orderkey * 0.01e0 + case when l_tax > 0.07e0 then 6 else 0 end, 2) as altitude_km"]
_ORD = ["o1", "o2", "o3", "o4"]


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(*_TEL)


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return tel.steps(_points(spark, sf), _ORD, F.floor(c("o1") / 2000))


_TS = f"""tp AS (SELECT {', '.join(_TEL)} FROM lineitem), tl AS (SELECT *, lag(t_s) OVER w AS t1, lag(speed_mps) OVER w AS v1, lag(altitude_km) OVER w AS a1 FROM tp WINDOW w AS (PARTITION BY stream ORDER BY o1, o2, o3, o4)),
td AS (SELECT *, t_s - t1 AS dt, CASE WHEN t_s - t1 >= 0.05 THEN (speed_mps - v1) / (t_s - t1) END AS acc, CASE WHEN t_s - t1 >= 0.05 THEN (altitude_km - a1) * 1000 / (t_s - t1) END AS vs, CASE WHEN t_s - t1 >= 0.05 THEN altitude_km - a1 END AS da FROM tl WHERE t1 IS NOT NULL),
tf AS (SELECT stream, t_s, 'SPC-004' AS rule_id, 'high' AS severity, dt AS measure FROM td WHERE dt <= 0 UNION ALL SELECT stream, t_s, 'SPC-003', 'medium', dt FROM td WHERE dt > 10
  UNION ALL SELECT stream, t_s, 'SPC-001', 'high', acc FROM td WHERE dt > 0 AND abs(acc) > 60 UNION ALL SELECT stream, t_s, 'SPC-002', 'high', vs FROM td WHERE dt > 0 AND speed_mps >= 100 AND abs(vs) > speed_mps + 150
  UNION ALL SELECT stream, t_s, 'SPC-005', 'medium', da FROM td WHERE dt > 0 AND abs(da) > 5)"""


@query("rule_telemetry", f"WITH {_TS} SELECT stream, t_s, rule_id, severity, round(measure, 3) AS measure FROM tf")
def rule_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-16 and RUL-21."""
    return tel.findings(_steps(spark, sf)).select("stream", "t_s", "rule_id", "severity", F.round("measure", 3).alias("measure"))


@query("telemetry_summary", f"WITH {_TS}, n AS (SELECT stream, count(*) AS findings, {', '.join(f'''count(*) FILTER (rule_id = 'SPC-00{i}') AS spc_00{i}''' for i in range(1, 6))} FROM tf GROUP BY ALL) SELECT s.*, coalesce(findings, 0) AS findings, {', '.join(f'coalesce(spc_00{i}, 0) AS spc_00{i}' for i in range(1, 6))} FROM (SELECT stream, count(*) AS samples, max(speed_mps) AS max_speed_mps, max(altitude_km) AS max_altitude_km FROM tp GROUP BY ALL) AS s LEFT JOIN n USING (stream)")
def telemetry_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-27."""
    return tel.summary(_points(spark, sf), tel.findings(_steps(spark, sf)))


# ---- packets: events of a user group, signed with a demonstration key; some altered, some unsigned, some replayed
_KEY = b"airlens-demonstration-key"
_IPAD, _OPAD = tel.key_pads(_KEY)
_PK = ["event_id", "concat('P', cast(user_id % 4 as varchar(4))) as stream", "cast(user_id % 3 as int) as spi", "value", "cast(regexp_extract(props, '([0-9]+)', 1) as int) as k", "event_id * 0.5e0 as t_s", "value as speed_mps", "value as altitude_km"]


def _packets(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/events.parquet").selectExpr(*_PK)
    p = p.withColumn("seq", F.when(c("k") == 9, c("event_id") - 50).otherwise(c("event_id")))
    good = tel.hmac_sha256(tel.canonical(c("spi"), c("seq"), c("t_s"), c("speed_mps"), c("altitude_km")), F.lit(_IPAD), F.lit(_OPAD))
    return p.withColumn("mac", F.when(c("k") == 5, None).when(c("value") > 200, F.concat(F.lit("00"), F.substring(good, 3, 62))).otherwise(good))


def _authenticated(spark: SparkSession, sf: str) -> DataFrame:
    keys = spark.createDataFrame([(0, _IPAD, _OPAD), (1, _IPAD, _OPAD)], "spi int, ipad string, opad string")
    return tel.authenticate(_packets(spark, sf), F.broadcast(keys), ["event_id"], F.floor(c("event_id") / 5000))


_PKS = f"""pk0 AS (SELECT {', '.join(_PK)} FROM events), pk1 AS (SELECT *, CASE WHEN k = 9 THEN event_id - 50 ELSE event_id END AS seq FROM pk0),
pk2 AS (SELECT *, printf('%d|%d|%.6f|%.6f|%.6f', spi, seq, t_s, speed_mps, altitude_km) AS msg FROM pk1),
pk3 AS (SELECT *, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(msg)))) AS good FROM pk2),
pk4 AS (SELECT *, CASE WHEN k = 5 THEN NULL WHEN value > 200 THEN '00' || substr(good, 3, 62) ELSE good END AS mac FROM pk3),
pk5 AS (SELECT *, CASE WHEN mac IS NULL THEN 'unauthenticated' WHEN spi NOT IN (0, 1) THEN 'no-key' WHEN mac = good THEN 'verified' ELSE 'failed' END AS status FROM pk4),
pk AS (SELECT *, coalesce(status = 'verified' AND seq <= max(CASE WHEN status = 'verified' THEN seq END) OVER (PARTITION BY stream, spi ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS replay FROM pk5)"""


@query("packet_authentication", f"WITH {_PKS} SELECT event_id, stream, spi, seq, mac, status, replay FROM pk")
def packet_authentication(spark: SparkSession, sf: str) -> DataFrame:
    """SCL-17 and WIN-17."""
    return _authenticated(spark, sf).select("event_id", "stream", "spi", "seq", "mac", "status", "replay")


@query("rule_packets", f"""WITH {_PKS} SELECT stream, 'SPC-006' AS rule_id, 'high' AS severity, seq AS measure FROM pk WHERE status = 'failed'
  UNION ALL SELECT stream, 'SPC-008', 'medium', seq FROM pk WHERE replay UNION ALL SELECT stream, 'SPC-007', 'low', count(*) FROM pk WHERE status IN ('unauthenticated', 'no-key') GROUP BY ALL""")
def rule_packets(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-22."""
    return tel.auth_findings(_authenticated(spark, sf))


@query("packet_summary", f"WITH {_PKS} SELECT stream, count(*) AS packets, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'unauthenticated') AS unauthenticated, count(*) FILTER (status = 'no-key') AS no_key, count(*) FILTER (replay) AS replays, round(count(*) FILTER (status = 'verified') / count(*), 4) AS trusted_share FROM pk GROUP BY ALL")
def packet_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-26."""
    return tel.auth_summary(_authenticated(spark, sf))


# ---- conjunction messages: one per customer, as text
#: messages of a task: reading, parsing and integrating one takes some hundred microseconds
MESSAGES_PER_TASK = 5_000
_CD = ["c_custkey as k", "7000.0e0 + c_custkey % 50 as x", "(c_custkey % 7) * 0.01e0 as dx", "0.02e0 + (c_custkey % 11) * 0.03e0 as dy", "(c_custkey % 5) * 0.02e0 as dz",
       "case when c_custkey % 23 = 0 then -100.0e0 else 400.0e0 + (c_custkey % 9) * 900 end as crr", "2500.0e0 + (c_custkey % 4) * 1000 as ctt", "900.0e0 as cnn", "(c_custkey % 3) * 50.0e0 as ctr"]


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Key-value text built from numbers, to be parsed again."""
    m = spread(spark.read.parquet(f"{sf}/customer.parquet").selectExpr(*_CD), MESSAGES_PER_TASK)
    kv = lambda k, v: F.concat(F.lit(f"{k} = "), v.cast("string"))
    n = lambda v: F.format_string("%.6f", v)
    miss = F.sqrt(c("dx") * c("dx") + c("dy") * c("dy") + c("dz") * c("dz")) * 1000
    head = [F.lit("CCSDS_CDM_VERS = 1.0"), F.lit("COMMENT demonstration"), kv("MESSAGE_ID", F.concat(F.lit("M"), c("k"))), F.lit("ORIGINATOR = TEST"), kv("TCA", F.lit("2024-01-01T00:00:00")),
            F.concat(F.lit("MISS_DISTANCE = "), n(F.when(c("k") % 6 == 0, miss * 2).otherwise(miss)), F.lit(" [m]"))]

    def obj(i: int, pos, vel):
        cov = [("CR_R", c("crr")), ("CT_R", c("ctr")), ("CT_T", c("ctt")), ("CN_R", F.lit(0.0)), ("CN_T", F.lit(0.0)), ("CN_N", c("cnn"))]
        return [F.lit(f"OBJECT = OBJECT{i}"), kv("OBJECT_DESIGNATOR", F.concat(F.lit(f"D{i}-"), c("k") % 40)), *[F.concat(F.lit(f"{a} = "), n(v), F.lit(" [km]")) for a, v in zip("XYZ", pos, strict=True)],
                *[F.concat(F.lit(f"{a}_DOT = "), n(v), F.lit(" [km/s]")) for a, v in zip("XYZ", vel, strict=True)], *[F.concat(F.lit(f"{k} = "), n(v), F.lit(" [m**2]")) for k, v in cov]]

    lines = [*head, *obj(1, (c("x"), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(7.5), F.lit(0.0))), *obj(2, (c("x") + c("dx"), c("dy"), c("dz")), (F.lit(0.5), F.lit(1.0), F.lit(7.4)))]
    return m.select(c("k").cast("string").alias("file"), F.concat_ws("\n", *lines).alias("text"))


_CDS = f"""cd AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) * 1000 AS miss FROM (SELECT {', '.join(_CD)} FROM customer) AS q),
cd1 AS (SELECT *, x + dx AS x2, dy AS y2, dz AS z2, CASE WHEN k % 6 = 0 THEN miss * 2 ELSE miss END AS stated FROM cd)"""


@query("conjunction_messages", f"WITH {_CDS} SELECT 'M' || k AS message_id, 'D1-' || (k % 40) AS object1, 'D2-' || (k % 40) AS object2, round(stated, 2) AS stated_miss_m, round(x, 5) AS o1_x, round(x2, 5) AS o2_x, round(y2, 5) AS o2_y, CAST(7.4 AS DOUBLE) AS o2_z_dot, crr AS o1_cr_r, ctr AS o2_ct_r FROM cd1")
def conjunction_messages(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-09."""
    p = cj.parse_kvn(_messages(spark, sf))
    return p.select("message_id", "object1", "object2", F.round("stated_miss_m", 2).alias("stated_miss_m"), F.round("o1_x", 5).alias("o1_x"), F.round("o2_x", 5).alias("o2_x"), F.round("o2_y", 5).alias("o2_y"), "o2_z_dot", "o1_cr_r", "o2_ct_r")


def _rtn(p: str, r: tuple[str, str, str], v: tuple[float, float, float]) -> str:
    """Columns of the rotation from radial-transverse-normal for object p."""
    h = [f"({r[1]} * {v[2]} - {r[2]} * {v[1]})", f"({r[2]} * {v[0]} - {r[0]} * {v[2]})", f"({r[0]} * {v[1]} - {r[1]} * {v[0]})"]
    rn, hn = f"sqrt({' + '.join(f'{a} * {a}' for a in r)})", f"sqrt({' + '.join(f'{a} * {a}' for a in h)})"
    return ", ".join([*[f"{r[i]} / {rn} AS {p}r{i}" for i in range(3)], *[f"{h[i]} / {hn} AS {p}n{i}" for i in range(3)]])


def _crs(a: str, b: str) -> list[str]:
    return [f"({a}1 * {b}2 - {a}2 * {b}1)", f"({a}2 * {b}0 - {a}0 * {b}2)", f"({a}0 * {b}1 - {a}1 * {b}0)"]


def _covsum() -> str:
    out = []
    for i in range(3):
        for j in range(3):
            terms = [f"({p}r{i} * crr * {p}r{j} + {p}r{i} * ctr * {p}t{j} + {p}t{i} * ctr * {p}r{j} + {p}t{i} * ctt * {p}t{j} + {p}n{i} * cnn * {p}n{j})" for p in ("a", "b")]
            out.append(f"{' + '.join(terms)} AS q{i}{j}")
    return ", ".join(out)


_V = (500.0, -6500.0, 7400.0)
_VN = sum(x * x for x in _V) ** 0.5
_U = [x / _VN for x in _V]
_PROJ = lambda a, b: " + ".join(f"{a}{i} * q{i}{j} * {b}{j}" for i in range(3) for j in range(3))
_PCS = f"""{_CDS}, c2 AS (SELECT *, {_rtn('a', ('x', '0', '0'), (0.0, 7.5, 0.0))}, {_rtn('b', ('x2', 'y2', 'z2'), (0.5, 1.0, 7.4))} FROM cd1 WHERE k % 23 <> 0),
c3 AS (SELECT *, {', '.join(f'{e} AS at{i}' for i, e in enumerate(_crs('an', 'ar')))}, {', '.join(f'{e} AS bt{i}' for i, e in enumerate(_crs('bn', 'br')))} FROM c2), c4 AS (SELECT *, {_covsum()} FROM c3),
c5 AS (SELECT *, dx * 1000 - al * {_U[0]!r} AS p0, dy * 1000 - al * {_U[1]!r} AS p1, dz * 1000 - al * {_U[2]!r} AS p2 FROM (SELECT *, dx * 1000 * {_U[0]!r} + dy * 1000 * {_U[1]!r} + dz * 1000 * {_U[2]!r} AS al FROM c4) AS q),
c6 AS (SELECT *, sqrt(p0 * p0 + p1 * p1 + p2 * p2) AS mx FROM c5), c7 AS (SELECT *, p0 / mx AS e0, p1 / mx AS e1, p2 / mx AS e2 FROM c6),
c8 AS (SELECT *, {_U[1]!r} * e2 - {_U[2]!r} * e1 AS g0, {_U[2]!r} * e0 - {_U[0]!r} * e2 AS g1, {_U[0]!r} * e1 - {_U[1]!r} * e0 AS g2 FROM c7), c9 AS (SELECT *, {_PROJ('e', 'e')} AS s11, {_PROJ('e', 'g')} AS s12, {_PROJ('g', 'g')} AS s22 FROM c8),
gridp AS (SELECT (i + 0.5) * 0.25 * cos((j + 0.5) * {2 * 3.141592653589793 / 180!r}) AS gx, (i + 0.5) * 0.25 * sin((j + 0.5) * {2 * 3.141592653589793 / 180!r}) AS gy, (i + 0.5) * 0.25 * 0.25 * {2 * 3.141592653589793 / 180!r} AS gw FROM range(80) AS a(i), range(180) AS b(j)),
pcs AS (SELECT k, any_value(miss) AS miss, any_value(stated) AS stated, least(1.0, sum(exp(-0.5 * (s22 * (gx - mx) * (gx - mx) - 2 * s12 * (gx - mx) * gy + s11 * gy * gy) / (s11 * s22 - s12 * s12)) * gw) / (2 * {3.141592653589793!r} * sqrt(any_value(s11 * s22 - s12 * s12)))) AS pc FROM c9, gridp GROUP BY k)"""


def _assessed(spark: SparkSession, sf: str) -> DataFrame:
    return cj.probability(cj.parse_kvn(_messages(spark, sf)))


@query("collision_probability", f"WITH {_PCS} SELECT 'M' || c.k AS message_id, round(c.miss, 3) AS miss_m, round(pc * 1e6, 2) AS pc_e6, CASE WHEN c.k % 23 = 0 THEN 'covariance not positive definite' END AS error FROM cd1 AS c LEFT JOIN pcs ON c.k = pcs.k")
def collision_probability(spark: SparkSession, sf: str) -> DataFrame:
    """SCL-12."""
    return _assessed(spark, sf).select("message_id", F.round("miss_m", 3).alias("miss_m"), F.round(c("pc") * 1e6, 2).alias("pc_e6"), "error")


@query("rule_conjunction", f"""WITH {_PCS} SELECT 'M' || k AS message_id, 'ORB-005' AS rule_id, 'medium' AS severity, 'covariance not positive definite' AS note FROM cd1 WHERE k % 23 = 0
  UNION ALL SELECT 'M' || k, 'ORB-005', 'medium', 'stated miss differs' FROM pcs WHERE abs(miss - stated) / stated > 0.05 UNION ALL SELECT 'M' || k, 'ORB-004', CASE WHEN pc >= 1e-4 THEN 'high' ELSE 'medium' END, CASE WHEN pc >= 1e-4 THEN 'above the manoeuvre threshold' ELSE 'monitor' END FROM pcs WHERE pc >= 1e-7""")
def rule_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-24."""
    return cj.findings(_assessed(spark, sf))


# ---- ledger: orders as summary messages about pairs
_LED = ["concat('O', cast(o_custkey % 97 as varchar(8)), '/P', cast(o_custkey % 13 as varchar(8))) as pair", "cast(1.7e9 + (o_orderkey % 9) * 400 as double) as tca_ts", "concat('M', cast(o_orderkey as varchar(12))) as message_id",
        "lpad(cast(o_orderkey % 500 as varchar(8)), 4, '0') as creation_date", "lpad(cast(o_orderkey as varchar(12)), 10, '0') as received_at", "case when o_orderkey % 3 = 0 then null else o_totalprice / 1e9 end as pc", "o_totalprice / 2e9 as stated_pc",
        "case when o_orderkey % 4 = 0 then 'terms' else null end as restricted", "o_orderstatus as sha256"]


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr(*_LED)


@query("conjunction_events", f"""WITH lg AS (SELECT *, floor(tca_ts / 600) AS bucket, coalesce(pc, stated_pc) AS p, creation_date || received_at AS o FROM (SELECT {', '.join(_LED)} FROM orders) AS q),
  ev AS (SELECT pair, CAST(bucket AS BIGINT) AS bucket, count(*) AS messages, max(p) AS max_pc, arg_max(message_id, o) AS latest_message_id, list(p ORDER BY o DESC) AS ps FROM lg GROUP BY ALL)
  SELECT pair, bucket, messages, round(max_pc * 1e6, 7) AS max_pc_e6, latest_message_id, round(ps[1] * 1e6, 7) AS latest_pc_e6, CASE WHEN ps[1] > ps[2] * 1.5 THEN 'escalating' WHEN ps[1] < ps[2] / 1.5 THEN 'de-escalating' ELSE 'stable' END AS trend FROM ev""")
def conjunction_events(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-21."""
    return cj.events(_ledger(spark, sf)).select("pair", "bucket", "messages", F.round(c("max_pc") * 1e6, 7).alias("max_pc_e6"), "latest_message_id", F.round(c("latest_pc") * 1e6, 7).alias("latest_pc_e6"), "trend")


@query("ledger_new_messages", """WITH inbox AS (SELECT concat('M', o_custkey) AS message_id, o_orderstatus AS sha256 FROM orders), led AS (SELECT concat('M', c_custkey) AS message_id, CASE WHEN c_acctbal > 3000 THEN 'F' ELSE 'O' END AS sha256 FROM customer)
  SELECT DISTINCT message_id, sha256 FROM inbox WHERE (message_id, sha256) NOT IN (SELECT (message_id, sha256) FROM led)""")
def ledger_new_messages(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-05 and SET-05: messages not yet in the ledger."""
    from airlens.sources.sinks import new_messages

    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("M"), c("o_custkey").cast("string")).alias("message_id"), c("o_orderstatus").alias("sha256"))
    led = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("M"), c("c_custkey").cast("string")).alias("message_id"), F.when(c("c_acctbal") > 3000, "F").otherwise("O").alias("sha256"))
    return new_messages(o, led).select("message_id", "sha256")


@query("ledger_restricted_share", f"SELECT count(*) AS rows, count(restricted) AS restricted_rows, round(avg(CAST(restricted IS NOT NULL AS INT)), 4) AS restricted_share FROM (SELECT {', '.join(_LED)} FROM orders) AS q")
def ledger_restricted_share(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-06."""
    from airlens.sources.sinks import restricted_share

    return restricted_share(_ledger(spark, sf))


# ---- missions: one per part
_MI = ["concat('MI', cast(p_partkey as varchar(12))) as name", "case p_size % 4 when 0 then 35786.0e0 when 1 then 8000.0e0 else 350.0e0 + (p_partkey % 30) * 30 end as perigee_km", "case p_size % 4 when 0 then 35800.0e0 when 1 then 20000.0e0 else 380.0e0 + (p_partkey % 30) * 30 end as apogee_km",
       "100.0e0 + p_size * 20 as mass_kg", "1.0e0 + p_size % 7 as area_m2", "2.2e0 as cd", "p_partkey % 2 = 0 as propulsion", "p_partkey % 3 = 0 as maneuverable", "p_partkey % 4 <> 0 as passivation_plan",
       "case p_partkey % 5 when 0 then 'none' when 1 then 'natural-decay' when 2 then 'controlled-reentry' when 3 then 'disposal-orbit' else 'graveyard' end as disposal_plan", "cast((p_partkey % 6) * 60 as double) as disposal_perigee_raise_km", "cast(p_partkey % 4 as int) as planned_releases",
       "p_partkey % 9 <> 0 as trackable", "case when p_partkey % 3 = 0 then null else (p_partkey % 4) * 5e-5 end as casualty_risk", "case when p_partkey % 3 <> 0 or p_partkey % 7 = 0 then null else p_partkey % 2 = 0 end as demisable", "cast(case when p_partkey % 8 = 0 then 150 else 1 end as int) as constellation_size",
       "case when p_partkey % 16 = 0 then 0.995e0 else null end as disposal_reliability", "p_partkey % 2 = 1 as us_licensed"]


def _missions(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr(*_MI)


# the decay integration, one step of five days a turn for the missions that are still up
_RHO = "CASE WHEN a - 6378.137 < 150 THEN 2.070e-9 " + " ".join(f"WHEN a - 6378.137 >= {h} THEN {rho!r} * exp(-(a - 6378.137 - {h}) / {scale!r})" for h, rho, scale in reversed(deb.ATMOSPHERE)) + " END"
_LIFE = f"""mi AS (SELECT row_number() OVER () AS id, * FROM (SELECT {', '.join(_MI)} FROM part) AS q),
  lf(id, a, t, drag, never, live) AS (SELECT id, 6378.137 + (perigee_km + apogee_km) / 2, 0.0::DOUBLE, cd * area_m2 / greatest(mass_kg, 1e-6), perigee_km > 2000, NOT perigee_km > 2000 AND (perigee_km + apogee_km) / 2 > 150 FROM mi
   UNION ALL SELECT id, a + s, t + 432000, drag, a - 6378.137 > 1500 AND s > -1e-6, NOT (a - 6378.137 > 1500 AND s > -1e-6) AND a + s - 6378.137 > 150 AND t + 432000 < 200 * 365.25 * 86400
   FROM (SELECT *, -drag * ({_RHO}) * sqrt(398600.4418 / a) * 1000.0 * a * 432000 AS s FROM lf WHERE live) AS q),
  life AS (SELECT mi.*, CASE WHEN never THEN 200.0 ELSE least(t / (365.25 * 86400), 200.0) END AS lifetime_years FROM mi JOIN lf USING (id) WHERE NOT live)"""


@query("orbital_lifetime", f"WITH RECURSIVE {_LIFE} SELECT name, round(lifetime_years, 4) AS lifetime_years FROM life")
def orbital_lifetime(spark: SparkSession, sf: str) -> DataFrame:
    """SCL-15: a step-by-step integration per mission."""
    return deb.lifetimes(_missions(spark, sf)).select("name", F.round("lifetime_years", 4).alias("lifetime_years"))


@query("rule_debris_checklist", f"""WITH mi AS (SELECT *, CASE WHEN perigee_km <= 2000 THEN 'LEO' WHEN abs((perigee_km + apogee_km) / 2 - 35786) < 300 THEN 'GEO' ELSE 'MEO/HEO' END AS regime FROM (SELECT {', '.join(_MI)} FROM part) AS q),
  ch AS (SELECT name, regime, 'DEB-001' AS rule_id, disposal_plan IN ('disposal-orbit', 'controlled-reentry', 'graveyard') AS ok, 'medium' AS sev FROM mi WHERE regime = 'MEO/HEO'
   UNION ALL SELECT name, regime, 'DEB-005', disposal_plan = 'graveyard' AND disposal_perigee_raise_km >= 235 + 1200 * area_m2 / mass_kg, 'high' FROM mi WHERE regime = 'GEO' UNION ALL SELECT name, regime, 'DEB-002', passivation_plan, 'high' FROM mi
   UNION ALL SELECT name, regime, 'DEB-003', NOT (regime = 'LEO' AND (perigee_km + apogee_km) / 2 BETWEEN 400 AND 1200) OR maneuverable, 'high' FROM mi
   UNION ALL SELECT name, regime, 'DEB-004', CASE WHEN casualty_risk IS NOT NULL THEN casualty_risk < 1e-4 ELSE demisable END, 'high' FROM mi WHERE regime = 'LEO' OR disposal_plan IN ('natural-decay', 'controlled-reentry')
   UNION ALL SELECT name, regime, 'DEB-006', trackable, 'medium' FROM mi UNION ALL SELECT name, regime, 'DEB-007', planned_releases = 0, 'medium' FROM mi UNION ALL SELECT name, regime, 'DEB-008', coalesce(disposal_reliability, 0) >= 0.99, 'high' FROM mi WHERE constellation_size >= 100)
  SELECT name, regime, rule_id, CASE WHEN ok IS NULL THEN 'unknown' WHEN ok THEN 'pass' ELSE 'fail' END AS status, CASE WHEN ok IS NULL THEN 'low' WHEN NOT ok THEN sev END AS severity FROM ch""")
def rule_debris_checklist(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-27 without the lifetime-dependent check, which `rule_debris_disposal` covers."""
    m = _missions(spark, sf).withColumn("lifetime_years", F.lit(0.0))
    return deb.checklist(m).filter("not (regime = 'LEO' and rule_id = 'DEB-001')")


@query("rule_debris_disposal", f"""WITH RECURSIVE {_LIFE}, ch AS (SELECT name, 'LEO' AS regime, 'DEB-001' AS rule_id, (disposal_plan = 'controlled-reentry' AND propulsion) OR lifetime_years <= CASE WHEN us_licensed THEN 5 ELSE 25 END AS ok FROM life WHERE perigee_km <= 2000)
  SELECT name, regime, rule_id, CASE WHEN ok IS NULL THEN 'unknown' WHEN ok THEN 'pass' ELSE 'fail' END AS status, CASE WHEN ok IS NULL THEN 'low' WHEN NOT ok THEN 'high' END AS severity FROM ch""")
def rule_debris_disposal(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-27: the lifetime-dependent check of low orbits."""
    return deb.checklist(deb.lifetimes(_missions(spark, sf))).filter("regime = 'LEO' and rule_id = 'DEB-001'")


# ---- space weather: nations as products, orders as notices
_SW = ["n_name as product_id", "cast(n_nationkey % 6 as int) as r", "cast(n_nationkey % 5 as int) as s", "cast((n_nationkey * 7) % 6 as int) as g", f"{NOW} - n_nationkey * 900 as fetched_ts"]
_NT = ["case o_orderkey % 9 when 0 then 'GST' when 1 then 'FLR' when 2 then 'CME' when 3 then 'SEP' when 4 then 'RBE' else 'IPS' end as type", f"{NOW} - (o_orderkey % 400) * 1800 as issued_ts"]


@query("rule_space_weather", f"""WITH p AS (SELECT {', '.join(_SW)} FROM nation), x AS (SELECT product_id, 'SWX-001' AS rule_id, g AS l, 4 AS m, 5 AS v FROM p UNION ALL SELECT product_id, 'SWX-002', r, 3, 4 FROM p UNION ALL SELECT product_id, 'SWX-003', s, 3, 4 FROM p)
  SELECT product_id, rule_id, CASE WHEN l >= v THEN 'high' ELSE 'medium' END AS severity, CAST(l AS DOUBLE) AS measure FROM x WHERE l >= m UNION ALL SELECT product_id, 'SWX-004', 'low', round({NOW} - fetched_ts, 0) FROM p WHERE {NOW} - fetched_ts > 10800""")
def rule_space_weather(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-31 and SCL-20."""
    return swx.findings(spark.read.parquet(f"{sf}/nation.parquet").selectExpr(*_SW), F.lit(NOW))


@query("space_weather_agreement", f"""WITH p AS (SELECT {', '.join(_SW)} FROM nation), nt AS (SELECT CASE WHEN type IN ('GST', 'CME') THEN 'G' WHEN type = 'FLR' THEN 'R' WHEN type IN ('SEP', 'RBE') THEN 'S' END AS scale, count(*) AS n, string_agg(DISTINCT type, ',' ORDER BY type) AS types, max(issued_ts) AS latest_ts FROM (SELECT {', '.join(_NT)} FROM orders) AS q WHERE {NOW} - issued_ts <= 172800 GROUP BY ALL),
  x AS (SELECT product_id, 'G' AS scale, CASE WHEN g >= 5 THEN 'severe' WHEN g = 4 THEN 'moderate' END AS condition FROM p UNION ALL SELECT product_id, 'R', CASE WHEN r >= 4 THEN 'severe' WHEN r = 3 THEN 'moderate' END FROM p UNION ALL SELECT product_id, 'S', CASE WHEN s >= 4 THEN 'severe' WHEN s = 3 THEN 'moderate' END FROM p)
  SELECT product_id, x.scale, condition, coalesce(n, 0) AS notices, coalesce(types, '') AS types, latest_ts, CASE WHEN condition IS NOT NULL AND n > 0 THEN 'both' WHEN condition IS NOT NULL THEN 'swpc-only' WHEN n > 0 THEN 'donki-only' ELSE 'quiet' END AS agreement FROM x LEFT JOIN nt ON nt.scale = x.scale""")
def space_weather_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """JON-17."""
    return swx.agreement(spark.read.parquet(f"{sf}/nation.parquet").selectExpr(*_SW), spark.read.parquet(f"{sf}/orders.parquet").selectExpr(*_NT), F.lit(NOW))


# ---- object catalogue: one entry per customer
_CA = ["cast(10000 + c_custkey as int) as norad", "c_name as name", "case c_mktsegment when 'HOUSEHOLD' then 'PAYLOAD' when 'MACHINERY' then 'ROCKET BODY' else 'DEBRIS' end as object_type",
       "case when c_custkey % 4 = 0 then concat('2024-12-', lpad(cast(1 + c_custkey % 28 as varchar(4)), 2, '0')) when c_custkey % 4 = 1 then '2023-01-05' else null end as decay_date",
       "concat('2024-0', cast(1 + c_custkey % 9 as varchar(2)), '-10') as launch_date", "case c_custkey % 3 when 0 then 'AFETR' when 1 then 'TYMSC' else null end as launch_site"]
_CAT = f"cat AS (SELECT {', '.join(_CA)} FROM customer)"


def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr(*_CA)


@query("catalogue_recent_decays", f"WITH {_CAT} SELECT norad, decay_date FROM cat WHERE {START} - epoch(CAST(decay_date AS TIMESTAMP)) BETWEEN 0 AND 30 * 86400")
def catalogue_recent_decays(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-22 and SRC-07's date handling."""
    return cat.recent_decays(_catalogue(spark, sf), START).select("norad", "decay_date")


@query("catalogue_summary", f"WITH {_CAT} SELECT object_type, count(*) AS objects, count(*) FILTER (decay_date IS NULL) AS in_orbit, count(decay_date) AS decayed FROM cat GROUP BY ALL")
def catalogue_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-22."""
    return cat.summary(_catalogue(spark, sf))


@query("rule_decayed_in_use", f"WITH {EL}, {_CAT} SELECT DISTINCT CAST(el.norad AS INTEGER) AS norad, decay_date, 'ORB-008' AS rule_id, 'low' AS severity FROM el JOIN cat ON cat.norad = el.norad WHERE decay_date IS NOT NULL")
def rule_decayed_in_use(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-26 and JON-16."""
    return cat.decayed_in_use(sets(spark, sf), _catalogue(spark, sf))


_LD = "launch_id, concat('2024-0', cast(1 + s_suppkey % 9 as varchar(2)), '-10') as launch_date, case s_suppkey % 4 when 0 then 'AFETR' when 1 then 'FRGUI' else null end as site"


def launch_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Launches with their date and site."""
    return spark.read.parquet(f"{sf}/supplier.parquet").withColumn("launch_id", F.concat(F.lit("L"), c("s_suppkey").cast("string"))).selectExpr("launch_id", "concat('2024-0', cast(1 + s_suppkey % 9 as varchar(2)), '-10') as launch_date", "case s_suppkey % 4 when 0 then 'AFETR' when 1 then 'FRGUI' else null end as site")


@query("objects_of_launch", f"WITH {_CAT}, l AS (SELECT {_LD} FROM (SELECT *, concat('L', s_suppkey) AS launch_id FROM supplier) AS q) SELECT launch_id, norad FROM l JOIN cat USING (launch_date) WHERE site IS NULL OR launch_site IS NULL OR site = launch_site")
def objects_of_launch(spark: SparkSession, sf: str) -> DataFrame:
    """JON-14."""
    return cat.objects_of_launch(launch_sites(spark, sf), _catalogue(spark, sf)).select("launch_id", "norad")
