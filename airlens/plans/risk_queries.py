"""Risk register, digests and boards over audit results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.operators import audit, risk
from airlens.plans import bridge, places
from airlens.plans import sqlbase as S
from airlens.plans.registry import query
from airlens.session import cut_lineage

c = F.col
_EFF = "(SELECT avg(t.effectiveness) FROM threats AS t WHERE list_contains(string_split(r.threats, ' '), t.id))"
_PREC = "CASE a.rule_id WHEN 'SEC-011' THEN 0.9054054054054054 WHEN 'SEC-018' THEN 0.7407407407407407 WHEN 'ML-001' THEN 0.24691358024691357 ELSE 1.0 END"
_P = "least(1.0, greatest(0.0, k / n))"
REG = f"""{S.dim('risks')}, {S.dim('threats')}, na AS (SELECT greatest(1, count(DISTINCT (recording, icao24))) AS n FROM st), rc AS (SELECT rule_id, count(*) AS cnt FROM accf GROUP BY ALL),
rg0 AS (SELECT r.*, na.n, {_EFF} AS eff, coalesce((SELECT sum(a.cnt) FROM rc AS a WHERE list_contains(string_split(r.evidence, ' '), a.rule_id)), 0) AS hits,
   coalesce((SELECT sum(a.cnt * {_PREC}) FROM rc AS a WHERE list_contains(string_split(r.evidence, ' '), a.rule_id)), 0.0) AS k FROM risks AS r, na),
rg1 AS (SELECT *, 1000 * greatest(0.0, ({_P} + 3.8416 / (2 * n) - 1.96 * sqrt({_P} * (1 - {_P}) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)) AS rate FROM rg0),
rg2 AS (SELECT *, CASE WHEN evidence IS NULL THEN likelihood ELSE greatest(1, least(5, likelihood + CASE WHEN rate >= 50 THEN 2 WHEN rate >= 10 THEN 1 WHEN rate > 0 OR n < 500 THEN 0 ELSE -1 END)) END AS l FROM rg1),
rg3 AS (SELECT *, l * impact AS score, greatest(1, CAST(round_even(l * impact * (1 - coalesce(eff, 0)), 0) AS INT)) AS residual FROM rg2)"""
_RATE = lambda x: f"CASE WHEN {x} >= 15 THEN 'critical' WHEN {x} >= 10 THEN 'high' WHEN {x} >= 5 THEN 'medium' ELSE 'low' END"
_RB = f"{S.accepted()}, {REG}"


def _register(spark: SparkSession, sf: str) -> DataFrame:
    st = bridge.states(spark, sf)
    counts = audit.audit(st).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return risk.assess(spark, counts, st.agg(F.countDistinct("recording", "icao24").alias("aircraft")))


@query("risk_register", f"{_RB} SELECT id, domain, likelihood, l AS L, impact AS I, score, {_RATE('score')} AS rating, CAST(hits AS BIGINT) AS hits, round(k, 1) AS expected_true, round(rate, 1) AS rate_lb, round(coalesce(eff, 0), 2) AS control_effectiveness, residual, {_RATE('residual')} AS residual_rating FROM rg3")
def risk_register(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-17 and SRT-07."""
    return _register(spark, sf).select("id", "domain", "likelihood", "L", "I", "score", "rating", "hits", F.round("expected_true", 1).alias("expected_true"), F.round("rate_lb", 1).alias("rate_lb"),
                                       F.round("control_effectiveness", 2).alias("control_effectiveness"), "residual", "residual_rating")


@query("risk_heatmap", f"{_RB} SELECT l AS L, {', '.join(f'''coalesce(string_agg(id, ', ' ORDER BY id) FILTER (impact = {i}), '') AS impact_{i}''' for i in range(1, 6))} FROM rg3 GROUP BY ALL")
def risk_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-20."""
    return risk.heatmap(_register(spark, sf))


@query("register_by_domain", f"{_RB} SELECT domain, {_RATE('residual')} AS residual_rating, count(*) AS risks FROM rg3 GROUP BY ALL")
def register_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-31."""
    return _register(spark, sf).groupBy("domain", "residual_rating").agg(F.count(F.lit(1)).alias("risks"))


_DOM = "SELECT 'S' || s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'space-launch' WHEN 1 THEN 'uas-utm' ELSE 'earth-crisis' END AS domain, CAST(1 + s_suppkey % 5 AS INT) AS l, CAST(1 + s_suppkey % 4 AS INT) AS i, CAST(s_suppkey % 3 AS INT) AS k FROM supplier"


@query("unified_register", f"""{_RB}, dm AS (SELECT id, domain, l * i AS score, greatest(1, CAST(round_even(l * i * (1 - least(0.8, 0.2 * k)), 0) AS INT)) AS residual FROM ({_DOM}) AS q), un AS (SELECT id, domain, score, residual FROM rg3 UNION ALL SELECT * FROM dm)
  SELECT id, domain, score, {_RATE('score')} AS rating, residual, {_RATE('residual')} AS residual_rating, CAST(row_number() OVER (ORDER BY CASE WHEN residual >= 15 THEN 0 WHEN residual >= 10 THEN 1 WHEN residual >= 5 THEN 2 ELSE 3 END, residual DESC, id) AS INT) AS place FROM un""")
def unified_register(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-31 and SRT-07: the evidence-weighted register and the risks of other domains on one scale, in order of residual risk."""
    own = _register(spark, sf).select("id", "domain", "score", "rating", "residual", "residual_rating")
    rows = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("concat('S', cast(s_suppkey as string)) as id", "case s_suppkey % 3 when 0 then 'space-launch' when 1 then 'uas-utm' else 'earth-crisis' end as domain", "cast(1 + s_suppkey % 5 as int) as likelihood", "cast(1 + s_suppkey % 4 as int) as impact", "cast(s_suppkey % 3 as int) as controls")
    return risk.unified(own, risk.domain_risks(rows))


@query("executive_posture", f"""{S.trusted()}, td AS (SELECT recording, rule_id, icao24, round(risk_score, 4) AS risk, row_number() OVER (PARTITION BY recording ORDER BY round(risk_score, 4) DESC, batch_seq, phase, pos, rule_ord) AS r FROM accf)
  SELECT recording, {', '.join(f"(SELECT count(*) FROM accf AS a WHERE a.recording = g.recording AND a.severity = '{s}') AS {s}" for s in ('critical', 'high', 'medium', 'low', 'info'))}, (SELECT count(*) FROM trust AS t WHERE t.recording = g.recording AND round(t.trust, 6) < 0.5) AS low_trust,
   (SELECT string_agg(rule_id || ' ' || coalesce(icao24, '-'), '; ' ORDER BY r) FROM td WHERE td.recording = g.recording AND r <= 3) AS do_first FROM (SELECT DISTINCT recording FROM accf) AS g""")
def executive_posture(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-38: counts by severity, aircraft of low trust and the three findings to do first, per recording."""
    from airlens.operators import folds

    st = bridge.states(spark, sf)
    cand = cut_lineage(audit.candidates(st))
    acc = cut_lineage(folds.cooldown(cand))
    return risk.posture(acc, folds.trust_scores(st, cand, acc))


@query("executive_summary", f"""{_RB}, kp AS (SELECT count(DISTINCT recording) AS recordings, count(*) AS states, round(count(*) FILTER (NOT on_ground AND position_source LIKE 'adsb%' AND nic >= 7 AND coalesce(nac_p, 0) >= 8 AND coalesce(sil, 0) >= 3) / count(*) FILTER (NOT on_ground AND position_source LIKE 'adsb%' AND nic IS NOT NULL), 4) AS compliance FROM st)
  SELECT kp.*, (SELECT count(*) FROM accf) AS findings, (SELECT count(*) FROM accf WHERE severity IN ('critical', 'high')) AS urgent, (SELECT string_agg(id, ',' ORDER BY score DESC, id) FROM (SELECT * FROM rg3 ORDER BY score DESC, id LIMIT 3) AS q) AS top_risks FROM kp""")
def executive_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-38: one row."""
    from airlens.operators.ecosystem import _share

    st = bridge.states(spark, sf)
    acc = cut_lineage(audit.audit(st))
    facts = st.agg(F.countDistinct("recording").alias("recordings"), F.count(F.lit(1)).alias("states"), _share().alias("compliance"))
    counts = acc.agg(F.count(F.lit(1)).alias("findings"), F.count_if(c("severity").isin("critical", "high")).alias("urgent"))
    reg = risk.assess(spark, acc.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")), st.agg(F.countDistinct("recording", "icao24").alias("aircraft")))
    top = reg.orderBy(F.desc("score"), "id").limit(3).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct((-c("score")).alias("s"), "id"))), lambda x: x["id"])).alias("top_risks"))
    one = lambda d: d.withColumn("_k", F.lit(1))  # noqa: E731  (each side is a single row)
    return one(facts).join(one(counts), "_k").join(one(top), "_k").drop("_k")


@query("threat_coverage", f"""WITH {S.dim('threats')}, rc AS (SELECT CASE s_suppkey % 8 WHEN 0 THEN 'teleport' WHEN 1 THEN 'velocity_forge' WHEN 2 THEN 'altitude_forge' WHEN 3 THEN 'replay' WHEN 4 THEN 'squawk_hijack' WHEN 5 THEN 'slow_drift' ELSE 'other' END AS scenario, avg(CAST(s_suppkey % 3 > 0 AS INT)) AS recall FROM supplier GROUP BY ALL)
  SELECT t.id, t.name, tactic, coverage, coalesce(rules, '-') AS rules, likelihood * impact AS score, coalesce((SELECT string_agg(x.scenario || ' ' || CAST(round(x.recall * 100) AS INT) || '%', ', ' ORDER BY list_position(string_split(t.scenarios, ' '), x.scenario)) FROM rc AS x WHERE list_contains(string_split(t.scenarios, ' '), x.scenario)), '-') AS measured FROM threats AS t""")
def threat_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-32."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    scen = F.expr("case s_suppkey % 8 when 0 then 'teleport' when 1 then 'velocity_forge' when 2 then 'altitude_forge' when 3 then 'replay' when 4 then 'squawk_hijack' when 5 then 'slow_drift' else 'other' end")
    return risk.coverage(spark, s.groupBy(scen.alias("scenario")).agg(F.avg((c("s_suppkey") % 3 > 0).cast("int")).alias("recall")))


_DIG = """rp AS (SELECT DISTINCT recording, CASE CAST(substr(recording, 4) AS INTEGER) % 3 WHEN 0 THEN 'wellclear_' WHEN 1 THEN 'live_check_' ELSE recording || '_telemetry_' END || recording AS stem, CAST(substr(recording, 4) AS INTEGER) % 4 > 0 AS manifest, CAST(substr(recording, 4) AS INTEGER) % 5 = 4 AS degraded FROM st),
  rk AS (SELECT *, CASE WHEN starts_with(stem, 'wellclear') THEN 'wellclear' WHEN starts_with(stem, 'live_check') THEN 'live_check' ELSE 'telemetry' END AS kind FROM rp)"""
_STEM = "concat(case cast(substr(recording, 4) as int) % 3 when 0 then 'wellclear_' when 1 then 'live_check_' else concat(recording, '_telemetry_') end, recording)"


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    """A report per recording with a name, and whether it has a manifest and is degraded."""
    k = "cast(substr(recording, 4) as int)"
    return bridge.states(spark, sf).select("recording").distinct().selectExpr("recording", f"{_STEM} as stem", f"{k} % 4 > 0 as manifest", f"{k} % 5 = 4 as degraded")


@query("report_digest", f"""{S.accepted()}, {_DIG} SELECT kind, count(*) AS reports, CAST(sum(n) AS BIGINT) AS findings, count(*) FILTER (manifest) AS with_manifest, count(*) FILTER (degraded) AS degraded, string_agg(stem, ',' ORDER BY stem) FILTER (NOT manifest) AS without_manifest
  FROM (SELECT rk.*, (SELECT count(*) FROM accf WHERE accf.recording = rk.recording) AS n FROM rk) AS q GROUP BY ALL""")
def report_digest(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-25: reports of a kind, their findings, manifests and degraded ones."""
    return risk.digest(_reports(spark, sf), audit.audit(bridge.states(spark, sf)))


@query("digest_worst", f"""{S.accepted()}, {_DIG} SELECT stem, rule_id, severity, icao24, ts FROM (SELECT rk.stem, accf.*, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, rule_id, stem, batch_seq, phase, pos, rule_ord) AS r FROM accf JOIN rk USING (recording)) AS q WHERE r <= 20""")
def digest_worst(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-25: the twenty worst findings of all reports."""
    a = audit.audit(bridge.states(spark, sf)).join(_reports(spark, sf), "recording")
    return a.orderBy("sev_rank", "rule_id", "stem", "batch_seq", "phase", "pos", "rule_ord").limit(20).select("stem", "rule_id", "severity", "icao24", "ts")


@query("digest_severities", f"{S.accepted()} SELECT severity, rule_id, count(*) AS findings, count(DISTINCT recording) AS reports FROM accf GROUP BY ALL")
def digest_severities(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-25: findings of all reports by rule and severity."""
    return audit.audit(bridge.states(spark, sf)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("recording").alias("reports"))


@query("operations_board", f"""WITH {places.VOL_CTE}, {places.LCH_CTE}
  SELECT 'restrictions_active' AS section, count(*) FILTER ({places.ACTIVE.format(ts=places.NOW).replace('v.', '')}) AS n, CAST(NULL AS DOUBLE) AS next_ts FROM vol UNION ALL SELECT 'restrictions_next', count(*) FILTER (effective_ts > {places.NOW}), min(effective_ts) FILTER (effective_ts > {places.NOW}) FROM vol
  UNION ALL SELECT 'launches_24h', count(*) FILTER (w0 BETWEEN {places.NOW} AND {places.NOW} + 86400), min(w0) FILTER (w0 >= {places.NOW}) FROM lch""")
def operations_board(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-36: one row per section."""
    from airlens.operators import airspace as asp

    v, l, now = places.volumes(spark, sf), asp.launch_windows(places.launches(spark, sf)), F.lit(places.NOW)
    a = v.agg(F.count_if(asp.active(now)).alias("n")).select(F.lit("restrictions_active").alias("section"), "n", F.lit(None).cast("double").alias("next_ts"))
    b = v.agg(F.count_if(c("effective_ts") > now).alias("n"), F.min(F.when(c("effective_ts") > now, c("effective_ts"))).alias("next_ts")).select(F.lit("restrictions_next").alias("section"), "n", "next_ts")
    d = l.agg(F.count_if(c("w0").between(now, now + 86400)).alias("n"), F.min(F.when(c("w0") >= now, c("w0"))).alias("next_ts")).select(F.lit("launches_24h").alias("section"), "n", "next_ts")
    return a.unionByName(b).unionByName(d)


@query("recording_inventory", S.states() + " SELECT recording, count(DISTINCT batch_seq) AS polls, count(*) AS states, count(DISTINCT icao24) AS aircraft, string_agg(DISTINCT region, ',' ORDER BY region) AS regions, max(batch_ts) - min(batch_ts) AS span_s FROM st GROUP BY ALL")
def recording_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-24; regions are a short closed list."""
    return bridge.states(spark, sf).groupBy("recording").agg(
        F.countDistinct("batch_seq").alias("polls"), F.count(F.lit(1)).alias("states"), F.countDistinct("icao24").alias("aircraft"), F.concat_ws(",", F.array_sort(F.collect_set("region"))).alias("regions"), (F.max("batch_ts") - F.min("batch_ts")).alias("span_s"))


@query("mission_dossier", f"""WITH RECURSIVE {bridge.states_cte()}, {places.LCH_CTE}, {places.VOL_CTE}, fly AS (SELECT * FROM st WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT on_ground),
  near AS (SELECT l.launch_id, count(DISTINCT (f.recording, f.icao24)) AS aircraft FROM fly AS f JOIN lch AS l ON abs(f.lat - l.pad_lat) <= 1 WHERE {S.planar('f.lat', 'f.lon', 'l.pad_lat', 'l.pad_lon')} <= 50 AND f.ts BETWEEN l.w0 AND l.w1 GROUP BY ALL),
  cov AS (SELECT l.launch_id, count(*) AS volumes FROM lch AS l JOIN vol AS v ON (v.effective_ts IS NULL OR v.effective_ts <= l.w1) AND (v.expire_ts IS NULL OR v.expire_ts >= l.w0) WHERE {places.inside_sql('l.pad_lat', 'l.pad_lon')} OR {S.planar('l.pad_lat', 'l.pad_lon', 'v.clat', 'v.clon')} <= 30 GROUP BY ALL)
  SELECT launch_id, name, status, coalesce(aircraft, 0) AS aircraft, coalesce(volumes, 0) AS volumes, CAST(coalesce(aircraft, 0) > 0 AS INT) AS lch_001 FROM lch LEFT JOIN near USING (launch_id) LEFT JOIN cov USING (launch_id)""")
def mission_dossier(spark: SparkSession, sf: str) -> DataFrame:
    """JON-15 and AGG-33: every launch with its traffic and its restrictions."""
    from airlens.operators import airspace as asp

    l, v = places.launches(spark, sf), places.volumes(spark, sf)
    near = asp.traffic_in_windows(bridge.states(spark, sf), l).groupBy("launch_id").agg(F.countDistinct("recording", "icao24").alias("aircraft"))
    cov = asp.covering_counts(l, v)
    d = asp.launch_windows(l).join(near, "launch_id", "left").join(cov, "launch_id", "left").fillna(0, ["aircraft", "volumes"])
    return d.select("launch_id", "name", "status", "aircraft", "volumes", (c("aircraft") > 0).cast("int").alias("lch_001"))


@query("launch_lookup", f"""WITH l AS (SELECT launch_id, name, lower(concat_ws(' ', name, pad, location)) AS hay, window_start FROM (SELECT {', '.join(places._LCH)} FROM supplier) AS q)
  (SELECT 'L7' AS key, launch_id, name FROM l WHERE launch_id = 'L7' OR contains(hay, 'l7') ORDER BY launch_id <> 'L7', window_start NULLS LAST, launch_id LIMIT 1)
  UNION ALL (SELECT 'Pad 3', launch_id, name FROM l WHERE launch_id = 'Pad 3' OR contains(hay, 'pad 3') ORDER BY launch_id <> 'Pad 3', window_start NULLS LAST, launch_id LIMIT 1)""")
def launch_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-14: by id and by text."""
    from airlens.operators.missions import find_launch

    l = places.launches(spark, sf)
    pick = lambda k: find_launch(l, k).select(F.lit(k).alias("key"), "launch_id", "name")
    return pick("L7").unionByName(pick("Pad 3"))


@query("capture_due", f"""WITH {places.LCH_CTE} SELECT launch_id, w0 - {places.NOW} AS starts_in_s, row_number() OVER (ORDER BY w0, launch_id) = 1 AS picked FROM lch WHERE {places.NOW} BETWEEN w0 - 1800 AND w1 - 1 + 3600 AND launch_id NOT IN (SELECT concat('L', s_suppkey) FROM supplier WHERE s_acctbal < 2000)""")
def capture_due(spark: SparkSession, sf: str) -> DataFrame:
    """SCL-23: launches whose window is near, finished ones left out, the earliest picked."""
    from airlens.operators.missions import capture_due as due

    done = spark.read.parquet(f"{sf}/supplier.parquet").filter("s_acctbal < 2000").select(F.concat(F.lit("L"), c("s_suppkey").cast("string")).alias("launch_id"))
    return due(places.launches(spark, sf), done, places.NOW)

