"""Rules, cool-down, scoring, trust and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.functions.scoring import SEVERITIES
from airlens.operators import audit, folds, proximity, rules, tracks, watchlist
from airlens.plans import bridge, places
from airlens.plans import sqlbase as S
from airlens.plans.registry import query
from airlens.session import cut_lineage
from airlens.thresholds import DEFAULT

c = F.col
COLS = ["recording", "batch_seq", "phase", "pos", "rule_ord", "rule_id", "severity", "category", "icao24", "callsign", "ts", "batch_ts", "position_source", "measure"]
SEL = ", ".join(COLS)


def _register_state_rule(name: str, sql: str) -> None:
    slug = {
        "SEC-00x": "rule_emergency_squawk", "SEC-004": "rule_emergency_field", "SEC-010": "rule_impossible_jump", "SEC-011": "rule_speed_mismatch",
        "SEC-018": "rule_altitude_inconsistency", "SEC-012": "rule_low_integrity", "SEC-013": "rule_identity_gap", "OPS-001": "rule_stale_contact",
        "OPS-002": "rule_holding", "OPS-003": "rule_low_orbit", "SAF-003": "rule_excessive_vrate", "OPS-004": "rule_altitude_deviation", "OPS-005": "rule_vfr_in_class_a",
    }[name]
    ords = {n: i for i, n in enumerate(rules.STATE_RULES)}
    drop = [x for x in COLS if x != "rule_ord"]

    @query(slug, f"{S.featured()} SELECT {', '.join(drop)} FROM ({sql}) AS q")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        st = bridge.states(spark, sf)
        needs_track = name in ("SEC-00x", "SEC-010", "SEC-011", "SEC-018", "OPS-002", "OPS-003", "OPS-004", "SAF-003")
        if needs_track:
            st = tracks.with_features(st)
        else:  # stateless rules read no track memory, so no shuffle is planned for them
            st = st.select("*", *[F.lit(None).cast("double").alias(f) for f in tracks.FEATURES])
        return rules.state_findings(st, DEFAULT, only=[name]).select(*drop)

    run.__doc__ = f"Rule {name} (order {ords[name]})."


for _name, _sql in S.state_rules().items():
    _register_state_rule(_name, _sql)

_STATES_BATCH = "WITH RECURSIVE " + bridge.states_cte() + "," + S.BATCH + "," + S.POLLS


@query("rule_duplicate_address", f"{_STATES_BATCH} SELECT {SEL} FROM ({S.DUP}) AS q")
def rule_duplicate_address(spark: SparkSession, sf: str) -> DataFrame:
    return rules.duplicate_address(bridge.states(spark, sf)).select(*COLS)


@query("rule_proximity", f"{_STATES_BATCH} SELECT {SEL} FROM ({S.PROX}) AS q")
def rule_proximity(spark: SparkSession, sf: str) -> DataFrame:
    return proximity.proximity_findings(bridge.states(spark, sf)).select(*COLS)


@query("proximity_pairs", f"{_STATES_BATCH} SELECT recording, batch_seq, icao24, other AS other_icao24, round(sep, 4) AS lateral_nm, round(dalt, 1) AS vertical_ft FROM prox")
def proximity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """JON-01."""
    return proximity.close_pairs(bridge.states(spark, sf)).select("recording", "batch_seq", "icao24", "other_icao24", F.round("lateral_nm", 4).alias("lateral_nm"), F.round("vertical_ft", 1).alias("vertical_ft"))


@query("rule_stream_checks", f"{_STATES_BATCH} SELECT {SEL} FROM ({S.BURST} UNION ALL {S.COLLAPSE}) AS q")
def rule_stream_checks(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-09 and RUL-10: address burst, coverage collapse."""
    return rules.stream_findings(bridge.states(spark, sf)).select(*COLS)


def watched(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The watchlist's findings, for an audit that has one."""
    return [watchlist.findings(bridge.states(spark, sf), places.watch_entries(spark, sf), places.PREFIX_LENGTHS)]


@query("finding_candidates", f"{S.candidates(True)} SELECT {SEL} FROM cand")
def finding_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """FLD-03, SET-04 and RUL-12: all candidates, the watchlist's among them, with their total order."""
    return audit.candidates(bridge.states(spark, sf), extra=watched(spark, sf)).select(*COLS)


@query("audit_findings", f"{S.accepted(True)} SELECT {SEL}, occurrences, round(risk_score, 4) AS risk_score FROM accf")
def audit_findings(spark: SparkSession, sf: str) -> DataFrame:
    """FLD-01, SCL-11 and RUL-12: the audit end to end, with a watchlist."""
    return audit.audit(bridge.states(spark, sf), extra=watched(spark, sf)).select(*COLS, "occurrences", F.round("risk_score", 4).alias("risk_score"))


@query("findings_by_rule", f"{S.accepted()} SELECT rule_id, count(*) AS findings, count(DISTINCT icao24) AS aircraft, CAST(sum(occurrences) AS BIGINT) AS occurrences, round(max(risk_score), 4) AS max_risk FROM accf GROUP BY ALL")
def findings_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit(bridge.states(spark, sf)).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("icao24").alias("aircraft"), F.sum("occurrences").alias("occurrences"), F.round(F.max("risk_score"), 4).alias("max_risk"))


@query("findings_by_severity", f"""{S.accepted()} SELECT g.recording, s.severity, coalesce(count(a.rule_id), 0) AS findings FROM (SELECT DISTINCT recording FROM accf) AS g
  CROSS JOIN (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) AS s(severity) LEFT JOIN accf AS a ON a.recording = g.recording AND a.severity = s.severity GROUP BY ALL""")
def findings_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-01: counts by severity, zero-filled."""
    return audit.by_severity(audit.audit(bridge.states(spark, sf))).select("recording", "severity", "findings")


@query("findings_by_category", f"{S.accepted()} SELECT recording, category, count(*) AS findings FROM accf GROUP BY ALL")
def findings_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-01: counts by category."""
    return audit.by_category(audit.audit(bridge.states(spark, sf)))


_ADSB = "NOT on_ground AND position_source LIKE 'adsb%' AND nic IS NOT NULL"
_OK = "nic >= 7 AND coalesce(nac_p, 0) >= 8 AND coalesce(sil, 0) >= 3"
_SUMMARY = f"""sm AS (SELECT t.*, coalesce(f.total, 0) AS findings_total, {', '.join(f'coalesce(f.{s}, 0) AS {s}' for s in SEVERITIES)} FROM (
  SELECT recording, count(DISTINCT batch_seq) AS batches, count(*) AS state_vectors, count(DISTINCT icao24) AS unique_aircraft, min(batch_ts) AS first_ts, max(batch_ts) AS last_ts,
    count(*) FILTER ({_ADSB}) AS adsb_airborne_fixes, round(count(*) FILTER ({_ADSB} AND {_OK}) / nullif(count(*) FILTER ({_ADSB}), 0), 4) AS adsb_compliance_rate FROM st GROUP BY ALL) AS t
  LEFT JOIN (SELECT recording, count(*) AS total, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES)} FROM accf GROUP BY ALL) AS f USING (recording))"""


@query("audit_summary", f"{S.accepted()}, {_SUMMARY} SELECT * FROM sm")
def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-01 and AGG-02 per recording."""
    st = bridge.states(spark, sf)
    return audit.summary(st, audit.audit(st))


@query("merged_summaries", f"""{S.accepted()}, {_SUMMARY} SELECT count(*) AS recordings, CAST(sum(batches) AS BIGINT) AS batches, CAST(sum(state_vectors) AS BIGINT) AS state_vectors,
  CAST(sum(unique_aircraft) AS BIGINT) AS unique_aircraft, CAST(sum(findings_total) AS BIGINT) AS findings_total FROM sm""")
def merged_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-18: each recording audited alone, then summed."""
    st = bridge.states(spark, sf)
    s = audit.summary(st, audit.audit(st))
    return s.agg(F.count(F.lit(1)).alias("recordings"), *[F.sum(n).alias(n) for n in ("batches", "state_vectors", "unique_aircraft", "findings_total")])


@query("top_aircraft_by_risk", f"{S.accepted()} SELECT icao24, round(sum(risk_score), 4) AS risk FROM accf WHERE icao24 IS NOT NULL GROUP BY ALL ORDER BY risk DESC, icao24 LIMIT 10")
def top_aircraft_by_risk(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-01."""
    return audit.top_aircraft(audit.audit(bridge.states(spark, sf)))


@query("trust_ledger", f"{S.trusted(True)} SELECT recording, icao24, round(trust, 4) AS trust, CAST(hits AS BIGINT) AS hits FROM trust")
def trust_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """FLD-02: trust after all findings, the watchlist's among them."""
    st = bridge.states(spark, sf)
    cand = cut_lineage(audit.candidates(st, extra=watched(spark, sf)))  # used twice: by the cool-down and for the clean rows
    return folds.trust_scores(st, cand, folds.cooldown(cand)).select("recording", "icao24", F.round("trust", 4).alias("trust"), "hits")


@query("low_trust_aircraft", f"""{S.trusted()} SELECT recording, icao24, round(trust, 4) AS trust, CAST(hits AS BIGINT) AS hits FROM trust WHERE round(trust, 6) < 0.5
  QUALIFY row_number() OVER (PARTITION BY recording ORDER BY round(trust, 6), icao24) <= 15""")
def low_trust_aircraft(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-03: the fifteen worst per recording."""
    from pyspark.sql.window import Window as W

    st = bridge.states(spark, sf)
    cand = cut_lineage(audit.candidates(st))  # used twice: by the cool-down and for the clean rows
    low = folds.trust_scores(st, cand, folds.cooldown(cand)).withColumn("_t", F.round("trust", 6)).filter("_t < 0.5")
    low = low.withColumn("_r", F.row_number().over(W.partitionBy("recording").orderBy("_t", "icao24"))).filter("_r <= 15")
    return low.select("recording", "icao24", F.round("trust", 4).alias("trust"), "hits")


@query("findings_ranked", f"""{S.accepted()} SELECT recording, rule_id, severity, category, icao24, callsign, ts, round(risk_score, 4) AS risk_score FROM accf
  ORDER BY round(risk_score, 4) DESC, recording, batch_seq, phase, pos, rule_ord LIMIT 60""")
def findings_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-02: the sixty findings to look at first."""
    a = audit.audit(bridge.states(spark, sf)).withColumn("risk_score", F.round("risk_score", 4))
    return a.orderBy(F.desc("risk_score"), "recording", "batch_seq", "phase", "pos", "rule_ord").limit(60).select(
        "recording", "rule_id", "severity", "category", "icao24", "callsign", "ts", "risk_score")


@query("findings_filtered", f"""{S.accepted()} SELECT recording, rule_id, severity, category, icao24, callsign, ts, round(risk_score, 4) AS risk_score FROM accf
  WHERE severity IN ('high', 'critical') AND category = 'security' AND lower(concat_ws(' ', rule_id, icao24, callsign)) LIKE '%a0%'""")
def findings_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-03."""
    from airlens.operators.picture import filter_findings

    a = audit.audit(bridge.states(spark, sf))
    return filter_findings(a, severities=["high", "critical"], category="security", text="a0").select(
        "recording", "rule_id", "severity", "category", "icao24", "callsign", "ts", F.round("risk_score", 4).alias("risk_score"))


@query("alerts_at_threshold", f"{S.accepted()} SELECT recording, rule_id, severity, icao24, ts FROM accf WHERE severity IN ('critical', 'high')")
def alerts_at_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-02: what an alert sink with threshold `high` receives."""
    from airlens.sources.sinks import alerts

    return alerts(audit.audit(bridge.states(spark, sf)), "high").select("recording", "rule_id", "severity", "icao24", "ts")




@query("tuned_thresholds", S.states() + " SELECT recording, batch_seq, pos, icao24, ts, vrate_fpm FROM st WHERE NOT on_ground AND abs(vrate_fpm) > 800")
def tuned_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-10: a rule under overridden thresholds."""
    t = DEFAULT.override({"rules": {"max_vrate_fpm": 800.0}})
    st = bridge.states(spark, sf).select("*", *[F.lit(None).cast("double").alias(f) for f in tracks.FEATURES])
    return rules.state_findings(st, t, only=["SAF-003"]).select("recording", "batch_seq", "pos", "icao24", "ts", c("measure").alias("vrate_fpm"))
