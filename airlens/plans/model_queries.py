"""Training frame, anomaly model and injected-scenario evaluation over the derived traffic."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from airlens.operators import audit, model, tracks
from airlens.operators.quantiles import quantiles
from airlens.plans import bridge
from airlens.plans import sqlbase as S
from airlens.plans.registry import query
from airlens.session import cut_lineage, shared_folder

c = F.col
_FR = ("fr AS (SELECT *, CASE WHEN baro_alt_ft < 10000 THEN 'terminal' ELSE 'enroute' END AS band, CAST('0x' || substr(sha256(icao24), 1, 4) AS INTEGER) / 65536.0 < 0.2 AS is_holdout FROM fx WHERE NOT on_ground AND baro_alt_ft >= 1000 AND dt_s <= 120)")


def _frame(spark: SparkSession, sf: str) -> DataFrame:
    return model.training_frame(tracks.track_fixes(bridge.states(spark, sf)))


@query("model_training_frame", f"{S.fixes()}, {_FR} SELECT recording, icao24, batch_seq, pos, band, is_holdout, round(gs_mismatch_ratio, 4) AS gs_mismatch_ratio, round(window_gs_std_kt, 4) AS window_gs_std_kt, round(turn_rate_dps, 4) AS turn_rate_dps FROM fr")
def model_training_frame(spark: SparkSession, sf: str) -> DataFrame:
    """ML-01 and ML-02."""
    return model.holdout(_frame(spark, sf)).select("recording", "icao24", "batch_seq", "pos", "band", "is_holdout", F.round("gs_mismatch_ratio", 4).alias("gs_mismatch_ratio"), F.round("window_gs_std_kt", 4).alias("window_gs_std_kt"), F.round("turn_rate_dps", 4).alias("turn_rate_dps"))


@query("model_training_statistics", f"{S.fixes()}, {_FR} SELECT band, count(*) AS rows, count(*) FILTER (is_holdout) AS holdout_rows, round(avg(implied_gs_kt), 3) AS gs_mean, round(quantile_cont(baro_alt_ft, 0.05), 2) AS alt_p05, round(quantile_cont(baro_alt_ft, 0.5), 2) AS alt_p50, round(quantile_cont(baro_alt_ft, 0.95), 2) AS alt_p95 FROM fr GROUP BY ALL")
def model_training_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """ML-05."""
    f = model.holdout(_frame(spark, sf))
    return f.groupBy("band").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_holdout").alias("holdout_rows"), F.round(F.avg("implied_gs_kt"), 3).alias("gs_mean")).join(_altitudes(f), "band")


@query("model_feature_quantiles", f"{S.fixes()}, {_FR} SELECT band, feature, count(x) AS n, round(quantile_cont(x, 0.05), 4) AS p05, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.95), 4) AS p95 FROM (SELECT band, unnest(['implied_gs_kt', 'turn_rate_dps', 'window_gs_std_kt', 'dt_s']) AS feature, unnest([implied_gs_kt, turn_rate_dps, window_gs_std_kt, dt_s]) AS x FROM fr) AS q WHERE x IS NOT NULL GROUP BY ALL")
def model_feature_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """ML-05: quantiles of features by band, interpolated."""
    names = ["implied_gs_kt", "turn_rate_dps", "window_gs_std_kt", "dt_s"]
    long = _frame(spark, sf).select("band", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), c(n).cast("double").alias("x")) for n in names])))
    q = quantiles(long, ["band", "feature"], "x", [0.05, 0.5, 0.95])
    return q.select("band", "feature", "n", *[F.round(F.get("quantiles", F.lit(i)), 4).alias(n) for i, n in enumerate(("p05", "p50", "p95"))])


def _altitudes(frame: DataFrame) -> DataFrame:
    q = quantiles(frame, ["band"], "baro_alt_ft", [0.05, 0.5, 0.95])
    return q.select("band", *[F.round(F.get("quantiles", F.lit(i)), 2).alias(n) for i, n in enumerate(("alt_p05", "alt_p50", "alt_p95"))])


def _fitted(spark: SparkSession, train: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, scale and limits of a model that was stored and came back through the registry's gate."""
    scale = cut_lineage(model.scaling(train))
    registry = model.Registry(f"{shared_folder(spark)}/models-{uuid.uuid4().hex}")
    registry.save("kinematic", model.fit(train, scale), scale, lambda s, n: model.thresholds(model.score(train, s, n)))
    return registry.load(spark, "kinematic")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    f = cut_lineage(model.holdout(_frame(spark, sf)))
    nodes, scale, limits = _fitted(spark, f.filter("not is_holdout"))
    return model.flag(cut_lineage(model.score(f, scale, nodes)), limits)


@query("model_anomalies")
def model_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """ML-03, ML-04 and RUL-19 before persistence; random trees, so checked by properties in the tests."""
    return _scored(spark, sf).filter("flag").select("recording", "icao24", "batch_seq", "pos", "model_band", F.round("score", 4).alias("score"), F.round("margin", 4).alias("margin"), "percentile", "severity", F.concat_ws(";", "explain").alias("explain"))


@query("model_persistent_anomalies")
def model_persistent_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-13: at least two flags of an aircraft within ten minutes, among its last eight flags."""
    from airlens.thresholds import DEFAULT

    return model.persistent(_scored(spark, sf).filter("flag"), DEFAULT.ml_flag_window_s, DEFAULT.ml_min_flags).select("recording", "icao24", "batch_seq", "pos", F.lit("ML-001").alias("rule_id"), "severity", "flagged")


@query("model_flag_rates")
def model_flag_rates(spark: SparkSession, sf: str) -> DataFrame:
    """ML-05: flag rates on both sides of the split."""
    return _scored(spark, sf).groupBy("is_holdout").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(c("flag").cast("double")), 4).alias("flag_rate"))


@query("flag_persistence_window", S.states() + """, fl AS (SELECT * FROM st WHERE squawk IN ('7500', '7600', '7700')), w AS (SELECT *, list(ts) OVER (PARTITION BY recording, icao24 ORDER BY batch_seq, pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS l FROM fl)
  SELECT recording, icao24, batch_seq, pos, CAST(len(list_filter(l, lambda t: ts - t <= 600)) AS INTEGER) AS flagged FROM w WHERE len(list_filter(l, lambda t: ts - t <= 600)) >= 2""")
def flag_persistence_window(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-13 on a deterministic flag (emergency codes)."""
    f = bridge.states(spark, sf).filter(c("squawk").isin("7500", "7600", "7700"))
    w = W.partitionBy("recording", "icao24").orderBy("batch_seq", "pos").rowsBetween(-7, 0)
    f = f.withColumn("_ts", F.collect_list("ts").over(w)).withColumn("flagged", F.size(F.filter("_ts", lambda t: c("ts") - t <= 600.0)))
    return f.filter("flagged >= 2").select("recording", "icao24", "batch_seq", "pos", "flagged")


_TG = f"""fly AS (SELECT *, lag(ts) OVER (PARTITION BY recording, icao24 ORDER BY batch_seq, pos) AS p FROM st WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT on_ground),
pr AS (SELECT recording, icao24, max(n / polls) AS presence FROM (SELECT recording, icao24, region, count(*) AS n FROM fly GROUP BY ALL) AS a JOIN (SELECT recording, region, count(DISTINCT batch_seq) AS polls FROM st GROUP BY ALL) AS b USING (recording, region) GROUP BY ALL),
onst AS (SELECT recording, greatest(3, CAST(floor(count(DISTINCT batch_seq) * 0.4) AS INT)) AS onset FROM st GROUP BY ALL),
wh AS (SELECT recording, icao24, count(*) FILTER (batch_seq >= onset AND (p IS NULL OR ts > p + 0.5)) AS aft, bool_or(coalesce(baro_alt_ft, 0) >= 3000 AND coalesce(gs_kt, 0) >= 150 AND coalesce(nullif(position_source, ''), 'adsb') LIKE 'adsb%' AND coalesce(nic, 0) >= 7 AND coalesce(nac_p, 0) >= 8 AND coalesce(sil, 0) >= 3) AS okc, bool_or(coalesce(baro_alt_ft, 0) >= 3000 AND coalesce(gs_kt, 0) >= 150 AND coalesce(nullif(position_source, ''), 'adsb') LIKE 'adsb%') AS ok FROM fly JOIN onst USING (recording) GROUP BY ALL),
tg AS (SELECT recording, icao24 FROM wh JOIN pr USING (recording, icao24) WHERE ok AND presence >= 0.6 AND aft >= 3 QUALIFY row_number() OVER (PARTITION BY recording ORDER BY sha256(icao24)) <= 25),
tc AS (SELECT recording, icao24 FROM wh JOIN pr USING (recording, icao24) WHERE okc AND presence >= 0.6 AND aft >= 3 QUALIFY row_number() OVER (PARTITION BY recording ORDER BY sha256(icao24)) <= 25),
ts AS (SELECT recording, icao24, scenario FROM tg, (SELECT unnest(['teleport', 'velocity_forge', 'altitude_forge', 'replay', 'squawk_hijack', 'slow_drift']) AS scenario) AS s
   UNION ALL SELECT recording, icao24, 'integrity_degrade' FROM tc UNION ALL SELECT recording, icao24, 'integrity_degrade' FROM tg WHERE recording NOT IN (SELECT recording FROM tc))"""


@query("scenario_targets", f"{S.states()}, {_TG} SELECT * FROM ts")
def scenario_targets(spark: SparkSession, sf: str) -> DataFrame:
    """ML-07: up to 25 targets a recording and scenario, compliant ones where integrity is degraded."""
    st = bridge.states(spark, sf)
    return model.scenario_targets(st, model.onsets(st)).select("recording", "icao24", "scenario")


@query("scenario_rows", f"""{S.states()}, {_TG}, sc AS (SELECT unnest(['teleport', 'velocity_forge', 'altitude_forge', 'squawk_hijack', 'integrity_degrade', 'slow_drift']) AS scenario), y AS (SELECT st.*, sc.scenario, onset FROM st JOIN onst USING (recording), sc), x AS (SELECT y.*, ts.icao24 IS NOT NULL AND batch_seq >= onset AS h FROM y LEFT JOIN ts ON ts.recording = y.recording AND ts.icao24 = y.icao24 AND ts.scenario = y.scenario)
  SELECT recording || '@' || scenario AS recording, batch_seq, pos, icao24, round(CASE WHEN h AND scenario = 'teleport' THEN lat + 0.5 ELSE lat END, 5) AS lat, round(CASE WHEN h AND scenario = 'slow_drift' THEN lon + 0.004 * (batch_seq - onset + 1) ELSE lon END, 5) AS lon,
   CASE WHEN h AND scenario = 'velocity_forge' THEN coalesce(gs_kt, 0) * 0.5 ELSE gs_kt END AS gs_kt, CASE WHEN h AND scenario = 'altitude_forge' THEN coalesce(baro_alt_ft, 0) + 6000 ELSE baro_alt_ft END AS baro_alt_ft, CASE WHEN h AND scenario = 'squawk_hijack' THEN '7500' ELSE squawk END AS squawk,
   CASE WHEN h AND scenario = 'integrity_degrade' THEN 4 ELSE nic END AS nic FROM x""")
def scenario_rows(spark: SparkSession, sf: str) -> DataFrame:
    """ML-08."""
    st = bridge.states(spark, sf)
    on = model.onsets(st)
    return model.perturb(st, model.scenario_targets(st, on), on).select("recording", "batch_seq", "pos", "icao24", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "gs_kt", "baro_alt_ft", "squawk", "nic")


@query("replayed_fixes", f"""{S.states()}, {_TG}, q AS (SELECT n.recording, n.icao24, n.batch_seq, n.pos, o.ts AS old_ts, o.lat AS lat, row_number() OVER (PARTITION BY n.recording, n.icao24, n.batch_seq, n.pos ORDER BY o.batch_seq DESC, o.ts DESC, o.pos DESC) AS r
   FROM st AS n JOIN tg USING (recording, icao24) JOIN onst ON onst.recording = n.recording JOIN st AS o ON o.recording = n.recording AND o.icao24 = n.icao24 AND o.batch_seq < n.batch_seq AND n.ts - o.ts >= 120 AND o.lat IS NOT NULL WHERE n.lat IS NOT NULL AND n.lon IS NOT NULL AND o.lon IS NOT NULL AND n.batch_seq >= onset) SELECT recording || '@replay' AS recording, icao24, count(*) AS replayed FROM q WHERE r = 1 GROUP BY ALL""")
def replayed_fixes(spark: SparkSession, sf: str) -> DataFrame:
    """ML-08 (replay) as an as-of self join."""
    st = bridge.states(spark, sf)
    on = model.onsets(st)
    r = model.replay(st, model.select_targets(st, on), on)
    return r.filter("pos >= 100000").groupBy("recording", "icao24").agg(F.count(F.lit(1)).alias("replayed"))


_CLAIM = ["concat('rec', lpad(cast(s_suppkey % 10 as varchar(8)), 8, '0')) as recording", "cast(s_suppkey as int) as n", "32.5e0 + (s_suppkey % 7) * 0.1e0 as lat", "-97.5e0 + (s_suppkey % 11) * 0.1e0 as lon", "(s_suppkey * 37 % 360) * 1.0e0 as track_deg", "450.0e0 as gs_kt", "35000.0e0 as alt_ft"]


@query("ghost_tracks", f"""{S.states()}, pl AS (SELECT recording, batch_seq, min(batch_ts) AS bts FROM st GROUP BY ALL), g0 AS (SELECT pl.*, k.* EXCLUDE (recording) FROM pl JOIN (SELECT {', '.join(_CLAIM)} FROM supplier) AS k USING (recording)),
  g1 AS (SELECT *, gs_kt * coalesce(bts - lag(bts) OVER (PARTITION BY recording, n ORDER BY batch_seq), 0) / 3600 AS d FROM g0), g2 AS (SELECT * EXCLUDE (lat), lat + sum(d * cos(radians(track_deg)) / 60) OVER (PARTITION BY recording, n ORDER BY batch_seq) AS lat FROM g1)
  SELECT recording, batch_seq, printf('feed%02x', n) AS icao24, track_deg, round(lat, 5) AS lat, round(lon + sum(d * sin(radians(track_deg)) / (60 * greatest(cos(radians(lat)), 0.1))) OVER (PARTITION BY recording, n ORDER BY batch_seq), 5) AS lon FROM g2""")
def ghost_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """ML-09: claimed tracks of a given table at the polls of their recordings."""
    claims = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr(*_CLAIM)
    return model.ghosts(bridge.states(spark, sf), claims).select("recording", "batch_seq", "icao24", "track_deg", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query("target_revisit", f"""{S.states()}, {_TG}, g AS (SELECT st.recording, ts - lag(ts) OVER (PARTITION BY st.recording, st.icao24 ORDER BY batch_seq, pos) AS d FROM st JOIN tg USING (recording, icao24) WHERE lat IS NOT NULL AND lon IS NOT NULL)
  SELECT recording, round(quantile_cont(d, 0.5), 3) AS median_revisit_s FROM g WHERE d > 0.5 GROUP BY ALL""")
def target_revisit(spark: SparkSession, sf: str) -> DataFrame:
    """ML-11."""
    from airlens.operators.ordered import with_previous

    st = bridge.states(spark, sf)
    s = st.filter("lat is not null and lon is not null").join(model.select_targets(st, model.onsets(st)), ["recording", "icao24"])
    s = with_previous(s, ["recording", "icao24"], F.floor(c("batch_ts") / 3600), ["batch_seq", "pos"], ["ts"], "_p").withColumn("d", c("ts") - c("_p.ts")).filter("d > 0.5")
    return quantiles(s, ["recording"], "d", [0.5]).select("recording", F.round(F.get("quantiles", F.lit(0)), 3).alias("median_revisit_s"))


def _evaluation(spark: SparkSession, sf: str, precision: bool = False) -> tuple[DataFrame, DataFrame]:
    """The scenarios through the whole audit in one plan, with the anomaly model's findings on them and without.

    precision: the second result is used, so the findings it counts are stored first: together with the rest their plan,
    which adaptive execution makes anew after every stage, would fill the driver.
    """
    st = bridge.states(spark, sf)
    on = cut_lineage(model.onsets(st))
    tg = cut_lineage(model.scenario_targets(st, on))
    replayed = tg.filter("scenario = 'replay'")
    rows = cut_lineage(model.perturb(st, tg, on).select(*st.columns).unionByName(model.replay(st, replayed, on).select(*st.columns)))
    frame = cut_lineage(model.holdout(_frame(spark, sf)))
    nodes, scale, limits = _fitted(spark, frame.filter("not is_holdout"))

    def found(states: DataFrame, scored_frame: DataFrame) -> DataFrame:
        flags = model.persistent(model.flag(model.score(scored_frame, scale, nodes), limits).filter("flag"))
        return audit.audit(states, extra=[model.findings(flags, states)])

    accepted = found(rows, model.training_frame(tracks.track_fixes(rows))).select("recording", "icao24", "batch_ts", "rule_id", "category")
    baseline = found(st, frame).select("rule_id")
    return model.evaluate(cut_lineage(accepted), cut_lineage(baseline) if precision else baseline, tg, on)


@query("scenario_recall")
def scenario_recall(spark: SparkSession, sf: str) -> DataFrame:
    """ML-10: recall per scenario, with the model in the loop."""
    return _evaluation(spark, sf)[0]


@query("detection_study")
def detection_study(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-37: recall per scenario beside the revisit time of its targets, precision per rule below."""
    from airlens.operators.ordered import with_previous

    recall, precision = _evaluation(spark, sf, precision=True)
    st = bridge.states(spark, sf)
    s = st.filter("lat is not null and lon is not null").join(model.select_targets(st, model.onsets(st)), ["recording", "icao24"])
    gaps = with_previous(s, ["recording", "icao24"], F.floor(c("batch_ts") / 3600), ["batch_seq", "pos"], ["ts"], "_p").withColumn("d", c("ts") - c("_p.ts")).filter("d > 0.5")
    revisit = quantiles(cut_lineage(gaps.select("d", F.lit(1).alias("_k"))), ["_k"], "d", [0.5]).select("_k", F.round(F.get("quantiles", F.lit(0)), 3).alias("median_revisit_s"))
    a = recall.withColumn("_k", F.lit(1)).join(F.broadcast(revisit), "_k").select(F.lit("scenario").alias("kind"), c("scenario").alias("name"), c("recall").alias("value"), "median_ttd_s", "median_revisit_s", "known_gap")
    return a.unionByName(precision.select(F.lit("precision").alias("kind"), c("rule_id").alias("name"), c("precision").alias("value")), allowMissingColumns=True)


@query("audit_findings_with_model")
def audit_findings_with_model(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-19 and ML-06: the audit with the persistent findings of a registered model, past the same cool-down and score."""
    st = bridge.states(spark, sf)
    flags = model.persistent(_scored(spark, sf).filter("flag"))
    found = audit.audit(st, extra=[model.findings(flags, st)])
    return found.select("recording", "batch_seq", "phase", "pos", "rule_id", "severity", "category", "icao24", "occurrences", F.round("risk_score", 4).alias("risk_score"))
