"""Audit rules as column expressions.

A rule is a predicate, a severity, a category and an evidence struct over one state row with its track features.
All registered rules are evaluated in one pass: an array of optional finding structs per row, nulls dropped, inlined.
Register more with `state_rule` (columns in, columns out) or `batch_rule` (DataFrame in, DataFrame out).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from airlens.functions.geo import haversine_nm
from airlens.functions.scoring import sev_rank
from airlens.thresholds import DEFAULT, Thresholds

FINDING_COLUMNS = [
    "recording", "batch_seq", "phase", "pos", "rule_ord", "rule_id", "severity", "sev_rank", "category", "title",
    "icao24", "callsign", "ts", "batch_ts", "position_source", "measure", "evidence",
]
PHASE_STATE, PHASE_BATCH, PHASE_STREAM, PHASE_ML = 0, 1, 2, 3


@dataclass(frozen=True)
class Hit:
    """What a rule says about one row; `measure` is the number the rule turned on."""

    when: Column
    rule_id: Column
    severity: Column
    category: Column
    title: Column
    measure: Column
    evidence: dict[str, Column]


StateRule = Callable[[Thresholds], Hit]
BatchRule = Callable[[DataFrame, Thresholds], DataFrame]
STATE_RULES: dict[str, StateRule] = {}
BATCH_RULES: dict[str, BatchRule] = {}


def state_rule(name: str) -> Callable[[StateRule], StateRule]:
    def register(fn: StateRule) -> StateRule:
        STATE_RULES[name] = fn
        return fn

    return register


def batch_rule(name: str) -> Callable[[BatchRule], BatchRule]:
    def register(fn: BatchRule) -> BatchRule:
        BATCH_RULES[name] = fn
        return fn

    return register


c, lit = F.col, F.lit


def airborne() -> Column:
    return ~F.coalesce(c("on_ground"), lit(False))


def zero(name: str) -> Column:
    return F.coalesce(c(name), lit(0.0))


def trimmed_callsign() -> Column:
    t = F.trim(c("callsign"))
    return F.when(t != "", t)


def direct_adsb() -> Column:
    src = c("position_source")
    return src.isNull() | (src == "") | src.startswith("adsb")


def source_family() -> Column:
    src = F.when(c("position_source").isNull() | (c("position_source") == ""), "adsb").otherwise(c("position_source"))
    return F.substring_index(src, "_", 1)


@state_rule("SEC-00x")
def emergency_squawk(t: Thresholds) -> Hit:
    sq, run = c("squawk"), c("_squawk_run")
    confirmed = run >= 2
    sev = F.when(sq == "7500", F.when(confirmed, "critical").otherwise("high")).otherwise(F.when(confirmed, "high").otherwise("medium"))
    rid = F.when(sq == "7500", "SEC-003").when(sq == "7600", "SEC-002").when(sq == "7700", "SEC-001")
    title = F.concat(
        F.when(sq == "7500", "Unlawful interference code 7500").when(sq == "7600", "Radio failure code 7600").otherwise("General emergency code 7700"),
        F.when(confirmed, "").otherwise(" (one fix, unconfirmed)"),
    )
    return Hit(sq.isin("7500", "7600", "7700"), rid, sev, lit("security"), title, run.cast("double"),
               {"squawk": sq, "emergency_field": c("emergency"), "consecutive_fixes": run})


def squawk_run(t: Thresholds) -> Column:
    """Consecutive remembered fixes with the row's code, the row itself counted, the newest fix left out."""
    sq = c("squawk")
    earlier = F.slice(F.reverse(c("track")), 2, t.track_window)  # newest first, without the newest
    return F.aggregate(
        earlier,
        F.struct(lit(True).alias("open"), lit(1).alias("n")),
        lambda s, x: F.struct(
            (s["open"] & x["squawk"].eqNullSafe(sq)).alias("open"),
            F.when(s["open"] & x["squawk"].eqNullSafe(sq), s["n"] + 1).otherwise(s["n"]).alias("n"),
        ),
        lambda s: s["n"],
    )

@state_rule("SEC-004")
def emergency_field(t: Thresholds) -> Hit:
    em = c("emergency")
    plain = ~F.coalesce(c("squawk").isin("7500", "7600", "7700"), lit(False))
    return Hit(plain & em.isNotNull() & ~em.isin("none", ""), lit("SEC-004"), lit("high"), lit("security"),
               F.concat(lit("Emergency status field: "), em), lit(1.0), {"emergency_field": em, "squawk": c("squawk")})


@state_rule("SEC-010")
def impossible_jump(t: Thresholds) -> Hit:
    gs = c("implied_gs_kt")
    return Hit(
        (c("dt_s") >= t.min_dt_kinematics_s) & airborne() & (gs > t.max_plausible_gs_kt), lit("SEC-010"),
        F.when(direct_adsb(), F.when(gs > 2 * t.max_plausible_gs_kt, "critical").otherwise("high")).otherwise("medium"),
        F.when(direct_adsb(), "security").otherwise("data-quality"),
        F.when(direct_adsb(), "Position jump no aircraft can fly").otherwise(F.concat(lit("Position jump on a solution from "), c("position_source"))),
        F.round(gs, 1), {"implied_gs_kt": F.round(gs, 1), "reported_gs_kt": c("reported_gs_kt"), "jump_nm": F.round(c("dist_nm"), 2), "dt_s": F.round(c("dt_s"), 1)},
    )


@state_rule("SEC-011")
def speed_mismatch(t: Thresholds) -> Hit:
    fam = source_family()
    tol = t.gs_mismatch_kt * F.when(fam == "mlat", t.mlat_factor).when(fam == "tisb", t.tisb_factor).when(fam == "asterix", t.asterix_factor).otherwise(1.0)
    return Hit(
        c("gs_mismatch_kt").isNotNull() & (c("dt_s") >= t.min_dt_kinematics_s) & airborne()
        & (c("implied_gs_kt") <= t.max_plausible_gs_kt) & (F.abs("gs_mismatch_kt") > tol),
        lit("SEC-011"), F.when(fam == "adsb", "medium").otherwise("low"), lit("security"),
        lit("Reported speed does not match the positions"), F.round("gs_mismatch_kt", 1),
        {"implied_gs_kt": F.round("implied_gs_kt", 1), "reported_gs_kt": c("reported_gs_kt"), "mismatch_kt": F.round("gs_mismatch_kt", 1), "tolerance_kt": F.round(tol, 0), "dt_s": F.round("dt_s", 1)},
    )


@state_rule("SEC-018")
def altitude_inconsistency(t: Thresholds) -> Hit:
    vr = c("implied_vrate_fpm")
    mismatch = vr - c("vrate_fpm")
    impossible = F.abs(vr) > t.max_implied_vrate_fpm
    inconsistent = F.coalesce(F.abs(mismatch) > t.vrate_mismatch_fpm, lit(False))
    return Hit(
        vr.isNotNull() & (c("dt_s") >= t.min_dt_vrate_s) & airborne() & (impossible | inconsistent), lit("SEC-018"),
        F.when(direct_adsb(), F.when(impossible, "high").otherwise("medium")).otherwise("low"),
        F.when(direct_adsb(), "security").otherwise("data-quality"),
        F.when(direct_adsb(), "Altitude change the reported vertical rate cannot explain").otherwise(F.concat(lit("Altitude jump on a solution from "), c("position_source"))),
        F.round(vr, 0), {"implied_vrate_fpm": F.round(vr, 0), "reported_vrate_fpm": c("vrate_fpm"), "mismatch_fpm": F.round(mismatch, 0), "dt_s": F.round("dt_s", 1)},
    )


@state_rule("SEC-012")
def low_integrity(t: Thresholds) -> Hit:
    def below(name: str, label: str, limit: int) -> Column:
        return F.when(c(name) < limit, F.concat(lit(f"{label} "), c(name).cast("string"), lit(f" < {limit}")))

    problems = F.array_compact(F.array(below("nic", "NIC", t.min_nic), below("nac_p", "NACp", t.min_nac_p), below("sil", "SIL", t.min_sil)))
    sev = F.when(F.coalesce(c("sil") == 0, lit(False)) | F.coalesce(c("nic") <= 4, lit(False)), "medium").otherwise("low")
    return Hit(airborne() & F.coalesce(c("position_source").startswith("adsb"), lit(False)) & (F.size(problems) > 0), lit("SEC-012"), sev,
               lit("data-quality"), lit("Position integrity below rule-airspace minimums"), F.size(problems).cast("double"),
               {"nic": c("nic"), "nac_p": c("nac_p"), "sil": c("sil"), "problems": problems})


@state_rule("SEC-013")
def identity_gap(t: Thresholds) -> Hit:
    return Hit(airborne() & (zero("baro_alt_ft") >= t.identity_floor_ft) & trimmed_callsign().isNull(), lit("SEC-013"), lit("low"), lit("security"),
               lit("No flight identification above 10,000 ft"), zero("baro_alt_ft"), {"registration": c("registration"), "type": c("aircraft_type")})


@state_rule("OPS-001")
def stale_contact(t: Thresholds) -> Hit:
    age = c("batch_ts") - c("ts")
    return Hit(airborne() & (age > t.stale_contact_s), lit("OPS-001"), lit("info"), lit("operations"), lit("Coverage gap: stale position"),
               F.round(age, 1), {"age_s": F.round(age, 1)})


def _orbiting(t: Thresholds) -> Column:
    return (airborne() & (c("n_fixes") >= t.hold_min_fixes) & (F.abs("window_heading_sum_deg") >= t.hold_heading_deg)
            & (c("window_net_nm") <= t.hold_max_net_nm))


def _high_and_fast(t: Thresholds) -> Column:
    return (zero("baro_alt_ft") >= t.hold_min_alt_ft) & (zero("gs_kt") >= t.hold_min_gs_kt)


def _orbit_evidence() -> dict[str, Column]:
    return {"heading_change_deg": F.round("window_heading_sum_deg", 0), "net_displacement_nm": F.round("window_net_nm", 2),
            "path_nm": F.round("window_path_nm", 2), "span_s": F.round("window_span_s", 0)}


@state_rule("OPS-002")
def holding(t: Thresholds) -> Hit:
    return Hit(_orbiting(t) & _high_and_fast(t), lit("OPS-002"), lit("low"), lit("operations"), lit("Holding pattern"), F.round("window_span_s", 0), _orbit_evidence())


@state_rule("OPS-003")
def low_orbit(t: Thresholds) -> Hit:
    return Hit(_orbiting(t) & ~_high_and_fast(t), lit("OPS-003"), lit("info"), lit("operations"), lit("Orbiting low or slow"), F.round("window_span_s", 0), _orbit_evidence())


@state_rule("SAF-003")
def excessive_vrate(t: Thresholds) -> Hit:
    return Hit(airborne() & (F.abs("vrate_fpm") > t.max_vrate_fpm), lit("SAF-003"), lit("medium"), lit("safety"), lit("Excessive vertical rate"),
               c("vrate_fpm"), {"vrate_fpm": c("vrate_fpm"), "implied_vrate_fpm": F.round("implied_vrate_fpm", 0)})


@state_rule("OPS-004")
def altitude_deviation(t: Thresholds) -> Hit:
    dev = c("baro_alt_ft") - c("selected_alt_ft")
    size, persistent = c("_dev_fixes"), c("_dev_persistent")
    near = F.abs(dev) <= t.alt_dev_preselect_ft
    return Hit(
        airborne() & dev.isNotNull() & (c("baro_alt_ft") >= t.alt_dev_min_alt_ft) & (F.abs(zero("vrate_fpm")) <= t.level_vrate_fpm)
        & (F.abs(dev) > t.alt_dev_ft) & size.isNotNull() & persistent,
        lit("OPS-004"), F.when(near, "low").otherwise("info"), lit("safety"),
        F.concat(lit("Level flight away from the selected altitude"), F.when(near, "").otherwise(" (large gap: likely the next level)")),
        F.round(dev, 0), {"selected_alt_ft": c("selected_alt_ft"), "deviation_ft": F.round(dev, 0), "vrate_fpm": c("vrate_fpm"), "persisted_fixes": size},
    )


@state_rule("OPS-005")
def vfr_in_class_a(t: Thresholds) -> Hit:
    return Hit(airborne() & (c("squawk") == "1200") & (zero("baro_alt_ft") >= t.class_a_floor_ft), lit("OPS-005"), lit("low"), lit("operations"),
               lit("VFR code in class A airspace"), c("baro_alt_ft"), {"squawk": c("squawk")})


BASE_EVIDENCE = ["lat", "lon", "baro_alt_ft", "gs_kt", "position_source"]


def _extra(extra: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in extra.items()]))


def _evidence(extra: dict[str, Column]) -> Column:
    """Where and what the aircraft was, followed by what the rule adds."""
    return _join_json(F.to_json(F.struct(*BASE_EVIDENCE, c("source").alias("feed"))), _extra(extra))


def _join_json(base: Column, extra: Column) -> Column:
    return F.when(extra == "{}", base).otherwise(F.concat(F.substring(base, lit(1), F.length(base) - 1), lit(","), F.substring(extra, lit(2), F.length(extra))))


def deviation_suffix(t: Thresholds) -> Column:
    """Length of the smallest suffix of the track that is long enough in fixes and in time; null when there is none."""
    newest_first, n = F.reverse(c("track")), F.size("track")
    lengths = F.filter(
        F.when(n >= t.alt_dev_min_fixes, F.sequence(lit(t.alt_dev_min_fixes), n)).otherwise(F.array().cast("array<int>")),
        lambda k: F.get(newest_first, lit(0))["ts"] - F.get(newest_first, k - 1)["ts"] >= t.alt_dev_min_persist_s,
    )
    return F.get(lengths, lit(0))


def deviation_persistent(t: Thresholds) -> Column:
    suffix = F.slice(F.reverse(c("track")), lit(1), F.coalesce(c("_dev_fixes"), lit(1)))
    return F.forall(
        suffix,
        lambda r: F.coalesce(F.abs(r["baro_alt_ft"] - r["selected_alt_ft"]) > t.alt_dev_ft, lit(False))
        & (F.abs(F.coalesce(r["vrate_fpm"], lit(0.0))) <= t.level_vrate_fpm),
    )


def _prepare(featured: DataFrame, t: Thresholds) -> DataFrame:
    """Track scans several rules share or a rule uses more than once."""
    if "track" not in featured.columns:
        return featured
    dev = c("baro_alt_ft") - c("selected_alt_ft")
    featured = featured.withColumn("_squawk_run", F.when(c("squawk").isin("7500", "7600", "7700"), squawk_run(t)))
    featured = featured.withColumn("_dev_fixes", F.when(F.abs(dev) > t.alt_dev_ft, deviation_suffix(t)))
    return featured.withColumn("_dev_persistent", F.when(c("_dev_fixes").isNotNull(), deviation_persistent(t)))


def state_findings(featured: DataFrame, t: Thresholds = DEFAULT, only: list[str] | None = None) -> DataFrame:
    """Every finding of the per-row rules, in one pass over the rows."""
    hits = []
    for i, (name, fn) in enumerate(STATE_RULES.items()):
        if only is not None and name not in only:
            continue
        h = fn(t)
        hits.append(F.when(h.when, F.struct(
            lit(i).alias("rule_ord"), h.rule_id.alias("rule_id"), h.severity.alias("severity"), h.category.alias("category"),
            h.title.alias("title"), h.measure.cast("double").alias("measure"), _extra(h.evidence).alias("extra"))))
    rows = _prepare(featured, t).select(
        "recording", "batch_seq", "pos", "icao24", trimmed_callsign().alias("callsign"), "ts", "batch_ts", *BASE_EVIDENCE, "source",
        F.explode(F.array_compact(F.array(*hits))).alias("_h"),
    )
    return rows.select(
        "recording", "batch_seq", lit(PHASE_STATE).alias("phase"), "pos", "_h.rule_ord", "_h.rule_id", "_h.severity",
        sev_rank(c("_h.severity")).alias("sev_rank"), "_h.category", "_h.title", "icao24", "callsign", "ts", "batch_ts", "position_source",
        "_h.measure", _join_json(F.to_json(F.struct(*BASE_EVIDENCE, c("source").alias("feed"))), c("_h.extra")).alias("evidence"),
    )


@batch_rule("SEC-014")
def duplicate_address(states: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Later rows of an address far from its first positioned row in the same poll."""
    s = states.filter("lat is not null and lon is not null")
    w = W.partitionBy("recording", "batch_seq", "icao24").orderBy("pos")
    s = s.withColumn("_o", F.first(F.struct("pos", "lat", "lon")).over(w))
    sep = haversine_nm(c("_o.lat"), c("_o.lon"), c("lat"), c("lon"))
    s = s.filter(c("_o.pos") < c("pos")).withColumn("_sep", sep).filter(c("_sep") >= t.duplicate_min_sep_nm)
    ev = _evidence({"separation_nm": F.round("_sep", 1), "other_lat": c("_o.lat"), "other_lon": c("_o.lon")})
    return s.select(
        "recording", "batch_seq", lit(PHASE_BATCH).alias("phase"), "pos", lit(0).alias("rule_ord"), lit("SEC-014").alias("rule_id"), lit("high").alias("severity"),
        lit(1).alias("sev_rank"), lit("security").alias("category"), lit("One address at two distant positions").alias("title"), "icao24",
        trimmed_callsign().alias("callsign"), "ts", "batch_ts", "position_source", F.round("_sep", 1).alias("measure"), ev.alias("evidence"),
    )


def poll_sizes(states: DataFrame, first_seen: DataFrame) -> DataFrame:
    """One row per poll: size and number of addresses that first_seen (recording, icao24, batch_seq) puts into it."""
    per_poll = states.groupBy("recording", "batch_seq").agg(
        F.first("batch_ts").alias("batch_ts"), F.first("region").alias("region"), F.first("provider").alias("provider"), F.count(lit(1)).alias("n_states"))
    new = first_seen.groupBy("recording", "batch_seq").agg(F.count(lit(1)).alias("n_new"))
    return per_poll.join(new, ["recording", "batch_seq"], "left").withColumn("n_new", F.coalesce("n_new", lit(0)).cast("long"))


def first_sightings(states: DataFrame) -> DataFrame:
    return states.groupBy("recording", "icao24").agg(F.min("batch_seq").alias("batch_seq"))


def with_history(polls: DataFrame) -> DataFrame:
    """Polls with count and mean of up to eight polls before: of the recording for new addresses, of the region for sizes."""
    # windows over polls, not over rows
    whole = W.partitionBy("recording").orderBy("batch_seq").rowsBetween(-DEFAULT.history_batches, -1)
    region = W.partitionBy("recording", "region").orderBy("batch_seq").rowsBetween(-DEFAULT.history_batches, -1)
    return polls.select(
        "*", F.count(lit(1)).over(whole).alias("hist_new"), F.avg("n_new").over(whole).alias("mean_new"),
        F.count(lit(1)).over(region).alias("hist_size"), F.avg("n_states").over(region).alias("mean_size"))


def poll_counts(states: DataFrame) -> DataFrame:
    """One row per poll: size and number of addresses never seen before in the recording."""
    return with_history(poll_sizes(states, first_sightings(states)))


def stream_findings(states: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """New-address burst (whole recording) and coverage collapse (per region)."""
    return census_findings(poll_counts(states), first_sightings(states), t)


def _burst(t: Thresholds) -> Column:
    return (c("hist_new") >= t.history_min) & (c("n_new") >= t.burst_min_new) & (c("n_new") > t.burst_factor * F.greatest(c("mean_new"), lit(1.0)))


def burst_addresses(polls: DataFrame, first_seen: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """All addresses that came with a burst."""
    return first_seen.join(polls.filter(_burst(t)).select("recording", "batch_seq"), ["recording", "batch_seq"]).select("recording", "batch_seq", "icao24")


def census_findings(polls: DataFrame, first_seen: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """The same for polls with their history; first_seen names the addresses of a burst."""
    burst_when = _burst(t)
    collapse_when = (c("hist_size") >= t.history_min) & (c("mean_size") >= t.collapse_min_baseline) & (c("n_states") < t.collapse_fraction * c("mean_size"))
    sample = (
        first_seen.withColumn("_r", F.row_number().over(W.partitionBy("recording", "batch_seq").orderBy("icao24"))).filter("_r <= 10")
        .groupBy("recording", "batch_seq").agg(F.array_sort(F.collect_list("icao24")).alias("_sample"))
    )
    polls = polls.filter(burst_when | collapse_when).join(sample, ["recording", "batch_seq"], "left")
    hit = F.explode(F.array_compact(F.array(
        F.when(burst_when, F.struct(lit(0).alias("rule_ord"), lit("SEC-016").alias("rule_id"), lit("Burst of never-seen addresses").alias("title"), c("n_new").cast("double").alias("measure"),
                                    F.to_json(F.struct(c("n_new").alias("new_addresses"), F.round("mean_new", 1).alias("rolling_mean_new"), "region", c("_sample").alias("sample"), c("provider").alias("feed"))).alias("evidence"))),
        F.when(collapse_when, F.struct(lit(1).alias("rule_ord"), lit("SEC-017").alias("rule_id"), lit("Coverage collapse").alias("title"), c("n_states").cast("double").alias("measure"),
                                       F.to_json(F.struct(c("n_states").alias("aircraft_now"), F.round("mean_size", 1).alias("rolling_mean"), "region", c("provider").alias("feed"))).alias("evidence"))),
    ))).alias("_h")
    return polls.select("recording", "batch_seq", "batch_ts", hit).select(
        "recording", "batch_seq", lit(PHASE_STREAM).alias("phase"), lit(0).alias("pos"), "_h.rule_ord", "_h.rule_id", lit("high").alias("severity"), lit(1).alias("sev_rank"),
        lit("security").alias("category"), "_h.title", lit(None).cast("string").alias("icao24"), lit(None).cast("string").alias("callsign"), c("batch_ts").alias("ts"), "batch_ts",
        lit(None).cast("string").alias("position_source"), "_h.measure", "_h.evidence")
