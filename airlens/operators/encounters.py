"""Encounters between airborne aircraft: candidate pairs, well-clear state, summary and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.functions import wellclear as wc
from airlens.functions.geo import FT_PER_NM
from airlens.operators.bandjoin import band_join, floor_cell, trunc_cell

c = F.col
CANDIDATE_NM, CANDIDATE_FT = 10.0, 3000.0
NMAC_H_FT, NMAC_V_FT = 500.0, 100.0
MIN_LEAD_S = 25.0
CELL_DEG = 0.2
MIN_ALT_FT = 500.0


def airborne(states: DataFrame) -> DataFrame:
    return states.filter("lat is not null and lon is not null and not on_ground and gs_kt is not null and track_deg is not null").filter(c("baro_alt_ft") > MIN_ALT_FT)


def samples(states: DataFrame) -> DataFrame:
    """One row per pair and poll with its well-clear state; `weight` counts exact copies of the two reports."""
    geo = ["lat", "lon", "baro_alt_ft", "gs_kt", "track_deg", "vrate_fpm"]
    s = airborne(states).groupBy("recording", "batch_seq", "icao24", *geo).agg(
        F.min("pos").alias("pos"), F.min_by("callsign", "pos").alias("callsign"), F.first("batch_ts").alias("batch_ts"), F.first("region").alias("region"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("callsign", F.trim(F.coalesce("callsign", F.lit("")))).withColumn("vr", F.coalesce("vrate_fpm", F.lit(0.0))).drop("vrate_fpm")
    cells = [trunc_cell(c("lat"), CELL_DEG), trunc_cell(c("lon"), CELL_DEG), floor_cell(c("baro_alt_ft"), CANDIDATE_FT)]
    pairs = band_join(s, s.drop("batch_ts", "region"), ["recording", "batch_seq"], cells, cells).filter("a.icao24 < b.icao24")
    pairs = pairs.filter(F.abs(c("b.baro_alt_ft") - c("a.baro_alt_ft")) <= CANDIDATE_FT)
    g = wc.relative(c("a.lat"), c("a.lon"), c("a.gs_kt"), c("a.track_deg"), c("b.lat"), c("b.lon"), c("b.gs_kt"), c("b.track_deg"))
    pairs = pairs.select(
        "a.recording", "a.batch_seq", "a.batch_ts", "a.region", c("a.icao24").alias("a"), c("b.icao24").alias("b"), c("a.callsign").alias("a_callsign"), c("b.callsign").alias("b_callsign"),
        c("a.pos").alias("pos_a"), c("b.pos").alias("pos_b"), (c("a.n") * c("b.n")).alias("weight"), c("a.baro_alt_ft").alias("alt_ft"),
        (c("b.baro_alt_ft") - c("a.baro_alt_ft")).alias("dz"), ((c("b.vr") - c("a.vr")) / 60.0).alias("vz"), *[v.alias(k) for k, v in g.items()])
    pairs = pairs.withColumn("range", F.sqrt(c("sx") * c("sx") + c("sy") * c("sy"))).filter(c("range") / FT_PER_NM <= CANDIDATE_NM)
    return score(pairs)


def score(pairs: DataFrame) -> DataFrame:
    """Well-clear columns for rows with sx, sy, vx, vy, dz, vz and range: only pairs past the distance test get here."""
    v = [c(n) for n in ("sx", "sy", "vx", "vy")]
    pairs = pairs.withColumn("t_preventive", wc.first_violation(*v, c("dz"), c("vz"), wc.ZTHR_PREVENTIVE_FT))
    pairs = pairs.withColumn("t_corrective", wc.first_violation(*v, c("dz"), c("vz"), wc.ZTHR_FT))
    return pairs.select(
        "*", F.round("range", 1).alias("range_ft"), F.round(wc.miss_distance(*v), 1).alias("hmd_ft"), F.round(wc.tau_mod(*v), 1).alias("tau_mod_s"),
        F.round(F.try_divide(-(c("sx") * c("vx") + c("sy") * c("vy")), c("range")), 2).alias("closure_ftps"), F.round("dz", 1).alias("dz_ft"),
        (~wc.violates(*v, c("dz"))).alias("well_clear"), wc.alert_level(c("t_preventive"), c("t_corrective")).cast("int").alias("alert_level"))


def pair_summary(smp: DataFrame) -> DataFrame:
    """One row per pair of a recording; plain aggregates, combined before the shuffle."""
    nmac = (c("range_ft") <= NMAC_H_FT) & (F.abs("dz_ft") <= NMAC_V_FT)
    first_alert = F.min(F.when(c("alert_level") > 0, c("batch_ts")))
    first_viol = F.min(F.when(~c("well_clear"), c("batch_ts")))
    order = F.struct("batch_seq", "pos_a", "pos_b")
    out = smp.groupBy("recording", "a", "b").agg(
        F.sum("weight").alias("samples"), F.min("range_ft").alias("min_range_ft"), F.round(F.min(F.abs("dz_ft")), 1).alias("min_dz_ft"), F.min("hmd_ft").alias("min_hmd_ft"),
        F.bool_or(~c("well_clear")).alias("violation"), F.bool_or(nmac).alias("nmac_proximate"), F.max("alert_level").alias("max_alert"),
        F.round(first_viol - first_alert, 1).alias("lead_time_s"), F.min("batch_ts").alias("first_ts"), first_viol.alias("violation_ts"),
        F.min_by(F.struct("a_callsign", "b_callsign", "alt_ft", "region"), order).alias("_f"))
    return out.select("*", F.concat_ws(" / ", F.coalesce(F.nullif(c("_f.a_callsign"), F.lit("")), c("a")), F.coalesce(F.nullif(c("_f.b_callsign"), F.lit("")), c("b"))).alias("callsigns"),
                      c("_f.alt_ft").alias("alt_ft"), c("_f.region").alias("region")).drop("_f")


def flight_hours(states: DataFrame) -> DataFrame:
    order = F.struct("batch_seq", "pos")
    per = airborne(states).groupBy("recording", "icao24").agg(F.min_by("ts", order).alias("t0"), F.max_by("ts", order).alias("t1"))
    return per.groupBy("recording").agg(F.count(F.lit(1)).alias("aircraft_airborne"), F.round(F.sum(c("t1") - c("t0")) / 3600.0, 2).alias("flight_hours"))


def nearest_rank(key: list[str], df: DataFrame, value: str, index, alias: str) -> DataFrame:
    """The element of rank `index(n)` (0-based, nothing interpolated) of a column within a group, from value counts.

    Equal values are counted first, so a group is as long as its distinct values, and only running counts are kept.
    """
    counts = df.filter(c(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    return nearest_rank_of_counts(counts, key, value, index).filter("_wanted").select(*key, c(value).alias(alias))


def nearest_rank_of_counts(counts: DataFrame, key: list[str], value: str, index) -> DataFrame:
    """Rows of distinct values with their number `_n` in a group, and whether a value is the one of rank `index(n)`."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy(*key).orderBy(value)
    total = F.sum("_n").over(W.partitionBy(*key))
    upto = F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))
    out = counts.withColumn("_total", total).withColumn("_upto", upto)
    return out.withColumn("_wanted", (c("_upto") > index(c("_total"))) & (c("_upto") - c("_n") <= index(c("_total")))).drop("_total", "_upto")


def recording_summary(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rates of every recording with airborne traffic, and the time of its first pair.

    The pairs are read once: counted by recording and warning time, from which the totals and the median follow.
    """
    lead = F.when(c("violation"), c("lead_time_s"))
    n = pairs.groupBy("recording", lead.alias("_lead")).agg(
        F.count(F.lit(1)).alias("encounter_pairs"), F.count_if(c("max_alert") > 0).alias("pairs_with_alert"), F.count_if("violation").alias("violations"), F.count_if("nmac_proximate").alias("nmac_proximate"),
        F.count(lead).alias("_n"), F.min("first_ts").alias("first_pair_ts"))
    totals = nearest_rank_of_counts(n, ["recording"], "_lead", lambda k: F.floor(k / 2)).groupBy("recording").agg(
        *[F.sum(x).alias(x) for x in ("encounter_pairs", "pairs_with_alert", "violations", "nmac_proximate")], F.min("first_pair_ts").alias("first_pair_ts"), F.max(F.when(c("_wanted"), c("_lead"))).alias("median_lead_time_s"))
    out = flight_hours(states).join(totals, "recording", "left").fillna(0, ["encounter_pairs", "pairs_with_alert", "violations", "nmac_proximate"])
    rates = [F.round(F.try_divide(x, "flight_hours"), 4).alias(f"{y}_per_flight_hour") for x, y in (("violations", "violations"), ("nmac_proximate", "nmac"))]
    return out.select("recording", "aircraft_airborne", "flight_hours", "encounter_pairs", "pairs_with_alert", "violations", "nmac_proximate", "median_lead_time_s", *rates, "first_pair_ts")


def findings(pairs: DataFrame) -> DataFrame:
    """Well-clear violations, and alerts that came later than the warning time."""
    hit = F.explode(F.array_compact(F.array(
        F.when(c("violation"), F.struct(F.lit("DAA-001").alias("rule_id"), F.when(c("nmac_proximate"), "high").otherwise("medium").alias("severity"), c("min_range_ft").alias("measure"))),
        F.when(c("violation") & (c("lead_time_s") < MIN_LEAD_S), F.struct(F.lit("DAA-002").alias("rule_id"), F.lit("medium").alias("severity"), c("lead_time_s").alias("measure"))),
    ))).alias("_h")
    return pairs.select("recording", "a", "b", c("violation_ts").alias("ts"), hit).select("recording", c("a").alias("icao24"), F.concat_ws(":", "a", "b").alias("pair"), "ts", "_h.*", F.lit("safety").alias("category"))


def risk_ratio(pairs: DataFrame) -> DataFrame:
    """Close encounters that came with less than the warning time of notice, over all of them."""
    unresolved = c("nmac_proximate") & (c("lead_time_s").isNull() | (c("lead_time_s") < MIN_LEAD_S))
    out = pairs.groupBy("recording").agg(F.count(F.lit(1)).alias("encounters"), F.count_if("nmac_proximate").alias("nmac_proximate"), F.count_if(unresolved).alias("unresolvable"))
    return out.withColumn("risk_ratio", F.round(F.try_divide("unresolvable", "nmac_proximate"), 3))


def trend(rows: DataFrame, rise: float = 1.5, at_least: int = 3) -> DataFrame:
    """Least-squares slope of the violation rate per day over recordings, and whether it is rising."""
    y = F.coalesce("violations_per_flight_hour", F.lit(0.0))
    out = rows.filter("first_ts is not null").agg(
        F.count(F.lit(1)).alias("recordings"), F.regr_slope(y, c("first_ts") / 86400.0).alias("slope"), F.min_by(y, "first_ts").alias("first_rate"), F.max_by(y, "first_ts").alias("last_rate"))
    rising = (c("recordings") >= at_least) & (c("slope") > 0) & ((c("first_rate") == 0) | (c("last_rate") >= rise * c("first_rate"))) & (c("last_rate") > 0)
    return out.withColumn("rising", F.coalesce(rising, F.lit(False)))
