"""Who operates an aircraft, what it is, what it is doing and where; boards per airport, operator and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from airlens import dims
from airlens.functions.geo import haversine_nm, planar_nm
from airlens.operators.bandjoin import floor_cell

c = F.col
AIRPORT_RADIUS_NM = 40.0
# fixed values
MILITARY = (
    r"^(RCH|REACH|SAM|EVAC|TOPCAT|DUKE|HORSE|FRED|REDHK|PAT|CNV|NAVY|ARMY|COAST|CG|GLEX|SLICK|MOOSE|SPAR|VENUS|JAKE|GOLD|TITAN|OTIS|KING|BLUE|VIPER|RAPTOR|EAGLE|SWIFT|GRIFN|BLADE|SNAKE|ROCKY|RAIDR|KNIFE|HAWK|AF\d|USAF|TEST)"
)


def airport_cells(spark: SparkSession) -> DataFrame:
    """One row per 1 degree cell with the airports of its neighbourhood (a table of fixed size)."""
    a = dims.table(spark, "airports")
    for col, src in (("cell_y", "lat"), ("cell_x", "lon")):
        at = floor_cell(c(src), 1.0)
        a = a.withColumn(col, F.explode(F.array(at - 1, at, at + 1)))
    return a.groupBy("cell_y", "cell_x").agg(F.collect_list(F.struct("icao", "lat", "lon", "elev_ft")).alias("_near"))


def nearest_airport(states: DataFrame, max_nm: float = AIRPORT_RADIUS_NM) -> DataFrame:
    """Add airport, airport_nm and airport_elev_ft: a broadcast map lookup per row, nothing is shuffled."""
    cells = F.broadcast(airport_cells(states.sparkSession))
    s = states.withColumn("cell_y", floor_cell(c("lat"), 1.0)).withColumn("cell_x", floor_cell(c("lon"), 1.0)).join(cells, ["cell_y", "cell_x"], "left")
    dist = F.transform("_near", lambda a: F.struct(haversine_nm(c("lat"), c("lon"), a["lat"], a["lon"]).alias("nm"), a["icao"].alias("icao"), a["elev_ft"].alias("elev_ft")))
    s = s.withColumn("_best", F.array_min(dist)).drop("_near", "cell_y", "cell_x")
    ok = c("_best.nm") <= max_nm
    return s.select("*", F.when(ok, c("_best.icao")).alias("airport"), F.when(ok, c("_best.nm")).alias("airport_nm"), F.when(ok, c("_best.elev_ft")).alias("airport_elev_ft")).drop("_best")


def nearest_spaceport(points: DataFrame, lat: str, lon: str, max_nm: float = 60.0) -> DataFrame:
    """Nearest launch site; the forty sites travel as one broadcast row."""
    sites = dims.table(points.sparkSession, "spaceports").agg(F.collect_list(F.struct("code", "lat", "lon")).alias("_sites"))
    p = points.withColumn("_k", F.lit(1)).join(F.broadcast(sites.withColumn("_k", F.lit(1))), "_k").drop("_k")
    d = F.transform("_sites", lambda s: F.struct(planar_nm(c(lat), c(lon), s["lat"], s["lon"]).alias("nm"), s["code"].alias("code")))
    p = p.withColumn("_best", F.array_min(d)).drop("_sites")
    ok = c("_best.nm") <= max_nm
    return p.select("*", F.when(ok, c("_best.code")).alias("spaceport"), F.when(ok, c("_best.nm")).alias("spaceport_nm")).drop("_best")


def airports_near(points: DataFrame, lat: str, lon: str, max_nm: float = 50.0) -> DataFrame:
    """One row per point and airport within the radius."""
    a = dims.table(points.sparkSession, "airports").agg(F.collect_list(F.struct("icao", "lat", "lon")).alias("_apts"))
    p = points.withColumn("_k", F.lit(1)).join(F.broadcast(a.withColumn("_k", F.lit(1))), "_k").drop("_k")
    d = F.filter(F.transform("_apts", lambda s: F.struct(s["icao"].alias("icao"), planar_nm(c(lat), c(lon), s["lat"], s["lon"]).alias("nm"))), lambda x: x["nm"] <= max_nm)
    return p.withColumn("_a", F.explode(d)).drop("_apts").select("*", c("_a.icao").alias("airport"), c("_a.nm").alias("airport_nm")).drop("_a")


def with_operator(states: DataFrame) -> DataFrame:
    """Operator from the callsign designator, then balloon, military words and registration prefixes."""
    ops = dims.table(states.sparkSession, "operators").select(c("code").alias("_code"), c("name").alias("_name"), c("country").alias("_country"), c("category").alias("_cat"))
    s = states.withColumn("_cs", F.upper(F.trim(F.coalesce("callsign", F.lit("")))))
    s = s.withColumn("_d", F.when(c("_cs").rlike("^[A-Z]{3}($|[0-9A-Z])"), F.substring("_cs", 1, 3))).join(F.broadcast(ops), c("_d") == c("_code"), "left")
    reg = F.upper(F.when(F.coalesce("registration", F.lit("")) != "", c("registration")).otherwise(c("_cs")))
    three = F.substring("_cs", 1, 3)

    def pick(balloon: str, table: Column, mil: str, us: str, ca: str, mx: str, unknown: Column, none: str) -> Column:
        return (
            F.when(c("_cs").startswith("HBAL"), balloon).when(c("_code").isNotNull(), table).when(c("_cs").rlike(MILITARY), mil)
            .when(reg.rlike("^N[0-9]"), us).when(reg.rlike("^(C-|CF|CG)"), ca).when(reg.rlike("^X[ABC]"), mx).when(three.rlike("^[A-Z]{1,3}$"), unknown).otherwise(none)
        )

    return s.select(
        *states.columns,
        pick("HBAL", c("_code"), "MIL", "N", "C", "X", three, "?").alias("operator_code"),
        pick("High-altitude balloon", c("_name"), "Military / government", "General aviation (US registration)", "General aviation (Canada)", "General aviation (Mexico)", F.concat(F.lit("Unknown operator "), three), "Unidentified").alias("operator"),
        pick("US", c("_country"), "US", "US", "CA", "MX", F.lit("?"), "?").alias("operator_country"),
        pick("balloon", c("_cat"), "military", "ga", "ga", "ga", F.lit("unknown"), "unknown").alias("operator_cat"),
    )


def with_type(states: DataFrame) -> DataFrame:
    types = dims.table(states.sparkSession, "aircraft_types").select(c("code").alias("_t"), c("name").alias("_tn"), c("category").alias("_tc"))
    code = F.upper(F.when(c("aircraft_type") != "", c("aircraft_type")))
    s = states.withColumn("_u", code).join(F.broadcast(types), c("_u") == c("_t"), "left")
    return s.select(*states.columns, F.coalesce("_tn", "_u", F.lit("unknown")).alias("type_name"), F.coalesce("_tc", F.lit("unknown")).alias("type_cat"))


def with_phase(states: DataFrame) -> DataFrame:
    """Flight phase: an ordered cascade on height above the field, vertical rate and distance."""
    alt = c("baro_alt_ft")
    s = states.withColumn("agl_ft", F.when(c("airport").isNotNull(), alt - c("airport_elev_ft")).otherwise(alt)).withColumn("_vr", F.coalesce("vrate_fpm", F.lit(0.0)))
    at, agl, vr = c("airport").isNotNull(), c("agl_ft"), c("_vr")
    terminal = at & F.coalesce(agl < 10000, F.lit(False))
    phase = (
        F.when(c("on_ground") | (at & F.coalesce(agl < 150, F.lit(False)) & (F.coalesce("gs_kt", F.lit(0.0)) < 80)), "ground")
        .when(terminal & (vr > 300), "departure")
        .when(terminal & (vr < -300) & (agl < 3000) & (c("airport_nm") <= 15), "approach")
        .when(terminal & (vr < -300), "arrival")
        .when(terminal & (agl < 3000), "pattern").when(terminal, "terminal")
        .when((alt >= 18000) & (F.abs(vr) < 500), "cruise").when(vr > 300, "climb").when(vr < -300, "descent").otherwise("level")
    )
    return s.withColumn("phase", phase).drop("_vr")


def enrich(states: DataFrame) -> DataFrame:
    return with_phase(nearest_airport(with_type(with_operator(states))))


COMPLIANT = "nic >= 7 and coalesce(nac_p, 0) >= 8 and coalesce(sil, 0) >= 3"
MEASURED = "not on_ground and position_source like 'adsb%' and nic is not null"


def _share() -> Column:
    return F.round(F.try_divide(F.count_if(F.expr(f"{MEASURED} and {COMPLIANT}")), F.count_if(F.expr(MEASURED))), 4)


def airport_board(enriched: DataFrame) -> DataFrame:
    n = lambda *p: F.count_if(c("phase").isin(*p))
    return enriched.filter("airport is not null").groupBy("recording", "batch_seq", "airport").agg(
        F.count(F.lit(1)).alias("nearby"), n("ground").alias("ground"), n("departure").alias("departing"), n("arrival", "approach").alias("arriving"), n("approach").alias("approach"),
        n("terminal", "pattern").alias("terminal"), n("cruise", "level", "climb", "descent").alias("overhead"), F.count_if(c("squawk").isin("7500", "7600", "7700")).alias("emergencies"))


def top_types(enriched: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent types of an operator in a poll, first seen first among equals."""
    t = enriched.groupBy("recording", "batch_seq", "operator_code", F.coalesce("aircraft_type", F.lit("?")).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("_p"))
    w = W.partitionBy("recording", "batch_seq", "operator_code").orderBy(F.desc("n"), "_p")
    t = t.withColumn("_r", F.row_number().over(w)).filter(c("_r") <= k)
    return t.groupBy("recording", "batch_seq", "operator_code").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_r", "type"))), lambda x: x["type"])).alias("types"))


def operator_board(enriched: DataFrame) -> DataFrame:
    key = ["recording", "batch_seq", "operator_code"]
    alt = F.when(~c("on_ground"), c("baro_alt_ft"))
    b = enriched.groupBy(*key).agg(
        F.first("operator").alias("operator"), F.first("operator_cat").alias("category"), F.count(F.lit(1)).alias("aircraft"), F.count_if(~c("on_ground")).alias("airborne"), F.count_if("on_ground").alias("ground"),
        F.bround(F.avg(alt), 0).alias("mean_alt"), _share().alias("compliance"))
    return b.join(top_types(enriched), key)


def type_board(enriched: DataFrame) -> DataFrame:
    e = enriched.filter("aircraft_type is not null and aircraft_type <> ''").withColumn("type_code", F.upper("aircraft_type"))
    return e.groupBy("recording", "batch_seq", "type_code").agg(
        F.first("type_name").alias("type_name"), F.first("type_cat").alias("category"), F.count(F.lit(1)).alias("aircraft"), F.count_if(~c("on_ground")).alias("airborne"),
        F.bround(F.avg(F.when(~c("on_ground"), c("baro_alt_ft"))), 0).alias("mean_alt"), F.bround(F.avg(F.when(~c("on_ground"), c("gs_kt"))), 0).alias("mean_gs"))


def integrity_by_operator(enriched: DataFrame, at_least: int = 20) -> DataFrame:
    """Share of fixes that meet the minimums, per operator with enough fixes."""
    e = enriched.filter("lat is not null and lon is not null and not on_ground and coalesce(nullif(position_source, ''), 'adsb') = 'adsb' and nic is not null and nac_p is not null and sil is not null")
    return e.groupBy("operator_code").agg(
        F.count(F.lit(1)).alias("fixes"), F.countDistinct("icao24").alias("aircraft"), F.round(F.avg(F.expr("cast(nic >= 7 and nac_p >= 8 and sil = 3 as int)")), 4).alias("compliance"),
    ).filter(c("fixes") >= at_least)


# fixed values: assumptions of the holding estimate
FUEL_KG_PER_MIN, CO2_PER_KG_FUEL, DELAY_COST_PER_MIN, FUEL_PRICE_PER_KG = 40.0, 3.16, 100.0, 0.85


def holding_impact(holds: DataFrame, by: list[str]) -> DataFrame:
    """Minutes, fuel, CO2 and cost of holding findings (`measure` is the observed span in seconds)."""
    m = F.sum(F.coalesce("measure", F.lit(0.0))) / 60.0
    return holds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("holds"), F.countDistinct("icao24").alias("aircraft"), F.round(m, 1).alias("observed_minutes"), F.bround(m * FUEL_KG_PER_MIN, 0).alias("fuel_kg"),
        F.bround(m * FUEL_KG_PER_MIN * CO2_PER_KG_FUEL, 0).alias("co2_kg"), F.bround(m * FUEL_KG_PER_MIN * FUEL_PRICE_PER_KG, 0).alias("fuel_cost"), F.bround(m * DELAY_COST_PER_MIN, 0).alias("delay_cost"))


def recent_findings(states: DataFrame, accepted: DataFrame, window_s: float = 600.0) -> DataFrame:
    """Per poll and aircraft in it: accepted findings of the last `window_s` seconds, holds among them, worst severity.

    Findings are counted per poll first and meet the polls in slots of the window's length, two of which reach any poll.
    """
    f = accepted.filter("icao24 is not null").groupBy("recording", "icao24", c("batch_ts").alias("_at")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(c("rule_id") == "OPS-002").alias("_h"), F.min("sev_rank").alias("_s"))
    slot = F.floor(c("_at") / window_s)
    f = f.withColumn("_slot", F.explode(F.array(slot, slot + 1)))
    s = states.select("recording", "icao24", "batch_seq", "batch_ts").distinct().withColumn("_slot", F.floor(c("batch_ts") / window_s))
    j = s.join(f, ["recording", "icao24", "_slot"]).filter(c("_at").between(c("batch_ts") - window_s, c("batch_ts")))
    return j.groupBy("recording", "icao24", "batch_seq").agg(F.sum("_n").alias("_findings"), F.sum("_h").alias("_holds"), F.min("_s").alias("_worst"))


def with_findings(enriched: DataFrame, recent: DataFrame) -> DataFrame:
    j = enriched.join(recent, ["recording", "icao24", "batch_seq"], "left")
    return j.withColumn("_findings", F.coalesce("_findings", F.lit(0))).withColumn("_holds", F.coalesce("_holds", F.lit(0)))


def _found() -> list[Column]:
    from airlens.functions.scoring import sev_name

    return [F.sum("_findings").alias("findings"), sev_name(F.min("_worst")).alias("worst")]


def airport_findings(noted: DataFrame, programmes: DataFrame) -> DataFrame:
    """Airports of a poll with holds, findings, worst severity and the traffic programmes (airport as IATA code, kind)."""
    b = noted.filter("airport is not null").groupBy("recording", "batch_seq", "airport").agg(F.count(F.lit(1)).alias("nearby"), F.sum("_holds").alias("holds"), *_found())
    p = programmes.groupBy(c("airport").alias("iata")).agg(F.concat_ws(",", F.array_sort(F.collect_list("kind"))).alias("programmes"))
    a = dims.table(noted.sparkSession, "airports").select(c("icao").alias("airport"), "iata", "name", "city", "country")
    return b.join(F.broadcast(a), "airport").join(p, "iata", "left").withColumn("programmes", F.coalesce("programmes", F.lit("")))


def operator_findings(noted: DataFrame) -> DataFrame:
    """Operators of a poll with country, phases (`phase:flights`), findings and worst severity."""
    key = ["recording", "batch_seq", "operator_code"]
    phases = noted.groupBy(*key, "phase").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "phase", c("n").cast("string")))), ",").alias("phases"))
    return noted.groupBy(*key).agg(F.first("operator_country").alias("country"), F.count(F.lit(1)).alias("aircraft"), *_found()).join(phases, key)


def type_findings(noted: DataFrame) -> DataFrame:
    e = noted.filter("aircraft_type is not null and aircraft_type <> ''").withColumn("type_code", F.upper("aircraft_type"))
    return e.groupBy("recording", "batch_seq", "type_code").agg(F.count(F.lit(1)).alias("aircraft"), *_found())
