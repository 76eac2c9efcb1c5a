"""Boards put together from other queries: each section is a few rows (section, item, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.operators import audit, rules
from airlens.operators import catalogue as cat
from airlens.operators import ecosystem as eco
from airlens.operators import picture as pic
from airlens.operators import texts as tx
from airlens.plans import bridge, picture_queries, places, space_queries
from airlens.plans import sqlbase as S
from airlens.plans.registry import QUERIES, SQL, query
from airlens.session import cut_lineage, shared_folder
from airlens.sources import readers

c = F.col
NOW = places.NOW


def _rows(df: DataFrame, section: str, item: Column, value: Column | None, *key: str) -> DataFrame:
    return df.select(*key, F.lit(section).alias("section"), item.cast("string").alias("item"), (F.lit(None) if value is None else value).cast("double").alias("value"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---- mission dossier -----------------------------------------------------------------------------------------------
_NEWEST = "SELECT * FROM (SELECT n_name AS product_id, n_nationkey % 6 AS r, n_nationkey % 5 AS s, (n_nationkey * 7) % 6 AS g, n_nationkey AS age FROM nation) AS p ORDER BY age, product_id LIMIT 1"
_LAUNCHES = f"(WITH {places.LCH_CTE} SELECT launch_id FROM lch)"
_TFR1 = f"(SELECT launch_id, notam_id, count(DISTINCT (recording, icao24)) AS n FROM ({SQL['launch_covering_volumes']}) AS v JOIN ({SQL['restricted_traffic']}) AS t USING (notam_id) WHERE is_active GROUP BY ALL)"


@query("mission_dossier_sections", f"""SELECT launch_id, 'spaceport' AS section, spaceport AS item, CAST(spaceport_nm AS DOUBLE) AS value FROM ({SQL['spaceport_of_pad']}) AS q WHERE spaceport IS NOT NULL
 UNION ALL SELECT launch_id, 'airport', airport, airport_nm FROM ({SQL['airports_near_pad']}) AS q UNION ALL SELECT launch_id, 'volume', notam_id, NULL FROM ({SQL['launch_covering_volumes']}) AS q
 UNION ALL SELECT launch_id, 'inside', notam_id, n FROM {_TFR1} AS q
 UNION ALL SELECT launch_id, 'traffic', recording, aircraft_in_window FROM ({SQL['launch_exposure']}) AS q WHERE aircraft_in_window > 0
 UNION ALL SELECT l.launch_id, 'weather', k, v FROM {_LAUNCHES} AS l, (SELECT unnest(['R', 'S', 'G']) AS k, unnest([r, s, g]) AS v FROM ({_NEWEST}) AS p) AS w
 UNION ALL SELECT launch_id, 'objects', 'all', count(*) FROM ({SQL['objects_of_launch']}) AS q GROUP BY ALL
 UNION ALL SELECT launch_id, 'rule', rule_id, count(*) FROM (SELECT launch_id, rule_id FROM ({SQL['rule_launch_window']}) AS q UNION ALL SELECT launch_id, 'TFR-001' FROM {_TFR1} AS q UNION ALL SELECT launch_id, 'TFR-002' FROM ({SQL['rule_launch_uncovered']}) AS q WHERE uncovered
   UNION ALL SELECT l.launch_id, rule_id FROM {_LAUNCHES} AS l, ({SQL['rule_space_weather']}) AS w WHERE w.product_id = (SELECT product_id FROM ({_NEWEST}) AS p)
   UNION ALL SELECT launch_id, rule_id FROM ({SQL['objects_of_launch']}) AS o JOIN ({SQL['rule_decayed_in_use']}) AS d USING (norad)) AS r GROUP BY ALL""")
def mission_dossier_sections(spark: SparkSession, sf: str) -> DataFrame:
    """JON-15 and AGG-33: for every launch its spaceport and airports, the volumes over its window and the traffic inside
    them, traffic near the pad, space weather, catalogued objects, and the findings of all rules."""
    from airlens.operators import airspace as asp

    run = lambda n: QUERIES[n](spark, sf)
    by = "launch_id"
    volumes = run("launch_covering_volumes")
    # objects are counted by date and site before launches are joined, those that decayed but are in use too
    sites, catalogue = space_queries.launch_sites(spark, sf), space_queries._catalogue(spark, sf)
    per_launch = lambda objects: cat.objects_of_launch(sites, cat.by_site(objects)).groupBy(by).agg(F.sum("n").alias("n"))
    used = run("rule_decayed_in_use").select("norad", "rule_id")
    # how many aircraft a volume saw does not depend on the launch: counted once a volume, before launches are joined
    hits = asp.traffic_inside(bridge.states(spark, sf), places.volumes(spark, sf), only_active=True)
    seen = hits.select("notam_id", "recording", "icao24").distinct().groupBy("notam_id").agg(F.count_if(c("recording").isNotNull() & c("icao24").isNotNull()).alias("n"))
    inside = volumes.join(cut_lineage(seen), "notam_id")
    newest = spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey", "n_name").limit(1)
    launches = places.launches(spark, sf).filter("pad_lat is not null").select(by)
    k = c("n_nationkey")
    scales = F.inline(F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in (("R", k % 6), ("S", k % 5), ("G", k * 7 % 6))]))
    weather = launches.join(F.broadcast(newest.select(scales)))  # three rows
    told = run("rule_space_weather").join(F.broadcast(newest.select(c("n_name").alias("product_id"))), "product_id").select("rule_id")  # at most four
    found = [run("rule_launch_window").select(by, "rule_id"), inside.select(by, F.lit("TFR-001").alias("rule_id")), run("rule_launch_uncovered").filter("uncovered").select(by, F.lit("TFR-002").alias("rule_id")),
             launches.join(F.broadcast(told))]
    decayed = per_launch(catalogue.join(used, "norad")).select(by, F.lit("ORB-008").alias("rule_id"), "n")
    rules_of = _all(found).groupBy(by, "rule_id").agg(F.count(F.lit(1)).alias("n")).unionByName(decayed)
    return _all([
        _rows(run("spaceport_of_pad").filter("spaceport is not null"), "spaceport", c("spaceport"), c("spaceport_nm"), by), _rows(run("airports_near_pad"), "airport", c("airport"), c("airport_nm"), by), _rows(volumes, "volume", c("notam_id"), None, by),
        _rows(inside, "inside", c("notam_id"), c("n"), by), _rows(run("launch_exposure").filter("aircraft_in_window > 0"), "traffic", c("recording"), c("aircraft_in_window"), by), _rows(weather, "weather", c("k"), c("v"), by),
        _rows(per_launch(catalogue), "objects", F.lit("all"), c("n"), by), _rows(rules_of, "rule", c("rule_id"), c("n"), by)])


# ---- operations board ----------------------------------------------------------------------------------------------
_VOLS = f"(WITH {places.VOL_CTE} SELECT * FROM vol)"


@query("operations_board_sections", f"""SELECT * FROM (SELECT 'launch' AS section, launch_id AS item, CAST(w0 AS DOUBLE) AS value FROM (WITH {places.LCH_CTE} SELECT * FROM lch WHERE w0 >= {NOW} ORDER BY w0, launch_id LIMIT 5) AS q)
 UNION ALL SELECT 'launches_24h', 'all', count(*) FROM (WITH {places.LCH_CTE} SELECT * FROM lch WHERE w0 BETWEEN {NOW} AND {NOW} + 86400) AS q
 UNION ALL SELECT * FROM (SELECT 'in_effect', notam_id, CAST(expire_ts AS DOUBLE) FROM {_VOLS} AS v WHERE {places.ACTIVE.format(ts=NOW)} ORDER BY notam_id LIMIT 8) AS q
 UNION ALL SELECT * FROM (SELECT 'next_restriction', notam_id, CAST(effective_ts AS DOUBLE) FROM {_VOLS} AS v WHERE effective_ts > {NOW} ORDER BY effective_ts, notam_id LIMIT 1) AS q
 UNION ALL SELECT 'weather', k, v FROM (SELECT unnest(['R', 'S', 'G']) AS k, unnest([r, s, g]) AS v FROM ({_NEWEST}) AS p) AS w
 UNION ALL SELECT 'advisory', rule_id, measure FROM ({SQL['rule_space_weather']}) AS w WHERE w.product_id = (SELECT product_id FROM ({_NEWEST}) AS p)
 UNION ALL SELECT 'decaying', 'all', count(*) FROM ({SQL['rule_decay']}) AS q
 UNION ALL SELECT * FROM (SELECT 'decaying_first', CAST(norad AS VARCHAR), decay_days FROM ({SQL['rule_decay']}) AS q ORDER BY decay_days NULLS LAST, perigee_km, norad LIMIT 5) AS q
 UNION ALL SELECT 'conjunctions', 'pairs', count(*) FROM ({SQL['conjunction_events']}) AS q UNION ALL SELECT 'conjunctions', 'highest_pc_e6', max(latest_pc_e6) FROM ({SQL['conjunction_events']}) AS q
 UNION ALL SELECT 'well_clear', k, v FROM (SELECT unnest(['airborne', 'violations', 'nmac_proximate']) AS k, unnest([sum(aircraft_airborne), sum(violations), sum(nmac_proximate)]) AS v FROM ({SQL['encounter_rates']}) AS q) AS w
 UNION ALL SELECT 'findings_24h', severity, count(*) FROM (SELECT severity, batch_ts, max(batch_ts) OVER () AS newest FROM ({SQL['audit_findings']}) AS q) AS w WHERE newest - batch_ts <= 86400 GROUP BY ALL""")
def operations_board_sections(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-36: launches, restrictions, space weather, decaying objects, conjunctions, well clear and the findings of a day."""
    from airlens.operators import airspace as asp

    run = lambda n: QUERIES[n](spark, sf)
    now = F.lit(NOW)
    launches, volumes = asp.launch_windows(places.launches(spark, sf)), places.volumes(spark, sf)
    newest = spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey", "n_name").limit(1)
    k = c("n_nationkey")
    scales = F.inline(F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in (("R", k % 6), ("S", k % 5), ("G", k * 7 % 6))]))
    told = run("rule_space_weather").join(F.broadcast(newest.select(c("n_name").alias("product_id"))), "product_id")
    decaying = cut_lineage(run("rule_decay").select("norad", "decay_days", "perigee_km"))
    events = cut_lineage(run("conjunction_events").agg(F.count(F.lit(1)).alias("pairs"), F.max("latest_pc_e6").alias("highest")))  # one row
    rates = run("encounter_rates").agg(F.sum("aircraft_airborne").alias("a"), F.sum("violations").alias("b"), F.sum("nmac_proximate").alias("n"))
    rates = rates.select(F.inline(F.array(*[F.struct(F.lit(n).alias("k"), c(x).cast("double").alias("v")) for n, x in (("airborne", "a"), ("violations", "b"), ("nmac_proximate", "n"))])))
    found = cut_lineage(run("audit_findings").groupBy("severity", "batch_ts").agg(F.count(F.lit(1)).alias("n")))
    last = found.agg(F.max("batch_ts").alias("newest"))  # one row
    recent = found.join(F.broadcast(last)).filter(c("newest") - c("batch_ts") <= 86400).groupBy("severity").agg(F.sum("n").alias("n"))
    count = F.count(F.lit(1)).alias("n")
    return _all([
        _rows(launches.filter(c("w0") >= now).orderBy("w0", "launch_id").limit(5), "launch", c("launch_id"), c("w0")), _rows(launches.filter(c("w0").between(now, now + 86400)).agg(count), "launches_24h", F.lit("all"), c("n")),
        _rows(volumes.filter(asp.active(now)).orderBy("notam_id").limit(8), "in_effect", c("notam_id"), c("expire_ts")), _rows(volumes.filter(c("effective_ts") > now).orderBy("effective_ts", "notam_id").limit(1), "next_restriction", c("notam_id"), c("effective_ts")),
        _rows(newest.select(scales), "weather", c("k"), c("v")), _rows(told, "advisory", c("rule_id"), c("measure")), _rows(decaying.agg(count), "decaying", F.lit("all"), c("n")),
        _rows(decaying.orderBy(c("decay_days").asc_nulls_last(), "perigee_km", "norad").limit(5), "decaying_first", c("norad"), c("decay_days")),
        _rows(events, "conjunctions", F.lit("pairs"), c("pairs")), _rows(events, "conjunctions", F.lit("highest_pc_e6"), c("highest")), _rows(rates, "well_clear", c("k"), c("v")), _rows(recent, "findings_24h", c("severity"), c("n"))])


# ---- filters and whole lists ---------------------------------------------------------------------------------------
@query("flight_list_whole", f"""{picture_queries._EB}, {picture_queries._LATEST} SELECT recording, icao24, callsign, operator_code, type_cat, phase, baro_alt_ft FROM lt
  WHERE type_cat = 'narrowbody' AND baro_alt_ft >= 2000 AND baro_alt_ft <= 30000 AND lower(concat_ws(' ', icao24, callsign, registration, operator, aircraft_type)) LIKE '%a%'""")
def flight_list_whole(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-02: all flights that the filters leave."""
    e = eco.enrich(pic.latest_states(bridge.states(spark, sf)))
    return pic.flights(e, category="narrowbody", min_alt=2000.0, max_alt=30000.0, text="a").select("recording", "icao24", "callsign", "operator_code", "type_cat", "phase", "baro_alt_ft")


@query("flights_by_worst_severity", f"SELECT recording, icao24, findings, rules, worst FROM ({SQL['current_picture']}) AS q WHERE worst = 'high'")
def flights_by_worst_severity(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-02: flights whose worst finding of the last ten minutes is of one severity."""
    st = bridge.states(spark, sf)
    found = pic.recent_findings(pic.latest_states(st), audit.audit(st))
    return pic.flights(found.withColumn("baro_alt_ft", F.lit(None).cast("double")), severity="high").select("recording", "icao24", "findings", F.concat_ws(",", "rules").alias("rules"), "worst")


@query("operator_board_by_category", f"SELECT * FROM ({SQL['operator_board']}) AS q WHERE category = 'regional'")
def operator_board_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-16: the operators' board of one category."""
    return eco.operator_board(eco.enrich(bridge.states(spark, sf))).filter("category = 'regional'")


@query("log_tail", """WITH l AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARNING' ELSE 'ERROR' END AS level, 'turn.' || role AS event, CAST(1.7e9 + conv_id * 60 + turn AS DOUBLE) AS ts FROM conversations)
  SELECT ts, level, event, conv_id FROM l WHERE level IN ('WARNING', 'ERROR') AND event = 'turn.user'""")
def log_tail(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-07: lines of a JSON log from a level on and of one event; lines that are no JSON are left out."""
    folder = f"{shared_folder(spark)}/log-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    level = F.element_at(F.array(*[F.lit(x) for x in ("DEBUG", "INFO", "WARNING", "ERROR")]), (c("turn") % 4 + 1).cast("int"))
    line = F.to_json(F.struct((F.lit(1.7e9) + c("conv_id") * 60 + c("turn")).alias("ts"), level.alias("level"), F.concat(F.lit("turn."), c("role")).alias("event"), F.struct("conv_id").alias("fields")))
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    t.select(F.explode(F.array(line, F.lit("not a line of the log"))).alias("value")).write.mode("overwrite").text(folder)
    return readers.log_lines(spark, folder, least="WARNING", event="turn.user").select("ts", "level", "event", F.get_json_object("fields", "$.conv_id").cast("long").alias("conv_id"))


@query("url_slugs_whole", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def url_slugs_whole(spark: SparkSession, sf: str) -> DataFrame:
    """SCL-22, uncut."""
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", tx.slug(c("url"), 0).alias("slug"))


@query("notice_headlines_whole", "SELECT doc_id, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))[1]) AS headline FROM documents")
def notice_headlines_whole(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-17, uncut."""
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", tx.headline(c("text"), 0).alias("headline"))


@query("burst_addresses", f"WITH RECURSIVE {bridge.states_cte()},{S.POLLS} SELECT p.recording, p.batch_seq, f.icao24 FROM pl AS p JOIN (SELECT recording, icao24, min(batch_seq) AS batch_seq FROM st GROUP BY ALL) AS f USING (recording, batch_seq) WHERE hist_new >= 3 AND n_new >= 25 AND n_new > 4 * greatest(mean_new, 1)")
def burst_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-09: all addresses of every burst; the finding names ten of them."""
    st = bridge.states(spark, sf)
    return rules.burst_addresses(rules.poll_counts(st), rules.first_sightings(st))


@query("threat_coverage_measured")
def threat_coverage_measured(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-32: threats with the recall that the injected scenarios reached, the anomaly model in the loop."""
    from airlens.operators import risk

    return risk.coverage(spark, QUERIES["scenario_recall"](spark, sf).select("scenario", "recall"))
