"""Products written as text from the driver tables and read back by their readers; sinks written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.operators import audit
from airlens.plans import bridge, places
from airlens.plans import sqlbase as S
from airlens.plans.registry import query
from airlens.session import cut_lineage, shared_folder
from airlens.sources import readers as rd
from airlens.sources import sinks

c = F.col


def _text(x: Column) -> Column:
    return x.cast("string")


def _t(name: str, x: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), _text(x), F.lit(f"</{name}>"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/products-{uuid.uuid4().hex}"


# ---- SRC-01 and SNK-01
@query("recording_round_trip", f"{S.states()} SELECT recording, batch_seq, batch_ts, prev_batch_ts, icao24, ts, round(lat, 6) AS lat, squawk, nic FROM st")
def recording_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-01 and SNK-01: the traffic written as recordings and read back."""
    path = _folder(spark)
    sinks.write_recording(bridge.states(spark, sf), path)
    return rd.recordings(spark, path).select("recording", "batch_seq", "batch_ts", "prev_batch_ts", "icao24", "ts", F.round("lat", 6).alias("lat"), "squawk", "nic")


# ---- SRC-04
_NOTAM = ["s_suppkey as k", "30 + (s_suppkey % 13) * 0.5e0 as lat", "80 + (s_suppkey % 17) * 0.5e0 as lon", "s_suppkey % 2 = 0 as ring", "s_suppkey % 3 = 0 as space", "s_suppkey % 4 as zone"]


@query("restriction_notices", f"""WITH n AS (SELECT {', '.join(_NOTAM)} FROM supplier)
  SELECT '5/' || k AS notam_id, CASE WHEN space THEN 'SPACE OPERATIONS' ELSE '91.137' END AS type, CASE WHEN space THEN '91.143' ELSE '91.137' END AS regulation, 'F' || k AS facility, CAST(1704103200 + CASE zone WHEN 1 THEN 18000 WHEN 2 THEN -36000 ELSE 0 END AS DOUBLE) AS effective_ts,
   CAST(1704110400 + CASE zone WHEN 1 THEN 18000 WHEN 2 THEN 14400 ELSE 0 END AS DOUBLE) AS expire_ts, zone = 3 AS time_zone_assumed_utc, CAST(CASE WHEN k % 5 = 0 THEN NULL ELSE k % 5 * 1000 END AS DOUBLE) AS lower_ft, CASE WHEN k % 7 = 0 THEN NULL ELSE 18000.0 END AS upper_ft,
   CASE WHEN ring THEN 4 ELSE 0 END AS vertices, CASE WHEN ring AND k % 3 <> 0 THEN NULL ELSE 5.5 END AS radius_nm, round(CASE WHEN ring THEN lat + 0.5 ELSE lat END, 4) AS centroid_lat, round(CASE WHEN ring THEN -lon + 0.5 ELSE -lon END, 4) AS centroid_lon,
   CASE k % 3 WHEN 0 THEN 'Cape & <Bay> ' || k WHEN 1 THEN 'Café "' || k || '" &co' ELSE 'a<b>]] & &amp; ' || k END AS place, CASE WHEN k % 2 = 0 THEN 'it''s <on> & off' END AS purpose FROM n""")
def restriction_notices(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-04: notices with zones, nested shape kinds, outlines and circles."""
    n = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr(*_NOTAM)
    point = lambda a, o, *more: F.concat(F.lit("<Avx>"), _t("geoLat", F.concat(_text(a), F.lit("N"))), _t("geoLong", F.concat(_text(o), F.lit("W"))), *more, F.lit("</Avx>"))
    corners = F.concat(*[point(c("lat") + y, c("lon") - x) for y, x in ((0, 0), (1, 0), (1, 1), (0, 1))])
    circle = point(c("lat"), c("lon"), _t("codeType", F.lit("CIR")), _t("valRadiusArc", F.lit(5.5)))
    area = F.concat(F.when(c("ring"), corners).otherwise(""), F.when(~c("ring") | (c("k") % 3 == 0), circle).otherwise(""))
    zone = F.when(c("zone") == 1, "<codeTimeZone>EST</codeTimeZone>").when(c("zone") == 2, "<codeTimeZone>ChST</codeTimeZone><codeExpirationTimeZone>AST</codeExpirationTimeZone>").when(c("zone") == 3, "<codeTimeZone>XST</codeTimeZone>").otherwise("")
    limits = F.concat(F.when(c("k") % 5 != 0, F.concat(_t("valDistVerLower", c("k") % 5 * 1000), F.lit("<uomDistVerLower>FT</uomDistVerLower>"))).otherwise(""), F.when(c("k") % 7 != 0, "<valDistVerUpper>180</valDistVerUpper><uomDistVerUpper>FL</uomDistVerUpper>").otherwise("<valDistVerUpper>UNL</valDistVerUpper>"))
    # named, numbered and broken entities, sections of plain text, a comment
    place = _t("txtNameCity", F.when(c("k") % 3 == 0, F.concat(F.lit("Cape &amp; &lt;Bay&gt; "), _text(c("k")))).when(c("k") % 3 == 1, F.concat(F.lit("Caf&#233; &quot;"), _text(c("k")), F.lit("&quot; &amp;co"))).otherwise(F.concat(F.lit("<![CDATA[a<b>]] & &amp; ]]>"), _text(c("k")))))
    purpose = F.when(c("k") % 2 == 0, "<!-- <txtDescrPurpose>no</txtDescrPurpose> --><txtDescrPurpose>it&apos;s <![CDATA[<on>]]> &amp; off</txtDescrPurpose>").otherwise("")
    xml = F.concat(F.lit("<Group><Add><Not>"), _t("codeFacility", F.concat(F.lit("F"), _text(c("k")))), _t("txtLocalName", F.concat(F.lit("5/"), _text(c("k")))), place, purpose, F.lit("<dateEffective>2024-01-01T10:00:00</dateEffective><dateExpire>2024-01-01T12:00:00</dateExpire>"), zone,
                   F.lit("<TfrNot><TFRAreaGroup><aseTFRArea><codeType>AREA</codeType></aseTFRArea><abdMergedArea>"), area, F.lit("</abdMergedArea>"), limits, F.lit("</TFRAreaGroup>"), _t("codeType", F.when(c("space"), "91.143").otherwise("91.137")), F.lit("</TfrNot></Not></Add></Group>"))
    r = rd.restrictions_xml(n.select(xml.alias("xml")))
    return r.select("notam_id", "type", "regulation", "facility", "effective_ts", "expire_ts", "time_zone_assumed_utc", "lower_ft", "upper_ft", "vertices", c("circle.radius_nm").alias("radius_nm"), F.round("centroid_lat", 4).alias("centroid_lat"), F.round("centroid_lon", 4).alias("centroid_lon"), "place", "purpose")


# ---- SRC-05
@query("airport_programmes", """SELECT 'A' || s_suppkey AS airport, CASE s_suppkey % 4 WHEN 0 THEN 'ground stop' WHEN 1 THEN 'ground delay program' WHEN 2 THEN 'arrival/departure delay' ELSE 'closure' END AS kind, CASE WHEN s_suppkey % 4 = 2 THEN 'arrival' END AS direction, CASE s_suppkey % 3 WHEN 0 THEN 'wind & <rain> ' || s_suppkey WHEN 1 THEN 'snow & ice' ELSE 'r' || s_suppkey END AS reason,
   CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey || ' minutes' END AS avg, CASE WHEN s_suppkey % 4 = 2 THEN '15 minutes' END AS min, CASE WHEN s_suppkey % 4 IN (1, 2) THEN '1 hour' END AS max, CASE WHEN s_suppkey % 4 = 2 THEN 'Increasing' END AS trend, CASE WHEN s_suppkey % 4 = 0 THEN '5:00 pm' END AS end_time FROM supplier""")
def airport_programmes(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-05: status pages of ten airports each."""
    k = c("s_suppkey")
    head = F.concat(_t("ARPT", F.concat(F.lit("a"), _text(k))), _t("Reason", F.when(k % 3 == 0, F.concat(F.lit("wind &amp; &lt;rain&gt; "), _text(k))).when(k % 3 == 1, "<![CDATA[snow & ice]]>").otherwise(F.concat(F.lit("r"), _text(k)))))
    entry = F.when(k % 4 == 0, F.concat(F.lit("<Program>"), head, F.lit("<End_Time>5:00 pm</End_Time></Program>"))).when(k % 4 == 1, F.concat(F.lit("<Ground_Delay>"), head, _t("Avg", F.concat(_text(k), F.lit(" minutes"))), F.lit("<Max>1 hour</Max></Ground_Delay>"))) \
        .when(k % 4 == 2, F.concat(F.lit("<Delay>"), head, F.lit('<Arrival_Departure Type="Arrival"><Min>15 minutes</Min><Max>1 hour</Max><Trend>Increasing</Trend></Arrival_Departure></Delay>'))).otherwise(F.concat(F.lit("<Airport>"), head, F.lit("</Airport>")))
    pages = spark.read.parquet(f"{sf}/supplier.parquet").groupBy((k - k % 10).alias("page")).agg(F.concat(F.lit("<AIRPORT_STATUS_INFORMATION>"), F.array_join(F.collect_list(entry), ""), F.lit("</AIRPORT_STATUS_INFORMATION>")).alias("xml"))
    return rd.airport_programmes_xml(pages).select("airport", "kind", "direction", "reason", "avg", "min", "max", "trend", "end_time")


# ---- SRC-06
@query("launch_payloads", """SELECT 'L' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'Go' ELSE 'Hold for weather' END AS status, CAST(1704067200 + s_suppkey % 1000 * 60 AS DOUBLE) AS net, CASE WHEN s_suppkey % 4 <> 0 THEN 'P' || s_suppkey END AS pad,
   CASE WHEN s_suppkey % 4 <> 0 THEN round(s_suppkey % 90 + 0.25, 2) END AS pad_lat, CASE WHEN s_suppkey % 4 <> 0 THEN 'USA' END AS country FROM supplier""")
def launch_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-06: pages of launches, some without a pad."""
    k = c("s_suppkey")
    net = F.date_format(F.timestamp_seconds(F.lit(1704067200) + k % 1000 * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pad = F.when(k % 4 != 0, F.struct(F.concat(F.lit("P"), _text(k)).alias("name"), F.format_string("%.2f", k % 90 + 0.25).alias("latitude"), F.lit("-80.5").alias("longitude"), F.struct(F.lit("Cape").alias("name"), F.lit("USA").alias("country_code")).alias("location")))
    launch = F.struct(F.concat(F.lit("L"), _text(k)).alias("id"), c("s_name").alias("name"), net.alias("net"), F.struct(F.when(k % 3 == 0, "Go").alias("abbrev"), F.lit("Hold for weather").alias("name")).alias("status"), pad.alias("pad"))
    p = spark.read.parquet(f"{sf}/supplier.parquet").groupBy((k - k % 10).alias("page")).agg(F.to_json(F.struct(F.collect_list(launch).alias("results"))).alias("json"))
    return rd.launches_json(p).select("id", "name", "status", "net", "pad", F.round("pad_lat", 2).alias("pad_lat"), "country")


# ---- SRC-07
@query("catalogue_file", """SELECT CAST(10000 + c_custkey AS INTEGER) AS norad, c_name AS object_name, CASE c_custkey % 3 WHEN 0 THEN 'PAY' WHEN 1 THEN 'DEB' END AS object_type, CASE WHEN c_custkey % 4 = 0 THEN '2024-01-05' END AS decay_date, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 90 + c_custkey % 100 / 4.0 END AS period FROM customer WHERE c_custkey % 50 <> 0""")
def catalogue_file(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-07: a catalogue file with gaps and lines without a number."""
    k = c("c_custkey")
    none = F.lit("")
    d = spark.read.parquet(f"{sf}/customer.parquet").select(
        c("c_name").alias("OBJECT_NAME"), F.concat(F.lit("2024-"), _text(k)).alias("OBJECT_ID"), F.when(k % 50 == 0, "n/a").otherwise(_text(10000 + k)).alias("NORAD_CAT_ID"), F.when(k % 3 == 0, "PAY").when(k % 3 == 1, "DEB").otherwise(none).alias("OBJECT_TYPE"), F.lit("2020-01-01").alias("LAUNCH_DATE"),
        none.alias("LAUNCH_SITE"), F.when(k % 4 == 0, "2024-01-05").otherwise(none).alias("DECAY_DATE"), F.when(k % 5 == 0, none).otherwise(_text(90 + k % 100 / 4)).alias("PERIOD"), F.lit("51.6").alias("INCLINATION"), F.lit("500").alias("APOGEE"), F.lit("490").alias("PERIGEE"))
    path = _folder(spark)
    d.write.option("header", True).csv(path)
    return rd.satcat_csv(spark, path).select("norad", "object_name", "object_type", "decay_date", "period")


# ---- SRC-10
@query("message_xml", "SELECT 'M' || c_custkey AS message_id, round(100 + c_custkey % 1000 * 0.5, 3) AS stated_miss_m, 'A&' || c_custkey AS object1, 'B<' || c_custkey AS object2, round(7000 + c_custkey % 100 * 0.25, 3) AS o1_x FROM customer")
def message_xml(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-10: conjunction messages as XML."""
    from airlens.operators import conjunctions as cj

    k = c("c_custkey")
    unit = lambda n, u, x: F.concat(F.lit(f'<{n} units="{u}">'), F.format_string("%.3f", x.cast("double")), F.lit(f"</{n}>"))
    obj = lambda i, p: F.concat(_t("OBJECT", F.lit(f"OBJECT{i}")), _t("OBJECT_DESIGNATOR", F.concat(F.lit(p), _text(k))), unit("X", "km", 7000 + k % 100 * 0.25))
    xml = F.concat(F.lit("<cdm><header>"), _t("MESSAGE_ID", F.concat(F.lit("M"), _text(k))), F.lit("</header><body>"), unit("MISS_DISTANCE", "m", 100 + k % 1000 * 0.5), obj(1, "A&amp;"), obj(2, "<![CDATA[B<]]>"), F.lit("</body></cdm>"))
    m = rd.message_xml_to_kvn(spark.read.parquet(f"{sf}/customer.parquet").select(_text(k).alias("file"), xml.alias("text")))
    return cj.parse_kvn(m).select("message_id", F.round("stated_miss_m", 3).alias("stated_miss_m"), "object1", "object2", F.round("o1_x", 3).alias("o1_x"))


# ---- SRC-11 and SRC-12
@query("telemetry_file", "SELECT CAST(event_id AS DOUBLE) AS t_s, round(value / 3.6, 4) AS speed_mps, round(value / 1000, 5) AS altitude_km FROM events WHERE event_id % 10 <> 3")
def telemetry_file(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-11: a file in km/h and metres with bad cells."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    path = _folder(spark)
    e.select(c("event_id").alias("Time"), F.when(c("event_id") % 10 == 3, "bad").otherwise(_text(c("value"))).alias("speed_kmh"), c("value").alias("altitude_m")).write.option("header", True).csv(path)
    return rd.telemetry_csv(spark, path).select("t_s", F.round("speed_mps", 4).alias("speed_mps"), F.round("altitude_km", 5).alias("altitude_km"))


@query("telemetry_array_payloads", "SELECT CAST(event_id AS DOUBLE) AS t_s, value AS speed_mps, value / 2 AS altitude_km FROM events WHERE event_id % 9 <> 4")
def telemetry_array_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-12: parallel arrays with gaps, fifty points a payload."""
    e, k = spark.read.parquet(f"{sf}/events.parquet"), c("event_id")
    points = e.groupBy(F.floor(k / 50).alias("g")).agg(F.array_sort(F.collect_list(F.struct(k.alias("t"), F.when(k % 9 != 4, c("value")).alias("v"), (c("value") / 2).alias("a")))).alias("p"))
    p = points.select(F.to_json(F.struct(c("p.t").alias("time"), c("p.v").alias("velocity"), c("p.a").alias("altitude")), {"ignoreNullFields": "false"}).alias("json"))
    return rd.telemetry_arrays(p).select("t_s", "speed_mps", "altitude_km")


# ---- SRC-13
@query("packet_payloads", "SELECT 'u' || user_id % 7 AS stream, CAST(event_id % 3 AS INTEGER) AS spi, event_id AS seq, value AS speed_mps, CASE WHEN event_id % 4 <> 0 THEN 'm' || event_id END AS mac FROM events")
def packet_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-13: packets of a stream, fifty a payload."""
    e, k = spark.read.parquet(f"{sf}/events.parquet"), c("event_id")
    packet = F.struct((k % 3).alias("spi"), k.alias("seq"), (k * 0.5).alias("t_s"), c("value").alias("speed_mps"), F.lit(1.0).alias("altitude_km"), F.when(k % 4 != 0, F.concat(F.lit("m"), _text(k))).alias("mac"))
    stream = F.concat(F.lit("u"), _text(c("user_id") % 7))
    p = e.groupBy(stream.alias("stream"), F.floor(k / 350).alias("g")).agg(F.collect_list(packet).alias("packets")).select(F.to_json(F.struct("stream", "packets")).alias("json"))
    return rd.packet_stream(p).select("stream", "spi", "seq", "speed_mps", "mac")


# ---- SRC-16 and AGG-35
_EXT = "SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'Flood' WHEN 1 THEN 'Fire' ELSE 'Wind' END AS event FROM supplier"


def _extents(spark: SparkSession, sf: str) -> DataFrame:
    s, k = spark.read.parquet(f"{sf}/supplier.parquet"), c("s_suppkey")
    ring = F.concat(F.lit("[["), F.array_join(F.transform(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0, 0), (0, 1), (1, 1))]), lambda q: F.concat(F.lit("["), _text(k % 50 + F.get(q, 0)), F.lit(","), _text(F.get(q, 1)), F.lit("]"))), ","), F.lit("]]"))
    shape = F.when(k % 4 == 0, F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), ring, F.lit(","), ring, F.lit("]}"))).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":'), ring, F.lit("}")))
    event = F.when(k % 3 == 0, "Flood").when(k % 3 == 1, "Fire").otherwise("Wind")
    feature = F.concat(F.lit('{"type":"Feature","properties":{"event":"'), event, F.lit('","severity":"S'), _text(k % 2), F.lit('"},"geometry":'), shape, F.lit("}"))
    return s.groupBy((k - k % 20).alias("g")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("json"))


@query("alert_extents", f"SELECT event, 'S' || k % 2 AS severity, CAST(k % 50 AS DOUBLE) AS west, count(*) * 1 AS rings FROM ({_EXT}) AS e, (SELECT unnest(range(CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END)) AS i) AS r GROUP BY ALL")
def alert_extents(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-16: feature collections of polygons and multi-polygons."""
    e = rd.geojson_extents(_extents(spark, sf))
    west = F.array_min(F.transform("polygon", lambda p: F.get(p, 1)))
    return e.groupBy("event", "severity", west.alias("west")).agg(F.count(F.lit(1)).alias("rings"))


@query("alert_feed_summary", f"SELECT event, count(*) AS alerts FROM ({_EXT}) AS e GROUP BY ALL")
def alert_feed_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-35: alerts by event over all payloads."""
    p = _extents(spark, sf).withColumn("payload", c("g"))
    return rd.alert_summary(rd.geojson_extents(p))


# ---- SRC-18
@query("scale_payloads", """SELECT CAST(s_suppkey % 6 AS INTEGER) AS r, CAST(s_suppkey % 5 AS INTEGER) AS s, CAST(0 AS INTEGER) AS g, CAST(s_suppkey % 4 AS INTEGER) AS g_24h, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey / 4.0 ELSE 5.5 END AS kp, CAST(1704067200 + s_suppkey AS DOUBLE) AS fetched_ts FROM supplier""")
def scale_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-18: scales now and over the last day, newest known index."""
    k = c("s_suppkey")
    lvl = lambda x: F.concat(F.lit('{"Scale":'), x, F.lit("}"))
    quoted = lambda x: F.concat(F.lit('"'), _text(x), F.lit('"'))
    js = F.concat(F.lit('{"scales":{"0":{"R":'), lvl(quoted(k % 6)), F.lit(',"S":'), lvl(quoted(k % 5)), F.lit(',"G":'), lvl(F.lit("null")), F.lit('},"-1":{"G":'), lvl(quoted(k % 4)), F.lit('}},"kp":[{"kp_index":1},'), F.when(k % 2 == 0, F.concat(F.lit('{"kp_index":'), _text(k / 4), F.lit("}"))).otherwise('{"estimated_kp":5.5}'),
                  F.lit(',{}],"fetched_at":"'), F.date_format(F.timestamp_seconds(F.lit(1704067200) + k), "yyyyMMdd'T'HHmmss'Z'"), F.lit('"}'))
    return rd.scales_json(spark.read.parquet(f"{sf}/supplier.parquet").select(js.alias("json"))).select("r", "s", "g", "g_24h", "kp", "fetched_ts")


# ---- SRC-19 to SRC-21
@query("zone_and_detection_files", "SELECT 'img' || s_suppkey AS image, CAST(i AS INTEGER) AS det_id, 'aircraft' AS label, round(0.5 + i * 0.1, 2) AS conf, round(s_suppkey % 10 / 10.0, 2) AS cx, CAST(1 + i AS INTEGER) AS capacity FROM supplier, (SELECT unnest(range(3)) AS i) AS r")
def zone_and_detection_files(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-19: detections joined with zones of the same number."""
    k = c("s_suppkey")
    dets = F.array(*[F.struct(F.lit("aircraft").alias("label"), F.lit(round(0.5 + i * 0.1, 2)).alias("conf"), (k % 10 / 10).alias("cx"), F.lit(0.5).alias("cy"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h")) for i in range(3)])
    images = spark.read.parquet(f"{sf}/supplier.parquet").select(F.to_json(F.struct(F.concat(F.lit("img"), _text(k)).alias("image"), F.lit(640).alias("width"), F.lit(480).alias("height"), dets.alias("detections"))).alias("json"))
    zone = F.struct(F.concat(F.lit("z"), _text(c("id"))).alias("name"), F.expr("array(array(0D,0D),array(1D,0D),array(1D,1D))").alias("polygon"), (c("id") + 1).alias("capacity"))
    zones = rd.zones(spark.range(3).agg(F.to_json(F.collect_list(zone)).alias("json"))).select(F.substring("name", 2, 5).cast("int").alias("det_id"), "capacity")
    return rd.detections(images).join(F.broadcast(zones), "det_id").select("image", "det_id", "label", F.round("conf", 2).alias("conf"), F.round("cx", 2).alias("cx"), "capacity")


@query("mission_files", "SELECT 'M' || s_suppkey AS name, CAST(500 + s_suppkey % 100 AS DOUBLE) AS perigee_km, CASE WHEN s_suppkey % 2 = 0 THEN 2.5 ELSE 2.2 END AS cd, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 12 ELSE 1 END AS INTEGER) AS constellation_size, TRUE AS us_licensed, 'none' AS disposal_plan, CAST(s_suppkey % 9 AS VARCHAR) AS note FROM supplier")
def mission_files(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-20: mission files with missing fields."""
    k = c("s_suppkey")
    m = F.to_json(F.struct(F.concat(F.lit("M"), _text(k)).alias("name"), (500 + k % 100).alias("perigee_km"), F.when(k % 2 == 0, 2.5).alias("cd"), F.when(k % 3 == 0, 12).alias("constellation_size"), (k % 9).alias("note")))
    return rd.missions(spark.read.parquet(f"{sf}/supplier.parquet").select(m.alias("json"))).select("name", "perigee_km", "cd", "constellation_size", "us_licensed", "disposal_plan", c("extra")["note"].alias("note"))


@query("watchlist_files", f"WITH {places.WATCH_CTE} SELECT entry_id AS label, icao24, callsign_prefix, registration, CASE WHEN ord % 4 = 0 THEN 'high' ELSE severity END AS severity, CASE WHEN ord % 6 = 0 THEN 'detect' ELSE mode END AS mode FROM watch")
def watchlist_files(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-21: watchlist files with missing severities and modes."""
    e = places.watch_entries(spark, sf)
    line = F.to_json(F.struct(c("entry_id").alias("label"), "icao24", "callsign_prefix", "registration", F.when(c("ord") % 4 != 0, c("severity")).alias("severity"), F.when(c("ord") % 6 != 0, c("mode")).alias("mode")))
    lists = e.groupBy((c("ord") - c("ord") % 10).alias("g")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(line), ","), F.lit("]")).alias("json"))
    return rd.watch_entries(lists).select("label", "icao24", "callsign_prefix", "registration", "severity", "mode")


# ---- SNK-03 and SNK-04
@query("report_round_trip", f"{S.accepted()} SELECT recording, rule_id, severity, icao24, ts FROM accf")
def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-03: the audit written as a report and its findings read back."""
    st = bridge.states(spark, sf)
    found = audit.audit(st).select("recording", "rule_id", "severity", "icao24", "ts")
    path = _folder(spark)
    found = cut_lineage(found)  # read twice: by the list and by its summary
    sinks.write_report(found, found.groupBy("severity").agg(F.count(F.lit(1)).alias("findings")), path)
    return spark.read.schema(found.schema).parquet(f"{path}/findings")


@query("csv_round_trip", "SELECT s_suppkey, s_name, s_suppkey || ';' || s_nationkey AS keys FROM supplier")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-04: rows with a list written as CSV and read back."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_name", F.array(_text(c("s_suppkey")), _text(c("s_nationkey"))).alias("keys"))
    path = _folder(spark)
    sinks.write_csv(s, path)
    return spark.read.schema("s_suppkey long, s_name string, keys string").option("header", True).csv(path)
