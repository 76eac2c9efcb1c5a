"""Readers: recordings, provider payloads, products, element files, messages. Explicit schemas, nothing inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.schema import BATCH, STATE_COLUMNS

c = F.col
# fixed values
FT_PER_M, KT_PER_MPS, FPM_PER_MPS = 3.28084, 1.943844, 196.8504
SOURCE_CODES = {0: "adsb", 1: "asterix", 2: "mlat", 3: "flarm"}
ZONE_HOURS = {"UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10, "AST": -4, "ChST": 10}
SPACE_REGULATION, SPACE_TYPE = "91.143", "SPACE OPERATIONS"
PROGRAMME_KINDS = {"Ground_Delay": "ground delay program", "Ground_Stop": "ground stop", "Program": "ground stop", "Airport": "closure", "Airport_Closure": "closure", "Delay": "arrival/departure delay"}


def _lines(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    """Lines of recordings with the recording and the line's place in it.

    A recording is the value of a `recording=` folder if the path has one (its files follow each other by name), else
    the file's path without its suffix, so files of equal names in two folders are two recordings.
    """
    reader = spark.read.schema(BATCH + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    reader = reader if pattern is None else reader.option("pathGlobFilter", pattern)
    b = reader.json(path)
    b = b.select(*[f"`{n}`" for n in b.columns if n != "recording"], c("_metadata.file_path").alias("_file"), c("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    folder = F.regexp_extract("_file", "/recording=([^/]+)/", 1)
    plain = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))  # noqa: E731  (once for the address, once for the folder's name)
    return b.withColumn("recording", F.when(folder != "", plain(plain(folder))).otherwise(F.regexp_replace("_file", r"\.(jsonl|json)(\.gz)?$", "")))


def recordings(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """JSON-lines recordings (gzip too): a line is a poll, polls count in the order of the lines.

    One state row per reported aircraft with the recording, poll number and place. Lines that are no polls are left to
    `corrupt_lines`; between them the two return every line.
    """
    from pyspark.sql.window import Window as W

    b = _lines(spark, path, pattern).filter("_corrupt_record is null and states is not null")
    place = ["_file", "_block", "_line"]
    w = W.partitionBy("recording").orderBy(*place)
    # the clock has a few bytes a poll; the polls' rows are joined by it, not sorted
    clock = b.select("recording", *place, "ts").select("recording", *place, (F.row_number().over(w) - 1).alias("batch_seq"), F.lag("ts").over(w).alias("prev_batch_ts"))
    j = b.join(clock, ["recording", *place]).withColumnRenamed("ts", "batch_ts")
    s = j.select("recording", "batch_seq", "batch_ts", "prev_batch_ts", "region", "provider", F.posexplode("states").alias("pos", "_s"))
    return s.select("recording", "batch_seq", "pos", "batch_ts", "prev_batch_ts", "region", "provider", *[c(f"_s.{n}").alias(n) for n in STATE_COLUMNS])


def corrupt_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Lines that are no polls: recording, and the text where it was not JSON at all."""
    return _lines(spark, path, pattern).filter("_corrupt_record is not null or states is null").select("recording", "_corrupt_record")


READSB = ("hex string, flight string, r string, t string, alt_baro string, alt_geom double, gs double, track double, baro_rate double, geom_rate double, squawk string, emergency string, "
          "nav_altitude_mcp double, lat double, lon double, seen_pos double, nic int, nac_p int, sil int, type string")


def from_readsb(rows: DataFrame, now: Column) -> DataFrame:
    """Aircraft objects of a readsb payload (columns as READSB) to state columns.

    "ground" as altitude means on the ground and no altitude; a zero barometric rate falls through to the geometric one.
    """
    ground = c("alt_baro") == "ground"
    kind = F.coalesce("type", F.lit(""))
    source = F.when(kind.startswith("adsb"), "adsb").when(kind != "", kind)
    return rows.select(
        F.lower(F.trim("hex")).alias("icao24"), c("flight").alias("callsign"), c("r").alias("registration"), c("t").alias("aircraft_type"), (now - F.coalesce("seen_pos", F.lit(0.0))).alias("ts"), "lat", "lon",
        F.when(~F.coalesce(ground, F.lit(False)), c("alt_baro").try_cast("double")).alias("baro_alt_ft"), c("alt_geom").alias("geo_alt_ft"), c("gs").alias("gs_kt"), c("track").alias("track_deg"),
        F.coalesce(F.when(c("baro_rate") != 0, c("baro_rate")), "geom_rate").alias("vrate_fpm"), "squawk", F.coalesce(ground, F.lit(False)).alias("on_ground"), "emergency", c("nav_altitude_mcp").alias("selected_alt_ft"),
        "nic", "nac_p", "sil", source.alias("position_source"), F.lit("readsb").alias("source"))


def readsb(payloads: DataFrame) -> DataFrame:
    """`json` column with {now, ac: [...]}: one row per aircraft."""
    fields = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in READSB.split(", "))
    p = payloads.select(F.from_json("json", f"now double, ac array<struct<{fields}>>").alias("p")).select(c("p.now").alias("_now"), F.inline("p.ac"))
    return from_readsb(p, c("_now"))


def array_rows(payloads: DataFrame) -> DataFrame:
    """`json` column with {time, states: [[...17 values...]]} in SI units: one row per aircraft."""
    p = payloads.select(F.from_json("json", "time double, states array<array<string>>").alias("p")).select(c("p.time").alias("_now"), F.explode("p.states").alias("a"))
    num = lambda i: F.get("a", i).try_cast("double")
    code = F.coalesce(F.get("a", 16).try_cast("int"), F.lit(-1))
    source = None
    for k, v in SOURCE_CODES.items():
        source = F.when(code == k, v) if source is None else source.when(code == k, v)
    return p.select(
        F.lower(F.get("a", 0)).alias("icao24"), F.trim(F.get("a", 1)).alias("callsign"), F.coalesce(num(3), num(4), c("_now")).alias("ts"), num(6).alias("lat"), num(5).alias("lon"), (num(7) * FT_PER_M).alias("baro_alt_ft"),
        (num(13) * FT_PER_M).alias("geo_alt_ft"), (num(9) * KT_PER_MPS).alias("gs_kt"), num(10).alias("track_deg"), (num(11) * FPM_PER_MPS).alias("vrate_fpm"), F.get("a", 14).alias("squawk"),
        F.coalesce(F.get("a", 8).try_cast("boolean"), F.lit(False)).alias("on_ground"), source.alias("position_source"), F.lit("arrays").alias("source"))


def _coordinate(text: Column) -> Column:
    """'41.1N' or '72.5W' to signed degrees; null for anything else."""
    form = r"^\s*([0-9.]+)\s*([NSEW])\s*$"
    v = F.regexp_extract(text, form, 1).try_cast("double")
    return F.when(F.regexp_extract(text, form, 2).isin("S", "W"), -v).otherwise(v)


def _plain(xml: Column) -> Column:
    """A document without CDATA sections, whose text is escaped instead, and without comments."""
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def section(p: Column) -> Column:
        end = F.locate("]]>", p)
        return F.when(end == 0, escaped(p)).otherwise(F.concat(escaped(F.substring(p, F.lit(1), end - 1)), F.substring(p, end + 3, F.length(p))))

    parts = F.split(xml, r"<!\[CDATA\[")
    return F.regexp_replace(F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(section(p))), ""), r"(?s)<!--.*?-->", "")


def _decoded(text: Column) -> Column:
    """Text of an element with its entities resolved; anything that is no entity stays as it is."""
    numbers = F.when(text.contains("&#") & ~F.regexp_like(text, F.lit("&(?!(amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)")), F.expr("1"))
    named = text
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        named = F.replace(named, F.lit(f"&{name};"), F.lit(sign))
    # numbered characters are left to the XML parser, and only where every entity is well formed
    return F.when(numbers.isNotNull(), F.xpath_string(F.concat(F.lit("<t>"), text, F.lit("</t>")), F.lit("t"))).otherwise(named)


def _tag(text: Column, name: str) -> Column:
    """Text of the first such element, decoded and trimmed; null where there is none or it is empty."""
    return F.nullif(F.trim(_decoded(F.regexp_extract(text, f"<{name}(?: [^>]*)?>([^<]*)</{name}>", 1))), F.lit(""))


def _part(text: Column, name: str) -> Column:
    return F.regexp_extract(text, f"(?s)<{name}(?: [^>]*)?>(.*?)</{name}>", 1)


def restrictions_xml(docs: DataFrame) -> DataFrame:
    """`xml` column with one restriction notice each: identity, times in UTC, limits in feet, outline and circle.

    The outline has the vertices of the merged area (or else of the first area) that are no circle; fewer than three
    are none. A vertex of kind CIR is the centre of the circle, the last one if there are several. The regulation is
    the kind that stands directly under the notice's body, not a shape's.
    """
    docs = docs.withColumn("xml", _plain(c("xml")))
    x = c("xml")
    head, body = _part(x, "Not"), _part(x, "TfrNot")
    start_zone = F.coalesce(_tag(head, "codeTimeZone"), F.lit("UTC"))
    end_zone = F.coalesce(_tag(head, "codeExpirationTimeZone"), start_zone)
    zones = F.create_map(*[F.lit(v) for kv in ZONE_HOURS.items() for v in kv])

    def when(name: str, zone: Column) -> Column:
        t = F.unix_timestamp(F.try_to_timestamp(F.substring(_tag(head, name), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))).cast("double")
        return t - F.coalesce(F.try_element_at(zones, zone), F.lit(0)) * 3600.0

    def feet(side: str) -> Column:
        v = _tag(body, f"valDistVer{side}").try_cast("double")
        return F.when(F.upper(F.coalesce(_tag(body, f"uomDistVer{side}"), F.lit("FT"))) == "FL", v * 100.0).otherwise(v)

    merged = _part(x, "abdMergedArea")
    area = F.when(merged != "", merged).otherwise(_part(x, "Abd"))
    each = F.transform(F.regexp_extract_all(area, F.lit(r"(?s)<Avx(?: [^>]*)?>(.*?)</Avx>"), 1), lambda v: F.struct(
        _coordinate(_tag(v, "geoLat")).alias("lat"), _coordinate(_tag(v, "geoLong")).alias("lon"), (F.upper(F.coalesce(_tag(v, "codeType"), F.lit(""))) == "CIR").alias("round"), _tag(v, "valRadiusArc").try_cast("double").alias("r")))
    known = F.filter(each, lambda v: v["lat"].isNotNull() & v["lon"].isNotNull())
    # shapes nest their own kinds deeper: they are taken out before the regulation is looked for
    regulation = _tag(F.regexp_replace(body, r"(?s)<(TFRAreaGroup|aseTFRArea|abdMergedArea|Abd)(?: [^>]*)?>.*</\1>", ""), "codeType")
    d = docs.select("*", known.alias("_v"), start_zone.alias("time_zone"), _tag(head, "txtLocalName").alias("notam_id"), regulation.alias("regulation"), _tag(head, "codeFacility").alias("facility"), _tag(head, "txtNameUSState").alias("state"), _tag(head, "txtNameCity").alias("place"),
                    _tag(head, "txtDescrPurpose").alias("purpose"), _tag(head, "dateIssued").alias("issued"), _tag(head, "dateEffective").alias("effective"), _tag(head, "dateExpire").alias("expire"), when("dateEffective", start_zone).alias("effective_ts"), when("dateExpire", end_zone).alias("expire_ts"),
                    (~(F.map_contains_key(zones, start_zone) & F.map_contains_key(zones, end_zone))).alias("time_zone_assumed_utc"), feet("Lower").alias("lower_ft"), feet("Upper").alias("upper_ft"))
    d = d.withColumn("type", F.when(c("regulation") == SPACE_REGULATION, SPACE_TYPE).otherwise(c("regulation")))
    d = d.withColumn("_p", F.transform(F.filter("_v", lambda v: ~v["round"]), lambda v: F.array(v["lat"], v["lon"]))).withColumn("_c", F.try_element_at(F.filter("_v", lambda v: v["round"]), F.lit(-1)))
    d = d.withColumn("polygon", F.when(F.size("_p") >= 3, c("_p"))).withColumn("vertices", F.when(F.size("_p") >= 3, F.size("_p")).otherwise(0))
    d = d.withColumn("circle", F.when(c("_c").isNotNull(), F.struct(c("_c.lat").alias("lat"), c("_c.lon").alias("lon"), F.coalesce("_c.r", F.lit(0.0)).alias("radius_nm"))))
    mid = lambda i: F.round(F.aggregate("polygon", F.lit(0.0), lambda s, p: s + F.get(p, i)) / F.size("polygon"), 4)
    return d.withColumn("centroid_lat", F.coalesce(mid(0), c("circle.lat"))).withColumn("centroid_lon", F.coalesce(mid(1), c("circle.lon"))).drop("_p", "_c", "_v", "xml")


def airport_programmes_xml(docs: DataFrame) -> DataFrame:
    """`xml` column with an airport status page: one row per entry with its kind, direction, reason, delays and times."""
    fields = ["Reason", "Avg", "Max", "Min", "Trend", "End_Time", "Start", "Reopen"]

    def entry(kind: str):
        def row(x: Column) -> Column:
            direction = F.nullif(F.lower(_decoded(F.regexp_extract(x, '<Arrival_Departure[^>]* Type="([^"]*)"', 1))), F.lit(""))
            return F.struct(F.upper(_tag(x, "ARPT")).alias("airport"), F.lit(kind).alias("kind"), direction.alias("direction"), *[_tag(x, n).alias(n.lower()) for n in fields])

        return row

    docs = docs.withColumn("xml", _plain(c("xml")))
    items = {t: F.filter(F.regexp_extract_all("xml", F.lit(f"(?s)<{t}>(.*?)</{t}>"), 1), lambda x: _tag(x, "ARPT").isNotNull()) for t in PROGRAMME_KINDS}
    found = [F.transform(items[t], entry(kind)) for t, kind in PROGRAMME_KINDS.items()]
    return docs.select(F.inline(F.concat(*found)))


LAUNCH = ("id: string, name: string, net: string, window_start: string, window_end: string, last_updated: string, url: string, status: struct<abbrev: string, name: string>, launch_service_provider: struct<name: string>, "
          "pad: struct<name: string, latitude: string, longitude: string, location: struct<name: string, country_code: string>>")


def launches_json(payloads: DataFrame) -> DataFrame:
    """`json` column with {results: [...]}: flat launch rows; pads and places may be missing."""
    p = payloads.select(F.from_json("json", f"results array<struct<{LAUNCH}>>").alias("p")).select(F.inline("p.results"))
    return p.select("id", "name", c("launch_service_provider.name").alias("provider"), F.coalesce("status.abbrev", "status.name").alias("status"), iso_seconds(c("net")).alias("net"), iso_seconds(c("window_start")).alias("window_start"),
                    iso_seconds(c("window_end")).alias("window_end"), c("pad.name").alias("pad"), c("pad.location.name").alias("location"), c("pad.location.country_code").alias("country"),
                    c("pad.latitude").try_cast("double").alias("pad_lat"), c("pad.longitude").try_cast("double").alias("pad_lon"), iso_seconds(c("last_updated")).alias("last_updated"))


def iso_seconds(text: Column) -> Column:
    """ISO time to epoch seconds; without a zone it is read as UTC."""
    formats = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]X", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mmX", "yyyyMMdd'T'HHmmssX", "yyyy-MM-dd"]
    return F.unix_timestamp(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])).cast("double")


def satcat_csv(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.option("header", True).csv(path)
    empty = lambda n: F.nullif(F.trim(n), F.lit("")).alias(n.lower())
    return d.select(c("NORAD_CAT_ID").try_cast("int").alias("norad"), empty("OBJECT_NAME"), empty("OBJECT_ID"), empty("OBJECT_TYPE"), empty("LAUNCH_DATE"), empty("LAUNCH_SITE"), empty("DECAY_DATE"),
                    *[c(n).try_cast("double").alias(n.lower()) for n in ("PERIOD", "INCLINATION", "APOGEE", "PERIGEE")]).filter("norad is not null")


def element_files(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (file, line_no, text) for the element parser, line by line; line numbers grow within a file."""
    t = spark.read.text(path).select(c("_metadata.file_path").alias("_file"), c("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), F.rtrim("value").alias("text"))
    # a block's lines are numbered in one task: the block's first byte keeps later blocks behind
    first = t.groupBy("_file", "_block").agg(F.min("_line").alias("_first"))
    return t.join(first, ["_file", "_block"]).select(F.element_at(F.split("_file", "/"), -1).alias("file"), (c("_block") + c("_line") - c("_first")).alias("line_no"), "text")


def message_files(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.option("wholetext", True).text(path)
    return t.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), c("value").alias("text"), F.sha2("value", 256).alias("sha256"))


def message_xml_to_kvn(messages: DataFrame) -> DataFrame:
    """XML conjunction messages rewritten as key-value text, so both forms meet in one parser."""
    messages = messages.withColumn("text", _plain(c("text")))
    leaf = F.regexp_extract_all("text", F.lit(r"<([A-Z][A-Z0-9_]*)(?: [^>]*)?>[^<]*</"), 1)
    value = F.regexp_extract_all("text", F.lit(r"<[A-Z][A-Z0-9_]*(?: [^>]*)?>([^<]*)</"), 1)
    lines = F.transform(F.arrays_zip(leaf.alias("k"), value.alias("v")), lambda z: F.concat_ws(" = ", z["k"], _decoded(z["v"])))
    return messages.withColumn("text", F.array_join(lines, "\n"))


def telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with aliased headers: t_s/time, speed in m/s or km/h, altitude in km or m; bad rows dropped."""
    d = spark.read.option("header", True).csv(path)
    have = {n.strip().lower(): n for n in d.columns}

    def pick(names: list[str]) -> str:
        found = next((have[n] for n in names if n in have), None)
        if found is None:
            raise ValueError(f"none of {names} in {d.columns}")
        return found

    t, v, a = pick(["t_s", "t", "time", "time_s", "seconds"]), pick(["speed_mps", "speed_kmh", "speed", "velocity_mps", "velocity_kmh"]), pick(["altitude_km", "altitude_m", "altitude", "alt_km", "alt_m"])
    speed = c(v).try_cast("double") / (3.6 if "kmh" in v.lower() else 1.0)
    alt = c(a).try_cast("double") / (1000.0 if a.lower().endswith("_m") else 1.0)
    return d.select(c(t).try_cast("double").alias("t_s"), speed.alias("speed_mps"), alt.alias("altitude_km")).dropna()


def telemetry_arrays(payloads: DataFrame) -> DataFrame:
    """`json` with parallel arrays time, velocity, altitude; rows with a gap are dropped."""
    p = payloads.select(F.from_json("json", "time array<double>, velocity array<double>, altitude array<double>").alias("p"))
    return p.select(F.posexplode(F.arrays_zip("p.time", "p.velocity", "p.altitude")).alias("n", "z")).select("n", c("z.time").alias("t_s"), c("z.velocity").alias("speed_mps"), c("z.altitude").alias("altitude_km")).dropna()


def packet_stream(payloads: DataFrame) -> DataFrame:
    p = payloads.select(F.from_json("json", "stream string, packets array<struct<spi: int, seq: long, t_s: double, speed_mps: double, altitude_km: double, mac: string>>").alias("p"))
    return p.select(c("p.stream").alias("stream"), F.posexplode("p.packets").alias("index", "k")).select("stream", "index", "k.*")


def geojson_extents(payloads: DataFrame) -> DataFrame:
    """Polygons and multi-polygons of a feature collection as outer rings [[lat, lon]], in file order."""
    feat = "type string, features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    named = ["payload"] if "payload" in payloads.columns else []
    p = payloads.select(*named, F.from_json("json", feat).alias("p")).select(*named, F.posexplode("p.features").alias("ordinal", "f"))
    kind, text = c("f.geometry.type"), c("f.geometry.coordinates")
    one = F.array(F.from_json(text, "array<array<array<double>>>"))
    many = F.from_json(text, "array<array<array<array<double>>>>")
    p = p.withColumn("_r", F.explode(F.when(kind == "MultiPolygon", many).otherwise(one)))
    ring = F.transform(F.get("_r", 0), lambda q: F.array(F.get(q, 1), F.get(q, 0)))
    return p.select(*named, "ordinal", c("f.properties")["event"].alias("event"), c("f.properties")["severity"].alias("severity"), ring.alias("polygon"))


def alert_summary(extents: DataFrame) -> DataFrame:
    """Alerts by event: rings of one alert share its payload (if the rows name one) and its place in it."""
    key = [n for n in ("payload", "ordinal") if n in extents.columns]
    return extents.groupBy("event").agg(F.countDistinct(*key).alias("alerts"))


def scales_json(payloads: DataFrame) -> DataFrame:
    """Space-weather scales: levels now and over the last day, newest known planetary index."""
    lvl = "struct<Scale: string, Text: string>"
    p = payloads.select(F.from_json("json", f"scales map<string, struct<DateStamp: string, TimeStamp: string, R: {lvl}, S: {lvl}, G: {lvl}>>, kp array<struct<time_tag: string, kp_index: double, estimated_kp: double>>, fetched_at string").alias("p")).select("p.*")
    level = lambda day, k: F.coalesce(c("scales")[day][k]["Scale"].try_cast("int"), F.lit(0))
    kp = F.element_at(F.filter(F.transform("kp", lambda x: F.coalesce(x["kp_index"], x["estimated_kp"])), lambda v: v.isNotNull()), -1)
    return p.select(*[level("0", k).alias(k.lower()) for k in "RSG"], *[level("-1", k).alias(f"{k.lower()}_24h") for k in "RSG"], F.when(F.size("kp") > 0, kp).alias("kp"), iso_seconds(c("fetched_at")).alias("fetched_ts"))


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """Small JSON files as the `json` column of the payload readers."""
    return spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "json")


def _objects(payloads: DataFrame, schema: str) -> DataFrame:
    """Objects of `json`, which holds one or an array of them."""
    fields = ", ".join(f"{x.split(' ', 1)[0]}: {x.split(' ', 1)[1]}" for x in schema.split(", "))
    return payloads.select(F.inline(F.from_json("json", f"array<struct<{fields}>>")))


MISSION = ("name string, perigee_km double, apogee_km double, inclination_deg double, mass_kg double, area_m2 double, cd double, mission_years double, propulsion boolean, maneuverable boolean, passivation_plan boolean, disposal_plan string, "
           "disposal_perigee_raise_km double, planned_releases int, trackable boolean, casualty_risk double, demisable boolean, constellation_size int, disposal_reliability double, us_licensed boolean")
# fixed values
MISSION_DEFAULTS = {"cd": 2.2, "mission_years": 5.0, "propulsion": False, "maneuverable": False, "passivation_plan": False, "disposal_plan": "none", "disposal_perigee_raise_km": 0.0, "planned_releases": 0, "trackable": True, "constellation_size": 1, "us_licensed": True}


def missions(payloads: DataFrame) -> DataFrame:
    """`json` with a mission: its fields, the defaults of missing ones, and `extra`: all other fields by name."""
    known = F.array(*[F.lit(x.split()[0]) for x in MISSION.split(", ")])
    rest = F.map_filter(F.from_json("json", "map<string, string>"), lambda k, v: ~F.array_contains(known, k))
    fields = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in MISSION.split(", "))
    return payloads.select(F.from_json("json", f"struct<{fields}>").alias("m"), rest.alias("extra")).select("m.*", "extra").fillna(MISSION_DEFAULTS)


def missions_json(spark: SparkSession, path: str) -> DataFrame:
    """Mission files, one mission each."""
    return missions(json_files(spark, path))


def watch_entries(payloads: DataFrame) -> DataFrame:
    """`json` with a watchlist: entries with the defaults of missing severities and modes."""
    d = _objects(payloads, "label string, reason string, icao24 string, callsign_prefix string, registration string, severity string, mode string")
    return d.fillna({"severity": "high", "mode": "detect"})


def watchlist_json(spark: SparkSession, path: str) -> DataFrame:
    return watch_entries(json_files(spark, path))


def zones(payloads: DataFrame) -> DataFrame:
    return _objects(payloads, "name string, polygon array<array<double>>, capacity int")


def zones_json(spark: SparkSession, path: str) -> DataFrame:
    return zones(json_files(spark, path))


def detections(payloads: DataFrame) -> DataFrame:
    """`json` with the detections of an image: one row each, numbered in their order."""
    box = "struct<label: string, conf: double, cx: double, cy: double, w: double, h: double>"
    d = payloads.select(F.from_json("json", f"struct<image: string, width: int, height: int, detections: array<{box}>>").alias("m"))
    return d.select("m.image", F.posexplode("m.detections").alias("det_id", "d")).select("image", "det_id", "d.*")


def detections_json(spark: SparkSession, path: str) -> DataFrame:
    return detections(json_files(spark, path))


WEATHER = "icaoId string, temp string, wdir string, wspd string, wgst string, visib string, cover string, altim string, rawOb string"


def weather_line(report: Column) -> Column:
    """One line for a station report (a struct with the fields of WEATHER); what is not known reads None, wind `?`."""
    def shown(name: str, missing: str = "None") -> Column:
        return F.coalesce(report[name], F.lit(missing))

    gust = F.when(~F.coalesce(report["wgst"], F.lit("")).isin("", "0"), F.concat(F.lit("G"), report["wgst"])).otherwise("")
    wind = F.concat(shown("wdir", "?"), F.lit("/"), shown("wspd", "?"), F.lit("kt"), gust)
    return F.concat(shown("icaoId"), F.lit(": "), shown("temp"), F.lit("C wind "), wind, F.lit(" vis "), shown("visib"), F.lit("sm cover "), shown("cover"), F.lit(" QNH "), shown("altim"), F.lit(" | "), F.coalesce(report["rawOb"], F.lit("")))


def weather_reports(payloads: DataFrame) -> DataFrame:
    """`json` with an array of station reports: station and line."""
    fields = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in WEATHER.split(", "))
    p = payloads.select(F.explode(F.from_json("json", f"array<struct<{fields}>>")).alias("r"))
    return p.select(c("r.icaoId").alias("station"), weather_line(c("r")).alias("line"))


LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]


def log_lines(spark: SparkSession, path: str, least: str = "DEBUG", event: str | None = None) -> DataFrame:
    """Lines of JSON logs from a level on, and of one event: ts, level, event, and all other fields as JSON. Lines that
    are no JSON object, or of an unknown level, are left out."""
    t = spark.read.text(path).select(F.from_json("value", "ts double, level string, event string, fields string").alias("l")).select("l.*")
    t = t.withColumn("level", F.upper("level")).filter(c("level").isin(LEVELS[LEVELS.index(least.upper()):]))
    return t if event is None else t.filter(c("event") == event)
