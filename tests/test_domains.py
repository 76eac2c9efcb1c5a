"""Readers on small fixtures, closed forms, brute force on small data, model properties."""

import json
import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlens.operators import conjunctions as cj
from airlens.operators import debris, elements, model, telemetry, vision
from airlens.operators.contracts import check
from airlens.sources import readers as rd


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols))


def test_restriction_xml(spark):
    shape = "<aseTFRArea><codeType>AREA</codeType></aseTFRArea>"
    point = lambda a, o, more="": f"<Avx><geoLat>{a}</geoLat><geoLong>{o}</geoLong>{more}</Avx>"
    other = f"<Abd>{point('1N', '1E')}{point('2N', '1E')}{point('2N', '2E')}</Abd>"
    ring = point("41.0N", "72.5W") + point("42.0N", "72.5W") + point("42.0N", "71.5W") + point("bad", "71.5W")
    circle = point("40.0S", "70.0E", "<codeType>CIR</codeType><valRadiusArc>5</valRadiusArc>")

    def notice(area, zone="<codeTimeZone>EST</codeTimeZone><codeExpirationTimeZone>AST</codeExpirationTimeZone>"):
        return (f"<Not><txtLocalName>4/1234</txtLocalName><dateEffective>2024-01-01T10:00:00</dateEffective><dateExpire>2024-01-01T12:00:00</dateExpire>{zone}"
                f"<TfrNot><TFRAreaGroup>{shape}{other}<abdMergedArea>{area}</abdMergedArea><valDistVerUpper>180</valDistVerUpper><uomDistVerUpper>FL</uomDistVerUpper></TFRAreaGroup><codeType>91.143</codeType></TfrNot></Not>")

    both, lone, unknown = [rd.restrictions_xml(one(spark, xml=x)).first() for x in (notice(ring + circle), notice(circle), notice(ring, "<codeTimeZone>XYZ</codeTimeZone>"))]
    assert (both.notam_id, both.type, both.regulation, both.upper_ft, both.lower_ft) == ("4/1234", "SPACE OPERATIONS", "91.143", 18000, None)
    assert (both.effective_ts, both.expire_ts, both.time_zone_assumed_utc) == (1704121200.0, 1704124800.0, False)
    assert len(both.polygon) == both.vertices == 3 and both.polygon[0] == [41.0, -72.5] and tuple(both.circle) == (-40.0, 70.0, 5.0) and both.centroid_lat == 41.6667
    assert lone.polygon is None and lone.vertices == 0 and (lone.centroid_lat, lone.centroid_lon) == (-40.0, 70.0)
    assert unknown.circle is None and unknown.time_zone_assumed_utc and unknown.effective_ts == 1704103200.0


def test_status_launches_scales_and_extents(spark):
    xml = ("<Ground_Stop_List><Program><ARPT>EWR</ARPT><Reason>wind</Reason><End_Time>5 pm</End_Time></Program></Ground_Stop_List><Airport_Closure_List><Airport><ARPT>san</ARPT><Reason>runway</Reason><Start>1</Start><Reopen>2</Reopen></Airport></Airport_Closure_List>"
           "<Ground_Delay_List><Ground_Delay><ARPT>JFK</ARPT><Reason>rain</Reason><Avg>30 minutes</Avg><Max>1 hour</Max></Ground_Delay></Ground_Delay_List><Arrival_Departure_Delay_List><Delay><ARPT>BOS</ARPT><Reason>volume</Reason><Arrival_Departure Type=\"Departure\"><Min>15</Min><Max>30</Max><Trend>Increasing</Trend></Arrival_Departure></Delay></Arrival_Departure_Delay_List>")
    rows = {r.airport: r for r in rd.airport_programmes_xml(one(spark, xml=xml)).collect()}
    assert {k: r.kind for k, r in rows.items()} == {"EWR": "ground stop", "SAN": "closure", "JFK": "ground delay program", "BOS": "arrival/departure delay"}
    assert (rows["BOS"].direction, rows["BOS"].min, rows["BOS"].max, rows["BOS"].trend) == ("departure", "15", "30", "Increasing") and (rows["JFK"].avg, rows["JFK"].direction) == ("30 minutes", None)
    assert rows["EWR"].end_time == "5 pm" and (rows["SAN"].start, rows["SAN"].reopen) == ("1", "2")
    pay = {"results": [{"id": "1", "name": "A", "net": "2024-01-01T00:00:00Z", "status": {"abbrev": "Go"}, "pad": {"name": "P", "latitude": "28.5", "longitude": "-80.5", "location": {"name": "Cape", "country_code": "USA"}}}, {"id": "2", "name": "B", "net": "2024-01-02T00:00:00Z"}]}
    rows = {r.id: r for r in rd.launches_json(one(spark, json=json.dumps(pay))).collect()}
    assert rows["1"].pad_lat == 28.5 and rows["1"].net == 1704067200.0 and rows["2"].pad_lat is None
    sw = {"scales": {"0": {"R": {"Scale": "3"}, "S": {"Scale": None}, "G": {"Scale": "5"}}, "-1": {"G": {"Scale": "2"}}}, "kp": [{"kp_index": 4}, {"estimated_kp": 5.3}, {}], "fetched_at": "20240101T000000Z"}
    r = rd.scales_json(one(spark, json=json.dumps(sw))).first()
    assert (r.r, r.s, r.g, r.g_24h, r.kp, r.fetched_ts) == (3, 0, 5, 2, 5.3, 1704067200.0)
    ring = [[0, 0], [0, 1], [1, 1]]
    geo = {"type": "FeatureCollection", "features": [{"properties": {"event": "Flood"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"event": "Fire"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}
    e = rd.geojson_extents(one(spark, json=json.dumps(geo)))
    assert e.count() == 3 and {(r.event, r.alerts) for r in rd.alert_summary(e).collect()} == {("Flood", 1), ("Fire", 1)}


def test_files(spark):
    d = tempfile.mkdtemp(prefix="files-")
    open(f"{d}/t.csv", "w").write("time,speed_kmh,altitude_m\n0,36,1000\n1,bad,5\n2,72,2000\n")
    assert [tuple(r) for r in rd.telemetry_csv(spark, f"{d}/t.csv").collect()] == [(0.0, 10.0, 1.0), (2.0, 20.0, 2.0)]
    open(f"{d}/c.csv", "w").write("OBJECT_NAME,OBJECT_ID,NORAD_CAT_ID,OBJECT_TYPE,LAUNCH_DATE,LAUNCH_SITE,DECAY_DATE,PERIOD,INCLINATION,APOGEE,PERIGEE\nA,1,25544,PAY,1998-11-20,TYMSC,,92.9,51.6,420,410\nB,2,x,DEB,,,,,,,\n")
    r = rd.satcat_csv(spark, f"{d}/c.csv").collect()
    assert len(r) == 1 and r[0].norad == 25544 and r[0].decay_date is None
    open(f"{d}/m.json", "w").write(json.dumps({"name": "M", "perigee_km": 500, "apogee_km": 500, "mass_kg": 10, "area_m2": 1}))
    m = rd.missions_json(spark, f"{d}/m.json").first()
    assert m.cd == 2.2 and m.constellation_size == 1 and m.us_licensed
    p = rd.telemetry_arrays(one(spark, json='{"time": [0, 1, null], "velocity": [1, 2, 3], "altitude": [0, null, 1]}'))
    assert p.count() == 1


def test_xml_and_text_messages_agree(spark):
    text = "MESSAGE_ID = M1\nMISS_DISTANCE = 100 [m]\nOBJECT = OBJECT1\nOBJECT_DESIGNATOR = 1\nX = 7000 [km]\nOBJECT = OBJECT2\nOBJECT_DESIGNATOR = 2\nX = 7001 [km]"
    xml = "<cdm><header><MESSAGE_ID>M1</MESSAGE_ID></header><MISS_DISTANCE units=\"m\">100</MISS_DISTANCE><OBJECT>OBJECT1</OBJECT><OBJECT_DESIGNATOR>1</OBJECT_DESIGNATOR><X units=\"km\">7000</X><OBJECT>OBJECT2</OBJECT><OBJECT_DESIGNATOR>2</OBJECT_DESIGNATOR><X>7001</X></cdm>"
    a = cj.parse_kvn(one(spark, file="f", text=text)).first()
    b = cj.parse_kvn(rd.message_xml_to_kvn(one(spark, file="f", text=xml))).first()
    assert a == b and a.o1_x == 7000 and a.o2_x == 7001 and a.stated_miss_m == 100


def test_collision_probability_closed_form(spark):
    """Isotropic covariance and a central hit: 1 - exp(-R^2 / 2 s^2)."""
    s2 = 50.0**2
    vals = {"o1_x": 7000.0, "o1_y": 0.0, "o1_z": 0.0, "o2_x": 7000.0, "o2_y": 0.0, "o2_z": 0.0, "o1_x_dot": 0.0, "o1_y_dot": 7.5, "o1_z_dot": 0.0, "o2_x_dot": 0.0, "o2_y_dot": 0.0, "o2_z_dot": 7.5}
    for o in ("o1", "o2"):
        vals |= {f"{o}_cr_r": s2 / 2, f"{o}_ct_r": 0.0, f"{o}_ct_t": s2 / 2, f"{o}_cn_r": 0.0, f"{o}_cn_t": 0.0, f"{o}_cn_n": s2 / 2}
    r = cj.probability(one(spark, **vals)).first()
    assert r.error is None and math.isclose(r.pc, 1 - math.exp(-(20.0**2) / (2 * s2)), rel_tol=1e-3)


def test_lifetime_ordering(spark):
    rows = [("low", 300.0, 300.0, 100.0, 1.0, 2.2), ("mid", 500.0, 500.0, 100.0, 1.0, 2.2), ("high", 900.0, 900.0, 100.0, 1.0, 2.2), ("geo", 35786.0, 35786.0, 100.0, 1.0, 2.2), ("gone", 120.0, 120.0, 100.0, 1.0, 2.2)]
    t = {r.name: r.lifetime_years for r in debris.lifetimes(spark.createDataFrame(rows, "name string, perigee_km double, apogee_km double, mass_kg double, area_m2 double, cd double")).collect()}
    assert t["gone"] == 0 and t["low"] < t["mid"] < t["high"] <= 200 and t["geo"] == 200


def test_kepler_and_geodetic(spark):
    row = dict(norad=1, epoch=1.7e9, n_rev_day=15.0, a_km=(398600.4418 / (15 * 2 * math.pi / 86400) ** 2) ** (1 / 3), e=0.1, inc_deg=51.6, raan_deg=10.0, argp_deg=20.0, m_deg=0.0)
    e = elements.geodetic(elements.ephemeris(one(spark, **row), 1.7e9, 3, 60.0)).orderBy("t_idx").collect()
    r = math.sqrt(e[0].x_km**2 + e[0].y_km**2 + e[0].z_km**2)
    assert math.isclose(r, row["a_km"] * 0.9, rel_tol=1e-9) and all(abs(x.lat) <= 51.9 for x in e)
    v = math.sqrt(e[0].vx_kms**2 + e[0].vy_kms**2 + e[0].vz_kms**2)
    assert math.isclose(v, math.sqrt(398600.4418 * (2 / r - 1 / row["a_km"])), rel_tol=1e-6)


def test_element_lines(spark):
    l1 = "1 25544U 98067A   24001.50000000  .00016717  00000-0  10270-3 0  999"
    l2 = "2 25544  51.6400 208.9163 0006317  69.9862  25.2906 15.4938155800001"
    chk = lambda s: str(sum(int(x) if x.isdigit() else (x == "-") for x in s) % 10)
    a, b = l1 + chk(l1), l2 + chk(l2)
    rows = [("f", 0, "STATION"), ("f", 1, a), ("f", 2, b), ("f", 3, a), ("f", 4, b), ("f", 5, "BAD"), ("f", 6, l1 + str((int(chk(l1)) + 1) % 10)), ("f", 7, b), ("f", 8, "")]
    r = elements.mean_elements(elements.parse_lines(spark.createDataFrame(rows, "file string, line_no int, text string"))).orderBy("line_no").collect()
    assert [x.name for x in r] == ["STATION", "NORAD 25544"] and r[0].norad == 25544 and math.isclose(r[0].bstar, 0.10270e-3) and math.isclose(r[0].epoch, 1704067200 + 43200)


def test_hmac_matches_library(spark):
    import hashlib
    import hmac

    key = b"some key"
    i, o = telemetry.key_pads(key)
    got = spark.range(1).select(telemetry.hmac_sha256(F.lit("1|2|3.000000"), F.lit(i), F.lit(o))).first()[0]
    assert got == hmac.new(key, b"1|2|3.000000", hashlib.sha256).hexdigest()


def test_suppression_and_matching_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i % 5), int(i), float(round(rng.random(), 3)), float(rng.random()), float(rng.random()), 0.3, 0.3) for i in range(60)]
    df = spark.createDataFrame(rows, "image long, det_id long, conf double, cx double, cy double, w double, h double")

    def iou(a, b):
        w = min(a[3] + a[5] / 2, b[3] + b[5] / 2) - max(a[3] - a[5] / 2, b[3] - b[5] / 2)
        h = min(a[4] + a[6] / 2, b[4] + b[6] / 2) - max(a[4] - a[6] / 2, b[4] - b[6] / 2)
        x = max(w, 0) * max(h, 0)
        return x / (a[5] * a[6] + b[5] * b[6] - x)

    want = set()
    for img in range(5):
        kept = []
        for r in sorted((r for r in rows if r[0] == img), key=lambda r: (-r[2], r[1])):
            if all(iou(r, k) < 0.5 for k in kept):
                kept.append(r)
        want |= {k[1] for k in kept}
    assert {r.det_id for r in vision.suppress(df).collect()} == want
    m = vision.match(df, df.withColumn("cx", F.col("cx") + 0.001)).agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first()
    assert tuple(m) == (60, 0, 0)


def test_contract_clauses(spark):
    contract = {
        "type": "object", "required": ["id"], "additionalProperties": False,
        "properties": {
            "id": {"type": "string", "pattern": "^m"}, "n": {"type": ["integer", "null"], "minimum": 1}, "tags": {"type": "array", "items": {"type": "string", "maxLength": 3}, "minItems": 1, "maxItems": 2}, "pos": {"$ref": "#/defs/pos"},
            "who": {"oneOf": [{"type": "string"}, {"type": "object", "required": ["name"]}]}, "any": {"anyOf": [{"type": "integer"}, {"type": "boolean"}]}, "all": {"allOf": [{"type": "number", "minimum": 0}, {"maximum": 5}]}, "opt": {"type": "string", "nullable": True}, "ext": {"type": "object", "additionalProperties": {"type": "number"}},
        }, "defs": {"pos": {"type": "object", "properties": {"lat": {"type": "number", "maximum": 90}}, "required": ["lat"]}},
    }
    cases = {
        '{"id":"m1"}': set(), '{"id":"x","zz":1}': {("$.id", "does not match pattern"), ("$.zz", "unexpected property")}, '{"n":0}': {("$.id", "missing"), ("$.n", "below minimum")},
        '{"id":"m","n":null,"tags":["a","long",3],"opt":null}': {("$.tags", "too many items"), ("$.tags[1]", "too long"), ("$.tags[2]", "wrong type")}, '{"id":"m","tags":[],"pos":{"lat":91}}': {("$.tags", "too few items"), ("$.pos.lat", "above maximum")},
        '{"id":"m","pos":{},"who":3,"any":"s","all":6}': {("$.pos.lat", "missing"), ("$.who", "matches 0 of oneOf"), ("$.any", "matches none of anyOf"), ("$.all", "above maximum")}, '{"id":"m","ext":{"a":1,"b":"x"}}': {("$.ext.b", "wrong type")},
        "broken": {("$", "not JSON")}, '{"id":null}': {("$.id", "wrong type")}, "[1]": {("$", "wrong type")},
    }
    df = spark.createDataFrame([(m,) for m in cases], "json string")
    found = {}
    for r in check(df, "json", contract).collect():
        found.setdefault(r.json, set()).add((r.path, r.problem))
    assert found == {m: p for m, p in cases.items() if p}


def test_contracts_nested(spark):
    c = {"type": "object", "required": ["a"], "properties": {"a": {"$ref": "#/defs/inner"}}, "defs": {"inner": {"type": "object", "required": ["b"], "properties": {"b": {"type": "integer", "minimum": 2}}}}}
    rows = [(1, '{"a": {"b": 3}}'), (2, '{"a": {"b": 1}}'), (3, '{"a": {}}'), (4, "{}"), (5, '{"a": {"b": "x"}}')]
    got = {(r.id, r.path, r.problem) for r in check(spark.createDataFrame(rows, "id int, json string"), "json", c).collect()}
    assert got == {(2, "$.a.b", "below minimum"), (3, "$.a.b", "missing"), (4, "$.a", "missing"), (5, "$.a.b", "wrong type")}


def test_forest_ranks_planted_outliers_first(spark):
    rng = np.random.default_rng(1)
    rows = [("r", f"a{i}", i, 0, 0.0, *[float(x) for x in (rng.normal(size=12) + (12 if i < 8 else 0))], "enroute") for i in range(1500)]
    cols = "recording string, icao24 string, batch_seq int, pos int, ts double, " + ", ".join(f"{f} double" for f in model.FEATURES) + ", band string"
    f = spark.createDataFrame(rows, cols)
    scale = model.scaling(f)
    nodes = model.fit(f, scale, trees=60)
    s = model.score(f, scale, nodes).cache()
    top = {r.icao24 for r in s.orderBy(F.desc("score")).limit(8).collect()}
    assert top == {f"a{i}" for i in range(8)}
    lo, hi = s.agg(F.min("score"), F.max("score")).first()
    assert 0 < lo < hi <= 1
    flagged = model.flag(s, model.thresholds(s, 0.01)).filter("flag").count()
    assert 5 <= flagged <= 25
    assert model.table_hash(nodes).first()[0] == model.table_hash(nodes.orderBy("cut")).first()[0]


def test_registry_is_consistent():
    from airlens.plans import registry

    registry.load()
    assert set(registry.SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 150


@pytest.mark.parametrize("name", ["rule_low_integrity", "rule_watchlist", "encounter_pairs", "restricted_dwell", "launch_exposure", "airport_board", "rule_telemetry", "packet_summary", "conjunction_events", "caption_milestones", "log_chain_verification", "readsb_payloads", "audit_findings"])
def test_queries_match_their_sql(spark, sf, name):
    import duckdb

    import check as tool
    from airlens.plans import registry

    con = duckdb.connect()
    for t in tool.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    status, note, *_ = tool.compare(spark, con, sf, name, registry.QUERIES[name], registry.SQL[name])
    assert status == "ok", note


def test_unusable_elements(spark):
    rows = [(1, "ok", 15.0, 0.001, 51.6, 400.0), (2, "low", 16.9, 0.1, 51.6, -300.0), (3, "none", None, 0.1, 51.6, None)]
    r = elements.unusable(spark.createDataFrame(rows, "norad int, name string, n_rev_day double, e double, inc_deg double, perigee_km double")).collect()
    assert {(x.norad, x.reason) for x in r} == {(2, "below the surface"), (3, "missing numbers")}


def test_close_approaches_of_a_day(spark, sf):
    from airlens.plans import orbit_queries, registry

    tca = [r.tca for r in registry.QUERIES["rule_close_approach"](spark, sf).collect()]
    assert min(tca) < orbit_queries.START + 6 * 3600 < orbit_queries.START + 18 * 3600 < max(tca) <= orbit_queries.START + 24 * 3600


def test_xml_text(spark):
    """Entities, sections of plain text, comments, and text that is none of these."""
    cases = {"wind &amp; rain": "wind & rain", "<![CDATA[snow]]>": "snow", "a<![CDATA[<b> & &lt;]]>c": "a<b> & &lt;c", "&#233;t&#xE9; &lt;": "été <", "&amp;lt;": "&lt;", "R&D &amp; x": "R&D & x", "&#233; &nbsp; &amp;": "&#233; &nbsp; &", "x<!-- <Reason>y</Reason> -->": "x", "  ": None, "<![CDATA[open": "open"}
    for raw, want in cases.items():
        end = "" if raw.endswith("open") else "</Reason></Program>"
        rows = rd.airport_programmes_xml(one(spark, xml=f"<Program><ARPT>e</ARPT><Reason>{raw}{end}")).collect()
        assert [r.reason for r in rows] == ([want] if end else [])


def test_model_registry_refuses_altered_nodes(spark):
    """A stored model comes back as it was; with one cut moved, a node missing or no registration it does not score."""
    nodes = spark.createDataFrame([("all", 0, 0, 2, 0.5, 1, 2, 0.0), ("all", 0, 1, -1, 0.0, -1, -1, 1.0), ("all", 0, 2, -1, 0.0, -1, -1, 2.0)], model.NODE)
    scale = spark.createDataFrame([("all", 1)], "model_band string, rows int")
    folder = tempfile.mkdtemp(prefix="models-")
    registry = model.Registry(folder)
    registry.save("m", nodes, scale, lambda s, n: s.crossJoin(n.select("cut").limit(1)))
    back, _, limits = registry.load(spark, "m")
    assert sorted(back.collect()) == sorted(nodes.collect()) and limits.count() == 1
    for altered in (nodes.withColumn("cut", F.col("cut") + 1e-9), nodes.limit(2)):
        altered.coalesce(1).write.mode("overwrite").parquet(f"{folder}/m/nodes")
        with pytest.raises(ValueError, match="hash"):
            registry.load(spark, "m")
    spark.createDataFrame([], "name string, model_hash string").write.mode("overwrite").parquet(f"{folder}/m/registered")
    with pytest.raises(ValueError, match="no model"):
        registry.load(spark, "m")


def test_study_reads_stored_findings(spark, sf):
    """Both audits and the revisit times are stored before the study's last plan, which holds no cool-down of its own."""
    from airlens.plans import registry

    study = registry.QUERIES["detection_study"](spark, sf)
    assert "MapInArrow" not in study._jdf.queryExecution().optimizedPlan().toString()
    assert {r.kind for r in study.collect()} == {"scenario", "precision"}

def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lifetimes_by_single_steps_and_dealt_to_tasks(spark):
    """A file of missions is one partition; the integration gives what one mission alone does, rising ones included."""
    rows = spark.range(12_000).coalesce(1).selectExpr("id", "300.0D + (id % 12) * 60 as perigee_km", "320.0D + (id % 12) * 60 as apogee_km", "10.0D + id % 5 as mass_kg", "20.0D as area_m2", "if(id = 7, -2.2D, 2.2D) as cd")
    out = debris.lifetimes(rows)
    assert out.rdd.getNumPartitions() >= 3
    layers = sorted(debris.ATMOSPHERE)
    for r in out.filter("id in (0, 3, 7, 13, 20)").collect():
        a, t = debris.RE_KM + (r.perigee_km + r.apogee_km) / 2, 0.0
        while a - debris.RE_KM > 150 and t < 200 * 365.25 * 86400:
            h, rho, scale = [x for x in layers if x[0] <= a - debris.RE_KM][-1]
            step = -r.cd * r.area_m2 / r.mass_kg * (rho * math.exp(-(a - debris.RE_KM - h) / scale)) * math.sqrt(debris.MU / a) * 1000.0 * a * debris.STEP_S
            gone, a, t = a - debris.RE_KM > 1500 and step > -1e-6, a + step, t + debris.STEP_S
            if gone:
                t = math.inf
        assert math.isclose(r.lifetime_years, min(t / (365.25 * 86400), 200.0), rel_tol=1e-9), r


def test_messages_are_dealt_to_tasks_and_read_by_key(spark):
    from airlens.plans import space_queries

    d = tempfile.mkdtemp(prefix="customers-")
    spark.range(12_000).coalesce(1).withColumnRenamed("id", "c_custkey").write.parquet(f"{d}/customer.parquet")
    assert space_queries._messages(spark, d).rdd.getNumPartitions() >= 3
    text = "MESSAGE_ID = M1\nMESSAGE_ID = M2\nOBJECT = OBJECT1\nX = 1 [km]\nX = 2 [km]\nOBJECT = OBJECT2\nY = bad [km]"
    parsed = cj.parse_kvn(one(spark, file="f", text=text))
    r = parsed.first()
    assert (r.message_id, r.o1_x, r.o2_x, r.o2_y, r.tca) == ("M2", 2.0, None, None, None)
    assert "map_concat" not in plan_of(parsed)


def test_close_approaches_against_all_seconds(spark):
    """Crossing, slow and motionless pairs against positions of every second; the test of a pair is compiled."""
    orbit = lambda k, a, inc, raan, m: (k, 0.0, 86400 / (2 * math.pi) * math.sqrt(398600.4418 / a**3), a, 0.001, inc, raan, 0.0, (m + 356.0) % 360)
    rows = [orbit(1, 7000.0, 50.0, 20.0, 0.0), orbit(2, 7003.0, 80.0, 20.0, 0.02), orbit(3, 7000.0, 50.0, 20.0, 0.1), orbit(4, 7000.0, 50.0, 20.0, 0.0), orbit(5, 7001.0, 51.0, 20.5, 359.9), orbit(6, 7100.0, 50.0, 20.0, 0.0)]
    sets = spark.createDataFrame(rows, "norad long, epoch double, n_rev_day double, a_km double, e double, inc_deg double, raan_deg double, argp_deg double, m_deg double")
    assert "lambdafunction" not in plan_of(elements.close_positions(sets, 0.0, 5, 60.0, 100.0))
    got = {(r.a, r.b): (r.tca, r.min_km) for r in elements.screen(sets, 0.0, 5, 60.0, 20.0).collect()}
    at = {}
    for r in elements.ephemeris(sets, 0.0, 301, 1.0).collect():
        at.setdefault(r.norad, {})[r.ts] = (r.x_km, r.y_km, r.z_km)
    want = {}
    for a in range(1, 7):
        for b in range(a + 1, 7):
            coarse = min((math.dist(at[a][t], at[b][t]), t) for t in range(0, 300, 60))
            best = min((math.dist(at[a][t], at[b][t]), t) for t in range(max(0, coarse[1] - 60), coarse[1] + 61))
            if best[0] <= 20:
                want[a, b] = best[1], best[0]
    assert got.keys() == want.keys() and len(want) >= 5
    for k, (_, d) in want.items():
        assert math.isclose(got[k][1], d, abs_tol=1e-9) and math.isclose(math.dist(at[k[0]][got[k][0]], at[k[1]][got[k][0]]), d, abs_tol=1e-9)


def test_objects_counted_by_site(spark):
    """Counts by date and site joined with launches are those of the objects listed; null sites match any."""
    from airlens.operators import catalogue

    known = spark.createDataFrame([(k, f"d{k % 3}", [None, "A", "B"][k % 7 % 3]) for k in range(40)], "norad int, launch_date string, launch_site string")
    launches = spark.createDataFrame([("L1", "d0", "A"), ("L2", "d1", None), ("L3", "d2", "B"), ("L3", "d0", "C"), ("L4", None, "A")], "launch_id string, launch_date string, site string")
    listed = catalogue.objects_of_launch(launches, known).groupBy("launch_id").count().collect()
    counted = catalogue.objects_of_launch(launches, catalogue.by_site(known)).groupBy("launch_id").agg({"n": "sum"}).collect()
    assert sorted(map(tuple, listed)) == sorted(map(tuple, counted)) and len(listed) == 3


def test_near_positions_by_brute_force(spark):
    """Every pair within reach is met at its closest time, also across cells, and pairs that cannot come near are told apart."""
    orbit = lambda k: (k, 0.0, 15.0 + k % 3 * 0.01, 6900.0 + k * 7 % 31, 0.001, 50.0 + k % 5, float(k * 13 % 40), 0.0, float(k * 29 % 50))
    rows = [orbit(k) for k in range(1, 61)]
    rows.append((61, *rows[-1][1:-1], rows[-1][-1] + 0.05))  # six km behind the one before
    sets = spark.createDataFrame(rows, "norad long, epoch double, n_rev_day double, a_km double, e double, inc_deg double, raan_deg double, argp_deg double, m_deg double")
    at = {}
    for r in elements.ephemeris(sets, 0.0, 4, 60.0).collect():
        at.setdefault(r.ts, {})[r.norad] = (r.x_km, r.y_km, r.z_km)
    want = {}
    for t, p in at.items():
        for a in p:
            for b in p:
                if a < b and math.dist(p[a], p[b]) <= 300:
                    want[a, b] = min(want.get((a, b), (math.inf, 0)), (math.dist(p[a], p[b]), t))
    got, near = {}, 0
    for r in elements.close_positions(sets, 0.0, 4, 60.0, 300.0, 20.0).collect():
        got[r.a, r.b] = min(got.get((r.a, r.b), (math.inf, 0)), (r.d, r.ts))
        near += r.near
    assert got.keys() == want.keys() and len(want) > 15 and all(math.isclose(got[k][0], want[k][0], abs_tol=1e-6) for k in want)
    assert 0 < near < len(got)


def test_wide_corridor_by_brute_force(spark):
    """A corridor of 400 nm finds what all pairs do; samples of the track with no aircraft near are dropped before."""
    from airlens.functions.geo import wrapped_nm

    track = spark.range(600).selectExpr("id % 3 as norad", "cast(id div 3 as int) as t_idx", "cast(-60 + id % 120 as double) as lat", "cast(-170 + (id * 7) % 340 as double) as lon", "200.0D as height_km", "30.0D * (id div 3) as ts")
    states = spark.range(900).selectExpr("'r' as recording", "concat('a', id % 40) as icao24", "id / 3.0D * 20 as ts", "cast(-50 + (id * 11) % 100 as double) as lat", "cast(-160 + (id * 13) % 320 as double) as lon", "1000.0D as baro_alt_ft", "false as on_ground")
    got = elements.corridor_aircraft(track, states, 0.0, 30.0, 400.0)
    s = states.selectExpr("icao24", "cast(ceil(ts / 30 - 0.5) as int) as t_idx", "lat as s_lat", "lon as s_lon")
    want = s.join(track, "t_idx").withColumn("nm", wrapped_nm(F.col("s_lat"), F.col("s_lon"), F.col("lat"), F.col("lon"))).filter("nm <= 400").groupBy("norad", "icao24").agg(F.min("nm").alias("nm"))
    want = {(r.norad, r.icao24): round(r.nm, 6) for r in want.collect()}
    assert want and {(r.norad, r.icao24): round(r.min_nm, 6) for r in got.collect()} == want
    assert "LeftSemi" in plan_of(got)


def test_trend_reads_pairs_once(spark, sf):
    from airlens.plans import registry

    assert plan_of(registry.QUERIES["encounter_trend"](spark, sf)).count("Generate explode") == 3
