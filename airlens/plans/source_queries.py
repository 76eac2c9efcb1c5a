"""Provider payloads written as JSON text from the event table and parsed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.plans.registry import query
from airlens.sources import readers as rd

c = F.col
_K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"


@query("readsb_payloads", f"""WITH e AS (SELECT *, {_K} AS k FROM events) SELECT lpad(lower(to_hex(10485760 + event_id)), 6, '0') AS icao24, 1.7e9 + event_id - k / 10.0 AS ts, CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k * 400 AS DOUBLE) END AS baro_alt_ft, k % 7 = 0 AS on_ground,
  CASE WHEN k % 5 = 0 THEN 64.0 ELSE CAST(k * 10 AS DOUBLE) END AS vrate_fpm, CASE k % 4 WHEN 0 THEN 'adsb' WHEN 1 THEN 'mlat' WHEN 2 THEN 'tisb_other' END AS position_source, round(value, 2) AS gs_kt FROM e""")
def readsb_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-02."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("k", F.expr(_K))
    ac = F.struct(F.lpad(F.lower(F.hex(10485760 + c("event_id"))), 6, "0").alias("hex"), F.when(c("k") % 7 == 0, "ground").otherwise((c("k") * 400).cast("string")).alias("alt_baro"), c("value").alias("gs"),
                  F.when(c("k") % 5 == 0, 0).otherwise(c("k") * 10).alias("baro_rate"), F.lit(64).alias("geom_rate"), (c("k") / 10).alias("seen_pos"), F.when(c("k") % 4 == 0, "adsb_icao").when(c("k") % 4 == 1, "mlat").when(c("k") % 4 == 2, "tisb_other").alias("type"))
    p = e.select(F.to_json(F.struct((1.7e9 + c("event_id")).alias("now"), F.array(ac).alias("ac"))).alias("json"))
    return rd.readsb(p).select("icao24", F.round("ts", 3).alias("ts"), "baro_alt_ft", "on_ground", "vrate_fpm", "position_source", F.round("gs_kt", 2).alias("gs_kt"))


@query("array_payloads", f"""WITH e AS (SELECT *, {_K} AS k FROM events) SELECT lpad(lower(to_hex(10485760 + event_id)), 6, '0') AS icao24, 1.7e9 + event_id AS ts, round(k * 100 * 3.28084, 3) AS baro_alt_ft, round(value * 1.943844, 3) AS gs_kt, round((k - 50) * 196.8504, 3) AS vrate_fpm, k % 7 = 0 AS on_ground,
  CASE k % 5 WHEN 0 THEN 'adsb' WHEN 1 THEN 'asterix' WHEN 2 THEN 'mlat' WHEN 3 THEN 'flarm' END AS position_source FROM e""")
def array_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-03."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("k", F.expr(_K))
    s = lambda x: F.coalesce(F.concat(F.lit('"'), x.cast("string"), F.lit('"')), F.lit("null"))
    n = F.lit("null")
    vals = [s(F.lpad(F.lower(F.hex(10485760 + c("event_id"))), 6, "0")), s(F.lit("TEST1 ")), n, F.format_string("%d", 1700000000 + c("event_id")), n, F.lit("-97.1"), F.lit("32.9"), (c("k") * 100).cast("string"), (c("k") % 7 == 0).cast("string"), c("value").cast("string"), F.lit("90.0"),
            (c("k") - 50).cast("string"), n, n, s(F.lit("1200")), n, (c("k") % 5).cast("string")]
    p = e.select(F.concat(F.lit('{"time": 1700000000, "states": [['), F.concat_ws(", ", *vals), F.lit("]]}")).alias("json"))
    return rd.array_rows(p).select("icao24", "ts", F.round("baro_alt_ft", 3).alias("baro_alt_ft"), F.round("gs_kt", 3).alias("gs_kt"), F.round("vrate_fpm", 3).alias("vrate_fpm"), "on_ground", "position_source")


@query("station_weather", """WITH r AS (SELECT s_suppkey AS k FROM supplier)
  SELECT 'K' || k AS station, 'K' || k || ': ' || CASE WHEN k % 5 = 0 THEN 'None' ELSE CAST(k % 40 AS VARCHAR) END || 'C wind ' || CASE WHEN k % 4 = 0 THEN '?' ELSE CAST(k % 36 * 10 AS VARCHAR) END || '/' || k % 30 || 'kt' || CASE WHEN k % 3 = 0 AND k % 60 <> 0 THEN 'G' || k % 60 ELSE '' END
   || ' vis 10+sm cover ' || CASE WHEN k % 2 = 0 THEN 'OVC' ELSE 'None' END || ' QNH ' || (1000 + k % 30) || ' | ' || CASE WHEN k % 7 = 0 THEN '' ELSE 'METAR K' || k END AS line FROM r""")
def station_weather(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-22: station reports as JSON, several in a payload, each as one line."""
    k = c("s_suppkey")
    report = F.struct(F.concat(F.lit("K"), k.cast("string")).alias("icaoId"), F.when(k % 5 != 0, k % 40).alias("temp"), F.when(k % 4 != 0, k % 36 * 10).alias("wdir"), (k % 30).alias("wspd"), F.when(k % 3 == 0, k % 60).alias("wgst"),
                      F.lit("10+").alias("visib"), F.when(k % 2 == 0, "OVC").alias("cover"), (1000 + k % 30).alias("altim"), F.when(k % 7 != 0, F.concat(F.lit("METAR K"), k.cast("string"))).alias("rawOb"))
    p = spark.read.parquet(f"{sf}/supplier.parquet").groupBy((k - k % 10).alias("g")).agg(F.to_json(F.collect_list(report)).alias("json"))
    return rd.weather_reports(p)


@query("iso_times", "SELECT o_orderkey, epoch(o_orderdate) + o_orderkey % 86400 AS ts FROM orders")
def iso_times(spark: SparkSession, sf: str) -> DataFrame:
    """SCL-21: five spellings of one time."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    t = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + c("o_orderkey") % 86400)
    k = c("o_orderkey") % 4
    text = (F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.concat(F.date_format(t, "yyyyMMdd'T'HHmmss"), F.lit("Z"))).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'.000Z'")))
    return o.select("o_orderkey", rd.iso_seconds(text).alias("ts"))


@query("contract_problems", """WITH x AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'missing' END AS a, CASE WHEN value > 200 THEN 'above maximum' END AS b, CASE WHEN event_type = 'signup' THEN 'not in enum' END AS c, CASE WHEN event_id % 10 = 3 THEN 'wrong type' END AS d FROM events)
  SELECT event_id, '$.id' AS path, a AS problem FROM x WHERE a IS NOT NULL UNION ALL SELECT event_id, '$.speed', b FROM x WHERE b IS NOT NULL AND d IS NULL UNION ALL SELECT event_id, '$.kind', c FROM x WHERE c IS NOT NULL UNION ALL SELECT event_id, '$.speed', d FROM x WHERE d IS NOT NULL""")
def contract_problems(spark: SparkSession, sf: str) -> DataFrame:
    """SCL-24: messages against a contract, one row per problem."""
    from airlens.operators.contracts import check

    e = spark.read.parquet(f"{sf}/events.parquet")
    msg = F.to_json(F.struct(F.when(c("event_id") % 6 != 0, F.concat(F.lit("m"), c("event_id").cast("string"))).alias("id"), c("event_type").alias("kind"), F.when(c("event_id") % 10 != 3, c("value")).alias("speed"), F.when(c("event_id") % 10 == 3, "fast").alias("speed_text")))
    msg = F.regexp_replace(msg, '"speed_text"', '"speed"')
    contract = {"type": "object", "required": ["id", "kind", "speed"], "properties": {"id": {"type": "string", "pattern": "^m[0-9]+$"}, "kind": {"type": "string", "enum": ["view", "purchase", "error", "click"]}, "speed": {"type": "number", "minimum": 0, "maximum": 200}}}
    return check(e.select("event_id", msg.alias("json")), "json", contract).select("event_id", "path", "problem")


_NESTED = {
    "type": "object", "required": ["id"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string", "maxLength": 3}, "minItems": 1, "maxItems": 2}, "who": {"oneOf": [{"type": "string"}, {"type": "object", "required": ["name"]}]},
        "speed": {"allOf": [{"type": "number"}, {"maximum": 300}]}, "note": {"type": ["string", "null"]}, "ext": {"type": "object", "additionalProperties": {"type": "number"}},
    },
}


@query("contract_problems_nested", """WITH e AS (SELECT event_id AS k, value FROM events) SELECT k AS event_id, '$.tags' AS path, CASE WHEN k % 4 = 0 THEN 'too few items' ELSE 'too many items' END AS problem FROM e WHERE k % 4 IN (0, 3) UNION ALL SELECT k, '$.tags[0]', 'too long' FROM e WHERE k % 3 = 0 AND k % 4 > 0
  UNION ALL SELECT k, '$.zz', 'unexpected property' FROM e WHERE k % 7 = 0 UNION ALL SELECT k, '$.who', 'matches 0 of oneOf' FROM e WHERE k % 5 IN (0, 2) UNION ALL SELECT k, '$.speed', 'above maximum' FROM e WHERE value > 300 UNION ALL SELECT k, '$.note', 'wrong type' FROM e WHERE k % 6 = 1
  UNION ALL SELECT k, '$.ext.b', 'wrong type' FROM e WHERE k % 8 = 5 UNION ALL SELECT k, '$.id', 'missing' FROM e WHERE k % 11 = 0""")
def contract_problems_nested(spark: SparkSession, sf: str) -> DataFrame:
    """SCL-24: arrays, composition, null, and properties that are unexpected or of any name."""
    from airlens.operators.contracts import check

    e, k = spark.read.parquet(f"{sf}/events.parquet"), c("event_id")
    tags = F.array_join(F.transform(F.sequence(F.lit(1), (k % 4).cast("int")), lambda i: F.when((i == 1) & (k % 3 == 0), '"longer"').otherwise('"abc"')), ",")
    parts = [F.when(k % 11 != 0, F.concat(F.lit('"id":'), k.cast("string"))), F.concat(F.lit('"tags":['), F.when(k % 4 > 0, tags).otherwise(""), F.lit("]")), F.concat(F.lit('"who":'), F.when(k % 5 == 0, "3").when(k % 5 == 1, '"me"').when(k % 5 == 2, "{}").otherwise('{"name":1}')),
             F.concat(F.lit('"speed":'), c("value").cast("string")), F.concat(F.lit('"note":'), F.when(k % 6 == 1, "5").when(k % 6 == 2, "null").otherwise('"x"')), F.concat(F.lit('"ext":{"a":1,"b":'), F.when(k % 8 == 5, '"x"').otherwise("2.5"), F.lit("}")), F.when(k % 7 == 0, '"zz":1')]
    return check(e.select("event_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json")), "json", _NESTED).select("event_id", "path", "problem")
