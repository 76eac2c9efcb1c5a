"""Restricted volumes, launches, watchlist entries and tasks derived from `supplier` and `customer`, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VOL = [
    "concat('R', cast(s_suppkey as varchar(12))) as notam_id",
    "case when s_suppkey % 3 = 0 then 'SPACE OPERATIONS' else 'HAZARDS' end as type",
    "32.0e0 + (s_suppkey % 13) * 0.12e0 as clat", "-97.9e0 + (s_suppkey % 17) * 0.12e0 as clon",
    "s_suppkey % 2 = 0 as round_shape", "6.0e0 + (s_suppkey % 5) * 3 as radius_nm", "0.15e0 as half",
    "cast(case when s_suppkey % 4 = 1 then null else (s_suppkey % 3) * 1000 end as double) as lower_ft",
    "cast(case when s_suppkey % 3 = 0 then null else 5000 + (s_suppkey % 5) * 4000 end as double) as upper_ft",
    "case when s_suppkey % 7 = 0 then null else 1.7e9 + (s_suppkey % 4) * 7200 + 100 end as effective_ts",
    "case when s_suppkey % 11 = 0 then null else 1.7e9 + (s_suppkey % 4) * 7200 + 1000 end as expire_ts",
]
_LCH = [
    "concat('L', cast(s_suppkey as varchar(12))) as launch_id", "s_name as name",
    "case s_suppkey % 4 when 0 then 'Go' when 1 then 'Hold' when 2 then 'TBD' else 'Success' end as status",
    "concat('Pad ', cast(s_suppkey % 9 as varchar(2))) as pad",
    "case when s_suppkey % 3 = 0 then 'Cape Canaveral, FL, USA' else 'Kourou, French Guiana' end as location",
    "case when s_suppkey % 9 = 4 then null else 32.0e0 + (s_suppkey % 11) * 0.3e0 end as pad_lat", "-98.5e0 + (s_suppkey % 8) * 0.5e0 as pad_lon",
    "case when s_suppkey % 10 = 9 then null else 1.7e9 + (s_suppkey % 5) * 7200 + 200 end as window_start",
    "case when s_suppkey % 6 = 0 then null else 1.7e9 + (s_suppkey % 5) * 7200 + 500 end as window_end",
    "1.7e9 + (s_suppkey % 5) * 7200 + 300 as net", "1.7e9 + (s_suppkey % 5) * 7200 - (s_suppkey % 3) * 50000 as last_updated",
]
_WATCH = [
    "concat('W', cast(s_suppkey as varchar(12))) as entry_id",
    "case when s_suppkey % 3 = 0 then {hex} else null end as icao24",
    "case when s_suppkey % 3 = 1 then case when s_suppkey > 12 then concat('ZZT', cast(s_suppkey as varchar(8))) when s_suppkey = 1 then 'ual' when s_suppkey = 4 then 'FDX1' when s_suppkey = 7 then 'RCH' else 'ZZT11' end else null end as callsign_prefix",
    "case when s_suppkey % 3 = 2 then concat('n', cast(100 + s_suppkey as varchar(8)), 'ab') else null end as registration",
    "case s_suppkey % 2 when 0 then 'high' else 'critical' end as severity", "case s_suppkey % 5 when 0 then 'protect' else 'detect' end as mode", "cast(s_suppkey as int) as ord",
]
_VALID = [
    "case when s_suppkey % 4 = 0 then null else 1.7e9 + (s_suppkey % 3) * 7200 + 150 end as valid_from",
    "case when s_suppkey % 5 = 0 then 1.7e9 + (s_suppkey % 3) * 7200 + 900 else null end as valid_to",
]
NOW = 1.7e9 + 7200 + 400
PREFIX_LENGTHS = [3, 4, 5, 6, 7, 8]


def _supplier(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/supplier.parquet")


def volumes(spark: SparkSession, sf: str) -> DataFrame:
    v = _supplier(spark, sf).selectExpr(*_VOL)
    a, o, h = F.col("clat"), F.col("clon"), F.col("half")
    corners = [(a - h, o - h), (a - h, o + h), (a, o + h), (a, o), (a + h, o), (a + h, o - h)]
    poly = F.array(*[F.array(y, x) for y, x in corners])
    circle = F.struct(a.alias("lat"), o.alias("lon"), F.col("radius_nm"))
    return v.select("notam_id", "type", "lower_ft", "upper_ft", "effective_ts", "expire_ts", F.when(~F.col("round_shape"), poly).alias("polygon"),
                    F.when(F.col("round_shape"), circle).alias("circle"), a.alias("centroid_lat"), o.alias("centroid_lon"))


def launches(spark: SparkSession, sf: str) -> DataFrame:
    return _supplier(spark, sf).selectExpr(*_LCH)


def watch_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _supplier(spark, sf).selectExpr(*[x.replace("{hex}", "lpad(lower(hex(10485760 + s_suppkey * 37)), 6, '0')") for x in _WATCH])


def watch_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Watchlist entries that hold from and up to a time."""
    return _supplier(spark, sf).selectExpr(*[x.replace("{hex}", "lpad(lower(hex(10485760 + s_suppkey * 37)), 6, '0')") for x in [*_WATCH, *_VALID]])


def volume_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Restricted volumes that were published and withdrawn at a time."""
    spans = _supplier(spark, sf).selectExpr("concat('R', cast(s_suppkey as varchar(12))) as notam_id", *_VALID)
    return volumes(spark, sf).join(spans, "notam_id")


VALID_CTE = "valid AS (SELECT concat('W', cast(s_suppkey as varchar(12))) AS entry_id, concat('R', cast(s_suppkey as varchar(12))) AS notam_id, " + ", ".join(_VALID) + " FROM supplier)"
VOL_CTE = ("vol AS (SELECT *, [[clat - half, clon - half], [clat - half, clon + half], [clat, clon + half], [clat, clon], [clat + half, clon], [clat + half, clon - half]] AS poly FROM (SELECT "
           + ", ".join(_VOL) + " FROM supplier) AS q)")
LCH_CTE = "lch AS (SELECT * FROM (SELECT *, coalesce(window_start, net) AS w0, coalesce(window_end, net) + 1 AS w1 FROM (SELECT " + ", ".join(_LCH) + " FROM supplier) AS q) AS r WHERE pad_lat IS NOT NULL)"
WATCH_CTE = "watch AS (SELECT " + ", ".join(x.replace("{hex}", "lpad(lower(to_hex(10485760 + s_suppkey * 37)), 6, '0')") for x in _WATCH) + " FROM supplier)"


def inside_sql(lat: str, lon: str) -> str:
    """Even-odd rule or circle, for a row of `vol` named v."""
    y1, x1, y2, x2 = "v.poly[i][1]", "v.poly[i][2]", "v.poly[i % 6 + 1][1]", "v.poly[i % 6 + 1][2]"
    cross = f"len(list_filter(range(1, 7), lambda i: ({y1} > {lat}) <> ({y2} > {lat}) AND {lon} < {x1} + ({lat} - {y1}) * ({x2} - {x1}) / ({y2} - {y1}))) % 2 = 1"
    circle = f"sqrt(pow((v.clat - {lat}) * 60, 2) + pow((v.clon - {lon}) * 60 * cos(radians(({lat} + v.clat) / 2)), 2)) <= v.radius_nm"
    return f"(CASE WHEN v.round_shape THEN {circle} ELSE {cross} END)"


ACTIVE = "((v.effective_ts IS NULL OR {ts} >= v.effective_ts) AND (v.expire_ts IS NULL OR {ts} <= v.expire_ts))"
