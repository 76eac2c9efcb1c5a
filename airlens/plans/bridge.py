"""Traffic derived from the driver tables: one row of `events` is one position report.

One formula sheet serves both engines; only integer division and hex formatting differ. It is a projection
(no shuffle): a recording is 2,500 consecutive events, a poll is 50 of them, an address is user_id modulo 75,
so the number of recordings, and with it the work, grows with the table while groups inside a recording stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T0 = "1.7e9"


class _Spark:
    @staticmethod
    def idiv(a: str, b: str) -> str:
        return f"({a} div {b})"

    @staticmethod
    def hex6(x: str) -> str:
        return f"lpad(lower(hex({x})), 6, '0')"

    @staticmethod
    def pad(x: str, n: int) -> str:
        return f"lpad(cast({x} as string), {n}, '0')"


class _Duck:
    @staticmethod
    def idiv(a: str, b: str) -> str:
        return f"({a} // {b})"

    @staticmethod
    def hex6(x: str) -> str:
        return f"lpad(lower(to_hex({x})), 6, '0')"

    @staticmethod
    def pad(x: str, n: int) -> str:
        return f"lpad(cast({x} as varchar), {n}, '0')"


def _layers(d) -> list[list[str]]:
    """Select lists applied one after the other; each keeps what the next one needs."""
    l1 = [
        "event_id", "user_id", "event_type", "value",
        "cast(regexp_extract(props, '([0-9]+)', 1) as int) as k",
        f"{d.idiv('event_id', '2500')} as rec_no",
        f"{d.idiv('(event_id % 2500)', '50')} as b_raw",
        "event_id % 50 as p_raw",
        "cast(user_id % 75 as int) as a",
    ]
    l2 = [
        "event_id", "event_type", "value", "k", "rec_no", "a",
        "cast(case when b_raw = 40 and p_raw >= 15 then 41 else b_raw end as int) as batch_seq",
        "cast(case when b_raw = 41 then p_raw + 50 else p_raw end as int) as pos",
        "140.0e0 + (a % 9) * 45 as v",
        "cast((a * 47) % 360 as double) as h0",
        f"1500.0e0 + (a % 6) * (a % 6) * 1400 + (a % 7) * 100 as alt0",
        "32.0e0 + (a % 5) * 0.25e0 as lat0",
        f"-97.6e0 + ({d.idiv('a', '5')} % 5) * 0.3e0 as lon0",
    ]
    l3 = [
        "event_id", "event_type", "value", "k", "rec_no", "a", "batch_seq", "pos", "v", "h0", "alt0", "lat0", "lon0",
        f"{T0} + rec_no * 7200 + batch_seq * 12 + case when batch_seq >= 25 then 700 else 0 end as batch_ts",
        f"case when batch_seq = 0 then null else {T0} + rec_no * 7200 + (batch_seq - 1) * 12 + case when batch_seq - 1 >= 25 then 700 else 0 end end as prev_batch_ts",
        "cast((a % 4) + case when k = 77 then 95 else 0 end as double) as age",
    ]
    l4 = [
        "event_id", "event_type", "value", "k", "rec_no", "a", "batch_seq", "pos", "v", "h0", "alt0", "lat0", "lon0", "batch_ts", "prev_batch_ts",
        "batch_ts - age as ts",
        f"batch_ts - age - {T0} - rec_no * 7200 as t",
        "case when a % 11 = 0 then (h0 + 3 * (batch_ts - age - " + T0 + " - rec_no * 7200) + 36000) % 360 else h0 end as hdg",
    ]
    circ_r = "(v / 3600 / radians(3.0e0))"
    jump = "case when event_type = 'error' and value > 180 then 0.6e0 else 0.0e0 end"
    l5 = [
        "event_id", "rec_no", "a", "k", "value",
        f"concat('rec', {d.pad('rec_no', 8)}) as recording",
        "batch_seq", "pos", "batch_ts", "prev_batch_ts",
        "case when batch_seq % 2 = 0 then 'dfw' else 'iah' end as region",
        "'primary' as provider",
        f"case when batch_seq = 36 then {d.hex6('11534336 + a')} else {d.hex6('10485760 + a * 37')} end as icao24",
        "case when a % 10 = 3 then null when a % 10 = 4 then '  ' else concat(case a % 8 when 0 then 'AAL' when 1 then 'DAL' when 2 then 'UAL'"
        " when 3 then 'SKW' when 4 then 'FDX' when 5 then 'RCH' when 6 then 'N' else 'ZZT' end, cast(100 + a as varchar(8)), ' ') end as callsign",
        "case a % 3 when 0 then concat('N', cast(100 + a as varchar(8)), 'AB') when 1 then concat('C-F', cast(100 + a as varchar(8))) else null end as registration",
        "case a % 9 when 0 then 'B738' when 1 then 'A320' when 2 then 'B77W' when 3 then 'E75L' when 4 then 'C172' when 5 then 'H60' when 6 then 'b739'"
        " when 7 then 'ZZZZ' else null end as aircraft_type",
        "ts",
        f"case when k = 62 then null when a % 11 = 0 then round(lat0 + {circ_r} * sin(radians(hdg)) / 60 + {jump}, 5)"
        f" else round(lat0 + v * t / 3600 / 60 * cos(radians(hdg)) + {jump}, 5) end as lat",
        f"case when k = 62 then null when a % 11 = 0 then round(lon0 - {circ_r} * cos(radians(hdg)) / (60 * cos(radians(lat0))), 5)"
        " else round(lon0 + v * t / 3600 / 60 * sin(radians(hdg)) / cos(radians(lat0)), 5) end as lon",
        "case when k = 61 or (k in (20, 21) and a % 6 = 0) then null else alt0 + case when event_type = 'signup' and value > 200 then 6000 else 0 end end as baro_alt_ft",
        "case when k = 61 then null else alt0 + 50 end as geo_alt_ft",
        "case when k = 63 then null else v + (k % 5) - 2 + case when event_type = 'view' and value > 200 then 260 else 0 end end as gs_kt",
        "case when k = 64 then null else round(hdg, 1) end as track_deg",
        "cast(case when k = 13 then 7200 when k < 8 then -900 when k > 91 then 900 when k = 50 then null else 0 end as double) as vrate_fpm",
        f"case when k = 60 then null when a = 7 and batch_seq >= 20 then '7700' when a = 19 and batch_seq >= 30 then '7600' when k = 99 then '7500'"
        f" when a % 25 = 12 or a % 15 = 5 then '1200' else cast(2000 + a as varchar(8)) end as squawk",
        "k in (20, 21) and a % 6 = 0 as on_ground",
        "case k when 33 then 'lifeguard' when 34 then 'none' else null end as emergency",
        "case a % 9 when 5 then alt0 - 700 when 6 then alt0 + 2500 else case when k % 2 = 0 then alt0 else null end end as selected_alt_ft",
        "cast(case when a % 13 = 4 then 4 when k = 70 then null else 8 + a % 3 end as int) as nic",
        "cast(case when a % 13 = 4 then 5 when a % 13 = 5 then 7 when k = 70 then null else 9 end as int) as nac_p",
        "cast(case when a % 13 = 4 then 0 when a % 13 = 6 then 2 when k = 70 then null else 3 end as int) as sil",
        "case when k = 80 then null when a % 12 = 8 then 'mlat' when a % 12 = 9 then 'tisb_other' when a % 12 = 10 then 'asterix' else 'adsb' end as position_source",
        "'primary' as source",
    ]
    return [l1, l2, l3, l4, l5]


STATE_NAMES = [
    "recording", "batch_seq", "pos", "batch_ts", "prev_batch_ts", "region", "provider", "icao24", "callsign", "registration", "aircraft_type",
    "ts", "lat", "lon", "baro_alt_ft", "geo_alt_ft", "gs_kt", "track_deg", "vrate_fpm", "squawk", "on_ground", "emergency", "selected_alt_ft",
    "nic", "nac_p", "sil", "position_source", "source",
]

# second feed: the same reports three seconds earlier, one aircraft in 17 displaced, one in 23 under another address
_SECOND = {
    "ts": "ts - 3",
    "lat": "case when a % 17 = 0 then lat + 0.2e0 else lat end",
    "icao24": "case when a % 23 = 5 then concat('c', substr(icao24, 2, 5)) else icao24 end",
    "source": "'secondary'",
    "provider": "'secondary'",
}


def _derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "props")
    for layer in _layers(_Spark):
        df = df.selectExpr(*layer)
    return df


def _sealed(df: DataFrame, columns: list) -> DataFrame:
    """Filters on derived columns must not be pushed below the formulas: each reference would repeat the whole formula."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary feed."""
    return _sealed(_derive(spark, sf_dir), STATE_NAMES)


def second_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sealed(_derive(spark, sf_dir), [F.expr(_SECOND[c]).alias(c) if c in _SECOND else F.col(c) for c in STATE_NAMES])


def _nest(final: list[str]) -> str:
    sql = "events"
    for i, layer in enumerate([*_layers(_Duck), final]):
        sql = f"(SELECT {', '.join(layer)} FROM {sql} AS l{i})"
    return sql


def states_cte() -> str:
    """`st AS (...)` for the SQL checks."""
    return f"st AS (SELECT * FROM {_nest(STATE_NAMES)} AS s)"


def second_cte() -> str:
    return "st2 AS (SELECT * FROM " + _nest([f"{_SECOND[c]} AS {c}" if c in _SECOND else c for c in STATE_NAMES]) + " AS s)"
