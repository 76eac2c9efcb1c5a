"""Telemetry plausibility and packet authentication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.operators.ordered import with_previous, with_running_max

c = F.col
# fixed values
MAX_ACCEL, MAX_GAP_S, MIN_DT_S, MAX_ALT_JUMP_KM, VS_TOLERANCE, MIN_SPEED_VS = 60.0, 10.0, 0.05, 5.0, 150.0, 100.0


def steps(points: DataFrame, order: list[str], slab: Column) -> DataFrame:
    """Points (stream, t_s, speed_mps, altitude_km) with the differences to the point that arrived before."""
    p = with_previous(points, ["stream"], slab, order, ["t_s", "speed_mps", "altitude_km"], "p").filter("p is not null")
    dt = c("t_s") - c("p.t_s")
    ok = dt >= MIN_DT_S
    return p.select("*", dt.alias("dt_s"), F.when(ok, (c("speed_mps") - c("p.speed_mps")) / dt).alias("accel"),
                    F.when(ok, (c("altitude_km") - c("p.altitude_km")) * 1000.0 / dt).alias("vs"), F.when(ok, c("altitude_km") - c("p.altitude_km")).alias("dalt_km"))


def findings(stepped: DataFrame) -> DataFrame:
    """Every rule a step breaks; a step back in time is only that."""
    forward = c("dt_s") > 0

    def hit(cond: Column, rule: str, sev: str, measure: Column) -> Column:
        return F.when(cond, F.struct(F.lit(rule).alias("rule_id"), F.lit(sev).alias("severity"), measure.alias("measure")))

    hits = F.array_compact(F.array(
        hit(~forward, "SPC-004", "high", c("dt_s")), hit(forward & (c("dt_s") > MAX_GAP_S), "SPC-003", "medium", c("dt_s")),
        hit(forward & (F.abs("accel") > MAX_ACCEL), "SPC-001", "high", c("accel")),
        hit(forward & (c("speed_mps") >= MIN_SPEED_VS) & (F.abs("vs") > c("speed_mps") + VS_TOLERANCE), "SPC-002", "high", c("vs")),
        hit(forward & (F.abs("dalt_km") > MAX_ALT_JUMP_KM), "SPC-005", "medium", c("dalt_km"))))
    return stepped.withColumn("_h", F.explode(hits)).select("stream", "t_s", "_h.*")


def summary(points: DataFrame, found: DataFrame) -> DataFrame:
    s = points.groupBy("stream").agg(F.count(F.lit(1)).alias("samples"), F.max("speed_mps").alias("max_speed_mps"), F.max("altitude_km").alias("max_altitude_km"))
    rules = ["SPC-001", "SPC-002", "SPC-003", "SPC-004", "SPC-005"]
    n = found.groupBy("stream").agg(F.count(F.lit(1)).alias("findings"), *[F.count_if(c("rule_id") == r).alias(r.replace("-", "_").lower()) for r in rules])
    return s.join(n, "stream", "left").fillna(0)


def canonical(spi: Column, seq: Column, t_s: Column, speed: Column, alt: Column) -> Column:
    """The text a packet's code covers."""
    return F.format_string("%d|%d|%.6f|%.6f|%.6f", spi.cast("long"), seq.cast("long"), t_s, speed, alt)


def key_pads(key: bytes) -> tuple[str, str]:
    """Inner and outer pads of a key as hex, computed once per key on the driver."""
    import hashlib

    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in k).hex(), bytes(b ^ 0x5C for b in k).hex()


def hmac_sha256(text: Column, ipad_hex: Column, opad_hex: Column) -> Column:
    inner = F.sha2(F.concat(F.unhex(ipad_hex), F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(opad_hex), F.unhex(inner)), 256)


def authenticate(packets: DataFrame, keys: DataFrame, order: list[str], slab: Column) -> DataFrame:
    """Packets (stream, spi, seq, t_s, speed_mps, altitude_km, mac) -> status and replay flag.

    `keys` has spi, ipad, opad: one row per security association. A verified packet replays when its sequence is not
    above every verified one before it; replayed packets never raise that maximum.
    """
    p = packets.join(keys, "spi", "left")
    expected = hmac_sha256(canonical(c("spi"), c("seq"), c("t_s"), c("speed_mps"), c("altitude_km")), c("ipad"), c("opad"))
    status = (
        F.when(F.coalesce("mac", F.lit("")) == "", "unauthenticated").when(c("ipad").isNull(), "no-key").when(F.lower("mac") == expected, "verified").otherwise("failed")
    )
    p = p.withColumn("status", status).drop("ipad", "opad")
    p = with_running_max(p, ["stream", "spi"], slab, order, F.when(c("status") == "verified", c("seq")), "_before")
    return p.withColumn("replay", F.coalesce((c("status") == "verified") & (c("seq") <= c("_before")), F.lit(False))).drop("_before")


def auth_findings(rows: DataFrame) -> DataFrame:
    """Every failed and every replayed packet, and one note a stream on what came unauthenticated."""
    out = []
    for rule, sev, cond in (("SPC-006", "high", c("status") == "failed"), ("SPC-008", "medium", c("replay"))):
        out.append(rows.filter(cond).select("stream", F.lit(rule).alias("rule_id"), F.lit(sev).alias("severity"), c("seq").cast("long").alias("measure")))
    note = rows.filter(c("status").isin("unauthenticated", "no-key")).groupBy("stream").agg(F.count(F.lit(1)).alias("measure"))
    out.append(note.select("stream", F.lit("SPC-007").alias("rule_id"), F.lit("low").alias("severity"), "measure"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def auth_summary(rows: DataFrame) -> DataFrame:
    names = ["verified", "failed", "unauthenticated", "no-key"]
    s = rows.groupBy("stream").agg(F.count(F.lit(1)).alias("packets"), *[F.count_if(c("status") == n).alias(n.replace("-", "_")) for n in names], F.count_if("replay").alias("replays"))
    return s.withColumn("trusted_share", F.round(F.try_divide("verified", "packets"), 4))
