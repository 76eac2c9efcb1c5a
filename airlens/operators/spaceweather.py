"""Space-weather scales, advisories, cross-check of two sources, exposed flights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
HIGH_LAT_DEG = 60.0
STALE_S = 3 * 3600.0
AGREEMENT_WINDOW_S = 48 * 3600.0
# fixed values: scale -> (moderate, severe, rule)
LEVELS = {"G": (4, 5, "SWX-001"), "R": (3, 4, "SWX-002"), "S": (3, 4, "SWX-003")}
# fixed values: notice type -> scale that it speaks of
NOTICES = {"GST": "G", "CME": "G", "FLR": "R", "SEP": "S", "RBE": "S"}


def advisory(scale: Column, level: Column) -> Column:
    out = None
    for s, (moderate, severe, _) in LEVELS.items():
        e = F.when(level >= severe, "severe").when(level >= moderate, "moderate")
        out = F.when(scale == s, e) if out is None else out.when(scale == s, e)
    return out


def findings(products: DataFrame, now: Column) -> DataFrame:
    """Products (product_id, r, s, g, fetched_ts) -> advisory findings per scale and a staleness note."""
    scales = [F.struct(F.lit(s).alias("scale"), c(s.lower()).alias("level"), F.lit(LEVELS[s][2]).alias("rule_id")) for s in LEVELS]
    rows = products.select("product_id", F.explode(F.array(*scales)).alias("x")).select("product_id", "x.*").withColumn("advisory", advisory(c("scale"), c("level"))).filter("advisory is not null")
    adv = rows.select("product_id", "rule_id", F.when(c("advisory") == "severe", "high").otherwise("medium").alias("severity"), c("level").cast("double").alias("measure"))
    age = now - c("fetched_ts")
    stale = products.filter(age > STALE_S).select("product_id", F.lit("SWX-004").alias("rule_id"), F.lit("low").alias("severity"), F.round(age, 0).alias("measure"))
    return adv.unionByName(stale)


def agreement(products: DataFrame, notices: DataFrame, now: Column, window_s: float = AGREEMENT_WINDOW_S) -> DataFrame:
    """Per product and scale: the advisory condition, and the notices of that physics no older than the window."""
    kinds = F.create_map(*[F.lit(x) for kv in NOTICES.items() for x in kv])
    recent = notices.withColumn("scale", F.try_element_at(kinds, c("type"))).filter(c("scale").isNotNull() & (now - c("issued_ts") <= window_s))
    per_scale = recent.groupBy("scale").agg(F.count(F.lit(1)).alias("notices"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.max("issued_ts").alias("latest_ts"))
    scales = [F.struct(F.lit(s).alias("scale"), advisory(F.lit(s), c(s.lower())).alias("condition")) for s in LEVELS]
    p = products.select("product_id", F.inline(F.array(*scales))).join(per_scale, "scale", "left").withColumn("notices", F.coalesce("notices", F.lit(0)))
    seen, told = c("condition").isNotNull(), c("notices") > 0
    state = F.when(seen & told, "both").when(seen, "swpc-only").when(told, "donki-only").otherwise("quiet")
    return p.select("product_id", "scale", "condition", "notices", F.coalesce("types", F.lit("")).alias("types"), "latest_ts", state.alias("agreement"))


def exposed_flights(states: DataFrame, lat_min: float = HIGH_LAT_DEG) -> DataFrame:
    s = states.filter("not on_ground").filter(F.abs("lat") >= lat_min)
    return s.groupBy("recording", "icao24").agg(F.max(F.abs("lat")).alias("max_abs_lat"), F.max(F.coalesce("baro_alt_ft", F.lit(0.0))).alias("max_alt_ft"), F.count(F.lit(1)).alias("samples"))


def conditions(products: DataFrame) -> DataFrame:
    """Products with the scales G and S whose advisory condition concerns flights, as `G`, `S`, `G/S` or empty."""
    return products.withColumn("conditions", F.concat_ws("/", *[F.when(advisory(F.lit(s), c(s.lower())).isNotNull(), s) for s in ("G", "S")]))


def exposure_findings(exposed: DataFrame, current: DataFrame) -> DataFrame:
    """SWX-005 per recording: its exposed flights (recording, icao24, ...) while `current` (recording, conditions) has one."""
    n = exposed.groupBy("recording").agg(F.count(F.lit(1)).alias("aircraft"), F.max("max_abs_lat").alias("max_abs_lat"))
    return n.join(current.filter("conditions <> ''"), "recording").select("recording", F.lit("SWX-005").alias("rule_id"), F.lit("medium").alias("severity"), "aircraft", "max_abs_lat", "conditions")
