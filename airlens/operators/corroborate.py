"""Two feeds of the same sky: matches, disagreements and addresses seen by one feed only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from airlens.functions.geo import haversine_nm, move

c = F.col
MAX_DT_S = 90.0
BASE_TOLERANCE_NM = 1.5
DR_UNCERTAINTY_KT = 60.0


def _side(states: DataFrame) -> DataFrame:
    """Last positioned airborne row per poll and address."""
    cols = ["pos", "ts", "lat", "lon", "gs_kt", "track_deg", "callsign", "baro_alt_ft", "position_source"]
    s = states.filter("lat is not null and lon is not null and not on_ground")
    return s.groupBy("recording", "batch_seq", "icao24").agg(F.max_by(F.struct(*cols), "pos").alias("s"))


def compare(primary: DataFrame, secondary: DataFrame, tolerance_nm: float = BASE_TOLERANCE_NM) -> DataFrame:
    """Full outer comparison per poll and address; status is matched, disagree, only_primary, only_secondary or too_far_apart."""
    key = ["recording", "batch_seq", "icao24"]
    j = _side(primary).withColumnRenamed("s", "a").join(_side(secondary).withColumnRenamed("s", "b"), key, "full_outer")
    # the older fix is moved to the newer fix's time
    older = F.when(c("a.ts") < c("b.ts"), c("a")).otherwise(c("b"))
    newer = F.when(c("a.ts") < c("b.ts"), c("b")).otherwise(c("a"))
    j = j.withColumn("_o", older).withColumn("_n", newer).withColumn("dt_s", F.abs(c("a.ts") - c("b.ts")))
    lat, lon = move(c("_o.lat"), c("_o.lon"), c("_o.gs_kt"), c("_o.track_deg"), c("_n.ts") - c("_o.ts"))
    j = j.withColumn("separation_nm", F.when(c("dt_s") <= MAX_DT_S, haversine_nm(lat, lon, c("_n.lat"), c("_n.lon"))))
    j = j.withColumn("allowed_nm", tolerance_nm + DR_UNCERTAINTY_KT * c("dt_s") / 3600.0)
    status = (
        F.when(c("b").isNull(), "only_primary").when(c("a").isNull(), "only_secondary").when(c("separation_nm").isNull(), "too_far_apart")
        .when(c("separation_nm") > c("allowed_nm"), "disagree").otherwise("matched")
    )
    return j.select(*key, status.alias("status"), "dt_s", "separation_nm", "allowed_nm", F.trim(F.coalesce("a.callsign", "b.callsign")).alias("callsign"), c("_n.ts").alias("ts"))


def findings(cmp: DataFrame) -> DataFrame:
    sev = F.when(c("separation_nm") > 4 * c("allowed_nm"), "high").otherwise("medium")
    return cmp.filter("status = 'disagree'").select("recording", "batch_seq", "icao24", "ts", F.lit("SEC-015").alias("rule_id"), sev.alias("severity"), F.lit("security").alias("category"), F.round("separation_nm", 2).alias("measure"))


def summary(cmp: DataFrame) -> DataFrame:
    """Counts per recording with nearest-rank median and 95th percentile of the separation.

    Separations are counted per value of the reported precision (three decimals) first, so the ranked list is short and
    no task sorts the raw matches.
    """
    n = cmp.groupBy("recording").agg(
        F.count_if(c("status").isin("matched", "disagree")).alias("matched"), F.count_if(c("status") == "only_primary").alias("only_primary"),
        F.count_if(c("status") == "only_secondary").alias("only_secondary"), F.count_if(c("status") == "disagree").alias("disagreements"))
    v = cmp.filter("separation_nm is not null").groupBy("recording", F.round("separation_nm", 3).alias("sep")).agg(F.count(F.lit(1)).alias("k"))
    w = W.partitionBy("recording").orderBy("sep")
    v = v.withColumn("upto", F.sum("k").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("k").over(W.partitionBy("recording")))
    at = lambda idx: F.min(F.when(c("upto") > idx, c("sep")))
    q = v.groupBy("recording").agg(at(F.floor(c("total") / 2)).alias("median_sep_nm"), at(F.floor(0.95 * (c("total") - 1))).alias("p95_sep_nm"))
    return n.join(q, "recording", "left").fillna(0.0, ["median_sep_nm", "p95_sep_nm"])
