"""The audit: features, rules, cool-down, score, trust, summary. One DataFrame plan from state rows to results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.functions.scoring import SEVERITIES, sev_name
from airlens.operators import proximity  # noqa: F401  (registers its rule)
from airlens.operators import folds, rules, tracks
from airlens.thresholds import DEFAULT, Thresholds


def candidates(states: DataFrame, t: Thresholds = DEFAULT, featured: DataFrame | None = None, extra: list[DataFrame] | None = None) -> DataFrame:
    """All candidate findings. `extra` takes findings of further phases in the same columns, such as those of
    `watchlist.findings` and `model.findings`; their phase and rule order put them in their place within the poll."""
    featured = tracks.with_features(states, t=t) if featured is None else featured
    parts = [rules.state_findings(featured, t)]
    parts += [fn(states, t) for fn in rules.BATCH_RULES.values()]
    parts += [rules.stream_findings(states, t), *(extra or [])]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def audit(states: DataFrame, t: Thresholds = DEFAULT, extra: list[DataFrame] | None = None) -> DataFrame:
    """Accepted, scored findings; extra findings go through cool-down and score like any other."""
    return folds.cooldown(candidates(states, t, extra=extra), t)


def by_category(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("recording", "category").agg(F.count(F.lit(1)).alias("findings"))


def by_severity(accepted: DataFrame) -> DataFrame:
    """Counts per recording and severity, zeros included."""
    counts = accepted.groupBy("recording", "severity").agg(F.count(F.lit(1)).alias("findings"))
    scale = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(i).alias("sev_rank")) for i, s in enumerate(SEVERITIES)])
    grid = counts.select("recording").distinct().select("recording", F.inline(scale))
    return grid.join(counts, ["recording", "severity"], "left").select("recording", "severity", "sev_rank", F.coalesce("findings", F.lit(0)).alias("findings"))


def summary(states: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row per recording: volume, integrity compliance and findings by severity."""
    adsb = "not on_ground and position_source like 'adsb%' and nic is not null"
    ok = "nic >= 7 and coalesce(nac_p, 0) >= 8 and coalesce(sil, 0) >= 3"
    traffic = states.groupBy("recording").agg(
        F.countDistinct("batch_seq").alias("batches"), F.count(F.lit(1)).alias("state_vectors"), F.countDistinct("icao24").alias("unique_aircraft"),
        F.min("batch_ts").alias("first_ts"), F.max("batch_ts").alias("last_ts"),
        F.count_if(F.expr(adsb)).alias("adsb_airborne_fixes"), F.count_if(F.expr(f"{adsb} and {ok}")).alias("_ok"),
    ).withColumn("adsb_compliance_rate", F.round(F.try_divide("_ok", "adsb_airborne_fixes"), 4)).drop("_ok")
    found = accepted.groupBy("recording").agg(
        F.count(F.lit(1)).alias("findings_total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return traffic.join(found, "recording", "left").fillna(0, subset=["findings_total", *SEVERITIES])


def top_aircraft(accepted: DataFrame, n: int = 10) -> DataFrame:
    return (
        accepted.filter("icao24 is not null").groupBy("icao24").agg(F.round(F.sum("risk_score"), 4).alias("risk"))
        .orderBy(F.desc("risk"), "icao24").limit(n)
    )


def worst(rank_col: str = "sev_rank"):
    return sev_name(F.min(rank_col))
