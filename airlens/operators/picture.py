"""Filters and views over flights and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from airlens.functions.scoring import sev_name
from airlens.operators.bandjoin import LEAST_BUCKETS, salted_join

c = F.col


def _text(cols: list[str], needle: str) -> Column:
    return F.lower(F.concat_ws(" ", *cols)).contains(needle.lower())


def filter_findings(findings: DataFrame, severities: list[str] | None = None, rule: str | None = None, category: str | None = None, text: str | None = None) -> DataFrame:
    out = findings
    if severities:
        out = out.filter(c("severity").isin(severities))
    if rule:
        out = out.filter(c("rule_id") == rule)
    if category:
        out = out.filter(c("category") == category)
    if text:
        out = out.filter(_text(["rule_id", "icao24", "callsign"], text))
    return out


def latest_states(states: DataFrame) -> DataFrame:
    """The newest row of every aircraft of a recording: a partial aggregate per task, then one row per key."""
    cols = [n for n in states.columns if n not in ("recording", "icao24")]
    return states.groupBy("recording", "icao24").agg(F.max_by(F.struct(*cols), F.struct("batch_seq", "pos")).alias("_s")).select("recording", "icao24", "_s.*")


def recent_findings(picture: DataFrame, accepted: DataFrame, window_s: float = 600.0) -> DataFrame:
    """Per aircraft of the picture: rules and worst severity of the findings up to window_s before its report."""
    f = accepted.filter("icao24 is not null").select("recording", "icao24", c("batch_ts").alias("_fts"), "rule_id", "sev_rank")
    key = ["recording", "icao24"]
    # an aircraft's findings are dealt to several tasks, its one row is copied to each
    j = salted_join(f, picture.select(*key, c("batch_ts").alias("_now")), key, F.hash("rule_id", "_fts"), LEAST_BUCKETS).filter(c("_fts").between(c("_now") - window_s, c("_now")))
    # rules and severities are a closed set, so the set stays small
    found = j.groupBy(*key).agg(F.count(F.lit(1)).alias("findings"), F.array_sort(F.collect_set("rule_id")).alias("rules"), sev_name(F.min("sev_rank")).alias("worst"))
    none = F.array().cast("array<string>")
    return picture.select(*key).join(found, key, "left").select(*key, F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("rules", none).alias("rules"), "worst")


def flights(enriched: DataFrame, sort: str = "-baro_alt_ft", limit: int | None = None, *, operator: str | None = None, category: str | None = None, type_code: str | None = None,
            phase: str | None = None, airport: str | None = None, severity: str | None = None, source: str | None = None, min_alt: float | None = None,
            max_alt: float | None = None, text: str | None = None, tie: str = "icao24") -> DataFrame:
    """Filter chain of the flight list; a leading minus sorts descending, nulls last either way."""
    out = enriched
    for col, val in {"operator_code": operator, "type_cat": category, "aircraft_type": type_code, "phase": phase, "airport": airport, "worst": severity, "position_source": source}.items():
        if val is not None:
            out = out.filter(c(col) == val)
    if min_alt is not None:
        out = out.filter(c("baro_alt_ft") >= min_alt)
    if max_alt is not None:
        out = out.filter(c("baro_alt_ft") <= max_alt)
    if text:
        out = out.filter(_text(["icao24", "callsign", "registration", "operator", "aircraft_type"], text))
    key = sort.lstrip("+-")
    order = c(key).desc_nulls_last() if sort.startswith("-") else c(key).asc_nulls_last()
    if limit is not None:
        out = out.orderBy(order, tie).limit(limit)
    return out


def facets(enriched: DataFrame, cols: list[str]) -> DataFrame:
    """Values and counts per filter column, one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), c(n).cast("string").alias("value")) for n in cols])).alias("_p")
    return enriched.select(pairs).select("_p.*").filter("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("flights"))


def trail(states: DataFrame, points: int = 24) -> DataFrame:
    """The newest positions of every aircraft, oldest first; the ranking drops the rest before anything is collected."""
    w = W.partitionBy("recording", "icao24").orderBy(F.desc("batch_seq"), F.desc("pos"))
    s = states.filter("lat is not null and lon is not null").withColumn("_r", F.row_number().over(w)).filter(c("_r") <= points)
    return s.groupBy("recording", "icao24").agg(F.array_sort(F.collect_list(F.struct("batch_seq", "pos", "ts", "lat", "lon"))).alias("trail"))
