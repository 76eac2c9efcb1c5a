"""Severity scales, risk score and trust penalties as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
SEVERITIES = ["critical", "high", "medium", "low", "info"]  # most severe first; the index is the rank
WEIGHT = {"info": 1.0, "low": 2.0, "medium": 4.0, "high": 8.0, "critical": 16.0}
PENALTY = {"critical": 0.60, "high": 0.35, "medium": 0.15, "low": 0.05, "info": 0.01}
CATEGORY_FACTOR = {"security": 1.0, "safety": 0.6, "ml": 0.5, "operations": 0.2, "data-quality": 0.4}
SOURCE_TRUST = {"adsb": 1.0, "asterix": 0.9, "mlat": 0.7, "tisb": 0.6, "adsc": 0.6, "flarm": 0.6}
DEFAULT_TRUST = 0.5
REPEAT_GAIN = 0.5
PRECISION_FLOOR = 0.2
ML_CAP = 4.0
RULE_PRECISION = {
    "SEC-003": 1.0,
    "SEC-010": 1.0,
    "SEC-011": 0.9054054054054054,
    "SEC-012": 1.0,
    "SEC-014": 1.0,
    "SEC-018": 0.7407407407407407,
    "ML-001": 0.24691358024691357,
}


def lookup(key: Column, values: dict[str, float], default: float | None = None) -> Column:
    """A small fixed map as one CASE, so it stays inside code generation."""
    expr = None
    for k, v in values.items():
        expr = F.when(key == k, v) if expr is None else expr.when(key == k, v)
    return expr if default is None else expr.otherwise(default)


def sev_rank(severity: Column) -> Column:
    return lookup(severity, {s: i for i, s in enumerate(SEVERITIES)}).cast("int")


def sev_name(rank: Column) -> Column:
    return F.when(rank.isNotNull(), F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank))


def risk_score(severity: Column, category: Column, rule_id: Column, repeats: Column, position_source: Column,
               precision: dict[str, float] | None = None) -> Column:
    """Expected-value score: weight x persistence x evidence quality x measured precision; model findings are capped."""
    prec = RULE_PRECISION if precision is None else precision
    repeat = 1.0 + REPEAT_GAIN * F.log2(F.greatest(repeats, F.lit(1)))
    quality = F.when(category == "security", 0.6 + 0.4 * lookup(position_source, SOURCE_TRUST, DEFAULT_TRUST)).otherwise(1.0)
    weight = lookup(severity, WEIGHT)
    measured = F.greatest(lookup(rule_id, prec, 1.0), F.lit(PRECISION_FLOOR)) if prec else F.lit(1.0)
    score = weight * repeat * quality * measured
    return F.when(category == "ml", F.least(score, F.lit(ML_CAP))).otherwise(score)


def trust_penalty(severity: Column, category: Column) -> Column:
    return lookup(severity, PENALTY) * lookup(category, CATEGORY_FACTOR, 0.5)


def rating(value: Column) -> Column:
    """Risk rating bands."""
    return F.when(value >= 15, "critical").when(value >= 10, "high").when(value >= 5, "medium").otherwise("low")
