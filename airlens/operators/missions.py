"""Looking up launches and choosing which to record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.operators.airspace import launch_windows

c = F.col
LEAD_S, TAIL_S = 1800.0, 3600.0  # fixed values


def find_launch(launches: DataFrame, key: str) -> DataFrame:
    """The launch with this id, else the earliest whose name, pad or place contains the text: one filter, one row."""
    hay = F.lower(F.concat_ws(" ", "name", "pad", "location"))
    exact = c("launch_id") == key
    hits = launches.filter(exact | hay.contains(key.lower())).withColumn("_rank", F.when(exact, 0).otherwise(1))
    return hits.orderBy("_rank", c("window_start").asc_nulls_last(), "launch_id").limit(1).drop("_rank")


def capture_due(launches: DataFrame, finished: DataFrame, now: float, lead_s: float = LEAD_S, tail_s: float = TAIL_S) -> DataFrame:
    """Launches to record now, with the one to start with."""
    due = launch_windows(launches).filter((c("w0") - lead_s <= now) & (c("w1") - 1.0 + tail_s >= now)).join(finished, "launch_id", "left_anti")
    first = due.agg(F.min_by("launch_id", F.struct("w0", "launch_id")).alias("_first"))
    j = due.withColumn("_k", F.lit(1)).join(F.broadcast(first.withColumn("_k", F.lit(1))), "_k")
    return j.select("launch_id", (c("w0") - now).alias("starts_in_s"), (c("launch_id") == c("_first")).alias("picked"))
