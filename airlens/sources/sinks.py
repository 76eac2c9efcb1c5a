"""Outputs: recordings, reports, alerts, exports, the conjunction ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.functions.scoring import SEVERITIES
from airlens.schema import STATE_COLUMNS


def alerts(findings: DataFrame, threshold: str = "high") -> DataFrame:
    """Findings at least as severe as the threshold."""
    return findings.filter(F.col("sev_rank") <= SEVERITIES.index(threshold))


def write_alerts(findings: DataFrame, path: str, threshold: str = "high") -> None:
    alerts(findings, threshold).write.mode("append").json(path)


def to_batches(states: DataFrame, *more: str) -> DataFrame:
    """Back to one row per poll; the array is as long as the poll."""
    return (
        states.groupBy("recording", "batch_seq", F.col("batch_ts").alias("ts"), "provider", "region")
        .agg(F.array_sort(F.collect_list(F.struct("pos", *STATE_COLUMNS))).alias("_s"))
        .select("recording", *more, "ts", "provider", "region", F.lit(1).alias("schema_version"),
                F.transform("_s", lambda s: F.struct(*[s[n].alias(n) for n in STATE_COLUMNS])).alias("states"))
    )


def write_recording(states: DataFrame, path: str) -> None:
    """JSON lines, one poll per line, one folder per recording, polls in order over the files of a folder.

    Ranges of (recording, poll) are written side by side, so a long recording is several files; the reader takes the
    files of a folder by name.
    """
    ordered = to_batches(states, "batch_seq").repartitionByRange("recording", "batch_seq").sortWithinPartitions("recording", "batch_seq")
    ordered.drop("batch_seq").write.mode("append").partitionBy("recording").json(path)


def write_report(findings: DataFrame, summary: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").parquet(f"{path}/findings")
    summary.write.mode("overwrite").json(f"{path}/summary")


def csv_ready(df: DataFrame) -> DataFrame:
    """Arrays joined with ';' so that a row fits a CSV line."""
    return df.select(*[F.concat_ws(";", n).alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    csv_ready(df).write.mode("overwrite").option("header", True).csv(path)


def is_exportable(marker: Column) -> Column:
    """Rows with a redistribution marker stay inside."""
    return marker.isNull()


def restricted_share(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("restricted").isNotNull()).alias("restricted_rows"),
                      F.round(F.avg(F.col("restricted").isNotNull().cast("int")), 4).alias("restricted_share"))


def new_messages(messages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Messages whose (id, content hash) is neither repeated in the inbox nor already in the ledger."""
    key = ["message_id", "sha256"]
    return messages.dropDuplicates(key).join(ledger.select(*key), key, "left_anti")


def append_ledger(messages: DataFrame, ledger_path: str, ledger: DataFrame) -> None:
    new_messages(messages, ledger).write.mode("append").parquet(ledger_path)
