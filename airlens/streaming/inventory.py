"""The inventory of recordings, kept up as files arrive: what is kept can be merged, and no file is read twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.session import remove

c = F.col
_TABLES = {"polls": "recording string, batch_seq int, region string, batch_ts double, states long", "addresses": "recording string, icao24 string"}


class Inventory:
    """foreachBatch writer. Its state has one row a poll and region, and one an address of a recording; a micro-batch
    merges its own rows into the version that the one before has left, and older versions are removed. A poll may be
    spread over micro-batches. A retry writes the same version again."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _table(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return spark.createDataFrame([], _TABLES[name])
        return spark.read.schema(_TABLES[name]).parquet(f"{self.folder}/{name}/batch={batch_id}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        polls = batch.groupBy("recording", "batch_seq", "region").agg(F.max("batch_ts").alias("batch_ts"), F.count(F.lit(1)).alias("states")).select("recording", "batch_seq", "region", "batch_ts", "states")
        merged = polls.unionByName(self._table(spark, "polls", batch_id - 1)).groupBy("recording", "batch_seq", "region").agg(F.max("batch_ts").alias("batch_ts"), F.sum("states").alias("states"))
        merged.write.mode("overwrite").parquet(f"{self.folder}/polls/batch={batch_id}")
        seen = batch.select("recording", "icao24").unionByName(self._table(spark, "addresses", batch_id - 1)).distinct()
        seen.write.mode("overwrite").parquet(f"{self.folder}/addresses/batch={batch_id}")
        for name in _TABLES:
            remove(spark, f"{self.folder}/{name}/batch={batch_id - 2}")

    def table(self, spark: SparkSession) -> DataFrame:
        """Per recording: polls, states, aircraft, regions (a short closed list), span_s."""
        last = spark.read.parquet(f"{self.folder}/polls").agg(F.max("batch")).first()[0]
        polls = self._table(spark, "polls", last).groupBy("recording").agg(F.countDistinct("batch_seq").alias("polls"), F.sum("states").alias("states"), F.concat_ws(",", F.array_sort(F.collect_set("region"))).alias("regions"), (F.max("batch_ts") - F.min("batch_ts")).alias("span_s"))
        aircraft = self._table(spark, "addresses", last).groupBy("recording").agg(F.count("icao24").alias("aircraft"))
        return polls.join(aircraft, "recording").select("recording", "polls", "states", "aircraft", "regions", "span_s")
