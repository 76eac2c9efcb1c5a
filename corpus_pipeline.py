"""A training corpus from the documents, in five stages that each read what the one before has written.

Every stage takes (spark, docs, sf_dir) and returns a table: all but the last have the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.llm import compression_quality, lsh_forest, queries, sharding, suffix_matches
from airlens.llm.shared import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it is fitted on the labels outside the held-out quarter."""
    columns = docs.columns
    kept = docs.select(F.struct(*[F.col(f"`{n}`") for n in columns]).alias("row"))
    model = queries.quality_model(spark, sf_dir, docs)
    scored = compression_quality.scored(kept, model, "row.text")
    return scored.filter(F.col("score") >= queries.ACCEPT).select(*[F.col(f"row.`{n}`").alias(n) for n in columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents that share four fifths of their five-word shingles."""
    return lsh_forest.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item, or a whole shorter item."""
    columns = docs.columns
    kept = docs.select(F.struct(*[F.col(f"`{n}`") for n in columns]).alias("row"))
    clean = suffix_matches.decontaminated(spark, kept, queries.table(spark, sf_dir, "benchmark", "item_id", "text"), text="row.text")
    return clean.select(*[F.col(f"row.`{n}`").alias(n) for n in columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw of the documents whose tokens fit the target weights of sources, languages and topics."""
    columns = docs.columns
    kept = docs.select(F.struct(*[F.col(f"`{n}`") for n in columns]).alias("doc"), "source", "lang", "text")
    return queries.mix(kept).filter("drawn").select(*[F.col(f"doc.`{n}`").alias(n) for n in columns])


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in eight runs of the Hilbert order, with shard and slot."""
    return sharding.hilbert_shards(docs, queries.TEXT_DIMENSIONS, queries.SHARDS).drop("curve")


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("shards", shards)]

#: a classifier, a forest and a draw by a hash of Spark's are beyond SQL: tests/llm/test_pipeline.py has the brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
