"""What several operators need: a stored table to cut lineage, and columns kept apart from the operators' own names."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a scratch folder only where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="airlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read from there: lost executors recompute nothing before this."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """One struct column `row` of all columns, so that no name of the input can clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, names: list[str], *added: str) -> list[Column]:
    """The input's columns without those that an added column replaces, then the added ones."""
    new = {a.lower() for a in added}
    return [F.col(f"row.`{n}`").alias(n) for n in names if n.lower() not in new] + [F.col(a) for a in added]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def kept_by_worker(name: str, make: Callable):
    """What make() gives, made once in a Python worker and kept for its later tasks: functions travel by value, so the
    globals of their own module do not last."""
    home = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


#: rows of an Arrow batch at most, whatever the session allows: a batch of texts is held several times over
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from here on; a smaller limit of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def computed(df: DataFrame, text: str, keep: list[str], added: str, setup: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """The `keep` columns and the `added` ones (DDL), which setup()(text column of a batch) returns; nothing is shuffled.

    text: a column, or `struct.field` of a kept struct column, so that a text travels once. Kept columns with an added
    name are replaced.
    """
    small_batches(df.sparkSession)
    new = T.StructType.fromDDL(added)
    taken = {f.name.lower() for f in new}
    names = [k for k in keep if k.lower() not in taken]
    schema = T.StructType([df.schema[k] for k in names] + list(new))
    struct, _, field = text.partition(".")
    inside = bool(field) and text not in df.columns
    at = names.index(struct if inside else text) if (struct if inside else text) in names else len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = setup()
        for b in batches:
            if b.num_rows:
                values = compute(pc.struct_field(b.column(at), field) if inside else b.column(at))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *values], [*names, *new.names])
                del b, values
                pa.default_memory_pool().release_unused()

    own = [] if at < len(names) else [F.col(f"{struct}.`{field}`" if inside else f"`{text}`").alias("_text")]
    return df.select(*[F.col(f"`{k}`") for k in names], *own).mapInArrow(run, schema)
