"""Reference tables shipped with the package (tens to a few hundred rows), as DataFrames and as SQL literals."""

from __future__ import annotations

import csv
from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

# column name -> Spark type for everything that is not a string
TYPED = {
    "lat": "double", "lon": "double", "elev_ft": "int", "major": "boolean", "radius_nm": "double",
    "lamin": "double", "lomin": "double", "lamax": "double", "lomax": "double",
    "rule_ord": "int", "sev_rank": "int", "weight": "double", "penalty": "double",
    "likelihood": "int", "impact": "int", "effectiveness": "double", "position": "int", "recall": "double",
    "level": "int", "floor": "int", "precision": "double", "limit": "double",
}


@lru_cache(maxsize=None)
def rows(name: str) -> tuple[tuple[str, ...], tuple[tuple[object, ...], ...]]:
    """Header and typed rows of one table."""
    text = resources.files(__package__).joinpath(f"{name}.csv").read_text().splitlines()
    reader = csv.reader(line for line in text if not line.startswith("#"))
    header = tuple(next(reader))
    cast = {"double": float, "int": int, "boolean": lambda v: v == "true"}
    out = []
    for r in reader:
        out.append(tuple(None if v == "" else cast.get(TYPED.get(h, ""), str)(v) for h, v in zip(header, r, strict=True)))
    return header, tuple(out)


def table(spark: SparkSession, name: str) -> DataFrame:
    header, data = rows(name)
    return spark.createDataFrame(list(data), ", ".join(f"`{h}` {TYPED.get(h, 'string')}" for h in header))


def values_sql(name: str) -> str:
    """The same table as a parenthesised SELECT over VALUES, for the SQL checks."""
    header, data = rows(name)

    def lit(h: str, v: object) -> str:
        kind = TYPED.get(h, "string")
        sql_type = {"double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN", "string": "VARCHAR"}[kind]
        if v is None:
            return f"CAST(NULL AS {sql_type})"
        if kind == "string":
            return "'" + str(v).replace("'", "''") + "'"
        if kind == "double":
            return f"CAST({v} AS DOUBLE)"
        return str(v).lower()

    body = ", ".join("(" + ", ".join(lit(h, v) for h, v in zip(header, r, strict=True)) + ")" for r in data)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(header)}))"
