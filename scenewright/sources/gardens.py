"""The table of gardens: where each one's drawing, footpaths, saved route and boundary lie, and how they fit together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright import schema as S

#: result is null where no route is saved yet; area is in units of 10,000 square metres, null if unknown.
SCHEMA = f"name string, dxf_file string, path_file string, offset {S.POINT}, start {S.POINT}, end {S.POINT}, result string, area double, boundary string, enabled boolean"


def read(spark: SparkSession, path: str | list[str], every: bool = False) -> DataFrame:
    """One row for each enabled garden (or each one) of JSON lines with the columns of SCHEMA; enabled unless it says otherwise."""
    found = spark.read.schema(SCHEMA).json(path).withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    return found if every else found.filter("enabled")
